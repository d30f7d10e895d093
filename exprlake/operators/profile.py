"""A profile of all columns of a table in one pass, from states that can be stored and merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric, quoted

# Probabilities of the quantiles that a profile shows, and the columns that hold them.
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}

STATE = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("column_type", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("min_text", T.StringType()),
        T.StructField("max_text", T.StringType()),
        T.StructField("min_number", T.DoubleType()),
        T.StructField("max_number", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("m2", T.DoubleType()),
        T.StructField("distinct", T.BinaryType()),
        T.StructField("quantiles", T.BinaryType()),
    ]
)


def profile_state(df: DataFrame) -> DataFrame:
    """One STATE row for each column: counts, ends, moments, and sketches of different values and quantiles.

    One aggregation over one scan, whatever the number of columns; map tasks send a row each.
    """
    states = []
    for field in df.schema.fields:
        value = F.col(quoted(field.name))
        number = value.cast("double") if is_numeric(field.dataType) else F.lit(None).cast("double")
        text = value.cast("string")
        counted = F.count(value)
        squares = F.var_pop(number) * counted
        states.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("column_type"),
                F.count(F.lit(1)).alias("n_rows"),
                counted.alias("n_known"),
                F.min(text).alias("min_text"),
                F.max(text).alias("max_text"),
                F.min(number).alias("min_number"),
                F.max(number).alias("max_number"),
                F.avg(number).alias("mean"),
                squares.alias("m2"),
                F.hll_sketch_agg(text).alias("distinct"),
                F.kll_sketch_agg_double(number).alias("quantiles"),
            )
        )
    packed = df.agg(F.array(*states).alias("states"))
    return packed.select(F.inline("states")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE.fields])


def merge_states(states: DataFrame) -> DataFrame:
    """One STATE for each column of several, stacked: of parts of a table, that of the whole."""
    total = states.join(
        states.groupBy(F.col("column_name").alias("c"), F.col("column_type").alias("t")).agg(
            (F.sum(F.col("mean") * F.col("n_known")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n_known")))).alias("all_mean")
        ),
        (F.col("column_name") == F.col("c")) & (F.col("column_type") == F.col("t")),
    )
    # Squares around the common mean: those around the own mean, and that of the means' distance.
    apart = F.col("m2") + F.col("n_known") * F.pow(F.col("mean") - F.col("all_mean"), 2)
    return total.groupBy("column_name", "column_type").agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_known").alias("n_known"),
        F.min("min_text").alias("min_text"),
        F.max("max_text").alias("max_text"),
        F.min("min_number").alias("min_number"),
        F.max("max_number").alias("max_number"),
        F.max("all_mean").alias("mean"),
        F.sum(apart).alias("m2"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def profile_of(states: DataFrame) -> DataFrame:
    """What a user reads: a row for each column, with approximate different values and quartiles.

    Ends are numbers of numeric columns and texts of all others.  ``std`` is that of a sample.
    """
    is_number = F.col("min_number").isNotNull()

    def quantile(p: float) -> Column:
        known = F.kll_sketch_get_n_double("quantiles") > 0
        return F.when(known & is_number, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))

    return states.select(
        "column_name",
        "column_type",
        "n_rows",
        (F.col("n_rows") - F.col("n_known")).alias("n_null"),
        F.when(is_number, F.col("min_number").cast("string")).otherwise(F.col("min_text")).alias("min_value"),
        F.when(is_number, F.col("max_number").cast("string")).otherwise(F.col("max_text")).alias("max_value"),
        "mean",
        F.when(F.col("n_known") > 1, F.sqrt(F.col("m2") / (F.col("n_known") - 1))).alias("std"),
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
        *[quantile(p).alias(name) for name, p in QUARTILES.items()],
    )


def summarize_table(df: DataFrame) -> DataFrame:
    """The profile of a table; of an empty one, zero counts."""
    return profile_of(profile_state(df))


def summarize_parts(parts: list[DataFrame]) -> DataFrame:
    """The profile of several tables of one shape, from the state of each."""
    return profile_of(merge_states(reduce(DataFrame.unionByName, [profile_state(p) for p in parts])))
