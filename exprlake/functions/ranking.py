"""Positions and first rows within groups, without putting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Rows of a key range: what one window task sorts.
RANGE_ROWS = 1_000_000


def first_rows(df: DataFrame, group: list[str], order: list[str | Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group.

    The filter on ``row_number`` lets Spark cut every group to ``k`` rows in each map
    task, so a hot group sends at most ``k`` rows per task through the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place")


def index_within(df: DataFrame, group: str, key: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the 0-based position of each row by ``key`` inside its ``group``.

    (group, key) has to be unique.  The input is cut into key ranges of even size:
    a group of any size spans many ranges, and a row's position is its place in the range
    plus the number of the group's rows in earlier ranges.  The ranges are written out
    first, because sampled bounds may differ between two runs of the same plan.
    """
    spark = df.sparkSession
    kept = materialize(df, "index")
    ranges = max(kept.count() // range_rows + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(
        kept.repartitionByRange(ranges, group, key).withColumn("__range", F.spark_partition_id()),
        "index-ranges",
    )
    # One row per (group, range): at most `ranges` rows plus one per group.
    sizes = ranged.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("__group"),
        F.col("__range").alias("__at"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"),
    )
    in_range = Window.partitionBy(group, "__range").orderBy(key)
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__range") == F.col("__at"))
    return (
        ranged.withColumn("__place", F.row_number().over(in_range) - 1)
        .join(starts, same)
        .withColumn(name, (F.col("__start") + F.col("__place")).cast("bigint"))
        .select(*df.columns, name)
    )
