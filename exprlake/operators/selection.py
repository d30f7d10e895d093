"""Exact order statistics of groups of any size, and what follows from them: quantiles and exact samples.

The value of a given rank is found by refinement: equi-depth edges from a mergeable sketch, exact counts between
them, and then only the stretch that holds the rank again.  Counts are combined in the map tasks and a stretch
is some thousandth of its parent, so a few passes of filters do what a sort of the whole group would, and no
task holds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, measured_side

# Stretches of up to so many rows are sorted; larger ones are cut by so many edges.
SORT_ROWS = 100_000
EDGES = 128
# Ranks of edges are off by at most this part of the rows.
SKETCH_ACCURACY = 10_000


def order_statistics(
    rows: DataFrame, targets: DataFrame, sort_rows: int = SORT_ROWS, edges: int = EDGES, written: bool = False
) -> DataFrame:
    """(g, rank, value, below) for each (g, rank) of ``targets``.

    ``rows`` has (g, v), any group and a number that is not NULL.  ``value`` is the one at place ``rank``, from
    0, of the group's values in order, ``below`` how many are less than it.
    A rank outside the group gives no row.  ``written`` says that ``rows`` are cheap to read again and again.
    """
    rows = rows.select("g", "v") if written else materialize(rows.select("g", "v"), "selection")
    grid = F.array(*[F.lit((i + 1) / (edges + 1)) for i in range(edges)])
    kind = rows.schema["v"].dataType
    none = F.lit(None).cast(kind)
    open_ = materialize(
        targets.select("g", "rank", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("below")).distinct(),
        "ranks",
    )
    found = []
    while True:
        stretches = open_.select(F.col("g").alias("h"), F.struct("low", "high", "below").alias("b")).distinct()
        stretches = measured_side(stretches, "stretches")
        within = (F.col("b.low").isNull() | (F.col("v") > F.col("b.low"))) & (
            F.col("b.high").isNull() | (F.col("v") < F.col("b.high"))
        )
        inside = rows.join(stretches, F.col("g").eqNullSafe(F.col("h")) & within).select("g", "v", "b")
        facts = materialize(
            inside.groupBy("g", "b").agg(
                F.count(F.lit(1)).alias("n"),
                F.percentile_approx("v", grid, SKETCH_ACCURACY).alias("edges"),
            ),
            "edges",
        )
        wanted = open_.select(
            F.col("g").alias("h"), "rank", F.struct("low", "high", "below").alias("c")
        )
        same = F.col("g").eqNullSafe(F.col("h")) & F.col("b").eqNullSafe(F.col("c"))

        few = measured_side(facts.filter(F.col("n") <= sort_rows).select(F.col("g").alias("x"), F.col("b").alias("y")), "few")
        sorted_ = inside.join(few, F.col("g").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y")), "left_semi")
        order = Window.partitionBy("g", "b").orderBy("v")
        place, less = (f.over(order) - 1 + F.col("b.below") for f in (F.row_number(), F.rank()))
        at = sorted_.select("g", "b", "v", place.alias("at"), less.alias("below"))
        found.append(
            at.join(wanted, same & (F.col("at") == F.col("rank"))).select(
                "g", "rank", F.col("v").alias("value"), "below"
            )
        )
        # Of the edges only those beside a wanted rank: every row is compared with all that are left.
        beside = F.floor((F.col("rank") - F.col("b.below")) / F.col("n") * (edges + 1)) - 1
        near = facts.filter(F.col("n") > sort_rows).join(wanted, same).groupBy("g", "b", "edges")
        near = near.agg(F.collect_set(beside).alias("near"))
        many = near.select(
            F.col("g").alias("x"),
            F.col("b").alias("y"),
            F.expr("array_distinct(filter(edges, (e, i) -> exists(near, p -> i >= p - 1 AND i <= p + 2)))").alias("edges"),
        )
        if many.isEmpty():
            break
        many = measured_side(many, "many")
        # An edge is a stretch of its own, so equal values end the search; the others lie between two edges.
        cut = inside.join(
            many, F.col("g").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y"))
        ).withColumn("less", F.size(F.filter("edges", lambda e: e < F.col("v"))))
        is_edge = F.array_contains("edges", F.col("v")).alias("is_edge")
        counted = cut.groupBy("g", "b", "less", is_edge).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("v").alias("least"),
            F.max("v").alias("most"),
        )
        order = Window.partitionBy("g", "b").orderBy("least")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("before", before + F.col("b.below"))
        holds = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        # The edges come back after the rows are counted: an aggregate that carries a list sorts its input.
        again = F.col("g").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y"))
        chosen = materialize(counted.join(wanted, same & holds).join(many, again), "chosen")
        equal = F.col("least") == F.col("most")
        found.append(chosen.filter(equal).select("g", "rank", F.col("least").alias("value"), F.col("before").alias("below")))
        open_ = materialize(
            chosen.filter(~equal).select(
                "g",
                "rank",
                F.coalesce(F.try_element_at("edges", F.nullif("less", F.lit(0))), F.col("b.low")).alias("low"),
                F.coalesce(F.try_element_at("edges", F.col("less") + 1), F.col("b.high")).alias("high"),
                F.col("before").alias("below"),
            ),
            "ranks",
        )
        if open_.isEmpty():
            break
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probabilities: list[float], sort_rows: int = SORT_ROWS
) -> DataFrame:
    """(by..., probability, quantile): continuous quantiles of each group, between the two nearest values.

    Equal to `percentile_cont` of a sorted group.  NULL values do not count, and a group of them alone has no
    row; NULL is a group in ``by``.
    """
    if not all(0 <= p <= 1 for p in probabilities):
        raise ValueError(f"probabilities lie between 0 and 1: {probabilities}")
    rows = df.select(F.struct(F.lit(1).alias("__one"), *by).alias("g"), F.col(value).cast("double").alias("v"))
    rows = materialize(rows.filter(F.col("v").isNotNull()), "quantile-rows")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    places = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select("g", "n", wanted)
    places = places.withColumn("at", F.col("p") * (F.col("n") - 1))
    places = places.select("g", "p", F.floor("at").alias("low"), F.ceil("at").alias("high"), "at")
    ranks = places.select("g", F.explode(F.array("low", "high")).alias("rank"))
    values = materialize(order_statistics(rows, ranks, sort_rows, written=True), "order-statistics")

    def at(end: str) -> DataFrame:
        names = [F.col("g").alias(f"g_{end}"), F.col("rank").alias(f"rank_{end}"), F.col("value").alias(f"value_{end}")]
        return values.select(*names)

    both = places
    for end in ("low", "high"):
        both = both.join(at(end), F.col("g").eqNullSafe(F.col(f"g_{end}")) & (F.col(end) == F.col(f"rank_{end}")))
    between = F.col("value_low") + (F.col("value_high") - F.col("value_low")) * (F.col("at") - F.col("low"))
    return both.select(*[F.col("g")[c].alias(c) for c in by], F.col("p").alias("probability"), between.alias("quantile"))


def stratified_sample(
    df: DataFrame, by: list[str], size: int, key: list[str], seed: int = 0, sort_rows: int = SORT_ROWS
) -> DataFrame:
    """Exactly ``size`` rows of each stratum, or all of a smaller one.

    Rows with the least hashes of ``key`` (which tells rows apart) and ``seed`` are taken, so the sample is the
    same at every run and on every cluster.  The hash at place ``size`` is found for each stratum, and the
    sample is a filter by it: no stratum meets in a task.  NULL is a stratum.
    """
    if size < 0:
        raise ValueError(f"a sample has no {size} rows")
    # 52 bits, so that numbers and their sketches are exact; of a hash that other engines have too.
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    hashed = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    rows = df.select(F.struct(F.lit(1).alias("__one"), *by).alias("g"), hashed.alias("v"))
    rows = materialize(rows, "strata")
    full = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size)
    targets = full.select("g", F.lit(size).cast("long").alias("rank"))
    limits = order_statistics(rows, targets, sort_rows, written=True).select(
        F.col("g").alias("__g"), F.col("value").alias("__limit"), (F.lit(size) - F.col("below")).alias("__more")
    )
    place = F.struct(F.lit(1).alias("__one"), *by)
    judged = df.withColumn("__hash", hashed).join(measured_side(limits, "limits"), place.eqNullSafe(F.col("__g")), "left")
    # Written, so that the hashes are made once and not for each of the two parts.
    judged = materialize(judged.filter(F.col("__limit").isNull() | (F.col("__hash") <= F.col("__limit"))), "judged")
    below = judged.filter(F.col("__limit").isNull() | (F.col("__hash") < F.col("__limit")))
    # Keys that share the hash at the limit, one as a rule, fill up what is missing.
    equal = Window.partitionBy(*by).orderBy(*key)
    ties = judged.filter(F.col("__hash") == F.col("__limit")).withColumn("__place", F.row_number().over(equal))
    return below.select(*df.columns).union(ties.filter(F.col("__place") <= F.col("__more")).select(*df.columns))
