"""Windows and as-of joins over groups of any size.

Spark computes a window in one task for each group, which a group with most of the rows does not survive.  Here
rows are cut into ranges of even size by (group, order).  A range is summarized by a few values, the summaries
of a group's earlier ranges are carried into the next, and rows are finished within their range: a prefix scan
in two passes.  No task holds more than a range, and what is carried has a row for each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import RANGE_ROWS
from ..session import materialize

KINDS = ("sum", "count", "min", "max", "last")


def running(
    df: DataFrame,
    by: list[str],
    order: list[str | Column],
    values: dict[str, tuple[str, str | None]],
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Add values over the rows of each ``by`` group from its first, in ``order``, up to and with the row itself.

    ``values`` says what each new column holds: ("sum", column), ("count", None) for the place of the row,
    ("count", column) for values so far, ("min", column), ("max", column), or ("last", column), the latest that
    is not NULL.  Rows that tie in ``order`` are taken in the order they were read in, which is the same for the
    whole result.  NULL is a group of its own.  An empty table stays empty.
    """
    unknown = {kind for kind, _ in values.values()} - set(KINDS)
    if unknown:
        raise ValueError(f"running values are {KINDS}, not {sorted(unknown)}")
    spark = df.sparkSession
    # Written out, as numbers and sampled bounds may differ between two runs of one plan.
    kept = materialize(df.withColumn("__tie", F.monotonically_increasing_id()), "ordered")
    ranges = max(kept.count() // range_rows + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(
        kept.repartitionByRange(ranges, *by, *order, "__tie").withColumn("__range", F.spark_partition_id()),
        "ordered-ranges",
    )
    inside = Window.partitionBy(*by, "__range").orderBy(*order, "__tie")
    placed = ranged.withColumn("__place", F.row_number().over(inside))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)

    summaries, carried, here, finished = [], [], [], []
    for i, (name, (kind, column)) in enumerate(values.items()):
        value = F.lit(1) if column is None else F.col(column)
        whole, earlier, mine = f"__w{i}", f"__e{i}", F.col(f"__h{i}")
        if kind == "last":
            summaries.append(F.max_by(value, F.when(value.isNotNull(), F.col("__place"))).alias(whole))
            carried.append(F.last(whole, ignorenulls=True).over(before).alias(earlier))
            here.append(F.last(value, ignorenulls=True).over(so_far).alias(f"__h{i}"))
            finished.append(F.coalesce(mine, F.col(earlier)).alias(name))
            continue
        aggregate = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind]
        join = {"sum": _plus, "count": _plus, "min": F.least, "max": F.greatest}[kind]
        summaries.append(aggregate(value).alias(whole))
        carried.append((F.sum if kind == "count" else aggregate)(whole).over(before).alias(earlier))
        here.append(aggregate(value).over(so_far).alias(f"__h{i}"))
        finished.append(join(mine, F.col(earlier)).alias(name))
    summary = placed.groupBy(*by, "__range").agg(*summaries)
    groups = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    carry = summary.select(*groups, F.col("__range").alias("__at"), *carried)
    same = [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
    same.append(F.col("__range") == F.col("__at"))
    return (
        placed.select(*df.columns, "__range", *here)
        .join(carry, reduce(Column.__and__, same))
        .select(*df.columns, *finished)
    )


def _plus(mine: Column, earlier: Column) -> Column:
    """The sum of two numbers of which either may be NULL."""
    return F.coalesce(mine + earlier, mine, earlier)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: list[str] | None = None,
    direction: str = "backward",
    tolerance: float | Column | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` that lies nearest to it by ``on``, and equal in ``by``.

    ``direction`` is "backward" (the last one not after it), "forward" (the first one not before it) or
    "nearest" (of these two the closer one, the earlier at a tie).  ``tolerance`` bounds the distance: a number,
    or an interval where ``on`` is a time.  ``right`` gives `on_right`-style columns: its ``on`` as
    ``{on}_right`` and all columns that are not in ``by``; they are NULL where nothing matches, as it is for
    NULL in ``by`` or ``on``.  Of rows of ``right`` that agree in both, the one with the greatest other columns
    counts.  Both sides are put into one order and cut into ranges, so a key with most of the rows is spread
    over tasks like any other.
    """
    by = list(by or [])
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction is 'backward', 'forward' or 'nearest', not {direction!r}")
    others = [c for c in right.columns if c not in by and c != on]
    clash = sorted(set(left.columns) & {*others, f"{on}_right"})
    if clash:
        raise ValueError(f"both sides have columns {clash}")
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*by, on]])
    rows = F.struct(*left.columns).alias("__left")
    found = right.filter(known).groupBy(*by, on).agg(F.max(F.struct(*others) if others else F.lit(True)).alias("__o"))
    # A row of the right side comes before the rows of the left side that it matches exactly.
    ours = left.select(*keys, F.col(on).alias("__t"), F.lit(1).alias("__side"), rows)
    theirs = found.select(
        *keys, F.col(on).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(on).alias("t"), "__o").alias("__right")
    )
    both = ours.unionByName(theirs, allowMissingColumns=True)
    here = F.col("__t").isNotNull()
    for name in names:
        here &= F.col(name).isNotNull()
    if direction != "forward":
        both = running(both, names, ["__t", "__side"], {"__back": ("last", "__right")}, range_rows)
    if direction != "backward":
        order = [F.col("__t").desc(), "__side"]
        both = running(both, names, order, {"__next": ("last", "__right")}, range_rows)
    back, ahead = F.col("__back"), F.col("__next")
    if direction == "nearest":
        closer = F.col("__t") - back["t"] <= ahead["t"] - F.col("__t")
        match = F.when(back.isNull(), ahead).when(ahead.isNull() | closer, back).otherwise(ahead)
    else:
        match = back if direction == "backward" else ahead
    if tolerance is not None:
        far = F.greatest(F.col("__t"), match["t"]) - F.least(F.col("__t"), match["t"])
        match = F.when(far <= tolerance, match)
    matched = both.filter(F.col("__left").isNotNull()).select("__left", F.when(here, match).alias("__m"))
    columns = [F.col("__left")[c].alias(c) for c in left.columns]
    return matched.select(
        *columns, F.col("__m.t").alias(f"{on}_right"), *[F.col("__m.__o")[c].alias(c) for c in others]
    )
