"""Joins of intervals by dyadic nodes.

An interval of whole numbers is cut into at most two nodes of each size: stretches of 2^k numbers that start at
a multiple of 2^k.  A point lies in one node of each size, and in at most one of those that make up an interval,
so "a point in an interval" is an equality join on nodes.  Two intervals overlap when one starts inside the
other, which happens in one way only: every pair is found once, with no comparison of all with all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _nodes(low: str, high: str) -> Column:
    """The nodes (k, number) that make up the numbers from ``low`` to ``high``, for expressions of type long."""
    # Of size 2^k: the first node that starts at or after `low`, and the first one that is not whole.
    first = f"shiftright({low} + shiftleft(1L, k) - 1L, k)"
    past = f"shiftright({high} + 1L, k)"
    taken = f"""filter(array(
        if({first} % 2 <> 0, struct(k AS k, {first} AS node), NULL),
        if({past} % 2 <> 0, struct(k AS k, {past} - 1L AS node), NULL)), x -> x IS NOT NULL)"""
    sizes = f"sequence(0, length(bin({high} - {low} + 1L)) - 1)"
    return F.expr(f"flatten(transform({sizes}, k -> if({first} < {past}, {taken}, array())))")


def _starts_inside(
    points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, by: list[str], by_intervals: list[str]
) -> DataFrame:
    """(__p, __i): rows of ``points`` and the rows of ``intervals`` from ``low`` to ``high`` that hold their ``at``."""
    keys = [F.col(c).alias(f"__b{n}") for n, c in enumerate(by)]
    keys_i = [F.col(c).alias(f"__b{n}") for n, c in enumerate(by_intervals)]
    names = [f"__b{n}" for n in range(len(by))]
    known = reduce(Column.__and__, [F.lit(True), *[F.col(c).isNotNull() for c in by_intervals]])
    held = intervals.filter(known & F.expr(f"{low} <= {high}")).select(
        *keys_i, F.struct(*intervals.columns).alias("__i"), F.explode(_nodes(low, high)).alias("__n")
    )
    # A point looks only at sizes that occur: at most one for each bit of a number.
    sizes = sorted(r["k"] for r in held.select("__n.k").distinct().collect())
    levels = "array(" + ", ".join(map(str, sizes)) + ")" if sizes else "cast(array() as array<int>)"
    above = F.expr(f"transform({levels}, k -> struct(k AS k, shiftright({at}, k) AS node))")
    points = points.filter(F.expr(f"{at} IS NOT NULL")).select(
        *keys, F.struct(*points.columns).alias("__p"), F.explode(above).alias("__n")
    )
    # The planner knows a side by the size of its rows before they are cut into nodes, each with the whole row:
    # left to itself it would broadcast many times what it believes to.
    return points.join(held.hint("merge"), [*names, "__n"]).select("__p", "__i")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_on: tuple[str, str],
    right_on: tuple[str, str],
    by: list[str] | None = None,
) -> DataFrame:
    """All pairs of rows whose intervals share a number, and that are equal in ``by``.

    ``left_on`` and ``right_on`` name the first and last number (whole numbers below 2^61 in size, both
    included) of each side's intervals.  Rows whose interval is empty or has a NULL end, or with NULL in ``by``,
    match nothing.  The result has the columns of ``left`` and those of ``right`` but ``by``, which may not
    clash.  An interval gives a row for each of its nodes, at most two for each doubling of its length; a start
    one for each size that occurs.
    """
    by = list(by or [])
    others = [c for c in right.columns if c not in by]
    clash = sorted(set(left.columns) & set(others))
    if clash:
        raise ValueError(f"both sides have columns {clash}")
    a, b = (left_on, right_on)

    def whole(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        low, high = (F.col(c).cast("long") for c in ends)
        return df.withColumns({"__low": low, "__high": high}).filter("__low <= __high")

    ours, theirs = whole(left, a), whole(right, b)
    in_right = _starts_inside(ours, "__low", theirs, "__low", "__high", by, by)
    # The other way round without equal starts, which the first join has.
    in_left = _starts_inside(theirs, "__low", ours, "(__low + 1L)", "__high", by, by)
    pairs = in_right.select("__p", "__i").union(in_left.select(F.col("__i"), F.col("__p")))
    return pairs.select(
        *[F.col("__p")[c].alias(c) for c in left.columns], *[F.col("__i")[c].alias(c) for c in others]
    )
