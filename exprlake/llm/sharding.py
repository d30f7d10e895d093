"""Uniform shuffle into shards of exact sizes, with DataFrame functions only.

Rows lie in source groups.  A communication matrix says how many rows of each group go to each shard; it
is drawn from the multivariate hypergeometric law, as a uniform permutation of all rows would fill it.
Each group is then permuted by itself and dealt out by its row of the matrix, and each shard is permuted
again after the exchange.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize

LAW = "rows"
# Rows of one window task, about.
ROWS_PER_GROUP = 200_000


def hypergeometric(draw: random.Random, good: int, bad: int, sample: int) -> int:
    """How many good items a sample without replacement holds.

    Inversion outwards from the mode: exact to floating point for any size, in steps of the order of the
    standard deviation.
    """
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample))
    left, below, above = draw.random() - peak, peak, peak
    a = b = mode
    while left > 0 and (a > low or b < high):
        if b < high:
            above *= (good - b) * (sample - b) / ((b + 1) * (bad - sample + b + 1))
            b += 1
            left -= above
            if left <= 0:
                return b
        if a > low:
            below *= a * (bad - sample + a) / ((good - a + 1) * (sample - a + 1))
            a -= 1
            left -= below
            if left <= 0:
                return a
        if above + below == 0.0:
            break
    return mode


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows of each source for each shard, with the given row and column sums."""
    draw = random.Random(seed)
    left = list(shards)
    out = []
    for size in sources:
        total, need, row = sum(left), size, []
        for have in left:
            take = hypergeometric(draw, have, total - have, need)
            row.append(take)
            total -= have
            need -= take
        left = [have - take for have, take in zip(left, row)]
        out.append(row)
    return out


def shuffle_into_shards(
    docs: DataFrame, shards: int, seed: int = 17, rows_per_group: int = ROWS_PER_GROUP
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in a uniformly drawn place of a shard.

    Shards differ by at most one row; ``slot`` counts from 0 in each.  ``size`` is the UTF-8 bytes of
    the text and 8, ``text_crc32`` their checksum; a null text has no bytes.  Only doc_id and text are
    read, so other columns cannot clash.  Repeated rows are rows of their own.  An empty table gives no
    rows.  The places are written once, so a lost executor changes nothing.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__row"),
    )
    # Written before it is used: row numbers depend on how the input was split.
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    groups = max(128, total // rows_per_group)
    rows = rows.withColumn("__source", F.pmod(F.xxhash64("__row", F.lit(seed)), F.lit(groups)).cast("int"))
    rows = rows.withColumn("__key", F.xxhash64("__row", F.lit(seed + 1)))
    sizes = {r["__source"]: r["n"] for r in rows.groupBy("__source").agg(F.count(F.lit(1)).alias("n")).collect()}
    sources = sorted(sizes)
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([sizes[s] for s in sources], goal, seed)
    # One row per source group: from which local place on its rows go to which shard.
    dealt = []
    for source, row in zip(sources, matrix):
        ends = []
        for take in row:
            ends.append((ends[-1] if ends else 0) + take)
        dealt.append((source, ends))
    schema = StructType.fromDDL("__source int, __ends array<long>")
    ends = rows.sparkSession.createDataFrame(dealt, schema)
    local = Window.partitionBy("__source").orderBy("__key", "__row")
    placed = (
        rows.withColumn("__place", F.row_number().over(local) - 1)
        .join(ends, "__source")
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e <= F.col("__place"))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "__row")
    )
    # The second permutation: a fresh key, whose leading part cuts a shard into groups of bounded size.
    cells = max(8, total // shards // rows_per_group)
    placed = placed.withColumn("__key", F.xxhash64("__row", F.lit(seed + 2)))
    placed = placed.withColumn("__cell", F.pmod(F.xxhash64("__row", F.lit(seed + 3)), F.lit(cells)).cast("int"))
    placed = materialize(placed, "shards")
    counts = placed.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    in_cell = Window.partitionBy("shard", "__cell").orderBy("__key", "__row")
    return (
        placed.withColumn("__place", F.row_number().over(in_cell) - 1)
        .join(starts, ["shard", "__cell"])
        .select(
            "doc_id", "size", "text_crc32", "shard", (F.col("__start") + F.col("__place")).cast("long").alias("slot")
        )
    )
