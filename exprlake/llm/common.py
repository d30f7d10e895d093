"""What several operators share: tables, scratch tables and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import PLAIN_READS, materialize, sibling_session

# Bytes of one batch of rows between Spark and a worker; long texts then come a few at a time.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, read in a session whose batches for workers are small."""
    session = sibling_session(spark, spark__sql__execution__arrow__maxBytesPerBatch=BATCH_BYTES)
    return session.read.options(**PLAIN_READS).parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node that it reaches.

    Alternating stars: each round hangs larger neighbours, then all neighbours, on the least one, until
    nothing changes.  Rounds grow with the logarithm of the longest chain.  Links of any number to one
    node are handled by sums and joins, never gathered; each round is a table in the shared folder.
    """
    links = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(),
        label,
    )
    state = _digest(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.filter("a <> b").distinct(), label)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = materialize(small.union(least).distinct(), label)
        before, state = state, _digest(links)
        if state == before:
            break
    nodes = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.union(roots)


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
