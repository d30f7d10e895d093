"""Exact deduplication against a persistent index of text digests.

The index is a Parquet table bucketed and sorted by digest.  A load of new documents is digested once,
brought down to one candidate for each digest, and joined with the index by a sort-merge anti-join that
shuffles the candidates but never the index; what is left is appended.  Documents themselves never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

_ROWS = T.StructType(
    [
        T.StructField("load", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("place", T.LongType()),
    ]
)
# A group that holds more than one in so many rows is a hot one.  There are fewer than this many, whatever
# the corpus holds, which is the bound of the only broadcast.
HOT_GROUPS = 10_000


def unchanged(text: Column) -> Column:
    return text


@dataclass(frozen=True)
class DigestIndex:
    """An index below ``root``, a folder that all executors reach.

    ``entries`` is the bucketed table; a digest has an entry for each load that brought a larger doc_id
    than all before, so the newest entry names the row that stays.  ``rows`` keeps the digests of all
    rows ever seen, by load.
    """

    spark: SparkSession
    root: str
    table: str

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(f"{self.root}/rows")

    def current(self) -> DataFrame:
        """(digest, doc_id, load, place) of the row that stays, for each digest; the index is not shuffled."""
        newest = self.entries().groupBy("digest").agg(F.max(F.struct("doc_id", "load", "place")).alias("kept"))
        return newest.select("digest", "kept.*")


def open_index(spark: SparkSession, root: str, buckets: int | None = None) -> DigestIndex:
    """The index below ``root``, empty if nothing was added yet.

    A bucket should hold some hundred MB (some 50 bytes for each different text); the number is fixed when
    the index is made and read from there afterwards (default: the session's shuffle partitions).
    """
    shape = T.StructType([T.StructField("buckets", T.IntegerType())])
    if not _written(spark, f"{root}/shape"):
        wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.range(1).select(F.lit(wanted).alias("buckets")).write.mode("overwrite").parquet(f"{root}/shape")
    buckets = spark.read.schema(shape).parquet(f"{root}/shape").first()["buckets"]
    table = "digests_" + hashlib.sha256(root.encode()).hexdigest()[:24]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, doc_id BIGINT, load BIGINT, place BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{root}/entries'"
    )
    return DigestIndex(spark, root, table)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)


def add(
    index: DigestIndex, docs: DataFrame, load: int, normalize: Callable[[Column], Column] = unchanged
) -> DataFrame:
    """Take ``docs`` into the index as load number ``load``; gives the entries that were appended.

    Texts are equal when ``normalize`` makes them the same; a null text counts as empty.  Loads are numbered
    in the order they arrive.  A load that was broken off can be added again under its number: digests that
    were written to their end are used as they are, and what the index has already is not appended twice.
    Columns other than doc_id and text are ignored, a null doc_id is less than all others, an empty load
    changes nothing.
    """
    text = normalize(F.coalesce(F.col("text").cast("string"), F.lit("")))
    digests = docs.select(
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("place"),
    )
    path = f"{index.root}/rows/load={load}"
    if not _written(index.spark, path):
        digests.write.mode("overwrite").parquet(path)
    rows = index.spark.read.schema(T.StructType(_ROWS.fields[1:])).parquet(path)
    # One row for each digest: made in the map tasks first, so a text with many copies is one row of each task.
    best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "place")).alias("best"))
    best = best.select("digest", "best.doc_id", F.lit(load).cast("long").alias("load"), "best.place")
    new = materialize(_unknown(index, best), "new-digests")
    new.write.insertInto(index.table)
    index.spark.catalog.refreshTable(index.table)
    return new


def _unknown(index: DigestIndex, best: DataFrame) -> DataFrame:
    """Candidates that the index does not hold with this doc_id or a larger one."""
    known = index.entries().select(F.col("digest").alias("known"), F.col("doc_id").alias("known_id"))
    settled = F.coalesce(F.col("known_id") >= F.col("doc_id"), F.col("doc_id").isNull())
    return best.join(known.hint("merge"), (F.col("digest") == F.col("known")) & settled, "left_anti")


def decisions(index: DigestIndex) -> DataFrame:
    """(load, doc_id, keep_id, group_size, kept, digest) of every row of every load.

    Of equal texts the row with the largest doc_id stays; of rows that agree in that too, the one of the
    earliest load, and there the one that was read last, so exactly one row of each group is kept.
    """
    rows = index.rows()
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    kept = index.current().select(
        "digest", F.col("doc_id").alias("keep_id"), F.col("load").alias("keep_load"), F.col("place").alias("keep_place")
    )
    groups = materialize(sizes.join(kept, "digest"), "digest-groups")
    n_rows = groups.agg(F.sum("group_size")).first()[0] or 0
    is_hot = F.col("group_size") * HOT_GROUPS > n_rows
    hot = F.broadcast(groups.filter(is_hot))
    # Rows of hot groups stay where they are; the others are few for each digest and meet their group by a shuffle.
    several = rows.join(hot, "digest")
    few = rows.join(hot.select("digest"), "digest", "left_anti").join(groups.filter(~is_hot), "digest")
    return several.unionByName(few).select(
        "load",
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("load") == F.col("keep_load")) & (F.col("place") == F.col("keep_place"))).alias("kept"),
        "digest",
    )


def oracle() -> str:
    """DuckDB SQL for the decisions over a table whose doc_ids differ."""
    return """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
