"""Sessions and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# What the library expects of a session.  Names of samples may differ only in case
# (`a1`, `A1`) and `"name"` has to mean an identifier, as in the SQL users know.
ENGINE_CONF = {
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def sibling_session(spark: SparkSession, **overrides: str) -> SparkSession:
    """A session on the same application, with its own temp views and settings.

    Runtime settings of ``spark`` are carried over; ``overrides`` win (``__`` in a name
    stands for a dot).
    """
    sibling = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            sibling.conf.set(key, value)
    for key, value in overrides.items():
        sibling.conf.set(key.replace("__", "."), value)
    return sibling


def engine_session(spark: SparkSession) -> SparkSession:
    """A sibling session with the settings the matrix readers need."""
    return sibling_session(spark, **{k.replace(".", "__"): v for k, v in ENGINE_CONF.items()})


_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for materialised tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temp folder is used, and only in local mode: executors of a
    cluster could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="exprlake-")
    return _LOCAL_SCRATCH[context.applicationId]


def new_scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that nothing has used yet."""
    return f"{scratch_root(spark)}/exprlake/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


_TEMPORARY: ContextVar[list[str] | None] = ContextVar("temporary", default=None)

# Parquet looks at the size of a page and of a row group after 100 rows at the earliest, and its codec keeps direct
# memory for the largest page of an executor's life.  Rows here may be batches of several MB, so it looks from the first.
SIZED_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
# Vectored reads go through direct buffers of whole column chunks, which the threads that read keep.
PLAIN_READS = {"parquet.hadoop.vectored.io.enabled": "false"}


def materialize(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner real sizes.  The table stays, unless
    `temporary_tables` encloses the call and it does not outlive that.
    """
    path = new_scratch_path(df.sparkSession, label)
    df.write.options(**SIZED_PAGES).parquet(path)
    listed = _TEMPORARY.get()
    if listed is not None and not outlives:
        listed.append(path)
    return df.sparkSession.read.options(**PLAIN_READS).schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove at the end all tables that `materialize` writes inside, but those that outlive it.

    Only tables that outlive it may be read afterwards.
    """
    listed: list[str] = []
    before = _TEMPORARY.set(listed)
    try:
        yield
    finally:
        _TEMPORARY.reset(before)
        for path in listed:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside are removed when it ends; otherwise they stay until the driver
    collects garbage, beside those of all queries since."""
    before = spark.conf.get(REMOVE_SHUFFLES)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def materialize_slices(df: DataFrame, label: str, column: str) -> DataFrame:
    """`materialize` into a folder for each value of ``column``, a whole number; a filter on it reads those folders alone."""
    spark = df.sparkSession
    path = new_scratch_path(spark, label)
    # A cell is read a few times and mostly repeats others: it is worth packing well.
    df.write.options(**SIZED_PAGES, compression="zstd").partitionBy(column).parquet(path)
    listed = _TEMPORARY.get()
    if listed is not None:
        listed.append(path)
    return spark.read.options(**PLAIN_READS).schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, label: str, column: str) -> DataFrame:
    """`materialize` into a table dealt by ``column``: what needs equal values of it together does not shuffle it.

    It has as many buckets as the session has shuffle partitions, and outlives `temporary_tables`.
    """
    spark = df.sparkSession
    path, name = new_scratch_path(spark, label), f"buckets_{uuid.uuid4().hex}"
    writer = df.write.options(**SIZED_PAGES).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column)
    writer.saveAsTable(name, format="parquet", path=path)
    return spark.read.options(**PLAIN_READS).table(name)


# What a set may measure to be broadcast, and what a row of it costs besides its text.
BROADCAST_BYTES = 128 * 1024**2
ROW_BYTES = 64
ITEM_BYTES = 16


def measured_side(df: DataFrame, label: str) -> DataFrame:
    """Compute the small side of a matrix join first, and broadcast it if it measures small.

    Left to itself Spark starts to shuffle the matrix before it knows how small the other
    side came out.  Above the bound the join is planned as usual.
    """
    kept = materialize(df, label)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType == T.StringType()]
    lists = [F.greatest(F.size(f.name), F.lit(0)) * ITEM_BYTES for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    row = sum(texts + lists, F.lit(ROW_BYTES))
    size = kept.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(kept) if size <= BROADCAST_BYTES else kept


def small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Driver rows as a relation whose size the planner knows.

    A frame made from a plain list has no size estimate, so joins with it would be planned
    as shuffles; handed over as Arrow it is broadcast if it is below the threshold.
    """
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [() for _ in arrow]
    return spark.createDataFrame(
        pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema
    )
