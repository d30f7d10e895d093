"""The driver's star-schema tables seen as releases.

Mapping A: a sample is an order, a compound a customer, a gene a part, a release an order
priority.  Mapping B: a sample is a supplier, a compound a nation, a release a region.
Mapping E: a sample is an event; its `props` is an extra text column.  `SQL` holds the same
definitions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.matrix import estimate_size
from .session import measured_side
from .sources.catalog import catalog_stats
from .sources.frames import ReleaseFrames

# Quantities up to this become zeros of the matrix.
ZERO_UP_TO = 45


_SCHEMAS: dict[str, T.StructType] = {}

# Matrix rows that a part may have where line numbers tell them apart.
ROWS_PER_PART = 8

# Fixed value: releases of mapping B, named 0 to 4 after the regions.
RELEASES_B = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables.  Its footer is looked at once; later reads declare the schema."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _release() -> Column:
    return F.concat(F.lit("job-"), F.substring("o_orderpriority", 1, 1)).alias("job_id")


# --- mapping A -----------------------------------------------------------------------


def catalog_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("substr(o_orderpriority, 3)").alias("job_name")
    return table(spark, sf_dir, "orders").select(_release(), name).distinct()


def metadata_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("sequenced_id"),
        _release(),
        F.col("o_custkey").cast("string").alias("compound"),
        F.col("c_name").alias("user_compound_id"),
        F.col("c_mktsegment").alias("cell_line"),
        F.when(F.month("o_orderdate") <= 6, "24h").otherwise("48h").alias("timepoint"),
        (F.col("o_orderstatus") == "F").alias("is_control"),
        (F.col("o_totalprice") / 10000).alias("percent_mitochondrial"),
        F.floor("o_totalprice").cast("bigint").alias("total_sequenced_reads"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("sampled_on"),
    )


def chemistry_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compound once for each release that used it."""
    used = table(spark, sf_dir, "orders").select(_release(), "o_custkey").distinct()
    customers = table(spark, sf_dir, "customer")
    return used.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "job_id",
        F.col("c_custkey").cast("string").alias("compound"),
        F.col("c_name").alias("user_compound_id"),
        F.col("c_mktsegment").alias("smiles"),
        F.col("c_acctbal").alias("log_p"),
    )


def sequencing_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are summed per (order, part) before they meet their orders."""
    cells = _cells(table(spark, sf_dir, "lineitem"), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _release())
    return cells.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "job_id",
        F.col("l_partkey").cast("string").alias("gene_id"),
        F.col("l_orderkey").cast("string").alias("sequenced_id"),
        "value",
    )


def sequencing_raw_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell per line item: an order with a part twice has a duplicate cell."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _release())
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "job_id",
        F.col("l_partkey").cast("string").alias("gene_id"),
        F.col("l_orderkey").cast("string").alias("sequenced_id"),
        _value().alias("value"),
    )


def sequencing_rows_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a matrix with a row for each (part, line number): a gene stands in up to seven rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _release())
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "job_id",
        F.col("l_partkey").cast("string").alias("gene_id"),
        F.col("l_orderkey").cast("string").alias("sequenced_id"),
        _value().alias("value"),
        (F.col("l_partkey") * ROWS_PER_PART + F.col("l_linenumber")).alias("gene_row"),
    )


def sequencing_rows_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as above with suppliers as samples: a supplier that sold a part on one line number twice is there twice."""
    samples = metadata_b(spark, sf_dir).select("job_id", "sequenced_id")
    cells = table(spark, sf_dir, "lineitem")
    return cells.join(samples, F.col("l_suppkey").cast("string") == F.col("sequenced_id")).select(
        "job_id",
        F.col("l_partkey").cast("string").alias("gene_id"),
        "sequenced_id",
        _value().alias("value"),
        (F.col("l_partkey") * ROWS_PER_PART + F.col("l_linenumber")).alias("gene_row"),
    )


def metadata_raw_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, so samples repeat; the line number is the ingest order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", _release())
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("sequenced_id"),
        "job_id",
        F.col("l_returnflag").alias("cell_line"),
        (F.col("o_orderstatus") == "F").alias("is_control"),
        F.floor("l_extendedprice").cast("bigint").alias("total_sequenced_reads"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("ingest_ordinal"),
    )


def _value() -> Column:
    return F.greatest(F.col("l_quantity") - ZERO_UP_TO, F.lit(0).cast("double"))


def _cells(lineitem: DataFrame, sample: str) -> DataFrame:
    return lineitem.groupBy(sample, "l_partkey").agg(F.sum(_value()).alias("value"))


# --- mapping B -----------------------------------------------------------------------


def catalog_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("string").alias("job_id"), F.col("r_name").alias("job_name")
    )


def metadata_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(nations, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("sequenced_id"),
        F.col("n_regionkey").cast("string").alias("job_id"),
        F.col("n_nationkey").cast("string").alias("compound"),
        F.col("n_name").alias("user_compound_id"),
        (F.col("s_acctbal") < 0).alias("is_control"),
        F.col("s_acctbal").alias("percent_mitochondrial"),
    )


def chemistry_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("string").alias("job_id"),
        F.col("n_nationkey").cast("string").alias("compound"),
        F.col("n_name").alias("user_compound_id"),
    ).distinct()


def observed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells a release has; the others stay absent instead of being filled with every pair."""
    cells = _cells(table(spark, sf_dir, "lineitem"), "l_suppkey")
    samples = measured_side(metadata_b(spark, sf_dir).select("job_id", "sequenced_id"), "samples")
    return cells.join(samples, F.col("l_suppkey").cast("string") == F.col("sequenced_id")).select(
        "job_id", F.col("l_partkey").cast("string").alias("gene_id"), "sequenced_id", "value"
    )


# --- mapping E -----------------------------------------------------------------------


def catalog_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.select(F.col("event_type").alias("job_id"), F.upper("event_type").alias("job_name"))


def metadata_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("sequenced_id"),
        F.col("event_type").alias("job_id"),
        F.col("user_id").cast("string").alias("compound"),
        "props",
    )


def chemistry_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("job_id"), F.col("user_id").cast("string").alias("compound")
    ).distinct()


# --- sources -------------------------------------------------------------------------


def release_a(sf_dir: str) -> ReleaseFrames:
    return ReleaseFrames(
        lambda s: catalog_a(s, sf_dir),
        lambda s: metadata_a(s, sf_dir),
        lambda s: chemistry_a(s, sf_dir),
        lambda s: sequencing_a(s, sf_dir),
    )


def release_b(sf_dir: str) -> ReleaseFrames:
    return ReleaseFrames(
        lambda s: catalog_b(s, sf_dir),
        lambda s: metadata_b(s, sf_dir),
        lambda s: chemistry_b(s, sf_dir),
        lambda s: observed_b(s, sf_dir),
    )


def release_e(sf_dir: str) -> ReleaseFrames:
    return ReleaseFrames(
        lambda s: catalog_e(s, sf_dir),
        lambda s: metadata_e(s, sf_dir),
        lambda s: chemistry_e(s, sf_dir),
        lambda s: observed_b(s, sf_dir),
    )


def described_catalog(catalog: DataFrame, sequencing: DataFrame, metadata: DataFrame) -> DataFrame:
    """A catalog with the statistics a service would publish."""
    sizes = estimate_size(sequencing).select("job_id", F.col("estimated_bytes").alias("parquet_file_size_bytes"))
    return (
        catalog.join(catalog_stats(sequencing, metadata), "job_id", "left")
        .join(sizes, "job_id", "left")
        .withColumn("is_public", F.lit(True))
    )


# --- the same for DuckDB -------------------------------------------------------------

SQL = {
    "catalog_a": """
        SELECT DISTINCT 'job-' || substr(o_orderpriority, 1, 1) AS job_id, substr(o_orderpriority, 3) AS job_name
        FROM orders""",
    "metadata_a": """
        SELECT CAST(o_orderkey AS VARCHAR) AS sequenced_id, 'job-' || substr(o_orderpriority, 1, 1) AS job_id,
               CAST(o_custkey AS VARCHAR) AS compound, c_name AS user_compound_id, c_mktsegment AS cell_line,
               CASE WHEN month(o_orderdate) <= 6 THEN '24h' ELSE '48h' END AS timepoint,
               (o_orderstatus = 'F') AS is_control, o_totalprice / 10000 AS percent_mitochondrial,
               CAST(floor(o_totalprice) AS BIGINT) AS total_sequenced_reads, strftime(o_orderdate, '%Y-%m-%d') AS sampled_on
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "chemistry_a": """
        SELECT DISTINCT 'job-' || substr(o_orderpriority, 1, 1) AS job_id, CAST(c_custkey AS VARCHAR) AS compound,
               c_name AS user_compound_id, c_mktsegment AS smiles, c_acctbal AS log_p
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "sequencing_a": """
        SELECT 'job-' || substr(o_orderpriority, 1, 1) AS job_id, CAST(l_partkey AS VARCHAR) AS gene_id,
               CAST(l_orderkey AS VARCHAR) AS sequenced_id, sum(greatest(l_quantity - 45, 0)) AS value
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""",
    "sequencing_raw_a": """
        SELECT 'job-' || substr(o_orderpriority, 1, 1) AS job_id, CAST(l_partkey AS VARCHAR) AS gene_id,
               CAST(l_orderkey AS VARCHAR) AS sequenced_id, greatest(l_quantity - 45, 0) AS value
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "sequencing_rows_a": """
        SELECT 'job-' || substr(o_orderpriority, 1, 1) AS job_id, CAST(l_partkey AS VARCHAR) AS gene_id,
               CAST(l_orderkey AS VARCHAR) AS sequenced_id, l_partkey * 8 + l_linenumber AS gene_row
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "sequencing_rows_b": """
        SELECT m.job_id, CAST(l_partkey AS VARCHAR) AS gene_id, m.sequenced_id, l_partkey * 8 + l_linenumber AS gene_row
        FROM lineitem JOIN metadata_b m ON m.sequenced_id = CAST(l_suppkey AS VARCHAR)""",
    "metadata_raw_a": """
        SELECT CAST(l_orderkey AS VARCHAR) AS sequenced_id, 'job-' || substr(o_orderpriority, 1, 1) AS job_id,
               l_returnflag AS cell_line, (o_orderstatus = 'F') AS is_control,
               CAST(floor(l_extendedprice) AS BIGINT) AS total_sequenced_reads,
               l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "catalog_b": """
        SELECT CAST(r_regionkey AS VARCHAR) AS job_id, r_name AS job_name FROM region""",
    "metadata_b": """
        SELECT CAST(s_suppkey AS VARCHAR) AS sequenced_id, CAST(n_regionkey AS VARCHAR) AS job_id,
               CAST(n_nationkey AS VARCHAR) AS compound, n_name AS user_compound_id,
               (s_acctbal < 0) AS is_control, s_acctbal AS percent_mitochondrial
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "chemistry_b": """
        SELECT DISTINCT CAST(n_regionkey AS VARCHAR) AS job_id, CAST(n_nationkey AS VARCHAR) AS compound,
               n_name AS user_compound_id
        FROM nation""",
    "observed_b": """
        SELECT m.job_id, CAST(l_partkey AS VARCHAR) AS gene_id, m.sequenced_id,
               sum(greatest(l_quantity - 45, 0)) AS value
        FROM lineitem JOIN metadata_b m ON m.sequenced_id = CAST(l_suppkey AS VARCHAR) GROUP BY 1, 2, 3""",
    "metadata_e": """
        SELECT CAST(event_id AS VARCHAR) AS sequenced_id, event_type AS job_id, CAST(user_id AS VARCHAR) AS compound,
               props
        FROM events""",
}


def with_views(names: str, sql: str) -> str:
    """Prefix ``sql`` with the named definitions as CTEs."""
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in names.split())
    return f"WITH {ctes}\n{sql}"
