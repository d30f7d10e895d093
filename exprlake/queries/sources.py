"""Check queries: catalog, file sources and unions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.union import concat_chemistry, concat_metadata
from ..plans.experiments import load_experiment
from ..session import materialize, new_scratch_path
from ..sources.catalog import catalog_stats, resolve_jobs, select_wanted
from ..sources.files import ReleaseFiles
from ..sources.store import (
    Store,
    append,
    open_store,
    write_catalog,
    write_chemistry,
    write_matrix,
    write_metadata,
)
from ..sources.wide import write_wide_parts


@dataclass(frozen=True)
class _Store:
    """Releases written as files, and the catalog that lists them."""

    root: str
    files: ReleaseFiles


_STORES: dict[tuple[str, str, str], _Store] = {}


# Loads in which samples reach the ingested store, so that its statistics have something to be merged with.
LOADS = 2
# Samples whose ids start like this, neighbours in rank as those of one plate would be: under one in a hundred.
PLATE = "121"

_INGESTED: dict[tuple[str, str], str] = {}


def _ingested(spark: SparkSession, sf_dir: str) -> Store:
    """Mapping A in an ingested store; each load brings samples to all releases.  Written once, like `_store`."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INGESTED:
        root = new_scratch_path(spark, "ingested")
        whole = fx.release_a(sf_dir)
        for load in range(LOADS):
            here = F.pmod(F.xxhash64("sequenced_id"), F.lit(LOADS)) == load
            arrived = replace(
                whole,
                metadata_table=lambda s, here=here: whole.metadata_table(s).filter(here),
                chemistry_table=lambda s, load=load: whole.chemistry_table(s).filter(F.lit(load == 0)),
                sequencing_table=lambda s, here=here: whole.sequencing_table(s).filter(here),
            )
            append(spark, arrived, root)
        _INGESTED[key] = root
    return open_store(_INGESTED[key])


def _store(spark: SparkSession, sf_dir: str, mapping: str) -> _Store:
    """The tables of one mapping as files; written once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, mapping)
    if key not in _STORES:
        build = {"a": _write_a, "b": _write_b}[mapping]
        _STORES[key] = build(spark, sf_dir)
    return _STORES[key]


def _paths(root: str, matrix: str) -> dict:
    return {
        "data_path": F.concat(F.lit(f"{root}/{matrix}"), F.col("job_id")),
        "metadata_path": F.concat(F.lit(f"{root}/metadata/release="), F.col("job_id")),
        "chemistry_path": F.concat(F.lit(f"{root}/chemistry/release="), F.col("job_id")),
    }


def _write_a(spark: SparkSession, sf_dir: str) -> _Store:
    root = new_scratch_path(spark, "store-a")
    metadata = fx.metadata_a(spark, sf_dir)
    write_matrix(fx.sequencing_a(spark, sf_dir), f"{root}/matrix")
    write_metadata(metadata, f"{root}/metadata")
    write_chemistry(fx.chemistry_a(spark, sf_dir), f"{root}/chemistry")
    sequencing = spark.read.schema(fx.sequencing_a(spark, sf_dir).schema).parquet(f"{root}/matrix")
    described = fx.described_catalog(fx.catalog_a(spark, sf_dir), sequencing, metadata)
    write_catalog(described.withColumns(_paths(root, "matrix/job_id=")), f"{root}/catalog")
    return _Store(root, ReleaseFiles(f"{root}/catalog"))


def _write_b(spark: SparkSession, sf_dir: str) -> _Store:
    """The same with a folder of wide files per release, the shape releases are handed out in."""
    root = new_scratch_path(spark, "store-b")
    metadata = fx.metadata_b(spark, sf_dir)
    # The long matrix serves to write the wide one and to describe it, so it is computed once and lies in no order.
    sequencing = materialize(fx.observed_b(spark, sf_dir), "observed")
    write_metadata(metadata, f"{root}/metadata")
    write_chemistry(fx.chemistry_b(spark, sf_dir), f"{root}/chemistry")
    catalog = fx.catalog_b(spark, sf_dir)
    write_wide_parts(sequencing, f"{root}/wide")
    described = fx.described_catalog(catalog, sequencing, metadata)
    write_catalog(described.withColumns(_paths(root, "wide/")), f"{root}/catalog")
    return _Store(root, ReleaseFiles(f"{root}/catalog"))


def list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "a").files.catalog(spark).select(
        "job_id",
        "job_name",
        "is_public",
        "parquet_file_size_bytes",
        "datapoint_count",
        "metadata_row_count",
        F.array_join("cell_lines", ",").alias("cell_lines"),
        F.array_join("timepoints", ",").alias("timepoints"),
    )


def load_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every release's wide matrix, read back and made long."""
    return _store(spark, sf_dir, "b").files.sequencing(spark, keep_nulls=False)


def load_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "a").files.metadata(spark)


def load_chem(spark: SparkSession, sf_dir: str) -> DataFrame:
    chemistry = _store(spark, sf_dir, "a").files.chemistry(spark)
    return chemistry.select("job_id", "compound", "user_compound_id", "smiles", "log_p")


def load_experiment_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every release in one scan each; cells joined to their sample and its compound."""
    files = _store(spark, sf_dir, "b").files
    cells = files.sequencing(spark, keep_nulls=False)
    samples = files.metadata(spark).select("job_id", "sequenced_id", "compound")
    compounds = files.chemistry(spark).select("job_id", "compound", "user_compound_id")
    return (
        cells.groupBy("job_id", "sequenced_id")
        .agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))
        .join(samples, ["job_id", "sequenced_id"])
        .join(compounds, ["job_id", "compound"])
        .groupBy("job_id", "user_compound_id")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.sum("cells").alias("n_cells"),
            F.sum("total").alias("total_value"),
        )
    )


def missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One release without metadata, one without chemistry: the rest is still read."""
    store = _store(spark, sf_dir, "a")
    broken = store.files.catalog(spark).withColumns(
        {
            "metadata_path": F.when(F.col("job_name") == "HIGH", F.concat("metadata_path", F.lit("-gone"))).otherwise(
                F.col("metadata_path")
            ),
            "chemistry_path": F.when(F.col("job_name") != "MEDIUM", F.col("chemistry_path")),
        }
    )
    path = new_scratch_path(spark, "catalog-broken")
    write_catalog(broken, path)
    files = ReleaseFiles(path)
    metadata = files.metadata(spark).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_metadata"))
    chemistry = files.chemistry(spark).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_chemistry"))
    errors = files.source_errors(spark).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_errors"))
    counted = files.catalog(spark).select("job_id")
    for part in (metadata, chemistry, errors):
        counted = counted.join(part, "job_id", "left")
    return counted.fillna(0)


def collective_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all releases through one scan of the store."""
    long = _store(spark, sf_dir, "a").files.sequencing(spark)
    return long.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total_value"))


def resolve_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, unique names, names several releases share, and names of no release."""
    regions = fx.catalog_b(spark, sf_dir)
    nations = fx.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey")).alias("job_id"),
        F.col("n_regionkey").cast("string").alias("region"),
    )
    shared = nations.join(regions.select(F.col("job_id").alias("region"), "job_name"), "region").select(
        "job_id", "job_name"
    )
    catalog = fx.catalog_a(spark, sf_dir).unionByName(shared)
    segments = fx.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("job")).distinct()
    wanted = catalog.select(F.explode(F.array("job_id", "job_name")).alias("job")).unionByName(segments)
    return resolve_jobs(catalog, wanted)


def select_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases with an order on the first day (wanted by id) or the last day (by name)."""
    orders = fx.table(spark, sf_dir, "orders")
    ends = orders.agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    job = F.concat(F.lit("job-"), F.substring("o_orderpriority", 1, 1))
    on_first = orders.join(ends, F.col("o_orderdate") == F.col("first")).select(job.alias("job"))
    on_last = orders.join(ends, F.col("o_orderdate") == F.col("last")).select(
        F.expr("substr(o_orderpriority, 3)").alias("job")
    )
    return select_wanted(fx.catalog_a(spark, sf_dir), on_first.unionByName(on_last))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_stats(fx.sequencing_a(spark, sf_dir), fx.metadata_a(spark, sf_dir)).select(
        "job_id",
        "datapoint_count",
        "metadata_row_count",
        F.array_join("cell_lines", ",").alias("cell_lines"),
        F.array_join("timepoints", ",").alias("timepoints"),
    )


def stored_catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the statistics that each load left in the store; the matrix is not read."""
    return _ingested(spark, sf_dir).stats(spark).select(
        "job_id",
        "datapoint_count",
        "metadata_row_count",
        F.array_join("cell_lines", ",").alias("cell_lines"),
        F.array_join("timepoints", ",").alias("timepoints"),
    )


def stored_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).sizes(spark)


def zorder_keep_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of neighbouring samples, from the row groups that can hold them."""
    ids = fx.metadata_a(spark, sf_dir).select("sequenced_id").filter(F.col("sequenced_id").startswith(PLATE))
    return _ingested(spark, sf_dir).sequencing_of(spark, ids)


def wide_gene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, cells and totals of every wide release, all read in one stage."""
    cells = _store(spark, sf_dir, "b").files.sequencing(spark, keep_nulls=False, with_rows=True)
    rows = cells.groupBy("job_id", "gene_id", "gene_row").agg(
        F.count("value").alias("n_cells"), F.sum("value").alias("total_value")
    )
    return rows.groupBy("job_id", "gene_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_cells").alias("n_cells"), F.sum("total_value").alias("total_value")
    )


def union_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sample tables with different columns."""
    return concat_metadata(spark, [fx.metadata_a(spark, sf_dir), fx.metadata_b(spark, sf_dir)])


def union_chemistry(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = concat_chemistry(spark, [fx.chemistry_a(spark, sf_dir), fx.chemistry_b(spark, sf_dir)])
    return both.select("compound", "user_compound_id", "smiles", "log_p")


QUERIES = {
    "list_datasets": list_datasets,
    "load_dataset": load_dataset,
    "load_metadata": load_metadata,
    "load_chem": load_chem,
    "load_experiment": load_experiment_all,
    "missing_source": missing_source,
    "collective_count": collective_count,
    "resolve_job": resolve_job,
    "select_releases": select_releases,
    "catalog_stats": stats,
    "stored_catalog_stats": stored_catalog_stats,
    "stored_size_estimate": stored_size_estimate,
    "zorder_keep_samples": zorder_keep_samples,
    "wide_gene_rows": wide_gene_rows,
    "concat_metadata": union_metadata,
    "concat_chemistry": union_chemistry,
}

_STATS = """
        cells AS (SELECT job_id, count(*) AS datapoint_count, count(DISTINCT gene_id) AS g,
                         count(DISTINCT sequenced_id) AS s FROM sequencing_a GROUP BY 1),
        meta AS (SELECT job_id, count(*) AS metadata_row_count,
                        string_agg(DISTINCT cell_line, ',' ORDER BY cell_line) AS cell_lines,
                        string_agg(DISTINCT timepoint, ',' ORDER BY timepoint) AS timepoints
                 FROM metadata_a GROUP BY 1)"""

_CATALOG_STATS = fx.with_views(
    "metadata_a sequencing_a",
    f""", {_STATS}
    SELECT meta.job_id, datapoint_count, metadata_row_count, cell_lines, timepoints
    FROM meta JOIN cells ON cells.job_id = meta.job_id""",
)

ORACLE = {
    "list_datasets": fx.with_views(
        "catalog_a metadata_a sequencing_a",
        f""", {_STATS}
        SELECT c.job_id, c.job_name, true AS is_public, CAST(g * s * 8 AS BIGINT) AS parquet_file_size_bytes,
               datapoint_count, metadata_row_count, cell_lines, timepoints
        FROM catalog_a c JOIN cells ON cells.job_id = c.job_id JOIN meta ON meta.job_id = c.job_id""",
    ),
    "load_dataset": fx.with_views(
        "metadata_b observed_b", "SELECT job_id, gene_id, sequenced_id, value FROM observed_b"
    ),
    "load_metadata": fx.with_views("metadata_a", "SELECT * FROM metadata_a"),
    "load_chem": fx.with_views("chemistry_a", "SELECT * FROM chemistry_a"),
    "load_experiment": fx.with_views(
        "metadata_b chemistry_b observed_b",
        """SELECT o.job_id, c.user_compound_id, count(DISTINCT o.sequenced_id) AS n_samples, count(*) AS n_cells,
                  sum(o.value) AS total_value
           FROM observed_b o JOIN metadata_b m ON m.job_id = o.job_id AND m.sequenced_id = o.sequenced_id
           JOIN chemistry_b c ON c.job_id = o.job_id AND c.compound = m.compound GROUP BY 1, 2""",
    ),
    "missing_source": fx.with_views(
        "catalog_a metadata_a chemistry_a",
        """SELECT c.job_id,
                  (SELECT count(*) FROM metadata_a m WHERE m.job_id = c.job_id AND c.job_name <> 'HIGH') AS n_metadata,
                  (SELECT count(*) FROM chemistry_a k WHERE k.job_id = c.job_id AND c.job_name <> 'MEDIUM')
                      AS n_chemistry,
                  CAST(CASE WHEN c.job_name IN ('HIGH', 'MEDIUM') THEN 1 ELSE 0 END AS BIGINT) AS n_errors
           FROM catalog_a c""",
    ),
    "collective_count": fx.with_views(
        "sequencing_a", "SELECT job_id, count(*) AS n_cells, sum(value) AS total_value FROM sequencing_a GROUP BY 1"
    ),
    "resolve_job": fx.with_views(
        "catalog_a",
        """, cat AS (SELECT * FROM catalog_a UNION ALL
                     SELECT 'nation-' || CAST(n_nationkey AS VARCHAR), r_name
                     FROM nation JOIN region ON r_regionkey = n_regionkey),
             wanted AS (SELECT job_id AS job FROM cat UNION SELECT job_name FROM cat
                        UNION SELECT c_mktsegment FROM customer),
             named AS (SELECT job_name, count(*) AS n, min(job_id) AS named_id FROM cat GROUP BY 1)
           SELECT w.job,
                  CASE WHEN c.job_id IS NOT NULL THEN c.job_id WHEN n.n = 1 THEN n.named_id END AS job_id,
                  CASE WHEN c.job_id IS NOT NULL THEN 'id' WHEN n.n = 1 THEN 'name' WHEN n.n > 1 THEN 'ambiguous'
                       ELSE 'none' END AS found_by
           FROM wanted w LEFT JOIN cat c ON c.job_id = w.job LEFT JOIN named n ON n.job_name = w.job""",
    ),
    "select_releases": fx.with_views(
        "catalog_a",
        """SELECT job_id, job_name FROM catalog_a
           WHERE job_id IN (SELECT 'job-' || substr(o_orderpriority, 1, 1) FROM orders
                            WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders))
              OR job_name IN (SELECT substr(o_orderpriority, 3) FROM orders
                              WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders))""",
    ),
    "catalog_stats": _CATALOG_STATS,
    "stored_catalog_stats": _CATALOG_STATS,
    "stored_size_estimate": fx.with_views(
        "sequencing_a",
        """SELECT job_id, count(DISTINCT gene_id) AS n_genes, count(DISTINCT sequenced_id) AS n_samples,
                  CAST(count(DISTINCT gene_id) * count(DISTINCT sequenced_id) * 8 AS BIGINT) AS estimated_bytes
           FROM sequencing_a GROUP BY 1""",
    ),
    "zorder_keep_samples": fx.with_views(
        "sequencing_a", f"SELECT * FROM sequencing_a WHERE sequenced_id LIKE '{PLATE}%'"
    ),
    "wide_gene_rows": fx.with_views(
        "metadata_b observed_b",
        """SELECT job_id, gene_id, CAST(1 AS BIGINT) AS n_rows, count(value) AS n_cells, sum(value) AS total_value
           FROM observed_b GROUP BY 1, 2""",
    ),
    "concat_metadata": fx.with_views(
        "metadata_a metadata_b",
        """SELECT * FROM metadata_a UNION ALL
           SELECT sequenced_id, job_id, compound, user_compound_id, NULL, NULL, is_control, percent_mitochondrial,
                  NULL, NULL FROM metadata_b""",
    ),
    "concat_chemistry": fx.with_views(
        "chemistry_a chemistry_b",
        """SELECT compound, user_compound_id, smiles, log_p FROM chemistry_a UNION ALL
           SELECT compound, user_compound_id, NULL, NULL FROM chemistry_b""",
    ),
}
