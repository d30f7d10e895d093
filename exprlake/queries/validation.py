"""Check queries: release validation and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import export as ex
from ..operators import validate as vd
from ..plans.release_check import validate_releases as check
from ..session import measured_side, new_scratch_path

# Genes per block of the vector check; small, so that every sample has several blocks.
CHECK_BLOCK = 256
QC_READS = 10_000


def _a(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.sequencing_a(spark, sf_dir), fx.metadata_a(spark, sf_dir)


def _b(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.observed_b(spark, sf_dir), fx.metadata_b(spark, sf_dir)


def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vd.validate_counts(*_a(spark, sf_dir))


def _partly_renamed(metadata: DataFrame) -> DataFrame:
    """Metadata in which samples with few reads go by another id than in the matrix; every row takes part."""
    own = F.col("sequenced_id")
    few = F.when(F.col("total_sequenced_reads") >= QC_READS, own).otherwise(F.concat(F.lit("S"), own))
    return metadata.withColumn("sequenced_id", few)


def only_in_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that the metadata has under another id than the matrix."""
    sequencing, metadata = _a(spark, sf_dir)
    return vd.only_in_matrix(sequencing, _partly_renamed(metadata))


def only_in_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vd.only_in_metadata(*_a(spark, sf_dir))


def shared_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vd.shared_samples(*_a(spark, sf_dir))


def duplicate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = vd.duplicate_cells(fx.sequencing_raw_a(spark, sf_dir))
    rows = vd.duplicate_metadata_rows(fx.metadata_raw_a(spark, sf_dir))
    return cells.join(rows, "job_id", "full").fillna(0)


def issue_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequencing, metadata = _a(spark, sf_dir)
    return vd.issue_previews(vd.reconcile(sequencing, _partly_renamed(metadata)))


def _report_columns(reports: DataFrame) -> DataFrame:
    return reports.select(
        "job_id",
        "job_name",
        "n_genes",
        "n_samples_metadata",
        "n_samples_parquet",
        "n_samples_intersection",
        F.array_join("issues", " | ").alias("issues"),
        "fatal",
        "status",
    )


def release_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full reports of releases with duplicate cells and samples missing on both sides."""
    metadata = _partly_renamed(fx.metadata_a(spark, sf_dir))
    return _report_columns(
        vd.release_report(fx.catalog_a(spark, sf_dir), fx.sequencing_raw_a(spark, sf_dir), metadata)
    )


def validate_repeated_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of matrices whose genes stand in several rows, without and with repeated sample columns."""
    catalog = fx.catalog_a(spark, sf_dir).unionByName(fx.catalog_b(spark, sf_dir))
    rows = fx.sequencing_rows_a(spark, sf_dir).unionByName(fx.sequencing_rows_b(spark, sf_dir))
    samples = [m.select("job_id", "sequenced_id") for m in (fx.metadata_a(spark, sf_dir), fx.metadata_b(spark, sf_dir))]
    return _report_columns(vd.release_report(catalog, rows, samples[0].unionByName(samples[1])))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports over releases that fail in different ways.

    Mapping A is readable.  Regions have samples under other names on each side, event types
    have no matrix, nations have no metadata.
    """
    observed, regions = _b(spark, sf_dir)
    nation_of = measured_side(regions.select("sequenced_id", "compound"), "nation-of")
    per_nation = observed.join(nation_of, "sequenced_id").select(
        F.concat(F.lit("nation-"), F.col("compound")).alias("job_id"), "gene_id", "sequenced_id", "value"
    )
    nations = fx.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey")).alias("job_id"), F.col("n_name").alias("job_name")
    )
    catalog = (
        fx.catalog_a(spark, sf_dir)
        .unionByName(fx.catalog_b(spark, sf_dir))
        .unionByName(fx.catalog_e(spark, sf_dir))
        .unionByName(nations)
    )
    sequencing = fx.sequencing_a(spark, sf_dir).unionByName(observed).unionByName(per_nation)
    renamed = F.concat(F.lit("S"), F.col("sequenced_id")).alias("sequenced_id")
    metadata = (
        fx.metadata_a(spark, sf_dir)
        .select("job_id", "sequenced_id")
        .unionByName(regions.select("job_id", renamed))
        .unionByName(fx.metadata_e(spark, sf_dir).select("job_id", "sequenced_id"))
    )
    return vd.release_report(catalog, sequencing, metadata)


def validate_fatal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("job_id", "n_genes", "n_samples_intersection", "fatal", "status")


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vd.summarize(_mixed(spark, sf_dir))


def validate_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen releases, by name or id, end to end."""
    names = [r["job_name"] for r in fx.catalog_a(spark, sf_dir).select("job_name").collect()]
    return _report_columns(check(spark, fx.release_a(sf_dir), names).reports)


def export_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validate and export all releases, and count what the written tables hold."""
    path = new_scratch_path(spark, "annotated")
    check(spark, fx.release_b(sf_dir), output_path=path)

    def rows(name: str, count: str) -> DataFrame:
        written = spark.read.parquet(f"{path}/{name}").withColumn("job_id", F.col("job_id").cast("string"))
        return written.groupBy("job_id").agg(F.count(F.lit(1)).alias(count))

    return rows("obs", "n_samples").join(rows("var", "n_genes"), "job_id")


def var_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.var_table(fx.observed_b(spark, sf_dir))


def obs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with a row per line item: the first row of each order is kept."""
    obs = ex.obs_table(fx.sequencing_a(spark, sf_dir), fx.metadata_raw_a(spark, sf_dir), ["ingest_ordinal"])
    return obs.select("job_id", "sequenced_id", "cell_line", "is_control", "total_sequenced_reads")


def sample_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequencing, metadata = _b(spark, sf_dir)
    vectors = ex.sample_vectors(
        ex.sample_cells(sequencing, metadata, ex.var_table(sequencing)), block_genes=CHECK_BLOCK
    )
    return vectors.select(
        "job_id",
        "sequenced_id",
        "block",
        F.array_join(F.col("gene_idx").cast("array<string>"), ",").alias("genes"),
        F.array_join(F.col("value").cast("array<bigint>").cast("array<string>"), ",").alias("values"),
    )


QUERIES = {
    "validate_counts": validate_counts,
    "only_in_matrix": only_in_matrix,
    "only_in_metadata": only_in_metadata,
    "shared_samples": shared_samples,
    "duplicate_samples": duplicate_samples,
    "issue_preview": issue_preview,
    "release_status": release_status,
    "validate_repeated_genes": validate_repeated_genes,
    "validate_fatal": validate_fatal,
    "validation_summary": validation_summary,
    "validate_releases": validate_releases,
    "export_tables": export_tables,
    "var_table": var_table,
    "obs_table": obs_table,
    "sample_vectors": sample_vectors,
}


def _sides(matrix: str, metadata: str) -> str:
    return f"""
        ms AS (SELECT DISTINCT job_id, sequenced_id FROM {matrix}),
        ds AS (SELECT DISTINCT job_id, sequenced_id FROM {metadata}),
        lone AS (SELECT *, 'matrix' AS side FROM (SELECT * FROM ms EXCEPT SELECT * FROM ds)
                 UNION ALL SELECT *, 'metadata' FROM (SELECT * FROM ds EXCEPT SELECT * FROM ms)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id, side ORDER BY sequenced_id) AS place,
                          count(*) OVER (PARTITION BY job_id, side) AS n FROM lone),
        previews AS (SELECT job_id, side, max(n) AS n, string_agg(sequenced_id, ', ' ORDER BY sequenced_id) AS preview
                     FROM ranked WHERE place <= 5 GROUP BY 1, 2)"""


def _report(catalog: str, matrix: str, metadata: str, row: str = "gene_id") -> str:
    """Report rows in DuckDB; `_sides` has to come before.  ``row`` names the rows of the matrix."""

    def preview(alias: str, what: str) -> str:
        more = f"CASE WHEN {alias}.n > 5 THEN ', ... (+' || ({alias}.n - 5) || ' more)' ELSE '' END"
        return f"CASE WHEN {alias}.n > 0 THEN {alias}.n || ' {what}: ' || {alias}.preview || {more} END"

    def duplicates(n: str, what: str) -> str:
        return f"CASE WHEN {n} > 0 THEN '{what} (' || CAST({n} AS BIGINT) || ' duplicates)' END"

    return f"""
        g AS (SELECT job_id, count(DISTINCT {row}) AS n_genes, count(DISTINCT sequenced_id) AS n_matrix
              FROM {matrix} GROUP BY 1),
        d AS (SELECT job_id, count(*) AS n_meta, count(DISTINCT sequenced_id) AS n_ids FROM {metadata} GROUP BY 1),
        b AS (SELECT job_id, count(*) AS n_both
              FROM (SELECT * FROM ms INTERSECT SELECT * FROM ds) GROUP BY 1),
        dup AS (SELECT job_id, sum(n - 1) AS n_dup
                FROM (SELECT job_id, {row}, sequenced_id, count(*) AS n FROM {matrix} GROUP BY 1, 2, 3)
                WHERE n > 1 GROUP BY 1),
        facts AS (
            SELECT c.job_id, c.job_name, n_genes, n_meta, n_matrix, coalesce(n_both, 0) AS n_both,
                   CASE WHEN n_genes IS NULL THEN 'parquet returned 0 rows'
                        WHEN n_meta IS NULL THEN 'metadata returned 0 rows' END AS structural,
                   concat_ws(' | ', {duplicates("n_dup", "parquet has duplicate sample columns")},
                             {duplicates("n_meta - n_ids", "metadata has duplicate sequenced_id rows")},
                             {preview("pm", "sample(s) in parquet but missing from metadata")},
                             {preview("pd", "sample(s) in metadata but missing from parquet")}) AS text
            FROM {catalog} c LEFT JOIN g ON g.job_id = c.job_id LEFT JOIN d ON d.job_id = c.job_id
            LEFT JOIN b ON b.job_id = c.job_id LEFT JOIN dup ON dup.job_id = c.job_id
            LEFT JOIN previews pm ON pm.job_id = c.job_id AND pm.side = 'matrix'
            LEFT JOIN previews pd ON pd.job_id = c.job_id AND pd.side = 'metadata'),
        report AS (
            SELECT job_id, job_name,
                   CASE WHEN structural IS NULL THEN n_genes END AS n_genes,
                   CASE WHEN structural IS NULL THEN n_meta END AS n_samples_metadata,
                   CASE WHEN structural IS NULL THEN n_matrix END AS n_samples_parquet,
                   CASE WHEN structural IS NULL THEN n_both END AS n_samples_intersection,
                   CASE WHEN structural IS NULL THEN text ELSE '' END AS issues,
                   CASE WHEN structural IS NOT NULL THEN structural
                        WHEN n_both = 0 THEN 'no overlapping samples between metadata and parquet' END AS fatal,
                   CASE WHEN structural IS NOT NULL OR n_both = 0 THEN 'FAIL' WHEN text <> '' THEN 'WARN'
                        ELSE 'OK' END AS status
            FROM facts)"""


_QC = (
    f"qc AS (SELECT * REPLACE (CASE WHEN total_sequenced_reads >= {QC_READS} THEN sequenced_id "
    "ELSE 'S' || sequenced_id END AS sequenced_id) FROM metadata_a)"
)

_MIXED = f""",
    per_nation AS (SELECT 'nation-' || m.compound AS job_id, gene_id, o.sequenced_id, value
                   FROM observed_b o JOIN metadata_b m ON m.sequenced_id = o.sequenced_id),
    cat AS (SELECT * FROM catalog_a UNION ALL SELECT * FROM catalog_b
            UNION ALL SELECT DISTINCT event_type, upper(event_type) FROM events
            UNION ALL SELECT 'nation-' || CAST(n_nationkey AS VARCHAR), n_name FROM nation),
    mat AS (SELECT job_id, gene_id, sequenced_id FROM sequencing_a
            UNION ALL SELECT job_id, gene_id, sequenced_id FROM observed_b
            UNION ALL SELECT job_id, gene_id, sequenced_id FROM per_nation),
    met AS (SELECT job_id, sequenced_id FROM metadata_a UNION ALL SELECT job_id, 'S' || sequenced_id FROM metadata_b
            UNION ALL SELECT job_id, sequenced_id FROM metadata_e),
    {_sides("mat", "met")}, {_report("cat", "mat", "met")}"""
_MIXED_VIEWS = "catalog_a metadata_a sequencing_a catalog_b metadata_b observed_b metadata_e"
_REPORT_COLUMNS = """job_id, job_name, n_genes, n_samples_metadata, n_samples_parquet, n_samples_intersection, issues,
                     fatal, status"""

ORACLE = {
    "validate_counts": fx.with_views(
        "metadata_a sequencing_a",
        """, g AS (SELECT job_id, count(DISTINCT gene_id) AS n_genes, count(DISTINCT sequenced_id) AS n_samples_parquet
                  FROM sequencing_a GROUP BY 1),
             d AS (SELECT job_id, count(sequenced_id) AS n_samples_metadata FROM metadata_a GROUP BY 1),
             b AS (SELECT job_id, count(*) AS n_samples_intersection
                   FROM (SELECT job_id, sequenced_id FROM sequencing_a
                         INTERSECT SELECT job_id, sequenced_id FROM metadata_a) GROUP BY 1)
           SELECT g.job_id, n_genes, n_samples_metadata, n_samples_parquet, n_samples_intersection
           FROM g JOIN d ON d.job_id = g.job_id JOIN b ON b.job_id = g.job_id""",
    ),
    "only_in_matrix": fx.with_views(
        "metadata_a sequencing_a",
        f""", {_QC} SELECT job_id, sequenced_id FROM sequencing_a EXCEPT SELECT job_id, sequenced_id FROM qc""",
    ),
    "only_in_metadata": fx.with_views(
        "metadata_a sequencing_a",
        "SELECT job_id, sequenced_id FROM metadata_a EXCEPT SELECT job_id, sequenced_id FROM sequencing_a",
    ),
    "shared_samples": fx.with_views(
        "metadata_a sequencing_a",
        "SELECT job_id, sequenced_id FROM metadata_a INTERSECT SELECT job_id, sequenced_id FROM sequencing_a",
    ),
    "duplicate_samples": fx.with_views(
        "metadata_raw_a sequencing_raw_a",
        """SELECT job_id, CAST(coalesce(c, 0) AS BIGINT) AS n_duplicate_cells,
                  CAST(coalesce(r, 0) AS BIGINT) AS n_duplicate_rows
           FROM (SELECT job_id, sum(n - 1) AS c
                 FROM (SELECT job_id, gene_id, sequenced_id, count(*) AS n FROM sequencing_raw_a GROUP BY 1, 2, 3)
                 WHERE n > 1 GROUP BY 1)
           FULL JOIN (SELECT job_id, count(*) - count(DISTINCT sequenced_id) AS r FROM metadata_raw_a GROUP BY 1)
           USING (job_id)""",
    ),
    "issue_preview": fx.with_views(
        "metadata_a sequencing_a", f", {_QC}, {_sides('sequencing_a', 'qc')} SELECT job_id, side, preview FROM previews"
    ),
    "release_status": fx.with_views(
        "catalog_a metadata_a sequencing_raw_a",
        f""", {_QC}, {_sides("sequencing_raw_a", "qc")}, {_report("catalog_a", "sequencing_raw_a", "qc")}
           SELECT {_REPORT_COLUMNS} FROM report""",
    ),
    "validate_repeated_genes": fx.with_views(
        "catalog_a metadata_a sequencing_rows_a catalog_b metadata_b sequencing_rows_b",
        f""", cat AS (SELECT * FROM catalog_a UNION ALL SELECT * FROM catalog_b),
             mat AS (SELECT * FROM sequencing_rows_a UNION ALL SELECT * FROM sequencing_rows_b),
             met AS (SELECT job_id, sequenced_id FROM metadata_a
                     UNION ALL SELECT job_id, sequenced_id FROM metadata_b),
             {_sides("mat", "met")}, {_report("cat", "mat", "met", "gene_row")}
           SELECT {_REPORT_COLUMNS} FROM report""",
    ),
    "validate_fatal": fx.with_views(
        _MIXED_VIEWS, f"{_MIXED} SELECT job_id, n_genes, n_samples_intersection, fatal, status FROM report"
    ),
    "validation_summary": fx.with_views(
        _MIXED_VIEWS,
        f"""{_MIXED}
            SELECT count(*) FILTER (WHERE status = 'OK') AS n_ok, count(*) FILTER (WHERE status = 'WARN') AS n_warn,
                   count(*) FILTER (WHERE status = 'FAIL') AS n_fail, count(*) AS n_total,
                   CAST(CASE WHEN bool_or(status = 'FAIL') THEN 2 WHEN bool_or(status = 'WARN') THEN 1 ELSE 0 END
                        AS BIGINT) AS code
            FROM report""",
    ),
    "validate_releases": fx.with_views(
        "catalog_a metadata_a sequencing_a",
        f""", {_sides("sequencing_a", "metadata_a")}, {_report("catalog_a", "sequencing_a", "metadata_a")}
           SELECT {_REPORT_COLUMNS} FROM report""",
    ),
    "export_tables": fx.with_views(
        "metadata_b observed_b",
        """SELECT job_id, count(DISTINCT sequenced_id) AS n_samples, count(DISTINCT gene_id) AS n_genes
           FROM observed_b GROUP BY 1""",
    ),
    "var_table": fx.with_views(
        "metadata_b observed_b",
        """SELECT job_id, gene_id, row_number() OVER (PARTITION BY job_id ORDER BY gene_id) - 1 AS gene_idx
           FROM (SELECT DISTINCT job_id, gene_id FROM observed_b)""",
    ),
    "obs_table": fx.with_views(
        "metadata_raw_a sequencing_a",
        """SELECT job_id, sequenced_id, cell_line, is_control, total_sequenced_reads
           FROM (SELECT *, row_number() OVER (PARTITION BY job_id, sequenced_id
                        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place
                 FROM metadata_raw_a)
           WHERE place = 1 AND (job_id, sequenced_id) IN (SELECT (job_id, sequenced_id) FROM sequencing_a)""",
    ),
    "sample_vectors": fx.with_views(
        "metadata_b observed_b",
        f""", v AS (SELECT job_id, gene_id, row_number() OVER (PARTITION BY job_id ORDER BY gene_id) - 1 AS gene_idx
                   FROM (SELECT DISTINCT job_id, gene_id FROM observed_b))
           SELECT o.job_id, o.sequenced_id, gene_idx // {CHECK_BLOCK} AS block,
                  string_agg(CAST(gene_idx AS VARCHAR), ',' ORDER BY gene_idx) AS genes,
                  string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY gene_idx) AS values
           FROM observed_b o JOIN v ON v.job_id = o.job_id AND v.gene_id = o.gene_id GROUP BY 1, 2, 3""",
    ),
}
