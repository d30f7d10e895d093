"""Check queries: operators on the expression matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import matrix as mx
from ..plans.experiments import filter_metadata_by_sql as samples_by_sql
from ..plans.experiments import load_experiments

CONTROLS = "SELECT * FROM metadata WHERE is_control"


def filter_metadata_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of compounds that were tested in every release."""
    sql = """
        SELECT sequenced_id FROM metadata WHERE compound IN (
            SELECT compound FROM metadata GROUP BY compound
            HAVING count(DISTINCT job_id) = (SELECT count(DISTINCT job_id) FROM metadata))"""
    kept, _ = samples_by_sql(spark, fx.release_a(sf_dir), fx.metadata_a(spark, sf_dir), sql)
    return kept.select("sequenced_id", "job_id", "compound", "cell_line", "is_control")


def keep_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls = fx.metadata_b(spark, sf_dir).filter("is_control").select("sequenced_id")
    return mx.keep_samples(fx.observed_b(spark, sf_dir), controls)


def drop_unexpressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.drop_unexpressed(fx.sequencing_a(spark, sf_dir))


def drop_unexpressed_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.drop_unexpressed(fx.sequencing_a(spark, sf_dir), scope="combined")


def expressed_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.expressed_genes(fx.observed_b(spark, sf_dir))


def combine_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.combine(
        mx.drop_unexpressed(fx.sequencing_a(spark, sf_dir)), mx.drop_unexpressed(fx.observed_b(spark, sf_dir))
    )


def combine_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All releases, all samples side by side, in blocks of samples."""
    return mx.to_blocks(mx.drop_unexpressed(fx.observed_b(spark, sf_dir))).cells


def sample_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sample has which place in the blocks of ``combine_wide``."""
    return mx.to_blocks(mx.drop_unexpressed(fx.observed_b(spark, sf_dir))).samples


def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back: the cells of the wide blocks are the cells they were made from."""
    return mx.from_blocks(mx.to_blocks(fx.observed_b(spark, sf_dir)))


def full_join_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-gene totals of the five releases side by side, in one aggregation."""
    totals = [
        F.sum(F.when(F.col("job_id") == str(job), F.col("value"))).alias(f"total_{job}") for job in range(fx.RELEASES_B)
    ]
    return fx.observed_b(spark, sf_dir).groupBy("gene_id").agg(*totals)


def join_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by full outer joins of a frame for each release."""
    cells = fx.observed_b(spark, sf_dir)
    frames = [
        cells.filter(F.col("job_id") == str(job)).groupBy("gene_id").agg(F.sum("value").alias(f"total_{job}"))
        for job in range(fx.RELEASES_B)
    ]
    return mx.join_releases(frames)


def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.estimate_size(fx.sequencing_a(spark, sf_dir))


def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.size_guard(mx.estimate_size(fx.sequencing_a(spark, sf_dir)))


def load_experiments_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control samples of all releases, combined; expressed genes only."""
    source = fx.release_a(sf_dir)
    names = [r["job_name"] for r in source.catalog(spark).select("job_name").collect()]
    return load_experiments(spark, source, names, sql=CONTROLS).data


QUERIES = {
    "filter_metadata_by_sql": filter_metadata_by_sql,
    "keep_samples": keep_samples,
    "drop_unexpressed": drop_unexpressed,
    "drop_unexpressed_combined": drop_unexpressed_combined,
    "expressed_genes": expressed_genes,
    "combine_long": combine_long,
    "combine_wide": combine_wide,
    "sample_blocks": sample_blocks,
    "wide_to_long": wide_to_long,
    "full_join_gene": full_join_gene,
    "join_releases": join_releases,
    "size_estimate": size_estimate,
    "size_guard": size_guard,
    "load_experiments_sql": load_experiments_sql,
}

_SIZES = """SELECT job_id, count(DISTINCT gene_id) AS n_genes, count(DISTINCT sequenced_id) AS n_samples,
                   CAST(count(DISTINCT gene_id) * count(DISTINCT sequenced_id) * 8 AS BIGINT) AS estimated_bytes
            FROM sequencing_a GROUP BY 1"""


def _expressed(cells: str) -> str:
    return f"""SELECT c.* FROM {cells} c
               WHERE EXISTS (SELECT 1 FROM {cells} e
                             WHERE e.job_id = c.job_id AND e.gene_id = c.gene_id AND e.value <> 0)"""


# Place of each sample in the blocks, and a column for each slot of a block.
_PLACES = f"""places AS (
    SELECT job_id, sequenced_id, (n - 1) // {mx.BLOCK_SAMPLES} AS block,
           CAST((n - 1) % {mx.BLOCK_SAMPLES} AS INTEGER) AS position
    FROM (SELECT job_id, sequenced_id, row_number() OVER (ORDER BY job_id, sequenced_id) AS n
          FROM (SELECT DISTINCT job_id, sequenced_id FROM kept)))"""
_SLOTS = ", ".join(f"max(CASE WHEN position = {i} THEN value END) AS c{i}" for i in range(mx.BLOCK_SAMPLES))

_FULL_JOIN = fx.with_views(
    "metadata_b observed_b",
    ", "
    + ", ".join(
        f"t{j} AS (SELECT gene_id, sum(value) AS total_{j} FROM observed_b WHERE job_id = '{j}' GROUP BY 1)"
        for j in range(fx.RELEASES_B)
    )
    + """ SELECT gene_id, total_0, total_1, total_2, total_3, total_4
          FROM t0 FULL JOIN t1 USING (gene_id) FULL JOIN t2 USING (gene_id) FULL JOIN t3 USING (gene_id)
          FULL JOIN t4 USING (gene_id)""",
)

ORACLE = {
    "filter_metadata_by_sql": fx.with_views(
        "metadata_a",
        """SELECT sequenced_id, job_id, compound, cell_line, is_control FROM metadata_a WHERE compound IN (
               SELECT compound FROM metadata_a GROUP BY compound
               HAVING count(DISTINCT job_id) = (SELECT count(DISTINCT job_id) FROM metadata_a))""",
    ),
    "keep_samples": fx.with_views(
        "metadata_b observed_b",
        "SELECT * FROM observed_b WHERE sequenced_id IN (SELECT sequenced_id FROM metadata_b WHERE is_control)",
    ),
    "drop_unexpressed": fx.with_views("sequencing_a", _expressed("sequencing_a")),
    "drop_unexpressed_combined": fx.with_views(
        "sequencing_a",
        "SELECT * FROM sequencing_a WHERE gene_id IN (SELECT gene_id FROM sequencing_a WHERE value <> 0)",
    ),
    "expressed_genes": fx.with_views(
        "metadata_b observed_b",
        "SELECT job_id, gene_id FROM observed_b GROUP BY 1, 2 HAVING bool_or(value <> 0)",
    ),
    "combine_long": fx.with_views(
        "sequencing_a metadata_b observed_b",
        f"{_expressed('sequencing_a')} UNION ALL {_expressed('observed_b')}",
    ),
    "combine_wide": fx.with_views(
        "metadata_b observed_b",
        f""", kept AS ({_expressed("observed_b")}), {_PLACES}
           SELECT gene_id, block, {_SLOTS}
           FROM kept JOIN places USING (job_id, sequenced_id) GROUP BY gene_id, block""",
    ),
    "sample_blocks": fx.with_views(
        "metadata_b observed_b",
        f""", kept AS ({_expressed("observed_b")}), {_PLACES}
           SELECT block, position, job_id, sequenced_id FROM places""",
    ),
    "wide_to_long": fx.with_views(
        "metadata_b observed_b", "SELECT job_id, gene_id, sequenced_id, value FROM observed_b"
    ),
    "full_join_gene": _FULL_JOIN,
    "join_releases": _FULL_JOIN,
    "size_estimate": fx.with_views("sequencing_a", _SIZES),
    "size_guard": fx.with_views(
        "sequencing_a",
        f"""SELECT count(*) AS n_releases, CAST(sum(estimated_bytes) AS BIGINT) AS estimated_bytes,
                  CASE WHEN sum(estimated_bytes) > 8589934592 THEN 'fallback'
                       WHEN sum(estimated_bytes) > 2147483648 THEN 'warn' ELSE 'ok' END AS verdict
           FROM ({_SIZES})""",
    ),
    "load_experiments_sql": fx.with_views(
        "metadata_a sequencing_a",
        f""", kept AS (SELECT * FROM sequencing_a
                       WHERE sequenced_id IN (SELECT sequenced_id FROM metadata_a WHERE is_control))
           {_expressed("kept")}""",
    ),
}
