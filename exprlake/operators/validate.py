"""Release validation as one set-based job over all releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sample_id
from ..functions.facts import one_row_per_release
from ..functions.ranking import first_rows
from ..schemas import REPORT
from . import coverage as cv

PREVIEW_IDS = 5

# Texts of a release report.
MATRIX_EMPTY = "parquet returned 0 rows"
METADATA_EMPTY = "metadata returned 0 rows"
NO_SAMPLE_COLUMN = "metadata missing 'sequenced_id' column"
NO_OVERLAP = "no overlapping samples between metadata and parquet"
MATRIX_DUPLICATES = "parquet has duplicate sample columns"
METADATA_DUPLICATES = "metadata has duplicate sequenced_id rows"
ONLY_IN_MATRIX = "sample(s) in parquet but missing from metadata"
ONLY_IN_METADATA = "sample(s) in metadata but missing from parquet"

# Kinds of problem found before any data is read (rows of a PROBLEMS table).
LOAD_FAILED = "load"
SAMPLE_COLUMN_MISSING = "sample_column"
GENE_COLUMN_MISSING = "gene_column"


def matrix_samples(sequencing: DataFrame) -> DataFrame:
    return sequencing.select("job_id", sample_id()).filter(F.col("sequenced_id").isNotNull()).distinct()


def metadata_samples(metadata: DataFrame) -> DataFrame:
    return metadata.select("job_id", sample_id()).filter(F.col("sequenced_id").isNotNull()).distinct()


def reconcile(sequencing: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every sample id of a release with the side it is on: matrix, metadata or both."""
    left = matrix_samples(sequencing).withColumn("__m", F.lit(True))
    right = metadata_samples(metadata).withColumn("__d", F.lit(True))
    side = F.when(F.col("__m") & F.col("__d"), "both").when(F.col("__m"), "matrix").otherwise("metadata")
    return left.join(right, ["job_id", "sequenced_id"], "full").select("job_id", "sequenced_id", side.alias("side"))


def only_in_matrix(sequencing: DataFrame, metadata: DataFrame) -> DataFrame:
    return matrix_samples(sequencing).join(metadata_samples(metadata), ["job_id", "sequenced_id"], "left_anti")


def only_in_metadata(sequencing: DataFrame, metadata: DataFrame) -> DataFrame:
    return metadata_samples(metadata).join(matrix_samples(sequencing), ["job_id", "sequenced_id"], "left_anti")


def shared_samples(sequencing: DataFrame, metadata: DataFrame) -> DataFrame:
    return matrix_samples(sequencing).join(metadata_samples(metadata), ["job_id", "sequenced_id"], "left_semi")


def side_counts(sides: DataFrame) -> DataFrame:
    """Sample counts per release from `reconcile`; one pass, combined in the map tasks."""

    def on(*names: str) -> Column:
        return F.count_if(F.col("side").isin(*names))

    return sides.groupBy("job_id").agg(
        on("both", "matrix").alias("n_samples_parquet"),
        on("both").alias("n_samples_intersection"),
        on("matrix").alias("n_only_matrix"),
        on("metadata").alias("n_only_metadata"),
        on("both", "metadata").alias("n_metadata_ids"),
    )


def metadata_counts(metadata: DataFrame) -> DataFrame:
    """All rows, and rows that carry a sample id (duplicates included)."""
    return metadata.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_metadata_rows"), F.count("sequenced_id").alias("n_samples_metadata")
    )


def validate_counts(sequencing: DataFrame, metadata: DataFrame) -> DataFrame:
    """Gene rows, samples on each side and shared samples of each release."""
    rows, samples = cv.totals(sequencing)
    sides = side_counts(reconcile(samples, metadata))
    return one_row_per_release([sides, rows, metadata_counts(metadata)]).select(
        "job_id", "n_genes", "n_samples_metadata", "n_samples_parquet", "n_samples_intersection"
    )


def duplicate_cells(sequencing: DataFrame) -> DataFrame:
    """Per release, matrix cells beyond the first of their (gene, sample).

    For tables bucketed by (release, gene), where this shuffles nothing; `coverage.duplicate_cells` needs no layout.
    """
    return (
        sequencing.groupBy("job_id", "gene_id", "sequenced_id")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > 1)
        .groupBy("job_id")
        .agg(F.sum(F.col("__n") - 1).alias("n_duplicate_cells"))
    )


def duplicate_metadata_rows(metadata: DataFrame) -> DataFrame:
    """Per release, metadata rows beyond the first of their sample."""
    return (
        metadata.filter(F.col("sequenced_id").isNotNull())
        .groupBy("job_id", "sequenced_id")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > 1)
        .groupBy("job_id")
        .agg(F.sum(F.col("__n") - 1).alias("n_duplicate_rows"))
    )


def issue_previews(sides: DataFrame, k: int = PREVIEW_IDS) -> DataFrame:
    """The ``k`` first ids in text order of each release and one-sided kind, as one text.

    Ids are cut to ``k`` per group before they are collected.
    """
    lone = first_rows(sides.filter(F.col("side") != "both"), ["job_id", "side"], ["sequenced_id"], k)
    return lone.groupBy("job_id", "side").agg(
        F.array_join(F.sort_array(F.collect_list("sequenced_id")), ", ").alias("preview")
    )


def preview_text(n: Column, what: str, preview: Column, k: int = PREVIEW_IDS) -> Column:
    """`7 sample(s) ...: a, b, c, d, e, ... (+2 more)`; NULL if there are none."""
    more = F.when(n > k, F.concat(F.lit(", ... (+"), (n - k).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}: "), preview, more))


def duplicate_text(n: Column, what: str) -> Column:
    return F.when(n > 0, F.concat(F.lit(f"{what} ("), n.cast("string"), F.lit(" duplicates)")))


def status_of(fatal: Column, issues: Column) -> Column:
    return F.when(fatal.isNotNull(), "FAIL").when(F.size(issues) > 0, "WARN").otherwise("OK")


def release_report(
    catalog: DataFrame, sequencing: DataFrame, metadata: DataFrame, problems: DataFrame | None = None
) -> DataFrame:
    """One REPORT row for each release of ``catalog``.

    ``problems`` names releases whose load or columns failed before any row was read.  The matrix is computed
    once: its coverage, at most a number for each cell, answers for its rows, samples and duplicates.  With a
    `gene_row` in ``sequencing`` a gene in two rows counts twice and is no duplicate; without one, two cells
    of one gene and sample are.
    """
    rows, samples = cv.totals(sequencing)
    if "sequenced_id" not in metadata.columns:  # no release has it; `problems` says so
        metadata = metadata.withColumn("sequenced_id", F.lit(None).cast("string"))
    sides = reconcile(samples, metadata)
    previews = (
        issue_previews(sides)
        .groupBy("job_id")
        .agg(
            F.max(F.when(F.col("side") == "matrix", F.col("preview"))).alias("matrix_preview"),
            F.max(F.when(F.col("side") == "metadata", F.col("preview"))).alias("metadata_preview"),
        )
    )
    parts = [
        rows,
        metadata_counts(metadata),
        side_counts(sides),
        cv.duplicate_cells(samples),
        previews,
    ]
    kinds = [LOAD_FAILED, SAMPLE_COLUMN_MISSING, GENE_COLUMN_MISSING]
    if problems is not None:
        parts.append(
            problems.select("job_id", *[F.when(F.col("source") == k, F.col("message")).alias(k) for k in kinds])
        )
    facts = catalog.select("job_id", "job_name").join(one_row_per_release(parts), "job_id", "left")
    if problems is None:
        facts = facts.withColumns({k: F.lit(None).cast("string") for k in kinds})

    n_shared = F.coalesce(F.col("n_samples_intersection"), F.lit(0))
    structural = (
        F.when(F.col(LOAD_FAILED).isNotNull(), F.concat(F.lit("load_experiment failed: "), F.col(LOAD_FAILED)))
        .when(F.col(GENE_COLUMN_MISSING).isNull() & F.col("n_genes").isNull(), F.lit(MATRIX_EMPTY))
        .when(F.coalesce("n_metadata_rows", F.lit(0)) == 0, F.lit(METADATA_EMPTY))
        .when(F.col(SAMPLE_COLUMN_MISSING).isNotNull(), F.lit(NO_SAMPLE_COLUMN))
        .when(F.col(GENE_COLUMN_MISSING).isNotNull(), F.col(GENE_COLUMN_MISSING))
    )
    facts = facts.withColumn("__structural", structural)
    readable = F.col("__structural").isNull()
    issues = F.array_compact(
        F.array(
            duplicate_text(F.col("n_duplicate_cells"), MATRIX_DUPLICATES),
            duplicate_text(F.col("n_samples_metadata") - F.col("n_metadata_ids"), METADATA_DUPLICATES),
            preview_text(F.col("n_only_matrix"), ONLY_IN_MATRIX, F.col("matrix_preview")),
            preview_text(F.col("n_only_metadata"), ONLY_IN_METADATA, F.col("metadata_preview")),
        )
    )
    # A release that failed structurally carries neither counts nor issues.
    facts = facts.withColumn("issues", F.when(readable, issues).otherwise(F.array().cast("array<string>")))
    fatal = F.coalesce(F.col("__structural"), F.when(n_shared == 0, F.lit(NO_OVERLAP)))
    counts = ["n_genes", "n_samples_metadata", "n_samples_parquet", "n_samples_intersection"]
    report = facts.select(
        "job_id",
        "job_name",
        *[F.when(readable, F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counts],
        F.lit(None).cast("string").alias("output_path"),
        "issues",
        fatal.alias("fatal"),
    )
    return report.withColumn("status", status_of(F.col("fatal"), F.col("issues"))).select(*REPORT.fieldNames())


def summarize(reports: DataFrame) -> DataFrame:
    """Counts per status and the overall code: 2 any FAIL (or nothing to check), 1 any WARN, else 0."""

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    totals = reports.agg(
        n("OK").alias("n_ok"), n("WARN").alias("n_warn"), n("FAIL").alias("n_fail"), F.count(F.lit(1)).alias("n_total")
    )
    code = (
        F.when((F.col("n_fail") > 0) | (F.col("n_total") == 0), 2).when(F.col("n_warn") > 0, 1).otherwise(0)
    )
    return totals.withColumn("code", code.cast("bigint"))
