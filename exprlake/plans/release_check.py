"""Validation of all or chosen releases, with an optional export."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import folder_value
from ..operators.export import annotated_matrix, write_annotated
from ..operators.validate import release_report, status_of, summarize
from ..schemas import REPORT
from ..session import materialize
from ..sources.catalog import select_releases

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class ReleaseCheck:
    """``reports``: one row per release; ``summary``: one row with counts and `code`."""

    reports: DataFrame
    summary: DataFrame
    unknown: list[str]


def validate_releases(
    spark: SparkSession, source, jobs: list[str] | None = None, output_path: str | None = None
) -> ReleaseCheck:
    """Check the releases of ``source`` in one job; no loop over releases.

    An unknown name, or a catalog without releases, gives no reports and code 2.  With
    ``output_path`` the sound releases are also written as samples x genes tables; if those
    cannot be built the releases fail, and a failed write becomes an issue of each.
    """
    catalog = source.catalog(spark)
    job_ids = None
    if jobs is not None:
        catalog, unknown = select_releases(catalog, jobs)
        if unknown:
            logger.error("unknown release(s): %s", ", ".join(unknown))
            none = spark.createDataFrame([], REPORT)
            return ReleaseCheck(none, summarize(none), unknown)
        # One id per release the user named.
        job_ids = [r["job_id"] for r in catalog.select("job_id").distinct().collect()]

    sequencing = source.sequencing(spark, job_ids)
    metadata = source.metadata(spark, job_ids)
    rows = source.sequencing(spark, job_ids, with_rows=True)
    reports = release_report(catalog, rows, metadata, source.problems(spark, job_ids))
    if output_path is not None:
        reports = materialize(reports, "release-report")
        reports = _export(spark, source, reports, sequencing, job_ids, output_path)
    return ReleaseCheck(reports, summarize(reports), [])


def _export(
    spark: SparkSession, source, reports: DataFrame, sequencing: DataFrame, job_ids: list[str] | None, path: str
) -> DataFrame:
    sound = F.col("fatal").isNull()
    good = reports.filter(sound).select("job_id")
    try:
        metadata, order = _ordered_metadata(spark, source, job_ids)
        # The tables and the bounds of their ranges read the matrix several times.
        cells = materialize(sequencing.join(good, "job_id", "left_semi"), "export-matrix")
        matrix = annotated_matrix(cells, metadata.join(good, "job_id", "left_semi"), order)
    except Exception as exc:
        logger.error("the export could not be built: %s", exc)
        broken = F.when(sound, F.lit(f"export could not be built: {type(exc).__name__}")).otherwise(F.col("fatal"))
        return reports.withColumn("fatal", broken).withColumn("status", status_of(F.col("fatal"), F.col("issues")))
    try:
        write_annotated(matrix, path)
    except Exception as exc:
        logger.error("export to %s failed: %s", path, exc)
        failed = F.array(F.lit(f"write failed: {type(exc).__name__} at {path}"))
        issues = F.when(sound, F.concat("issues", failed)).otherwise(F.col("issues"))
        reports = reports.withColumn("issues", issues)
    else:
        folder = F.concat(F.lit(f"{path}/x/job_id="), folder_value(F.col("job_id")))
        reports = reports.withColumn("output_path", F.when(sound, folder))
    return reports.withColumn("status", status_of(F.col("fatal"), F.col("issues")))


def _ordered_metadata(spark: SparkSession, source, job_ids: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Metadata with the order in which "the first row of a sample" is meant."""
    from ..sources.files import ReleaseFiles

    if isinstance(source, ReleaseFiles):
        return source.metadata(spark, job_ids, with_ordinal=True), ["ingest_ordinal"]
    metadata = source.metadata(spark, job_ids)
    return metadata, ["ingest_ordinal"] if "ingest_ordinal" in metadata.columns else list(metadata.columns)
