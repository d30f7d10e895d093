"""Releases given as DataFrames (catalog tables, views, derived data)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import conform_to
from ..operators.matrix import sample_names, to_wide
from ..schemas import CHEMISTRY, PROBLEMS
from ..session import small_frame
from .catalog import resolve_all, resolve_job

Builder = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class ReleaseFrames:
    """Builds each table on the session it is asked for, so that SQL runs on its own one.

    All tables carry `job_id`; a selection of releases is a filter on it, which prunes
    partitions where the table is partitioned by release.  In the matrix an unknown gene id
    has to be the empty text, not NULL.
    """

    catalog: Builder
    metadata_table: Builder
    chemistry_table: Builder
    sequencing_table: Builder

    def resolve(self, spark: SparkSession, job: str) -> str:
        return resolve_job(self.catalog(spark), job)

    def resolve_all(self, spark: SparkSession, jobs: list[str]) -> list[str]:
        return resolve_all(self.catalog(spark), jobs)

    def is_empty(self, spark: SparkSession) -> bool:
        return self.catalog(spark).isEmpty()

    def metadata(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        return _only(self.metadata_table(spark), job_ids)

    def chemistry(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        return _only(self.chemistry_table(spark), job_ids)

    def sequencing(
        self, spark: SparkSession, job_ids: list[str] | None = None, with_rows: bool = False
    ) -> DataFrame:
        """The long matrix; ``with_rows`` keeps the `gene_row` of a table that has one."""
        cells = _only(self.sequencing_table(spark), job_ids)
        return cells if with_rows else cells.drop("gene_row")

    def load_dataset(self, spark: SparkSession, job: str) -> DataFrame:
        """The matrix of one release, wide.  Runs a job to learn the names of its columns."""
        cells = self.sequencing(spark, [self.resolve(spark, job)])
        return to_wide(cells, sample_names(cells))

    def load_metadata(self, spark: SparkSession, job: str) -> DataFrame:
        return self.metadata(spark, [self.resolve(spark, job)])

    def load_chem(self, spark: SparkSession, job: str) -> DataFrame:
        return conform_to(self.chemistry(spark, [self.resolve(spark, job)]), CHEMISTRY)

    def problems(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        return small_frame(spark, [], PROBLEMS)

    def require(self, spark: SparkSession, job_ids: list[str]) -> None:
        """Tables are always there."""


def _only(df: DataFrame, job_ids: list[str] | None) -> DataFrame:
    return df if job_ids is None else df.filter(F.col("job_id").isin(list(job_ids)))
