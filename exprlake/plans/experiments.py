"""Loading one release, and combining several."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import conform_to
from ..operators.matrix import (
    WideBlocks,
    distinct_sample_ids,
    drop_unexpressed,
    expressed_genes,
    keep_samples,
    to_blocks,
    to_wide,
)
from ..schemas import CHEMISTRY
from ..session import measured_side
from ..sources.store import Store
from .sql import query


@dataclass(frozen=True)
class Experiment:
    """One release: long matrix with its zeros, samples, compounds."""

    data: DataFrame
    metadata: DataFrame
    chemistry: DataFrame
    job_id: str

    def to_blocks(self) -> WideBlocks:
        """Genes x samples, in blocks of a fixed number of samples."""
        return to_blocks(self.data)

    def to_wide(self, samples: list[str]) -> DataFrame:
        """Genes x the given samples, one named column each."""
        return to_wide(self.data, samples)


@dataclass(frozen=True)
class Combined:
    """Several releases.  ``data`` is long and holds the expressed genes of each release."""

    data: DataFrame
    metadata: DataFrame
    chemistry: DataFrame
    job_ids: list[str]
    unfiltered: DataFrame

    def release(self, job_id: str) -> DataFrame:
        """The cells of one of the releases."""
        return self.data.filter(F.col("job_id") == job_id)

    def to_blocks(
        self, fill_value: float | None = None, include_empty_release_genes: bool = False
    ) -> WideBlocks:
        """Genes x samples of all releases, in blocks of a fixed number of samples.

        A release whose samples were all filtered out has no cells here.  To list its genes
        anyway (all NULL), set ``include_empty_release_genes``.
        """
        extra = self._empty_release_genes() if include_empty_release_genes else None
        return to_blocks(self.data, fill_value=fill_value, extra_genes=extra)

    def to_wide(
        self, samples: list[str], fill_value: float | None = None, include_empty_release_genes: bool = False
    ) -> DataFrame:
        """The same with a named column for each of the given samples."""
        extra = self._empty_release_genes() if include_empty_release_genes else None
        return to_wide(self.data, samples, fill_value=fill_value, extra_genes=extra)

    def _empty_release_genes(self) -> DataFrame:
        used = keep_samples(self.unfiltered, self.metadata).select("job_id").distinct()
        return self.unfiltered.join(used, "job_id", "left_anti").select("gene_id")


def load_dataset(spark: SparkSession, source, job: str) -> DataFrame:
    """The matrix of one release, wide, all genes kept."""
    return source.load_dataset(spark, job)


def load_metadata(spark: SparkSession, source, job: str) -> DataFrame:
    """The samples of one release."""
    return source.load_metadata(spark, job)


def load_chem(spark: SparkSession, source, job: str) -> DataFrame:
    """The compounds of one release; a typed empty table if it has none."""
    return source.load_chem(spark, job)


def load_experiment(spark: SparkSession, source, job: str) -> Experiment:
    """Matrix, metadata and chemistry of one release.  Only the matrix has to exist."""
    job_id = source.resolve(spark, job)
    source.require(spark, [job_id])
    return Experiment(
        data=source.sequencing(spark, [job_id]),
        metadata=source.metadata(spark, [job_id]),
        chemistry=conform_to(source.chemistry(spark, [job_id]), CHEMISTRY),
        job_id=job_id,
    )


def filter_metadata_by_sql(
    spark: SparkSession, source, metadata: DataFrame, sql: str, job_ids: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Samples of ``metadata`` that ``sql`` returns, and the set of ids it returned.

    The statement sees all releases, unless ``job_ids`` narrows it.
    """
    seen = source if job_ids is None else _Narrowed(source, job_ids)
    # Computed once: a statement with a bare LIMIT may pick other samples the next time.
    ids = measured_side(distinct_sample_ids(query(spark, seen, sql=sql)), "sample-ids")
    return keep_samples(metadata, ids), ids


def load_experiments(
    spark: SparkSession,
    source,
    jobs: list[str],
    sql: str | None = None,
    scope: str = "release",
    filter_scope: str = "collective",
) -> Combined:
    """Combine releases: choose samples with ``sql``, then drop unexpressed genes.

    ``scope`` judges genes per ``"release"`` or over the ``"combined"`` samples.
    ``filter_scope`` runs ``sql`` over all releases (``"collective"``: a LIMIT or an
    aggregate in it is global) or over the ``"requested"`` ones.  Chemistry is not filtered.

    The chosen samples and the expressed genes are computed now; the cells are read when
    they are asked for, and move in no shuffle as long as those two sets measure small.
    """
    if not jobs:
        raise ValueError("no releases given")
    if filter_scope not in ("collective", "requested"):
        raise ValueError(f"filter_scope is 'collective' or 'requested', not {filter_scope!r}")
    job_ids = source.resolve_all(spark, jobs)
    source.require(spark, job_ids)
    unfiltered = source.sequencing(spark, job_ids)
    metadata = source.metadata(spark, job_ids)
    data = unfiltered
    if sql is not None:
        only = job_ids if filter_scope == "requested" else None
        metadata, ids = filter_metadata_by_sql(spark, source, metadata, sql, only)
        # A store reads only where the chosen samples lie.
        data = source.sequencing_of(spark, ids, job_ids) if isinstance(source, Store) else keep_samples(data, ids)
    genes = measured_side(expressed_genes(data, scope), "expressed-genes")
    return Combined(
        data=drop_unexpressed(data, scope, genes),
        metadata=metadata,
        chemistry=conform_to(source.chemistry(spark, job_ids), CHEMISTRY),
        job_ids=job_ids,
        unfiltered=unfiltered,
    )


class _Narrowed:
    """A source that shows only some of its releases."""

    def __init__(self, source, job_ids: list[str]):
        self._source = source
        self._job_ids = job_ids

    def is_empty(self, spark: SparkSession) -> bool:
        return self._source.is_empty(spark)

    def metadata(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        return self._source.metadata(spark, job_ids or self._job_ids)

    def chemistry(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        return self._source.chemistry(spark, job_ids or self._job_ids)
