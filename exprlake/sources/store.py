"""Write releases: as files that `ReleaseFiles` reads, or as one Parquet store that knows its statistics."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import conform_to
from ..functions.facts import one_row_per_release
from ..operators import coverage as cv
from ..operators.layout import in_parts, ranked_parts, with_parts
from ..operators.matrix import keep_samples, known_gene, sample_names, to_wide
from ..schemas import CATALOG, CHEMISTRY, CHEMISTRY_COLUMNS, METADATA_TYPES, SEQUENCING, SEQUENCING_ROWS
from ..session import materialize
from .files import CSV_OPTIONS, ReleaseFiles
from .frames import ReleaseFrames, _only

CHEMISTRY_BY_JOB = T.StructType([T.StructField("job_id", T.StringType()), *CHEMISTRY.fields])
SAMPLE_PARTS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("sequenced_id", T.StringType()),
        T.StructField("sample_part", T.IntegerType()),
    ]
)
SAMPLE_FACTS = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("cell_line", T.StringType()),
        T.StructField("timepoint", T.StringType()),
        T.StructField("n_rows", T.LongType()),
    ]
)

# Wide releases that Spark has to scan one by one, taken into the store per job.
RELEASES_PER_JOB = 32
# Filters on these columns skip row groups that hold none of the values; a filter is sized for so many.
BLOOM_COLUMNS = ("sequenced_id", "gene_id")
BLOOM_VALUES = 100_000


def _canonical(sequencing: DataFrame) -> DataFrame:
    schema = SEQUENCING_ROWS if "gene_row" in sequencing.columns else SEQUENCING
    return conform_to(sequencing, schema).withColumn("gene_id", known_gene(F.col("gene_id")))


def write_matrix(sequencing: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The long matrix, one folder per release.

    Ranges over (release, gene, sample) split a large release over many tasks and keep
    small ones in one file; sorted genes give Parquet tight min/max statistics.
    """
    keys = ["job_id", "gene_id", "sequenced_id"]
    (
        _canonical(sequencing)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode(mode)
        .partitionBy("job_id")
        .parquet(path)
    )


def write_matrix_by_parts(sequencing: DataFrame, path: str, parts_path: str, files: int | None = None) -> None:
    """The long matrix along the Morton curve of gene and sample ranks, one folder per release.

    Serves a choice of samples as well as one of genes (`operators.layout`); files carry the `sample_part` of
    each cell, and ``parts_path`` gets the part of each sample.  Bloom filters answer for single ids.
    """
    # Ranks, bounds of ranges and the write each need the cells, which may be dear to make.
    cells = materialize(_canonical(sequencing), "cells")
    parts = materialize(ranked_parts(cells, "job_id", "sequenced_id", "sample_part"), "sample-parts")
    parts.write.mode("append").parquet(parts_path)
    keys = ["job_id", "__z", "sequenced_id", "gene_id"]
    placed = with_parts(cells, parts)
    ranged = placed.repartitionByRange(files, *keys) if files else placed.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).drop("__z").write.partitionBy("job_id")
    for column in BLOOM_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(BLOOM_VALUES))
    writer.parquet(path)


def write_matrix_table(sequencing: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """The long matrix as a catalog table bucketed by (release, gene).

    Dropping unexpressed genes, counting genes and looking for duplicate cells then run
    without a shuffle of the matrix.  Choose buckets of a few hundred MB.  A bucket is read by
    one task, so where one gene holds much of the matrix `write_matrix` is the better layout.
    """
    writer = (
        _canonical(sequencing)
        .repartition(buckets, "job_id", "gene_id")
        .write.bucketBy(buckets, "job_id", "gene_id")
        .sortBy("job_id", "gene_id")
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_wide(sequencing: DataFrame, path: str) -> None:
    """One release as a wide matrix with a named column for each sample."""
    to_wide(sequencing, sample_names(sequencing)).write.parquet(path)


def _balanced(df: DataFrame, by: str) -> DataFrame:
    """Rows of one key together in tasks of even size: a hot key is split, small ones share."""
    return df.hint("rebalance", F.col(by))


def write_metadata(metadata: DataFrame, path: str) -> None:
    (
        _balanced(metadata.withColumn("release", F.col("job_id")), "release")
        .write.partitionBy("release")
        .options(**CSV_OPTIONS)
        .csv(path)
    )


def write_chemistry(chemistry: DataFrame, path: str) -> None:
    """`{"compounds": [...]}` documents, one compound each, so that nothing is collected."""
    documents = conform_to(chemistry, CHEMISTRY_BY_JOB).select(
        F.col("job_id").alias("release"), F.array(F.struct(*CHEMISTRY_COLUMNS)).alias("compounds")
    )
    _balanced(documents, "release").write.partitionBy("release").json(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """`{"datasets": [...]}` documents, one release each."""
    conform_to(catalog, CATALOG).select(F.array(F.struct("*")).alias("datasets")).write.json(path)


@dataclass(frozen=True)
class Store(ReleaseFrames):
    """An ingested store: its tables, and statistics that were kept up with every load."""

    root: str = ""

    def coverage(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        """The coverage of the matrix as words; the loads of a release are merged, its cells are not read."""
        return cv.merge(_only(spark.read.schema(cv.COVERAGE).parquet(f"{self.root}/stats/coverage"), job_ids))

    def sizes(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        """Gene rows, samples and bytes of each release's wide matrix."""
        return cv.estimate_size(self.coverage(spark, job_ids))

    def stats(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        """Per release: matrix cells, metadata rows, and the cell lines and time points used."""
        used = _only(spark.read.schema(SAMPLE_FACTS).parquet(f"{self.root}/stats/samples"), job_ids)
        cells = cv.sample_counts(self.coverage(spark, job_ids)).select("job_id", "datapoint_count")
        rows = used.groupBy("job_id").agg(
            F.sum("n_rows").alias("metadata_row_count"),
            F.sort_array(F.collect_set("cell_line")).alias("cell_lines"),
            F.sort_array(F.collect_set("timepoint")).alias("timepoints"),
        )
        none = F.array().cast("array<string>")
        return one_row_per_release([rows, cells]).select(
            "job_id",
            F.coalesce("datapoint_count", F.lit(0)).alias("datapoint_count"),
            F.coalesce("metadata_row_count", F.lit(0)).alias("metadata_row_count"),
            F.coalesce("cell_lines", none).alias("cell_lines"),
            F.coalesce("timepoints", none).alias("timepoints"),
        )

    def sequencing_of(self, spark: SparkSession, ids: DataFrame, job_ids: list[str] | None = None) -> DataFrame:
        """Cells of the samples in ``ids``; row groups in which no such sample can lie are not read.

        The parts that hold the samples, at most a few hundred numbers, come to the driver and become a
        filter on the files.
        """
        wanted = ids.select(F.col("sequenced_id").cast("string")).distinct()
        held = _only(spark.read.schema(SAMPLE_PARTS).parquet(f"{self.root}/sample_parts"), job_ids)
        parts = held.join(wanted, "sequenced_id", "left_semi").select("sample_part").distinct().collect()
        cells = _matrix(spark, self.root, with_parts=True).filter(in_parts([r["sample_part"] for r in parts]))
        return keep_samples(_only(cells, job_ids).drop("sample_part", "gene_row"), wanted)


def ingest(spark: SparkSession, source, root: str, files: int | None = None) -> Store:
    """Take the releases of ``source`` (files or frames) into a new Parquet store below ``root``.

    Wide matrices are turned long once, here; later reads are single scans that prune by release, gene and
    sample.  ``files`` fixes the number of ranges that the matrix is cut into.
    """
    return append(spark, source, root, files)


def append(spark: SparkSession, source, root: str, files: int | None = None) -> Store:
    """Add the releases of ``source`` to the store below ``root``, with their statistics.

    A release that the store has already gets more cells and samples, if it was long from the start; the rows
    of a wide matrix are numbered within it, so it can be taken in once only.  A load that broke off leaves no
    statistics behind; `rebuild_statistics` makes them anew from the tables.
    """
    listed = conform_to(source.catalog(spark), CATALOG)
    job_ids = [r["job_id"] for r in listed.select("job_id").distinct().orderBy("job_id").collect()]
    load = uuid.uuid4().hex
    step = max(1, len(job_ids))
    if isinstance(source, ReleaseFiles) and not source.is_one_scan(spark):
        step = RELEASES_PER_JOB
    for i, start in enumerate(range(0, len(job_ids), step)):
        group = job_ids[start : start + step]
        rows = source.sequencing(spark, group, with_rows=True)
        at = f"{root}/matrix/load={load}-{i}"
        write_matrix_by_parts(rows, at, f"{root}/sample_parts", files)
        _add_coverage(spark, root, spark.read.schema(SEQUENCING_ROWS).parquet(at))
    metadata = source.metadata(spark)
    _balanced(metadata, "job_id").write.mode("append").parquet(f"{root}/metadata")
    _sample_facts(metadata).write.mode("append").parquet(f"{root}/stats/samples")
    chemistry = conform_to(source.chemistry(spark), CHEMISTRY_BY_JOB)
    _balanced(chemistry, "job_id").write.mode("append").parquet(f"{root}/chemistry")
    if _exists(spark, f"{root}/catalog"):
        had = materialize(open_store(root).catalog(spark).select("job_id"), "releases")
        listed = listed.join(had, "job_id", "left_anti").select(*CATALOG.fieldNames())
    listed.write.mode("append").parquet(f"{root}/catalog")
    return open_store(root)


def rebuild_statistics(spark: SparkSession, root: str) -> None:
    """Make the statistics of a store anew from its matrix and metadata, beside the old ones, then replace them."""
    cells = _matrix(spark, root)
    genes = materialize(cv.number_genes(cells.filter(F.col("gene_row").isNull())), "genes")
    covered = materialize(cv.coverage(cells, genes), "coverage")
    facts = materialize(_sample_facts(open_store(root).metadata(spark)), "sample-facts")
    genes.write.mode("overwrite").parquet(f"{root}/stats/genes")
    covered.write.mode("overwrite").parquet(f"{root}/stats/coverage")
    facts.write.mode("overwrite").parquet(f"{root}/stats/samples")


def _add_coverage(spark: SparkSession, root: str, cells: DataFrame) -> None:
    """Append the coverage of new cells; genes keep the numbers that earlier loads gave them."""
    known = _known_genes(spark, root)
    new = materialize(cv.number_genes(cells.filter(F.col("gene_row").isNull()), known), "new-genes")
    new.write.mode("append").parquet(f"{root}/stats/genes")
    genes = new if known is None else known.unionByName(new)
    cv.coverage(cells, genes).write.mode("append").parquet(f"{root}/stats/coverage")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _known_genes(spark: SparkSession, root: str) -> DataFrame | None:
    if not _exists(spark, f"{root}/stats/genes"):
        return None
    # Written out, as the folder it is read from gets more files before it is used.
    return materialize(spark.read.schema(cv.GENE_ROWS).parquet(f"{root}/stats/genes"), "known-genes")


def _sample_facts(metadata: DataFrame) -> DataFrame:
    """Metadata rows by release, cell line and time point: sums, so those of several loads add up."""
    names = ["job_id", "cell_line", "timepoint"]
    rows = conform_to(metadata, T.StructType([T.StructField(n, METADATA_TYPES[n]) for n in names]))
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"))


def _matrix(spark: SparkSession, root: str, with_parts: bool = False) -> DataFrame:
    # With a declared schema the release folders stay text and need not be looked at.
    part = [T.StructField("sample_part", T.IntegerType())] if with_parts else []
    schema = T.StructType([*SEQUENCING_ROWS.fields, *part])
    return conform_to(spark.read.schema(schema).parquet(f"{root}/matrix"), schema)


def open_store(root: str) -> Store:
    """The releases of an ingested store."""
    return Store(
        catalog=lambda spark: spark.read.schema(CATALOG).parquet(f"{root}/catalog"),
        metadata_table=lambda spark: spark.read.option("mergeSchema", "true").parquet(f"{root}/metadata"),
        chemistry_table=lambda spark: spark.read.schema(CHEMISTRY_BY_JOB).parquet(f"{root}/chemistry"),
        sequencing_table=lambda spark: _matrix(spark, root),
        root=root,
    )
