"""Samples x genes export: the three tables of an annotated matrix, as Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sample_id
from ..functions.ranking import RANGE_ROWS, first_rows, index_within
from ..session import measured_side
from .validate import matrix_samples, metadata_samples

# Genes per vector block: the most cells one row of `sample_vectors` can hold.
BLOCK_GENES = 4096


@dataclass(frozen=True)
class AnnotatedMatrix:
    """`x`: cells by sample; `obs`: one row per sample; `var`: one row per gene."""

    x: DataFrame
    obs: DataFrame
    var: DataFrame


def var_table(sequencing: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Genes of each release with their 0-based position in text order."""
    genes = sequencing.select("job_id", F.col("gene_id").cast("string").alias("gene_id")).distinct()
    return index_within(genes, "job_id", "gene_id", "gene_idx", range_rows)


def obs_table(sequencing: DataFrame, metadata: DataFrame, order: list[str | Column]) -> DataFrame:
    """Metadata of the samples both sides know: the first row per sample by ``order``.

    ``order`` names the ingest order; without one "first" would depend on the scan.
    """
    named = metadata.withColumn("sequenced_id", sample_id()).filter(F.col("sequenced_id").isNotNull())
    # Cut repeated samples to one row before the join: the cut starts in the map tasks.
    once = first_rows(named, ["job_id", "sequenced_id"], order)
    return once.join(matrix_samples(sequencing), ["job_id", "sequenced_id"], "left_semi")


def sample_cells(sequencing: DataFrame, metadata: DataFrame, var: DataFrame) -> DataFrame:
    """The matrix turned to samples x genes: (job, sample, gene position, value) of shared samples."""
    samples = measured_side(metadata_samples(metadata), "samples")
    positions = measured_side(var.select("job_id", "gene_id", "gene_idx"), "gene-positions")
    kept = sequencing.join(samples, ["job_id", "sequenced_id"], "left_semi")
    return kept.join(positions, ["job_id", "gene_id"]).select("job_id", sample_id(), "gene_idx", "value")


def sample_vectors(cells: DataFrame, block_genes: int = BLOCK_GENES) -> DataFrame:
    """Each sample as vectors over blocks of neighbouring genes.

    A block holds at most ``block_genes`` cells however large the sample is; equal
    (sample, gene) cells raise instead of growing it.
    """
    once = (
        cells.groupBy("job_id", "sequenced_id", "gene_idx")
        .agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "value",
            F.when(
                F.col("__n") > 1,
                F.raise_error(F.concat_ws(" ", F.lit("duplicate cell in sample"), "sequenced_id")).cast("double"),
            ).otherwise(F.col("value")),
        )
    )
    pairs = F.sort_array(F.collect_list(F.struct("gene_idx", "value")))
    return (
        once.groupBy("job_id", "sequenced_id", F.floor(F.col("gene_idx") / block_genes).alias("block"))
        .agg(pairs.alias("__cells"))
        .select(
            "job_id",
            "sequenced_id",
            "block",
            F.col("__cells.gene_idx").alias("gene_idx"),
            F.col("__cells.value").alias("value"),
        )
    )


def annotated_matrix(sequencing: DataFrame, metadata: DataFrame, order: list[str | Column]) -> AnnotatedMatrix:
    var = var_table(sequencing)
    return AnnotatedMatrix(
        x=sample_cells(sequencing, metadata, var), obs=obs_table(sequencing, metadata, order), var=var
    )


def write_annotated(matrix: AnnotatedMatrix, path: str) -> None:
    """One folder per release in each of `x`, `obs` and `var`.

    `x` is clustered by (release, sample, gene) ranges, so a large sample spans several
    files and a small one lies in a single file.
    """
    _write(matrix.x, f"{path}/x", ["job_id", "sequenced_id", "gene_idx"])
    _write(matrix.obs, f"{path}/obs", ["job_id", "sequenced_id"])
    _write(matrix.var, f"{path}/var", ["job_id", "gene_idx"])


def export_samples_by_genes(
    sequencing: DataFrame, metadata: DataFrame, order: list[str | Column], path: str | None = None
) -> AnnotatedMatrix:
    """Build `x`, `obs` and `var`; with ``path`` also write them."""
    matrix = annotated_matrix(sequencing, metadata, order)
    if path is not None:
        write_annotated(matrix, path)
    return matrix


def _write(df: DataFrame, path: str, order: list[str]) -> None:
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("errorifexists")
        .partitionBy("job_id")
        .parquet(path)
    )
