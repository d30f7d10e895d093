"""What a matrix covers: for each release and sample the set of its gene rows, as words of bits.

Gene rows are taken 64 at a time, and those of a sample are the bits of one number.  A full matrix costs a number
for 64 of its cells, and a sparse one a number for each cell at most, so the counts that validation, size
estimates and catalog statistics need come from one pass whose shuffle never outgrows the cells.  Coverages can be
merged: words are or-ed and counts added, which is how a store keeps its statistics up to date without reading
the matrix again.

A row of a matrix is named by `gene_row`.  Where a matrix has that column it is the ordinal its reader gave to
each row, so a gene that stands in two rows is told apart from a sample that stands in two columns.  Where it
is absent or NULL, as in tables that were long from the start, the gene itself is the row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import index_within
from ..session import materialize, materialize_slices, measured_side, shuffles_removed, temporary_tables
from .matrix import BYTES_PER_CELL, known_gene

# Gene rows of a word, and words that a stored row takes together.
WORD_BITS = 64
BLOCK_WORDS = 512
# Slices of its samples that a matrix is kept in, and cells that are made into words at a time, about.
SLICES = 16
PASS_CELLS = 10_000_000

# (job_id, sequenced_id, block): the words of a block in which the sample has cells, and how many cells.
COVERAGE = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("sequenced_id", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField(
            "words",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("word", T.LongType()),
                        T.StructField("genes", T.LongType()),
                        T.StructField("n_cells", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)
GENE_ROWS = T.StructType([T.StructField("gene_id", T.StringType()), T.StructField("gene_row", T.LongType())])


def number_genes(gene_ids: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(gene_id, gene_row) of the distinct ids in ``gene_ids`` that ``known`` has no number for.

    Numbers are dense, in the order of the ids, and go on after the largest known one.
    """
    new = gene_ids.select(known_gene(F.col("gene_id")).alias("gene_id")).distinct()
    first = 0
    if known is not None:
        first = known.agg(F.coalesce(F.max("gene_row") + 1, F.lit(0))).first()[0]
        new = new.join(known, "gene_id", "left_anti")
    numbered = index_within(new.withColumn("__all", F.lit(0)), "__all", "gene_id", "__at")
    return numbered.select("gene_id", (F.col("__at") + F.lit(first)).cast("long").alias("gene_row"))


def with_gene_rows(sequencing: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """The matrix with a `gene_row` in every cell.

    ``genes`` numbers the ids of cells without one (default: they are numbered now).  It is one row for each
    gene id and is broadcast if it measures small, so that the cells stay where they are.
    """
    sequencing = _with_row_column(sequencing)
    if genes is None:
        genes = number_genes(sequencing.filter(F.col("gene_row").isNull()))
    return _with_numbers(sequencing, _measured(genes))


def _with_row_column(sequencing: DataFrame) -> DataFrame:
    if "gene_row" in sequencing.columns:
        return sequencing
    return sequencing.withColumn("gene_row", F.lit(None).cast("long"))


def _measured(genes: DataFrame) -> DataFrame:
    return measured_side(genes.select(F.col("gene_id").alias("__gene"), F.col("gene_row").alias("__row")), "gene-rows")


def _with_numbers(sequencing: DataFrame, numbers: DataFrame) -> DataFrame:
    same = (known_gene(F.col("gene_id")) == F.col("__gene")) & F.col("gene_row").isNull()
    rows = sequencing.join(numbers, same, "left")
    return rows.withColumn("gene_row", F.coalesce("gene_row", "__row")).drop("__gene", "__row")


def words(sequencing: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """(job_id, sequenced_id, word, genes, n_cells): `genes` has a bit for each gene row of the word that the
    sample has a cell in.

    Each map task sends one row for each sample and 64 gene rows that it has cells of, however many.
    """
    return _words(with_gene_rows(sequencing, genes))


def _words(cells: DataFrame) -> DataFrame:
    rows = cells.select(
        "job_id",
        F.col("sequenced_id").cast("string").alias("sequenced_id"),
        F.expr(f"gene_row div {WORD_BITS}").alias("word"),
        F.expr(f"shiftleft(1L, cast(gene_row % {WORD_BITS} as int))").alias("bit"),
    )
    return rows.groupBy("job_id", "sequenced_id", "word").agg(
        F.coalesce(F.bit_or("bit"), F.lit(0).cast("long")).alias("genes"), F.count(F.lit(1)).alias("n_cells")
    )


def coverage(sequencing: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """COVERAGE of a long matrix: its words, those of a sample and 32,768 gene rows in one row."""
    return (
        words(sequencing, genes)
        .groupBy("job_id", "sequenced_id", F.expr(f"word div {BLOCK_WORDS}").alias("block"))
        .agg(F.collect_list(F.struct("word", "genes", "n_cells")).alias("words"))
    )


def words_of(covered: DataFrame) -> DataFrame:
    """The words of a COVERAGE, or of a frame that has them as its rows."""
    return covered.select("job_id", "sequenced_id", F.inline("words")) if "words" in covered.columns else covered


def merge(coverages: DataFrame) -> DataFrame:
    """The words of several coverages, stacked, as those of one.

    Rows move while they are packed; the words of a sample then meet without another shuffle.
    """
    return words_of(coverages.repartition("job_id", "sequenced_id")).groupBy("job_id", "sequenced_id", "word").agg(
        F.bit_or("genes").alias("genes"), F.sum("n_cells").alias("n_cells")
    )


def _any_sample(covered: DataFrame) -> DataFrame:
    return words_of(covered).groupBy("job_id", "word").agg(F.bit_or("genes").alias("genes"))


def row_counts(covered: DataFrame) -> DataFrame:
    """Gene rows of each release: with repeated genes as often as they are repeated."""
    return _any_sample(covered).groupBy("job_id").agg(F.sum(F.bit_count("genes").cast("long")).alias("n_genes"))


def sample_totals(covered: DataFrame) -> DataFrame:
    """(job_id, sequenced_id, n_cells, n_again): cells of each sample, and those beyond the first of their gene row.

    A frame that has them as its rows stays as it is.
    """
    if "n_again" in covered.columns:
        return covered
    return words_of(covered).groupBy("job_id", "sequenced_id").agg(
        F.sum("n_cells").alias("n_cells"), F.sum(F.col("n_cells") - F.bit_count("genes")).alias("n_again")
    )


def sample_counts(covered: DataFrame) -> DataFrame:
    """Samples, cells, and cells beyond the first of their (gene row, sample), of each release."""
    return sample_totals(covered).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum("n_cells").alias("datapoint_count"),
        F.sum("n_again").alias("n_duplicate_cells"),
    )


def totals(sequencing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The `row_counts` and the `sample_totals` of a matrix, computed now.

    What is on disk at a time is the matrix without its values and the words of some of its samples: cells are kept
    by slices of the samples, and those of a pass are made into words, summed up and dropped before the next.
    """
    spark = sequencing.sparkSession
    rows, samples = [], []
    with temporary_tables(spark), shuffles_removed(spark):
        cells = _with_row_column(sequencing).select(
            F.col("job_id").cast("string").alias("job_id"),
            F.col("sequenced_id").cast("string").alias("sequenced_id"),
            F.when(F.col("gene_row").isNull(), known_gene(F.col("gene_id"))).alias("gene_id"),
            F.col("gene_row").cast("long").alias("gene_row"),
        )
        number = F.pmod(F.xxhash64("job_id", "sequenced_id"), F.lit(SLICES)).cast("int")
        kept = materialize_slices(cells.withColumn("slice", number), "cells", "slice")
        unnumbered = kept.filter(F.col("gene_row").isNull())
        numbers = _measured(number_genes(unnumbered))
        passes = min(SLICES, kept.count() // PASS_CELLS + 1)
        for i in range(passes):
            some = kept.filter(F.col("slice").isin([s for s in range(SLICES) if s % passes == i]))
            with temporary_tables(spark):
                covered = materialize(_words(_with_numbers(some.drop("slice"), numbers)), "coverage")
                rows.append(materialize(_any_sample(covered), "row-words", outlives=True))
                samples.append(materialize(sample_totals(covered), "sample-totals", outlives=True))
    return row_counts(reduce(DataFrame.unionByName, rows)), reduce(DataFrame.unionByName, samples)


def duplicate_cells(covered: DataFrame) -> DataFrame:
    """Releases with cells beyond the first of their (gene row, sample), and how many."""
    return sample_counts(covered).select("job_id", "n_duplicate_cells").filter("n_duplicate_cells > 0")


def estimate_size(covered: DataFrame) -> DataFrame:
    """Gene rows, samples and bytes of each release's wide matrix."""
    samples = sample_counts(covered).select("job_id", "n_samples")
    size = F.col("n_genes") * F.col("n_samples") * F.lit(BYTES_PER_CELL).cast("bigint")
    return row_counts(covered).join(samples, "job_id").withColumn("estimated_bytes", size)
