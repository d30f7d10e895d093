"""A matrix layout that serves filters on genes and filters on samples alike.

Genes, and the samples of each release, are cut into equal parts by rank.  Cells are ordered along the Morton
curve of (gene part, sample part), so every stretch of a file holds few parts of both, and a reader who looks
for some samples or for some genes skips most row groups by their statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import index_within
from ..session import materialize, measured_side
from .matrix import known_gene

# Genes and samples of a release are cut into 2 ** PART_BITS parts each.
PART_BITS = 8
# Ranges of parts that a reader's filter lists; neighbouring ones are joined beyond that.
MAX_RANGES = 16


def ranked_parts(keys: DataFrame, group: str, key: str, name: str, bits: int = PART_BITS) -> DataFrame:
    """(group, key, name): the part of its group, by rank, in which each distinct key lies."""
    numbered = materialize(index_within(keys.select(group, key).distinct(), group, key, "__at"), "ranked")
    sizes = numbered.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(group, "__group")
    # A few groups hold all keys: joined by a shuffle, each of them would meet in one task.
    sizes = measured_side(sizes, "group-sizes")
    part = F.expr(f"cast(__at * {1 << bits} div __n as int)").alias(name)
    return numbered.join(sizes, F.col(group).eqNullSafe(F.col("__group"))).select(group, key, part)


def interleaved(high: Column, low: Column, bits: int = PART_BITS) -> Column:
    """The bits of two numbers in turn, ``high`` first: the place on the Morton curve."""
    place = F.lit(0).cast("long")
    for i in range(bits):
        for at, number in ((2 * i + 1, high), (2 * i, low)):
            bit = F.shiftright(number.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
            place = place.bitwiseOR(F.shiftleft(bit, at))
    return place


def with_parts(sequencing: DataFrame, sample_parts: DataFrame, bits: int = PART_BITS) -> DataFrame:
    """The matrix with `sample_part` and its place `__z` on the curve.

    The parts of genes and samples are a row for each gene and sample, and are broadcast if they measure
    small, so that the cells move once, into the order of the curve.
    """
    genes = sequencing.select(F.lit(0).alias("__all"), known_gene(F.col("gene_id")).alias("gene_id"))
    gene_parts = ranked_parts(genes, "__all", "gene_id", "__gene_part", bits).select(
        F.col("gene_id").alias("__gene"), "__gene_part"
    )
    here = sample_parts.select(F.col("job_id").alias("__job"), F.col("sequenced_id").alias("__sample"), "sample_part")
    same = F.col("job_id").eqNullSafe(F.col("__job")) & F.col("sequenced_id").eqNullSafe(F.col("__sample"))
    parted = (
        sequencing.join(measured_side(gene_parts, "gene-parts"), known_gene(F.col("gene_id")) == F.col("__gene"), "left")
        .join(measured_side(here, "sample-parts"), same, "left")
        .withColumn("sample_part", F.coalesce("sample_part", F.lit(0)))
        .withColumn("__z", interleaved(F.coalesce("__gene_part", F.lit(0)), F.col("sample_part"), bits))
    )
    return parted.select(*sequencing.columns, "sample_part", "__z")


def in_parts(parts: list[int], column: str = "sample_part", most: int = MAX_RANGES) -> Column:
    """A filter that Parquet statistics can answer: the column lies in one of a few ranges that hold ``parts``."""
    if not parts:
        return F.lit(False)
    ordered = sorted(set(parts))
    # The widest gaps between parts stay; the others are read over.
    gaps = sorted(range(1, len(ordered)), key=lambda i: ordered[i] - ordered[i - 1], reverse=True)
    cuts = sorted(i for i in gaps[: most - 1] if ordered[i] - ordered[i - 1] > 1)
    condition = F.lit(False)
    for low, high in zip([0, *cuts], [*cuts, len(ordered)]):
        within = (F.col(column) >= ordered[low]) & (F.col(column) <= ordered[high - 1])
        condition = within if low == 0 else condition | within
    return condition
