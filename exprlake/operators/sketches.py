"""Stored sketches of (release, gene): how many samples, and how values are spread, for any set of releases.

A sketch is some kilobytes whatever it was made from, and two merge into that of both.  Questions about genes over
any choice of releases are answered from the sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The estimate of different samples is off by more than three times this part in one case of 400.
SAMPLES_ERROR = 1.04 / 2**6
# Rank error of a quantile at 99 per cent confidence with the default size.
RANK_ERROR = 0.0133


def gene_sketches(sequencing: DataFrame) -> DataFrame:
    """(job_id, gene_id, n_cells, samples, values) of the cells that are not NULL; made in the map tasks."""
    known = sequencing.filter(F.col("value").isNotNull() & F.col("sequenced_id").isNotNull())
    return known.groupBy("job_id", "gene_id").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.hll_sketch_agg("sequenced_id").alias("samples"),
        F.kll_sketch_agg_double("value").alias("values"),
    )


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of all releases together, by gene or by whatever ``by`` names."""
    return sketches.groupBy(*by).agg(
        F.sum("n_cells").alias("n_cells"),
        F.hll_union_agg("samples").alias("samples"),
        F.kll_merge_agg_double("values").alias("values"),
    )


def n_samples() -> Column:
    """About how many different samples."""
    return F.hll_sketch_estimate("samples")


def quantile(p: float) -> Column:
    """A value whose place among all is about ``p``."""
    return F.kll_sketch_get_quantile_double("values", F.lit(p))
