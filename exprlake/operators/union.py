"""Stacking of per-release sample and chemistry tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import conform_metadata, conform_to
from ..schemas import CHEMISTRY, METADATA


def concat_metadata(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name.  Core columns are cast first, so types agree; columns
    only some releases have are NULL elsewhere.  No frames: a typed empty table."""
    if not frames:
        return spark.createDataFrame([], METADATA)
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [conform_metadata(f) for f in frames]
    )


def concat_chemistry(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    """Bag union of compounds.  A compound of several releases stays repeated."""
    if not frames:
        return empty_chemistry(spark)
    return reduce(DataFrame.unionByName, [conform_to(f, CHEMISTRY) for f in frames])


def empty_chemistry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHEMISTRY)
