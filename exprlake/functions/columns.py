"""Column expressions used in several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import METADATA_TYPES


def quoted(name: str) -> str:
    """A column name for `F.col` or SQL text, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def sample_id(name: str = "sequenced_id") -> Column:
    """Sample ids are compared as text everywhere."""
    return F.col(name).cast("string").alias("sequenced_id")


# Characters besides control characters that Spark writes as %XX in the name of a partition folder.
FOLDER_ESCAPES = "\"#%'*/:=?\\{[]^\x7f"


def folder_value(value: Column) -> Column:
    """A text as it stands in the name of a partition folder."""

    def shown(c: Column) -> Column:
        special = (F.ascii(c) < 32) | F.lit(FOLDER_ESCAPES).contains(c)
        return F.when(special, F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)

    return F.when(F.coalesce(value, F.lit("")) == "", "__HIVE_DEFAULT_PARTITION__").otherwise(
        F.array_join(F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), shown), "")
    )


def conform_metadata(df: DataFrame) -> DataFrame:
    """Cast the core sample columns by name; keep all other columns as they are.

    ``try_cast`` turns a value that does not parse into NULL instead of failing a scan
    over thousands of files.
    """
    return df.select(
        *[
            F.col(quoted(c)).try_cast(METADATA_TYPES[c]).alias(c) if c in METADATA_TYPES else F.col(quoted(c))
            for c in df.columns
        ]
    )


def conform_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order; those ``df`` lacks become typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)
