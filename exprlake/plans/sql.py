"""SQL over the `metadata` and `chemistry` of one release or of all."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.columns import conform_to
from ..schemas import CHEMISTRY
from ..session import sibling_session

logger = logging.getLogger(__name__)

# Fixed value: the statement run when none is given.
DEFAULT_SQL = "SELECT * FROM metadata LIMIT 10"


def query(
    spark: SparkSession, source, job: str | None = None, sql: str = DEFAULT_SQL, with_sequencing: bool = False
) -> DataFrame:
    """Run Spark SQL over the tables of one release (``job``: id or name) or of all.

    Tables: ``metadata``, ``chemistry``, and ``chemistry_by_job``, which also has `job_id` to
    join on, as ``chemistry`` repeats a compound for each release that used it.  The long
    matrix ``sequencing`` is only there with ``with_sequencing=True``; names then have to match
    in case.

    The statement runs on a session of its own, so it sees no other temp views and leaves
    none behind.  It is executed as given: do not pass untrusted text.
    """
    job_ids = None
    if job is not None:
        job_ids = [source.resolve(spark, job)]
        source.require(spark, job_ids)
    # Column names match in any case and "name" is an identifier, as SQL users expect.  Names
    # of samples may differ only in case, so with the matrix at hand case counts.
    session = sibling_session(
        spark,
        spark__sql__caseSensitive="true" if with_sequencing else "false",
        spark__sql__ansi__doubleQuotedIdentifiers="true",
    )
    if source.is_empty(spark):
        logger.warning("query(): the catalog lists no release; the result is empty")
        return session.createDataFrame([], T.StructType([]))
    chemistry = source.chemistry(session, job_ids)
    source.metadata(session, job_ids).createOrReplaceTempView("metadata")
    conform_to(chemistry, CHEMISTRY).createOrReplaceTempView("chemistry")
    chemistry.createOrReplaceTempView("chemistry_by_job")
    if with_sequencing:
        source.sequencing(session, job_ids).createOrReplaceTempView("sequencing")
    return session.sql(sql)


def describe(spark: SparkSession, source, job: str | None = None) -> dict[str, DataFrame]:
    """Column names and types of `metadata` and `chemistry`.  Reads schemas only."""
    job_ids = None if job is None else [source.resolve(spark, job)]
    return {
        "metadata": describe_schema(spark, source.metadata(spark, job_ids).schema),
        "chemistry": describe_schema(spark, CHEMISTRY),
    }


def describe_schema(spark: SparkSession, schema: T.StructType) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    return spark.createDataFrame(rows, "column_name string, column_type string")
