"""The release catalog: listing, name resolution, selection, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import conform_to
from ..functions.facts import one_row_per_release
from ..schemas import CATALOG
from ..session import small_frame

# Sample columns that the catalog sums up; a release may lack them.
_USED = T.StructType([T.StructField(c, T.StringType()) for c in ("job_id", "cell_line", "timepoint")])


def list_datasets(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """All releases of a catalog: JSON documents with an array `datasets`.

    A single `.json` file is one document, over many lines if need be; a folder holds one
    document per line and is split over tasks.
    """
    if multi_line is None:
        multi_line = path.endswith(".json")
    return read_documents(spark, path, "datasets", CATALOG, multi_line).select(F.inline("datasets"))


def read_documents(
    spark: SparkSession,
    paths: str | list[str],
    array: str,
    row: T.StructType,
    multi_line: bool,
    corrupt: str | None = None,
) -> DataFrame:
    """JSON documents with one array field, read with a declared schema (nothing is inferred).

    ``corrupt`` names a column for the text of documents that do not parse.
    """
    schema = T.StructType([T.StructField(array, T.ArrayType(row))])
    reader = spark.read.option("multiLine", multi_line)
    if corrupt is not None:
        schema = schema.add(corrupt, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).json(paths)


def resolve_job(catalog: DataFrame, job: str) -> str:
    """The id of a release given its id or its name; an id match wins."""
    if catalog.filter(F.col("job_id") == job).take(1):
        return job
    named = catalog.filter(F.col("job_name") == job).select("job_id").collect()
    if len(named) == 1:
        return named[0]["job_id"]
    if named:
        raise ValueError(f"Ambiguous job name {job!r} matches several datasets: {sorted(r['job_id'] for r in named)}")
    raise ValueError(f"No dataset found matching {job!r}. list_datasets() shows the job ids and names.")


def resolve_all(catalog: DataFrame, jobs: list[str]) -> list[str]:
    """The ids of several releases, in the order given, looked up with one job."""
    job = T.StructType([T.StructField("job", T.StringType())])
    wanted = small_frame(catalog.sparkSession, [(j,) for j in dict.fromkeys(jobs)], job)
    # As many rows as names were given.
    ids = {r["job"]: r["job_id"] for r in resolve_jobs(catalog, wanted).collect()}
    return list(dict.fromkeys(ids[j] or resolve_job(catalog, j) for j in jobs))


def resolve_jobs(catalog: DataFrame, wanted: DataFrame, column: str = "job") -> DataFrame:
    """The set form: each wanted id or name with the id it stands for and how it was found.

    `found_by` is `id`, `name`, `ambiguous` or `none`; `job_id` is NULL for the last two.
    """
    releases = catalog.filter(F.col("job_id").isNotNull() & (F.col("job_id") != ""))
    by_id = releases.select(F.col("job_id").alias("__id")).distinct()
    by_name = (
        releases.groupBy(F.col("job_name").alias("__name"))
        .agg(F.count(F.lit(1)).alias("__n"), F.min("job_id").alias("__named_id"))
    )
    return (
        wanted.select(F.col(column).alias("job"))
        .distinct()
        .join(by_id, F.col("job") == F.col("__id"), "left")
        .join(by_name, F.col("job") == F.col("__name"), "left")
        .select(
            "job",
            F.coalesce("__id", F.when(F.col("__n") == 1, F.col("__named_id"))).alias("job_id"),
            F.when(F.col("__id").isNotNull(), "id")
            .when(F.col("__n") == 1, "name")
            .when(F.col("__n") > 1, "ambiguous")
            .otherwise("none")
            .alias("found_by"),
        )
    )


def select_releases(catalog: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Releases whose id or name is wanted, and the wanted names nothing matches."""
    spark = catalog.sparkSession
    chosen = catalog.filter(F.col("job_id").isin(*names) | F.col("job_name").isin(*names))
    job = T.StructType([T.StructField("job", T.StringType())])
    wanted = small_frame(spark, [(n,) for n in sorted(set(names))], job)
    known = chosen.select(F.explode(F.array("job_id", "job_name")).alias("job"))
    unknown = wanted.join(known, "job", "left_anti")
    # At most as many rows as names were given.
    return chosen, sorted(r["job"] for r in unknown.collect())


def select_wanted(catalog: DataFrame, wanted: DataFrame, column: str = "job") -> DataFrame:
    """The set form of `select_releases`: matching releases for a table of ids and names."""
    names = wanted.select(F.col(column).alias("__wanted")).distinct()
    either = F.col("job_id") == F.col("__wanted")
    return catalog.join(names, either, "left_semi").unionByName(
        catalog.join(names, either, "left_anti").join(names, F.col("job_name") == F.col("__wanted"), "left_semi")
    )


def resolve_dataset_url(catalog: DataFrame, job: str) -> str:
    """Where the matrix of a release is stored."""
    job_id = resolve_job(catalog, job)
    row = catalog.filter(F.col("job_id") == job_id).select("data_path").first()
    if row is None or not row["data_path"]:
        raise ValueError(f"No parquet URL recorded for job_id: {job_id!r}")
    return row["data_path"]


def catalog_stats(sequencing: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per release: matrix cells, metadata rows, and the cell lines and time points used."""
    cells = sequencing.groupBy("job_id").agg(F.count(F.lit(1)).alias("datapoint_count"))

    def values(column: str, name: str) -> DataFrame:
        used = conform_to(metadata, _USED).filter(F.col(column).isNotNull()).select("job_id", column).distinct()
        return used.groupBy("job_id").agg(F.sort_array(F.collect_list(column)).alias(name))

    none = F.array().cast("array<string>")
    facts = [
        metadata.groupBy("job_id").agg(F.count(F.lit(1)).alias("metadata_row_count")),
        cells,
        values("cell_line", "cell_lines"),
        values("timepoint", "timepoints"),
    ]
    return one_row_per_release(facts).select(
        "job_id",
        F.coalesce("datapoint_count", F.lit(0)).alias("datapoint_count"),
        F.coalesce("metadata_row_count", F.lit(0)).alias("metadata_row_count"),
        F.coalesce("cell_lines", none).alias("cell_lines"),
        F.coalesce("timepoints", none).alias("timepoints"),
    )
