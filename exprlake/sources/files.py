"""Releases stored as files: Parquet matrix, CSV sample metadata, JSON chemistry.

Reads are lazy, so a missing file would only show when a query runs.  Availability and
columns are therefore checked on the driver while the plan is built: paths, Parquet
footers and CSV header lines, never data rows.
"""

from __future__ import annotations

import logging
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import conform_to, quoted
from ..operators.matrix import gene_column, to_long
from ..operators.union import concat_metadata, empty_chemistry
from ..operators.validate import GENE_COLUMN_MISSING, LOAD_FAILED, SAMPLE_COLUMN_MISSING
from ..schemas import CHEMISTRY, PROBLEMS, SEQUENCING, SEQUENCING_ROWS
from ..session import small_frame
from .catalog import list_datasets, read_documents, resolve_all, resolve_dataset_url, resolve_job
from .wide import LONG_COLUMNS, Wide, look_at, read_wide, readable_by_arrow

logger = logging.getLogger(__name__)

# Driver threads that look at paths, footers and header lines of many releases.
LOOKUP_THREADS = 16

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}
# A file whose header is not the one its release was grouped by fails instead of being bound by position.
# A quoted value may hold line breaks, so a file is read by one task; large metadata is a folder of many files.
CSV_READ_OPTIONS = {**CSV_OPTIONS, "enforceSchema": "false", "multiLine": "true"}
PARTS = ("data_path", "metadata_path", "chemistry_path")


@dataclass(frozen=True)
class Entry:
    """One file or folder of one release, and when it was last changed."""

    job_id: str
    path: str
    is_folder: bool
    changed_at: int = 0


def find_path(spark: SparkSession, path: str) -> tuple[str, bool, int] | None:
    """The full path, whether it is a folder, and its time stamp; None if nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        status = system.getFileStatus(at)
    except Py4JJavaError as exc:
        if exc.java_exception.getClass().getSimpleName() == "FileNotFoundException":
            return None
        raise
    return status.getPath().toString(), status.isDirectory(), status.getModificationTime()


def plain_path(path: str) -> str:
    """`file:/x`, `file:///x` and `/x` are the same place."""
    return "/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path


def _file_path() -> Column:
    decoded = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    return F.regexp_replace(decoded, "^file:/+", "/")


def _release_of(df: DataFrame, entries: list[Entry]) -> DataFrame:
    """Add `__release`: the release whose file or folder a row's `__file` is."""
    spark = df.sparkSession
    found = []
    for folder, at in ((False, F.col("__file")), (True, F.regexp_replace("__file", "/[^/]*$", ""))):
        rows = [(plain_path(e.path), e.job_id) for e in entries if e.is_folder == folder]
        if rows:
            name = f"__release_{int(folder)}"
            owner = T.StructType([T.StructField("__path", T.StringType()), T.StructField(name, T.StringType())])
            owners = small_frame(spark, rows, owner)
            df = df.join(owners, at == F.col("__path"), "left").drop("__path")
            found.append(name)
    return df.withColumn("__release", F.coalesce(*found)).drop(*found)


# --- sample metadata -----------------------------------------------------------------


Header = tuple[str, ...]


def csv_header(spark: SparkSession, entry: Entry) -> Header:
    return tuple(spark.read.options(**CSV_OPTIONS, multiLine="true").csv(entry.path).columns)


def read_metadata(
    spark: SparkSession, entries: list[Entry], headers: list[Header], with_ordinal: bool = False
) -> DataFrame:
    """Sample metadata of all given releases.

    A CSV with a declared schema is bound by position, so files are grouped by their
    header line and read with one scan per distinct header; columns then meet by name.
    Everything is read as text first (`0012` stays `0012`), then cast.
    """
    by_header: dict[Header, list[Entry]] = defaultdict(list)
    for entry, header in zip(entries, headers):
        if header:
            by_header[header].append(entry)
    frames = []
    for header, group in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        rows = spark.read.schema(schema).options(**CSV_READ_OPTIONS).csv([e.path for e in group])
        place = [_file_path().alias("__file")]
        if with_ordinal:
            # File order: split start within the file, then row within the split.
            start = F.col("_metadata.file_block_start").alias("start")
            row = F.monotonically_increasing_id().alias("row")
            place.append(F.struct(_file_path().alias("file"), start, row).alias("ingest_ordinal"))
        rows = _release_of(rows.select(*[F.col(quoted(c)) for c in header], *place), group)
        job = F.coalesce(F.col("job_id"), F.col("__release")) if "job_id" in header else F.col("__release")
        frames.append(rows.withColumn("job_id", job).drop("__file", "__release"))
    return concat_metadata(spark, frames)


# --- chemistry -----------------------------------------------------------------------


def read_chemistry(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """Compounds of all given releases with their `job_id`.

    A single `.json` file is one document, which one task has to parse; a folder holds one
    document per line and is split, so it is the form for large libraries.
    """
    if not entries:
        return empty_chemistry(spark).withColumn("job_id", F.lit(None).cast("string"))
    frames = []
    for multi_line in (True, False):
        group = [e for e in entries if (not e.is_folder and e.path.endswith(".json")) == multi_line]
        if group:
            documents = read_documents(spark, [e.path for e in group], "compounds", CHEMISTRY, multi_line)
            rows = documents.select(_file_path().alias("__file"), F.inline("compounds"))
            frames.append(_release_of(rows, group).withColumnRenamed("__release", "job_id").drop("__file"))
    return reduce(DataFrame.unionByName, frames)


def broken_chemistry(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """(job_id, __file) of the documents that do not parse; they give no compounds."""
    frames = []
    for multi_line in (True, False):
        group = [e for e in entries if (not e.is_folder and e.path.endswith(".json")) == multi_line]
        if group:
            paths = [e.path for e in group]
            documents = read_documents(spark, paths, "compounds", CHEMISTRY, multi_line, corrupt="__broken")
            # Spark wants a parsed column looked at beside the one for broken records.
            broken = documents.filter(
                F.col("__broken").isNotNull() & (F.col("compounds").isNull() | (F.size("compounds") >= 0))
            )
            rows = _release_of(broken.select(_file_path().alias("__file")), group)
            frames.append(rows.select(F.col("__release").alias("job_id"), "__file"))
    return reduce(DataFrame.unionByName, frames)


# --- matrix --------------------------------------------------------------------------


# A footer's schema, or of a wide matrix that Arrow can read what there is to know.
Shape = T.StructType | Wide


def is_long(shape: Shape) -> bool:
    return not isinstance(shape, Wide) and LONG_COLUMNS <= set(shape.fieldNames())


def gene_column_problems(entries: list[Entry], shapes: list[Shape]) -> list[tuple[str, str]]:
    """(job, message) of the wide releases without a gene column."""
    problems = []
    for entry, shape in zip(entries, shapes):
        if isinstance(shape, Wide):
            if shape.problem is not None:
                problems.append((entry.job_id, shape.problem))
        elif not is_long(shape):
            try:
                gene_column(shape)
            except ValueError as exc:
                problems.append((entry.job_id, str(exc)))
    return problems


def shapes_ahead(spark: SparkSession, entries: list[Entry]) -> dict[Entry, tuple[object, str | None]]:
    """Shapes of all wide matrices that Arrow can read, looked at in one job; the others are left to Spark."""
    reachable = [e for e in entries if readable_by_arrow(e.path)]
    if not reachable:
        return {}
    seen = look_at(spark, [(e.path, e.is_folder) for e in reachable])
    return {e: (shape, None) for e, (shape, _) in zip(reachable, seen) if shape is not None}


def read_sequencing(
    spark: SparkSession,
    entries: list[Entry],
    schemas: list[Shape],
    keep_nulls: bool = True,
    with_rows: bool = False,
) -> DataFrame:
    """The long matrix of all given releases; those without a gene column are left out.

    Long releases in `job_id=...` folders of one store are a single scan with `job_id` as
    partition column.  Wide releases differ in their columns, so Spark could only scan them one by one;
    all of them together are one work list of Parquet parts (`wide.read_wide`), where Arrow can reach their files.
    ``with_rows`` adds `gene_row`, the ordinal of a cell's matrix row, NULL where the source has none.
    """
    target = SEQUENCING_ROWS if with_rows else SEQUENCING
    unusable = {job for job, _ in gene_column_problems(entries, schemas)}
    frames: list[DataFrame] = []
    stores: dict[str, list[str]] = defaultdict(list)
    listed: list[tuple[Entry, str]] = []
    for entry, schema in zip(entries, schemas):
        root, _, folder = entry.path.rstrip("/").rpartition("/")
        if entry.job_id in unusable:
            continue
        if is_long(schema) and unquote(folder) == f"job_id={entry.job_id}":
            stores[root].append(entry.path)
        elif is_long(schema):
            rows = spark.read.schema(schema).parquet(entry.path).withColumn("job_id", F.lit(entry.job_id))
            frames.append(conform_to(rows, target))
        elif isinstance(schema, Wide):
            listed.append((entry, schema.gene_column))
        else:
            wide = spark.read.schema(schema).parquet(entry.path)
            long = to_long(wide, gene_column(schema), job_id=entry.job_id, keep_nulls=keep_nulls, with_rows=with_rows)
            frames.append(conform_to(long, target))
    if listed:
        rows = read_wide(spark, [(e.job_id, e.path, e.is_folder, gene) for e, gene in listed], keep_nulls)
        frames.append(conform_to(rows, target))
    for root, paths in stores.items():
        rows = spark.read.schema(target).option("basePath", root).parquet(*paths)
        frames.append(conform_to(rows, target))
    if not frames:
        return spark.createDataFrame([], target)
    long = reduce(DataFrame.unionByName, frames)
    return long if keep_nulls else long.filter(F.col("value").isNotNull())


# --- the source ----------------------------------------------------------------------


class ReleaseFiles:
    """All releases of one JSON catalog.

    A part that is missing gives an empty table, a warning, and a row in `problems`; the
    rest of the query goes on.
    """

    def __init__(self, catalog_path: str):
        self.catalog_path = catalog_path
        self._catalog: DataFrame | None = None
        self._manifest: list[Row] | None = None
        self._looked_up: dict[tuple, object] = {}

    def catalog(self, spark: SparkSession) -> DataFrame:
        """The catalog, read once and kept until `refresh`."""
        if self._catalog is None:
            self._catalog = list_datasets(spark, self.catalog_path).cache()
        return self._catalog

    def refresh(self) -> None:
        if self._catalog is not None:
            self._catalog.unpersist()
        self._catalog = None
        self._manifest = None
        self._looked_up.clear()

    def resolve(self, spark: SparkSession, job: str) -> str:
        return resolve_job(self.catalog(spark), job)

    def resolve_all(self, spark: SparkSession, jobs: list[str]) -> list[str]:
        return resolve_all(self.catalog(spark), jobs)

    def is_empty(self, spark: SparkSession) -> bool:
        return not self._releases(spark)

    def metadata(
        self, spark: SparkSession, job_ids: list[str] | None = None, with_ordinal: bool = False
    ) -> DataFrame:
        present, headers, _ = self._headers(spark, job_ids)
        return read_metadata(spark, present, headers, with_ordinal)

    def chemistry(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        present, _ = self._entries(spark, "chemistry_path", job_ids)
        return read_chemistry(spark, present)

    def sequencing(
        self, spark: SparkSession, job_ids: list[str] | None = None, keep_nulls: bool = True, with_rows: bool = False
    ) -> DataFrame:
        present, schemas, _ = self._schemas(spark, job_ids)
        return read_sequencing(spark, present, schemas, keep_nulls, with_rows)

    def is_one_scan(self, spark: SparkSession) -> bool:
        """Whether the matrices of all releases are read by plans of one size, however many they are."""
        present, shapes, _ = self._schemas(spark, None)
        return all(is_long(s) or isinstance(s, Wide) for _, s in zip(present, shapes))

    def problems(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        """What keeps a release from being checked: matrix missing or unreadable, columns missing."""
        matrices, schemas, missing = self._schemas(spark, job_ids)
        samples, headers, _ = self._headers(spark, job_ids)
        rows = [(job, LOAD_FAILED, message) for job, message in missing]
        for job, message in gene_column_problems(matrices, schemas):
            rows.append((job, GENE_COLUMN_MISSING, message))
        for entry, header in zip(samples, headers):
            if header and "sequenced_id" not in header:
                rows.append((entry.job_id, SAMPLE_COLUMN_MISSING, f"columns are {list(header)[:5]}"))
        return small_frame(spark, rows, PROBLEMS)

    def source_errors(self, spark: SparkSession, job_ids: list[str] | None = None) -> DataFrame:
        """One row per part of a release that could not be found or read."""
        compounds, missing = self._entries(spark, "chemistry_path", job_ids)
        rows = [(job, "chemistry_path", message) for job, message in missing]
        rows += [(job, "data_path", message) for job, message in self._schemas(spark, job_ids)[2]]
        rows += [(job, "metadata_path", message) for job, message in self._headers(spark, job_ids)[2]]
        found = small_frame(spark, rows, PROBLEMS)
        if not compounds:
            return found
        # Documents are looked at where they lie: a broken one is known only once it is parsed.
        message = F.concat_ws(" ", F.col("__file"), F.lit("cannot be read: not the JSON it should be"))
        broken = broken_chemistry(spark, compounds).select("job_id", F.lit("chemistry_path"), message).distinct()
        return found.union(broken)

    def require(self, spark: SparkSession, job_ids: list[str]) -> None:
        """Raise unless every given release has its matrix."""
        missing = self._schemas(spark, job_ids)[2]
        if missing:
            raise ValueError(f"Dataset not found for job_id={missing[0][0]!r}: {missing[0][1]}")

    def load_dataset(self, spark: SparkSession, job: str) -> DataFrame:
        """The matrix of one release as it is stored, all genes kept."""
        # Files of a folder may differ in their columns.
        return spark.read.option("mergeSchema", "true").parquet(resolve_dataset_url(self.catalog(spark), job))

    def load_metadata(self, spark: SparkSession, job: str) -> DataFrame:
        return self.metadata(spark, [self.resolve(spark, job)])

    def load_chem(self, spark: SparkSession, job: str) -> DataFrame:
        return conform_to(self.chemistry(spark, [self.resolve(spark, job)]), CHEMISTRY)

    def _releases(self, spark: SparkSession) -> list[Row]:
        """Ids and paths of all releases.  A scan is built from its paths, so the driver has to
        know them; rows without an id are left out."""
        if self._manifest is None:
            listed = self.catalog(spark).filter(F.col("job_id").isNotNull() & (F.col("job_id") != ""))
            self._manifest = listed.select("job_id", *PARTS).orderBy("job_id").collect()
        return self._manifest

    def _headers(self, spark: SparkSession, job_ids: list[str] | None):
        return self._look_up(spark, "metadata_path", job_ids, lambda e: csv_header(spark, e))

    def _schemas(self, spark: SparkSession, job_ids: list[str] | None):
        def read(entry: Entry) -> T.StructType:
            return spark.read.parquet(entry.path).schema

        return self._look_up(spark, "data_path", job_ids, read, shapes_ahead)

    def _look_up(
        self, spark: SparkSession, part: str, job_ids: list[str] | None, read, ahead=lambda spark, entries: {}
    ) -> tuple[list[Entry], list, list[tuple[str, str]]]:
        """The readable files of one part, their headers or footers, and (job, message) for the others.

        A header or footer is read once for each state of its file; a failure is not remembered.  What
        ``ahead`` finds for many files at once is not read again.
        """
        present, missing = self._entries(spark, part, job_ids)
        new = [e for e in present if (part, e.path, e.changed_at) not in self._looked_up]
        failed: dict[Entry, str] = {}
        known_ahead = ahead(spark, new)
        seen = _map(lambda e: known_ahead.get(e) or _attempt(read, e), new)
        for entry, (found, error) in zip(new, seen):
            if error is None:
                self._looked_up[part, entry.path, entry.changed_at] = found
            else:
                failed[entry] = f"{entry.path} cannot be read: {error}"
                logger.warning("%s of %s is not available: %s", part, entry.job_id, failed[entry])
        readable = [e for e in present if e not in failed]
        known = [self._looked_up[part, e.path, e.changed_at] for e in readable]
        return readable, known, missing + [(e.job_id, message) for e, message in failed.items()]

    def _entries(
        self, spark: SparkSession, part: str, job_ids: list[str] | None
    ) -> tuple[list[Entry], list[tuple[str, str]]]:
        """The files of one part that exist, and (job, message) for the others."""
        wanted = None if job_ids is None else set(job_ids)
        rows = [r for r in self._releases(spark) if wanted is None or r["job_id"] in wanted]
        found = _map(lambda r: find_path(spark, r[part]) if r[part] else None, rows)
        present = [Entry(r["job_id"], *at) for r, at in zip(rows, found) if at]
        missing = [
            (r["job_id"], f"nothing at {r[part]}" if r[part] else "no path recorded")
            for r, at in zip(rows, found)
            if not at
        ]
        for job, message in missing:
            logger.warning("%s of %s is not available: %s", part, job, message)
        return present, missing


def _attempt(read, entry: Entry) -> tuple[object, str | None]:
    """What ``read`` finds, or the first line of why Spark could not read the file."""
    try:
        return read(entry), None
    except Py4JJavaError as exc:
        return None, str(exc.java_exception.getMessage()).strip().splitlines()[0]
    except PySparkException as exc:
        return None, str(exc).strip().splitlines()[0]


def _map(function, items: list) -> list:
    if len(items) < 2:
        return [function(i) for i in items]
    with ThreadPoolExecutor(min(LOOKUP_THREADS, len(items))) as pool:
        return list(pool.map(function, items))
