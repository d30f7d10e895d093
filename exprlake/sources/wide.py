"""Wide releases, any number of them, in one stage.

Every wide matrix has columns of its own, so a Spark scan can hold one release alone: ten thousand releases would
be ten thousand nodes of a plan.  Here the releases are rows of a work list instead.  One stage looks at the
Parquet footers and cuts each file into parts (a row group and a range of its columns); after these parts are
dealt out evenly, a second stage reads each part and hands its cells out long.  A release may be a folder of very
many files, so several tasks share its footers.  The plan is the same for one release and for ten thousand, and the
driver sees paths only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matrix import NO_GENE_ID, gene_column
from ..schemas import SEQUENCING_ROWS
from ..session import small_frame

LONG_COLUMNS = {"gene_id", "sequenced_id", "value"}

# Cells of one part, and of one batch that a task hands out.
PART_CELLS = 2_000_000
BATCH_CELLS = 200_000
# Places (gene rows times samples) of one file of a sparse matrix, and cells that a task deals with at a time.
FILE_PLACES = 4_000_000
FILE_CELLS = 200_000
# Rows of one file are numbered from the number of the file times this.
ROWS_PER_FILE = 1 << 40

_LISTED = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("is_folder", T.BooleanType()),
        T.StructField("gene_column", T.StringType()),
    ]
)
_PARTS = (
    "job_id string, path string, gene_column string, row_group int, first_row long, n_rows long, columns array<string>"
)


def _open(path: str):
    """The file system of a path and the path within it."""
    from pyarrow import fs

    path = "s3" + path[3:] if path.startswith("s3a:") else path
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def readable_by_arrow(path: str) -> bool:
    """Whether tasks may open the file without Spark: a local or shared folder, or storage that Arrow knows."""
    scheme = path.split("/", 1)[0]
    return ":" not in scheme or scheme in ("file:", "s3:", "s3a:", "gs:", "abfs:", "abfss:", "hdfs:")


def read_wide(
    spark: SparkSession, releases: list[tuple[str, str, bool, str]], keep_nulls: bool = True
) -> DataFrame:
    """SEQUENCING_ROWS of all given wide releases (job_id, path, is_folder, gene column).

    `gene_row` numbers the rows of a release by file and place, so repeated genes stay apart.  All columns
    but the gene's are samples and have to be numeric.  A release is a file or a folder of files, which may
    differ in their columns; files whose names start with `_` or `.` are not part of it.
    """
    # Parts of one file are dealt over all tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = list_parts(spark, releases).repartition(tasks, F.xxhash64("path", "row_group", F.element_at("columns", 1)))
    cells = dealt.mapInArrow(_reader(keep_nulls), SEQUENCING_ROWS)
    return cells


def list_parts(spark: SparkSession, releases: list[tuple[str, str, bool, str]]) -> DataFrame:
    """The parts of all given releases, from the footers of their files."""
    listed = small_frame(spark, releases, _LISTED)
    # A footer is a small read that waits for storage, and takes its time where a file has many columns.  Where there
    # are more tasks than releases, each lists a folder and takes its share of the files.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.when(F.col("is_folder"), max(1, tasks // max(1, len(releases)))).otherwise(1)
    shared = listed.withColumn("shares", shares).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return shared.repartition(tasks, "path", "share").mapInArrow(_list_parts, _PARTS)


@dataclass(frozen=True)
class Wide:
    """What a source has to know of a wide matrix: its gene column, or why there is none."""

    gene_column: str | None
    problem: str | None = None


def look_at(spark: SparkSession, entries: list[tuple[str, bool]]) -> list[tuple[Wide | None, str | None]]:
    """For each (path, is_folder), in one job: what is wide there, None for a long matrix, or why it cannot be read.

    Column names stay on the executors; a release sends one row, however many samples it has.
    """
    rows = [(i, path, is_folder, None) for i, (path, is_folder) in enumerate(entries)]
    listed = small_frame(spark, rows, T.StructType([T.StructField("at", T.LongType()), *_LISTED.fields[1:]]))
    tasks = min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen = listed.repartition(max(1, tasks), "path").mapInArrow(
        _look, "at long, gene_column string, problem string, error string, is_long boolean"
    )
    found = {r["at"]: r for r in seen.collect()}
    out = []
    for i in range(len(entries)):
        r = found[i]
        out.append((None if r["is_long"] or r["error"] else Wide(r["gene_column"], r["problem"]), r["error"]))
    return out


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    for batch in batches:
        rows = []
        for at, path, is_folder, _ in zip(*(c.to_pylist() for c in batch.columns)):
            gene = problem = error = None
            is_long = False
            try:
                system, inside = _open(path)
                files = _files(system, inside, is_folder)
                if not files:
                    raise OSError("no files")
                schema = pq.read_schema(system.open_input_file(files[0]))
                is_long = LONG_COLUMNS <= set(schema.names)
                if not is_long:
                    try:
                        gene = gene_column(from_arrow_schema(schema))
                    except ValueError as exc:
                        problem = str(exc)
            except (OSError, pa.ArrowException) as exc:
                error = str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__
            rows.append((at, gene, problem, error, is_long))
        columns = list(zip(*rows)) if rows else [()] * 5
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        names = ["at", "gene_column", "problem", "error", "is_long"]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _files(system, inside: str, is_folder: bool) -> list[str]:
    from pyarrow import fs

    if not is_folder:
        return [inside]
    found = system.get_file_info(fs.FileSelector(inside, recursive=False))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")


def _list_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for batch in batches:
        for job, path, is_folder, gene, shares, share in zip(*(c.to_pylist() for c in batch.columns)):
            system, inside = _open(path)
            files = _files(system, inside, is_folder)
            for number in range(share, len(files), shares):
                rows = []
                with pq.ParquetFile(system.open_input_file(files[number])) as opened:
                    meta = opened.metadata
                    samples = [c for c in opened.schema_arrow.names if c != gene]
                    first = number * ROWS_PER_FILE
                    at = path.rstrip("/") + "/" + files[number].rsplit("/", 1)[1] if is_folder else path
                    for group in range(meta.num_row_groups):
                        n = meta.row_group(group).num_rows
                        width = max(1, PART_CELLS // max(n, 1))
                        # A file without samples has no cells.
                        for i in range(0, len(samples), width):
                            rows.append((job, at, gene, group, first, n, samples[i : i + width]))
                        first += n
                columns = list(zip(*rows)) if rows else [()] * 7
                types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())]
                names = ["job_id", "path", "gene_column", "row_group", "first_row", "n_rows", "columns"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _reader(keep_nulls: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for batch in batches:
            for part in batch.to_pylist():
                system, inside = _open(part["path"])
                names, gene = part["columns"], part["gene_column"]
                with pq.ParquetFile(system.open_input_file(inside)) as opened:
                    table = opened.read_row_group(part["row_group"], columns=[gene, *names])
                genes = pc.fill_null(pc.cast(table[gene], pa.string()), NO_GENE_ID).combine_chunks()
                n = table.num_rows
                # Places of a part lie column by column, as many columns at a time as may come out as one batch.
                wide = max(1, BATCH_CELLS // max(n, 1)) if keep_nulls else max(1, len(names))
                for i in range(0, len(names), wide):
                    some = names[i : i + wide]
                    columns = [table[c] for c in some]
                    columns = [c if c.type == pa.float64() else pc.cast(c, pa.float64()) for c in columns]
                    value = pa.concat_arrays([chunk for c in columns for chunk in c.chunks]) if n else pa.array([], pa.float64())
                    # Rows that have a cell: a sparse matrix is mostly without.
                    if keep_nulls or not value.null_count:
                        at = np.arange(len(value))
                    else:
                        at = np.flatnonzero(value.is_valid().to_numpy(zero_copy_only=False))
                        value = value.drop_null()
                    for j in range(0, len(at), BATCH_CELLS):
                        of, place = np.divmod(at[j : j + BATCH_CELLS], n)
                        names_of = pa.DictionaryArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(some, pa.string()))
                        data = [
                            pa.repeat(pa.scalar(part["job_id"], pa.string()), len(place)),
                            genes.take(pa.array(place)),
                            names_of.cast(pa.string()),
                            value.slice(j, len(place)),
                            pa.array(part["first_row"] + place),
                        ]
                        yield pa.record_batch(data, names=SEQUENCING_ROWS.fieldNames())

    return read


def write_wide_parts(sequencing: DataFrame, path: str) -> None:
    """Every release of a long matrix as a folder ``path``/job_id of wide files, all of them in one job.

    A file holds whole gene rows, and columns for the samples that have a cell in them, so what is written grows
    with the cells of a matrix and not with its genes times its samples.  Repeated genes have a row for each
    repetition, least values first; an unknown gene is NULL.  ``path`` has to be one that tasks may write to.
    """
    if not readable_by_arrow(path):
        raise ValueError(f"tasks cannot write to {path} without Spark")
    cells = sequencing.select(
        F.col("job_id").cast("string"),
        F.coalesce(F.col("gene_id").cast("string"), F.lit(NO_GENE_ID)).alias("gene_id"),
        F.col("sequenced_id").cast("string"),
        F.col("value").cast("double"),
    ).filter("job_id IS NOT NULL AND sequenced_id IS NOT NULL")
    ranged = cells.repartitionByRange(sequencing.count() // FILE_CELLS + 1, "job_id", "gene_id")
    # Genes only have to be whole here, and a number tells them apart sooner than texts that begin alike.
    keys = [F.xxhash64("job_id", "gene_id"), "job_id", "gene_id"]
    done = ranged.sortWithinPartitions(*keys).mapInArrow(_writer(path), "path string")
    done.agg(F.count(F.lit(1))).collect()


def _one_chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        number = 0

        def put(cells: pa.Table) -> Iterator[str]:
            """Files of the cells of whole genes of one release, in the order of the genes."""
            genes, samples = (_one_chunk(cells[c]).dictionary_encode() for c in ("gene_id", "sequenced_id"))
            gene, sample = (a.indices.to_numpy(zero_copy_only=False).astype(np.int64) for a in (genes, samples))
            by_name = pc.array_sort_indices(genes.dictionary)
            rank = np.empty(len(by_name), np.int64)
            rank[by_name.to_numpy()] = np.arange(len(by_name))
            value = _one_chunk(cells["value"])
            absent = value.is_null().to_numpy(zero_copy_only=False)
            value = value.fill_null(0.0).to_numpy(zero_copy_only=False)
            order = np.lexsort((value, ~absent, sample, rank[gene]))
            gene, sample, value, absent = rank[gene][order], sample[order], value[order], absent[order]
            # The cells are in order: equal ones follow each other, and a place is how far one is from the first.
            new = np.r_[True, (gene[1:] != gene[:-1]) | (sample[1:] != sample[:-1])]
            at = np.arange(len(gene))
            again = at - np.maximum.accumulate(np.where(new, at, 0))
            starts = np.r_[np.flatnonzero(np.r_[True, gene[1:] != gene[:-1]]), len(gene)]
            # A gene has a row for each repetition, and follows the genes before it.
            n_rows = np.maximum.reduceat(again, starts[:-1]) + 1
            job, known, all_names = cells["job_id"][0].as_py(), genes.dictionary.take(by_name), samples.dictionary
            todo = [(0, len(n_rows))]
            while todo:
                low, high = todo.pop()
                a, b = int(starts[low]), int(starts[high])
                held = np.flatnonzero(np.bincount(sample[a:b], minlength=len(all_names)))
                size = int(n_rows[low:high].sum())
                if size * len(held) > FILE_PLACES and high - low > 1:
                    middle = int(np.searchsorted(starts, (a + b) // 2).clip(low + 1, high - 1))
                    todo += [(middle, high), (low, middle)]
                    continue
                first = np.cumsum(n_rows[low:high]) - n_rows[low:high]
                # Genes are numbered in their order, so those of a stretch follow each other too.
                row = first[gene[a:b] - low] + again[a:b]
                place = np.searchsorted(held, sample[a:b]) * size + row
                places, empty = np.zeros(len(held) * size), np.ones(len(held) * size, bool)
                places[place], empty[place] = value[a:b], absent[a:b]
                ids = known.take(pa.array(np.repeat(np.arange(low, high), n_rows[low:high])))
                yield _file(job, ids, all_names.take(pa.array(held)), pa.array(places, mask=empty), size)

        def _file(job: str, ids: pa.Array, samples: pa.Array, places: pa.Array, size: int) -> str:
            """A file of ``size`` gene rows and the given samples, whose columns follow each other in ``places``."""
            nonlocal number
            known = pc.if_else(pc.equal(ids, NO_GENE_ID), pa.scalar(None, pa.string()), ids)
            names = samples.to_pylist()
            if "gene_id" in names:
                raise ValueError("a sample is named gene_id, like the column of the genes")
            columns = [known, *[places.slice(i * size, size) for i in range(len(names))]]
            system, inside = _open(f"{root.rstrip('/')}/{job}")
            system.create_dir(inside, recursive=True)
            name = f"part-{task:06d}-{number:06d}.parquet"
            number += 1
            # A task that is run again puts the same file in the place of the first.
            with system.open_output_stream(f"{inside}/_{attempt}-{name}") as out:
                pq.write_table(
                    pa.table(columns, names=["gene_id", *names]), out, use_dictionary=["gene_id"], write_statistics=False
                )
            system.move(f"{inside}/_{attempt}-{name}", f"{inside}/{name}")
            return f"{inside}/{name}"

        def runs(table: pa.Table) -> Iterator[pa.Table]:
            """The cells of one release after the other."""
            jobs = pc.unique(table["job_id"])
            for job in jobs:
                yield table if len(jobs) == 1 else table.filter(pc.equal(table["job_id"], job))

        held: list[pa.RecordBatch] = []
        n = 0

        def flush(last: bool) -> Iterator[str]:
            nonlocal held, n
            table = pa.Table.from_batches(held)
            whole = table.num_rows
            if not last:  # cells of the last gene may follow
                same = pc.and_(*[pc.equal(table[c], table[c][-1]) for c in ("job_id", "gene_id")])
                whole = pc.index(same, True).as_py()
            for run in runs(table.slice(0, whole)) if whole else ():
                yield from put(run)
            held = table.slice(whole).to_batches()
            n = table.num_rows - whole

        names: list[str] = []
        full = FILE_CELLS
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= full:
                names += flush(False)
                full = max(FILE_CELLS, 2 * n)  # a gene of very many cells is not looked at again and again
        if n:
            names += flush(True)
        yield pa.record_batch([pa.array(names, pa.string())], names=["path"])

    return write
