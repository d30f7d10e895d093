"""Expression-matrix operators.

All work on the long matrix (`job_id`, `gene_id`, `sequenced_id`, `value`), so releases
are combined by a union and any number of them is handled by one job.  `to_long`, `to_wide`
and `to_blocks` convert at the edges.  In the long matrix an unknown gene id is the empty text,
never NULL, so plain equality on the keys is right and keeps bucketed tables aligned.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import conform_to, is_numeric, quoted, sample_id
from ..functions.ranking import index_within
from ..schemas import SEQUENCING, SEQUENCING_ROWS
from ..session import materialize, measured_side

# Sizes at which the report on a combined wide matrix says "warn" and "fallback".
WARN_BYTES = 2 * 1024**3
LIMIT_BYTES = 8 * 1024**3
BYTES_PER_CELL = 8

# Samples side by side in a block of the wide matrix.
BLOCK_SAMPLES = 64
# Cells that one task puts into blocks: in a sparse matrix each may need a row of its own, as wide as a block.
BLOCK_CELLS = 250_000

NO_GENE_ID = ""


# --- gene column of a wide frame (schema only, no job) -------------------------------


def shared_gene_column(frames: list[DataFrame]) -> str:
    """The gene column of several wide frames: the one column name they all have.

    A single frame shares every column with itself, so there its type decides.
    """
    if not frames:
        raise ValueError("no releases given")
    if len(frames) == 1:
        return gene_column(frames[0].schema)
    shared = set.intersection(*[set(f.columns) for f in frames])
    if len(shared) != 1:
        raise ValueError(f"releases share {len(shared)} columns {sorted(shared)[:10]}; only the gene id may be shared")
    return shared.pop()


def gene_column(schema: T.StructType) -> str:
    """The gene column of one wide frame: its only text column, else the first non-numeric."""
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    if len(texts) == 1:
        return texts[0]
    others = [f.name for f in schema.fields if not is_numeric(f.dataType)]
    if not others:
        raise ValueError(f"all columns are numeric, none can hold gene ids: {schema.fieldNames()[:5]}")
    return others[0]


# --- wide <-> long -------------------------------------------------------------------


def known_gene(gene: Column) -> Column:
    return F.coalesce(gene.cast("string"), F.lit(NO_GENE_ID))


def to_long(
    wide: DataFrame,
    gene_col: str | None = None,
    samples: list[str] | None = None,
    job_id: str | None = None,
    keep_nulls: bool = True,
    with_rows: bool = False,
) -> DataFrame:
    """Turn a wide matrix long.  ``samples`` limits the Parquet columns that are read.

    ``with_rows`` adds `gene_row`, an ordinal of the row a cell comes from.

    One array of (name, value) pairs per gene row is exploded; on 1,000 columns this
    runs about four times faster than `unpivot`, which re-reads the row per column.
    """
    gene_col = gene_col or gene_column(wide.schema)
    if samples is None:
        samples = [c for c in wide.columns if c != gene_col]
    gene = known_gene(F.col(quoted(gene_col))).alias("gene_id")
    job = F.lit(job_id).cast("string").alias("job_id")
    row = [F.monotonically_increasing_id().alias("gene_row")] if with_rows else []
    if not samples:
        return conform_to(wide.select(job, gene, *row).limit(0), SEQUENCING_ROWS if with_rows else SEQUENCING)
    # Expression texts: a Column object per sample would take seconds on wide frames.
    names = "array(" + ", ".join(f"'{_escaped(s)}'" for s in samples) + ")"
    cells = F.arrays_zip(F.expr(names).alias("sequenced_id"), F.expr(_values(wide, samples)).alias("value"))
    if not keep_nulls:
        cells = F.filter(cells, lambda cell: cell["value"].isNotNull())
    long = wide.select(job, gene, *row, F.inline(cells).alias("sequenced_id", "value"))
    return long.select(*SEQUENCING_ROWS.fieldNames()) if with_rows else long


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _values(wide: DataFrame, samples: list[str]) -> str:
    """SQL for the array of a row's sample values, as doubles."""
    types = dict(wide.dtypes)
    values = [quoted(s) if types[s] == "double" else f"CAST({quoted(s)} AS DOUBLE)" for s in samples]
    return "array(" + ", ".join(values) + ")"


@dataclass(frozen=True)
class WideBlocks:
    """Genes x samples, cut into blocks of a fixed number of samples.

    ``cells`` has a row (`gene_id`, `block`, `c0`, `c1`, ...) where a gene has a cell in a block;
    ``samples`` says which sample (`job_id`, `sequenced_id`) a `block` holds at which `position`.
    """

    cells: DataFrame
    samples: DataFrame


def to_blocks(
    long: DataFrame,
    width: int = BLOCK_SAMPLES,
    fill_value: float | None = None,
    extra_genes: DataFrame | None = None,
) -> WideBlocks:
    """All samples of any number of releases side by side, in one shape whatever their number.

    Samples are numbered by (release, id) on the executors, now; the cells move in one shuffle,
    by gene and block.  Cells a release does not have are NULL unless ``fill_value`` is given.
    A gene that is repeated in a release has a row for each repetition, least values first;
    unknown genes of two releases are not the same gene.  ``extra_genes`` adds genes without any
    cell, with a NULL block.
    """
    owners = materialize(long.groupBy("job_id", "sequenced_id").agg(F.count(F.lit(1)).alias("__n")), "owners")
    n_cells = owners.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n")).first()["n"]
    numbered = index_within(
        owners.select(F.lit(0).alias("__all"), F.struct("job_id", "sequenced_id").alias("__sample")),
        "__all",
        "__sample",
        "__at",
    )
    samples = measured_side(
        numbered.select(
            F.expr(f"__at div {width}").alias("block"),
            (F.col("__at") % width).cast("int").alias("position"),
            "__sample.job_id",
            "__sample.sequenced_id",
        ),
        "sample-blocks",
    )
    here = samples.select("block", "position", F.col("job_id").alias("__job"), F.col("sequenced_id").alias("__id"))
    # A release without an id and a sample without one are places of their own.
    same = F.col("job_id").eqNullSafe(F.col("__job")) & F.col("sequenced_id").eqNullSafe(F.col("__id"))
    placed = long.join(here, same).select("gene_id", _unnamed_in(), "block", "position", "value")
    cells = _side_by_side(
        placed,
        ["gene_id", "__unnamed_in", "block"],
        "position",
        {f"c{i}": i for i in range(width)},
        # Cells of one task need no number of tasks.
        parts=n_cells // BLOCK_CELLS + 1 if n_cells >= BLOCK_CELLS else None,
    )
    return WideBlocks(_finished(cells, long, extra_genes, fill_value), samples)


def from_blocks(blocks: WideBlocks) -> DataFrame:
    """The long matrix of the cells that are not NULL."""
    slots = [c for c in blocks.cells.columns if c not in ("gene_id", "block")]
    values = F.posexplode(F.array(*slots)).alias("position", "value")
    cells = blocks.cells.select(known_gene(F.col("gene_id")).alias("gene_id"), "block", values)
    cells = cells.filter(F.col("value").isNotNull())
    return conform_to(cells.join(blocks.samples, ["block", "position"]), SEQUENCING)


def to_wide(
    long: DataFrame,
    samples: list[str],
    fill_value: float | None = None,
    extra_genes: DataFrame | None = None,
) -> DataFrame:
    """Genes x the given samples, one named column each.  `to_blocks` needs no names.

    The rules on absent cells, repeated and unknown genes are those of `to_blocks`.  Raises if
    one of the samples occurs in two releases, which takes a look at the ids of the cells.
    """
    twice = [c for c, n in Counter(samples).items() if n > 1]
    if twice:
        raise ValueError(f"samples are given more than once: {sorted(twice)[:5]}")
    chosen = long.filter(F.col("sequenced_id").isin(list(samples)))
    owners = chosen.select("job_id", "sequenced_id").distinct().groupBy("sequenced_id").agg(F.count(F.lit(1)).alias("n"))
    shared = [r["sequenced_id"] for r in owners.filter("n > 1").orderBy("sequenced_id").take(5)] if samples else []
    if shared:
        raise ValueError(f"sample ids occur in more than one release: {shared}")
    cells = _side_by_side(
        chosen.select("gene_id", _unnamed_in(), "sequenced_id", "value"),
        ["gene_id", "__unnamed_in"],
        "sequenced_id",
        {s: s for s in samples},
    )
    return _finished(cells, long, extra_genes, fill_value)


def sample_names(long: DataFrame) -> list[str]:
    """The samples of a release in order, for a frame or file that has to name them as its columns."""
    return [r[0] for r in long.select("sequenced_id").distinct().orderBy("sequenced_id").collect()]


def _unnamed_in() -> Column:
    """The release of an unknown gene: unknown genes of two releases are not the same gene."""
    return F.when(F.col("gene_id") == NO_GENE_ID, F.col("job_id")).alias("__unnamed_in")


def _side_by_side(
    cells: DataFrame, row: list[str], slot: str, columns: dict[str, object], parts: int | None = None
) -> DataFrame:
    """One row for each ``row`` key (and repetition), one column per slot; one shuffle.

    Cells move while they are long: pivoting in the map tasks first would send a full-width row
    per gene and task.  The window and the groups need no shuffle of their own, as they are finer
    than the keys the cells were dealt by.  A cell is written to its place once, whatever the number of columns.

    ``parts`` is the number of tasks: left to itself Spark counts the bytes of long cells, of which a sparse
    matrix makes rows many times wider.
    """
    repeated = Window.partitionBy(*row, slot).orderBy("value")
    dealt = cells.repartition(parts, *row) if parts else cells.repartition(*row)
    cells = dealt.withColumn("__repeat", F.row_number().over(repeated))
    grouped = cells.groupBy(*row, "__repeat")
    if columns:
        wide = grouped.pivot(slot, list(columns.values())).agg(F.first("value"))
    else:
        wide = grouped.agg(F.count(F.lit(1)))
    # Columns get plain names first, so that no sample can clash with a key.
    wide = wide.toDF(*row, "__repeat", *[f"__v{i}" for i in range(len(wide.columns) - len(row) - 1)])
    named = [F.col(f"__v{i}").alias(name) for i, name in enumerate(columns)]
    return wide.select(*[c for c in row if c != "__unnamed_in"], *named)


def _finished(
    wide: DataFrame, long: DataFrame, extra_genes: DataFrame | None, fill_value: float | None
) -> DataFrame:
    values = [c for c in wide.columns if c not in ("gene_id", "block")]
    if extra_genes is not None:
        missing = extra_genes.select("gene_id").distinct().join(long.select("gene_id"), "gene_id", "left_anti")
        wide = wide.unionByName(missing, allowMissingColumns=True)
    wide = wide.withColumn("gene_id", F.nullif("gene_id", F.lit(NO_GENE_ID)))
    return wide if fill_value is None or not values else wide.fillna(fill_value, subset=[quoted(c) for c in values])


def join_releases(frames: list[DataFrame], gene_col: str = "gene_id") -> DataFrame:
    """Full outer join of per-release frames on the gene; NULL genes match nothing."""
    if not frames:
        raise ValueError("no releases given")
    return reduce(lambda left, right: left.join(right, gene_col, "full"), frames)


# --- filters -------------------------------------------------------------------------


def distinct_sample_ids(df: DataFrame) -> DataFrame:
    """The set of sample ids in a query result, as text."""
    if "sequenced_id" not in df.columns:
        raise ValueError("the sample filter has to return a 'sequenced_id' column")
    return df.select(sample_id()).filter(F.col("sequenced_id").isNotNull()).distinct()


def keep_samples(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (matrix cells or samples) whose sample is in ``ids``."""
    return df.join(ids.select(sample_id()), "sequenced_id", "left_semi").select(*df.columns)


def _gene_keys(scope: str) -> list[str]:
    if scope == "release":
        return ["job_id", "gene_id"]
    if scope == "combined":
        return ["gene_id"]
    raise ValueError(f"scope is 'release' or 'combined', not {scope!r}")


def expressed_genes(long: DataFrame, scope: str = "release") -> DataFrame:
    """Genes with a value other than 0.  NaN counts as expressed, NULL does not.

    The test on the value is a plain filter, so Parquet skips all-zero row groups.
    """
    return long.filter(F.col("value") != 0).select(*_gene_keys(scope)).distinct()


def drop_unexpressed(long: DataFrame, scope: str = "release", genes: DataFrame | None = None) -> DataFrame:
    """All cells, zeros included, of the expressed genes.

    By default a gene is judged in each release on its own.  ``genes`` is the result of
    `expressed_genes` where it has been computed already.
    """
    genes = expressed_genes(long, scope) if genes is None else genes
    return long.join(genes, _gene_keys(scope), "left_semi").select(*long.columns)


def drop_unexpressed_wide(wide: DataFrame, gene_col: str | None = None) -> DataFrame:
    """The same rule on a wide frame; a frame without samples stays as it is."""
    gene_col = gene_col or gene_column(wide.schema)
    samples = [c for c in wide.columns if c != gene_col]
    if not samples:
        return wide
    return wide.filter(F.exists(F.expr(_values(wide, samples)), lambda v: v != 0))


# --- combine and size ----------------------------------------------------------------


def combine(*longs: DataFrame) -> DataFrame:
    """Stack long matrices: what a wide engine needs a full outer join on the gene for."""
    if not longs:
        raise ValueError("no releases given")
    return reduce(DataFrame.unionByName, [conform_to(d, SEQUENCING) for d in longs])


def gene_counts(long: DataFrame) -> DataFrame:
    """Genes of each release."""
    return long.select("job_id", "gene_id").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n_genes"))


def estimate_size(long: DataFrame) -> DataFrame:
    """Genes, samples and bytes of each release's wide matrix."""
    samples = (
        long.select("job_id", "sequenced_id").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("n_samples"))
    )
    return gene_counts(long).join(samples, "job_id").withColumn(
        "estimated_bytes", F.col("n_genes") * F.col("n_samples") * F.lit(BYTES_PER_CELL).cast("bigint")
    )


def size_guard(sizes: DataFrame, warn_bytes: int = WARN_BYTES, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """One row: the size of all releases together and how it ranks; nothing depends on it."""
    total = sizes.agg(
        F.count(F.lit(1)).alias("n_releases"),
        F.coalesce(F.sum("estimated_bytes"), F.lit(0)).cast("bigint").alias("estimated_bytes"),
    )
    return total.withColumn(
        "verdict",
        F.when(F.col("estimated_bytes") > limit_bytes, "fallback")
        .when(F.col("estimated_bytes") > warn_bytes, "warn")
        .otherwise("ok"),
    )
