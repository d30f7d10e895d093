"""The ingested store: statistics kept up with loads, row groups skipped, wide releases in one stage."""

from __future__ import annotations

import collections
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from exprlake import fixtures as fx
from exprlake.operators import coverage as cv
from exprlake.operators import validate as vd
from exprlake.operators.layout import in_parts, interleaved, ranked_parts
from exprlake.plans.experiments import load_experiments
from exprlake.sources import wide
from exprlake.sources.frames import ReleaseFrames
from exprlake.sources.store import append, ingest, open_store, rebuild_statistics

from .compare import TESTDATA

SF = f"{TESTDATA}/sf0.01"
ROWS = "job_id string, gene_id string, sequenced_id string, value double, gene_row long"


def physical(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def frames(cells, metadata=None, catalog=None):
    metadata = metadata or (lambda s: s.createDataFrame([], "job_id string, sequenced_id string, cell_line string"))
    return ReleaseFrames(
        catalog or (lambda s: cells(s).select("job_id", F.col("job_id").alias("job_name")).distinct()),
        metadata,
        lambda s: s.createDataFrame([], "job_id string, compound string"),
        cells,
    )


class TestCoverage:
    def test_against_sets(self, spark):
        draw = random.Random(4)
        cells = [
            (draw.choice("ab"), draw.choice(["g1", "g2", None, "g3"]), draw.choice(["s1", "s2", None]), 1.0)
            for _ in range(300)
        ]
        df = spark.createDataFrame(cells, "job_id string, gene_id string, sequenced_id string, value double")
        covered = cv.coverage(df.repartition(5))
        for job in "ab":
            here = [(g, s) for j, g, s, _ in cells if j == job]
            row = cv.sample_counts(covered).filter(F.col("job_id") == job).first()
            assert row["datapoint_count"] == len(here)
            assert row["n_duplicate_cells"] == len(here) - len(set(here))
            assert row["n_samples"] == len({s for _, s in here})
            assert cv.row_counts(covered).filter(F.col("job_id") == job).first()["n_genes"] == len({g for g, _ in here})
        parts = [cv.coverage(df.filter(F.col("job_id") == job), cv.number_genes(df)) for job in "ab"]
        again = cv.merge(parts[0].unionByName(parts[1]).unionByName(cv.coverage(df.limit(0))))
        assert {tuple(r) for r in cv.estimate_size(again).collect()} == {tuple(r) for r in cv.estimate_size(covered).collect()}

    def test_genes_in_several_rows(self, spark):
        """Genes g1, g1, g2 and two samples: three rows, no duplicates; a sample in two columns is one."""
        sound = [("r", g, s, 1.0, row) for row, g in enumerate(["g1", "g1", "g2"]) for s in ("s1", "s2")]
        doubled = [("d", g, s, 1.0, row) for row, g in enumerate(["g1", "g2"]) for s in ("s1", "s1", "s2")]
        long = [("l", g, s, 1.0, None) for g in ("g1", "g2") for s in ("s1", "s2")]
        matrix = spark.createDataFrame(sound + doubled + long, ROWS)
        samples = spark.createDataFrame([(j, s) for j in "rdl" for s in ("s1", "s2")], "job_id string, sequenced_id string")
        catalog = spark.createDataFrame([(j, j) for j in "rdl"], "job_id string, job_name string")
        reports = {r["job_id"]: r for r in vd.release_report(catalog, matrix, samples).collect()}
        assert (reports["r"]["n_genes"], reports["r"]["issues"], reports["r"]["status"]) == (3, [], "OK")
        assert reports["d"]["issues"] == ["parquet has duplicate sample columns (2 duplicates)"]
        assert (reports["l"]["n_genes"], reports["l"]["status"]) == (2, "OK")

    def test_few_rows_are_shuffled(self, spark):
        """Shuffled rows are a small part of the cells, and no cell moves."""
        cells = spark.range(400_000).select(
            F.lit("r").alias("job_id"),
            (F.col("id") % 2000).cast("string").alias("gene_id"),
            F.expr("cast(id div 2000 as string)").alias("sequenced_id"),
            F.lit(1.0).alias("value"),
            (F.col("id") % 2000).alias("gene_row"),
        )
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            covered = cv.coverage(cells, spark.createDataFrame([], cv.GENE_ROWS))
            plan = covered._jdf.queryExecution().executedPlan()
            assert plan.execute().count() == 200
            assert 0 < written(plan) < 0.05 * 400_000
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")

    def test_a_sparse_matrix_costs_no_more_than_its_cells(self, spark):
        """Cells far apart in rank: a row each, and a few bytes, not a bitmap of kilobytes."""
        cells = spark.range(3000).select(
            F.lit("r").alias("job_id"),
            F.col("id").cast("string").alias("gene_id"),
            F.expr("cast(id % 1500 as string)").alias("sequenced_id"),
            F.lit(1.0).alias("value"),
            (F.col("id") * 100_000).alias("gene_row"),
        )
        covered = cv.coverage(cells, spark.createDataFrame([], cv.GENE_ROWS))
        stored = covered.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.max("n"), F.count("n")).first()
        assert stored[0] < 200 and stored[1] == 3000
        assert tuple(cv.sample_counts(covered).first()) == ("r", 1500, 3000, 0)
        assert tuple(cv.row_counts(covered).first()) == ("r", 3000)
        twice = cv.merge(covered.unionByName(covered))
        assert tuple(cv.sample_counts(twice).first()) == ("r", 1500, 6000, 3000)

    def test_an_empty_matrix(self, spark):
        none = spark.createDataFrame([], ROWS)
        assert cv.coverage(none).count() == 0 and cv.estimate_size(cv.coverage(none)).count() == 0


def nodes(plan):
    """A physical plan's nodes, without adaptive execution."""
    yield plan
    children = plan.children()
    for i in range(children.length()):
        yield from nodes(children.apply(i))


def metric(plan, kind: str, name: str, says: str = "") -> int:
    return sum(
        n.metrics().apply(name).value()
        for n in nodes(plan)
        if n.nodeName().startswith(kind) and says in n.toString() and n.metrics().contains(name)
    )


def written(plan) -> int:
    return metric(plan, "Exchange", "shuffleRecordsWritten")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return ingest(spark, fx.release_a(SF), str(tmp_path_factory.mktemp("store") / "s"), files=1500)


class TestPruning:
    def test_one_percent_of_the_samples(self, spark, store):
        """Neighbouring samples are read from a few row groups, found by statistics of the files."""
        total = store.sequencing(spark).count()
        ids = fx.metadata_a(spark, SF).select("sequenced_id").filter(F.col("sequenced_id").startswith("121"))
        assert 0.005 < ids.count() / fx.metadata_a(spark, SF).count() < 0.02
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            cells = store.sequencing_of(spark, ids)
            assert "GreaterThanOrEqual(sample_part" in physical(cells)
            plan = cells._jdf.queryExecution().executedPlan()
            found = plan.execute().count()
            read = metric(plan, "Scan parquet", "numOutputRows", "sample_part")
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        wanted = {r["sequenced_id"] for r in ids.collect()}
        assert found == store.sequencing(spark).filter(F.col("sequenced_id").isin(list(wanted))).count() > 0
        assert found <= read < 0.15 * total

    def test_one_gene(self, spark, store):
        """The layout keeps serving genes."""
        gene = store.sequencing(spark).agg(F.min("gene_id")).first()[0]
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            cells = store.sequencing(spark).filter(F.col("gene_id") == gene)
            plan = cells._jdf.queryExecution().executedPlan()
            assert plan.execute().count() > 0
            assert metric(plan, "Scan parquet", "numOutputRows") < 0.3 * store.sequencing(spark).count()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")

    def test_no_samples(self, spark, store):
        assert store.sequencing_of(spark, spark.createDataFrame([], "sequenced_id string")).count() == 0
        unknown = spark.createDataFrame([("no such sample",), (None,)], "sequenced_id string")
        assert store.sequencing_of(spark, unknown).count() == 0

    def test_combining(self, spark, store):
        source = fx.release_a(SF)
        sql = "SELECT * FROM metadata WHERE sequenced_id LIKE '121%' "
        got = load_experiments(spark, store, ["HIGH", "LOW"], sql).data
        want = load_experiments(spark, source, ["HIGH", "LOW"], sql).data
        assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

    @pytest.mark.parametrize("most", [1, 2, 16])
    def test_ranges_hold_all_parts(self, spark, most):
        for parts in ([], [5], [1, 2, 3, 9, 11, 200], list(range(0, 256, 2))):
            rows = spark.range(256).select(F.col("id").alias("sample_part"))
            found = {r[0] for r in rows.filter(in_parts(parts, most=most)).collect()}
            assert set(parts) <= found
            assert not parts or most < 16 or len(parts) > 16 or found == set(parts)

    def test_keys_of_a_group_do_not_meet_in_a_task(self, spark):
        keys = spark.range(2000).select(F.lit("r").alias("g"), F.col("id").cast("string").alias("k"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            parts = ranked_parts(keys, "g", "k", "part", 2)
            assert "Exchange hashpartitioning" not in physical(parts)
            assert {tuple(r) for r in parts.groupBy("part").count().collect()} == {(i, 500) for i in range(4)}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def test_curve(self, spark):
        row = spark.range(1).select(interleaved(F.lit(0b101), F.lit(0b011), 3).alias("z")).first()
        assert row["z"] == 0b100111


class TestStatistics:
    def test_loads_add_up(self, spark, tmp_path):
        first = lambda s: s.createDataFrame([("r", "g1", "s1", 1.0, None), ("r", "g2", "s1", 0.0, None)], ROWS)
        second = lambda s: s.createDataFrame(
            [("r", "g2", "s1", 5.0, None), ("r", "g0", "s2", 1.0, None), ("q", "g9", "s1", 1.0, 7), ("q", "g9", "s1", 1.0, 8)], ROWS
        )
        people = lambda *rows: lambda s: s.createDataFrame(rows, "job_id string, sequenced_id string, cell_line string")
        root = str(tmp_path / "s")
        ingest(spark, frames(first, people(("r", "s1", "A"))), root)
        store = append(spark, frames(second, people(("r", "s2", "B"), ("r", "s3", None), ("q", "s1", "A"))), root)
        for _ in range(2):
            assert {tuple(r) for r in store.sizes(spark).collect()} == {("r", 3, 2, 48), ("q", 2, 1, 16)}
            assert {tuple(r) for r in cv.duplicate_cells(store.coverage(spark)).collect()} == {("r", 1)}
            stats = {r["job_id"]: (r["datapoint_count"], r["metadata_row_count"], r["cell_lines"], r["timepoints"]) for r in store.stats(spark).collect()}
            assert stats == {"r": (4, 3, ["A", "B"], []), "q": (2, 1, ["A"], [])}
            assert store.catalog(spark).count() == 2
            assert store.sequencing(spark).columns == ["job_id", "gene_id", "sequenced_id", "value"]
            rebuild_statistics(spark, root)
            store = open_store(root)

    def test_plans_do_not_read_the_matrix(self, spark, store):
        for df in (store.sizes(spark), store.stats(spark)):
            text = physical(df)
            assert "/stats/" in text and "/matrix" not in text

    def test_equal_to_a_full_scan(self, spark, store):
        from exprlake.operators.matrix import estimate_size

        want = {tuple(r) for r in estimate_size(fx.sequencing_a(spark, SF)).collect()}
        assert {tuple(r) for r in store.sizes(spark).collect()} == want


class TestWide:
    def write(self, folder, name, columns, row_group_size=None):
        pq.write_table(pa.table(columns), str(folder / name), row_group_size=row_group_size)

    def test_any_number_of_releases_is_one_stage(self, spark, tmp_path, monkeypatch):
        monkeypatch.setattr(wide, "PART_CELLS", 6)
        monkeypatch.setattr(wide, "BATCH_CELLS", 4)
        draw, listed, want = random.Random(1), [], collections.Counter()
        for r in range(12):
            genes = [draw.choice(["g1", "g2", "g3", None]) for _ in range(draw.randrange(8))]
            columns = {f"s{r}.{i}": [draw.choice([None, 0.0, 1.5, float(i)]) for _ in genes] for i in range(draw.randrange(5))}
            columns["whole"] = pa.array([7] * len(genes), pa.int32())
            self.write(tmp_path, f"{r}.parquet", {**columns, "name": pa.array(genes, pa.string())}, 3)
            listed.append((f"r{r}", str(tmp_path / f"{r}.parquet"), False, "name"))
            for row, gene in enumerate(genes):
                for sample, values in columns.items():
                    value = 7.0 if sample == "whole" else values[row]
                    want[f"r{r}", gene or "", sample, value, row] += 1
        cells = wide.read_wide(spark, listed)
        assert collections.Counter(tuple(r) for r in cells.collect()) == want
        assert wide.read_wide(spark, listed, keep_nulls=False).count() == sum(k[3] is not None for k in want)
        size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
        assert size(cells) == size(wide.read_wide(spark, listed[:1])) == 2 and "FileScan" not in physical(cells)

    def test_files_of_a_folder(self, spark, tmp_path):
        folder = tmp_path / "r"
        folder.mkdir()
        self.write(folder, "a.parquet", {"gene": ["g1", "g1"], "s1": [1.0, 2.0]})
        self.write(folder, "b.parquet", {"gene": ["g2"], "s2": [3.0]})
        self.write(folder, "_hidden.parquet", {"gene": ["g3"], "s9": [3.0]})
        rows = wide.read_wide(spark, [("r", str(folder), True, "gene")]).collect()
        assert {(r["gene_id"], r["sequenced_id"], r["value"]) for r in rows} == {
            ("g1", "s1", 1.0), ("g1", "s1", 2.0), ("g2", "s2", 3.0)
        }
        assert len({r["gene_row"] for r in rows}) == 3

    def test_footers_of_one_folder_are_shared_by_tasks(self, spark, tmp_path):
        folder = tmp_path / "r"
        folder.mkdir()
        for i in range(40):
            self.write(folder, f"{i:02d}.parquet", {"gene": [f"g{i}"], "s": [float(i)]})
        listed = [("r", str(folder), True, "gene")]
        tasks = wide.list_parts(spark, listed).groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1 and max(r["count"] for r in tasks) < 40 == sum(r["count"] for r in tasks)
        rows = wide.read_wide(spark, listed).collect()
        want = {("r", f"g{i}", "s", float(i), i * wide.ROWS_PER_FILE) for i in range(40)}
        assert {tuple(r) for r in rows} == want and len(rows) == 40

    def test_shapes_are_looked_at_in_one_job(self, spark, tmp_path):
        self.write(tmp_path, "wide.parquet", {"gene": ["g"], "s": [1.0]})
        self.write(tmp_path, "numbers.parquet", {"s": [1.0], "t": [2]})
        self.write(tmp_path, "long.parquet", {"gene_id": ["g"], "sequenced_id": ["s"], "value": [1.0]})
        (tmp_path / "broken.parquet").write_text("no parquet")
        paths = [(str(tmp_path / f"{n}.parquet"), False) for n in ("wide", "numbers", "long", "broken")]
        found = wide.look_at(spark, paths)
        assert found[0] == (wide.Wide("gene"), None)
        assert found[1][0].gene_column is None and "numeric" in found[1][0].problem
        assert found[2] == (None, None)
        assert found[3][0] is None and found[3][1]

    @pytest.mark.parametrize("places, at_a_time", [(4, 3), (40, 7), (4_000_000, 200_000)])
    def test_written_by_places(self, spark, tmp_path, monkeypatch, places, at_a_time):
        """Releases there and back: repeated and unknown genes, NaN and NULL; any size of files."""
        monkeypatch.setattr(wide, "FILE_PLACES", places)
        monkeypatch.setattr(wide, "FILE_CELLS", at_a_time)
        draw = random.Random(places)
        cells = [
            (draw.choice("ab"), draw.choice(["g1", "g2", "g3", "g10", ""]), f"s{draw.randrange(6)}", draw.choice([0.0, 1.5, float("nan")]))
            for _ in range(90)
        ]
        df = spark.createDataFrame([*cells, ("a", "g1", "s0", None)], "job_id string, gene_id string, sequenced_id string, value double")
        wide.write_wide_parts(df, str(tmp_path))
        listed = [(job, str(tmp_path / job), True, "gene_id") for job in "ab"]
        rows = wide.read_wide(spark, listed, keep_nulls=False).collect()
        assert collections.Counter(str(tuple(r)[:4]) for r in rows) == collections.Counter(str(c) for c in cells)
        again = collections.Counter((r["job_id"], r["gene_row"], r["sequenced_id"]) for r in rows)
        assert set(again.values()) == {1}

    def test_a_sparse_matrix_is_not_written_in_full(self, spark, tmp_path, monkeypatch):
        """Genes of groups of samples that share none: places grow with the cells, not with genes times samples."""
        monkeypatch.setattr(wide, "FILE_PLACES", 1000)
        cells = spark.range(4000).select(
            F.lit("r").alias("job_id"),
            F.expr("concat('g', lpad(id div 4, 5, '0'))").alias("gene_id"),
            F.expr("concat('s', (id div 400) * 4 + id % 4)").alias("sequenced_id"),
            F.lit(1.0).alias("value"),
        )
        wide.write_wide_parts(cells, str(tmp_path))
        files = [pq.ParquetFile(f).metadata for f in (tmp_path / "r").glob("part-*.parquet")]
        assert sum(m.num_rows for m in files) == 1000
        assert sum(m.num_rows * (m.num_columns - 1) for m in files) < 4 * 4000 < 1000 * 40
        assert not list((tmp_path / "r").glob("_*"))

    def test_schemes(self):
        assert wide.readable_by_arrow("/a/b") and wide.readable_by_arrow("file:///a") and wide.readable_by_arrow("s3://b/c")
        assert not wide.readable_by_arrow("viewfs://in/x")


def test_temporary_tables(spark):
    """Tables written inside are gone afterwards, but those that outlive it."""
    from exprlake.session import materialize, temporary_tables

    with temporary_tables(spark):
        short = materialize(spark.range(3), "t")
        long = materialize(short.filter("id > 0"), "t", outlives=True)
        with temporary_tables(spark):
            inner = materialize(spark.range(2), "t")
        assert short.count() == 3
    after = materialize(spark.range(4), "t")
    assert long.count() == 2 and after.count() == 4
    for gone in (short, inner):
        with pytest.raises(Exception, match="(?i)not.?found|does not exist|not_exist"):
            gone.collect()
