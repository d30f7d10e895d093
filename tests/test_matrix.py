"""Expression-matrix operators and combining releases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import types as T

from exprlake import (
    ReleaseFrames,
    combine,
    drop_unexpressed,
    engine_session,
    estimate_size,
    expressed_genes,
    gene_column,
    join_releases,
    keep_samples,
    load_chem,
    load_dataset,
    load_experiments,
    load_metadata,
    shared_gene_column,
    to_long,
    to_blocks,
    to_wide,
)
from exprlake.schemas import CHEMISTRY_COLUMNS
from exprlake.operators.matrix import distinct_sample_ids, drop_unexpressed_wide, from_blocks, sample_names, size_guard

NAN = float("nan")

# r1: g_zero all 0, g_null all NULL, g_mixed 0 and NULL, g_nan a NaN, g_on expressed.
# r2: g_on only zeros, g_other expressed.
CELLS = [
    ("r1", "g_zero", "s1", 0), ("r1", "g_zero", "s2", 0),
    ("r1", "g_null", "s1", None), ("r1", "g_null", "s2", None),
    ("r1", "g_mixed", "s1", 0), ("r1", "g_mixed", "s2", None),
    ("r1", "g_nan", "s1", NAN), ("r1", "g_nan", "s2", 0),
    ("r1", "g_on", "s1", 0), ("r1", "g_on", "s2", 3),
    ("r2", "g_on", "t1", 0), ("r2", "g_other", "t1", -2),
]


class TestGeneColumn:
    def test_by_shared_name(self, spark):
        a = spark.createDataFrame([], "ensembl string, s1 double")
        b = spark.createDataFrame([], "s2 double, ensembl string")
        assert shared_gene_column([a, b]) == "ensembl"
        assert shared_gene_column([a]) == "ensembl"

    def test_by_shared_name_fails(self, spark):
        a = spark.createDataFrame([], "g string, s1 double")
        with pytest.raises(ValueError, match="share 2 columns"):
            shared_gene_column([a, a])
        with pytest.raises(ValueError, match="share 0 columns"):
            shared_gene_column([a, spark.createDataFrame([], "h string")])
        with pytest.raises(ValueError, match="no releases"):
            shared_gene_column([])

    def test_by_type(self, spark):
        def column(ddl):
            return gene_column(spark.createDataFrame([], ddl).schema)

        assert column("s1 double, gene string, s2 int") == "gene"
        assert column("s1 double, flag boolean, a string, b string") == "flag"
        with pytest.raises(ValueError, match="all columns are numeric"):
            column("s1 double, s2 int")


class TestWideLong:
    def test_round_trip_keeps_null_nan_and_case(self, spark):
        session = engine_session(spark)
        wide = session.createDataFrame(
            [("g1", 1.0, None, 0.0), ("g2", NAN, 2.0, 3.0)], "gene_id string, a1 double, A1 double, `x.y` double"
        )
        long = to_long(wide, job_id="r")
        assert long.count() == 6 and long.filter("value is null").count() == 1
        back = to_wide(long, sample_names(long))
        assert back.columns == ["gene_id", "A1", "a1", "x.y"]
        got = {r["gene_id"]: r.asDict() for r in back.collect()}
        assert got["g1"] == {"gene_id": "g1", "a1": 1.0, "A1": None, "x.y": 0.0}
        assert math.isnan(got["g2"]["a1"]) and got["g2"]["A1"] == 2.0

    def test_nulls_can_be_left_out(self, spark):
        wide = spark.createDataFrame([("g1", 1.0, None)], "gene_id string, a double, b double")
        assert to_long(wide, keep_nulls=False).count() == 1

    def test_chosen_samples_limit_the_scan(self, spark, tmp_path):
        path = str(tmp_path / "w")
        spark.createDataFrame([("g1", 1.0, 2.0, 3.0)], "gene_id string, a double, b double, c double").write.parquet(path)
        long = to_long(spark.read.parquet(path), samples=["b"])
        assert "ReadSchema: struct<gene_id:string,b:double>" in long._jdf.queryExecution().toString()
        assert [r["value"] for r in long.collect()] == [2.0]

    def test_names_with_quotes(self, spark):
        names = ["it's", "b\\s", 'say "x"', "tick`s", "a.b"]
        fields = [T.StructField("gene_id", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in names]
        wide = spark.createDataFrame([("g", 1.0, 2.0, 3.0, 4.0, 0.0)], T.StructType(fields))
        got = [(r["sequenced_id"], r["value"]) for r in to_long(wide).collect()]
        assert got == list(zip(names, [1.0, 2.0, 3.0, 4.0, 0.0]))
        assert drop_unexpressed_wide(wide).count() == 1

    def test_no_samples(self, spark):
        assert to_long(spark.createDataFrame([("g",)], "gene_id string")).count() == 0

    def test_integer_samples(self, spark):
        long = to_long(spark.createDataFrame([("g", 3)], "gene_id string, s int"))
        assert long.first()["value"] == 3.0

    def test_fill_value(self, long_of):
        long = long_of(("r1", "g1", "a", 1), ("r2", "g2", "b", 2))
        plain = {tuple(r) for r in to_wide(long, ["a", "b"]).select("gene_id", "a", "b").collect()}
        assert plain == {("g1", 1.0, None), ("g2", None, 2.0)}
        filled = {tuple(r) for r in to_wide(long, ["a", "b"], fill_value=0.0).select("gene_id", "a", "b").collect()}
        assert filled == {("g1", 1.0, 0.0), ("g2", 0.0, 2.0)}

    def test_explicit_samples(self, long_of):
        long = long_of(("r", "g1", "a", 1), ("r", "g1", "b", 2), ("r", "g2", "b", 3))
        wide = to_wide(long, ["b"])
        assert wide.columns == ["gene_id", "b"] and wide.count() == 2

    def test_no_cells(self, long_of):
        wide = to_wide(long_of(), [])
        assert wide.columns == ["gene_id"] and wide.count() == 0
        blocks = to_blocks(long_of(), width=2)
        assert blocks.cells.columns == ["gene_id", "block", "c0", "c1"]
        assert blocks.cells.count() == 0 and blocks.samples.count() == 0 and from_blocks(blocks).count() == 0

    def test_sample_in_two_releases_raises(self, long_of):
        with pytest.raises(ValueError, match=r"more than one release: \['a'\]"):
            to_wide(long_of(("r1", "g1", "a", 1), ("r2", "g2", "a", 2)), ["a"])
        with pytest.raises(ValueError, match="more than once"):
            to_wide(long_of(), ["a", "a"])

    def test_repeated_genes_keep_all_their_cells(self, long_of):
        cells = [("r", "g1", "a", 2), ("r", "g1", "a", 1), ("r", "g1", "b", 5), ("r", "", "a", 7), ("r", "", "a", 8)]
        wide = to_wide(long_of(*cells), ["a", "b"])
        assert sorted(map(tuple, wide.collect()), key=str) == sorted(
            [("g1", 1.0, 5.0), ("g1", 2.0, None), (None, 7.0, None), (None, 8.0, None)], key=str
        )

    def test_blocks_hold_all_samples_in_order(self, long_of, rows):
        cells = [(f"r{j}", f"g{i % 3}", f"s{i}", 10 * j + i) for j in range(2) for i in range(5)]
        blocks = to_blocks(long_of(*cells), width=4)
        assert blocks.cells.columns == ["gene_id", "block", "c0", "c1", "c2", "c3"]
        places = [(n // 4, n % 4, f"r{n // 5}", f"s{n % 5}") for n in range(10)]
        assert rows(blocks.samples, "block", "position", "job_id", "sequenced_id") == set(places)
        got = {(r["gene_id"], r["block"]): list(r)[2:] for r in blocks.cells.collect()}
        # The second block holds s4 of r0 and s0 to s2 of r1.
        assert got["g1", 1] == [4.0, None, 11.0, None] and got["g0", 1] == [None, 10.0, None, None]
        assert rows(from_blocks(blocks)) == {(j, g, s, float(v)) for j, g, s, v in cells}

    def test_blocks_of_samples_and_releases_without_an_id(self, spark):
        long = spark.createDataFrame(
            [("r", "g", None, 1.0), (None, "g", "a", 2.0), (None, "", "a", 3.0), ("r", "", "a", None)],
            "job_id string, gene_id string, sequenced_id string, value double",
        )
        blocks = to_blocks(long, width=2, fill_value=0.0)
        assert sorted(tuple(r) for r in blocks.samples.select("block", "position").collect()) == [(0, 0), (0, 1), (1, 0)]
        assert sum(v for r in blocks.cells.collect() for v in list(r)[2:]) == 6.0

    def test_unknown_genes_of_two_releases_stay_apart(self, spark):
        a = to_long(spark.createDataFrame([(None, 1.0)], "gene_id string, s double"), job_id="r1")
        b = to_long(spark.createDataFrame([(None, 2.0)], "gene_id string, t double"), job_id="r2")
        wide = to_wide(drop_unexpressed(combine(a, b)), ["s", "t"])
        assert {tuple(r) for r in wide.select("gene_id", "s", "t").collect()} == {(None, 1.0, None), (None, None, 2.0)}


class TestUnexpressed:
    def test_per_release(self, long_of, rows):
        kept = drop_unexpressed(long_of(*CELLS))
        assert rows(kept.select("job_id", "gene_id").distinct()) == {
            ("r1", "g_nan"),
            ("r1", "g_on"),
            ("r2", "g_other"),
        }
        # Zeros of an expressed gene stay.
        assert kept.count() == 5

    def test_combined(self, long_of, rows):
        kept = drop_unexpressed(long_of(*CELLS), scope="combined")
        assert ("r2", "g_on", "t1", 0.0) in rows(kept)
        with pytest.raises(ValueError, match="scope"):
            drop_unexpressed(long_of(*CELLS), scope="all")

    def test_wide_agrees_with_long(self, spark, long_of, rows):
        cells = [c for c in CELLS if c[0] == "r1"]
        wide = to_wide(long_of(*cells), ["s1", "s2"])
        by_wide = rows(drop_unexpressed_wide(wide), "gene_id")
        assert by_wide == rows(expressed_genes(long_of(*cells)), "gene_id") == {("g_nan",), ("g_on",)}
        only_genes = spark.createDataFrame([("g",)], "gene_id string")
        assert drop_unexpressed_wide(only_genes).count() == 1


def test_keep_samples_compares_text(spark, long_of):
    long = long_of(("r", "g", "12", 1), ("r", "g", "13", 2))
    ids = spark.createDataFrame([(12,)], "sequenced_id int")
    assert keep_samples(long, ids).count() == 1
    with pytest.raises(ValueError, match="sequenced_id"):
        distinct_sample_ids(long.select("gene_id"))


def test_join_releases(spark, rows):
    a = spark.createDataFrame([("g1", 1), ("g2", 2), (None, 9)], "gene_id string, a int")
    b = spark.createDataFrame([("g2", 3), ("g3", 4), (None, 8)], "gene_id string, b int")
    got = join_releases([a, b]).select("gene_id", "a", "b").collect()
    assert {tuple(r) for r in got} == {
        ("g1", 1, None), ("g2", 2, 3), ("g3", None, 4), (None, 9, None), (None, None, 8),
    }
    assert join_releases([a]).count() == 3
    with pytest.raises(ValueError):
        join_releases([])


def test_size(long_of, rows):
    sizes = estimate_size(long_of(*CELLS))
    assert rows(sizes) == {("r1", 5, 2, 80), ("r2", 2, 1, 16)}
    assert rows(size_guard(sizes)) == {(2, 96, "ok")}
    assert rows(size_guard(sizes, warn_bytes=50)) == {(2, 96, "warn")}
    assert rows(size_guard(sizes, warn_bytes=50, limit_bytes=90)) == {(2, 96, "fallback")}
    assert rows(size_guard(sizes.limit(0))) == {(0, 0, "ok")}


class TestLoadExperiments:
    @pytest.fixture()
    def source(self, spark, long_of):
        long = long_of(
            ("r1", "g1", "s1", 0), ("r1", "g1", "s2", 5), ("r1", "g2", "s1", 7), ("r1", "g2", "s2", 0),
            ("r2", "g1", "t1", 0), ("r2", "g3", "t1", 1), ("r3", "g9", "u1", 4),
        )
        metadata = [("s1", "r1", True), ("s2", "r1", False), ("t1", "r2", True), ("u1", "r3", False)]
        catalog = [("r1", "one"), ("r2", "two"), ("r3", "three")]
        # Built per session: SQL runs on a session of its own.
        cells = [tuple(r) for r in long.collect()]
        return ReleaseFrames(
            lambda s: s.createDataFrame(catalog, "job_id string, job_name string"),
            lambda s: s.createDataFrame(metadata, "sequenced_id string, job_id string, is_control boolean"),
            lambda s: s.createDataFrame([("r1", "c"), ("r3", "c")], "job_id string, compound string"),
            lambda s: s.createDataFrame(cells, long.schema),
        )

    def test_all_samples(self, spark, source, rows):
        got = load_experiments(spark, source, ["one", "r2"])
        assert got.job_ids == ["r1", "r2"]
        assert rows(got.data.select("job_id", "gene_id").distinct()) == {("r1", "g1"), ("r1", "g2"), ("r2", "g3")}
        assert got.metadata.count() == 3 and got.chemistry.count() == 1
        wide = got.to_wide(["s1", "s2", "t1"])
        # g1 is unexpressed in r2, so its cells there are NULL, not 0.
        assert got.release("r2").count() == 1
        assert rows(wide.select("gene_id", "s1", "s2", "t1")) == {
            ("g1", 0.0, 5.0, None), ("g2", 7.0, 0.0, None), ("g3", None, None, 1.0),
        }

    def test_samples_are_chosen_before_genes_are_judged(self, spark, source, rows):
        got = load_experiments(spark, source, ["one", "two"], sql="SELECT * FROM metadata WHERE is_control")
        assert rows(got.data) == {("r1", "g2", "s1", 7.0), ("r2", "g3", "t1", 1.0)}
        assert rows(got.metadata, "sequenced_id") == {("s1",), ("t1",)}
        assert got.chemistry.count() == 1

    def test_release_left_without_samples(self, spark, source, rows):
        got = load_experiments(spark, source, ["one", "three"], sql="SELECT * FROM metadata WHERE is_control")
        assert rows(got.to_wide(["s1"]), "gene_id") == {("g2",)}
        extra = got.to_wide(["s1"], include_empty_release_genes=True)
        assert rows(extra, "gene_id", "s1") == {("g2", 7.0), ("g9", None)}
        assert rows(got.to_blocks(include_empty_release_genes=True).cells, "gene_id", "block", "c0") == {
            ("g2", 0, 7.0), ("g9", None, None),
        }

    def test_filter_sees_all_releases_or_the_requested(self, spark, source, rows):
        first = "SELECT sequenced_id FROM metadata ORDER BY sequenced_id DESC LIMIT 1"
        assert load_experiments(spark, source, ["one"], sql=first).data.count() == 0
        got = load_experiments(spark, source, ["one"], sql=first, filter_scope="requested")
        assert rows(got.data) == {("r1", "g1", "s2", 5.0)}

    def test_chosen_samples_are_fixed_once(self, spark, source, rows):
        # Which sample a bare LIMIT returns is open, but metadata and matrix have to agree.
        got = load_experiments(spark, source, ["one"], sql="SELECT * FROM metadata WHERE job_id = 'r1' LIMIT 1")
        assert rows(got.data.select("sequenced_id").distinct()) == rows(got.metadata, "sequenced_id")

    def test_parts_of_one_release(self, spark, source, rows):
        assert rows(load_dataset(spark, source, "one"), "gene_id", "s1", "s2") == {("g1", 0.0, 5.0), ("g2", 7.0, 0.0)}
        assert rows(load_metadata(spark, source, "r2"), "sequenced_id") == {("t1",)}
        assert load_chem(spark, source, "two").count() == 0 and load_chem(spark, source, "one").columns == CHEMISTRY_COLUMNS

    def test_one_release_and_none(self, spark, source):
        assert load_experiments(spark, source, ["one"]).data.count() == 4
        with pytest.raises(ValueError, match="no releases"):
            load_experiments(spark, source, [])
        with pytest.raises(ValueError, match="No dataset found"):
            load_experiments(spark, source, ["one", "ten"])
        with pytest.raises(ValueError, match="filter_scope"):
            load_experiments(spark, source, ["one"], filter_scope="some")
        with pytest.raises(ValueError, match="sequenced_id"):
            load_experiments(spark, source, ["one"], sql="SELECT job_id FROM metadata")
