"""Release validation and the samples x genes export."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from exprlake import (
    ReleaseFrames,
    export_samples_by_genes,
    obs_table,
    release_report,
    sample_vectors,
    summarize,
    validate_releases,
    var_table,
)
from exprlake.functions.columns import folder_value
from exprlake.functions.ranking import index_within
from exprlake.operators.export import sample_cells
from exprlake.operators.validate import reconcile, validate_counts
from exprlake.schemas import PROBLEMS, REPORT

CATALOG = [("ok", "fine"), ("warn", "w"), ("dup", "d"), ("apart", "a"), ("nomatrix", "m"), ("nometa", "n")]


@pytest.fixture()
def parts(spark, long_of):
    cells = [("ok", "g1", "s1", 1), ("ok", "g2", "s1", 0), ("apart", "g1", "x", 1), ("nometa", "g1", "y", 1)]
    cells += [("warn", "g1", f"m{i}", 1) for i in range(7)] + [("warn", "g1", "both", 1)]
    cells += [("dup", "g1", "s", 1), ("dup", "g1", "s", 2), ("dup", "g2", "s", 2)]
    samples = [("ok", "s1"), ("ok", None), ("warn", "both"), ("warn", "z1"), ("dup", "s"), ("dup", "s"), ("dup", "s")]
    samples += [("apart", "q"), ("nomatrix", "p")]
    return (
        spark.createDataFrame(CATALOG, "job_id string, job_name string"),
        long_of(*cells),
        spark.createDataFrame(samples, "job_id string, sequenced_id string"),
    )


@pytest.fixture()
def reports(parts):
    return {r["job_id"]: r for r in release_report(*parts).collect()}


class TestReport:
    def test_schema(self, parts):
        assert release_report(*parts).columns == REPORT.fieldNames()

    def test_sound_release(self, reports):
        r = reports["ok"]
        assert (r["n_genes"], r["n_samples_metadata"], r["n_samples_parquet"], r["n_samples_intersection"]) == (2, 1, 1, 1)
        assert r["issues"] == [] and r["fatal"] is None and r["status"] == "OK"

    def test_one_sided_samples_with_preview(self, reports):
        r = reports["warn"]
        assert r["issues"] == [
            "7 sample(s) in parquet but missing from metadata: m0, m1, m2, m3, m4, ... (+2 more)",
            "1 sample(s) in metadata but missing from parquet: z1",
        ]
        assert r["status"] == "WARN" and r["n_samples_intersection"] == 1

    def test_duplicates(self, reports):
        r = reports["dup"]
        assert r["issues"] == [
            "parquet has duplicate sample columns (1 duplicates)",
            "metadata has duplicate sequenced_id rows (2 duplicates)",
        ]
        assert r["n_samples_metadata"] == 3 and r["status"] == "WARN"

    def test_no_overlap_keeps_counts_and_issues(self, reports):
        r = reports["apart"]
        assert r["fatal"] == "no overlapping samples between metadata and parquet" and r["status"] == "FAIL"
        assert r["n_samples_intersection"] == 0 and len(r["issues"]) == 2

    def test_structural_failures_have_no_counts(self, reports):
        assert reports["nomatrix"]["fatal"] == "parquet returned 0 rows"
        assert reports["nometa"]["fatal"] == "metadata returned 0 rows"
        for job in ("nomatrix", "nometa"):
            assert reports[job]["n_genes"] is None and reports[job]["issues"] == []

    def test_problems_win_in_order(self, spark, parts):
        problems = spark.createDataFrame(
            [("ok", "load", "gone"), ("ok", "sample_column", "x"), ("warn", "sample_column", "x"), ("dup", "gene_column", "no gene")],
            PROBLEMS,
        )
        got = {r["job_id"]: r["fatal"] for r in release_report(*parts, problems).collect()}
        assert got["ok"] == "load_experiment failed: gone"
        assert got["warn"] == "metadata missing 'sequenced_id' column"
        assert got["dup"] == "no gene"

    def test_summary(self, spark, parts, rows):
        reports = release_report(*parts)
        assert rows(summarize(reports)) == {(1, 2, 3, 6, 2)}
        assert rows(summarize(reports.filter("status <> 'FAIL'"))) == {(1, 2, 0, 3, 1)}
        assert rows(summarize(reports.filter("status = 'OK'"))) == {(1, 0, 0, 1, 0)}
        assert rows(summarize(reports.limit(0))) == {(0, 0, 0, 0, 2)}

    def test_counts_and_sides(self, parts, rows):
        _, cells, samples = parts
        assert ("dup", 2, 3, 1, 1) in rows(validate_counts(cells, samples))
        assert ("warn", "z1", "metadata") in rows(reconcile(cells, samples))


class TestFiles:
    def test_all_releases(self, release_files):
        spark, files, _ = release_files
        check = validate_releases(spark, files)
        got = {r["job_id"]: r for r in check.reports.collect() if r["job_id"]}
        assert got["r1"]["status"] == "OK" and got["r1"]["n_genes"] == 3
        assert got["r2"]["issues"] == ["metadata has duplicate sequenced_id rows (1 duplicates)"]
        assert got["r3"]["fatal"] == "metadata returned 0 rows"
        assert got["r4"]["fatal"].startswith("load_experiment failed: nothing at")
        assert check.summary.first()["code"] == 2

    def test_missing_columns(self, release_files):
        spark, files, tmp_path = release_files
        (tmp_path / "r1.csv").write_text("sample,job_id\n0012,r1\n")
        spark.createDataFrame([(1.0,)], "s1 double").write.mode("overwrite").parquet(str(tmp_path / "matrix/r2.parquet"))
        got = {r["job_id"]: r["fatal"] for r in validate_releases(spark, files, ["r1", "second"]).reports.collect()}
        assert got["r1"] == "metadata missing 'sequenced_id' column"
        assert got["r2"].startswith("all columns are numeric")

    def test_no_release_has_the_sample_column(self, release_files):
        spark, files, tmp_path = release_files
        (tmp_path / "r1.csv").write_text("sample,job_id\n0012,r1\n")
        got = validate_releases(spark, files, ["r1"]).reports.collect()
        assert [r["fatal"] for r in got] == ["metadata missing 'sequenced_id' column"]

    def test_chosen_and_unknown(self, release_files):
        spark, files, _ = release_files
        check = validate_releases(spark, files, ["first"])
        assert [r["job_id"] for r in check.reports.collect()] == ["r1"] and check.summary.first()["code"] == 0
        check = validate_releases(spark, files, ["first", "nope"])
        assert check.unknown == ["nope"] and check.reports.count() == 0 and check.summary.first()["code"] == 2

    def test_export(self, release_files, tmp_path):
        spark, files, _ = release_files
        out = str(tmp_path / "out")
        got = {r["job_id"]: r for r in validate_releases(spark, files, output_path=out).reports.collect()}
        assert got["r1"]["output_path"] == f"{out}/x/job_id=r1" and got["r3"]["output_path"] is None
        x = spark.read.parquet(f"{out}/x")
        assert x.filter("job_id = 'r1'").count() == 9 and x.filter("job_id = 'r3'").count() == 0
        obs = {(r["sequenced_id"], r["compound"]) for r in spark.read.parquet(f"{out}/obs").collect()}
        # The first of the two rows of b2 in file order.
        assert obs == {("0012", "c1"), ("a1", "c1"), ("A1", "c0"), ("b1", "c1"), ("b2", "c0")}
        var = {(r["job_id"], r["gene_id"], r["gene_idx"]) for r in spark.read.parquet(f"{out}/var").collect()}
        assert {("r1", "g3", 2), ("r2", "g4", 1)} <= var

    def test_failed_build_is_fatal(self, release_files, tmp_path, monkeypatch):
        spark, files, _ = release_files

        def broken(*args, **kwargs):
            raise RuntimeError("no")

        monkeypatch.setattr("exprlake.plans.release_check.annotated_matrix", broken)
        check = validate_releases(spark, files, ["r1"], str(tmp_path / "o"))
        row = check.reports.first()
        assert row["fatal"] == "export could not be built: RuntimeError" and row["status"] == "FAIL"
        assert check.summary.first()["code"] == 2

    def test_failed_write_is_an_issue(self, release_files, tmp_path):
        spark, files, _ = release_files
        (tmp_path / "taken").write_text("a file, not a folder")
        got = {r["job_id"]: r for r in validate_releases(spark, files, output_path=f"{tmp_path}/taken").reports.collect()}
        assert got["r1"]["status"] == "WARN" and got["r1"]["issues"][-1].startswith("write failed")
        assert got["r1"]["output_path"] is None and got["r3"]["status"] == "FAIL"


class TestExport:
    def test_first_row_by_ordinal(self, spark, long_of, rows):
        cells = long_of(("r", "g", "s", 1), ("r", "g", "only", 1))
        metadata = spark.createDataFrame(
            [("r", "s", "late", 9), ("r", "s", "first", 2), ("r", "absent", "x", 1), ("r", None, "y", 0)],
            "job_id string, sequenced_id string, compound string, at int",
        )
        assert rows(obs_table(cells, metadata, ["at"]), "sequenced_id", "compound") == {("s", "first")}

    def test_positions_over_ranges_equal_one_window(self, spark):
        # One group holds most rows; ranges have to cut it.
        ids = spark.range(3000).select(
            F.when(F.col("id") < 2500, "big").otherwise(F.concat(F.lit("j"), F.col("id") % 3)).alias("job_id"),
            F.concat(F.lit("g"), F.col("id")).alias("gene_id"),
        )
        one = index_within(ids, "job_id", "gene_id", "at")
        cut = index_within(ids, "job_id", "gene_id", "at", range_rows=100)
        assert cut.count() == 3000 and one.exceptAll(cut).isEmpty()

    def test_vectors_are_cut_into_blocks(self, spark, long_of, rows):
        cells = long_of(*[("r", f"g{i}", s, i) for i in range(5) for s in ("a", "b")], ("r", "g0", "not in metadata", 1))
        metadata = spark.createDataFrame([("r", "a"), ("r", "b")], "job_id string, sequenced_id string")
        x = sample_cells(cells, metadata, var_table(cells))
        got = {(r["sequenced_id"], r["block"]): (r["gene_idx"], r["value"]) for r in sample_vectors(x, 2).collect()}
        assert len(got) == 6 and got[("a", 1)] == ([2, 3], [2.0, 3.0]) and got[("b", 2)] == ([4], [4.0])

    def test_duplicate_cell_in_vector_raises(self, spark, long_of):
        cells = long_of(("r", "g", "a", 1), ("r", "g", "a", 2))
        metadata = spark.createDataFrame([("r", "a")], "job_id string, sequenced_id string")
        with pytest.raises(PySparkException, match="duplicate cell in sample a"):
            sample_vectors(sample_cells(cells, metadata, var_table(cells))).collect()

    def test_types_and_nulls_are_kept(self, spark, long_of, tmp_path):
        cells = long_of(("r", "g", "a", None), ("r", "g", "b", float("nan")))
        metadata = spark.createDataFrame(
            [("r", "a", None, 1), ("r", "b", "x", None)], "job_id string, sequenced_id string, note string, n int"
        )
        export_samples_by_genes(cells, metadata, ["sequenced_id"], str(tmp_path / "o"))
        obs = spark.read.parquet(str(tmp_path / "o/obs"))
        assert dict(obs.dtypes)["note"] == "string" and dict(obs.dtypes)["n"] == "int"
        assert obs.filter("note is null").count() == 1
        assert spark.read.parquet(str(tmp_path / "o/x")).filter("value is null").count() == 1


class TestCommand:
    def run(self, capsys, *args):
        from exprlake.__main__ import main

        code = main([str(a) for a in args])
        return code, capsys.readouterr()

    def test_codes(self, release_files, capsys):
        _, _, tmp_path = release_files
        catalog = tmp_path / "catalog.json"
        code, out = self.run(capsys, catalog, "--job", "first", "--no-write")
        assert code == 0 and "[OK] r1 (first) genes=3" in out.out and "1 OK  0 WARN  0 FAIL  (1 releases)" in out.out
        assert self.run(capsys, catalog, "--job", "r1", "--job", "r2")[0] == 1
        code, out = self.run(capsys, catalog, "--output-dir", tmp_path / "o", "--reports", tmp_path / "reports")
        assert code == 2 and f"wrote {tmp_path}/o/x/job_id=r1" in out.out and "fatal: load_experiment failed" in out.out
        code, out = self.run(capsys, catalog, "--job", "nope")
        assert code == 2 and "unknown release(s): nope" in out.err


def test_folder_value(spark, tmp_path):
    ids = ["plain", "a:b", "50%", "x=y/z", "q'\"#*?", "{[^]}", "tab\tline\n", "é ü", "back\\slash", "\x7f"]
    frame = spark.createDataFrame([(i, 1) for i in ids], "job_id string, n int")
    frame.write.partitionBy("job_id").parquet(str(tmp_path / "x"))
    on_disk = {p.name for p in (tmp_path / "x").iterdir() if p.is_dir()}
    told = {"job_id=" + r["v"] for r in frame.select(folder_value(F.col("job_id")).alias("v")).collect()}
    assert told == on_disk


def test_an_export_reads_the_matrix_a_few_times(spark, tmp_path):
    cells = [("r1", f"g{g}", f"s{s}", 1.0) for g in range(20) for s in range(10)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "job_id string, gene_id string, sequenced_id string, value double"
    samples = [(f"s{s}", "r1") for s in range(10)]
    source = ReleaseFrames(
        lambda s: s.createDataFrame([("r1", "one")], "job_id string, job_name string"),
        lambda s: s.createDataFrame(samples, "sequenced_id string, job_id string"),
        lambda s: s.createDataFrame([], "job_id string, compound string"),
        lambda s: s.createDataFrame(cells, schema).mapInArrow(count, schema),
    )
    out = str(tmp_path / "out")
    assert [r["status"] for r in validate_releases(spark, source, output_path=out).reports.collect()] == ["OK"]
    assert spark.read.parquet(f"{out}/x").count() == len(cells)
    # Its reports read it to number the genes and to count the cells, the export once.
    assert read.value <= 3 * len(cells)


def test_scratch_of_validation_is_bounded(spark, monkeypatch, tmp_path):
    """The samples of a matrix pass in shares, whose tables and shuffles go before the next; any number of passes agrees."""
    import glob
    import os

    from exprlake import session
    from exprlake.operators import coverage as cv

    draw = random.Random(3)
    cells = [
        (draw.choice(["a", "b"]), draw.choice([None, "g1", "g2", "g3"]), draw.choice([None, *"stuvw"]), draw.choice([None, 1, 2]))
        for _ in range(400)
    ]
    df = spark.createDataFrame(cells, "job_id string, gene_id string, sequenced_id string, gene_row long").withColumn("value", F.lit(1.0))
    monkeypatch.setattr(session, "scratch_root", lambda s: str(tmp_path))
    covered = cv.words(df)
    want = [{tuple(r) for r in f.collect()} for f in (cv.row_counts(covered), cv.sample_totals(covered))]
    widest = []

    def watched(table, label, outlives=False, made=cv.materialize):
        widest.append(len(glob.glob(f"{tmp_path}/**/coverage-*", recursive=True)))
        return made(table, label, outlives)

    monkeypatch.setattr(cv, "materialize", watched)
    for at_a_time, passes in ((10**9, 1), (150, 3)):
        monkeypatch.setattr(cv, "PASS_CELLS", at_a_time)
        widest.clear()
        rows, samples = cv.totals(df)
        assert len(widest) == 3 * passes and max(widest) == 1
        assert [{tuple(r) for r in f.collect()} for f in (rows, samples)] == want
        assert samples.count() == len(want[1])
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in glob.glob(f"{tmp_path}/exprlake/*/*") if os.listdir(p)}
    assert left >= {"row-words", "sample-totals"} and not left & {"cells", "coverage"}
    assert spark.conf.get(session.REMOVE_SHUFFLES) == "false"
