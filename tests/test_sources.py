"""Catalog, file sources, unions, and the ingested store."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from exprlake import (
    ReleaseFiles,
    list_datasets,
    load_experiment,
    resolve_dataset_url,
    resolve_job,
    select_releases,
    validate_releases,
)
from exprlake.operators.union import concat_chemistry, concat_metadata, empty_chemistry
from exprlake.schemas import CHEMISTRY, METADATA
from exprlake.session import scratch_root
from exprlake.sources.store import ingest, write_catalog, write_chemistry, write_metadata


def test_scratch_folder_is_the_configured_one(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Fake:
        def __init__(self, master, conf):
            self.conf, self.sparkContext, self.master, self.applicationId = Conf(conf), self, master, "app"

        def getConf(self):
            return Conf()

    assert scratch_root(Fake("spark://x", {"spark.checkpoint.dir": "s3a://b/c/"})) == "s3a://b/c"
    assert "exprlake-" in scratch_root(Fake("local[2]", {}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Fake("spark://x", {}))


def test_header_with_odd_names(spark, tmp_path):
    (tmp_path / "m.csv").write_text('sequenced_id,"a.b","tick`","say ""x"""\ns,1,2,3\n')
    datasets = [{"job_id": "j", "job_name": "j", "metadata_path": str(tmp_path / "m.csv")}]
    (tmp_path / "c.json").write_text(json.dumps({"datasets": datasets}))
    row = ReleaseFiles(str(tmp_path / "c.json")).metadata(spark).first()
    assert row.asDict() == {"sequenced_id": "s", "a.b": "1", "tick`": "2", 'say "x"': "3", "job_id": "j"}


def test_list_datasets(release_files):
    spark, files, tmp_path = release_files
    df = list_datasets(spark, str(tmp_path / "catalog.json"))
    assert df.count() == 5
    row = df.filter("job_id = 'r1'").first()
    assert row["job_name"] == "first" and row["cell_lines"] == ["THP-1"] and row["is_public"] is True
    assert dict(df.dtypes)["imported_at"] == "timestamp"


class TestResolve:
    @pytest.fixture()
    def catalog(self, spark):
        return spark.createDataFrame(
            [("j1", "one", "/p1"), ("j2", "two", None), ("j3", "two", ""), ("one", "x", "/p4")],
            "job_id string, job_name string, data_path string",
        )

    def test_id_wins_over_name(self, catalog):
        assert resolve_job(catalog, "one") == "one"
        assert resolve_job(catalog, "j1") == "j1"

    def test_unique_name(self, catalog):
        assert resolve_job(catalog, "x") == "one"

    def test_ambiguous_name_lists_ids(self, catalog):
        with pytest.raises(ValueError, match=r"Ambiguous job name 'two'.*j2.*j3"):
            resolve_job(catalog, "two")

    def test_unknown(self, catalog):
        with pytest.raises(ValueError, match="No dataset found matching 'nope'"):
            resolve_job(catalog, "nope")

    def test_url(self, catalog):
        assert resolve_dataset_url(catalog, "j1") == "/p1"
        for job in ("j2", "j3"):
            with pytest.raises(ValueError, match="No parquet URL"):
                resolve_dataset_url(catalog, job)

    def test_select(self, catalog):
        chosen, unknown = select_releases(catalog, ["two", "j1", "nope", "also no"])
        assert {r["job_id"] for r in chosen.collect()} == {"j1", "j2", "j3"}
        assert unknown == ["also no", "nope"]


def test_catalog_is_read_once_and_refreshed(release_files):
    spark, files, tmp_path = release_files
    assert files.resolve(spark, "first") == "r1"
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"datasets": [{"job_id": "new", "job_name": "first"}]}))
    assert files.resolve(spark, "first") == "r1"
    files.refresh()
    assert files.resolve(spark, "first") == "new"


class TestMetadata:
    def test_columns_bind_by_name_not_position(self, release_files):
        spark, files, _ = release_files
        got = {r["sequenced_id"]: r for r in files.metadata(spark, ["r1", "r2"]).filter("compound <> 'c9'").collect()}
        assert got["0012"]["percent_mitochondrial"] == 10.5
        assert got["b1"]["percent_mitochondrial"] == 3.5 and got["b1"]["total_sequenced_reads"] == 900
        assert got["b1"]["job_id"] == "r2" and got["A1"]["is_control"] is True

    def test_text_ids_keep_zeros_and_case(self, release_files):
        spark, files, _ = release_files
        ids = {r["sequenced_id"] for r in files.load_metadata(spark, "first").collect()}
        assert ids == {"0012", "a1", "A1"}

    def test_extra_column_and_quotes(self, release_files):
        spark, files, _ = release_files
        notes = {r["note"] for r in files.metadata(spark).filter("sequenced_id = 'b1' or job_id = 'r1'").collect()}
        assert notes == {None, 'a "quoted", note'}

    def test_value_that_does_not_parse_is_null(self, release_files):
        spark, files, _ = release_files
        row = files.load_metadata(spark, "r2").filter("sequenced_id = 'b2' and compound = 'c0'").first()
        assert row["total_sequenced_reads"] is None

    def test_missing_gives_typed_empty(self, release_files):
        spark, files, _ = release_files
        df = files.load_metadata(spark, "r3")
        assert df.count() == 0 and df.schema == METADATA

    def test_job_id_comes_from_the_file_if_the_column_is_absent(self, spark, tmp_path):
        for job in ("p 1", "p2"):
            (tmp_path / f"{job}.csv").write_text(f"sequenced_id,cell_line\n{job}-s,K562\n")
        datasets = [{"job_id": j, "job_name": j, "metadata_path": str(tmp_path / f"{j}.csv")} for j in ("p 1", "p2")]
        (tmp_path / "c.json").write_text(json.dumps({"datasets": datasets}))
        got = ReleaseFiles(str(tmp_path / "c.json")).metadata(spark)
        assert {(r["job_id"], r["sequenced_id"]) for r in got.collect()} == {("p 1", "p 1-s"), ("p2", "p2-s")}

    def test_changed_header_is_read_again(self, release_files):
        spark, files, tmp_path = release_files
        assert files.load_metadata(spark, "r1").filter("cell_line = 'THP-1'").count() == 3
        (tmp_path / "r1.csv").write_text("cell_line,sequenced_id\nK562,s\n")
        os.utime(tmp_path / "r1.csv", (1, 1))
        row = files.load_metadata(spark, "r1").first()
        assert (row["sequenced_id"], row["cell_line"], row["job_id"]) == ("s", "K562", "r1")

    def test_folder_with_two_headers_fails(self, spark, tmp_path):
        (tmp_path / "m").mkdir()
        (tmp_path / "m" / "a.csv").write_text("sequenced_id,cell_line\ns1,K562\n")
        (tmp_path / "m" / "b.csv").write_text("cell_line,sequenced_id\nK562,s2\n")
        datasets = [{"job_id": "j", "job_name": "j", "metadata_path": str(tmp_path / "m")}]
        (tmp_path / "c.json").write_text(json.dumps({"datasets": datasets}))
        with pytest.raises(Exception, match="CSV header does not conform"):
            ReleaseFiles(str(tmp_path / "c.json")).metadata(spark).collect()

    def test_line_breaks_inside_quotes(self, spark, tmp_path):
        (tmp_path / "m.csv").write_text('sequenced_id,note,cell_line\ns1,"two\nlines, and ""more""",K562\ns2,,THP-1\n')
        datasets = [{"job_id": "j", "job_name": "j", "metadata_path": str(tmp_path / "m.csv")}]
        (tmp_path / "c.json").write_text(json.dumps({"datasets": datasets}))
        read = ReleaseFiles(str(tmp_path / "c.json")).metadata(spark)
        want = {("s1", 'two\nlines, and "more"', "K562"), ("s2", None, "THP-1")}
        assert {(r["sequenced_id"], r["note"], r["cell_line"]) for r in read.collect()} == want
        write_metadata(read, str(tmp_path / "again"))
        datasets[0]["metadata_path"] = str(tmp_path / "again" / "release=j")
        (tmp_path / "d.json").write_text(json.dumps({"datasets": datasets}))
        again = ReleaseFiles(str(tmp_path / "d.json")).metadata(spark)
        assert {(r["sequenced_id"], r["note"], r["cell_line"]) for r in again.collect()} == want

    def test_ordinal_is_file_order(self, spark, tmp_path):
        # A quoted value may hold line breaks, so a file is one task and a large table is many files.
        (tmp_path / "m").mkdir()
        for part in range(5):
            lines = [f's{i % 7},{i},"a\nb"' for i in range(part * 1000, part * 1000 + 1000)]
            text = "sequenced_id,total_sequenced_reads,note\n" + "\n".join(lines) + "\n"
            (tmp_path / "m" / f"part-{part}.csv").write_text(text)
        datasets = [{"job_id": "j", "job_name": "j", "metadata_path": str(tmp_path / "m")}]
        (tmp_path / "c.json").write_text(json.dumps({"datasets": datasets}))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        try:
            df = ReleaseFiles(str(tmp_path / "c.json")).metadata(spark, with_ordinal=True)
            assert df.rdd.getNumPartitions() > 1
            order = [r["total_sequenced_reads"] for r in df.orderBy("ingest_ordinal").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert order == list(range(5000))


class TestChemistry:
    def test_document(self, release_files):
        spark, files, _ = release_files
        df = files.load_chem(spark, "first")
        assert df.schema.fieldNames() == CHEMISTRY.fieldNames()
        assert {(r["compound"], r["num_atoms"]) for r in df.collect()} == {("c1", 27), ("c0", None)}

    def test_missing_or_empty(self, release_files):
        spark, files, tmp_path = release_files
        assert files.load_chem(spark, "r3").count() == 0
        (tmp_path / "r3.json").write_text('{"compounds": []}')
        df = files.load_chem(spark, "r3")
        assert df.count() == 0 and df.schema == CHEMISTRY

    def test_typed_empty(self, spark):
        df = empty_chemistry(spark)
        assert df.count() == 0 and len(df.columns) == 13 and df.schema == CHEMISTRY

    def test_all_releases_with_their_id(self, release_files):
        spark, files, _ = release_files
        got = {(r["job_id"], r["compound"]) for r in files.chemistry(spark).collect()}
        assert got == {("r1", "c1"), ("r1", "c0"), ("r2", "c1")}

    def test_folder_of_line_documents(self, release_files, tmp_path):
        spark, files, _ = release_files
        write_chemistry(files.chemistry(spark), str(tmp_path / "out"))
        catalog = files.catalog(spark).withColumn(
            "chemistry_path", F.concat(F.lit(f"{tmp_path}/out/release="), F.col("job_id"))
        )
        write_catalog(catalog, str(tmp_path / "catalog-out"))
        again = ReleaseFiles(str(tmp_path / "catalog-out"))
        assert again.chemistry(spark).exceptAll(files.chemistry(spark).select(again.chemistry(spark).columns)).isEmpty()
        assert again.chemistry(spark).count() == 3


class TestMatrix:
    def test_stored_wide_frame(self, release_files):
        spark, files, _ = release_files
        df = files.load_dataset(spark, "first")
        assert df.columns == ["gene_id", "0012", "a1", "A1"] and df.count() == 3

    def test_long_keeps_zeros_and_nulls(self, release_files):
        spark, files, _ = release_files
        long = files.sequencing(spark, ["r1"])
        assert long.count() == 9 and long.filter("value is null").count() == 1
        assert {r["sequenced_id"] for r in long.collect()} == {"0012", "a1", "A1"}

    def test_errors_are_listed(self, release_files, caplog):
        spark, files, _ = release_files
        got = {(r["job_id"], r["source"]) for r in files.source_errors(spark).collect()}
        assert got == {
            ("r3", "metadata_path"),
            ("r3", "chemistry_path"),
            ("r4", "data_path"),
            ("r4", "metadata_path"),
            ("r4", "chemistry_path"),
        }
        assert "is not available" in caplog.text

    def test_unreadable_parts_stop_only_their_release(self, release_files):
        spark, files, tmp_path = release_files
        (tmp_path / "broken.parquet").write_bytes(b"not a matrix")
        (tmp_path / "broken.json").write_text('{"compounds": [{"compound": "c1", "smi')
        catalog = json.loads((tmp_path / "catalog.json").read_text())
        for entry in catalog["datasets"]:
            if entry["job_id"] == "r2":
                entry["data_path"] = str(tmp_path / "broken.parquet")
                entry["chemistry_path"] = str(tmp_path / "broken.json")
        (tmp_path / "other.json").write_text(json.dumps(catalog))
        files = ReleaseFiles(str(tmp_path / "other.json"))
        assert {r["job_id"] for r in files.sequencing(spark).collect()} == {"r1", "r3"}
        assert {r["job_id"] for r in files.chemistry(spark).collect()} == {"r1"}
        errors = {(r[0], r[1]): r[2] for r in files.source_errors(spark).collect()}
        assert "cannot be read" in errors["r2", "data_path"] and "cannot be read" in errors["r2", "chemistry_path"]
        assert ("r2", "metadata_path") not in errors and ("r1", "data_path") not in errors
        statuses = {r["job_id"]: r["status"] for r in validate_releases(spark, files).reports.collect()}
        assert statuses["r2"] == "FAIL" and statuses["r1"] != "FAIL"
        with pytest.raises(ValueError, match="Dataset not found for job_id='r2'"):
            load_experiment(spark, files, "r2")

    def test_experiment(self, release_files):
        spark, files, _ = release_files
        exp = load_experiment(spark, files, "third")
        assert exp.job_id == "r3" and exp.data.count() == 1
        assert exp.metadata.count() == 0 and exp.chemistry.schema == CHEMISTRY
        wide = load_experiment(spark, files, "r1").to_wide(["0012", "a1", "A1"])
        assert wide.columns == ["gene_id", "0012", "a1", "A1"] and wide.count() == 3

    def test_experiment_needs_its_matrix(self, release_files):
        spark, files, _ = release_files
        with pytest.raises(ValueError, match="Dataset not found for job_id='r4'"):
            load_experiment(spark, files, "fourth")

    def test_ingested_store(self, release_files, tmp_path):
        spark, files, _ = release_files
        store = ingest(spark, files, str(tmp_path / "store"))
        assert store.sequencing(spark).count() == files.sequencing(spark).count()
        assert store.sequencing(spark, ["r2"]).count() == 4
        assert store.metadata(spark).count() == 6 and "note" in store.metadata(spark).columns
        assert store.chemistry(spark, ["r1"]).count() == 2
        assert store.resolve(spark, "second") == "r2"


def test_concat_metadata_casts_before_the_union(spark):
    a = spark.createDataFrame([(12, "5")], "sequenced_id int, total_sequenced_reads string")
    b = spark.createDataFrame([("x", 7.5)], "sequenced_id string, percent_mapped double")
    both = concat_metadata(spark, [a, b])
    assert dict(both.dtypes) == {
        "sequenced_id": "string",
        "total_sequenced_reads": "bigint",
        "percent_mapped": "double",
    }
    assert {tuple(r) for r in both.collect()} == {("12", 5, None), ("x", None, 7.5)}
    assert concat_metadata(spark, []).schema == METADATA


def test_concat_chemistry_keeps_repeats(spark):
    a = spark.createDataFrame([("c1", "CC")], "compound string, smiles string")
    assert concat_chemistry(spark, [a, a]).count() == 2
    assert concat_chemistry(spark, []).schema == CHEMISTRY
