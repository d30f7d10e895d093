"""SQL over the tables of one release or of all."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

from exprlake import ReleaseFiles, describe, query
from exprlake.schemas import CHEMISTRY_COLUMNS


def test_default_statement(release_files):
    spark, files, _ = release_files
    df = query(spark, files)
    assert df.count() == 6 and "sequenced_id" in df.columns


def test_one_release_by_name_or_id(release_files, rows):
    spark, files, _ = release_files
    sql = "SELECT COUNT(*) AS n FROM metadata"
    assert rows(query(spark, files, "first", sql)) == {(3,)}
    assert rows(query(spark, files, job="r2", sql=sql)) == {(3,)}
    assert rows(query(spark, files, sql=sql)) == {(6,)}


def test_join_fans_out_over_releases_unless_keyed(release_files, rows):
    spark, files, _ = release_files
    join = "SELECT m.sequenced_id, c.smiles FROM metadata m JOIN {} c ON c.compound = m.compound{}"
    # c1 is in the chemistry of both releases.
    assert query(spark, files, sql=join.format("chemistry", "")).count() == 8
    by_job = join.format("chemistry_by_job", " AND c.job_id = m.job_id")
    assert query(spark, files, sql=by_job).count() == 4


def test_release_without_metadata_and_chemistry(release_files, rows):
    spark, files, _ = release_files
    assert query(spark, files, "third").count() == 0
    assert rows(query(spark, files, "third", "SELECT COUNT(compound) FROM chemistry")) == {(0,)}


def test_unknown_release(release_files):
    spark, files, _ = release_files
    with pytest.raises(ValueError, match="No dataset found matching"):
        query(spark, files, "nope")
    with pytest.raises(ValueError, match="Dataset not found"):
        query(spark, files, "fourth")


def test_empty_catalog(spark, tmp_path, caplog):
    (tmp_path / "c.json").write_text('{"datasets": []}')
    df = query(spark, ReleaseFiles(str(tmp_path / "c.json")), sql="SELECT 1")
    assert df.count() == 0 and df.columns == []
    assert "lists no release" in caplog.text


def test_only_the_two_tables(release_files, spark):
    session, files, _ = release_files
    spark.range(1).createOrReplaceTempView("elsewhere")
    for table in ("sequencing", "elsewhere"):
        with pytest.raises(AnalysisException, match="TABLE_OR_VIEW_NOT_FOUND"):
            query(session, files, sql=f"SELECT * FROM {table}")
    assert not session.catalog.tableExists("metadata") and not spark.catalog.tableExists("metadata")


def test_matrix_table_is_opt_in(release_files, rows):
    spark, files, _ = release_files
    sql = "SELECT gene_id, MAX(value) FROM sequencing WHERE value > 0 GROUP BY gene_id"
    assert rows(query(spark, files, "r1", sql, with_sequencing=True)) == {("g1", 1.0), ("g3", 4.0)}


def test_identifiers_in_quotes_and_any_case(release_files, rows):
    spark, files, _ = release_files
    sql = """SELECT "Sequenced_ID" FROM METADATA WHERE "is_control" AND JOB_ID = 'r1'"""
    assert rows(query(spark, files, sql=sql)) == {("A1",)}


def test_error_of_the_statement_is_raised(release_files):
    spark, files, _ = release_files
    with pytest.raises(AnalysisException, match="no_such_column"):
        query(spark, files, sql="SELECT no_such_column FROM metadata")


def test_describe(release_files, rows):
    spark, files, _ = release_files
    both = describe(spark, files)
    assert set(both) == {"metadata", "chemistry"}
    assert both["metadata"].columns == ["column_name", "column_type"]
    metadata = rows(both["metadata"])
    assert {("sequenced_id", "string"), ("percent_mitochondrial", "double"), ("note", "string")} <= metadata
    assert [r["column_name"] for r in both["chemistry"].collect()] == CHEMISTRY_COLUMNS
    assert ("note", "string") not in rows(describe(spark, files, "first")["metadata"])


def test_session_settings_carry_over(release_files, spark):
    session, files, _ = release_files
    result = query(session, files)
    assert result.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert session.conf.get("spark.sql.caseSensitive") == "true"
