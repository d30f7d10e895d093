"""What the physical plans have to look like at scale."""

from __future__ import annotations

import re
from dataclasses import replace

import pytest

from exprlake import drop_unexpressed, expressed_genes
from exprlake import fixtures as fx
from exprlake.operators.export import obs_table
from exprlake.operators.matrix import gene_counts, to_blocks
from exprlake.operators.validate import duplicate_cells, issue_previews, reconcile
from exprlake.schemas import SEQUENCING
from exprlake.sources.files import Entry, read_sequencing
from exprlake.sources.store import open_store, write_matrix, write_matrix_table

from .compare import TESTDATA

SF = f"{TESTDATA}/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def physical(df) -> str:
    return plan(df).split("== Physical Plan ==")[1]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    write_matrix(fx.sequencing_a(spark, SF), f"{root}/matrix")
    return root


def test_release_filter_prunes_folders(spark, store):
    df = open_store(store).sequencing(spark, ["job-2"])
    assert re.search(r"PartitionFilters: \[[^]]*job_id#\d+ (=|IN)", physical(df))
    assert {r["job_id"] for r in df.select("job_id").distinct().collect()} == {"job-2"}


def test_listed_release_folders_are_one_scan(spark, store):
    entries = [Entry(f"job-{i}", f"{store}/matrix/job_id=job-{i}", True) for i in (1, 2, 3)]
    df = read_sequencing(spark, entries, [SEQUENCING] * 3)
    assert physical(df).count("FileScan") == 1
    assert {r["job_id"] for r in df.select("job_id").distinct().collect()} == {"job-1", "job-2", "job-3"}


def test_expressed_genes_reads_what_it_needs(spark, store):
    text = physical(expressed_genes(open_store(store).sequencing(spark)))
    assert "ReadSchema: struct<gene_id:string,value:double>" in text
    assert "PushedFilters: [IsNotNull(value), Not(EqualTo(value,0.0))]" in text


def test_gene_count_reads_one_column(spark, store):
    text = physical(gene_counts(open_store(store).sequencing(spark)))
    assert "ReadSchema: struct<gene_id:string>" in text


def test_cells_are_shuffled_once_and_long(spark):
    text = physical(to_blocks(fx.observed_b(spark, SF)).cells)
    assert len(re.findall(r"Exchange hashpartitioning\(gene_id#\d+, __unnamed_in#\d+, block#\d+L, \d+\)", text)) == 1
    # Above that exchange nothing moves, and below it nothing is pivoted.
    above, below = text.split("REPARTITION_BY_COL", 1)
    assert above.count("Exchange") == 1 and "max(" not in below


def test_cells_do_not_move_to_their_samples(spark):
    """More samples than Spark would broadcast by itself, but few bytes: the cells are not shuffled as texts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = physical(fx.observed_b(spark, SF))
        assert "BroadcastHashJoin" in text and "cast(l_suppkey" not in "".join(re.findall(r"Exchange hashpartitioning.*", text))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_of_blocks_follow_the_cells(spark, monkeypatch):
    """Rows of a sparse matrix are as wide as a block each, which the size of long cells does not tell."""
    from exprlake.operators import matrix as mx

    monkeypatch.setattr(mx, "BLOCK_CELLS", 100)
    cells = spark.range(1250).selectExpr("'r' AS job_id", "cast(id AS string) AS gene_id", "'s' AS sequenced_id", "1.0D AS value")
    blocks = mx.to_blocks(cells).cells
    assert ", 13), REPARTITION_BY_NUM" in physical(blocks) and blocks.count() == 1250


def test_groups_are_cut_before_the_shuffle(spark):
    sequencing, metadata = fx.sequencing_a(spark, SF), fx.metadata_a(spark, SF)
    for df in (
        issue_previews(reconcile(sequencing, metadata)),
        obs_table(sequencing, fx.metadata_raw_a(spark, SF), ["ingest_ordinal"]),
    ):
        text = physical(df)
        final, partial = text.index("Final"), text.index(", Partial")
        assert "Exchange" in text[final:partial]


def test_bucketed_matrix_needs_no_shuffle(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS matrix_buckets")
    write_matrix_table(fx.sequencing_a(spark, SF), "matrix_buckets", 4, str(tmp_path / "b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matrix = spark.table("matrix_buckets")
        kept = drop_unexpressed(matrix)
        assert "Exchange" not in physical(kept)
        # Only the last step, one row per gene or duplicate, moves.
        assert physical(gene_counts(matrix)).count("Exchange") == 1
        assert physical(duplicate_cells(matrix)).count("Exchange") == 1
        assert kept.count() == drop_unexpressed(fx.sequencing_a(spark, SF)).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE matrix_buckets")


def test_no_cross_product_and_no_unmeasured_broadcast(spark):
    from __spark_entry__ import queries

    for key in ("sql_join_chem", "sql_range_join", "drop_unexpressed", "obs_table", "load_experiments_sql"):
        text = plan(queries()[key](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, key
        if key != "load_experiments_sql":
            assert "strategy=broadcast" not in text, key


def test_combining_moves_no_cells_while_its_sets_are_small(spark, store, monkeypatch):
    from exprlake import load_experiments

    source = replace(fx.release_a(SF), sequencing_table=open_store(store).sequencing_table)
    jobs, sql = ["URGENT", "HIGH"], "SELECT * FROM metadata WHERE is_control"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = load_experiments(spark, source, jobs, sql).data
        assert "Exchange hashpartitioning" not in physical(small) and "SortMergeJoin" not in physical(small)
        monkeypatch.setattr("exprlake.session.BROADCAST_BYTES", 10)
        large = load_experiments(spark, source, jobs, sql).data
        assert physical(large).count("SortMergeJoin") == 2
        assert small.count() > 0 and small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
