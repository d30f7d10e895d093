"""The same comparisons where one order, part, supplier, customer and release hold a third of all rows."""

from __future__ import annotations

from pathlib import Path

import pytest

from exprlake.queries import matrix, sources, sql, validation

from .compare import TESTDATA, duck, mismatch

KEYS = (
    *matrix.QUERIES,
    *validation.QUERIES,
    *("collective_count", "load_dataset", "load_metadata", "catalog_stats"),
    *("sql_join_chem", "sql_window_rank", "sql_agg_ext", "asof_recipe", "sql_semi_anti", "sql_range_join"),
)
ALL = {k: (m.QUERIES[k], m.ORACLE[k]) for m in (matrix, sources, sql, validation) for k in m.QUERIES}

HOT = {
    "lineitem": """
        SELECT CASE WHEN l_linenumber % 3 = 0 THEN CAST(7 AS BIGINT) ELSE l_orderkey END AS l_orderkey,
               CASE WHEN l_linenumber % 3 = 1 THEN CAST(3 AS BIGINT) ELSE l_partkey END AS l_partkey,
               CASE WHEN l_linenumber % 3 = 2 THEN CAST(5 AS BIGINT) ELSE l_suppkey END AS l_suppkey,
               * EXCLUDE (l_orderkey, l_partkey, l_suppkey)
        FROM lineitem""",
    "orders": """
        SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(11 AS BIGINT) ELSE o_custkey END AS o_custkey,
               CASE WHEN o_orderkey % 3 = 1 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority,
               * EXCLUDE (o_custkey, o_orderpriority)
        FROM orders""",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skew")
    con = duck(f"{TESTDATA}/sf0.001")
    for file in Path(f"{TESTDATA}/sf0.001").glob("*.parquet"):
        rows = HOT.get(file.stem, f"SELECT * FROM {file.stem}")
        con.execute(f"COPY ({rows}) TO '{folder}/{file.name}' (FORMAT parquet)")
    return str(folder), duck(str(folder))


def test_a_third_is_hot(skewed):
    _, con = skewed
    for column in ("l_orderkey", "l_partkey", "l_suppkey"):
        share = f"SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {column})"
        assert con.execute(share).fetchone()[0] > 0.25


@pytest.mark.parametrize("key", KEYS)
def test_equals_duckdb(spark, skewed, key):
    folder, con = skewed
    run, oracle = ALL[key]
    problem = mismatch(run(spark, folder), con, oracle)
    assert problem is None or (key == "keep_samples" and problem == "both sides are empty")
