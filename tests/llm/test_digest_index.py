"""The digest index: decisions against brute force, loads in any order, the plan of the anti-join."""

from __future__ import annotations

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from exprlake.llm import digest_index
from exprlake.llm import queries as llm_queries
from exprlake.session import new_scratch_path
from tests.compare import TESTDATA

from .test_operators import SCHEMA, corpus


def want(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = collections.Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).digest()
        left = 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            out[i, keep, len(ids), kept, digest] += 1
    return out


def got(index):
    rows = digest_index.decisions(index).select("doc_id", "keep_id", "group_size", "kept", "digest").collect()
    return collections.Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in rows)


def odd_rows():
    rows = [(r[0], r[1]) for r in corpus()]
    return rows + [(None, "no id"), (None, "no id"), (None, rows[9][1]), (7, "same"), (7, "same"), (7, "other")]


@pytest.mark.parametrize("loads", [1, 3])
@pytest.mark.parametrize("hot", [1, 10_000])
def test_decisions(spark, loads, hot, monkeypatch):
    monkeypatch.setattr(digest_index, "HOT_GROUPS", hot)
    rows = odd_rows()
    index = digest_index.open_index(spark, new_scratch_path(spark, "t"), 3)
    for load in range(loads):
        part = spark.createDataFrame([(d, t, "s", "n", 1) for d, t in rows[load::loads]], SCHEMA)
        digest_index.add(index, part.withColumn("digest", F.lit("x")).withColumn("load", F.lit("x")), load)
    assert got(index) == want(rows)


def test_an_index_lasts(spark):
    root = new_scratch_path(spark, "t")
    first = spark.createDataFrame([(5, "a"), (3, "b")], "doc_id long, text string")
    index = digest_index.open_index(spark, root, 4)
    assert digest_index.add(index, first, 0).count() == 2
    # Forgotten by the catalog, found again by its folder, with the buckets it was made with.
    spark.sql(f"DROP TABLE {index.table}")
    index = digest_index.open_index(spark, root, 99)
    assert digest_index.add(index, first, 0).count() == 0  # the same load again
    second = spark.createDataFrame([(4, "a"), (9, "b"), (1, "c")], "doc_id long, text string")
    taken = {(r["doc_id"]) for r in digest_index.add(index, second, 1).collect()}
    assert taken == {9, 1}  # 4 is less than 5, which the index holds
    assert got(index) == want([(5, "a"), (3, "b"), (4, "a"), (9, "b"), (1, "c")])


def test_empty_and_normalized(spark):
    index = digest_index.open_index(spark, new_scratch_path(spark, "t"), 2)
    assert digest_index.add(index, spark.createDataFrame([], SCHEMA), 0).count() == 0
    assert digest_index.decisions(index).count() == 0
    docs = spark.createDataFrame([(1, "A"), (2, "a"), (3, None), (4, "")], "doc_id long, text string")
    digest_index.add(index, docs, 1, F.lower)
    assert {(r["doc_id"], r["keep_id"]) for r in digest_index.decisions(index).collect()} == {(1, 2), (2, 2), (3, 4), (4, 4)}


def test_the_index_is_not_shuffled(spark):
    index = digest_index.open_index(spark, new_scratch_path(spark, "t"), 5)
    docs = spark.createDataFrame([(r[0], r[1]) for r in corpus()], "doc_id long, text string")
    digest_index.add(index, docs, 0)
    best = spark.createDataFrame([(bytearray(b"x"), 1, 0, 0)], "digest binary, doc_id long, load long, place long")
    plan = digest_index._unknown(index, best)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    # The one exchange is that of the candidates.
    assert plan.count("Exchange") == 1 and "Scan ExistingRDD" in plan[plan.index("Exchange") : plan.index("FileScan")]
    assert index.current()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_query(spark):
    sf = f"{TESTDATA}/sf0.001"
    out = llm_queries.op13_exact_dedup(spark, sf)
    types = dict(out.dtypes)
    assert types == {
        "doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"
    }
    rows = collections.Counter((r[0], r[1], r[2], r[3], bytes.fromhex(r[4])) for r in out.collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows == want([(r[0], r[1]) for r in docs])
