"""The pipeline stage by stage, each against what its operator's brute force says."""

from __future__ import annotations

import corpus_pipeline
from exprlake.llm import queries as llm_queries
from tests.compare import TESTDATA, duck, mismatch

from .test_operators import ALNUM, near_groups, words

SF = f"{TESTDATA}/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), "t")
        if name != "best-fit packing":
            assert out.columns == columns and 0 < out.count() <= len(rows)
        kept = out.collect()
        if name == "n-gram Jaccard join":
            want = {c for d, n, c, _ in near_groups([(r["doc_id"], r["text"]) for r in rows], 5, 80)}
            assert {r["doc_id"] for r in kept} == want
        if name == "benchmark decontamination":
            windows = set()
            for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
                w = words(ALNUM, item["text"])
                windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(w) for w in windows}

            def clean(text):
                w = words(ALNUM, text)
                return not any(tuple(w[i : i + s]) in windows for s in sizes for i in range(len(w) - s + 1))

            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in rows if clean(r["text"])}
        if name == "secret scans":
            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in rows}
        if name == "best-fit packing":
            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in rows}
        docs, rows = out, kept


ODD = "doc_id long, text string, lang string, source string, n_chars long, __doc string, __hash int, __n int, __values string, row int"


def test_stages_on_odd_rows(spark):
    """No text is lost that lacks or repeats a doc_id, and no column's name clashes."""
    words = [f"word{i}" for i in range(80)]
    texts = [(None, " ".join(words[i : i + 12])) for i in range(0, 60, 12)]
    texts += [(7, " ".join(words[i : i + 9])) for i in range(1, 60, 16)] + [(9, "other " * 3), (None, None), (3, "")]
    near = " ".join([*words[:70], "edit"])
    texts += [(20, " ".join(words[:71])), (None, near), (21, near), (21, near)]
    rows = [(d, t, "en", "s", 1, "d", 5, 6, "v", 1) for d, t in texts]
    docs = spark.createDataFrame(rows, ODD)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["n-gram Jaccard join"](spark, docs, SF)
    assert kept.columns == docs.columns
    want = sorted(((d, t) for d, t in texts[:-3]), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want
    for name in ("quality rules", "benchmark decontamination", "secret scans"):
        out = stages[name](spark, docs, SF)
        assert out.columns == docs.columns and (name == "quality rules" or out.count() == len(texts))
    assert stages["best-fit packing"](spark, docs, SF).count() >= len(texts)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_oracles(spark):
    for key, sql in llm_queries.ORACLE.items():
        problem = mismatch(llm_queries.QUERIES[key](spark, SF), duck(SF), sql)
        assert problem in (None, "both sides are empty"), key
