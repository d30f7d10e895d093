"""Cross-tokenizer alignment against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprlake.llm import alignment
from exprlake.llm import queries as llm_queries
from exprlake.llm.queries import tokenizer_path
from tests.compare import TESTDATA

from .test_operators import SCHEMA, corpus

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteLevel(tokenizer_path()), alignment.Pieces(tokenizer_path("piece_bpe_32k.model"))


def brute(rows, sides):
    """Rows of the contract: all pairs of tokens are compared by their byte ranges."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    linked, out = [], []
    for doc_id, text in rows:
        a = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sides[1].model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        spelled = [b"".join(side.bytes[i] for i in ids) for side, ids in zip(sides, (a, b))]
        if not text or spelled[0] != raw or spelled[1] != raw:
            linked.append([])
            out.append([doc_id, 0, 0, 0, ""])
            continue
        spans = []
        for side, ids in zip(sides, (a, b)):
            ends = np.cumsum([len(side.bytes[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        linked.append([(i, j) for i, (s, e) in zip(a, spans[0]) for j, (x, y) in zip(b, spans[1]) if s < y and x < e])
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for end in common:
            inside = [
                ",".join(str(i) for i, (s, e) in zip(ids, places) if low <= s and e <= end)
                for ids, places in zip((a, b), spans)
            ]
            groups.append("|".join(inside))
            low = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append([doc_id, len(a), len(b), len(groups), digest])
    count = collections.Counter(p for links in linked for p in set(links))
    most: dict[int, int] = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    want = collections.Counter()
    for row, links in zip(out, linked):
        n_best = sum(count[p] == most[p[0]] for p in links)
        want[(*row[:4], len(links), n_best, sum(count[p] for p in links), row[4])] += 1
    return want


def odd_texts():
    draw = random.Random(2)
    letters = "aé€𝄞 \n\t'xyz019日本▁<|>"
    yield from ["<|endoftext|>", "a<|endoftext|> b", "<s> </s> <unk>", "<0x41>", "▁", "a▁b", " ", "  a", "\r\n\n  x", "\u0000"]
    yield from ["naïve café 日本語 𝄞𝄞 ́́", "'s 're  don't", "ﬁ ﬃ Å Å ﻿"]
    for _ in range(60):
        yield "".join(draw.choices(letters, k=draw.randrange(1, 60)))


def test_operator(spark, sides, monkeypatch):
    rows = [(r[0], r[1]) for r in corpus()]
    rows += [(5000 + i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, "s", "n", 1) for d, t in rows], SCHEMA)
    docs = docs.withColumn("pair", F.lit(1)).withColumn("batch", F.lit("x")).withColumn("to", F.lit("x"))
    want = brute(rows, sides)
    for limit in (alignment.ALIGN_BYTES, 500):
        monkeypatch.setattr(alignment, "ALIGN_BYTES", limit)
        found = alignment.align(docs.repartition(3), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
        assert found.columns == COLUMNS
        assert collections.Counter(tuple(r) for r in found.collect()) == want
    none = alignment.align(spark.createDataFrame([], SCHEMA), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    assert none.count() == 0


def test_a_long_text(spark, sides):
    text = " ".join(random.Random(1).choices(["water", "ünder", "naïveté", "x" * 30, "12345"], k=400_000))
    docs = spark.createDataFrame([(1, text), (2, "water")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in alignment.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert found[1]["n_a"] == len(sides[0].encode([" " + text])[0]) and found[1]["n_links"] >= found[1]["n_a"]
    assert found[2]["n_a"] >= 1


def test_links_inside_a_group():
    ends_a, ends_b = np.array([2, 5, 9, 12]), np.array([3, 6, 9, 10, 11, 12])
    cuts = alignment.cut_groups(ends_a.tolist(), ends_b.tolist())
    assert cuts == ([3, 4], [3, 6])
    i, j = alignment.link_groups(ends_a, ends_b, *cuts)
    assert set(zip(i.tolist(), j.tolist())) == {(0, 0), (1, 0), (1, 1), (2, 1), (2, 2), (3, 3), (3, 4), (3, 5)}


def test_query(spark, sides):
    sf = f"{TESTDATA}/sf0.001"
    out = llm_queries.op11_tokenizer_alignment(spark, sf)
    assert {t for c, t in out.dtypes if c != "groups_sha256"} == {"bigint"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert len(got) == len(rows)
    short = [r for r in rows if len(r[1] or "") < 6000]
    assert len(short) > len(rows) // 2
    # The counts need all documents, the rest of a row its own text alone.
    want = brute(short, sides)
    assert {w[:5] + w[7:] for w in want} == {got[d][:5] + got[d][7:] for d, _ in short}
    short_only = alignment.align(
        docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 6000),
        tokenizer_path(),
        tokenizer_path("piece_bpe_32k.model"),
    )
    assert collections.Counter(tuple(r) for r in short_only.collect()) == want
