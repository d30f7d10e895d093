"""Registered queries, as put out, against brute force of what they promise."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from exprlake.llm import queries as llm_queries
from tests.compare import TESTDATA

from .test_operators import ALNUM, SPACE, near_groups, words

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return {r[0]: r[1] for r in docs.collect()}


def by_id(df):
    rows = df.collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(llm_queries.tokenizer_path())
    out = llm_queries.op1_best_fit_packing(spark, SF)
    types = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert {c: t for c, t in out.dtypes if c in types} == types
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in out.collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces.pop(doc_id), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 1024 or k == 0)
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids) and (k == 0) == (len(ids) <= 1024)
    assert not pieces
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.1 * math.ceil(total / 1024) + 1


def test_op2(spark, texts):
    got = by_id(llm_queries.op2_ngram_jaccard_join(spark, SF))
    want = near_groups(list(texts.items()), 3, 90)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.values()) == sorted(w[:3] for w in want)


def test_op3(spark, texts):
    got = by_id(llm_queries.op3_quality_rules(spark, SF))
    for doc_id, text in texts.items():
        text, r = text or "", got[doc_id]
        found = SPACE.findall(text)
        windows = collections.Counter(zip(found, found[1:], found[2:]))
        repeated = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        want = (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert 0 < sum(r["kept"] for r in got.values()) < len(got)


def test_op5(spark, texts):
    got = by_id(llm_queries.op5_suffix_dedup(spark, SF))
    least: dict[bytes, int] = {}
    raw = {d: (t or "").encode() for d, t in texts.items()}
    for doc_id in sorted(raw):
        for i in range(len(raw[doc_id]) - 49):
            least.setdefault(raw[doc_id][i : i + 50], doc_id)
    removed = 0
    for doc_id, body in raw.items():
        gone = np.zeros(len(body) + 1, np.int64)
        for i in range(len(body) - 49):
            if least[body[i : i + 50]] < doc_id:
                gone[i] += 1
                gone[i + 50] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        r = got[doc_id]
        spans = int((gone & np.r_[True, ~gone[:-1]][: len(gone)]).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(body), int(gone.sum()), spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        removed += spans
    assert removed > 20


def test_op6(spark, texts):
    got = by_id(llm_queries.op6_sharding(spark, SF))
    shards = collections.defaultdict(list)
    for doc_id, text in texts.items():
        r, body = got[doc_id], (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), "rows", None)
        shards[r["shard"]].append(r["slot"])
    assert set(shards) <= set(range(24))
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())
    counts = [len(shards[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1


def test_op7(spark, texts):
    windows = collections.defaultdict(set)
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(ALNUM, item["text"])
        for i in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[i : i + 10])].add(item["item_id"])
    sizes = sorted({len(w) for w in windows})
    got = by_id(llm_queries.op7_benchmark_decontamination(spark, SF))
    hit_docs = 0
    for doc_id, text in texts.items():
        w = words(ALNUM, text)
        hit, items = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    items |= found
        r = got[doc_id]
        names = ",".join(sorted(map(str, items)))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(names.encode()).hexdigest()
        hit_docs += bool(hit)
    assert hit_docs


def test_op10(spark, texts):
    tokens = {d: [*words(SPACE, t), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count = collections.Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    total, kinds = sum(count.values()), len(count)
    got = by_id(llm_queries.op10_lm_scoring(spark, SF))
    better = []
    for doc_id, ws in tokens.items():
        r = got[doc_id]
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[doc_id], len(ws), sum(w in count for w in ws), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
        if held[doc_id]:
            better.append(r["score"] - base)
    assert sum(better) > 0
