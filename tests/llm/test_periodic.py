"""Periodic runs against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from exprlake.llm import periodic
from exprlake.llm import queries as llm_queries
from tests.compare import TESTDATA

from .test_operators import SCHEMA, SPACE, corpus


def brute(words):
    """All runs: for each period the longest stretches that equal themselves so much further on."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
                if not smaller:
                    out[i, length, q] = True
            i = max(j, i + 1)
    return sorted(out)


def collapse(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    draw = random.Random(5)
    for n in (23, 24, 25, 40, 100, 300):
        yield ["a"] * n
        yield ["a", "b"] * (n // 2)
        yield [draw.choice("ab") for _ in range(n)]
        yield [draw.choice("abc") for _ in range(n)]
        yield [str(draw.randrange(n)) for _ in range(n)]
    for _ in range(150):
        words = []
        for _ in range(draw.randint(1, 5)):
            words += [draw.choice("abcdefgh") for _ in range(draw.randrange(30))]
            period = [draw.choice("abcd") for _ in range(draw.randint(1, 60))]
            words += (period * 8)[: draw.randrange(1, 5 * len(period) + 26)]
        yield words
    for _ in range(20):  # runs of runs
        inner = ["x"] * draw.randint(1, 30) + [draw.choice("yz")]
        yield (inner * 9)[: draw.randrange(20, 9 * len(inner) + 1)] + ["x"] * draw.randrange(40)
    before, last = "a", "ab"
    while len(last) < 300:  # Fibonacci words are rich in runs
        before, last = last, last + before
    yield list(last)


def test_find_runs():
    checked = 0
    for words in texts():
        number: dict[str, int] = {}
        word = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        want = brute(words)
        assert periodic.find_runs(word) == want, words
        kept = periodic.kept_words(len(words), want)
        assert " ".join(w for w, k in zip(words, kept) if k) == collapse(words, want)
        checked += len(want)
    assert checked > 100


def test_every_block_is_convolved(monkeypatch):
    """The sieve before the convolution, and portions, change no result."""
    every = [np.unique(words, return_inverse=True)[1] for words in texts()]
    want = [periodic.find_runs(word) for word in every]
    monkeypatch.setattr(periodic, "_recurs", lambda word, size: np.zeros(len(word) - size + 1, np.int64))
    monkeypatch.setattr(periodic, "PORTION", 64)
    assert [periodic.find_runs(word) for word in every] == want


@pytest.mark.parametrize("size", [2, 8, 64, 1024])
def test_ntt(size):
    draw = np.random.default_rng(1)
    x = draw.integers(0, int(periodic.PRIME), (3, size), dtype=np.uint64)
    assert (periodic.ntt(periodic.ntt(x), inverse=True) == x).all()
    if size <= 64:
        a, b = x[0].tolist(), x[1].tolist()
        want = [sum(a[i] * b[(k - i) % size] for i in range(size)) % int(periodic.PRIME) for k in range(size)]
        product = periodic.ntt(x[:1]) * periodic.ntt(x[1:2]) % periodic.PRIME
        assert periodic.ntt(product, inverse=True)[0].tolist() == want


def test_block_distances():
    draw = np.random.default_rng(2)
    word = draw.integers(0, 2, 400)
    for block, first, last in [(8, 1, 15), (16, 16, 31)]:
        starts = np.arange(0, 400 - block + 1, block)
        at, by = periodic.block_distances(word, starts, block, first, last)
        want = {
            (s, d)
            for s in starts.tolist()
            for d in range(first, last + 1)
            if s + d + block <= 400 and (word[s : s + block] == word[s + d : s + d + block]).all()
        }
        assert set(zip(at.tolist(), by.tolist())) == want


def test_operator(spark):
    rows = corpus() + [(900, "ab cd\n" * 5000 + "end " + "x " * 20, "s", "n", 1), (None, "z " * 30, "s", "n", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit(1))
    got = collections.Counter(
        (r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"])
        for r in periodic.periodic_runs(docs.repartition(3)).collect()
    )
    want = collections.Counter()
    for r in rows:
        words = SPACE.findall(r[1] or "")
        runs = brute(words) if len(words) < 1000 else [(0, 10_000, 2)]
        want[r[0], len(words), tuple(runs), collapse(words, runs)] += 1
    assert got == want
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    sf = f"{TESTDATA}/sf0.001"
    out = llm_queries.op12_periodic_runs(spark, sf)
    types = dict(out.dtypes)
    assert {c for c, t in types.items() if t == "bigint"} == {
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli"
    }
    assert types["runs_sha256"] == types["collapsed_sha256"] == "string"
    got = {r["doc_id"]: r for r in out.collect()}
    found = 0
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got) == out.count()
    for doc_id, text in docs:
        words = SPACE.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        r = got[doc_id]
        if n > 1500:  # brute force is cubic on the longest texts; those are held by the tests above
            continue
        runs = brute(words)
        found += len(runs)
        assert r["n_runs"] == len(runs)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        if best is None:
            assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None
        else:
            assert (r["start"], r["length"], r["period"]) == best
            assert r["exponent_milli"] == 1000 * best[1] // best[2]
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert found > 10
