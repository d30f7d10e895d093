"""The text operators against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from exprlake.llm import decontaminate, jaccard, licenses, ngram_model, packing, passages, quality, repeats, secrets, sharding
from exprlake.llm import queries as llm_queries
from exprlake.llm import textkit as tk

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, n_words string, row int"


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Texts with copies, edits, shared passages, nulls, empty texts, ties and columns of clashing names."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdeé", k=draw.randint(1, 6))) for _ in range(300)]
    passage = " ".join(draw.choices(vocabulary, k=70))
    texts: list[str | None] = [None, "", "   ", "one", "One two", "\n\n", "x" * 5000]
    for _ in range(n):
        kind, words = draw.random(), draw.choices(vocabulary, k=draw.randint(3, 150))
        if kind < 0.2 and len(texts) > 10:
            texts.append(texts[draw.randrange(7, len(texts))])
        elif kind < 0.5 and len(texts) > 10:
            old = texts[draw.randrange(7, len(texts))].split(" ")
            old[draw.randrange(len(old))] = "edit"
            texts.append(" ".join(old))
        elif kind < 0.7:
            texts.append(" ".join(words[:20]) + " " + passage + "\n" + " ".join(words[20:]))
        else:
            texts.append(" ".join(words))
    rows = [(i * 3, t, "src", "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[9], rows[12]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


def test_packing(spark, docs, none):
    path = llm_queries.tokenizer_path()
    pieces = packing.tokenize(docs, path, capacity=64)
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path).encode
    packed = packing.pack(pieces, capacity=64, rows_per_group=10).collect()
    ids = collections.defaultdict(dict)
    for r in packed:
        ids[r["doc_id"]][r["piece"]] = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["length"] == len(ids[r["doc_id"]][r["piece"]]) <= 64
    for doc_id, text, *_ in corpus():
        whole = [x for _, piece in sorted(ids[doc_id].items()) for x in piece]
        assert whole == encode(text or "", add_special_tokens=False).ids + [2]
    by_sequence = collections.defaultdict(list)
    for r in packed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 64
    assert len(packed) == pieces.count()
    assert packing.pack(packing.tokenize(none, path)).count() == 0
    assert sum(len(r["ids"]) // 4 for r in packing.sequences(packing.pack(pieces, 64)).collect()) == sum(r["length"] for r in packed)


def test_special_tokens_and_odd_spaces_encode_alike():
    from tokenizers import Tokenizer

    path = llm_queries.tokenizer_path()
    encoder, reference = packing._Encoder(path), Tokenizer.from_file(path)
    for text in ["", " ", "a  b", " a  b ", "x\t\n y", "it's we'll 12 3é", "a <|endoftext|> b"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_best_two_fit():
    draw = random.Random(1)
    counts = collections.Counter(draw.randint(1, 100) for _ in range(3000))
    used = collections.Counter()
    bins = 0
    for lengths, times in packing.plan(dict(counts), 100):
        assert sum(lengths) <= 100
        bins += times
        for length in lengths:
            used[length] += times
    assert used == counts
    # No packing has fewer sequences than there are ids for, or lengths of which no two fit together.
    least = max(math.ceil(sum(k * n for k, n in counts.items()) / 100), sum(n for k, n in counts.items() if k > 50))
    assert least <= bins <= 1.02 * least
    # 60 + 30 leaves 10; 30 gives way to 20 + 20, which fill the gap.
    assert packing.plan({60: 1, 30: 1, 20: 2}, 100)[0][0] == (60, 20, 20)


def near_groups(rows, size, percent):
    sets = []
    for _, text, *_ in rows:
        w = words(SPACE, text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root, links = list(range(len(rows))), collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        union = len(sets[i] | sets[j])
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * union:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, row in enumerate(rows):
        least[find(i)].append(row[0])
    return [(r[0], len(sets[i]), min(least[find(i)]), links[i]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("size,percent,classes", [(3, 90, 8000), (5, 80, 8000), (2, 60, 3)])
def test_jaccard_groups(docs, none, size, percent, classes):
    got = jaccard.jaccard_groups(docs, size, percent, block_classes=classes).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == sorted(near_groups(corpus(), size, percent))
    assert jaccard.jaccard_groups(none).count() == 0
    groups = jaccard.jaccard_groups(docs, size, percent, block_classes=classes, count_links=False).drop("text_hash", "n_links")
    assert sorted(map(tuple, groups.collect())) == sorted(row[:3] for row in near_groups(corpus(), size, percent))


def cut_and_lengthened(size: int, sizes: list[tuple[int, int]]) -> list[tuple]:
    """Pairs of a text and its cut copy, of so many shingles each; texts of different pairs share no word."""
    rows = []
    for k, pair in enumerate(sizes):
        rows += [(2 * k + i, " ".join(f"w{k}x{j}" for j in range(n + size - 1)), "src", "clash", 1) for i, n in enumerate(pair)]
    return rows


@pytest.mark.parametrize(
    "percent,sizes",
    [
        (80, [(8, 10), (100, 124), (124, 155), (200, 247), (250, 200), (1000, 1250), (100, 126)]),
        (60, [(6, 10), (60, 99), (120, 200), (240, 400), (100, 168)]),
        (30, [(3, 10), (30, 99), (120, 400)]),
    ],
)
def test_jaccard_groups_of_cut_copies(spark, percent, sizes):
    rows = cut_and_lengthened(5, sizes)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = jaccard.jaccard_groups(docs, 5, percent).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == sorted(near_groups(rows, 5, percent))


def test_jaccard_groups_without_ids(spark):
    """Rows without a doc_id, and different texts under one, link like any others."""
    text = [f"w{i}" for i in range(60)]
    near = [*text[:30], "edit", *text[31:]]
    rows = [(None, " ".join(text)), (4, " ".join(near)), (None, "a b c d e f"), (7, "g h i j k l"), (7, "m n o p q r"), (None, "a b c d e f")]
    docs = spark.createDataFrame([(d, t, "s", "n", 1) for d, t in rows], SCHEMA)
    got = [(r["doc_id"], r["component_id"], r["n_links"], r["group"]) for r in jaccard.grouped(docs, 1, 90).collect()]
    assert sorted((d is None, d, c, n) for d, c, n, _ in got if c == 4) == [(False, 4, 4, 1), (True, None, 4, 1)]
    assert sorted((str(d), str(c), n) for d, c, n, _ in got if c != 4) == [
        ("7", "7", 0), ("7", "7", 0), ("None", "None", 1), ("None", "None", 1)
    ]
    assert len({g for *_, g in got}) == 4


@pytest.mark.parametrize("bits", [0, 3])
def test_shared_prefixes(spark, bits, monkeypatch):
    """Sets that are near enough have a key in common; elements of one set alone are none."""
    from exprlake.llm import prefixes

    monkeypatch.setattr(prefixes, "shard_bits", lambda docs: bits)
    draw = np.random.default_rng(3)
    base = [draw.integers(0, 2**63, 120).astype(np.uint64) for _ in range(6)]
    sets = [np.unique(np.r_[b[draw.random(120) < 0.95], draw.integers(0, 2**63, 6).astype(np.uint64)]) for b in base for _ in range(8)]
    rows = []
    for batch in range(4):
        some = sets[batch::4]
        of = np.repeat(np.arange(len(some)), [len(s) for s in some])
        packed = prefixes.pack(np.arange(len(some), dtype=np.uint64) * np.uint64(4) + np.uint64(batch), np.concatenate(some), of, bits)
        rows.append((batch, *[v if isinstance(v, bytes) else v.to_pylist() for v in packed.values()]))
    keys = prefixes.shared_prefixes(spark.createDataFrame(rows, f"batch long, {prefixes.COLUMNS}"), Fraction(8, 10))
    held = collections.defaultdict(set)
    for r in keys.collect():
        held[r["class"]].add(r["key"])
    near = 0
    for i, j in itertools.combinations(range(len(sets)), 2):
        if 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j])):
            near += 1
            assert held[i] & held[j]
    assert near > 50
    assert all(sum(k in keys for keys in held.values()) > 0 for k in set().union(*held.values()))


def test_divide_skip():
    draw = np.random.default_rng(0)
    sets = [np.unique(draw.integers(0, 40, draw.integers(1, 30))) for _ in range(80)]
    a, b = jaccard.divide_skip(
        np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(80), [len(s) for s in sets]), 80, Fraction(6, 10)
    )
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = {
        (i, j)
        for i, j in itertools.combinations(range(80), 2)
        if 10 * len(np.intersect1d(sets[i], sets[j])) >= 6 * len(np.union1d(sets[i], sets[j]))
    }
    assert got == want and len(got) == len(a)


def roots(pairs, n):
    root = list(range(n))
    for _ in range(n):
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
    return root


def test_divide_skip_spanning(monkeypatch):
    draw = np.random.default_rng(1)
    monkeypatch.setattr(jaccard, "SETTLE", 7)
    monkeypatch.setattr(jaccard, "FIRST", 2)
    for round_ in range(30):
        monkeypatch.setattr(jaccard, "HEAP_ENTRIES", round_ * 10)
        base = [np.unique(draw.integers(0, 400, 40)) for _ in range(4)]
        sets = [np.unique(draw.permutation(base[draw.integers(4)])[: draw.integers(1, 40)]) for _ in range(70)]
        flat = np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(70), [len(s) for s in sets]), 70, Fraction(8, 10)
        every = list(zip(*map(np.ndarray.tolist, jaccard.divide_skip(*flat))))
        some = list(zip(*map(np.ndarray.tolist, jaccard.divide_skip(*flat, spanning=True))))
        assert {tuple(sorted(x)) for x in some} <= {tuple(sorted(x)) for x in every}
        assert roots(every, 70) == roots(some, 70) and len(some) < 70


def test_statistics_and_rules(spark, docs, none):
    got = {r["doc_id"]: r for r in quality.statistics(docs).collect()}
    for doc_id, text, *_ in corpus():
        text = text or ""
        w = SPACE.findall(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {x for x, n in collections.Counter(windows).items() if n > 1}
        covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int")
    stats = quality.statistics(docs, carry=True)
    rules = quality.learn(stats, labels)
    judged = quality.judge(stats, rules)
    assert judged.filter("kept and base_failed").count() == 0
    assert judged.select("row.*").columns == docs.columns
    assert quality.learn(stats, labels.limit(0)).rules == ()
    assert quality.statistics(none).count() == 0


def test_rules_are_learned():
    draw = np.random.default_rng(2)
    x = {f: draw.random(3000) for f in quality.FEATURES}
    bad = (x["symbols_per_word"] > 0.8) & (x["word_length"] <= 0.5) | (x["digit_share"] > 0.9)
    rules = quality.cover(x, bad)
    rejected = np.zeros(3000, bool)
    for rule in rules.rules:
        rejected |= quality._covered(rule, x)
    assert (rejected == bad).mean() > 0.95 and rules.text()


def test_repeats(docs, none):
    rows = corpus()
    held = collections.defaultdict(lambda: 10**9)
    for doc_id, text, *_ in rows:
        body = (text or "").encode()
        for k in range(len(body) - 49):
            held[body[k : k + 50]] = min(held[body[k : k + 50]], doc_id)
    want = []
    for doc_id, text, *_ in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for k in range(len(body) - 49):
            if held[body[k : k + 50]] < doc_id:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(body, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((doc_id, len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    got = repeats.remove_repeats(docs).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert repeats.remove_repeats(none).count() == 0


def test_run_index():
    draw = random.Random(5)
    base = [bytes(draw.choices(b"ab", k=80)) for _ in range(4)]
    texts = []
    for _ in range(150):
        x = bytearray(draw.choice(base))
        x[draw.randrange(80)] = draw.choice(b"abc")
        texts.append(bytes(x[: draw.choice([80, 60, 50, 20])]))
    owner = np.array([draw.randrange(40) for _ in texts])
    data = np.zeros((150, 80), np.uint8)
    for i, t in enumerate(texts):
        data[i, : len(t)] = np.frombuffer(t, np.uint8)
    got = repeats._covered(data, np.array([len(t) for t in texts]), owner)
    for i, o in itertools.product(range(150), range(31)):
        want = o + 50 <= len(texts[i]) and any(owner[j] < owner[i] and texts[i][o : o + 50] in u for j, u in enumerate(texts))
        assert got[i, o] == want


def test_sharding(docs, none):
    got = sharding.shuffle_into_shards(docs, 7, rows_per_group=5).collect()
    assert len(got) == len(corpus())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in corpus())
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shuffle_into_shards(none, 7).count() == 0


def test_hypergeometric_law():
    draw = random.Random(4)
    found = [sharding.hypergeometric(draw, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(found) / 4000 - 6) < 0.1
    assert abs(np.var(found) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert 0 < sharding.hypergeometric(draw, 10**12, 10**12, 10**9) < 10**9
    matrix = sharding.communication_matrix([5, 0, 9], [7, 7], 1)
    assert [sum(r) for r in matrix] == [5, 0, 9] and [sum(c) for c in zip(*matrix)] == [7, 7]


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_contamination(spark, docs, none, block):
    texts = [t for _, t, *_ in corpus()]
    items = [(1, " ".join(words(ALNUM, texts[20])[:14])), (2, texts[30].upper()), (3, "One"), (4, None), (5, "edit nothing here")]
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(ALNUM, text)
        for k in range(len(w) - 9 if len(w) >= 10 else min(len(w), 1)):
            windows[tuple(w[k : k + 10])].add(item)
    want = []
    for doc_id, text, *_ in corpus():
        w = words(ALNUM, text)
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        want.append((doc_id, len(w), len(hit), sorted(found)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(docs, bench, block_windows=block).collect()
    got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), sorted(r["items"])) for r in rows]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)
    assert decontaminate.contamination(none, bench).count() == 0


def test_passages(docs, none):
    got = passages.fuzzy_passages(docs).collect()
    text = {d: words(ALNUM, t) for d, t, *_ in corpus()}
    first: dict = {}
    for d in sorted(text):
        for k in range(len(text[d]) - 59):
            first.setdefault(tuple(text[d][k : k + 60]), d)
    repeated = {d for d in text for k in range(len(text[d]) - 59) if first[tuple(text[d][k : k + 60])] < d}
    assert repeated <= {r["doc_id"] for r in got}
    for r in got:
        assert r["source_id"] < r["doc_id"]
        a = text[r["doc_id"]][r["first"] : r["end"]]
        b = text[r["source_id"]][r["source_first"] : r["source_end"]]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert abs(table[-1][-1] - r["n_common"]) <= 2  # ends that grew may align better with the middle
    assert passages.fuzzy_passages(none).count() == 0


def test_shingles_of_a_block_are_made_some_texts_at_a_time():
    rng = np.random.default_rng(1)
    texts = [None, "", *(" ".join(map(str, rng.integers(0, 30_000, 400))) for _ in range(3500))]
    table = pa.table({"text": pa.chunked_array([texts[:900], texts[900:]])})
    peaks, found = [], []
    for make in (lambda: jaccard.shingle_sets(*tk.text_buffer(table["text"]), 5), lambda: jaccard.sets_of(table, 5)):
        tracemalloc.start()
        found.append(make())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(*found)) and len(found[1][0]) > 1_000_000
    assert peaks[1] < 0.6 * peaks[0]


def test_passages_edited_in_any_way_and_held_in_parts_by_others(spark):
    rng = random.Random(5)
    noise = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, want = [], []

    def hold(*passages):
        for p in passages:
            rows.append((len(rows), " ".join(noise(20) + p + noise(25))))
        want.append((len(rows) - 1, len(rows) - 2))

    for size, share in ((36, 0.1), (37, 0.18), (50, 0.15), (100, 0.15)):
        for _ in range(12):
            p = noise(size)
            changed = rng.sample(range(size), int(size * share))
            hold(p, [f"x{rng.randrange(10**9)}" if i in changed else w for i, w in enumerate(p)])
    for _ in range(12):
        p = noise(37)
        q = [w for i, w in enumerate(p) if i % 5 != 3]  # 30 stay, and 7 others come between
        for i in range(1, 8):
            q.insert(5 * i - 2, f"y{rng.randrange(10**9)}")
        hold(p, q)
        p = noise(60)
        hold(p[:28], p[32:], p, p)
    rows.append((len(rows), rows[0][1].upper()))
    want.append((len(rows) - 1, 0))
    found = passages.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert set(want) <= {(r["doc_id"], r["source_id"]) for r in found}
    for r in found:
        size = max(r["end"] - r["first"], r["source_end"] - r["source_first"])
        assert r["n_common"] >= 30 and r["n_common"] >= 0.8 * size and r["identity"] == r["n_common"] / size


def test_chains_advance_on_both_sides():
    x, y = np.array([0, 5, 8, 10, 12, 15]), np.array([0, 5, 8, 3, 12, 90])
    assert passages.chain(x, y)[0] == [0, 1, 2, 4]
    assert passages.common_words(np.array([1, 2, 3, 4, 5]), np.array([1, 9, 3, 5])) == 3


def test_licenses(spark, docs, none):
    rows = [
        (1, "Intro.\nLicensed under the Apache License, Version 2.0.\nMore text"),
        (2, "Released under the MIT License. Licensed under CC BY-NC 4.0."),
        (3, None),
        (4, ""),
        (5, "This license is nothing known."),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["n_matches"]) for r in licenses.licenses(frame).collect()}
    assert got == {(1, "Apache-2.0", 1), (2, "MIT", 1), (2, "CC-BY-NC-4.0", 1)}
    bsd = [s for s, i in licenses.SENTENCES.items() if i.startswith("BSD_")]
    one = spark.createDataFrame([(7, ". ".join(bsd) + ". ")], "doc_id long, text string")
    assert [r["license"] for r in licenses.licenses(one).collect()] == ["BSD-3-Clause"]
    assert licenses.licenses(none).count() == 0 and licenses.licenses(docs).count() == 0


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
}
WRAPPED["BSD-3-Clause"] = WRAPPED["BSD-2-Clause"] + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_wrapped_licenses(spark):
    rows, want = [], set()
    for name, text in WRAPPED.items():
        # Bare, with DOS line ends, and behind the leaders of comments; all after a line without an end.
        forms = [text, text.replace("\n", "\r\n"), " ".join(text.split())]
        forms += ["".join(f"{c}{line}\n" for line in text.splitlines()) for c in ("# ", " * ", "// ", ";; ", "REM ", "    ")]
        for form in forms[:2] + forms[3:] if name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0") else forms:
            want.add((len(rows), name))
            rows.append((len(rows), "file of someone\n" + form))
    # A blank line, or the end of a sentence, still ends it; a word before or after it makes it another.
    split = WRAPPED["ISC"].replace("any\n", "any\n\n"), "released under\n\nthe MIT License", "not the MIT License", "the MIT. License"
    rows += [(len(rows) + i, text) for i, text in enumerate(split)]
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == want | {(len(rows) - 3, "MIT")}


def test_secrets(spark, none):
    draw = random.Random(9)
    rows, planted = [], set()
    for i in range(200):
        key = "".join(draw.choices("0123456789abcdef", k=40))
        text = f"plain words and incomprehensibilities number {draw.randrange(10**15, 10**16)} here"
        if i % 2:
            text += f' token = "{key}" end'
            planted.add((i, text.index(key)))
        rows.append((i, text, "src"))
    rows += [(900, None, "src"), (901, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.scan(frame)
    assert {(r["doc_id"], r["start"]) for r in found.filter("is_secret").collect()} == planted
    clean = secrets.redact(frame, found)
    assert clean.columns == frame.columns and clean.count() == len(rows)
    assert clean.filter("text like '%<SECRET>%'").count() == 100
    assert secrets.scan(none).count() == 0


def test_short_and_dotted_secrets(spark):
    draw = random.Random(5)
    rows, values = [], {}
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for i in range(240):
        key = lambda n: "".join(draw.choices(alnum, k=n - 1)) + "7"  # noqa: E731, B023
        forms = [
            ('password = "{}"', f"Winter{draw.randrange(1000, 9999)}!"),
            ("api_key: {}", key(12)),
            ("MY_SERVICE_DB_PASSWORD={}", f"p@ss#w0rd${key(4)}"),
            ("pwd='{}'", f"tr0ub4dor.{key(3)}"),
            ('token = "{}"', f"{key(20)}.{key(30)}.{key(25)}"),
            ('secret = "{}"', key(22) + "=="),
            ("the commit was {}", None),
            ("{}", None),
        ]
        form, value = forms[i % len(forms)]
        shown = form.format(value if value else "incomprehensibilities")
        rows.append((i, f"some plain words here\n{shown}\nand more words follow", "src"))
        if value:
            values[i] = value
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.scan(frame)
    secret = {(r["doc_id"], r["start"], r["value"]) for r in found.filter("is_secret").collect()}
    assert secret == {(i, rows[i][1].index(v), v) for i, v in values.items()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(frame, found).collect()}
    assert all(clean[i] == text.replace(values.get(i, "\0"), "<SECRET>") for i, text, _ in rows)


def test_pair_model(docs, none):
    rows = corpus()
    train = [r for r in rows if r[0] % 2]
    model = ngram_model.fit(docs.filter("doc_id % 2 = 1"))
    texts = {d: words(SPACE, t) + ["\0"] for d, t, *_ in rows}
    count, pairs = collections.Counter(), collections.Counter()
    for d, *_ in train:
        count.update(texts[d])
        pairs.update(zip(["\1", *texts[d][:-1]], texts[d]))
    before, total, back = (collections.Counter() for _ in range(3))
    d2, d1 = [0, *model.discounts], [0, *model.word_discounts]
    for (h, w), n in pairs.items():
        before[w] += 1
        total[h] += n
        back[h] += d2[min(n, 3)]
    assert (model.tokens, model.distinct, model.pair_types) == (sum(count.values()), len(count), len(pairs))
    of = collections.Counter(pairs.values())
    y = of[1] / (of[1] + 2 * of[2])
    assert model.discounts[0] == pytest.approx(1 - 2 * y * of[2] / of[1])
    spread = sum(d1[min(n, 3)] for n in before.values()) / len(pairs)
    for r in ngram_model.score(docs, model).collect():
        t = texts[r["doc_id"]]
        base = sum(math.log10((count[w] + 1) / (model.tokens + len(count) + 1)) for w in t)
        score = 0.0
        for h, w in zip(["\1", *t[:-1]], t):
            p = (before[w] - d1[min(before[w], 3)]) / len(pairs) + spread / (len(count) + 1)
            if total[h]:
                p = (pairs[h, w] - d2[min(pairs[h, w], 3)]) / total[h] + back[h] / total[h] * p
            score += math.log10(p)
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(count[w] > 0 for w in t))
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    empty = ngram_model.fit(none)
    assert ngram_model.score(docs, empty).count() == len(rows) and ngram_model.score(none, model).count() == 0
