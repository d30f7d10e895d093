"""Interpolated modified Kneser-Ney model of word pairs.

Workers count a batch of texts at a time and send sorted arrays of (context, follower, count) to shards by
the hash of the context.  A shard sums what it gets; that is the model: rows of sorted hash arrays, as many
as the corpus needs.  Every word is followed by a word or the end mark, so a word's own count is the sum of
its followers' counts.  To score, batches send the distinct pairs they hold to the same shards; there a
worker maps the shard's arrays into memory, searches them, and sends counts back.  So neither the
vocabulary nor the pairs have to fit one machine.

Words are told apart by 64-bit hashes, followers within pairs by the leading 40 bits of them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textkit as tk

BATCH_TOKENS = 1_500_000
# Characters of training text for each shard.
SHARD_CHARS = 16 << 20
END = np.uint64(0xE4D0E4D0E4D0E4D1)
BEGIN = np.uint64(0xBE61BE61BE61BE61)

_SENT = "batch long, shard int, ids array<long>, a binary, b binary, c binary"
TOKENS = -1  # in place of a shard: the batch itself
_CODEC = "zstd"


def _squeeze(x: np.ndarray) -> bytes:
    """Small numbers, byte by byte and compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), _CODEC, asbytes=True)


def _expand(data) -> np.ndarray:
    n = int.from_bytes(bytes(data[:8]), "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, _CODEC, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    """The leading 40 bits of hashes, 5 bytes each."""
    x = x >> np.uint64(24)
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype(np.uint8).tobytes()


def _unpack(data) -> np.ndarray:
    n = len(data) // 5
    low = np.frombuffer(data, "<u4", n).astype(np.uint64)
    return (np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32) | low) << np.uint64(24)


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes, so sorted hashes stay sorted across them."""
    return ((x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


@dataclass
class _Batch:
    """Tokens of some documents: their contexts, and for each its followers, in hash order."""

    part: int
    ids: list
    lengths: np.ndarray
    contexts: np.ndarray
    sizes: np.ndarray
    follower: np.ndarray
    count: np.ndarray
    word_of: np.ndarray


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    ids: list = []
    lengths: list[np.ndarray] = []
    tokens: list[np.ndarray] = []
    size = part = 0
    for batch in tk.slices(batches):
        part = tk.column(batch, "part")[0].as_py()
        raw, at = tk.text_buffer(tk.column(batch, "text"))
        raw = tk.LOWER[raw]
        starts, ends, row = tk.spans(raw, at, tk.NOT_SPACE)
        count = np.bincount(row, minlength=batch.num_rows)
        out = np.full(len(row) + batch.num_rows, END, np.uint64)
        out[np.arange(len(row)) + row] = tk.hash_spans(raw, starts, ends)
        ids += tk.column(batch, "doc_id").to_pylist()
        lengths.append(count + 1)
        tokens.append(out)
        size += len(out)
        if size >= BATCH_TOKENS:
            yield _counted(part, ids, np.concatenate(lengths), np.concatenate(tokens))
            ids, lengths, tokens, size = [], [], [], 0
    if ids:
        yield _counted(part, ids, np.concatenate(lengths), np.concatenate(tokens))


def _pair_keys(word_of: np.ndarray, lengths: np.ndarray, begin: int, contexts: int) -> np.ndarray:
    """One number for each token and the token before it, by their places among all contexts."""
    before = np.empty(len(word_of), np.uint64)
    before[1:] = word_of[:-1]
    before[np.cumsum(lengths) - lengths] = begin
    return before * np.uint64(contexts) + word_of.astype(np.uint64)


def _counted(part: int, ids: list, lengths: np.ndarray, tokens: np.ndarray) -> _Batch:
    # The begin mark is a context, and the end mark is kept among them as a context without followers.
    words, word_of = np.unique(np.r_[tokens, BEGIN], return_inverse=True)
    word_of = word_of[:-1]
    keys = _pair_keys(word_of, lengths, int(np.searchsorted(words, BEGIN)), len(words))
    pairs, count = np.unique(keys, return_counts=True)
    at, of = np.divmod(pairs, np.uint64(len(words)))
    sizes = np.bincount(at.astype(np.int64), minlength=len(words))
    return _Batch(part, ids, lengths, words, sizes, words[of], count, word_of)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names = ["batch", "shard", "ids", "a", "b", "c"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _pair_rows(batch: int, b: _Batch, shards: int, counts: bool) -> Iterator[tuple]:
    """a: contexts; b: followers of each, then counts if asked for; c: followers."""
    cuts = np.searchsorted(_shard(b.contexts, shards), np.arange(shards + 1))
    begin = np.r_[0, np.cumsum(b.sizes)]
    for s in np.flatnonzero(np.diff(cuts)):
        x, y = slice(cuts[s], cuts[s + 1]), slice(begin[cuts[s]], begin[cuts[s + 1]])
        numbers = np.r_[b.sizes[x], b.count[y]] if counts else b.sizes[x]
        yield batch, int(s), None, b.contexts[x].tobytes(), _squeeze(numbers), _pack(b.follower[y])


def _read_pairs(a, b, c) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, followers of each, follower words, and their counts if there are any."""
    contexts, numbers = np.frombuffer(a, np.uint64), _expand(b)
    return contexts, numbers[: len(contexts)], _unpack(c), numbers[len(contexts) :]


def _texts(docs: DataFrame) -> DataFrame:
    """With the number of the input split, which is the same each time that the same table is read."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("part")
    )


@dataclass(frozen=True)
class Model:
    """A table of sorted hash arrays, and the numbers that the whole corpus gives.

    ``table``: shard, contexts (hashes), begins (where the followers of each begin), numbers (for each
    context its count, the kinds of followers seen once, twice, and more often, and the kinds of words
    before it), followers (hashes), counts.
    """

    table: DataFrame
    shards: int
    documents: int
    tokens: int
    distinct: int
    pair_types: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    spread: float


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9  # too little text for the estimate
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    # Something always has to be left for what was not seen.
    return tuple(min(max(d, 0.1), k) for d, k in zip(found, (1.0, 2.0, 3.0)))


def _of_counts(count: np.ndarray) -> list[int]:
    found = np.bincount(np.minimum(count, 5), minlength=6)
    return [int(n) for n in found[1:5]]


def fit(docs: DataFrame, shard_chars: int = SHARD_CHARS) -> Model:
    """Count all words and pairs of ``docs`` (doc_id, text).

    A null or empty text is its end mark alone.  An empty table gives a model in which every word is
    unknown.  Other columns are ignored.
    """
    texts = _texts(docs)
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(12, -(-chars // shard_chars))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            yield _record(list(_pair_rows(0, b, shards, True)))

    def sum_up(table: pa.Table) -> pa.Table:
        parts = [_read_pairs(*(table[c][i].as_buffer() for c in "abc")) for i in range(table.num_rows)]
        contexts = np.unique(np.concatenate([p[0] for p in parts]))
        at = np.concatenate([np.repeat(np.searchsorted(contexts, p[0]).astype(np.uint32), p[1]) for p in parts])
        follower, n = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        del parts
        order = np.lexsort((follower, at))
        at, follower, n = at[order], follower[order], n[order]
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (follower[1:] != follower[:-1])][: len(at)])
        n = np.add.reduceat(n, new) if len(new) else n
        at, follower = at[new], follower[new]
        begin = np.searchsorted(at, np.arange(len(contexts) + 1))
        rows = [_sums(at, n, len(contexts))] + [np.bincount(at[k], minlength=len(contexts)) for k in (n == 1, n == 2, n > 2)]
        return _shard_row(table["shard"][0].as_py(), contexts, begin, np.stack(rows), follower, n, _of_counts(n))

    counted = texts.mapInArrow(count, _SENT).groupBy("shard").applyInArrow(sum_up, _SUMMED)
    counted = materialize(counted, "counts")

    def words_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                word, n = np.unique(_unpack(tk.column(batch, "followers")[i].as_buffer()), return_counts=True)
                cuts = np.searchsorted(_shard(word, shards), np.arange(shards + 1))
                rows = []
                for s in np.flatnonzero(np.diff(cuts)):
                    x = slice(cuts[s], cuts[s + 1])
                    rows.append((0, int(s), None, _pack(word[x]), _squeeze(n[x]), None))
                yield _record(rows)

    def join(sent, held):
        if not held.num_rows:
            return held
        r = _read_shard(held)
        before = np.zeros(len(r.contexts), np.int64)
        for i in range(sent.num_rows):
            # Words that agree in 40 bits share what comes before them.
            of = np.searchsorted(r.contexts >> np.uint64(24), _unpack(sent["a"][i].as_buffer()) >> np.uint64(24))
            np.add.at(before, of, _expand(sent["b"][i].as_buffer()))
        words = r.contexts != BEGIN
        of_before = _of_counts(before[words])
        return _shard_row(r.shard, r.contexts, r.begin, np.stack([*r.numbers[:4], before]), r.followers, r.counts, of_before)

    before = counted.select("followers").mapInArrow(words_before, _SENT).groupBy("shard")
    table = materialize(before.cogroup(counted.groupBy("shard")).applyInArrow(join, _SUMMED), "pair-model")
    of = ["n1", "n2", "n3", "n4", "types", "total", "n_contexts"]
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in of]
    p, w = counted.agg(*sums).first(), table.agg(*sums).first()
    pair_types, documents = int(p[4]), int(texts.count())
    distinct = max(0, int(w[6]) - 1)  # all contexts but the begin mark
    d = _discounts(*w[:4])
    left = d[0] * w[0] + d[1] * w[1] + d[2] * max(0, distinct - w[0] - w[1])
    return Model(
        table, shards, documents, int(p[5]), distinct, pair_types, _discounts(*p[:4]), d,
        left / pair_types if pair_types else 1.0,
    )


_SUMMED = (
    "shard int, contexts binary, begins binary, numbers binary, followers binary, counts binary, "
    "n1 long, n2 long, n3 long, n4 long, types long, total long, n_contexts long"
)


def _sums(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, n, size).astype(np.int64)


def _shard_row(shard, contexts, begin, numbers, follower, n, of_counts) -> pa.Table:
    names = [f.split()[0] for f in _SUMMED.split(", ")]
    values = [
        shard, contexts.tobytes(), begin.astype("<i8").tobytes(), numbers.astype("<i8").tobytes(),
        _pack(follower), n.astype("<u4").tobytes(), *of_counts, len(n), int(n.sum()), len(contexts),
    ]
    kinds = [pa.int32()] + [pa.binary()] * 5 + [pa.int64()] * 7
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=names)


@dataclass
class _Shard:
    shard: int
    contexts: np.ndarray
    begin: np.ndarray
    numbers: np.ndarray
    followers: np.ndarray
    counts: np.ndarray


def _read_shard(held: pa.Table) -> _Shard:
    """Sorted arrays of a shard, mapped from a file of their own."""
    maps = {c: _mapped(held[c][0].as_buffer()) for c in ("contexts", "begins", "numbers", "followers", "counts")}
    contexts = maps["contexts"].view(np.uint64)
    numbers = maps["numbers"].view("<i8").reshape(-1, len(contexts))
    counts = maps["counts"].view("<u4")
    return _Shard(
        held["shard"][0].as_py(), contexts, maps["begins"].view("<i8"), numbers, _unpack(maps["followers"].data), counts
    )


def _mapped(data) -> np.ndarray:
    """Bytes as a memory-mapped file that goes away with its last user."""
    size = len(memoryview(data))
    if not size:
        return np.zeros(0, np.uint8)
    with tempfile.TemporaryFile() as file:
        file.write(data)
        file.flush()
        return np.memmap(file, np.uint8, "r", shape=(size,))


def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every document.

    ``score`` is the log10 probability of the words and the end mark, ``base_score`` that of single
    words with one added to each count, ``n_known`` the tokens that the model has seen.  A null or empty
    text is the end mark alone.  ``docs`` is read twice and has to give the same rows each time;
    what comes out of random or moving input is to be written to a table first.
    """
    texts = _texts(docs)
    shards = model.shards
    known = {k: getattr(model, k) for k in ("documents", "tokens", "distinct", "pair_types", "discounts", "word_discounts", "spread")}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(_batches(batches)):
            yield _record(list(_pair_rows((b.part << 32) + k, b, shards, False)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(_batches(batches)):
            begin = int(np.searchsorted(b.contexts, BEGIN))
            check = np.array([begin, len(b.contexts), len(b.follower)], "<i8").tobytes()
            row = ((b.part << 32) + k, TOKENS, b.ids, _squeeze(b.word_of), b.lengths.astype("<i8").tobytes(), check)
            yield _record([row])

    def answer(asked, held):
        rows = []
        if held.num_rows:
            r = _read_shard(held)
            # One sorted key for a pair: the place of its context, then its follower.
            sizes = np.diff(r.begin)
            key = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(40) | r.followers >> np.uint64(24)
        for i in range(asked.num_rows):
            contexts, sizes, follower, _ = _read_pairs(*(asked[c][i].as_buffer() for c in "abc"))
            numbers, count = np.zeros((5, len(contexts)), np.int64), np.zeros(len(follower), np.int64)
            if held.num_rows:
                at = np.searchsorted(r.contexts, contexts)
                there = at < len(r.contexts)
                there[there] = r.contexts[at[there]] == contexts[there]
                numbers[:, there] = r.numbers[:, at[there]]
                wanted = np.repeat(np.where(there, at, 0), sizes).astype(np.uint64) << np.uint64(40) | follower >> np.uint64(24)
                at = np.searchsorted(key, wanted)
                there = np.repeat(there, sizes) & (at < len(key))
                there[there] = key[at[there]] == wanted[there]
                count[there] = r.counts[at[there]]
            rows.append((asked["batch"][i].as_py(), asked["shard"][i].as_py(), None, _squeeze(numbers.ravel()), _squeeze(count), None))
        return pa.Table.from_batches([_record(rows)])

    def combine(table: pa.Table) -> pa.Table:
        return _scored(table, **known)

    asked = texts.mapInArrow(ask, _SENT).groupBy("shard")
    answers = asked.cogroup(model.table.groupBy("shard")).applyInArrow(answer, _SENT)
    own = texts.mapInArrow(keep, _SENT)
    return answers.union(own).groupBy("batch").applyInArrow(
        combine, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )


def _scored(table: pa.Table, documents, tokens, distinct, pair_types, discounts, word_discounts, spread) -> pa.Table:
    shard = table["shard"].to_numpy()
    own = int(np.flatnonzero(shard == TOKENS)[0])
    order = [int(i) for i in np.argsort(shard) if i != own]
    numbers = np.concatenate([_expand(table["a"][i].as_buffer()).reshape(5, -1) for i in order], axis=1)
    count = np.concatenate([_expand(table["b"][i].as_buffer()) for i in order])
    begin, contexts, pairs = np.frombuffer(table["c"][own].as_buffer(), "<i8")
    if numbers.shape[1] != contexts or len(count) != pairs:
        raise ValueError("the documents changed between two reads; write them to a table first")
    word_of = _expand(table["a"][own].as_buffer())
    lengths = np.frombuffer(table["b"][own].as_buffer(), "<i8")
    total, once, twice, more, before = numbers
    back = discounts[0] * once + discounts[1] * twice + discounts[2] * more
    gamma = np.divide(back, total, out=np.ones(len(total)), where=total > 0)
    if pair_types:
        alone = (before - _discount(before, word_discounts)) / pair_types + spread / (distinct + 1)
    else:
        alone = np.full(len(total), 1 / (distinct + 1))
    # A word is seen as often as it is followed; only the end mark is not, which ends every document.
    seen = total.copy()
    seen[word_of[np.cumsum(lengths)[0] - 1]] = documents
    key, pair_of = np.unique(_pair_keys(word_of, lengths, int(begin), int(contexts)), return_inverse=True)
    at, of = (x.astype(np.int64) for x in np.divmod(key, np.uint64(contexts)))
    direct = np.divide(count - _discount(count, discounts), total[at], out=np.zeros(len(count)), where=total[at] > 0)
    log_p = np.log10(direct + gamma[at] * alone[of])
    log_base = np.log10((seen + 1) / (tokens + 1 * (distinct + 1)))
    first = np.cumsum(lengths) - lengths
    return pa.table(
        {
            "doc_id": pa.array(table["ids"][own].as_py(), pa.int64()),
            "n_tokens": pa.array(lengths),
            "n_known": pa.array(np.add.reduceat((seen[word_of] > 0).astype(np.int64), first)),
            "base_score": pa.array(np.add.reduceat(log_base[word_of], first)),
            "score": pa.array(np.add.reduceat(log_p[pair_of], first)),
        }
    )
