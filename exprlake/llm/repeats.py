"""Long exact repeats between documents, by a run-length index.

Every 50-byte string holds an anchor: the 20-byte string with the least hash in it.  Equal strings have
equal anchors, so only what lies around anchors that several texts hold has to be compared.  Those contexts
meet by the hash of their anchor.  There each block of contexts becomes a run-compressed Burrows-Wheeler
transform with the places of run ends; the contexts stream through it backwards, and their matching
statistics tell which 50-byte strings a smaller document has as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

LENGTH = 50
ANCHOR = 20
SIDE = LENGTH - ANCHOR
CONTEXT = LENGTH + SIDE
# Bytes of text whose anchors meet in one shard, about, and bytes of contexts in one index.
SHARD_BYTES = 24 << 20
BLOCK_BYTES = 1 << 20
# Bytes of text whose anchors a worker sends at once.
SEND_BYTES = 8 << 20
_SEPARATOR = 0xFF  # no byte of UTF-8


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some short texts, with text places at run ends."""

    def __init__(self, texts: list[bytes] | np.ndarray, owner: np.ndarray, length: int = LENGTH):
        """``texts`` are rows of bytes, or one array in which each ends with a separator; ``owner`` is a
        number for each, and the least owner of every string of ``length`` bytes is kept."""
        if isinstance(texts, list):
            texts = np.frombuffer(b"".join(t + bytes([_SEPARATOR]) for t in texts), np.uint8)
        self.text = texts
        n = len(texts)
        text_of = np.cumsum(texts == _SEPARATOR) - (texts == _SEPARATOR)
        self.words = _words_at(texts)
        places = _suffix_order(self.words, texts)
        last = texts[places - 1]  # the byte before each suffix; the first text is preceded by the last separator
        new = np.r_[True, last[1:] != last[:-1]]
        self.run_start = np.flatnonzero(new)
        self.run_byte = last[self.run_start]
        run_end = np.r_[self.run_start[1:], n] - 1
        self.place_at_start, self.place_at_end = places[self.run_start], places[run_end]
        size = run_end - self.run_start + 1
        self.run_end = run_end
        # For each byte its runs, and how many of that byte come before each run.
        order = np.argsort(self.run_byte, kind="stable")
        total = np.cumsum(size[order]) - size[order]
        self.next_row = np.empty(len(size), np.int64)  # where the first row of a run goes: all smaller bytes, then earlier runs
        self.next_row[order] = total
        self.runs_by_byte = self.run_byte[order].astype(np.int64) * (len(size) + 1) + order
        self.runs_in_order = order
        # Rows whose suffixes share their first bytes form a group; its least owner stands for them.
        same = np.ones(n, bool)
        same[0] = False
        for k in range(0, length - 7, 8):
            same[1:] &= self.words[places[1:] + k] == self.words[places[:-1] + k]
        same[1:] &= self.words[places[1:] + length - 8] == self.words[places[:-1] + length - 8]
        self.group_start = np.flatnonzero(~same)
        self.least_owner = np.minimum.reduceat(owner[text_of[places]], self.group_start)

    def backward(self, byte: np.ndarray, row: np.ndarray, place: np.ndarray, length: np.ndarray):
        """Put ``byte`` before what each query has matched: its new row, place in the text and length."""
        run = np.searchsorted(self.run_start, row, side="right") - 1
        go = self.run_byte[run] == byte
        out_row = self.next_row[run] + (row - self.run_start[run])
        out_place, out_length = place - 1, length + 1
        other = np.flatnonzero(~go)
        if len(other):
            # The nearest runs of the byte before and after; go on from the end that agrees longer.
            key = byte[other].astype(np.int64) * (len(self.run_start) + 1)
            at = np.searchsorted(self.runs_by_byte, key + run[other])
            best = np.full(len(other), -1, np.int64)
            best_row, best_place = np.zeros(len(other), np.int64), np.zeros(len(other), np.int64)
            for step, rows, places in ((-1, self.run_end, self.place_at_end), (0, self.run_start, self.place_at_start)):
                x = np.clip(at + step, 0, len(self.runs_in_order) - 1)
                r = self.runs_in_order[x]
                there = (at + step >= 0) & (at + step < len(self.runs_in_order)) & (self.run_byte[r] == byte[other])
                agree = np.where(there, self._agree(place[other], places[r], length[other]), -1)
                better = agree > best
                best = np.where(better, agree, best)
                best_row, best_place = np.where(better, rows[r], best_row), np.where(better, places[r], best_place)
            found = best >= 0
            run = np.searchsorted(self.run_start, best_row, side="right") - 1
            out_row[other] = np.where(found, self.next_row[run] + (best_row - self.run_start[run]), 0)
            out_place[other] = np.where(found, best_place - 1, self.place_at_start[0])
            out_length[other] = np.where(found, best + 1, 0)
        return out_row, out_place, out_length

    def _agree(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common start of two suffixes, at most ``limit``."""
        out = np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(limit > 0)
        while len(open_):
            at = out[open_]
            differ = self.words[a[open_] + at] ^ self.words[b[open_] + at]
            equal = np.full(len(open_), 8, np.int64)
            for k in range(8):
                equal -= differ >= np.uint64(1 << (8 * k))
            out[open_] += equal
            open_ = open_[(equal == 8) & (out[open_] < limit[open_])]
        return np.minimum(out, limit)

    def owners(self, row: np.ndarray) -> np.ndarray:
        return self.least_owner[np.searchsorted(self.group_start, row, side="right") - 1]


def _words_at(texts: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; zeros follow the end."""
    padded = np.r_[texts, np.zeros(8 + CONTEXT + 8, np.uint8)]
    out = np.zeros(len(padded) - 8, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : len(padded) - 8 + k]
    return out


def _suffix_order(words: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order, by doubling.  Each separator is its own letter, so none are equal."""
    n = len(texts)
    ends = np.flatnonzero(texts == _SEPARATOR)
    next_end = ends[np.searchsorted(ends, np.arange(n))]
    away = np.minimum(next_end - np.arange(n), 8)
    # Cut the first 8 bytes after the separator, and let the separator's number decide between equals.
    keep = np.array([(0xFFFFFFFFFFFFFFFF << (8 * (8 - min(k + 1, 8)))) & 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)
    key = words[:n] & keep[away]
    tie = np.where(away < 8, next_end, -1)
    order = np.lexsort((tie, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (tie[order][1:] != tie[order][:-1])]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # equals share the first of their rows
    width = 8
    while True:
        # Only places whose rank is shared have to be looked at again.
        sorted_rank = rank[order]
        shared = np.r_[sorted_rank[1:] == sorted_rank[:-1], False]
        shared[1:] |= shared[:-1].copy()
        at = np.flatnonzero(shared)
        if not len(at):
            return order
        places = order[at]
        second = rank[np.minimum(places + width, n - 1)]
        pair = sorted_rank[at] * np.int64(n) + second
        again = np.argsort(pair, kind="stable")
        order[at] = places[again]
        pair = pair[again]
        first = sorted_rank[at]
        new = np.r_[True, pair[1:] != pair[:-1]]
        # A place gets the rank of its group, plus how many of the group come before its own equals.
        start_of_equal = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        group = np.r_[True, first[1:] != first[:-1]]
        start_of_group = np.maximum.accumulate(np.where(group, np.arange(len(at)), 0))
        rank[order[at]] = first + start_of_equal - start_of_group
        width *= 2


def _covered(contexts: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each context (row of bytes, its size, its owner) and offset: does a smaller owner hold the
    ``LENGTH`` bytes from there on?"""
    width = contexts.shape[1]
    padded = np.full((len(contexts), width + 1), _SEPARATOR, np.uint8)
    padded[:, :width] = contexts
    inside = np.arange(width + 1)[None, :] <= sizes[:, None]
    padded[np.arange(len(sizes)), sizes] = _SEPARATOR
    index = RunIndex(padded[inside], owner)
    out = np.zeros((len(contexts), width - LENGTH + 1), bool)
    row = np.zeros(len(contexts), np.int64)
    place = np.full(len(contexts), index.place_at_start[0], np.int64)
    length = np.zeros(len(contexts), np.int64)
    for k in range(width - 1, -1, -1):
        live = np.flatnonzero(sizes > k)
        row[live], place[live], length[live] = index.backward(contexts[live, k], row[live], place[live], length[live])
        if k <= width - LENGTH:
            long = live[length[live] >= LENGTH]
            out[long, k] = index.owners(row[long]) < owner[long]
    return out


def _anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, places in the batch's bytes and rows of the anchors of all texts; texts below ``LENGTH``
    bytes have none.  Texts are taken in small pieces, for which the work arrays stay small."""
    out, rows, size = [], 0, 0
    for piece in tk.slices(iter([batch])):
        raw, at = tk.text_buffer(tk.column(piece, "text"))
        out.append([x + k for x, k in zip(_piece_anchors(raw, at), (np.uint64(0), size, rows))])
        rows, size = rows + piece.num_rows, size + len(raw)
    return tuple(np.concatenate(x) for x in zip(*out))


def _piece_anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.empty(n, np.uint64)
    for low in range(0, n, tk.SLICE_BYTES):
        high = min(n, low + tk.SLICE_BYTES)
        hashes[low:high] = tk.rolling(raw[low : high + ANCHOR - 1], ANCHOR)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    whole = np.arange(n) + ANCHOR <= at[row + 1]
    long = np.diff(at) >= LENGTH
    places = np.flatnonzero(whole & long[row])
    hashes, row = hashes[places], row[places]
    chosen = tk.window_minima(hashes, row, SIDE + 1)
    return hashes[chosen], places[chosen], row[chosen]


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    # Anchors have the least hashes of their windows, so nearly all lie in the lowest part of the range.
    return ((tk.mix(hashes) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


_SENT = "shard int, ids array<long>, texts array<long>, counts binary, a binary, b binary, c binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.binary()] * 4
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names = ["shard", "ids", "texts", "counts", "a", "b", "c"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _lists(row: np.ndarray, rows: int, values: np.ndarray) -> pa.Array:
    """Values in row order as one list for each row."""
    offsets = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def repeated_spans(docs: DataFrame, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text, spans) of every document: the byte spans to remove.

    A byte is removed if it lies in a string of 50 bytes that also starts in a document with a smaller
    doc_id.  Strings do not cross documents and are judged on the input.  A null text is empty; a row
    without doc_id is compared with nothing.  Rows that repeat a doc_id are not smaller than each other.
    Columns other than doc_id and text are ignored; an empty table gives no rows.  ``docs`` is read more
    than once.
    """
    # A cast that does nothing would leave an alias in one of the two joins, and the shuffle of the texts that
    # they have in common would not be recognised as one.
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType == T.LongType() else F.col("doc_id").cast("long")
    texts = docs.select(
        doc_id, F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(12, -(-total // shard_bytes))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, limit=SEND_BYTES):
            hashes, _, row = _anchors(batch)
            ids, text = (tk.column(batch, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
            shard = _shard(hashes, shards)
            order = np.lexsort((row, shard))
            hashes, row, cuts = hashes[order], row[order], np.searchsorted(shard[order], np.arange(shards + 1))
            rows = []
            for s in np.flatnonzero(np.diff(cuts)):
                x = slice(cuts[s], cuts[s + 1])
                of, counts = np.unique(row[x], return_counts=True)
                rows.append((int(s), ids[of], text[of], counts.astype("<u4").tobytes(), hashes[x].astype("<u4").tobytes(), None, None))
            yield _sent(rows)

    def several(table: pa.Table) -> pa.Table:
        """Anchors that different texts hold, for the first document of each text."""
        ids, text = (table[c].combine_chunks().flatten().to_numpy() for c in ("ids", "texts"))
        counts, hashes = (np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table[c]]) for c in ("counts", "a"))
        _, text_of = np.unique(text, return_inverse=True)
        of = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(hashes, kind="stable")
        new = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
        t = text_of[of[order]]
        differ = np.minimum.reduceat(t, new) != np.maximum.reduceat(t, new)
        shared = np.zeros(len(hashes), bool)
        shared[order] = np.repeat(differ, np.diff(np.r_[new, len(hashes)]))
        first = np.full(int(text_of.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, text_of, ids)
        shared &= (ids == first[text_of])[of]
        of, hashes = of[shared], hashes[shared]
        held = np.unique(of)
        return pa.table(
            {
                "doc_id": pa.array(ids[held]),
                "text_hash": pa.array(text[held]),
                "anchors": _lists(np.searchsorted(held, of), len(held), hashes.view(np.int32)),
            }
        )

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, limit=SEND_BYTES):
            raw, at = tk.text_buffer(tk.column(batch, "text"))
            hashes, place, row = _anchors(batch)
            ids, text = (tk.column(batch, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
            asked = tk.column(batch, "anchors")
            wanted_row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            wanted = asked.flatten().to_numpy().view(np.uint32).astype(np.uint64) | wanted_row.astype(np.uint64) << np.uint64(32)
            mine = (hashes & np.uint64(0xFFFFFFFF)) | row.astype(np.uint64) << np.uint64(32)
            chosen = np.isin(mine, wanted)
            hashes, place, row = hashes[chosen], place[chosen], row[chosen]
            yield _sent(list(_context_rows(raw, at, hashes, place, row, ids, text, shards)))

    def judge(table: pa.Table) -> pa.Table:
        return _judge(table, block_bytes)

    known = texts.filter("doc_id is not null")
    held = (
        known.mapInArrow(send_anchors, _SENT).groupBy("shard")
        .applyInArrow(several, "doc_id long, text_hash long, anchors array<int>")
        .groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    )
    contexts = known.join(held, ["doc_id", "text_hash"]).mapInArrow(send_contexts, _SENT)
    spans = (
        contexts.groupBy("shard").applyInArrow(judge, "doc_id long, text_hash long, spans array<long>")
        .groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    # Of equal texts all but the first document's go whole.
    sizes = known.select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("bytes"))
    copies = sizes.groupBy("text_hash", "bytes").agg(F.min("doc_id").alias("first"))
    whole = (F.col("doc_id") > F.col("first")) & (F.col("bytes") >= LENGTH)
    facts = (
        sizes.distinct().join(copies, ["text_hash", "bytes"])
        .join(spans, ["doc_id", "text_hash"], "left")
        .select(
            "doc_id", "text_hash",
            F.when(whole, F.array(F.lit(0).cast("long"), "bytes"))
            .otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
        )
    )
    # An inner join like the one above, so that the texts are shuffled once for both.
    judged = known.join(facts, ["doc_id", "text_hash"]).select("doc_id", "text", "spans")
    nameless = texts.filter("doc_id is null").select("doc_id", "text", F.array().cast("array<long>").alias("spans"))
    return judged.union(nameless)


def _context_rows(raw, at, hashes, place, row, ids, text, shards) -> Iterator[tuple]:
    """The bytes around each anchor, equal ones once, dealt by the anchor.

    ``a`` holds for each distinct context its anchor, then bytes before the anchor, size, and how many
    places have it; ``b`` their bytes; ``c`` for each place its document and where the context starts there.
    """
    start = np.maximum(place - SIDE, at[row])
    size = np.minimum(place + LENGTH, at[row + 1]) - start
    left = place - start
    padded = np.r_[raw, np.zeros(CONTEXT, np.uint8)]
    data = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[start]
    data[np.arange(CONTEXT)[None, :] >= size[:, None]] = 0
    whole = _class_hash(hashes, left, data)
    shard = _shard(hashes, shards)
    order = np.lexsort((row, whole, hashes, shard))
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        x = order[cuts[s] : cuts[s + 1]]
        new = np.flatnonzero(np.r_[True, (whole[x][1:] != whole[x][:-1]) | (hashes[x][1:] != hashes[x][:-1])])
        first = x[new]
        counts = np.diff(np.r_[new, len(x)])
        of, of_x = np.unique(row[x], return_inverse=True)
        head = hashes[first].tobytes() + _numbers(left[first], size[first], counts).tobytes()
        tail = np.stack([of_x, start[x] - at[row[x]]]).astype("<u4")
        shown = pa.compress(data[first].tobytes(), "zstd", asbytes=True)
        yield int(s), ids[of], text[of], None, head, shown, tail.tobytes()


def _numbers(left: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.stack([left, size, counts]).astype("<u4")


def _class_hash(anchor: np.ndarray, left: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One number for an anchor and the bytes around it."""
    whole = anchor + left.astype(np.uint64)
    for k in range(0, CONTEXT, 8):
        whole = tk.mix(whole + np.ascontiguousarray(data[:, k : k + 8]).view(np.uint64).ravel())
    return whole


def _judge(table: pa.Table, block_bytes: int) -> pa.Table:
    """Spans (start, end, ...) of documents whose strings a smaller document holds."""
    ids, text = (table[c].combine_chunks().flatten().to_numpy() for c in ("ids", "texts"))
    anchors, numbers, contexts = [], [], []
    for a, b in zip(table["a"], table["b"]):
        n = len(a.as_buffer()) // 20
        anchors.append(np.frombuffer(a.as_buffer(), np.uint64, n))
        numbers.append(np.frombuffer(a.as_buffer(), "<u4", 3 * n, 8 * n).reshape(3, n))
        contexts.append(np.frombuffer(pa.decompress(b.as_buffer(), n * CONTEXT, "zstd"), np.uint8).reshape(n, CONTEXT))
    anchor, data = np.concatenate(anchors), np.concatenate(contexts)
    left, size, counts = np.concatenate(numbers, axis=1).astype(np.int64)
    whole = _class_hash(anchor, left, data)
    tails = [np.frombuffer(x.as_buffer(), "<u4").reshape(2, -1).astype(np.int64) for x in table["c"]]
    shift = np.cumsum([0, *(len(x.as_py()) for x in table["ids"])])
    doc = np.concatenate([t[0] + k for t, k in zip(tails, shift)])
    start = np.concatenate([t[1] for t in tails])
    context = np.repeat(np.arange(len(size)), counts)
    # Equal contexts of all senders become one class with its least document.
    order = np.lexsort((whole, anchor))
    new = np.r_[True, (anchor[order][1:] != anchor[order][:-1]) | (whole[order][1:] != whole[order][:-1])]
    class_of = np.empty(len(order), np.int64)
    class_of[order] = np.cumsum(new) - 1
    sample = order[new]
    member = class_of[context]
    least = np.full(len(sample), np.iinfo(np.int64).max)
    np.minimum.at(least, member, ids[doc])
    # Where an anchor has several contexts, their strings are compared.
    a = anchor[sample]
    edge = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    many = np.repeat(np.diff(edge) > 1, np.diff(edge)) & (size[sample] >= LENGTH)
    covered = np.zeros((len(sample), CONTEXT - LENGTH + 1), bool)
    open_ = np.flatnonzero(many)
    group = np.searchsorted(edge, open_, side="right")
    low = 0
    while low < len(open_):
        high = min(len(open_), low + max(1, block_bytes // (CONTEXT + 1)))
        # All contexts of one anchor stay together.
        high = int(np.searchsorted(group, group[high - 1], side="right"))
        x = open_[low:high]
        covered[x] = _covered(data[sample[x]], size[sample[x]], least[x])
        low = high
    full = (ids[doc] > least[member]) & (size[context] >= LENGTH)
    part = ~full & covered.any(axis=1)[member]
    at, offset = np.nonzero(_edges(covered[member[part]]))
    end_at, end = np.nonzero(_edges(covered[member[part]][:, ::-1])[:, ::-1])
    some = np.flatnonzero(part)
    of = np.r_[doc[full], doc[some[at]]]
    begin = np.r_[start[full], start[some[at]] + offset]
    stop = np.r_[start[full] + size[context[full]], start[some[end_at]] + end + LENGTH]
    order = np.lexsort((begin, of))
    of, pairs = of[order], np.stack([begin[order], stop[order]], 1)
    held = np.unique(of)
    row = np.repeat(np.searchsorted(held, of), 2)
    return pa.table(
        {
            "doc_id": pa.array(ids[held]),
            "text_hash": pa.array(text[held]),
            "spans": _lists(row, len(held), pairs.ravel()),
        }
    )


def _edges(flags: np.ndarray) -> np.ndarray:
    """The first of each run of set flags in a row."""
    out = flags.copy()
    out[:, 1:] &= ~flags[:, :-1]
    return out


_REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): documents without their repeats.

    ``n_spans`` counts the maximal removed runs, ``kept`` are the remaining bytes as text (bytes that no
    longer form a character are replaced), and null unless ``keep_text``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            out: list[tuple] = []
            raw, at = tk.text_buffer(tk.column(batch, "text"))
            spans, ids = tk.column(batch, "spans"), tk.column(batch, "doc_id").to_pylist()
            edges, values = spans.offsets.to_numpy(), spans.values.to_numpy()
            for i, doc_id in enumerate(ids):
                body = raw[at[i] : at[i + 1]]
                pairs = values[edges[i] : edges[i + 1]].reshape(-1, 2)
                level = np.zeros(len(body) + 1, np.int64)
                np.add.at(level, pairs[:, 0], 1)
                np.add.at(level, pairs[:, 1], -1)
                gone = np.cumsum(level)[:-1] > 0
                runs = int((gone & np.r_[True, ~gone[:-1]][: len(gone)]).sum())
                kept = body[~gone].tobytes()
                shown = kept.decode("utf-8", "replace") if keep_text else None
                out.append((doc_id, len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), shown))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            names = [f.split()[0] for f in _REMOVED.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return repeated_spans(docs).mapInArrow(cut, _REMOVED)
