"""Benchmark decontamination by winnowing.

The least hash of the word grams in each sliding window is a fingerprint.  Test and training texts that
share a window share its fingerprint at the same place, so joining fingerprints finds every shared window;
each hit is then extended to the whole window and compared.  Test fingerprints are handed to the tasks in
blocks of bounded size, so training texts are read once per block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textkit as tk

WINDOW = 10
GRAM = 5
# Test windows in one block, about 40 bytes each.
BLOCK_WINDOWS = 1_000_000
# Bytes of text that a task looks at together; each costs it some 100 in arrays.
SCAN_BYTES = 1 << 18

_TESTS = "item_id long, size int, fingerprint long, place int, window long"


def _gram(size: int) -> int:
    return min(GRAM, size)


def _word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = tk.LOWER[raw]
    starts, ends, row = tk.spans(raw, at, tk.WORD_BYTES)
    return tk.hash_spans(raw, starts, ends), row


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, fingerprint, place, window): every window of every item, once per item.

    An item of fewer words than a window is one window; an item without words, or a null text, has none.
    ``place`` is where in the window its fingerprint begins.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            item = tk.column(batch, "item_id").to_numpy(zero_copy_only=False)
            words, row = _word_hashes(*tk.text_buffer(tk.column(batch, "text")))
            count = np.bincount(row, minlength=len(item))
            for size in range(1, window + 1):
                rows = (count >= size) if size == window else (count == size)
                kept = rows[row]
                hashes, first = tk.windows(words[kept], row[kept], size)
                if not len(hashes):
                    continue
                grams = _at(words[kept], first[:, None] + np.arange(size - _gram(size) + 1), _gram(size))
                place = np.argmin(grams, axis=1)
                yield pa.record_batch(
                    [
                        pa.array(item[row[kept][first]].astype(np.int64)),
                        pa.array(np.full(len(hashes), size, np.int32)),
                        pa.array(grams[np.arange(len(place)), place].view(np.int64)),
                        pa.array(place.astype(np.int32)),
                        pa.array(hashes.view(np.int64)),
                    ],
                    names=["item_id", "size", "fingerprint", "place", "window"],
                )

    texts = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null")
    return texts.mapInArrow(cut, _TESTS).distinct()


def _at(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each start on."""
    out = np.zeros(starts.shape, np.uint64)
    for i in range(size):
        out = tk.mix(out + words[starts + i])
    return out


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items) of every document.

    ``spans`` are the maximal runs (first, end) of words covered by windows that an item has too, and
    ``items`` the ids of such items.  Words are ASCII letters and digits, A-Z in lower case, and anything
    outside ASCII.  A null or empty text has no words.  Other columns are ignored, repeated rows are each
    reported, an empty table gives no rows, and without items nothing is hit.
    """
    tests = materialize(test_windows(items, window), "test-windows")
    blocks = max(1, -(-tests.count() // block_windows))
    texts = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash")
    )
    parts = []
    for b in range(blocks):
        block = tests.filter(F.pmod("fingerprint", F.lit(blocks)) == b)
        shared = docs.sparkSession.sparkContext.broadcast(_index(block.toArrow()))
        found = texts.mapInArrow(_scan(shared), "doc_id long, text_hash long, n_words long, " + _HITS)
        if blocks > 1:
            found = materialize(found, "hits")
            shared.unpersist()
        parts.append(found)
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    merged = every.groupBy("doc_id", "text_hash", "n_words").agg(
        (F.count(F.lit(1)) / blocks).cast("int").alias("__copies"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return merged.select(
        "doc_id", "text_hash", "n_words", F.expr(_JOIN_SPANS).alias("spans"), "items", F.explode(F.expr("sequence(1, __copies)"))
    ).drop("col")


_HITS = "spans array<struct<first:long,end:long>>, items array<long>"
_JOIN_SPANS = """
aggregate(spans, cast(array() as array<struct<first:bigint,end:bigint>>), (a, s) ->
  CASE WHEN size(a) > 0 AND element_at(a, -1).end >= s.first THEN
    concat(slice(a, 1, size(a) - 1),
           array(named_struct('first', element_at(a, -1).first, 'end', greatest(element_at(a, -1).end, s.end))))
  ELSE concat(a, array(s)) END)
"""


def _index(block: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """By window size: sorted fingerprints, and with them place, window hash and the items of the window."""
    size = block["size"].to_numpy()
    out = {}
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        item, print_, place, window = (
            block[c].to_numpy()[rows] for c in ("item_id", "fingerprint", "place", "window")
        )
        print_, window = print_.view(np.uint64), window.view(np.uint64)
        order = np.lexsort((item, place, window, print_))
        out[int(s)] = tuple(x[order] for x in (print_, place, window, item))
    return out


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in tk.slices(batches, limit=SCAN_BYTES):
            rows = batch.num_rows
            words, row = _word_hashes(*tk.text_buffer(tk.column(batch, "text")))
            hit = np.zeros(len(words) + 1, np.int64)
            pairs = [np.zeros((0, 2), np.int64)]
            for size, tests in index.items():
                first, item = _hits(words, row, size, *tests)
                np.add.at(hit, first, 1)
                np.add.at(hit, first + size, -1)
                pairs.append(np.unique(np.stack([row[first], item], 1), axis=0))
            covered = np.cumsum(hit)[:-1] > 0
            edge = np.flatnonzero(covered & np.r_[True, ~covered[:-1] | (row[1:] != row[:-1])][: len(covered)])
            last = np.flatnonzero(covered & np.r_[~covered[1:] | (row[1:] != row[:-1]), True][: len(covered)]) + 1
            begin = np.searchsorted(row, np.arange(rows))
            span_row = row[edge]
            found = np.unique(np.concatenate(pairs), axis=0)
            spans = pa.StructArray.from_arrays(
                [pa.array(edge - begin[span_row]), pa.array(last - begin[span_row])], names=["first", "end"]
            )
            yield pa.record_batch(
                [
                    tk.column(batch, "doc_id"),
                    tk.column(batch, "text_hash"),
                    pa.array(np.bincount(row, minlength=rows).astype(np.int64)),
                    pa.ListArray.from_arrays(_offsets(span_row, rows), spans),
                    pa.ListArray.from_arrays(_offsets(found[:, 0], rows), pa.array(found[:, 1])),
                ],
                names=["doc_id", "text_hash", "n_words", "spans", "items"],
            )

    return scan


def _offsets(row: np.ndarray, rows: int) -> pa.Array:
    return pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))


def _hits(
    words: np.ndarray,
    row: np.ndarray,
    size: int,
    prints: np.ndarray,
    place: np.ndarray,
    window: np.ndarray,
    item: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """First words of windows that equal a test window, and the item that has it."""
    gram = _gram(size)
    grams, first = tk.windows(words, row, gram)
    chosen = tk.window_minima(grams, row[first], size - gram + 1)
    grams, first = grams[chosen], first[chosen]
    low = np.searchsorted(prints, grams)
    known = low < len(prints)
    known[known] = prints[low[known]] == grams[known]
    grams, first, low = grams[known], first[known], low[known]
    many = np.searchsorted(prints, grams, side="right") - low
    # Each fingerprint against every test window that has it.
    test = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]][: len(low)], many) + np.arange(many.sum())
    start = np.repeat(first, many) - place[test]
    inside = (start >= 0) & (start + size <= len(words))
    start, test = start[inside], test[inside]
    same = row[start] == row[start + size - 1]
    start, test = start[same], test[same]
    equal = _at(words, start, size) == window[test]
    return start[equal], item[test[equal]]
