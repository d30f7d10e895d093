"""Periodic runs of words by block convolution.

A run of smallest period q repeats q words at least three times.  At every dyadic scale L a text is tiled with
blocks of L words.  A run whose period lies in [L, 2L) (below 16 at the least scale, L = 8) holds a whole block
that occurs again q words later, so it is enough to know at which distances of that range each block occurs
again.  They are the zeros of the squared differences between the block and the window that follows it, summed
over the block: sum x^2 + sum y^2 - 2 sum xy, whose last term is a correlation and is computed for all blocks of
a scale at once by an integer NTT.  A distance is a seed; it is extended to the longest stretch of words that
equal those one distance further on, which is a run unless a shorter period explains it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

MIN_LENGTH = 24
MIN_PERIODS = 3
# Words in a block of the least scale; a third of MIN_LENGTH, which makes runs of that length hold a block.
LEAST_BLOCK = MIN_LENGTH // MIN_PERIODS
# Values that one convolution holds at a time; blocks of one scale are taken in such portions.
PORTION = 1 << 19

# A prime 3 * 2^30 + 1, whose products fit 64 bits, and a generator of its units.
PRIME = np.uint64(3221225473)
GENERATOR = 5

_FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@lru_cache(maxsize=None)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. size/2 - 1 of a root of unity of the order ``size``."""
    root = pow(GENERATOR, (int(PRIME) - 1) // size, int(PRIME))
    if inverse:
        root = pow(root, -1, int(PRIME))
    powers = np.ones(1, np.uint64)
    while len(powers) < size // 2:
        powers = np.r_[powers, powers * np.uint64(pow(root, len(powers), int(PRIME))) % PRIME]
    return powers


def ntt(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row of ``x``, rows of a power of two; ``inverse`` undoes it."""
    rows, size = x.shape
    x = x.reshape(rows, 1, size)
    # Decimation in frequency, self-sorting: axis 1 collects the finished index bits, axis 2 the open ones.
    while x.shape[2] > 1:
        half = x.shape[2] // 2
        low, high = x[:, :, :half], x[:, :, half:]
        even = low + high
        even -= PRIME * (even >= PRIME)
        odd = (low + (PRIME - high)) % PRIME * _roots(2 * half, inverse) % PRIME
        x = np.concatenate([even, odd], axis=1)
    out = x.reshape(rows, size)
    if inverse:
        out = out * np.uint64(pow(size, -1, int(PRIME))) % PRIME
    return out


def block_distances(word: np.ndarray, starts: np.ndarray, block: int, first: int, last: int):
    """(start, distance) where the block of words from ``start`` occurs again ``distance`` words further on.

    Distances run from ``first`` to ``last``.  A zero is modulo the prime, so it is a necessary sign of an
    occurrence; extension compares the words themselves.
    """
    window = last - first + block
    size = 1 << (window - 1).bit_length()
    # Beyond the end of the text stand values that no word has, so that no occurrence reaches there.
    ids = np.r_[word.astype(np.uint64), np.full(last + block, word.max() + 1, np.uint64)]
    found_at, found_by = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(starts), max(1, PORTION // size)):
        at = starts[i : i + max(1, PORTION // size)]
        x = np.zeros((len(at), size), np.uint64)
        y = np.zeros((len(at), size), np.uint64)
        x[:, :block] = ids[at[:, None] + np.arange(block)]
        y[:, :window] = ids[at[:, None] + first + np.arange(window)]
        x2 = (x * x % PRIME).sum(axis=1) % PRIME
        total = np.zeros((len(at), size + 1), np.uint64)
        np.cumsum(y * y % PRIME, axis=1, out=total[:, 1:])
        y2 = total[:, block : window + 1] - total[:, : window + 1 - block]
        # Correlation as a product with the reversed block: sum over j of x[j] y[o + j] stands at place o.
        back = np.zeros_like(x)
        back[:, 0] = x[:, 0]
        back[:, 1:] = x[:, :0:-1]
        xy = ntt(ntt(back) * ntt(y) % PRIME, inverse=True)[:, : window + 1 - block]
        row, offset = np.nonzero((x2[:, None] + y2) % PRIME == 2 * xy % PRIME)
        found_at.append(at[row])
        found_by.append(offset + first)
    return np.concatenate(found_at), np.concatenate(found_by)


def _recurs(word: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` words the distance to the next place with the same hash, or a huge number.

    Hashes can only make places look alike that are not, which costs a convolution and loses nothing.
    """
    n = len(word) - size + 1
    hashed = np.zeros(n, np.uint64)
    mixed = tk.mix(word.astype(np.uint64) + np.uint64(1))
    for i in range(size):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + mixed[i : i + n]
    order = np.argsort(hashed, kind="stable")
    gap = np.full(n, np.iinfo(np.int64).max)
    same = hashed[order[1:]] == hashed[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _matches(word: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from ``i`` and ``j`` on (``step`` 1) or back from them (-1) are equal; i < j."""
    limit = len(word) - j if step > 0 else i + 1
    done, width = 0, 32
    while done < limit:
        width = min(width, limit - done)
        if step > 0:
            differ = word[i + done : i + done + width] != word[j + done : j + done + width]
        else:
            differ = (word[i - done - width + 1 : i - done + 1] != word[j - done - width + 1 : j - done + 1])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done += width
        width *= 2
    return limit


def find_runs(word: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period.

    A run is a stretch of words of smallest period q, at least max(MIN_LENGTH, MIN_PERIODS * q) long, which the
    words beside it do not continue.  ``word`` holds a number for each word, equal for equal words.
    """
    n = len(word)
    if n < MIN_LENGTH:
        return []
    gap = _recurs(word, LEAST_BLOCK)
    if gap.min() >= n:
        return []
    gap = np.r_[gap, 0]
    known = _Runs(n)
    block = LEAST_BLOCK
    while block == LEAST_BLOCK or MIN_PERIODS * block <= n:
        first, last = (1 if block == LEAST_BLOCK else block), min(2 * block - 1, n // MIN_PERIODS)
        starts = np.arange(0, n - block + 1, block)
        # A block can only occur again where each of its parts does.
        parts = np.c_[starts, starts + block - LEAST_BLOCK + 1].ravel()
        starts = starts[np.maximum.reduceat(gap, parts)[::2] <= last]
        if len(starts):
            at, by = block_distances(word, starts, block, first, last)
            new = ~known.explain(at, at + block + by, by)
            at, by = at[new], by[new]
            for k in np.lexsort((at, by)).tolist():
                _extend(word, int(at[k]), int(by[k]), block, known)
        block *= 2
    return sorted(known.runs)


class _Runs:
    """Runs found so far, and which of them hold a place."""

    def __init__(self, n: int):
        self.runs: list[tuple[int, int, int]] = []
        self.tiles: dict[int, list[tuple[int, int, int]]] = {}
        # Of the first run that was found to hold a word: where it ends, and its period.
        self.end, self.period = np.zeros(n, np.int64), np.ones(n, np.int64)

    def add(self, start: int, length: int, period: int) -> None:
        run = (start, start + length, period)
        self.runs.append((start, length, period))
        for tile in range(start // LEAST_BLOCK, (run[1] - 1) // LEAST_BLOCK + 1):
            self.tiles.setdefault(tile, []).append(run)
        place = np.arange(start, run[1])[self.end[start : run[1]] == 0]
        self.end[place], self.period[place] = run[1], period

    def explain(self, at: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Flags of the stretches known to lie in a run whose period divides theirs; some may be missed."""
        return (end <= self.end[at]) & (period % self.period[at] == 0)

    def explains(self, near: int, start: int, end: int, period: int) -> bool:
        """Whether a stretch that holds the word ``near`` lies in such a run; exact."""
        held = self.tiles.get(near // LEAST_BLOCK, ())
        return any(s <= start and end <= e and period % q == 0 for s, e, q in held)


def _extend(word: np.ndarray, start: int, period: int, block: int, known: _Runs) -> None:
    """Add the run of ``period`` around the block from ``start``, if there is one and it is new.

    If the block and its next occurrence lie in a run whose period divides ``period``, so does all that equals
    itself ``period`` words further on around them, and a shorter period is that of the run.
    """
    if known.explains(start, start, start + block + period, period):
        return
    right = _matches(word, start, start + period, 1)
    if right < block:
        return  # a zero of the modulus alone
    left = _matches(word, start - 1, start + period - 1, -1) if start else 0
    length = left + right + period
    if length < max(MIN_LENGTH, MIN_PERIODS * period):
        return
    if not known.explains(start, start - left, start - left + length, period):
        known.add(start - left, length, period)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Flags of the words that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document; nothing is shuffled.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.  ``runs``
    lists (start, length, period) in words, by start and period; ``collapsed`` has the words joined by one
    space, without those that a run holds after its first period.  A null text has no words, like an empty one;
    both give no runs and an empty ``collapsed``.  Columns other than doc_id and text are ignored, repeated rows
    and null doc_ids give a row each, an empty table gives none.  A text is handled whole, in one task.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            n_words, runs, collapsed = [], [], []
            for text in tk.column(batch, "text").cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                numbers: dict[bytes, int] = {}
                word = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                found = find_runs(word)
                if found:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                n_words.append(len(word))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                collapsed.append(b" ".join(words).decode())
            run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.record_batch(
                [
                    tk.column(batch, "doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(runs, pa.list_(run)),
                    pa.array(collapsed, pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, _FOUND)
