"""Which sets have to meet: those that share one of their rarest elements.

Two sets that agree in all but some elements share one of their few rarest, if all sets rank elements alike
(prefix filter).  So elements are counted over the whole corpus, a set keeps the `n - need + 1` rarest of its
own, and of these only what another set holds too.  An element that most texts share is a rare one of almost no
set, so boilerplate brings nothing together.

Elements travel packed: a batch of texts sends its different elements once, sorted, in shards of their hash, and
gets back which of them are shared, and how widely.  An element costs a shard one entry for each batch that has
it, however many texts do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

# Elements that a shard holds, about, and bytes of text for one.
SHARD_ELEMENTS = 2_000_000
ELEMENT_BYTES = 6
# Bytes of text in one batch.
BATCH_BYTES = 2 << 20

COLUMNS = "classes array<long>, n array<int>, members binary, shards array<int>, starts array<int>, tokens array<binary>, held array<binary>"
_SHARED = "batch long, shard int, at binary, low binary, rank binary"


def shard_bits(docs: DataFrame) -> int:
    """Bits of a hash that name the shard, so many that shards stay of one size however large the corpus is."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(0, (int(size) // ELEMENT_BYTES // SHARD_ELEMENTS).bit_length())


def pack(classes: np.ndarray, sets: np.ndarray, of: np.ndarray, bits: int) -> dict[str, pa.Array]:
    """One batch: sets of different ``classes``, given as elements and the place of their class, packed.

    An element is its shard, the first ``bits`` bits of its hash, and the 32 bits that follow.
    """
    token = sets >> np.uint64(32 - bits)
    different, local, held = np.unique(token, return_inverse=True, return_counts=True)
    order = np.lexsort((local, of))
    members = local[order].astype(np.int64)
    first = np.r_[True, np.diff(of[order]) > 0] if len(of) else np.zeros(0, bool)
    # Steps between the elements of a set, small ones as a rule; a set starts anew.
    steps = np.diff(members, prepend=0)
    steps[first] = members[first]
    shard = (different >> np.uint64(32)).astype(np.int64)
    shards, starts = np.unique(shard, return_index=True)
    ends = np.r_[starts[1:], len(different)]
    low = different.astype("<u4")
    count = np.minimum(held, 255).astype(np.uint8)
    return {
        "classes": pa.array(classes.view(np.int64)),
        "n": pa.array(np.bincount(of, minlength=len(classes)).astype(np.int32)),
        "members": _narrow(steps),
        "shards": pa.array(shards.astype(np.int32)),
        "starts": pa.array(starts.astype(np.int32)),
        "tokens": pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        "held": pa.array([count[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
    }


def _narrow(steps: np.ndarray) -> bytes:
    """Numbers as 16 bits each; the few larger ones have their upper halves listed by place in front."""
    large = np.flatnonzero(steps >> 16)
    parts = (np.array([len(large)], "<u4"), large.astype("<u4"), (steps[large] >> 16).astype("<u2"), steps.astype("<u2"))
    return b"".join(part.tobytes() for part in parts)


def _widened(packed: bytes) -> np.ndarray:
    m = int(np.frombuffer(packed, "<u4", 1)[0])
    steps = np.frombuffer(packed, "<u2", offset=4 + 6 * m).astype(np.int64)
    large = np.frombuffer(packed, "<u4", m, offset=4)
    steps[large] += np.frombuffer(packed, "<u2", m, offset=4 + 4 * m).astype(np.int64) << 16
    return steps


def _count(table: pa.Table) -> pa.Table:
    """Of one shard: the elements of each batch that more than one set holds, and the rank of their number."""
    batch = table["batch"].to_numpy()
    lows = [np.frombuffer(t, "<u4") for t in table["tokens"].to_pylist()]
    held = np.concatenate([np.frombuffer(t, np.uint8) for t in table["held"].to_pylist()])
    size = np.array([len(low) for low in lows], np.int64)
    every, kind = np.unique(np.concatenate(lows), return_inverse=True)
    total = np.bincount(kind, weights=held, minlength=len(every)).astype(np.int64)
    rank = np.where(total > 1, np.minimum(255, 8 * np.log2(np.maximum(total, 2))), 0).astype(np.uint8)
    out: dict[str, list] = {c: [] for c in ("batch", "shard", "at", "low", "rank")}
    for b, low, ranks in zip(batch, lows, np.split(rank[kind], np.cumsum(size)[:-1])):
        at = np.flatnonzero(ranks)
        if len(at):
            out["batch"].append(b)
            out["shard"].append(table["shard"][0].as_py())
            out["at"].append(at.astype("<u4").tobytes())
            out["low"].append(low[at].tobytes())
            out["rank"].append(ranks[at].tobytes())
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(out.values(), types)], names=list(out))


def shared_prefixes(batches: DataFrame, share) -> DataFrame:
    """(class, key): the elements among the rarest of each class that another set holds too.

    ``batches`` has a number ``batch`` and COLUMNS.  Two classes whose sets have a Jaccard similarity of at least
    ``share`` have a key in common.
    """
    up, down = share.numerator, share.denominator
    sent = batches.select("batch", F.inline(F.arrays_zip("shards", "tokens", "held")))
    sent = sent.withColumnRenamed("shards", "shard")
    shared = sent.groupBy("shard").applyInArrow(_count, _SHARED)

    def choose(batch: pa.Table, answers: pa.Table) -> pa.Table:
        none = pa.table({"class": pa.array([], pa.int64()), "key": pa.array([], pa.int64())})
        if not batch.num_rows or not answers.num_rows:
            return none
        row = batch.to_pylist()[0]
        classes, n, steps = np.array(row["classes"], np.int64), np.array(row["n"], np.int64), _widened(row["members"])
        of = np.repeat(np.arange(len(classes)), n)
        # Undo the steps within each set.
        members = np.cumsum(steps)
        first = np.cumsum(n) - n
        members -= np.repeat(members[first] - steps[first], n)
        start = dict(zip(row["shards"], row["starts"]))
        rank = np.zeros(int(members.max(initial=0)) + 1, np.uint8)
        key = np.zeros(len(rank), np.int64)
        for shard, at, low, ranks in zip(*(answers[c].to_pylist() for c in ("shard", "at", "low", "rank"))):
            place = np.frombuffer(at, "<u4").astype(np.int64) + start[shard]
            rank[place] = np.frombuffer(ranks, np.uint8)
            key[place] = np.frombuffer(low, "<u4").astype(np.int64) | (shard << 32)
        # Elements of the batch are numbered in the order of their hashes, which settles equal ranks.
        order = np.lexsort((members, rank[members], of))
        place = np.arange(len(order)) - np.repeat(first, n)
        prefix = n - -(-n * up // down) + 1
        chosen = order[(place < np.repeat(prefix, n)) & (rank[members[order]] > 0)]
        return pa.table({"class": pa.array(classes[of[chosen]]), "key": pa.array(key[members[chosen]])})

    kept = batches.select("batch", "classes", "n", "members", "shards", "starts")
    return kept.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(choose, "class long, key long")
