"""N-gram Jaccard join by T-occurrence search.

Texts with the same set of shingles are one class, joined by their digest.  Different sets that are near
enough share one of their rarest shingles (`prefixes`), which tells which classes have to meet.  Classes
that hang together that way go to one block.  In a block, the search is DivideSkip: each shingle
has the list of classes that hold it, a class merges its short lists with a heap, keeps what occurs often
enough, and looks it up in the long lists by binary search until the required overlap is reached or out of
reach.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, measured_side
from . import textkit as tk
from .common import components
from .prefixes import BATCH_BYTES, COLUMNS, pack, shard_bits, shared_prefixes

WORDS = 3
PERCENT = 90
# Shingles of the classes in one block, and classes; more are cut into chunks that meet pairwise.
BLOCK_SHINGLES = 4_000_000
BLOCK_CLASSES = 8_000
# Where groups alone are wanted: central sets that a set is held against first, and sets after which it is
# looked up anew which lists need no search.  They change the work, not the result.
CENTRES = 2
SETTLE = 500
FIRST = 16
# Entries that a heap merges for one set.
HEAP_ENTRIES = 2_000

_DOCS = "docs array<struct<doc_id:long,text_hash:long,n_shingles:long,class:long>>"


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, and the rows, in (row, shingle) order.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    raw = tk.LOWER[raw]
    starts, ends, row = tk.spans(raw, at, tk.NOT_SPACE)
    word = tk.hash_spans(raw, starts, ends)
    shingle, first = tk.windows(word, row, words)
    of = row[first]
    count = np.bincount(row, minlength=len(at) - 1)
    for size in range(1, words):
        kept = (count == size)[row]
        short, first = tk.windows(word[kept], row[kept], size)
        shingle, of = np.r_[shingle, tk.mix(short + np.uint64(size))], np.r_[of, row[kept][first]]
    order = np.lexsort((shingle, of))
    shingle, of = shingle[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    return shingle[new], of[new]


def sets_of(texts: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray]:
    """`shingle_sets` of a column `text` of any size, some texts at a time."""
    parts, rows = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for batch in tk.slices(texts.select(["text"]).to_batches()):
        sets, of = shingle_sets(*tk.text_buffer(tk.column(batch, "text")), words)
        parts.append((sets, of + rows))
        rows += batch.num_rows
    return tuple(np.concatenate(column) for column in zip(*parts))


def digests(sets: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """Digest of each row's set."""
    digest = np.zeros(rows, np.uint64)
    np.add.at(digest, of, tk.mix(sets ^ np.uint64(0x5851F42D4C957F2D)))
    return tk.mix(digest + np.bincount(of, minlength=rows).astype(np.uint64))


def jaccard_groups(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    block_shingles: int = BLOCK_SHINGLES,
    block_classes: int = BLOCK_CLASSES,
    count_links: bool = True,
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, n_links) of every document, of null doc_ids too.

    Two documents link when their sets of word shingles have a Jaccard similarity of at least ``percent``
    per cent; ``component_id`` is the least doc_id that links lead to, ``n_links`` the number of other
    documents it links with, null unless ``count_links``: groups alone are found without looking at
    pairs whose documents are known to hang together.  A text without words, or null, has no shingles and links with nothing.
    Columns other than doc_id and text are ignored; repeated rows link with each other; an empty table
    gives no rows.  Shingles are compared by 64-bit hashes.  A null doc_id counts as larger than all others.
    """
    return grouped(docs, words, percent, block_shingles, block_classes, count_links).drop("group")


def grouped(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    block_shingles: int = BLOCK_SHINGLES,
    block_classes: int = BLOCK_CLASSES,
    count_links: bool = True,
) -> DataFrame:
    """`jaccard_groups` with a ``group`` that all rows of one have and no others, whatever their doc_ids; it is
    null for rows without shingles."""
    share = Fraction(percent, 100)
    texts = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")
    )

    bits = shard_bits(texts)

    def summarize(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for rows_of in rows:
            for batch in tk.slices(iter([rows_of]), limit=BATCH_BYTES):
                sets, of = shingle_sets(*tk.text_buffer(tk.column(batch, "text")), words)
                digest = digests(sets, of, batch.num_rows)
                size = np.bincount(of, minlength=batch.num_rows).astype(np.int64)
                # Of equal sets in a batch one is packed.
                one = np.zeros(batch.num_rows, bool)
                one[np.unique(digest, return_index=True)[1]] = True
                one &= size > 0
                renamed = np.cumsum(one) - 1
                packed = pack(digest[one], sets[one[of]], renamed[of[one[of]]], bits)
                docs = pa.StructArray.from_arrays(
                    [tk.column(batch, "doc_id"), tk.column(batch, "text_hash"), pa.array(size), pa.array(digest.view(np.int64))],
                    names=["doc_id", "text_hash", "n_shingles", "class"],
                )
                columns = {"batch": pa.array([number]), "docs": _one_row(docs)}
                for name, values in packed.items():
                    columns[name] = pa.array([values], pa.binary()) if isinstance(values, bytes) else _one_row(values)
                yield pa.record_batch(list(columns.values()), names=list(columns))
                number += 1

    batches = materialize(texts.mapInArrow(summarize, f"batch long, {_DOCS}, {COLUMNS}"), "shingle-sets")
    sets = batches.select(F.inline("docs"))
    # The first row of each class, whose text stands for it.
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    classes = sets.filter("n_shingles > 0").groupBy("class").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("n_docs"), F.max("n_shingles").alias("n_shingles")
    )
    classes = classes.select("class", F.col("first.doc_id").alias("first_id"), "first.text_hash", "n_docs", "n_shingles")
    classes = materialize(classes, "classes")

    # Rare shingles that different classes share, and for each member the least class that has it.
    postings = materialize(shared_prefixes(batches, share), "prefixes")
    shared = postings.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    shared = shared.filter("least < most").select("key", "least")
    meets = postings.join(shared, "key").filter("class <> least").select("class", "least").distinct()
    together = components(meets.select(F.col("class").alias("a"), F.col("least").alias("b")), "meets")
    links = _search(texts, classes, together, words, share, block_shingles, block_classes, count_links)

    linked = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")), "links")
    root = linked.join(classes, linked["node"] == classes["class"]).select("class", "component", "first_id")
    named = root.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = root.join(named, "component").select("class", "component_id", "component")
    n_linked = links.groupBy("class").agg(F.sum("n_linked").alias("n_linked"))
    per_class = (
        classes.join(named, "class", "left")
        .join(n_linked, "class", "left")
        .select(
            "class",
            F.coalesce("component_id", "first_id").alias("component_id"),
            F.coalesce("component", "class").alias("group"),
            (F.coalesce("n_linked", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
        )
    )
    return (
        sets.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class")).alias("class"))
        .join(per_class, "class", "left")
        .select(
            "doc_id",
            "text_hash",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            (F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None).cast("long")).alias("n_links"),
            "group",
        )
    )


def _one_row(values: pa.Array) -> pa.Array:
    """A list column of one row that holds ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _search(texts, classes, together, words, share, block_shingles, block_classes, count_links) -> DataFrame:
    """(class, root, n_linked) for every linked class of a block: the least class that links in the block
    lead to, and how many documents of other classes it links with there.  Each link is found in one block;
    unless ``count_links``, only as many links as connect the same classes.
    """
    members = together.join(classes, together["node"] == classes["class"])
    members = members.select("class", "component", "first_id", "text_hash", "n_docs", "n_shingles")
    members = materialize(members, "members")
    # A block too large for one task is cut into chunks, and every two chunks meet.
    sizes = members.groupBy("component").agg(
        F.greatest(
            F.ceil(F.sum("n_shingles") / block_shingles), F.ceil(F.count(F.lit(1)) / block_classes)
        ).alias("chunks")
    )
    chunked = members.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")))
    # One text for each class.  Rows that agree in id and text are one to it, whichever is read.
    source = chunked.select(
        F.col("class"), F.col("first_id").alias("__id"), F.col("text_hash").alias("__hash")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    found = texts.join(measured_side(source, "class-texts"), same).select("class", "text")
    placed = found.join(chunked, "class").select(
        "component", "chunk", "class", "n_docs", "text", "chunks",
        F.explode(F.expr("sequence(0L, chunks - 1)")).alias("other"),
    )
    if not count_links:
        placed = placed.filter("chunk <> other or chunks = 1")  # a chunk is also searched when it meets another
    placed = placed.select(
        "component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        "chunk", "class", "n_docs", "text",
    )

    def block(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        table = table.take(pa.array(np.unique(table["class"].to_numpy(), return_index=True)[1]))
        name, chunk, docs = (table[c].to_numpy() for c in ("class", "chunk", "n_docs"))
        shingle, of = sets_of(table, words)
        del table
        a, b = divide_skip(shingle, of, len(name), share, spanning=not count_links)
        if i != j and count_links:
            across = chunk[a] != chunk[b]
            a, b = a[across], b[across]
        linked = np.unique(np.r_[a, b])
        n_linked = np.zeros(len(name), np.int64)
        np.add.at(n_linked, np.r_[a, b], docs[np.r_[b, a]])
        return pa.table(
            {
                "class": pa.array(name[linked]),
                "root": pa.array(name[_roots(a, b, len(name))[linked]]),
                "n_linked": pa.array(n_linked[linked]),
            }
        )

    found = placed.groupBy("component", "i", "j").applyInArrow(block, "class long, root long, n_linked long")
    return materialize(found, "similar")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that the links (a, b) lead to, for each of ``n`` nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def divide_skip(
    shingle: np.ndarray, of: np.ndarray, sets: int, share: Fraction, spanning: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b) of sets whose Jaccard similarity is at least ``share``.

    With ``spanning`` only pairs that connect the same sets: a set skips those it hangs together with.
    """
    size = np.bincount(of, minlength=sets)
    # Sets by size, so that the lists of each shingle are in that order and a set looks at smaller ones only.
    rank = np.empty(sets, np.int64)
    by_size = np.argsort(size, kind="stable")
    rank[by_size] = np.arange(sets)
    order = np.lexsort((rank[of], shingle))
    held, who = shingle[order], rank[of][order]
    new = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, np.int64)
    length = np.diff(np.r_[new, len(held)])
    list_of = np.repeat(np.arange(len(new)), length)
    by_set = np.argsort(who, kind="stable")
    lists, cuts = list_of[by_set], np.searchsorted(who[by_set], np.arange(sets + 1))
    ordered_size = size[by_size]
    left: list[int] = []
    right: list[int] = []
    up, down = share.numerator, share.denominator
    root = np.arange(sets)
    # Lists whose sets all hang together have nothing to tell.
    settled = np.zeros(len(new), bool)
    if spanning and len(new):
        for a, b in _central_pairs(who, new, length, lists, cuts, share):
            if root[a] != root[b]:
                left.append(int(by_size[a]))
                right.append(int(by_size[b]))
                root[root == max(root[a], root[b])] = min(root[a], root[b])
    for q in range(sets):
        if spanning and len(new) and q % SETTLE == 0:
            settled = np.minimum.reduceat(root[who], new) == np.maximum.reduceat(root[who], new)
        own = lists[cuts[q] : cuts[q + 1]]
        n = len(own)
        # A smaller set has to hold share * n shingles at least, all of them in common.
        need = -(-n * up // down)
        least = int(np.searchsorted(ordered_size, need))
        if not n or least >= q:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        short, long = own[: n - need + 1], own[n - need + 1 :]
        parts = []
        for s in short[~settled[short]]:
            part = who[new[s] : new[s] + length[s]]
            part = part[np.searchsorted(part, least) : np.searchsorted(part, q)]
            if spanning:
                part = part[root[part] != root[q]]
            if len(part):
                parts.append(part)
        if not parts:
            continue
        found, count = _merge(parts)
        first = len(found)
        if spanning:
            # The likeliest first: once one links, those that hang together with it need no look.
            order = np.argsort(-count, kind="stable")
            found, count, first = found[order], count[order], FIRST
        while len(found):
            # Overlap that makes the pair near: o / (n + m - o) >= share.
            wanted = -(-up * (n + ordered_size[found[:first]]) // (up + down))
            if len(wanted) <= FIRST:
                # For a few, one search each in the set's own sorted shingles is less than one for each list.
                mine = lists[cuts[q] : cuts[q + 1]]
                held_by = (lists[cuts[c] : cuts[c + 1]] for c in found[:first].tolist())
                both = [int((mine[np.searchsorted(mine[:-1], x)] == x).sum()) for x in held_by]
                hit = found[:first][np.array(both) >= wanted]
            else:
                hit = _probe(found[:first], count[:first], wanted, [who[new[s] : new[s] + length[s]] for s in long])
            found, count, first = found[first:], count[first:], len(found)
            if spanning and len(hit):
                hit = hit[np.unique(root[hit], return_index=True)[1]]
                root[np.isin(root, np.r_[root[hit], root[q]])] = min(root[hit].min(), root[q])
                apart = root[found] != root[q]
                found, count = found[apart], count[apart]
            left += by_size[hit].tolist()
            right += [int(by_size[q])] * len(hit)
    return np.array(left, np.int64), np.array(right, np.int64)


def _merge(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What sorted lists hold, in order, and how many lists hold it: a heap merges short lists; where even
    the shortest of a set are long, their entries are tallied."""
    if sum(map(len, parts)) > HEAP_ENTRIES:
        low = min(int(part[0]) for part in parts)
        tally = np.bincount(np.concatenate(parts) - low)
        found = np.flatnonzero(tally)
        return found + low, tally[found]
    merged = np.fromiter(heapq.merge(*(part.tolist() for part in parts)), np.int64)
    start = np.flatnonzero(np.r_[True, merged[1:] != merged[:-1]])
    return merged[start], np.diff(np.r_[start, len(merged)])


def _probe(found: np.ndarray, count: np.ndarray, wanted: np.ndarray, long: list[np.ndarray]) -> np.ndarray:
    """Those of ``found`` that reach the wanted count, by binary search in the long lists."""
    count = count.copy()
    for k, part in enumerate(long):
        alive = count + (len(long) - k) >= wanted
        if not alive.all():
            found, count, wanted = found[alive], count[alive], wanted[alive]
        if not len(found):
            break
        at = np.searchsorted(part, found)
        at[at == len(part)] = 0
        count += part[at] == found
    return found[count >= wanted]


def _central_pairs(who, new, length, lists, cuts, share: Fraction) -> Iterator[tuple[int, int]]:
    """Near pairs of a set and the set that is most central in most of its lists.

    A set is central if its lists are long, as those of a text with many edited copies.
    """
    sets = len(cuts) - 1
    weight = np.bincount(who, np.repeat(length, length), minlength=sets)
    by_weight = np.argsort(weight, kind="stable")
    rank = np.empty(sets, np.int64)
    rank[by_weight] = np.arange(sets)
    centre = by_weight[np.maximum.reduceat(rank[who], new)]
    for q in range(sets):
        own = lists[cuts[q] : cuts[q + 1]]
        found, count = np.unique(centre[own], return_counts=True)
        for c in found[np.argsort(-count, kind="stable")][:CENTRES]:
            other = lists[cuts[c] : cuts[c + 1]]
            both = len(np.intersect1d(own, other, assume_unique=True))
            if c != q and both * (share.numerator + share.denominator) >= share.numerator * (len(own) + len(other)):
                yield q, int(c)
