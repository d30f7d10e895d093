"""Best-two-fit packing of token sequences.

A document becomes token ids and an end id, cut into pieces of at most one sequence.  How pieces are
put together depends on their lengths alone, so the packing is planned on the histogram of lengths
(at most ``capacity`` rows, whatever the corpus holds) and carried out by numbering the pieces of each
length and looking their numbers up in the plan.  Token ids never move.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small_frame
from . import textkit as tk

CAPACITY = 1024
END_ID = 2
# Pieces that one window task numbers, about.
ROWS_PER_GROUP = 200_000

_PIECES = "doc_id long, piece int, start long, length long, ids binary"
_LOADED: dict = {}


class _Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    Where the file is a plain byte-level pair encoding, ``tiktoken`` runs with the same vocabulary; the
    ids are the same, four times faster.  Any other file, and texts that hold a special token, go to
    ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = [t["content"] for t in model.get("added_tokens") or []]
        self.ranked = _ranked(model)

    def encode(self, text: str) -> bytes:
        if self.ranked is None or any(s in text for s in self.special):
            return np.array(self._whole().encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.ranked.encode_ordinary(text)).tobytes()

    def _whole(self):
        """``tokenizers`` itself, which few workers ever need beside the same vocabulary; it is loaded once."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer


def _ranked(model: dict):
    """The same encoding for ``tiktoken``, if the file has byte-level pairs whose ids follow their ranks."""
    import tiktoken

    pairs, before = model.get("model") or {}, model.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if pairs.get("type") != "BPE" or not plain or model.get("normalizer") or sys.byteorder != "little" or array("I").itemsize != 4:
        return None
    # Bytes that stand for themselves in such a file; the others follow from code point 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    names = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in pairs["vocab"].items() if token not in names}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in pairs["merges"]]
    if [pairs["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
        return None
    # Fixed value: the pre-token pattern of byte-level pair encodings.
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of all documents.

    ``tokenizer`` is the path of a tokenizer file on every worker.  A null or empty text is the end id
    alone.  Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids after a first
    one that may be shorter.  ``ids`` holds little-endian unsigned 32-bit ids.  Columns other than
    doc_id and text are ignored; repeated rows give repeated pieces; an empty table gives no pieces.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = _Encoder(tokenizer)
        encoder = _LOADED[tokenizer]
        for batch in tk.slices(batches):
            texts = ["" if t is None else t for t in tk.column(batch, "text").to_pylist()]
            doc_id, piece, start, length, ids = [], [], [], [], []
            for d, text in zip(tk.column(batch, "doc_id").to_pylist(), texts):
                body = encoder.encode(text) + end
                total = len(body) // 4
                at = 0
                for k in range(-(-total // capacity)):
                    size = (total % capacity or capacity) if k == 0 else capacity
                    doc_id.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    ids.append(body[4 * at : 4 * (at + size)])
                    at += size
            yield pa.record_batch(
                [
                    pa.array(doc_id, pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit over a histogram of lengths: (lengths of one sequence, how many such sequences).

    A sequence takes the longest length that still fits, again and again.  If room is left, its
    shortest length is tried against the pair of remaining lengths that fills the widened gap best.
    The same choice holds for as many sequences as the counts allow, so the plan has at most a few
    entries per length.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids does not fit {capacity}")
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    while left.any():
        used: list[int] = []
        room = capacity
        while room:
            fits = np.flatnonzero(left[: room + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            take = int(min(left[longest], room // longest))
            used += [longest] * take
            left[longest] -= take
            room -= longest * take
        if room and len(used) > 1:
            used = _two_for_one(left, used, room)
        lengths, times = np.unique(used, return_counts=True)
        again = int((left[lengths] // times).min())
        left[lengths] -= times * again
        out.append((tuple(sorted(used, reverse=True)), again + 1))
    return out


def _two_for_one(left: np.ndarray, used: list[int], room: int) -> list[int]:
    """Exchange the shortest length for two remaining ones that fill more, if there are any."""
    shortest = used[-1]
    gap = room + shortest
    lengths = np.flatnonzero(left[:gap])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return used
    # For each length the longest partner that fits; a length pairs with itself if two are left.
    partner = np.searchsorted(lengths, gap - lengths, side="right") - 1
    same = (partner == np.arange(len(lengths))) & (left[lengths] < 2)
    partner = np.where(same, partner - 1, partner)
    total = np.where(partner >= 0, lengths + lengths[partner], 0)
    best = int(np.argmax(total))
    if total[best] <= shortest:
        return used
    a, b = int(lengths[best]), int(lengths[partner[best]])
    left[shortest] += 1
    left[a] -= 1
    left[b] -= 1
    return [*used[:-1], a, b]


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length and any other columns).

    Pieces of one length are numbered in hashed groups, so a length that most pieces have spans many
    tasks; a group's first number comes from the counts of the groups before it.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    groups = max(64, pieces.count() // rows_per_group)
    pieces = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    sizes = materialize(pieces.groupBy("length", "__group").agg(F.count(F.lit(1)).alias("__n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__group", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    in_group = Window.partitionBy("length", "__group").orderBy("doc_id", "piece")
    numbered = (
        pieces.withColumn("__place", F.row_number().over(in_group) - 1)
        .join(starts, ["length", "__group"])
        .withColumn("__place", F.col("__start") + F.col("__place"))
    )
    # The plan as one row per length: where its numbers change from one slot to the next.
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken = dict.fromkeys(counts, 0)
    sequence = 0
    for lengths, times in plan(counts, capacity):
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((taken[length], times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    rows = [(length, *map(list, zip(*found))) for length, found in slots.items()]
    schema = "length long, __from array<long>, __times array<long>, __sequence array<long>, __offset array<long>"
    placed = small_frame(spark, rows, _struct(schema))
    # At most `capacity` rows, and a few slots per length: small whatever the corpus holds.
    return (
        numbered.join(F.broadcast(placed), "length")
        .withColumn("__slot", _last_not_above("__from", "__place"))
        .withColumn(
            "sequence_id",
            F.element_at("__sequence", F.col("__slot"))
            + F.col("__place")
            - F.element_at("__from", F.col("__slot")),
        )
        .withColumn("offset", F.element_at("__offset", F.col("__slot")))
        .select(*[c for c in pieces.columns if c != "__group"], "sequence_id", "offset")
    )


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _last_not_above(starts: str, value: str):
    """1-based index of the last element of the ascending ``starts`` that is not above ``value``."""
    return F.size(F.filter(F.col(starts), lambda s: s <= F.col(value)))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, at most one capacity of ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("p"))
        .select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))
    )
