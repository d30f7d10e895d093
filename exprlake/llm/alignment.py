"""Alignment of the tokens of two tokenizers on the same text.

Tokens are laid out on the bytes of the text.  For each side a dictionary leads from the byte where a token ends
to the number of tokens up to there; the ends that both dictionaries have, in order, cut both id lists into
groups that cover the same bytes.  Inside a group tokens that share a byte are linked.  How well two ids go
together is the number of documents of the whole corpus that hold them linked: batches of documents count
their id pairs on their own, Spark sums the pairs of all batches, and each batch gets the sums of its pairs back.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import textkit as tk
from .packing import _ranked

# Bytes of text in one batch; its pairs are asked for once, however many of its documents hold them.
ALIGN_BYTES = 2 << 20
# Pairs of ids as one number.
_SECOND = 1 << 32

_BATCHES = (
    "batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, "
    "size array<int>, link array<int>, times array<int>, pair array<long>, n_docs array<int>"
)
_ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
_LOADED: dict = {}


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    # Bytes that stand for themselves in such a file; the others follow from code point 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


# Below this code point all characters have been assigned for so long that libraries agree on what is a letter.
SETTLED = "\u0250"


class ByteLevel:
    """Ids of texts by a byte-level pair encoding, and the bytes of each id.

    Plain files are run by ``tiktoken`` on texts of settled characters, in a fifth of the time and with the same
    ids; all other files and texts go to ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        byte_of = byte_level()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for entry, i in model["model"]["vocab"].items():
            self.bytes[i] = bytes(byte_of[c] for c in entry)
        self.ranked = _ranked(model)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [
            self.ranked.encode_to_numpy(t, disallowed_special=())
            if self.ranked is not None and max(t, default="") < SETTLED
            else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            for t in texts
        ]


class Pieces:
    """Ids of texts by a sentencepiece model, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            single = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else None
            self.bytes.append(single or piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


def _tables(kind, path: str):
    """A tokenizer with the byte lengths of its ids, and their decimal names before a comma and at a group's end."""
    if path not in _LOADED:
        side = kind(path)
        end = "|" if kind is ByteLevel else ";"
        names = [np.array([f"{i}{mark}" for i in range(len(side.bytes))], object) for mark in (",", end)]
        _LOADED[path] = side, np.array([len(b) for b in side.bytes], np.int64), names
    return _LOADED[path]


def cut_groups(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Places in both token lists where groups end: where a token of both sides ends on the same byte."""
    upto_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))
    upto_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(upto_a.keys() & upto_b.keys())
    return [upto_a[end] for end in common], [upto_b[end] for end in common]


def link_groups(
    ends_a: np.ndarray, ends_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all linked tokens, group by group; texts laid end to end are handled like one.

    Where a group has one token on a side, it is linked with all of the other.  In any other group every place
    where a token of either side ends closes one link, that of the two tokens which cover the byte before it.
    """
    a, b = np.r_[0, cuts_a].astype(np.int64), np.r_[0, cuts_b].astype(np.int64)
    n_a, n_b = np.diff(a), np.diff(b)
    plain = (n_a == 1) | (n_b == 1)
    size = np.where(plain, n_a * n_b, 0)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    i = np.repeat(a[:-1], size) + np.where(np.repeat(n_a, size) > 1, place, 0)
    j = np.repeat(b[:-1], size) + np.where(np.repeat(n_b, size) > 1, place, 0)
    ends = np.union1d(ends_a[np.repeat(~plain, n_a)], ends_b[np.repeat(~plain, n_b)])
    return np.r_[i, np.searchsorted(ends_a, ends)], np.r_[j, np.searchsorted(ends_b, ends)]


def group_names(ids_a, ids_b, cuts_a, cuts_b, names_a, names_b) -> np.ndarray:
    """`a1,` `a2|` `b1;` `a3|` `b2,` `b3;`: the ids of each group in turn, with what follows them."""
    out = np.empty(len(ids_a) + len(ids_b), object)
    a, b = np.r_[0, cuts_a].astype(np.int64), np.r_[0, cuts_b].astype(np.int64)
    # Before a token stand all of its own side so far, and those groups of the other that come first.
    for ids, names, cuts, others in ((ids_a, names_a, a, b[:-1]), (ids_b, names_b, b, a[1:])):
        n = np.diff(cuts)
        shown = names[0][ids]
        shown[cuts[1:] - 1] = names[1][ids[cuts[1:] - 1]]
        out[np.arange(len(ids)) + np.repeat(others, n)] = shown
    return out


def align(docs: DataFrame, byte_level_path: str, pieces_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    A is the byte-level tokenizer of the file ``byte_level_path``, given a space and the text, B the
    sentencepiece model ``pieces_path``, which adds the space itself; both paths exist on every worker.  A text
    that is null or empty, or whose tokens do not spell it, has no tokens: zeros and an empty ``groups_sha256``.
    ``n_links`` counts linked token occurrences; ``count_sum`` adds up, over them, how many documents hold their
    ids linked; ``n_best`` counts those that no other id of B beats for their id of A.  Columns other than doc_id
    and text are ignored; repeated rows count as documents of their own; an empty table gives no rows.
    """
    batches = materialize(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            lambda rows: _align_batches(rows, byte_level_path, pieces_path), _BATCHES
        ),
        "aligned",
    )
    pairs = batches.select(F.inline(F.arrays_zip("pair", "n_docs")))
    counts = pairs.groupBy("pair").agg(F.sum("n_docs").alias("n"))
    counts = materialize(counts.withColumn("a", F.expr(f"pair div {_SECOND}L")), "pair-counts")
    # An id of A has at most as many partners as B has ids.
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    judged = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    asked = batches.select("batch", F.posexplode("pair").alias("at", "pair"))
    answers = asked.join(judged, "pair").select(F.col("batch").alias("to"), "at", "n", "is_best")
    return (
        batches.drop("pair", "n_docs")
        .groupBy("batch")
        .cogroup(answers.groupBy("to"))
        .applyInArrow(_judge_batch, _ALIGNED)
    )


def _align_batches(rows: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    a_side, a_length, a_name = _tables(ByteLevel, path_a)
    b_side, b_length, b_name = _tables(Pieces, path_b)
    number = TaskContext.get().partitionId() << 33
    none = np.zeros(0, np.int64)
    for rows_of in rows:
        for batch in tk.slices(iter([rows_of]), limit=ALIGN_BYTES):
            texts = tk.column(batch, "text").to_pylist()
            given = [i for i, t in enumerate(texts) if t]
            n_a, n_b, n_groups = np.zeros((3, len(texts)), np.int64)
            digest = [""] * len(texts)
            ids_a, ids_b, cuts_a, cuts_b, of = [none], [none], [none], [none], []
            at_a = at_b = 0
            spaced = [" " + texts[i] for i in given]
            for i, text, a, b in zip(given, spaced, a_side.encode(spaced), b_side.encode([texts[i] for i in given])):
                raw = text.encode()
                if any(b"".join(map(side.bytes.__getitem__, ids.tolist())) != raw for side, ids in ((b_side, b), (a_side, a))):
                    continue
                x, y = cut_groups(np.cumsum(a_length[a]).tolist(), np.cumsum(b_length[b]).tolist())
                cuts_a.append(np.array(x, np.int64) + at_a)
                cuts_b.append(np.array(y, np.int64) + at_b)
                ids_a.append(a)
                ids_b.append(b)
                n_a[i], n_b[i], n_groups[i] = len(a), len(b), len(x)
                at_a, at_b = at_a + len(a), at_b + len(b)
                of.append(i)
            # Texts laid end to end: the names of their groups, their links, and of each text its different pairs.
            all_a, all_b, x, y = (np.concatenate(c).astype(np.int64) for c in (ids_a, ids_b, cuts_a, cuts_b))
            names = group_names(all_a, all_b, x, y, a_name, b_name)
            ends = np.cumsum([0, *(n_a[of] + n_b[of])]).tolist()
            for i, low, high in zip(of, ends, ends[1:]):
                digest[i] = hashlib.sha256("".join(names[low:high].tolist())[:-1].encode()).hexdigest()
            x, y = link_groups(np.cumsum(a_length[all_a]), np.cumsum(b_length[all_b]), x, y)
            pair, kind = np.unique(all_a[x] * _SECOND + all_b[y], return_inverse=True)
            text_of = np.repeat(np.array(of, np.int64), n_a[of])[x]
            held, times = np.unique(text_of * max(len(pair), 1) + kind, return_counts=True)
            text_of, link = np.divmod(held, max(len(pair), 1))
            size = np.bincount(text_of, minlength=len(texts))
            n_docs = np.bincount(link, minlength=len(pair))
            columns = {
                "doc_id": tk.column(batch, "doc_id"),
                "n_a": pa.array(n_a),
                "n_b": pa.array(n_b),
                "n_groups": pa.array(n_groups),
                "groups_sha256": pa.array(digest, pa.string()),
                "size": pa.array(size.astype(np.int32)),
                "link": pa.array(link.astype(np.int32)),
                "times": pa.array(times.astype(np.int32)),
                "pair": pa.array(pair),
                "n_docs": pa.array(n_docs.astype(np.int32)),
            }
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
            yield pa.record_batch([pa.array([number]), *lists], names=["batch", *columns])
            number += 1


def _judge_batch(batch: pa.Table, answers: pa.Table) -> pa.Table:
    def of(name: str) -> pa.Array:
        return batch[name].combine_chunks().flatten()

    size, link, times = (of(c).to_numpy() for c in ("size", "link", "times"))
    order = np.argsort(answers["at"].to_numpy())
    n = answers["n"].to_numpy()[order]
    is_best = answers["is_best"].combine_chunks().to_numpy(zero_copy_only=False)[order]
    end = np.cumsum(size)
    sums = []
    for value in (times, times * is_best[link], times * n[link]):
        upto = np.r_[0, np.cumsum(value, dtype=np.int64)]
        sums.append(pa.array(upto[end] - upto[end - size]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.table([*(of(c) for c in names[:4]), *sums, of("groups_sha256")], names=names)
