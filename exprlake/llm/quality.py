"""Learned decision lists over text statistics.

Statistics of every document come from one pass over its words.  From documents with labels, sequential
covering grows conjunctions of thresholds that reject (each test taken by its information gain), prunes
them on rows held back, and keeps those that stay precise there.  The list is a Spark CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

# A document needs so many words, and at most this share of them in repeated windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Labelled rows that a list is learned from, at most; the least hashes of doc_id are taken.
MAX_LABELLED = 50_000
# A rule stands if so many of the rows it rejects were labelled bad, on rows it was not grown on.
MIN_PRECISION = 0.95
MIN_COVER = 5
MAX_RULES = 16
MAX_TESTS = 4
CUTS = 32

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_bytes", "n_lines", "n_digits", "n_upper", "n_marks", "n_distinct",
]
_SYMBOLS = tk.byte_class(b"#*$%&|<>")
_DIGITS = tk.byte_class(b"0123456789")
_UPPER = tk.byte_class(bytes(range(0x41, 0x5B)))
_MARKS = tk.byte_class(b".,;:!?")
_LINE = ~tk.byte_class(b"\n")
WINDOW = 3

# Bytes of text that are measured together; each costs a task some 100 in arrays.
MEASURE_BYTES = 1 << 18


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, counts) of every row of ``docs``; a null or empty text has zero of everything.

    Words are runs of anything but ASCII white space.  Columns other than doc_id and text are ignored, or
    with ``carry`` the whole row comes along as a struct ``row``, so that no name can clash.
    """
    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    texts = docs.select(*columns)
    extra = ["row"] if carry else []

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, limit=MEASURE_BYTES):
            raw, at = tk.text_buffer(tk.column(batch, "text"))
            found = text_counts(raw, at)
            yield pa.record_batch(
                [tk.column(batch, c) for c in ["doc_id", *extra]] + [pa.array(found[c], pa.int64()) for c in COUNTS],
                names=["doc_id", *extra, *COUNTS],
            )

    kept = T.StructType([f for f in texts.schema.fields if f.name != "text"])
    return texts.mapInArrow(measure, T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def text_counts(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(at) - 1

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[at[1:]] - total[at[:-1]]

    def per_row(row: np.ndarray) -> np.ndarray:
        return np.bincount(row, minlength=rows).astype(np.int64)

    starts, ends, row = tk.spans(raw, at, tk.NOT_SPACE)
    words = tk.hash_spans(raw, starts, ends)
    code_point = (raw & 0xC0) != 0x80
    lines, line_ends, line_row = tk.spans(raw, at, _LINE)
    word_before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(tk.NOT_SPACE[raw], out=word_before[1:])
    full = word_before[line_ends] > word_before[lines]
    lines, line_ends, line_row = lines[full], line_ends[full], line_row[full]
    line_hash = tk.hash_spans(raw, lines, line_ends)
    window, first = tk.windows(words, row, WINDOW)
    window_row = row[first]
    repeated = np.zeros(len(words) + 1, bool)
    again = first[~_single(window, window_row)]
    for i in range(WINDOW):
        repeated[again + i] = True
    return {
        "n_words": per_row(row),
        "word_chars": within(code_point & tk.NOT_SPACE[raw]),
        "n_symbols": within(_SYMBOLS[raw]),
        "n_dup_lines": per_row(line_row) - per_row(line_row[_firsts(line_hash, line_row)]),
        "n_repeat_words": per_row(row[repeated[:-1]]),
        "n_bytes": np.diff(at),
        "n_lines": per_row(line_row),
        "n_digits": within(_DIGITS[raw]),
        "n_upper": within(_UPPER[raw]),
        "n_marks": within(_MARKS[raw]),
        "n_distinct": per_row(row[_firsts(words, row)]),
    }


def _runs(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (row, hash), and the starts of equal runs in that order."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return order, new


def _firsts(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    order, new = _runs(hashes, row)
    return order[new]


def _single(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries have no equal in their row."""
    order, new = _runs(hashes, row)
    out = np.zeros(len(hashes), bool)
    out[order] = new & np.r_[new[1:], True][: len(new)]
    return out


# What rules may test: name -> (numerator, denominator), as counts or 1.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
    "digit_share": ("n_digits", "n_bytes"),
    "upper_share": ("n_upper", "n_bytes"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"),
    "words": ("n_words", None),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") / F.greatest(F.col(bottom) if bottom else F.lit(1), F.lit(1)).cast("double")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def expression(self) -> Column:
        return feature(self.feature) > self.cut if self.above else feature(self.feature) <= self.cut

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects, and what no rule holds for is kept."""

    rules: tuple[tuple[Test, ...], ...]

    def keeps(self) -> Column:
        out = None
        for rule in self.rules:
            holds = rule[0].expression()
            for test in rule[1:]:
                holds = holds & test.expression()
            out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def text(self) -> list[str]:
        return [" and ".join(f"{t.feature} {'>' if t.above else '<='} {t.cut:.6g}" for t in r) for r in self.rules]


def learn(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """A decision list from labels (doc_id, quality); quality 0 is bad, null is no label.

    At most ``max_labelled`` rows are used, those with the least hash of doc_id; without labels, or with
    labels of one kind, the list is empty and keeps everything.  What fails the base tests needs no rule.
    """
    marked = labels.select(F.col("doc_id").cast("long"), "quality").filter("quality is not null")
    rows = (
        stats.filter(~base_failed())
        .join(marked.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
        .select(F.xxhash64("doc_id").alias("h"), "doc_id", "quality", *[feature(f).alias(f) for f in FEATURES])
        .orderBy("h", "doc_id", *FEATURES)
        .limit(max_labelled)
        .toArrow()
    )
    x = {f: rows[f].to_numpy() for f in FEATURES}
    return cover(x, rows["quality"].to_numpy() == 0)


def cover(x: dict[str, np.ndarray], bad: np.ndarray) -> DecisionList:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, drop what it covers."""
    rules: list[tuple[Test, ...]] = []
    grow = np.arange(len(bad)) % 3 != 0
    open_rows = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and (bad & open_rows & grow).sum() >= MIN_COVER:
        rule = _grow(x, bad, open_rows & grow)
        rule = _prune(rule, x, bad, open_rows & ~grow)
        if not rule:
            break
        covered = _covered(rule, x) & open_rows
        held = covered & ~grow
        if held.sum() < MIN_COVER or bad[held].mean() < MIN_PRECISION or bad[covered].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        open_rows &= ~covered
    return DecisionList(tuple(rules))


def _covered(rule: tuple[Test, ...], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[Test, ...]:
    """Add the test with the highest gain until only bad rows are left."""
    rule: list[Test] = []
    rows = rows.copy()
    while len(rule) < MAX_TESTS:
        p, n = int((bad & rows).sum()), int((~bad & rows).sum())
        if not p or not n:
            break
        base = math.log2(p / (p + n))
        best, best_gain = None, 0.0
        for name in FEATURES:
            values = x[name][rows]
            for cut in np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")):
                over = values > cut
                for above, chosen in ((True, over), (False, ~over)):
                    p1 = int(bad[rows][chosen].sum())
                    if p1 and chosen.sum() < len(values):
                        gain = p1 * (math.log2(p1 / chosen.sum()) - base)
                        if gain > best_gain:
                            best, best_gain = Test(name, above, float(cut)), gain
        if best is None:
            break
        rule.append(best)
        rows &= best.holds(x)
    return tuple(rule)


def _prune(rule: tuple[Test, ...], x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[Test, ...]:
    """The shortest start of the rule that separates best on rows it was not grown on."""
    best, best_worth = (), -2.0
    for k in range(1, len(rule) + 1):
        covered = _covered(rule[:k], x) & rows
        if covered.sum():
            worth = 2 * bad[covered].mean() - 1
            if worth > best_worth + 1e-12:
                best, best_worth = rule[:k], worth
    return best


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to statistics."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keeps())
