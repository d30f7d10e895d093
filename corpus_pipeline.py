"""From raw documents to packed training sequences: five stages, each a table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exprlake.llm import decontaminate, jaccard, packing, quality, secrets
from exprlake.llm.common import table
from exprlake.llm.queries import tokenizer_path
from exprlake.session import materialize, measured_side, temporary_tables

# Near duplicates share at least this much of their runs of so many words.
DUPLICATE_WORDS = 5
DUPLICATE_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base tests and that no learned rule rejects."""
    rules = quality.learn(quality.statistics(docs), table(spark, sf_dir, "labels"))
    return quality.judge(quality.statistics(docs, carry=True), rules).filter("kept").select("row.*")


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one value beside what it is known by, so that no column's name can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, F.col("doc_id").cast("long").alias("known_id"), F.xxhash64("text").alias("known_text"))


def _same_row() -> Column:
    return F.col("known_id").eqNullSafe(F.col("id")) & (F.col("known_text") == F.col("hash"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id.

    A null doc_id counts as larger than all others.  Rows that repeat one doc_id are told apart by their texts,
    and of equal rows one stays.  Texts without words form no groups and all stay.  An empty table stays empty.
    """
    with temporary_tables(spark):
        groups = jaccard.grouped(docs, DUPLICATE_WORDS, DUPLICATE_PERCENT, count_links=False)
        rows = groups.groupBy("group", "n_shingles", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
        who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "n")
        first = rows.filter("n_shingles > 0").groupBy("group").agg(F.min(who).alias("who"))
        first = first.select(F.col("who.doc_id").alias("id"), F.col("who.text_hash").alias("hash"), (F.col("who.n") > 1).alias("several"))
        bare = rows.filter("n_shingles = 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.lit(False))
        kept = materialize(first.union(bare), "kept", outlives=True)
    # Few rows as a rule have an equal one, so the others need not meet.
    one = _rows(docs).join(measured_side(kept.filter("not several"), "kept-once"), _same_row())
    several = _rows(docs).join(measured_side(kept.filter("several"), "kept-of-several"), _same_row())
    return one.union(several.dropDuplicates(["known_id", "known_text"])).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; an empty table stays empty."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = found.filter(F.size("spans") > 0)
    hit = hit.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    return _rows(docs).join(measured_side(hit, "contaminated"), _same_row(), "left_anti").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.redact(docs, secrets.scan(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and the place in it that each is packed into."""
    pieces = packing.tokenize(docs, tokenizer_path())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
# Learned rules, groups by links and packing have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
