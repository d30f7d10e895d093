"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, new_scratch_path
from . import (
    alignment,
    decontaminate,
    digest_index,
    jaccard,
    licenses,
    ngram_model,
    packing,
    passages,
    periodic,
    quality,
    repeats,
    secrets,
    sharding,
)
from . import textkit as tk
from .common import table

SHARDS = 24
# Loads in which the documents reach the digest index, so that all but the first meet one that holds something.
LOADS = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), tokenizer_path())
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality.statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = quality.learn(stats, table(spark, sf_dir, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality.judge(stats, rules).select("doc_id", *names, "base_failed", "kept")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret found, by place and digest; the value itself is not put out again."""
    found = secrets.scan(table(spark, sf_dir, "documents")).filter("is_secret")
    return found.select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.length("value").cast("long").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        "probability",
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.fuzzy_passages(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = ngram_model.fit(docs.filter(~held_out))
    return ngram_model.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def planted_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, every tenth of which is given a long run that its id decides."""
    g, h = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if doc_id is None or h or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            ids = tk.column(batch, "doc_id")
            texts = tk.column(batch, "text").cast(pa.binary()).to_pylist()
            texts = [b" ".join(planted_words(d, (t or b"").split())).decode() for d, t in zip(ids.to_pylist(), texts)]
            yield pa.record_batch([ids, pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(plant, "doc_id long, text string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    # Runs come by start and period, so the first of the greatest wins; exponents are compared exactly.
    top = F.aggregate(
        "runs",
        F.try_element_at("runs", F.lit(1)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("*", top.alias("top"), F.array_join(line, "").alias("lines")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = digest_index.open_index(docs.sparkSession, new_scratch_path(spark, "digest-index"))
    arrives = F.pmod(F.xxhash64("doc_id"), F.lit(LOADS))
    for load in range(LOADS):
        digest_index.add(index, docs.filter(arrives == load), load)
    return digest_index.decisions(index).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scans": op4_secret_scans,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_sharding": op6_sharding,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scans": op9_license_scans,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLE: dict[str, str] = {"op9_license_scans": licenses.oracle(), "op13_exact_dedup": digest_index.oracle()}
