"""Secret findings, with false positives removed by a random forest.

Long runs of key characters, and values that stand by a key word, are candidates.  Each is described by its length, how often its characters
change kind, how much of it the corpus' frequent words cover, the path it comes from and the words around
it.  A random forest learned from labelled findings decides.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.selection import stratified_sample
from ..session import materialize, measured_side

MIN_LENGTH = 16
# Characters of a value that stands by a key word, at least.
MIN_VALUE = 6
CONTEXT = 60
DICTIONARY_WORDS = 500
# Labelled findings that a forest is learned from, at most; those with the least hashes are taken.
MAX_LABELLED = 20_000
TREES = 20
DEPTH = 6
THRESHOLD = 0.5

# A long run of key characters, with what dots and tildes join to it and its padding.
_C = "[A-Za-z0-9+/_-]"
_RUN = (
    rf"(?<!{_C})(?:{_C}++[.~]){{0,8}}{_C}{{{MIN_LENGTH},}}+(?:[.~]{_C}++){{0,8}}+"
    rf"""(?:==(?!{_C}|=)|=(?=["'`,;)\]}}<>]|[ \t\r]*(?:\n|$)))?+"""
)
# Words that stand by secrets, words that stand by other codes, and paths of examples.
_KEYS = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|credential|bearer|auth|private|access)(?:[_-]?key|s)?"
_KEY_WORDS = f"(?i){_KEYS}"
_CODE_WORDS = r"(?i)(sha-?\d*|md5|commit|digest|checksum|hash|uuid|isbn|card|phone|example|placeholder|dummy)"
_EXAMPLE_PATH = r"(?i)(test|example|sample|fixture|mock|doc)"
# A value that is assigned to a key word or quoted after it, however short its characters make it.
_IS = r"""["'`]?\s{0,3}(?::=|=>|[=:])\s{0,3}"""
_VALUE = "|".join(
    [rf"(?<=[=:>\s]{q})(?<=(?i:{_KEYS})(?:{_IS}|\s{{1,3}}(?:is\s)?){q})[^\s{q}]{{{MIN_VALUE},}}+" for q in "\"'`"]
    + [
        rf"""(?<=[=:>]\s{{0,3}})(?<=(?i:{_KEYS}){_IS})[^\s"'`<>,;=:][^\s"'`<>,;]{{{MIN_VALUE - 2},}}[^\s"'`<>,;.:)\]}}]"""
    ]
)
_FOUND = f"{_VALUE}|{_RUN}"

FEATURES = [
    "chars", "changes", "digits", "uppers", "distinct", "hex", "covered",
    "assigned", "quoted", "key_word", "code_word", "in_path", "example_path",
]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, value, before, after, path): every run of 16 or more key
    characters, and every value of 6 or more characters other than space that is assigned to a key word or
    quoted after it.

    ``start`` counts characters from 0, ``path`` is the column ``source`` if there is one.  Null and
    empty texts have no candidates; other columns are ignored; repeated rows give repeated candidates.
    """
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    found = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), path.alias("path"), text.alias("text"),
        F.regexp_extract_all(text, F.lit(_FOUND), F.lit(0)).alias("runs"),
    ).filter(F.size("runs") > 0)
    # What lies between the runs, one more than there are runs.
    gaps = found.withColumn("gaps", F.split("text", _FOUND)).withColumn("row", F.monotonically_increasing_id())
    each = gaps.select(
        "row", "doc_id", "text_hash", "path",
        F.posexplode(
            F.transform(
                "runs",
                lambda run, i: F.struct(
                    run.alias("value"),
                    F.length(F.get("gaps", i)).alias("gap"),
                    # A long name that a value is assigned to is a run itself.
                    F.right(
                        F.concat(F.coalesce(F.get("runs", i - 1), F.lit("")), F.get("gaps", i)), F.lit(CONTEXT)
                    ).alias("before"),
                    F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after"),
                ),
            )
        ).alias("place", "run"),
    )
    up_to = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("run.value")
    return each.select(
        "doc_id", "text_hash",
        (F.sum(F.col("run.gap") + length).over(up_to) - length).alias("start"),
        "run.value", "run.before", "run.after", "path",
    )


def frequent_words(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The words of 3 to 8 letters that most documents hold, ``words`` of them, counted over all texts."""
    each = F.explode(F.array_distinct(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+"))).alias("word")
    counts = docs.select(each).filter(F.length("word").between(3, 8)).groupBy("word").count()
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(words).collect()]


def described(found: DataFrame, words: list[str]) -> DataFrame:
    """Add the features of candidates; ``words`` is the dictionary."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    chars = F.length(value)

    def share(part: Column) -> Column:
        return part / chars

    def left_without(pattern: str) -> Column:
        return F.length(F.regexp_replace(value, pattern, ""))

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    known = "(?i)" + "|".join(sorted(words, key=lambda w: (-len(w), w))) if words else "(?!)"
    flag = lambda c: c.cast("double")
    return found.withColumns(
        {
            "chars": chars.cast("double"),
            "changes": share(F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1),
            "digits": share(chars - left_without("[0-9]")),
            "uppers": share(chars - left_without("[A-Z]")),
            "distinct": share(F.size(F.array_distinct(F.split(value, "")))),
            "hex": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "covered": share(chars - left_without(known)),
            "assigned": flag(before.rlike(r"""[=:]\s{0,3}["']?$""")),
            "quoted": flag(before.rlike("""["']$""") & after.rlike("""^["']""")),
            "key_word": flag(before.rlike(_KEY_WORDS + r"\W{0,5}$")),
            "code_word": flag(F.concat(before, after).rlike(r"\b" + _CODE_WORDS + r"\b")),
            "in_path": flag(before.rlike(r"[/\\]$") | after.rlike(r"^\.[a-z]{2,4}\b") | value.rlike(r"/.*/|\.[a-z]{2,4}$")),
            "example_path": flag(F.coalesce(F.col("path").rlike(_EXAMPLE_PATH), F.lit(False))),
        }
    )


def weak_labels(found: DataFrame) -> DataFrame:
    """Candidates with a ``label`` where their form settles it: 1 for keys by their maker's format and
    for values of a key word with a digit, 0 for runs of one kind of character alone (prose and plain numbers)
    that no key word stands by.  Other values of key words, such as passphrases of letters, are left to the forest."""
    value = F.col("value")
    given = value.rlike("^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[0-9A-Za-z-]{16,})$")
    named = F.col("before").rlike(_KEY_WORDS + r"""\s?[=:]\s?["']?$""") & value.rlike("[0-9]")
    plain = value.rlike("^([A-Za-z]+|[0-9]+)$") & ~F.col("before").rlike(_KEY_WORDS + r"\W{0,5}$")
    label = F.when(given | named, F.lit(1.0)).when(plain, F.lit(0.0))
    return found.withColumn("label", label).filter("label is not null")


def learn(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> RandomForestClassificationModel | None:
    """A forest from described findings with ``label`` 0 or 1; none if only one kind is there.

    At most ``max_labelled`` rows of each kind are used, those with the least hashes; no kind meets in one task.
    """
    bounded = stratified_sample(labelled, ["label"], max_labelled, ["value", "doc_id", "start"])
    bounded = materialize(bounded.select("label", *FEATURES), "labelled-findings")
    if bounded.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, labelCol="label", featuresCol="features")
    return forest.fit(_vectors(bounded))


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(found)


def judged(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Add ``probability`` of a secret and ``is_secret``; without a model every candidate stays."""
    if model is None:
        out = found.withColumn("probability", F.lit(1.0))
    else:
        out = model.transform(_vectors(found)).drop("features", "rawPrediction", "prediction")
        out = out.withColumn("probability", vector_to_array("probability")[1])
    return out.withColumn("is_secret", F.col("probability") >= THRESHOLD)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of ``docs`` with features, probability and ``is_secret``.

    ``labelled`` are findings (doc_id, start, label); without them the forest learns from those whose
    form settles what they are.  An empty table gives no candidates.
    """
    found = materialize(described(candidates(docs), frequent_words(docs)), "findings")
    if labelled is None:
        known = weak_labels(found)
    else:
        known = found.join(labelled.select("doc_id", "start", F.col("label").cast("double")), ["doc_id", "start"])
    return judged(found, learn(known))


def redact(docs: DataFrame, found: DataFrame, mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with every secret of ``found`` replaced where it stands; other columns stay as they are.

    Secrets are cut out by place and length, so the same characters elsewhere stay.  No column's name can clash.
    """
    place = F.struct(F.col("start").cast("int").alias("start"), F.length("value").alias("length"))
    per_doc = found.filter("is_secret").groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(
        F.sort_array(F.collect_set(place)).alias("places")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("known_id"), F.xxhash64("text").alias("known_text"))
    same = F.col("known_id").eqNullSafe(F.col("id")) & (F.col("known_text") == F.col("hash"))
    joined = rows.join(measured_side(per_doc, "masked"), same, "left")
    text = F.col("row")["text"].cast("string")
    # What stands between two secrets, and after the last.
    before = F.transform(
        "places",
        lambda p, i: F.substring(
            text,
            F.when(i > 0, F.get("places", i - 1)["start"] + F.get("places", i - 1)["length"]).otherwise(0) + 1,
            p["start"] - F.when(i > 0, F.get("places", i - 1)["start"] + F.get("places", i - 1)["length"]).otherwise(0),
        ),
    )
    last = F.element_at("places", -1)
    end = last["start"] + last["length"] + 1
    rest = F.substring(text, end, F.greatest(F.length(text) - end + 1, F.lit(0)))
    clean = F.concat(F.array_join(before, mask), F.lit(mask), rest)
    clean = F.when(F.col("places").isNull(), F.col("row")["text"]).otherwise(clean)
    return joined.select(*[clean.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
