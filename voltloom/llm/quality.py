"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and pairs of words (a run of letters, digits and underscores, or of other signs, lower-cased) are hashed into BUCKETS. One
multinomial over the buckets is counted on all trusted target documents, one on all documents. A document's score is the
mean of log(target / raw) over its n-grams; it is kept if the score reaches a fixed threshold and the rules hold. Nothing is
drawn at random: the same document with the same tables always has the same verdict.

Defined results: null text has no words; a text without n-grams has score 0 and fails the rules; without trusted documents every
ratio is 0; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored. A document is
trusted if some label row gives it quality 1 and none calls it toxic; labels with null doc_id or quality do not count.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import few

BUCKETS = 10_000
#: Documents whose mean log ratio lies below are rejected.
THRESHOLD = -0.4
#: Pseudo-counts per bucket.
SMOOTH = 1.0
WINDOW = 8
_BLANK = " \t\n\x0b\f\r"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def words(text: Column) -> Column:
    """Runs without ASCII white space."""
    inner = F.btrim(text, F.lit(_BLANK))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{_BLANK}]+"))


def shifted(items: Column, by: int) -> Column:
    return F.slice(items, by + 1, F.size(items))


def rule_columns(docs: DataFrame) -> DataFrame:
    """doc_id, ``_text`` and the counts of the rules."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    d = d.withColumn("_words", words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(f"[^{_BLANK}]"))
    d = d.withColumn("_lines", lines).withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    # Eight words in three doublings; the last windows reach past the end and are cut off.
    for step in (1, 2, 4):
        d = d.withColumn("_hash", F.zip_with("_hash", shifted(F.col("_hash"), step), lambda a, b: F.xxhash64(a, b)))
    n = F.size("_words")
    d = d.withColumn("_windows", F.slice("_hash", 1, F.greatest(F.lit(0), n - (WINDOW - 1))))
    d = d.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    placed = F.array_sort(F.zip_with("_windows", F.sequence(F.lit(1), F.size("_windows")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_placed", F.when(F.col("_repeats"), placed))
    same = F.zip_with("_placed", shifted(F.col("_placed"), 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("_at", F.when(F.col("_repeats"), F.array_sort(F.array_distinct(F.flatten(same)))))
    # Each repeated window adds the words that the one before it did not cover.
    covered = F.aggregate(
        "_at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")), lambda s: s["n"],
    )
    return d.select(
        "doc_id", "_text", n.cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def single(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def double(tokens: Column) -> Column:
    """Buckets of neighbouring tokens."""
    both = F.zip_with(tokens, shifted(tokens, 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))
    return F.slice(both, 1, F.greatest(F.lit(0), F.size(tokens) - 1))


def ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(target / raw) of every bucket; ``trusted`` has distinct doc_ids. The driver sees BUCKETS rows whatever the corpus."""
    mine = few(trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("_trusted")))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    d = d.join(mine, "doc_id", "left").select("_trusted", tokens(F.col("_text")).alias("_tokens"))
    grams = F.concat(F.transform("_tokens", single), double(F.col("_tokens")))
    counts = d.select("_trusted", F.explode(grams).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
    raw, target = [SMOOTH] * BUCKETS, [SMOOTH] * BUCKETS
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if sum(target) <= SMOOTH * BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw, strict=True)]


def trusted_documents(labels: DataFrame) -> DataFrame:
    by_doc = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return by_doc.where("q = 1 and t = 0").select("doc_id")


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rules' counts, base_failed, llr and kept for every row."""
    ratio = ratios(docs, trusted)
    d = rule_columns(docs).withColumn("_tokens", tokens(F.col("_text"))).drop("_text")
    table = F.from_json(F.lit(json.dumps(ratio)), "array<double>")
    one = F.aggregate("_tokens", F.lit(0.0), lambda s, t: s + F.get(table, single(t)))
    two = F.aggregate(double(F.col("_tokens")), F.lit(0.0), lambda s, b: s + F.get(table, b))
    n = F.size("_tokens")
    d = d.withColumn("llr", F.when(n == 0, F.lit(0.0)).otherwise((one + two) / (2 * n - 1))).drop("_tokens")
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
