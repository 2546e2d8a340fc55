"""Personal data in whole texts: strict rules, and contexts learned from what the rules find.

The rules' entities are seeds. The words around a seed are its patterns (the two words before it; the word on either side).
Patterns and the values they surround form a graph: a pattern is trusted for a kind by the share of its distinct values
that belong to the kind, a value by the trusted patterns around it, in turns. Identifier-like words, and runs of digit words
with spaces, brackets, dots or hyphens between them, are added in trusted contexts as spans of the kind. Values count once however many copies of a text exist.

Defined results: null text counts as empty and has no spans; repeated rows give repeated results; of equally trusted
kinds the first in KINDS wins; an empty table gives no rows; extra columns are ignored by ``find`` and kept by ``redact``.
Rows are matched to learned spans by the hash of their text, so null or repeated doc_ids do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import few, small_batches, stored

#: Kinds in the order of the result.
KINDS = ["email", "ip", "card", "phone"]
#: A pattern is trusted from this share of its distinct values on, and from so many values of the kind.
TRUST, SUPPORT, ROUNDS = 0.8, 3, 3
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")
#: Neighbouring groups of digits, joined by what cards and phones may have between them.
_RUN = re.compile(r"(?<![^\s\"'(\[{<,;:=])(?:\+\(?|\()?[0-9]++(?:[ ().-]{1,3}+[0-9]++(?![^\s\"'()\[\]{}<>,;:!?.=-]))+")
_EDGE = "\"'()[]{}<>,;:!?.="
_SPAN = "array<struct<kind:string,start:int,end:int>>"
_FOUND = f"doc_id long, text_key long, base {_SPAN}, near array<struct<start:int,end:int,value:long,kind:string,before:long,around:long>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def rules(text: str) -> list[tuple[str, int, int]]:
    """Spans by rule, leftmost without overlap per kind; matches that fail a kind's test are dropped."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        done = m.end() if m else at + 1
        if m:
            found.append(("email", start, done))
        at = text.find("@", done)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return found


def hashed(*words: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(words)) - (1 << 63)


def word_before(text: str, at: int) -> tuple[str, int]:
    """The word that ends before ``at``, in lower case without punctuation at its edges, and its place."""
    end = at
    while end > 0 and (text[end - 1].isspace() or text[end - 1] in _EDGE):
        end -= 1
    start = end
    while start > 0 and not text[start - 1].isspace() and end - start < 40:
        start -= 1
    return text[start:end].strip(_EDGE).lower(), start


def word_after(text: str, at: int) -> str:
    start = at
    while start < len(text) and (text[start].isspace() or text[start] in _EDGE):
        start += 1
    end = start
    while end < len(text) and not text[end].isspace() and end - start < 40:
        end += 1
    return text[start:end].strip(_EDGE).lower()


def neighbours(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and identifier-like words or runs of digit words (four digits or more, or an @) outside them, with hashes of their contexts."""
    spans = [(a, b, kind) for kind, a, b in base]
    covered = sorted((a, b) for a, b, _ in spans)
    # An identifier in several words has its context outside all of them.
    k, wide = 0, []
    for m in _RUN.finditer(text):
        a, b = m.span()
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if (k == len(covered) or covered[k][0] >= b) and len(_DIGITS.findall(m[0])) >= 4:
            wide.append((a, b))
            spans.append((a, b, None))
    # Only words that hold a digit or an @ can be identifiers; most texts have few.
    seen, k, r = -1, 0, 0
    for m in re.finditer(r"[0-9@]", text):
        if m.start() < seen:
            continue
        a = m.start()
        while a > max(0, seen) and not text[a - 1].isspace():
            a -= 1
        t = _TOKEN.match(text, m.start())
        b = seen = t.end() if t else m.end()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k < len(covered) and covered[k][0] < b:
            continue
        while r < len(wide) and wide[r][1] < b:
            r += 1
        if r < len(wide) and text[wide[r][0] : wide[r][1]].strip(_EDGE) == text[a:b] and wide[r][0] <= a:
            continue
        word = text[a:b]
        if "@" in word or len(_DIGITS.findall(word)) >= 4:
            spans.append((a, b, None))
    out = []
    for a, b, kind in spans:
        one, at = word_before(text, a)
        two, _ = word_before(text, at)
        after = word_after(text, b)
        out.append({"start": a, "end": b, "value": hashed(text[a:b]), "kind": kind, "before": hashed("before", two, one), "around": hashed("around", one, after)})
    return out


def survey(docs: DataFrame) -> DataFrame:
    """Per row: the hash of its text, the spans by rule, and what could be learned from or found."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = [rules(t) for t in batch.text]
            yield pd.DataFrame({
                "doc_id": batch.doc_id, "text_key": batch.text_key,
                "base": [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in base],
                "near": [neighbours(t, spans) for t, spans in zip(batch.text, base, strict=True)],
            })

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInPandas(run, _FOUND)


def trusted_patterns(surveyed: DataFrame, trust: float = TRUST, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) after ``rounds`` turns between patterns and values, all as Spark joins over distinct pairs."""
    near = surveyed.select(F.explode("near").alias("n")).select("n.*")
    edges = near.select(F.explode(F.array("before", "around")).alias("pattern"), "value", "kind")
    edges = stored(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = edges.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score"))
    patterns = None
    for turn in range(rounds):
        named = edges.select("pattern", "value").join(scores, "value")
        sums = named.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        good = sums.where(F.col("mass") >= support).join(sizes, "pattern").withColumn("confidence", F.least(F.lit(1.0), F.col("mass") / F.col("n")))
        patterns = stored(good.where(F.col("confidence") >= trust).select("pattern", "kind", "confidence"), "pii-patterns")
        if turn + 1 < rounds:
            # A value is wrong only if every trusted pattern around it is.
            doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))
            learned = edges.where("kind is null").join(patterns.withColumnRenamed("kind", "as"), "pattern").groupBy("value", F.col("as").alias("kind")).agg((1 - doubt).alias("score"))
            seeds = edges.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score"))
            scores = stored(seeds.unionByName(learned.where(F.col("score") >= trust)), "pii-scores")
    return patterns


def learned_spans(surveyed: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_key, added spans): identifier-like words in trusted contexts, each with its most trusted kind."""
    texts = surveyed.where(F.exists("near", lambda n: n["kind"].isNull())).select("text_key", F.explode("near").alias("n")).where("n.kind is null")
    uses = texts.select("text_key", "n.start", "n.end", F.explode(F.array("n.before", "n.around")).alias("pattern")).distinct()
    hits = uses.join(few(patterns), "pattern")
    best = hits.groupBy("text_key", "start", "end").agg(F.max(F.struct("confidence", F.negate(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))).alias("o"), "kind")).alias("b"))
    # A word inside a longer span says nothing more.
    before = Window.partitionBy("text_key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("reach", F.max("end").over(before)).where(F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    return best.groupBy("text_key").agg(F.collect_list(F.struct(F.col("b.kind").alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` spans by rule and ``spans``, all of them; code points, end exclusive, ordered by kind and start."""
    surveyed = stored(survey(docs), "pii-survey")
    added = stored(learned_spans(surveyed, trusted_patterns(surveyed)), "pii-added")
    rows = surveyed.select("doc_id", "text_key", "base").join(few(added), "text_key", "left")
    none = F.array().cast(_SPAN)
    return rows.select("doc_id", by_kind(F.col("base")).alias("base"), by_kind(F.concat("base", F.coalesce("added", none))).alias("spans"))


def by_kind(spans):
    """Spans in the order of KINDS, then by start."""
    return F.flatten(F.array(*[F.array_sort(of_kind(spans, k)) for k in KINDS]))


def of_kind(spans, kind: str):
    return F.filter(spans, lambda s: s["kind"] == kind)


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the rules' spans and all spans as text."""
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced by its kind, such as <EMAIL>. Null stays null."""
    surveyed = stored(survey(docs), "pii-survey")
    added = stored(learned_spans(surveyed, trusted_patterns(surveyed)), "pii-added")
    key, extra = free_name(docs, "text_key"), free_name(docs, "added")
    added = added.select(F.col("text_key").alias(key), F.col("added").alias(extra))

    @F.pandas_udf("string")
    def masked(text: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else mask(t, m) for t, m in zip(text, more, strict=True)])

    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).join(few(added), key, "left")
    # Structs reach pandas as text that any worker reads the same way.
    spans = F.array_join(F.transform(extra, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.withColumn("text", masked("text", spans)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mask(text: str, more: str | None) -> str:
    spans = rules(text) + [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in (more or "").split(",") if s)]
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


