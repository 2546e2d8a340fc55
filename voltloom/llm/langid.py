"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of bits. One binary classifier per bit, with log-odds of hashed n-grams as weights, tells
the languages with a 1 from those with a 0. A text goes to the language whose codeword costs least: the logistic
losses of the classifiers' margins, weighted by how reliable each bit is for that language. Two codewords of almost the same cost
are flagged as ambiguous.

Counts of n-grams cover every training row. The bits' reliabilities are measured on a sample of about CALIBRATION training
rows, chosen by the hash of their text. What reaches the driver is a table of languages by FEATURES, independent of the rows.

Defined results: null text or text without a letter is ``und`` with score 0, as is everything if nothing was learned; ties go to the
first language by code point; rows with null lang are never learned from; a null doc_id is neither learned from nor held out;
repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import BATCH_ROWS, small_batches

FEATURES = 1 << 13
GRAMS = (2, 3, 4)
CALIBRATION = 4000
#: Margins are mean log-odds per n-gram; the loss takes them times SHARP. Two costs closer than NEAR are ambiguous.
SHARP, NEAR = 12.0, 0.25
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1 << 20


def features(text: str) -> np.ndarray:
    """Counts of the hashed byte n-grams of the whole text, A-Z lower-cased, in blocks of bounded size."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").lower() + b" ", np.uint8)
    counts = np.zeros(FEATURES, np.int64)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    for at in range(0, len(data), _BLOCK):
        part = data[at : at + _BLOCK + max(GRAMS) - 1].astype(np.uint32)
        h = part * np.uint32(2654435761)
        for n in range(2, max(GRAMS) + 1):
            starts = min(_BLOCK, len(data) - at - n + 1)
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + part[n - 1 :] * np.uint32(3266489917)
            if n in GRAMS and starts > 0:
                counts += np.bincount(((h[:starts] * np.uint32(2654435761)) >> shift), minlength=FEATURES)
    return counts


def codewords(languages: int) -> np.ndarray:
    """Rows of -1 and 1, one per language: all splits of few languages, else random words that lie far apart."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= 6:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(languages)], np.int8)
    bits, rng, best = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(languages), None
    for _ in range(50):
        words = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        agree = words.astype(np.int32) @ words.T - 2 * bits * np.eye(languages, dtype=np.int32)
        if best is None or agree.max() < best[0]:
            best = (agree.max(), words)
    return best[1]


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.words = languages, codewords(len(languages))
        rates = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * FEATURES) if len(languages) else counts
        self.weights = np.zeros((FEATURES, self.words.shape[1]), np.float32)
        for j, bit in enumerate(self.words.T):
            self.weights[:, j] = np.log(rates[bit > 0].mean(0)) - np.log(rates[bit < 0].mean(0))
        self.trust = np.full(self.words.shape, 1 / max(1, self.words.shape[1]))

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.float32) @ self.weights / np.maximum(1, counts.sum(-1, keepdims=True))

    def costs(self, margins: np.ndarray) -> np.ndarray:
        """Rows of texts, columns of languages: the weighted logistic losses, per bit."""
        loss = np.logaddexp(0, -SHARP * margins[:, None, :] * self.words[None])
        return (loss * self.trust[None]).sum(2) * self.words.shape[1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score from 0 to 1, ambiguous) of each text."""
        real = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        out = [(UNKNOWN, 0.0, False)] * len(texts)
        if not self.languages:
            return out
        for i in real:  # a single row at a time: features of a text are large beside most texts
            cost = self.costs(self.margins(features(texts[i]))[None])[0] if self.words.shape[1] else np.zeros(1)
            share = np.exp(cost.min() - cost)
            order = np.argsort(cost, kind="stable")
            near = len(order) > 1 and cost[order[1]] - cost[order[0]] < NEAR
            out[i] = (self.languages[order[0]], float(1 / share.sum()), bool(near))
        return out


def held_out(doc_id, folds: int = 5):
    """Whether a document is kept from training: the crc32 of its id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(rows: DataFrame) -> Model:
    """Learn from all rows of (text, lang); rows with a null in either are skipped."""
    small_batches(rows.sparkSession)
    rows = rows.where("text is not null and lang is not null").select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            there = [(lang, np.flatnonzero(c)) for lang, c in held.items()]
            out = pd.DataFrame({
                "lang": np.concatenate([np.full(len(i), lang, object) for lang, i in there]),
                "feature": np.concatenate([i for _, i in there]).astype(np.int32), "n": np.concatenate([held[lang][i] for lang, i in there]),
            })
            held.clear()
            return out

        for batch in batches:
            for text, lang in zip(batch.text, batch.lang, strict=True):
                if lang not in held:
                    if len(held) == 64:
                        yield flush()
                    held[lang] = np.zeros(FEATURES + 1, np.int64)
                held[lang][:FEATURES] += features(text)
                held[lang][FEATURES] += 1
        if held:
            yield flush()

    table = rows.mapInPandas(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    # Order by code point, as the bytes of UTF-8 have it.
    languages = sorted(table.lang.unique(), key=lambda x: x.encode("utf-8", "surrogatepass"))
    counts = np.zeros((len(languages), FEATURES + 1))
    counts[table.lang.map({lang: i for i, lang in enumerate(languages)}).to_numpy(int), table.feature.to_numpy(int)] = table.n
    model = Model(languages, counts[:, :FEATURES])
    if model.words.shape[1]:
        calibrate(model, rows, int(counts[:, FEATURES].sum()))
    return model


def calibrate(model: Model, rows: DataFrame, total: int) -> None:
    """Set each bit's weight for each language to the share of sampled rows of the language on which it is right."""
    share = min(1.0, CALIBRATION / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {lang: i for i, lang in enumerate(model.languages)}
        hits, seen = np.zeros(model.words.shape), np.zeros(len(model.languages))
        for batch in batches:
            for text, lang in zip(batch.text, batch.lang, strict=True):
                i = place[lang]
                hits[i] += np.sign(model.margins(features(text))) == model.words[i]
                seen[i] += 1
        i, bit = np.nonzero(np.repeat(seen[:, None] > 0, hits.shape[1], 1))
        yield pd.DataFrame({"language": i, "bit": bit, "hits": hits[i, bit], "seen": seen[i]})

    found = sample.mapInPandas(right, "language int, bit int, hits double, seen double")
    hits, seen = np.ones(model.words.shape), np.ones(model.words.shape)
    for r in found.groupBy("language", "bit").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).collect():
        hits[r["language"], r["bit"]] += r["hits"]
        seen[r["language"], r["bit"]] += r["seen"]
    share = hits / seen
    model.trust = share / share.sum(1, keepdims=True)


def identify(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``name`` of pred, score and ambiguous, from the text alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("pred string, score double, ambiguous boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(text), BATCH_ROWS):
            out += shared.value.predict(text.iloc[at : at + BATCH_ROWS].tolist())
        return pd.DataFrame(out, columns=["pred", "score", "ambiguous"])

    return docs.withColumn(name, predict("text"))


def label(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row, learned from the rows that are not held out."""
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"))
    model = train(rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = identify(rows.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.pred").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.ambiguous").alias("ambiguous"))
