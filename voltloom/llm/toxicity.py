"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. Terms are runs of five bytes inside words, a space standing for a word's edge, so a stem is found in any of its forms. The
   labelled rows' documents are counted per term, and the terms that tell the labels apart best are the vocabulary: by a likelihood ratio
   that about one term reaches by chance, and odds ODDS times as high with one label as with the other. Every whole text becomes a sparse vector; document frequencies are counted over all rows.
2. A bounded sample of labelled rows (EXAMPLES, half of them of each label if there are as many) makes the index: postings per term in
   blocks of BLOCK examples, with the largest weight of each term in each block. A query adds those up to a bound per
   block, opens blocks from the highest bound on and stops where no bound reaches the k-th best cosine: exact neighbours.
3. Neighbours vote by squared cosine, weighed back to the labels' true shares; the vote is calibrated by logistic regression on the
   examples, each judged without itself. The neighbours are the evidence.

The score is a function of the text alone. Labels are learned only from rows that are not held out.

Defined results: null and empty texts, and those without a term of the vocabulary, have the (smoothed) share of toxic
rows among labelled rows like them; without labels all scores are 0; several labels of a document count as the largest; rows with null
doc_id are scored and not held out, but have no label; repeated rows give repeated results and repeated examples; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .tables import few, small_batches, stored

#: Terms of the vocabulary at most, the least documents of one, and the least ratio of its odds between the labels.
VOCABULARY, DOCUMENTS, ODDS = 2048, 3, 4.0
#: Labelled rows in the index at most, of a block, neighbours that vote, and weight of the labels' overall share in a vote.
EXAMPLES, BLOCK, NEIGHBOURS, PRIOR = 4096, 32, 15, 0.05
#: Bytes of text that are cut into terms at once.
SLICE = 1 << 19
#: Letters, A-Z lower-cased; every other ASCII character is a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
EVIDENCE = "array<struct<doc_id: long, cosine: double, toxic: int>>"


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, term) of every occurrence, some hundred thousand at a time."""
    held, owners, size = [], [], 0
    for i, text in enumerate([*texts, None]):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass").translate(LETTERS)
        if size and (text is None or size + len(data) > SLICE):
            yield _cut(held, owners)
            held, owners, size = [], [], 0
        if len(data) > SLICE:
            # Slices of one text share four bytes, so that each term is in just one of them.
            data = b" " + data + b" "
            for at in range(0, len(data) - 4, SLICE):
                yield _cut([data[at : at + SLICE + 4]], [i], edges=False)
        elif data:
            held.append(data)
            owners.append(i)
            size += len(data)


def _cut(texts: list[bytes], owners: list[int], edges: bool = True) -> tuple[np.ndarray, np.ndarray]:
    joined = b" " + b" ".join(texts) + b" " if edges else texts[0]
    c = np.frombuffer(joined, np.uint8)
    full = c != 32
    at = np.flatnonzero(full[1:-3] & full[2:-2] & full[3:-1])
    term = np.zeros(len(at), np.int64)
    for k in range(5):
        term = (term << 8) | c[at + k]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    owner = np.asarray(owners)[np.searchsorted(starts, at, "right") - 1]
    return owner, term


def spelled(term: int) -> str:
    """A term as text, for people."""
    return term.to_bytes(5, "big").decode("utf-8", "replace")


def counted(owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, term) with their counts; ``owner`` below 2^23."""
    pair, count = np.unique(owner.astype(np.int64) << 40 | term, return_counts=True)
    return pair >> 40, pair & ((1 << 40) - 1), count


class _Tally:
    """Documents and toxic documents per term, kept small by adding up."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.parts, self.size = most, [], 0

    def add(self, term: np.ndarray, docs: np.ndarray, toxic: np.ndarray) -> None:
        self.parts.append((term, docs, toxic))
        self.size += len(term)
        if self.size > self.most:
            self.parts = [self.sums()]
            self.size = len(self.parts[0][0])

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        term, docs, toxic = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        term, place = np.unique(term, return_inverse=True)
        return term, np.bincount(place, docs, len(term)).astype(np.int64), np.bincount(place, toxic, len(term)).astype(np.int64)

    def take(self) -> pd.DataFrame:
        frame = pd.DataFrame(dict(zip(("term", "docs", "toxic"), self.sums(), strict=True)))
        self.parts, self.size = [], 0
        return frame


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, docs, toxic) over (text, toxic)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = _Tally()
        for batch in batches:
            bad = batch.toxic.to_numpy()
            seen = [counted(*x) for x in grams(list(batch.text))]
            if seen:
                # Slices of one text may repeat a term.
                pairs = np.unique(np.concatenate([o << 40 | t for o, t, _ in seen]))
                owner, term = pairs >> 40, pairs & ((1 << 40) - 1)
                term, place, docs = np.unique(term, return_inverse=True, return_counts=True)
                tally.add(term, docs, np.bincount(place, bad[owner], len(term)).astype(np.int64))
            if tally.size > tally.most // 2 and len(tally.parts) == 1:
                yield tally.take()
        if tally.parts:
            yield tally.take()

    return labelled.mapInPandas(count, "term long, docs long, toxic long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


def vocabulary(counts: DataFrame, docs: int, toxic: int, most: int = VOCABULARY) -> np.ndarray:
    """The terms, ascending, that tell the labels apart best."""

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    if not 0 < toxic < docs:
        return np.zeros(0, np.int64)
    cells = []
    for total, with_term in ((toxic, F.col("toxic")), (docs - toxic, F.col("docs") - F.col("toxic"))):
        share = F.lit(total / docs)
        cells += [part(with_term, F.col("docs") * share), part(total - with_term, (docs - F.col("docs")) * share)]
    counts = stored(counts.where(F.col("docs") >= DOCUMENTS), "tox-counts")
    least = 2 * np.log(max(2, counts.count()))  # of so many terms, about one gets there by chance
    good, clean = F.col("docs") - F.col("toxic"), docs - toxic
    odds = F.log((F.col("toxic") + 0.5) / (toxic - F.col("toxic") + 0.5)) - F.log((good + 0.5) / (clean - good + 0.5))
    ratio = counts.where(F.abs(odds) >= math.log(ODDS)).select("term", (2 * sum(cells[1:], cells[0])).alias("g"))
    rows = ratio.where(F.col("g") >= float(least)).orderBy(F.desc("g"), "term").limit(most).collect()
    return np.array(sorted(r.term for r in rows), np.int64)


def vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """doc_id, terms (places in the vocabulary, ascending) and counts of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        # Most occurrences are no terms: a table of their low bits drops them.
        fold = lambda t: (t ^ (t >> 17)) & 0xFFFFF
        maybe = np.zeros(1 << 20, bool)
        maybe[fold(known)] = True
        for batch in batches:
            found = [[np.zeros(0, np.int64)] * 2]
            for owner, term in grams(list(batch.text)) if len(known) else ():
                keep = np.flatnonzero(maybe[fold(term)])
                owner, term = owner[keep], term[keep]
                place = np.minimum(np.searchsorted(known, term), len(known) - 1)
                keep = known[place] == term
                found.append([owner[keep], place[keep]])
            owner, place = (np.concatenate(x) for x in zip(*found, strict=True))
            owner, place, count = counted(owner, place)
            cuts = np.searchsorted(owner, np.arange(1, len(batch)))
            yield pd.DataFrame({
                "doc_id": batch.doc_id, "terms": np.split(place.astype(np.int32), cuts), "counts": np.split(count.astype(np.int32), cuts),
            })

    return docs.mapInPandas(run, "doc_id long, terms array<int>, counts array<int>")


def document_frequencies(vector: DataFrame, size: int) -> np.ndarray:
    """Rows that hold each of ``size`` terms. A task adds up its rows and gives one row per term at most; so does the driver's total."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            if len(batch):
                seen += np.bincount(np.concatenate(batch.terms.to_list()), minlength=size)  # a row's terms are distinct
        t = np.flatnonzero(seen)
        yield pd.DataFrame({"t": t, "n": seen[t]})

    df = np.zeros(size)
    for r in vector.select("terms").mapInPandas(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        df[r["t"]] = r["n"]
    return df


class Index:
    """Block-max inverted index of unit vectors; ``ids``, ``toxic`` and ``weight`` are by example.

    ``rows`` are (id, toxic, terms, counts), ``scale`` is what an example of a label stands for.
    """

    def __init__(self, idf: np.ndarray, rows: list[tuple[int, int, list[int], list[int]]], scale: dict[int, float], block: int = BLOCK):
        self.idf, self.block = idf, block
        units = [self.vector(np.asarray(t), np.asarray(c)) for _, _, t, c in rows]
        # Examples with the same heaviest term are neighbours, so that a block's bounds are tight.
        order = sorted(range(len(rows)), key=lambda i: (rows[i][2][int(np.argmax(units[i]))], len(units[i]), i))
        self.ids = np.array([rows[i][0] for i in order], np.int64)
        self.toxic = np.array([rows[i][1] for i in order], np.int64)
        self.weight = np.array([scale[rows[i][1]] for i in order])
        self.examples = [(np.asarray(rows[i][2]), units[i]) for i in order]
        self.blocks = max(1, -(-len(order) // block))
        term = np.concatenate([t for t, _ in self.examples]).astype(np.int64)
        value = np.concatenate([w for _, w in self.examples])
        example = np.repeat(np.arange(len(order)), [len(t) for t, _ in self.examples])
        at = np.lexsort((example, term))
        self.posting, self.value = example[at], value[at]
        cell = term[at] * self.blocks + self.posting // block
        cells = len(idf) * self.blocks
        self.start = np.searchsorted(cell, np.arange(cells + 1)).astype(np.int32)
        most = np.zeros(cells)
        np.maximum.at(most, cell, self.value)
        self.most = most.reshape(len(idf), self.blocks)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit weights of a text's terms."""
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine (ties: the first in the index), best first, and their cosines."""
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        found, score, at = np.zeros(0, np.int64), np.zeros(0), 0
        while at < len(order) and (len(found) < k or bound[order[at]] >= score[-1] - 1e-9):
            some = order[at : at + 4]
            cell = (terms[:, None].astype(np.int64) * self.blocks + some).ravel()
            size = self.start[cell + 1] - self.start[cell]
            place = np.repeat(self.start[cell] - np.cumsum(size) + size, size) + np.arange(size.sum())
            example, inverse = np.unique(self.posting[place], return_inverse=True)
            cosine = np.bincount(inverse, self.value[place] * np.repeat(np.repeat(weights, len(some)), size), len(example))
            found, score = np.concatenate([found, example]), np.concatenate([score, cosine])
            best = np.lexsort((found, -score))[:k]
            found, score = found[best], score[best]
            at += 4
        return found, score


@dataclass
class Model:
    terms: np.ndarray
    index: Index | None
    share: float
    blank: float
    slope: float = 1.0
    shift: float = 0.0

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine**2 * self.index.weight[found]
        return float((w @ self.index.toxic[found] + PRIOR * self.share) / (w.sum() + PRIOR))

    def score(self, found: np.ndarray, cosine: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.slope * logit(self.vote(found, cosine)) + self.shift))))


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def calibrate(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a slightly penalised logistic regression of labels on logits of votes."""
    x = np.stack([votes, np.ones(len(votes))], 1)
    beta, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (weight * (toxic - p)) - (beta - start)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2), gradient)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.05)), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, most: int = VOCABULARY) -> tuple[Model, DataFrame]:
    """The model and the stored vectors of all rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.when(F.col("toxic") == 0, 0).otherwise(1)).alias("toxic")).where(~held_out(F.col("doc_id")))
    marks = few(stored(marks, "tox-labels"))
    labelled = rows.join(marks, "doc_id").select("text", "toxic")
    n, bad = (int(x or 0) for x in labelled.agg(F.count("*"), F.sum("toxic")).first())
    terms = vocabulary(term_counts(labelled), n, bad, most) if 0 < bad < n else np.zeros(0, np.int64)
    vector = stored(vectors(rows, terms), "tox-vectors")
    share = bad / n if n else 0.0
    known = vector.join(marks, "doc_id")
    empty = {r.toxic: r.n for r in known.where(F.size("terms") == 0).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = Model(terms, None, share, (empty.get(1, 0) + share) / (sum(empty.values()) + 1))
    if not len(terms):
        model.blank = share
        return model, vector
    df = document_frequencies(vector, len(terms))
    total = vector.count()
    idf = np.log((1 + total) / (1 + df)) + 1
    sizes = {r.toxic: r.n for r in known.where(F.size("terms") > 0).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    room = {0: examples // 2, 1: examples // 2}
    for k in (0, 1):
        room[1 - k] += max(0, room[k] - sizes.get(k, 0))
    picked = []
    for k in (0, 1):
        order = [F.xxhash64("doc_id", F.lit(13)), F.col("doc_id"), F.col("terms"), F.col("counts")]
        picked += known.where((F.size("terms") > 0) & (F.col("toxic") == k)).orderBy(*order).select("doc_id", "toxic", "terms", "counts").limit(min(room[k], examples)).collect()
    if not picked:
        return model, vector
    taken = collections.Counter(r.toxic for r in picked)
    model.index = index = Index(idf, [tuple(r) for r in picked], {k: sizes[k] / taken[k] for k in taken})
    votes = []
    for i, (t, w) in enumerate(index.examples):
        found, cosine = index.nearest(t, w, NEIGHBOURS + 1)
        others = np.flatnonzero(found != i)[:NEIGHBOURS]
        votes.append(logit(model.vote(found[others], cosine[others])))
    model.slope, model.shift = calibrate(np.array(votes), index.toxic, index.weight)
    return model, vector


def score(vector: DataFrame, model: Model, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score and evidence (the examples that voted) of every stored vector."""
    shared = vector.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value

        def one(terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[dict]]:
            if m.index is None or not len(terms):
                return m.blank, []
            found, cosine = m.index.nearest(terms, m.index.vector(terms, counts), k)
            rows = zip(m.index.ids[found].tolist(), cosine.tolist(), m.index.toxic[found].tolist(), strict=True)
            return m.score(found, cosine), [{"doc_id": d, "cosine": c, "toxic": t} for d, c, t in rows]

        for batch in batches:
            known, out = {}, []  # equal vectors of a batch are scored once
            for terms, counts in zip(batch.terms, batch.counts, strict=True):
                key = (terms.tobytes(), counts.tobytes())
                if key not in known:
                    known[key] = one(terms, counts)
                out.append(known[key])
            yield pd.DataFrame({"doc_id": batch.doc_id, "score": [s for s, _ in out], "evidence": [e for _, e in out]})

    return vector.mapInPandas(run, f"doc_id long, score double, evidence {EVIDENCE}")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row."""
    model, vector = train(docs, labels)
    found = score(vector, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
