"""Ranked lexical search: the best documents of a set of queries, by range-maximum tables over posting lists.

1. Every whole text is cut into terms; of a document its length and its counts of the queries' terms are kept. Document
   frequencies and lengths are counted over all rows.
2. A shard is a run of stored rows with about POSTINGS postings, sorted by doc_id. Each posting list holds documents and impacts (the exact
   integer part of the score that a term adds), and a sparse table that gives the largest impact in any range of it.
3. A query starts with one interval, all documents of the shard. The sum over its terms of the largest impact within an interval bounds
   every score there. The intervals with the best bounds are taken first: each is split at the document of its largest impact,
   which is scored exactly, and what lies left and right of it becomes intervals with bounds of their own. The search ends
   when no bound reaches the k-th best score. A task carries its best documents from shard to shard.
4. The best k of all tasks are ranked in Spark, ties by doc_id. The results are exact.

Queries are broadcast in blocks of ITEMS; a block's texts must fit in memory, and so must one document's counts of the queries' terms.

Defined results: null text has no terms; a query without terms, or whose terms no document holds, has no rows; rows with one item_id
(null too) are one query of all their terms; repeated documents are documents of their own, equal scores go to the smaller doc_id (null last);
empty tables give no rows; extra columns are ignored. Scores are 64-bit integers, div rounds down.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import ranked, small_batches, stored

#: Results of a query, queries of a broadcast, postings of a shard, intervals split at once.
BEST, ITEMS, POSTINGS, SPLITS = 50, 1000, 1 << 20, 64
#: Letters and digits, A-Z lower-cased; every other ASCII character ends a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LAST = (1 << 63) - 1


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


@dataclass
class Queries:
    """``known``: term to number; ``wanted``: the term numbers of each query; ``ids``: item_id of each query."""

    known: dict[bytes, int]
    wanted: list[np.ndarray]
    ids: list[int | None]


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """The queries, at most ITEMS at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where(F.col("text").isNotNull())
    placed = stored(ranked(stored(rows, "search-items"), [F.col("item_id"), F.col("text")], "search-ranked", "rank"), "search-placed")
    firsts = placed.groupBy("item_id").agg(F.min("rank").alias("first"))
    n = int(firsts.agg(F.max("first")).first()[0] or 0) + 1 if placed.limit(1).count() else 0
    for at in range(0, n, ITEMS):
        some = placed.join(firsts.where(F.col("first").between(at, at + ITEMS - 1)).withColumnRenamed("item_id", "_id"), F.col("item_id").eqNullSafe(F.col("_id")))
        by = collections.defaultdict(set)
        for r in some.select("item_id", "text").toLocalIterator():
            by[r.item_id].update(terms(r.text))
        known: dict[bytes, int] = {}
        wanted = [np.array(sorted(known.setdefault(t, len(known)) for t in sorted(x)), np.int64) for x in by.values()]
        yield Queries(known, wanted, list(by))


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and the numbers and counts of the known terms, of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value
        for batch in batches:
            n, found, counts = [], [], []
            for text in batch.text:
                words = terms(text)
                own = collections.Counter(words)
                there = sorted((number[t], c) for t, c in own.items() if t in number)
                n.append(len(words))
                found.append([t for t, _ in there])
                counts.append([c for _, c in there])
            yield pd.DataFrame({"doc_id": batch.doc_id, "n": n, "terms": found, "counts": counts})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, n long, terms array<int>, counts array<int>")


@dataclass
class Measure:
    """Documents with a term, all their terms, and a weight for each known term."""

    docs: int
    total: int
    weight: np.ndarray

    def impacts(self, n: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """What each posting adds to a score; ``n`` is the length of its document."""
        m = 50 + (50 * n * self.docs) // max(1, self.total)
        return self.weight[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m))


def measure(rows: DataFrame, known: int) -> Measure:
    """Count over all rows; the driver sees one row per known term."""
    n, total = rows.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(known, np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    return Measure(n, total, weight)


class Shard:
    """Posting lists of some documents, sorted by id, with a sparse table of range maxima over all of them."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, known: int):
        self.ids, self.size = ids, len(ids)
        keep = impact > 0
        owner, term, impact = owner[keep], term[keep], impact[keep]
        order = np.argsort(term * self.size + owner)
        self.key, self.impact = (term * self.size + owner)[order], impact[order]
        self.best = [np.arange(len(order), dtype=np.int32)]  # places of the maxima of runs of 1, 2, 4, ... postings
        longest = int(np.bincount(term, minlength=1).max(initial=0))
        while 2 << (len(self.best) - 1) <= longest:
            half = 1 << (len(self.best) - 1)
            a, b = self.best[-1][:-half], self.best[-1][half:]
            self.best.append(np.where(self.impact[b] > self.impact[a], b, a))
        self.log = np.zeros(longest + 2, np.int64)
        for i in range(2, longest + 2):
            self.log[i] = self.log[i // 2] + 1

    def highest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the largest impact of each range of postings; -1 for empty ones."""
        out = np.full(low.shape, -1, np.int64)
        size = high - low
        level = self.log[size]
        for k in np.unique(level[size > 0]).tolist():
            at = np.nonzero((level == k) & (size > 0))
            a, b = self.best[k][low[at]], self.best[k][high[at] - (1 << k)]
            out[at] = np.where(self.impact[b] > self.impact[a], b, a)
        return out

    def search(self, wanted: np.ndarray, best: list[tuple[int, int]], k: int = BEST) -> list[tuple[int, int]]:
        """The best k of (-score, doc_id) among ``best`` and the shard's documents."""
        base = wanted * self.size
        low, high = np.searchsorted(self.key, base)[None], np.searchsorted(self.key, base + self.size)[None]
        keep = (high > low)[0]
        base, low, high = base[keep], low[:, keep], high[:, keep]
        best = sorted(best)[:k]
        if not len(base):
            return best
        top = self.highest(low, high)
        bound = self.impact[top].sum(1)
        while len(bound):
            least = -best[-1][0] if len(best) == k else 0
            open_ = bound >= max(least, 1)
            if not open_.all():
                low, high, top, bound = low[open_], high[open_], top[open_], bound[open_]
                if not len(bound):
                    break
            first = np.argpartition(-bound, SPLITS - 1)[:SPLITS] if len(bound) > SPLITS else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[first] = False
            a, b, t = low[first], high[first], top[first]
            value = np.where(t >= 0, self.impact[t], 0)
            term = value.argmax(1)
            doc = self.key[t[np.arange(len(first)), term]] - base[term]
            target = base + doc[:, None]
            middle = np.searchsorted(self.key, target)
            hit = (middle < b) & (self.key[np.minimum(middle, len(self.key) - 1)] == target)
            score = np.where(hit, self.impact[np.minimum(middle, len(self.key) - 1)], 0).sum(1)
            good = score >= max(least, 1)
            if good.any():
                best = sorted(best + list(zip((-score[good]).tolist(), self.ids[doc[good]].tolist(), strict=True)))[:k]
            a, b = np.concatenate([a, middle + hit]), np.concatenate([middle, b])
            t = self.highest(a, b)
            value = np.where(t >= 0, self.impact[t], 0).sum(1)
            low, high = np.concatenate([low[rest], a]), np.concatenate([high[rest], b])
            top, bound = np.concatenate([top[rest], t]), np.concatenate([bound[rest], value])
        return best


def search(docs: DataFrame, items: DataFrame, k: int = BEST, size: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every query."""
    spark = docs.sparkSession
    small_batches(spark)
    fields, found = "item_id long, doc_id long, score long", None
    for block in query_blocks(items):
        some = stored(_block(docs, block, k, size, fields), "search-found")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, block: Queries, k: int, size: int, fields: str) -> DataFrame:
    rows = stored(postings(docs, block.known), "search-postings")
    about = measure(rows, len(block.known))
    shared = docs.sparkSession.sparkContext.broadcast((about, block.wanted, block.ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        about, wanted, ids = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]

        def work(held: list[pd.DataFrame]) -> None:
            d = pd.concat(held)
            doc = d.doc_id.astype("Int64").fillna(LAST).to_numpy(np.int64)
            order = np.argsort(doc, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sizes = d.terms.map(len).to_numpy()
            term, count = (np.concatenate(d[c].tolist()).astype(np.int64) for c in ("terms", "counts"))
            impact = about.impacts(np.repeat(d.n.to_numpy(), sizes), term, count)
            shard = Shard(doc[order], np.repeat(place, sizes), term, impact, len(about.weight))
            for i, own in enumerate(wanted):
                best[i] = shard.search(own, best[i], k)

        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += int(batch.terms.map(len).sum())
            if many >= size:
                work(held)
                held, many = [], 0
        if held:
            work(held)
        out = [(ids[i], None if d == LAST else d, -s) for i, own in enumerate(best) for s, d in own]
        yield pd.DataFrame(out, columns=["item_id", "doc_id", "score"]).astype({"item_id": "Int64", "doc_id": "Int64", "score": "int64"})

    return rows.where(F.size("terms") > 0).mapInPandas(run, fields)
