"""Ranked search against scoring every document, in Python and in SQL."""

import collections
import math
import re

import numpy as np
import pytest

pytest.importorskip("voltloom.llm")

from voltloom.llm import oracles, ranked_search  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, item_id long, rank string, terms string, n int"
ITEMS = "item_id long, text string, doc_id long, score string"


def plain(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    counts = [(i, collections.Counter(plain(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    by = collections.defaultdict(set)
    for item, text in items:
        by[item].update(plain(text))
    out = {}
    for item, wanted in by.items():
        scores = []
        for i, c in counts:
            m = 100 - 50 + ((50 * c.total() * n) // total if total else 0)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out[item] = [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:50])]
    return {k: v for k, v in out.items() if v}


def found(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.item_id].append((r["rank"], r.doc_id, r.score))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}


@pytest.mark.parametrize("size, splits, block", [(1 << 20, 64, 1000), (500, 3, 7)])
def test_given_tables_against_brute_force(spark, monkeypatch, size, splits, block):
    monkeypatch.setattr(ranked_search, "SPLITS", splits)
    monkeypatch.setattr(ranked_search, "ITEMS", block)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(ranked_search.search(docs.repartition(3), items, size=size)) == want


def test_ties_copies_and_hot_words(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SPLITS", 4)
    rng = np.random.default_rng(2)
    words = [f"w{int(k)}" for k in rng.zipf(1.4, 4000) % 300]
    docs = [(i, " ".join(["the", *words[i * 9 % 3000 : i * 9 % 3000 + int(rng.integers(1, 30))]])) for i in range(400)]
    docs += [(1000 + i, "The same copied text of many") for i in range(300)] + [(5, "the w1"), (5, "the w1")]
    items = [(k, " ".join(rng.choice(words, 8))) for k in range(20)] + [(90, "the"), (91, "the same copied text"), (92, "nowhere"), (93, "w1 W1 w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = found(ranked_search.search(d, spark.createDataFrame(items, "item_id long, text string"), size=700))
    assert got == brute(docs, items)
    assert [r[1] for r in got[91]] == list(range(1000, 1050)) and 92 not in got


def test_odd_tables(spark):
    docs = [
        (1, None, 7, "x", "t", 1), (2, "", None, None, None, None), (None, "apple pear", 7, "x", "t", 1), (None, "apple", 7, "x", "t", 1), (3, "APPLE; pear\tPear", 7, "x", "t", 1),
        (3, "APPLE; pear\tPear", 7, "x", "t", 1), (4, "lorem ipsum apple " * 50_000, 7, "x", "t", 1), (6, "über ÜBER 7up\x00x", 7, "x", "t", 1), (8, " .\n", 7, "x", "t", 1),
    ]
    items = [(1, "Apple pear apple", 3, "s"), (1, "lorem", 3, "s"), (None, "pear", 3, "s"), (2, None, 3, "s"), (3, "", 3, "s"), (4, "über 7UP", 3, "s"), (5, "ÜBER x", 3, "s")]
    d, q = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert found(ranked_search.search(d, q)) == brute([r[:2] for r in docs], [r[:2] for r in items])
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        assert ranked_search.search(a, b).count() == 0


def test_range_maxima():
    rng = np.random.default_rng(1)
    n = 400
    owner, term = np.divmod(np.sort(rng.choice(n * 6, 900, replace=False)), 6)
    shard = ranked_search.Shard(np.arange(n), owner, term, rng.integers(1, 50, 900), 6)
    for _ in range(300):
        t = rng.integers(0, 6)
        a, b = np.sort(rng.integers(0, n + 1, 2))
        low, high = np.searchsorted(shard.key, [t * n + a, t * n + b])
        place = int(shard.highest(np.array([low]), np.array([high]))[0])
        assert (place == -1) == (low == high)
        if low < high:
            assert low <= place < high and shard.impact[place] == shard.impact[low:high].max()


def test_sql_against_brute_force():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = brute(con.sql("select doc_id, text from documents").fetchall(), con.sql("select item_id, text from benchmark").fetchall())
    got = collections.defaultdict(list)
    for item, *rest in con.sql(oracles.SEARCH + " ORDER BY item_id, rank").fetchall():
        got[item].append(tuple(rest))
    assert got == want
