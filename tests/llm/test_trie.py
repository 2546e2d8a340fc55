"""The conversation trie against a dictionary of prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("voltloom.llm")

from voltloom.llm import oracles, trie  # noqa: E402

FIELDS = "conv_id long, turn long, role string, text string"


def brute(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    by = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = (*by.get(c - c % 5, [])[:h], *own[h:])
    members, kids, leaves, saved = collections.defaultdict(list), collections.defaultdict(list), {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
    return sorted(
        (len(p), min(m), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest())
        for p, m in members.items()
    )


def found(df):
    rows = trie.nodes(df).collect()
    return sorted((r.depth, r.conv_id, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows)


@pytest.mark.parametrize("shard", [16, 64, 1024])
def test_trie_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "ROWS", shard)
    rng = random.Random(shard)
    rows = []
    for c in range(300):
        longest = 150 if c % 40 == 0 else rng.choice([1, 2, 3, 5, 9, 12])  # some are longer than a matrix is wide
        for t in range(longest):
            rows.append((c, None if t == 0 and c % 3 else t, rng.choice(["u", "a", None]), rng.choice(["x", "yy", "zé", None, "q" * 50])))
    # A third of all conversations are copies of one, so that its nodes cross many shards.
    rows += [(5 * c, t, "u", f"same {t}") for c in range(100, 250) for t in range(4)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, FIELDS).repartition(7)) == brute(rows)


def test_trie_odd_rows(spark):
    rows = [
        (None, 1, "u", "lost"), (5, None, None, None), (5, 1, "u", ""), (5, 1, "u", ""), (6, 3, "a", "x" * 200_000), (7, None, None, None), (-3, 0, "u", "é"), (-5, 1, "u", "b"),
        (2**62, 1, "u", "far"), (10, 2, "a", "z"),
    ]
    d = spark.createDataFrame(rows, FIELDS)
    # Ids below zero: the family is by division towards zero here and in SQL.
    plain = [r for r in rows if r[0] is None or r[0] >= 0]
    assert found(d.where("conv_id is null or conv_id >= 0")) == brute(plain)
    assert sum(r[0] == 0 for r in found(d)) == 1
    clash = d.selectExpr("*", "1 as depth", "text as shard", "2 as k1", "turn as rank")
    assert found(clash) == found(d)
    assert trie.nodes(spark.createDataFrame([], FIELDS)).count() == 0
    assert found(d.where("conv_id is null")) == []


def test_trie_on_the_given_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()]
    assert found(d) == brute(rows)


def test_trie_sql_against_brute_force():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    rows = con.sql("select conv_id, turn, role, text from conversations").fetchall()
    got = sorted((d, c, -1 if p is None else p, *rest) for c, d, p, *rest in con.sql(oracles.TRIE).fetchall())
    assert got == brute(rows)


def test_order_and_shared_turns_over_several_bands():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 2, n).tolist() for n in rng.integers(0, 6, 60)]
    base = rng.integers(0, 5, 200).tolist()
    rows += [base[:n] for n in (64, 65, 128, 129, 200, 200, 63)] + [[*base[:130], 9, 9], [*base[:64], 7]]
    length = np.array([len(r) for r in rows])
    ids, first = np.array([x for r in rows for x in r], np.int32), np.concatenate([[0], np.cumsum(length)[:-1]])
    conv = rng.permutation(len(rows))
    order = trie.ordered(ids, first, length, conv)
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], conv[i]))
    lcp = trie.shared(ids, first[order], length[order])
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [-1, *(same(rows[a], rows[b]) for a, b in zip(order, order[1:], strict=False))]
