"""Toxicity: terms and neighbours against brute force, held-out accuracy, and odd tables."""

import collections
import math
import zlib

import numpy as np
import pytest

pytest.importorskip("voltloom.llm")

from voltloom.llm import toxicity as tox  # noqa: E402

DOCS = "doc_id long, text string, lang string, score string, terms string, docs long, toxic string"
LABELS = "doc_id long, quality int, toxic int, text string"


def plain_grams(text):
    data = b" " + text.encode("utf-8", "surrogatepass").translate(tox.LETTERS) + b" "
    return collections.Counter(data[i : i + 5] for i in range(len(data) - 4) if b" " not in data[i + 1 : i + 4])


@pytest.mark.parametrize("size", [7, 64, 1 << 19])
def test_terms_against_brute_force(monkeypatch, size):
    monkeypatch.setattr(tox, "SLICE", size)
    rng = np.random.default_rng(size)
    texts = ["".join(rng.choice(list("abCé .1\n"), rng.integers(0, 60))) for _ in range(200)] + ["", "abc", "ab", " ab cde "]
    got = [collections.Counter() for _ in texts]
    for owner, term in tox.grams(texts):
        for o, t in zip(owner.tolist(), term.tolist(), strict=True):
            got[o][t.to_bytes(5, "big")] += 1
    assert got == [plain_grams(t) for t in texts]


def test_neighbours_are_exact():
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 5, 60)
    rows = []
    for i in range(700):
        t = np.sort(rng.choice(60, rng.integers(1, 12), replace=False))
        rows.append((i, int(rng.random() < 0.3), t.tolist(), rng.integers(1, 6, len(t)).tolist()))
    rows += rows[:40]  # equal examples
    index = tox.Index(idf, rows, {0: 1.0, 1: 2.0}, block=16)
    dense = np.zeros((len(rows), 60))
    for i, (t, w) in enumerate(index.examples):
        dense[i, t] = w
    for _ in range(200):
        t = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        w = index.vector(t, rng.integers(1, 4, len(t)))
        found, cosine = index.nearest(t, w, 15)
        s = dense[:, t] @ w
        best = np.sort(s)[::-1][:15]
        assert cosine == pytest.approx(best[best > 0]) and s[found] == pytest.approx(cosine) and len(set(found.tolist())) == len(found)


def test_term_counts_and_vocabulary(spark):
    rows = [(f"a vile{i} remark, so vile" if i % 4 == 0 else f"a kind{i} remark", int(i % 4 == 0)) for i in range(80)]
    d = spark.createDataFrame(rows, "text string, toxic int").repartition(3)
    got = {r.term.to_bytes(5, "big"): (r.docs, r.toxic) for r in tox.term_counts(d).collect()}
    want = collections.defaultdict(lambda: [0, 0])
    for text, bad in rows:
        for g in plain_grams(text):
            want[g][0] += 1
            want[g][1] += bad
    assert got == {g: tuple(v) for g, v in want.items()}
    terms = {int(t).to_bytes(5, "big") for t in tox.vocabulary(tox.term_counts(d), 80, 20)}
    ratio = {}
    for g, (docs, bad) in want.items():
        cells = [(bad, docs * 0.25), (20 - bad, (80 - docs) * 0.25), (docs - bad, docs * 0.75), (60 - docs + bad, (80 - docs) * 0.75)]
        ratio[g] = 2 * sum(o * math.log(o / e) for o, e in cells if o)
    many = {g for g, v in want.items() if v[0] >= tox.DOCUMENTS}
    odds = {g: math.log((bad + 0.5) / (20.5 - bad)) - math.log((docs - bad + 0.5) / (60.5 - docs + bad)) for g, (docs, bad) in want.items()}
    assert terms == {g for g in many if ratio[g] >= 2 * math.log(len(many)) and abs(odds[g]) >= math.log(tox.ODDS)} and b"vile " in terms


def test_held_out_accuracy(spark):
    # Stems in many forms among words that all documents share.
    rng = np.random.default_rng(5)
    words = [f"word{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rows = []
    for i in range(1500):
        text = rng.choice(words, 60).tolist()
        if i % 10 == 0:
            for k in rng.integers(0, 60, 3):
                text[k] = f"{rng.choice(['grobl', 'snark'])}{rng.choice(list('aeiou'))}{rng.integers(0, 99)}"
        rows.append((i, " ".join(text), int(i % 10 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1, y, "") for i, _, y in rows if i % 5], LABELS).unionByName(spark.createDataFrame([(i, 1, y, "") for i, _, y in rows if i % 5 == 0], LABELS))
    got = {r.doc_id: r for r in tox.judge(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    kept = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert np.mean([r.predicted == y for r, y in kept]) >= 0.99 and np.mean([r.predicted for r, y in kept if y]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(not got[e.doc_id].held_out for r in got.values() for e in r.evidence) and any(r.evidence for r in got.values())
    # Labels of held-out rows make no difference.
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic", "text")
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in tox.judge(docs.repartition(2), turned).collect()}


def test_odd_tables(spark):
    rows = [
        (1, None, "en", "x", "t", 1, "1"), (2, "", None, None, None, None, None), (None, "a b c vile words", "en", "s", "t", 2, "0"), (None, None, None, None, None, None, None),
        (4, "lorem ipsum vile " * 60_000, "de", "s", "t", 2, "0"), (5, "über \ud7ff \U0001f600 x", "en", "s", "t", 2, "0"), (5, "über \ud7ff \U0001f600 x", "en", "s", "t", 2, "0"),
    ]
    rows += [(10 + i, "so vile and vile" if i % 2 else "a kind word", "en", "s", "t", 2, "0") for i in range(60)]
    labels = [(10 + i, 1, i % 2, "z") for i in range(60)] + [(11, 1, None, "z"), (11, 1, 0, "z"), (None, 1, 1, "z"), (5, None, 0, None)]
    d, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = tox.judge(d, marks)
    out = got.collect()
    assert len(out) == len(rows) and sum(r.doc_id is None for r in out) == 2 and not any(r.held_out for r in out if r.doc_id is None)
    by = {r.doc_id: r for r in out}
    assert by[4].predicted == 1 and by[1].score == by[2].score and by[2].predicted == 0 and by[13].predicted == 1 and by[12].predicted == 0
    for docs, some in ((d.limit(0), marks), (d.limit(0), marks.limit(0))):
        assert tox.judge(docs, some).count() == 0
    none = tox.judge(d, marks.limit(0)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.0}
    assert {r.score for r in tox.judge(d, marks.where("toxic = 1")).collect()} == {1.0}


def test_document_frequencies_leave_a_task_as_one_row_per_term(spark):
    rows = [(i, [0, 2] if i % 3 else [], [1, 1] if i % 3 else []) for i in range(900)]
    vector = spark.createDataFrame(rows, "doc_id long, terms array<int>, counts array<int>").repartition(3)
    assert tox.document_frequencies(vector, 4).tolist() == [600, 0, 600, 0]
    assert tox.document_frequencies(vector.where("doc_id < 0"), 4).tolist() == [0, 0, 0, 0]
