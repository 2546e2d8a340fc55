"""The text operators against brute force, and on the cases that break things: nulls, empty tables, repeats, clashing columns."""

import collections
import itertools
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("voltloom.llm")


from tokenizers import Tokenizer  # noqa: E402

from voltloom.llm import ann, bitpack, langid, lm_score, mixing, near, notices, packing, pii, quality  # noqa: E402
from voltloom.llm.components import components  # noqa: E402
from voltloom.llm.tokens import Encoder, default_path  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, language string, row long"
LONG = "lorem ipsum dolor sit amet " * 30_000


def odd(spark):
    """Nulls in any column, empty, blank, repeated and very long texts, and columns named like results."""
    rows = [
        (1, None, "en", "a", None, "x", 1, "l", 1), (2, "", None, None, 0, None, None, None, None), (None, "a b c d e f g", "en", "b", 3, "s", 2, "m", 2),
        (3, " \n\t ", "de", "a", 4, "s", 2, "m", 2), (4, LONG, "de", "a", 4, "s", 2, "m", 2), (5, LONG, "de", None, 4, "s", 2, "m", 2),
        (6, "Mail me: jo@ex.org or +1 (555) 123-4567!", "en", "b", 4, "s", 2, "m", 2), (6, "Mail me: jo@ex.org or +1 (555) 123-4567!", "en", "b", 4, "s", 2, "m", 2),
        (7, "über ퟿ \U0001f600 CC-BY  x", "en", "c", 1, "s", 2, "m", 2), (None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def trusted(spark):
    return quality.trusted_documents(spark.read.parquet(f"{SF}/labels.parquet"))


EVERY = {
    "notices": lambda d, t: notices.scan(d), "quality": quality.judge, "lm": lm_score.rank, "mix": lambda d, t: mixing.mix(d), "copies": lambda d, t: mixing.copies(d),
    "pii": lambda d, t: pii.digest(pii.find(d)), "redact": lambda d, t: pii.redact(d), "near": lambda d, t: near.join(d), "dedupe": lambda d, t: near.dedupe(d),
    "langid": lambda d, t: langid.label(d), "bits": lambda d, t: bitpack.encode(d), "pack": lambda d, t: packing.pack_documents(d),
}


@pytest.mark.parametrize("name", EVERY)
def test_odd_and_empty_tables(spark, name):
    none = EVERY[name](empty(spark), trusted(spark))
    assert none.count() == 0
    found = EVERY[name](odd(spark), trusted(spark))
    rows = found.collect()
    assert found.dtypes == none.dtypes
    if name not in ("pack", "copies", "dedupe"):
        assert len(rows) == 10 and sum(r.doc_id is None for r in rows) == 2
    if name == "dedupe":
        # The two long texts are one, so are the two mails; blanks and nulls stay.
        assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 2, 3, 4, 6, 7]
    if name in ("redact", "copies", "dedupe"):
        assert found.columns == odd(spark).columns
    if name == "redact":
        assert {r.text for r in rows if r.doc_id == 6} == {"Mail me: <EMAIL> or <PHONE>!"}
    if name == "pack":
        assert sum(r.length for r in rows if r.doc_id in (4, 5)) == 2 * (len(Encoder(default_path()).whole(LONG)) // 4 + 1)


def normal(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_license_scan_against_brute_force(spark, docs, texts):
    made = {
        -1: "x Licensed under the Apach License, Version 2.0 y", -2: "relaesed under the MIT license", -3: "CC BY cc-by cc by", -4: "(c) all Rights Reserved. ALL RIGHTS RESERVED",
        -5: "the general public license", -6: "accc by", -7: "alll rihts reserve",
    }
    all_texts = texts | made
    extra = spark.createDataFrame([(i, t) for i, t in made.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in notices.scan(docs.select("doc_id", "text").unionByName(extra)).collect()}
    for i, text in all_texts.items():
        w, r = normal(text), got[i]
        at = [(k, label) for p, label in notices.BASE.items() for q in [p.split()] for k in range(len(w)) if w[k : k + len(q)] == q]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        for m in r.matches:
            assert normal(text[m.start : m.end]) == w[m.first_word : m.last_word + 1]
    assert got[-1].labels == "apache-2.0" and got[-1].matches[0].edits == 1
    assert got[-2].labels == "mit" and got[-4].n_base == 2 and got[-3].n_base == 3 and got[-6].n_base == 0 and got[-7].labels == ""
    # Every approximate occurrence has an exact seed, so the search finds what a scan without seeds finds.
    searcher = notices.Searcher()
    for i in [*made, *list(texts)[:60]]:
        joined = (" " + " ".join(normal(all_texts[i])) + " ").encode()
        plain = {label for label, _, _, _, pattern in searcher.items for _ in [0] if pattern.search(joined)}
        assert bool(plain) == bool(searcher.find(joined)), i


def test_license_matches_that_overlap():
    rng = np.random.default_rng(7)
    for _ in range(200):
        found = [(f"l{k}", int(a), int(a + n), int(e), 30) for k, (a, n, e) in enumerate(zip(rng.integers(0, 80, 12), rng.integers(1, 20, 12), rng.integers(0, 4, 12), strict=True))]
        kept = []
        for x in sorted(found, key=lambda x: x[3]):
            if all(x[3] == y[3] or x[2] <= y[1] + 1 or y[2] <= x[1] + 1 for y in kept):
                kept.append(x)
        assert notices.fewest_edits(found) == kept


def test_license_scan_of_very_many_matches():
    searcher, took = notices.Searcher(), []
    for n in (25_000, 100_000):
        start = time.process_time()
        words, base, first, last, _, labels, score, matches = notices.scan_text("all rights reserved filler words here " * n, searcher)
        took.append(time.process_time() - start)
        assert (words, base, first, last, labels, score, len(matches)) == (6 * n, n, 0, 6 * (n - 1), "reserved", 1.0, n)
        assert matches[-1]["first_word"] == 6 * (n - 1) and matches[-1]["end"] == 38 * (n - 1) + 19
    assert took[1] < 10 * took[0]


def test_quality_rules_against_brute_force(spark, docs, texts):
    got = quality.judge(docs, trusted(spark)).collect()
    for r in got:
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (r.kept <= (not r.base_failed))
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r for r in got if labels.get(r.doc_id) == (1, 0) and not r.base_failed]
    junk = [r for r in got if labels.get(r.doc_id, (1, 0))[0] == 0 and not r.base_failed]
    assert clean and all(r.kept for r in clean)
    assert np.mean([r.llr for r in clean]) > np.mean([r.llr for r in junk]) + 0.2


def test_lm_prefers_the_target(spark):
    rows = [(i, "the cat sat on the mat and the cat ran home") for i in range(40)] + [(100 + i, f"buy cheap pills now click here {i}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    t = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = {r.doc_id: r for r in lm_score.rank(d, t).collect()}
    assert max(got[i].score for i in range(40)) < min(got[100 + i].score for i in range(40))
    # A brute-force model of one text without its own counts, where no two words share a bucket.
    w = rows[0][1].split()
    n, words, pairs, firsts = 40 * 11 + sum(len(x.split()) for _, x in rows[40:]), collections.Counter(), collections.Counter(), collections.Counter()
    for _, x in rows:
        for a, b in zip([None, *x.split()], x.split(), strict=False):
            words[b] += 1
            pairs[a, b] += 1
            firsts[a] += 1
    loss = 0
    own = collections.Counter(w), collections.Counter(zip([None, *w], w, strict=False)), collections.Counter([None, *w[:-1]])
    for a, b in zip([None, *w], w, strict=False):
        rate = (pairs[a, b] - own[1][a, b]) / max(1, firsts[a] - own[2][a])
        loss -= np.log(lm_score.OWN * min(1, rate) + (1 - lm_score.OWN) * (words[b] - own[0][b] + lm_score.SMOOTH) / (n - len(w) + lm_score.SMOOTH * lm_score.WORDS))
    assert got[30].background_loss == pytest.approx(loss / len(w), rel=1e-9)


def test_lm_counts_of_rare_bigrams_are_their_own(spark):
    # More distinct words than any fixed table of 2^18 buckets could keep apart.
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(2000))) for i in range(300)] + [(1000, "w7x1 w9x1 w7x2"), (1001, "w7x1 w9x1")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    models = lm_score.train(d, spark.createDataFrame([(1000,)], "doc_id long"))
    assert (models.background, models.target, models.vocabulary) == (600_005, 3, 600_000)
    got = {r.doc_id: r for r in lm_score.score(d, spark.createDataFrame([(1000,)], "doc_id long"), models).collect()}
    # Of w7x1's two other followers one is w9x1; the text begins with w7x1 in one of 301 others.
    n = 600_003 + lm_score.SMOOTH * 600_000
    a = lm_score.OWN / 301 + (1 - lm_score.OWN) * (2 + lm_score.SMOOTH) / n
    b = lm_score.OWN / 2 + (1 - lm_score.OWN) * (2 + lm_score.SMOOTH) / n
    assert got[1001].background_loss == pytest.approx(-(np.log(a) + np.log(b)) / 2, rel=1e-9)


def test_lm_blocks_send_an_ngram_once_and_in_few_bytes(spark, docs):
    t, yes = trusted(spark), F.lit(True)
    whole = {r.doc_id: r for r in lm_score.rank(docs, t).collect()}
    models = lm_score.train(docs, t)
    sizes = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in ("words", "word_counts", "pairs", "pair_counts", "texts", "names", "tokens")]
    sent = lm_score.asking(models.rows.coalesce(1).withColumns({"counts": yes, "asks": yes}), models)
    rows, blocks, size = sent.agg(F.count("*"), F.countDistinct("block"), sum(sizes)).first()
    # Rows of five longs per bigram took 30 bytes a word after compression.
    assert blocks == 1 and rows <= lm_score.BUCKETS and size < 15 * models.background
    # The same from many small blocks (one or more per partition), and when the scored rows are not those that were counted.
    for found in (lm_score.rank(docs.repartition(20), t), lm_score.score(docs.where("doc_id % 3 = 0"), t, models)):
        found = found.collect()
        assert len(found) in (len(whole), sum(i % 3 == 0 for i in whole))
        for r in found:
            assert r.n_tokens == whole[r.doc_id].n_tokens
            assert (r.target_loss, r.background_loss) == pytest.approx((whole[r.doc_id].target_loss, whole[r.doc_id].background_loss), rel=1e-9)


def test_mix_meets_targets_and_agrees_on_reruns(spark, docs):
    first, second = ([tuple(r) for r in mixing.mix(docs).orderBy("doc_id").collect()] for _ in range(2))
    assert first == second
    rows = mixing.mix(docs).toPandas()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert dict(zip(rows.doc_id, rows["size"], strict=True)) == size and (rows.taken <= 2 * rows["size"]).all()
    by = rows.groupby("source").agg(size=("size", "sum"), most=("size", "max"), target=("target", "first"), taken=("taken", "sum"))
    by = by.loc[sorted(by.index, key=lambda s: s.encode())]
    weight, left = np.resize([3.0, 1.0, 2.0], len(by)), 1.5 * by["size"].sum()
    want, full = np.zeros(len(by)), np.zeros(len(by), bool)
    while True:
        want[~full] = (left - want[full].sum()) * weight[~full] / weight[~full].sum()
        over = ~full & (want > 2 * by["size"].to_numpy())
        if not over.any():
            break
        full |= over
        want[full] = 2 * by["size"].to_numpy()[full]
    assert by.target.to_numpy() == pytest.approx(want) and (abs(by.taken - by.target) <= by.most + 1).all()
    assert mixing.copies(docs).count() == rows.copies.sum()


def test_mix_meets_targets_with_repeated_rows(spark):
    rows = [(None, "w " * 50, s) for s in "abc" for _ in range(300)] + [(k, "w " * (10 + k % 90), s) for s in "abc" for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(d).toPandas()
    assert len(got) == len(rows)
    by = got.groupby("source").agg(most=("size", "max"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= by.most + 1).all()
    assert mixing.copies(d).count() == got.copies.sum()


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_rule(text):
    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m.split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [(k, *m.span()) for k, p in RULES.items() for m in re.finditer(p, text) if holds(k, m[0])]


def test_pii_rules_against_plain_patterns(texts):
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice(list("1234@.+- a(b)5%"), rng.integers(0, 40))) + "4111 1111 1111 1111"[: rng.integers(0, 20)] for _ in range(5000)]
    for t in [*texts.values(), *made]:
        assert sorted(by_rule(t)) == sorted(pii.rules(t))
    assert pii.rules("1" * 200_000) == [] and pii.rules("a" * 200_000) == []


def test_pii_learns_contexts(spark):
    seeds = [(i, f"please call me at home on +1 (555) 10{i}-4567 today {i}") for i in range(6)]
    more = [(10, "please call me at home on 555-999-8888 today"), (11, "it cost 12345 in total")]
    d = spark.createDataFrame(seeds + more, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(d).collect()}
    assert [(s.kind, more[0][1][s.start : s.end]) for s in got[10].spans] == [("phone", "555-999-8888")] and not got[10].base
    assert got[11].spans == [] and all(len(got[i].spans) == 1 for i in range(6))
    assert "<PHONE>" in {r.doc_id: r.text for r in pii.redact(d).collect()}[10]


def test_pii_learns_identifiers_in_several_words(spark):
    seeds = [(i, f"please call me at home on +1 (555) 1{i}-4567 today {i}") for i in range(10, 60)]
    numbers = [f"4111 1111 1111 {k}" for k in range(1000, 1300) if pii.luhn(f"411111111111{k}")]
    seeds += [(60 + i, f"my card number is {c} and more {i}") for i, c in enumerate(numbers)]
    phones = ["(555) 123-4567", "555 999 8888", "12 34 56 78", "555.999 8888", "(555)123-4567", "555 - 999 - 8888", "5551234567"]
    cards = ["4111 1111 1111 1112", "4111-1111 1111-1112"]
    more = {100 + i: (f"please call me at home on {x} today", "phone", x) for i, x in enumerate(phones)}
    more |= {200 + i: (f"my card number is {x} and more", "card", x) for i, x in enumerate(cards)}
    plain = [(300, "it took 12 34 56 78 in total")]
    d = spark.createDataFrame(seeds + [(i, t) for i, (t, _, _) in more.items()] + plain, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(d).collect()}
    assert {i: [(s.kind, t[s.start : s.end]) for s in got[i]] for i, (t, _, _) in more.items()} == {i: [(kind, x)] for i, (_, kind, x) in more.items()}
    assert got[300] == [] and all(len(got[i]) == 1 for i, _ in seeds)
    masked = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert all(masked[i] == t.replace(x, f"<{kind.upper()}>") for i, (t, kind, x) in more.items())


def brute_classes(texts):
    runs = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.encode().split()] if w}
    parent, links = {i: i for i in texts}, dict.fromkeys(texts, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(sorted(runs), 2):
        both = len(runs[x] & runs[y])
        if both and both >= 0.8 * (len(runs[x]) + len(runs[y]) - both) - 1e-9:
            links[x], links[y] = links[x] + 1, links[y] + 1
            i, j = root(x), root(y)
            parent[max(i, j)] = min(i, j)
    return {i: root(i) for i in texts}, links


def test_jaccard_join_against_brute_force(spark, texts):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 900, 150)]
    more = {}
    for i in range(320):  # a group larger than a block, some of it too far apart
        w = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 6)):
            w[k] = f"e{rng.integers(0, 10**6)}"
        more[10_000 + i] = " ".join(w)
    all_texts = texts | more
    got = near.join(spark.createDataFrame(list(all_texts.items()), "doc_id long, text string").repartition(7)).collect()
    group, links = brute_classes(all_texts)
    wrong = [r for r in got if r.class_id != group[r.doc_id] or r.n_links != links[r.doc_id]]
    assert len(got) == len(all_texts) and not wrong
    bands, rows = near.band_shape()
    assert 1 - (1 - 0.8**rows) ** bands >= near.RECALL


def test_jaccard_join_finds_pairs_within_a_template_family(spark):
    rng = np.random.default_rng(6)
    template, rows = [f"t{k}" for k in range(148)], []
    for i in range(500):  # 0.815 within a pair, 0.58 between pairs
        own = [f"o{i}x{k}" for k in range(52)]
        other = [f"p{i}x{k}" if k in (8, 18, 28, 38) else w for k, w in enumerate(own)]
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + other))]
    rng.shuffle(rows)
    d = spark.createDataFrame([(int(i), str(t)) for i, t in rows], "doc_id long, text string").repartition(7)
    assert all((r.class_id, r.n_links) == (r.doc_id // 2 * 2, 1) for r in near.join(d).collect())


def test_jaccard_join_of_one_large_family(spark, monkeypatch):
    # Edges between representatives, of all tables of edges that components see, for one family of 2,048 near copies.
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in rng.integers(0, 900, 150)]
    rows = [(i, " ".join(w if k != at else f"e{i}" for k, w in enumerate(base))) for i, at in enumerate(rng.integers(0, 150, 2048).tolist())]
    seen = []
    monkeypatch.setattr(near, "components", lambda e: (seen.append(e.where("a <> b").distinct().count()), components(e))[1])
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert {(r.class_id, r.n_links) for r in near.join(d).collect()} == {(0, 2047)}
    assert max(seen) < 2 * near.band_shape()[0] * 2048
    seen.clear()
    assert [r.doc_id for r in near.dedupe(d).collect()] == [0]
    assert len(seen) == 2 and seen[1] == 0  # pivots' links, and ties between classes: no group was compared


def test_dedupe_gives_the_classes_of_the_join(spark, texts):
    rng = np.random.default_rng(9)
    more, base = {}, [f"w{k}" for k in range(60)]
    for i in range(500):  # chains: neighbours are similar, far ones are not
        base = [f"n{i}" if k == i % 60 else w for k, w in enumerate(base)]
        more[20_000 + i] = " ".join(base)
    for i in range(700):  # several classes of one template
        w = [f"t{k}" for k in range(148)] + [f"o{i % 9}x{k}" for k in range(52)]
        w[int(rng.integers(0, 200))] = f"e{i}"
        more[30_000 + i] = " ".join(w)
    both = texts | more
    group, links = brute_classes(both)
    d = spark.createDataFrame(list(both.items()), "doc_id long, text string").repartition(7)
    got = near.join(d).collect()
    assert not [r for r in got if r.class_id != group[r.doc_id] or r.n_links != links[r.doc_id]]
    assert {r.doc_id for r in near.dedupe(d).collect()} == set(group.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24))
    v = [(centres[i % 12] + 0.6 * rng.standard_normal(24)) * rng.uniform(0.5, 2) for i in range(1500)]
    v[0] *= 5  # long, so that its copies are what is nearest to it
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000 + i, v[0].tolist()) for i in range(40)]
    rows += [(3000, None), (3020, [0.0] * 24), (3040, [float("nan")] * 24), (3060, [None] * 24), (3080, [1.0]), (None, [1.0] * 24)]
    e = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(e, e.where("vec_id % 20 = 0"), shard_rows=400).toPandas()
    real = [(i, np.array(x)) for i, x in rows if i is not None and i < 3000]
    ids, m = np.array([i for i, _ in real]), np.stack([x for _, x in real])
    hits = total = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert q not in set(part.vec_id) and part["rank"].tolist() == list(range(1, 21)) and (part.score.diff().dropna() <= 0).all()
        s = ann.products(m, m[ids == q][0])
        assert part.score.to_numpy() == pytest.approx([s[ids == i][0] for i in part.vec_id])
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hits, total = hits + len(set(order) & set(part.vec_id)), total + 20
    assert set(got.query_id) == {i for i in ids if i % 20 == 0} and hits / total >= 0.9
    # Equal vectors are ordered by id.
    same = got[(got.query_id == 0) & (got.vec_id >= 2000)].sort_values("rank").vec_id.tolist()
    assert same == list(range(2000, 2020))
    none = ann.usable(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert ann.search(none, none).count() == 0


@pytest.mark.parametrize("n, copies", [(2, 1), (21, 1), (32, 1), (60, 1), (10, 30)])
def test_neighbours_in_small_tables(spark, n, copies):
    v = np.random.default_rng(n).standard_normal((n, 24))
    rows = [(i + n * c, x.tolist()) for c in range(copies) for i, x in enumerate(v)]
    e = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.search(e, e.where("vec_id < 3")).toPandas()
    ids, m = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    for q in range(min(3, n)):
        s = ann.products(m, m[q])
        part = got[got.query_id == q].sort_values("rank")
        assert len(part) == min(20, len(rows) - 1)
        if n <= 21:  # every entry is looked at
            assert part.vec_id.tolist() == [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]


def test_language_held_out_accuracy(spark, docs):
    got = langid.label(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in kept]) >= 0.97 and all(0 <= r.score <= 1 for r in got)
    for n in (2, 4, 9, 30):
        words = langid.codewords(n)
        assert len({tuple(w) for w in words.tolist()}) == n
    d = spark.createDataFrame([(1, "abc", None), (2, "123 !", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.label(d).collect()} == {"und"}


def test_forest_stops_where_the_plain_ascent_stops(monkeypatch):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.standard_normal((900, 12)), 1e-3 * rng.standard_normal((60, 12)) + 1])
    f = ann.Forest(v, float(np.sqrt((v**2).sum(1).max())), trees=6)
    calls, ranges = [], f._ranges
    monkeypatch.setattr(f, "_ranges", lambda *x: calls.append(1) or ranges(*x))
    q = np.concatenate([v[::40], rng.standard_normal((5, 12))])
    flat = np.hstack([q, np.zeros((len(q), 1))])
    codes = [f._codes(flat, p) for p in f.planes]
    for wanted, least in ((150, 21), (3, 30), (10**9, 21)):
        calls.clear()
        got = list(f.candidates(q, wanted, least))
        assert len(calls) <= 8
        for i, c in enumerate(got):
            own = 6 * any((x == q[i]).all() for x in v)
            for depth in range(ann.BITS, -1, -1):
                same = [(s >> np.uint64(ann.BITS - depth) == codes[t][i] >> np.uint64(ann.BITS - depth)) if depth else np.ones(len(v), bool) for t, s in enumerate(f.sorted)]
                there = np.unique(np.concatenate([f.order[t][m] for t, m in enumerate(same)]))
                if sum(m.sum() for m in same) - own >= wanted and len(there) >= least:
                    break
            assert c.tolist() == there.tolist()


def test_rough_products_keep_the_best():
    rng = np.random.default_rng(9)
    for scale in (1.0, 1e-160, 1e200):
        v = rng.standard_normal((500, 16)) * scale
        v[100:200] = v[0] + 1e-15 * v[100:200]
        f, places = ann.Forest(v / scale, 1.0, trees=1), np.arange(0, 500, 2)
        f.longest = float(np.sqrt(((v / scale) ** 2).sum(1).max()) * scale)
        with np.errstate(all="ignore"):
            for q in v[:20]:
                kept = ann.best_roughly(v @ q, places, 21, f.slack(q))
                s = ann.products(v[places], q)
                best = places[s >= np.partition(s, -21)[-21]]
                assert set(best.tolist()) <= set(kept.tolist())
                assert scale != 1.0 or len(kept) <= 21 + 50


def test_encoder_gives_the_tokenizers_ids(texts):
    enc, plain = Encoder(default_path(), memory=2000), Tokenizer.from_file(default_path())
    rng = np.random.default_rng(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "12", ".", ",", "'s", " ", "!!", " \n", "\x02", "<|endoftext|>", "́", "Word"]
    made = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)] + list(texts.values())
    for at in range(0, len(made), 300):
        some = made[at : at + 300]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.batch(some)] == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]
    assert np.frombuffer(enc.batch(["a <|endoftext|> b"])[0], "<u4").tolist() == [64, 220, 50256, 275]
    literal = Encoder(default_path(), literal=True)
    assert np.frombuffer(literal.batch(["a <|endoftext|> b"])[0], "<u4").tolist()[:4] == [64, 1279, 91, 437]


def test_encoder_keeps_frequent_pieces():
    class Counting(Encoder):
        learnt = ()

        def spaced(self, pieces, known):
            self.learnt = [*self.learnt, *pieces]
            super().spaced(pieces, known)

    enc, plain = Counting(default_path(), memory=400), Tokenizer.from_file(default_path())
    for i in range(40):
        # A hundred rare words and ten frequent ones a batch; a mark asks for the slower way too.
        text = "x " + " ".join([*(f"rare{i}x{k}" for k in range(100)), *(f"often{k}" for k in range(10))]) + " !?" * (i % 2)
        assert np.frombuffer(enc.batch([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(enc.fine) + len(enc.plain) + len(enc.old_fine) + len(enc.old_plain) <= 400 + 2 * 250
    assert max(enc.learnt.count(f"often{k}") for k in range(10)) <= 2


def test_packing_leaves_no_pieces_in_the_worker(spark, docs):
    def held(batches):
        from voltloom.llm import tokens

        for _ in batches:
            pass
        yield pd.DataFrame({"n": [sum(len(m) for e in tokens._loaded.values() for m in (e.fine, e.plain, e.old_fine, e.old_plain))]})

    assert packing.pieces(docs).count() >= docs.count()
    # Only the empty piece of either kind.
    assert {r.n for r in spark.range(0, 64, 1, 16).mapInPandas(held, "n long").collect()} <= {0, 2}


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 5, 300, 1, 77)]
    r = bitpack.Reader(bitpack.to_file([1, None, 3, 4, 5], [x.tobytes() for x in ids], bits, block=64))
    assert r.bits == bits and [r.document(i).tolist() for i in range(5)] == [x.tolist() for x in ids]
    assert r.ids(3, 250).tolist() == np.concatenate(ids)[3:250].tolist() and r.null.tolist() == [False, True, False, False, False]
    assert bitpack.width(50_257) == 16 and bitpack.width(2) == 1


def test_token_files_and_packing_against_the_tokenizer(spark, docs, texts):
    plain, start = Tokenizer.from_file(default_path()), 0
    texts = texts | {10**6: "one <|endoftext|>two", 10**6 + 1: "<|endoftext|>", 10**6 + 2: "a\n<|endoftext|><|endoftext|> ."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in bitpack.encode(docs.repartition(5)).collect()}
    pieces = collections.defaultdict(list)
    for r in packing.pack_documents(docs).collect():
        pieces[r.doc_id].append(r)
    for i in sorted(texts):
        ids = np.array([*plain.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        ids[-1] = 0
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 2048 for r in own[1:]) and len(own) == -(-len(ids) // 2048)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own) and sum(r.length for r in own) == len(ids)
    by = collections.defaultdict(list)
    for r in itertools.chain(*pieces.values()):
        by[r.sequence_id].append((r.offset, r.length))
    for content in by.values():
        content.sort()
        ends = np.cumsum([n for _, n in content])
        assert [a for a, _ in content] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    total = sum(n for c in by.values() for _, n in c)
    assert len(by) <= 1.02 * -(-total // 2048) + 1


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(0)
    for n, size in ((0, 64), (1, 64), (5000, 64), (3000, 2048)):
        counts = np.bincount(rng.integers(1, size + 1, n), minlength=size + 1)
        runs, sequences = packing.plan(counts, size)
        assert (np.bincount(runs[:, 0], runs[:, 1], size + 1) == counts).all()
        used = collections.Counter()
        for length, repeats, first, _ in runs:
            for s in range(first, first + repeats):
                used[s] += length
        assert len(used) == sequences and max(used.values(), default=0) <= size


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = pipeline.language(spark, docs, SF)
    assert first.columns == docs.columns and first.count() >= 0.99 * docs.count()
    kept = {r.doc_id: r.text for r in first.collect()}
    group, _ = brute_classes(kept)
    once = near.dedupe(first)
    assert {r.doc_id for r in once.collect()} == set(group.values())
    assert {r.doc_id for r in rows} <= set(group.values()) and rows
    odd_out = pipeline.near_duplicates(spark, pipeline.language(spark, odd(spark), SF), SF)
    assert odd_out.columns == odd(spark).columns
    assert all(stage(spark, empty(spark), SF).count() == 0 for _, stage in pipeline.STAGES)
