"""Cross-entropy difference between a target and a background bigram model.

Both models share one vocabulary and one smoothing; the background is counted on all documents, the target on the trusted ones.
A bigram's probability is a mixture of its own and its word's frequency. Loss is in nats per token; ``score`` is target minus
background loss: the lower, the more like the target.

Texts go through in blocks of some million words. A block sends the distinct 64-bit hashes of its words and bigrams, with its own
counts, to the buckets that their upper bits name; a bucket adds up the counts of all blocks and answers each block with the totals
of what it sent, in the same order; the block, whose texts travel along as numbers of its words, then scores its texts. An n-gram
crosses the network once per block that has it, however many of the block's texts do, and no two n-grams share a count.

Defined results: null text counts as empty; a text without words has losses and score 0; without trusted documents the target model is
the background's; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
Words are runs without ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import few, small_batches
from .text_hash import mix, word_hashes

#: Words the smoothing reckons with at least; larger vocabularies count as they are.
WORDS = 1 << 18
#: Share of the bigram's own frequency, and pseudo-counts of a word.
OWN, SMOOTH = 0.6, 0.5
#: Words of a block, and of the texts per bucket; the fewest buckets.
BLOCK, BUCKET, BUCKETS = 1 << 21, 1 << 21, 64
#: Words whose losses are computed at once.
STEP = 1 << 17
_TEXTS = np.dtype([("doc_id", "<i8"), ("none", "?"), ("n", "<u4"), ("ours", "?"), ("asks", "?")])
_ASKED = "bucket int, block long, asks boolean, words binary, word_counts binary, pairs binary, pair_counts binary, texts binary, names binary, tokens binary"
_ANSWERED = "bucket int, block long, words binary, pairs binary, texts binary, names binary, tokens binary"
_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def tight(values: np.ndarray) -> bytes:
    """Unsigned integers, all in as many bytes as the largest needs, first all lowest bytes, then all next ones."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def loose(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def steps(ascending: np.ndarray) -> bytes:
    return tight(np.diff(ascending, prepend=np.uint64(0)))


def small(values: np.ndarray) -> bytes:
    """``tight``, and compressed: for counts and ranks, most of which are small."""
    return zlib.compress(tight(values), 1)


def large(data: bytes) -> np.ndarray:
    return loose(zlib.decompress(data))


def hashes(text: str) -> np.ndarray:
    return word_hashes(text.encode("utf-8", "surrogatepass").lower())


def following(h: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """What stands before each word of texts with ``n`` words each; ``start`` before the first of a text."""
    before = np.concatenate([h[:1], h[:-1]])
    before[(np.cumsum(n) - n)[n > 0]] = start
    return before


def pair_hashes(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + h)


def within(text: np.ndarray, item: np.ndarray) -> np.ndarray:
    """How often each element's item occurs in its text."""
    _, place, count = np.unique(text.astype(np.int64) << np.int64(32) | item, return_inverse=True, return_counts=True)
    return count.astype(np.int32)[place]


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: the rows without their texts, the number of words of each, and the hashes of all words."""
    held, found, size = [], [], 0

    def block() -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        return pd.concat(held), np.array([len(h) for h in found], np.int64), np.concatenate(found)

    for batch in batches:
        if not len(batch):
            continue
        found += [hashes(t) for t in batch.pop("text")]
        held.append(batch)
        size += sum(map(len, found[-len(batch) :]))
        if size >= BLOCK:
            yield block()
            held, found, size = [], [], 0
    if held:
        yield block()


@dataclass
class Models:
    """``rows``: what was counted (doc_id, text, trusted); the words of all and of trusted texts, and the number of different words."""

    rows: DataFrame
    background: int
    target: int
    vocabulary: int
    #: Nothing is trusted: the models differ only by the text's own counts.
    same: bool


def train(docs: DataFrame, trusted: DataFrame) -> Models:
    """The totals of both models; their counts are added up where they are used."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, n, h in gathered(batches):
            word, b = np.unique(h, return_counts=True)
            good = h[np.repeat((rows.trusted == True).to_numpy(), n)]  # noqa: E712
            yield pd.DataFrame({"word": word.view(np.int64), "b": b, "t": np.bincount(np.searchsorted(word, good), minlength=len(word))})

    rows = flagged(docs, trusted)
    words = rows.select("text", "trusted").mapInPandas(count, "word long, b long, t long").groupBy("word").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
    vocabulary, background, target = (int(x or 0) for x in words.agg(F.count("*"), F.sum("b"), F.sum("t")).first())
    return Models(rows, background, target or background, max(WORDS, vocabulary), not target)


def asked(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Rows of _ASKED, one per block and bucket with n-grams; the block's texts are in one of them."""
    buckets, shift = 1 << bits, np.uint64(64 - bits)
    part = TaskContext.get().partitionId()
    for k, (rows, n, h) in enumerate(gathered(batches)):
        counts, asks, trusted = ((rows[c] == True).to_numpy() for c in ("counts", "asks", "trusted"))  # noqa: E712
        every, good = np.repeat(counts, n), np.repeat(counts & trusted, n)
        # The start of a text is word 0, the least of all hashes.
        words, place = np.unique(np.append(h, np.uint64(0)), return_inverse=True)
        place = place[:-1]
        before = following(place, n, 0)
        pairs, pair = np.unique(pair_hashes(words[before], h), return_inverse=True)
        add = lambda x, some, size: np.bincount(x[some], minlength=size).astype(np.uint64)
        word_counts = np.stack([add(x, some, len(words)) for x in (place, before) for some in (every, good)])
        pair_counts = np.stack([add(pair, some, len(pairs)) for some in (every, good)])
        at, to = (np.searchsorted(x >> shift, np.arange(buckets + 1, dtype=np.uint64)) for x in (words, pairs))
        texts = names = tokens = None
        if asks.any():
            about = np.zeros(len(rows), _TEXTS)
            about["none"] = rows.doc_id.isna()
            about["doc_id"], about["n"], about["ours"], about["asks"] = rows.doc_id.fillna(0).astype("int64"), n, trusted, asks
            often = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint64)
            rank[often] = np.arange(len(words), dtype=np.uint64)
            texts, names, tokens = about.tobytes(), words[often].tobytes(), small(rank[place])
        out = []
        for b in range(buckets):
            i, j, x, y = at[b], at[b + 1], to[b], to[b + 1]
            if i < j or x < y:
                out.append((b, part << 33 | k, bool(asks.any()), steps(words[i:j]), small(word_counts[:, i:j].ravel()), steps(pairs[x:y]), small(pair_counts[:, x:y].ravel()), None, None, None))
        # Texts of different blocks go by different buckets.
        carrier = (part + 31 * k) % len(out)
        out[carrier] = (*out[carrier][:-3], texts, names, tokens)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _ASKED.split(", ")])


def totals(hashed: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of hashes the sums of their counts (rows of one matrix per list) over all lists."""
    _, place = np.unique(np.concatenate(hashed), return_inverse=True)
    sums = [np.bincount(place, np.concatenate(c)).astype(np.uint64) for c in zip(*counts, strict=True)]
    ends = np.cumsum([len(h) for h in hashed])
    return [np.stack([s[place[e - len(h) : e]] for s in sums]) for h, e in zip(hashed, ends, strict=True)]


def answered(d: pd.DataFrame) -> pd.DataFrame:
    """Rows of _ANSWERED for all rows of a bucket that ask."""
    out = d[["bucket", "block", "texts", "names", "tokens"]].copy()
    for name, kinds in (("word", 4), ("pair", 2)):
        hashed = [np.cumsum(loose(x), dtype=np.uint64) for x in d[f"{name}s"]]
        out[f"{name}s"] = [small(x.ravel()) if asks else None for x, asks in zip(totals(hashed, [large(x).reshape(kinds, -1) for x in d[f"{name}_counts"]]), d.asks, strict=True)]
    return out[d.asks][[c.split()[0] for c in _ANSWERED.split(", ")]]


def scored(d: pd.DataFrame, models: tuple[int, int, int, bool]) -> pd.DataFrame:
    """The scores of a block's texts that ask, from all answers to the block."""
    background, target, vocabulary, same = models
    d = d.sort_values("bucket")
    word, pair = (np.concatenate([large(x).reshape(k, -1) for x in d[c]], axis=1).astype(np.float64) for c, k in (("words", 4), ("pairs", 2)))
    texts, names, tokens = (d[c].dropna().iloc[0] for c in ("texts", "names", "tokens"))
    texts, names, tokens = np.frombuffer(texts, _TEXTS), np.frombuffer(names, np.uint64), large(tokens).astype(np.int32)
    n = texts["n"].astype(np.int64)
    order = np.argsort(names)
    start = int(order[0])  # word 0
    before = following(tokens, n, start)
    pairs, at = np.unique(pair_hashes(names[before], names[tokens]), return_inverse=True)
    if len(pairs) != pair.shape[1] or len(names) != word.shape[1]:
        raise RuntimeError("answers do not fit the block: its input was read in another order again")
    at = at.astype(np.int32)
    by_name = np.empty_like(word)
    by_name[:, order] = word
    text = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    own, own_word = within(text, at), within(text, tokens)
    # A word stands before another one as often as it occurs, but for the last of a text.
    last = np.zeros(len(texts), np.int64)
    last[n > 0] = tokens[(np.cumsum(n) - 1)[n > 0]]
    own_first = (before == start).astype(np.int32)
    inner = np.flatnonzero(before != start)
    own_first[inner] = own_word[inner - 1] - (before[inner] == last[text[inner]])
    losses = []
    for k, total, less in ((0, background, np.ones(len(texts))), (0 if same else 1, target, texts["ours"].astype(np.float64))):
        loss = np.empty(len(text))
        for i in range(0, len(text), STEP):
            j = slice(i, i + STEP)
            but = less[text[j]]
            rate = np.minimum(1.0, (pair[k][at[j]] - but * own[j]) / np.maximum(by_name[2 + k][before[j]] - but * own_first[j], 1))
            chance = OWN * rate + (1 - OWN) * (by_name[k][tokens[j]] - but * own_word[j] + SMOOTH) / (total - but * n[text[j]] + SMOOTH * vocabulary)
            loss[j] = -np.log(chance)
        losses.append(np.bincount(text, loss, len(texts)) / np.maximum(n, 1))
    asks = texts["asks"]
    doc_id = pd.array(texts["doc_id"][asks], "Int64")
    doc_id[texts["none"][asks]] = pd.NA
    b, t = (x[asks] for x in losses)
    return pd.DataFrame({"doc_id": doc_id, "n_tokens": n[asks], "target_loss": t, "background_loss": b, "score": t - b})


def asking(rows: DataFrame, models: Models) -> DataFrame:
    """What all blocks send to the buckets."""
    bits = max(BUCKETS, models.background // BUCKET).bit_length() - 1
    return rows.select("doc_id", "text", "trusted", "counts", "asks").mapInPandas(lambda batches: asked(batches, bits), _ASKED)


def exchange(rows: DataFrame, models: Models) -> DataFrame:
    """The scores of the rows that ask, by the counts of the rows that count."""
    about = (models.background, models.target, models.vocabulary, models.same)
    answers = asking(rows, models).groupBy("bucket").applyInPandas(answered, _ANSWERED)
    return answers.groupBy("block").applyInPandas(lambda d: scored(d, about), _SCORES)


def score(docs: DataFrame, trusted: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means per token) and score of every row.

    A text is scored by models without its own counts, so those the target was trained on have no advantage.
    """
    small_batches(docs.sparkSession)
    yes, no = F.lit(True), F.lit(False)
    counted = models.rows.withColumns({"counts": yes, "asks": no})
    return exchange(counted.unionByName(flagged(docs, trusted).withColumns({"counts": no, "asks": yes})), models)


def flagged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and whether the document is trusted; ``trusted`` has distinct doc_ids."""
    mine = few(trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(mine, "doc_id", "left")


def rank(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Train both models on the tables and score every row."""
    models = train(docs, trusted)
    return exchange(models.rows.withColumns({"counts": F.lit(True), "asks": F.lit(True)}), models)
