"""Near-duplicate join: documents whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

1. Every whole text gets its set of runs (64-bit hashes), a hash of the set, and MinHash bands; band and row counts follow from the
   wanted recall at the threshold. Texts with equal sets are one class and go on as one representative.
2. Representatives are shuffled on band hashes. In a bucket each member is paired with one pivot, so pairs grow with the
   members; pivots differ by band. Pairs are verified on the full sets, and those of LOOSE similarity or more tie
   representatives into groups. Members whose links the pivot may not have shown get a new one, and after STARS pivots
   are compared pair by pair within their bucket, so no link between two members of a bucket is lost.
   Pairs of the threshold or more are links, and their components are the first classes.
3. Members of a group meet in blocks: every pair of blocks is one unit of work that compares its pairs on full sets and returns
   how many links each member has and edges that join two classes. Blocks meet themselves first, so that edges stay few. Where only the
   classes are asked for, groups that are one class are not compared, and in others only what stands outside their
   largest class is compared with the rest. No pair is lost or capped, and no task sees more than two blocks.

Words are runs without ASCII white space; a text of one to four words has one run, all its words. Two similar texts miss each
other only if they share no bucket, which happens to one in 1 / (1 - RECALL) of such pairs at the threshold.

Defined results: null and empty texts, and those of white space only, have no runs and no links, and are classes of their own; a
row's ``class_id`` is the least doc_id of its class (null if all are null), its ``n_links`` the number of other rows linked to it;
repeated rows are links of each other; an empty table gives no rows; extra columns are kept by ``dedupe``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .pii import free_name
from .tables import few, small_batches, stored
from .text_hash import mix, runs, word_hashes

WORDS, SIMILAR, LOOSE = 5, 0.8, 0.6
RECALL, MOST_HASHES = 0.9995, 128
#: Members of a block, and their runs together, unless one text has more.
BLOCK, BLOCK_RUNS = 256, 1 << 18
#: Pivots a bucket gets one after the other before its unsettled members are compared pair by pair.
STARS = 3
_SIGNS = "h1 long, h2 long, n int, bands array<long>"


def band_shape(similar: float = SIMILAR, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have so that ``recall`` is reached at ``similar`` with at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def run_set(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word runs."""
    h = word_hashes(text.encode("utf-8", "surrogatepass"))
    return np.unique(runs(h, min(words, len(h)))) if len(h) else h


class Signer:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(5)
        self.bands, self.rows = bands, rows
        self.times = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        self.salt = rng.integers(0, 1 << 63, bands, np.uint64)

    def sign(self, s: np.ndarray) -> list[int]:
        least = np.full(self.bands * self.rows, ~np.uint64(0))
        for at in range(0, len(s), 4096):
            np.minimum(least, (s[at : at + 4096, None] * self.times + self.plus).min(0), out=least)
        h = self.salt
        for r in range(self.rows):
            h = mix(h + least[r :: self.rows])
        return h.view(np.int64).tolist()


def signed(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """All columns of ``docs``, a row number and the struct of set hash, set size and bands, stored."""
    small_batches(docs.sparkSession)
    signer = Signer(*band_shape())

    @F.pandas_udf(_SIGNS)
    def sign(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            s = run_set(t or "")
            m = mix(s)
            out.append((int(s.sum().view(np.int64)) if len(s) else 0, int(m.sum().view(np.int64)) if len(s) else 0, len(s), signer.sign(s) if len(s) else []))
        return pd.DataFrame(out, columns=["h1", "h2", "n", "bands"])

    return stored(docs.withColumn(names["row"], F.monotonically_increasing_id()).withColumn(names["sign"], sign("text")), "near-signed")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.withColumnsRenamed({"rep": "_a", "text": "text_a"})
    b = texts.withColumnsRenamed({"rep": "_b", "text": "text_b"})
    return pairs.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).select("a", "b", "text_a", "text_b")


def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaccard similarity of the full run sets."""
    out, seen = [], {}
    for x, y in zip(left, right, strict=True):
        if y not in seen:
            seen = {y: run_set(y)}  # pairs of one pivot mostly follow each other
        a, b = run_set(x), seen[y]
        both = len(np.intersect1d(a, b, assume_unique=True))
        out.append(both / (len(a) + len(b) - both))
    return pd.Series(out, dtype="float64")


def shared_runs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of runs that sets on the left and right have in common, in bounded memory."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = max(64, (1 << 21) // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[i:j], column[i:j] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def block_links(d: pd.DataFrame, similar: float, count: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each row, counting copies; a forest of linked components) between rows of side 0 and side 1, or among side 0 alone.

    Rows of one component are linked already: they give no edge, and are compared only if links are counted.
    """
    side, comp, copies = (d[c].to_numpy() for c in ("side", "comp", "copies"))
    links = np.zeros(len(d), np.int64)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = d.i.iloc[0] == d.j.iloc[0]
    b = a if alone else b
    if not len(a) or not len(b) or not count and (comp == comp[0]).all():
        return links, []
    sets = [run_set(t) for t in d.text]
    n = np.array([len(s) for s in sets])
    both = shared_runs([sets[i] for i in a], [sets[i] for i in b]).astype(np.float64)
    # both / (n_a + n_b - both) >= similar, without rounding
    linked = both >= similar * (n[a][:, None] + n[b][None] - both) - 1e-9
    if alone:
        np.fill_diagonal(linked, False)
    links[a] += linked @ copies[b]
    if not alone:
        links[b] += linked.T @ copies[a]
    x, y = np.nonzero(linked)
    pairs = np.unique(np.sort(np.stack([comp[a[x]], comp[b[y]]], 1)[comp[a[x]] != comp[b[y]]], axis=1), axis=0)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for x, y in pairs.tolist():
        i, j = root(x), root(y)
        if i != j:
            parent[max(i, j)] = min(i, j)
            forest.append((x, y))
    return links, forest


def unit_work(members: DataFrame, similar: float, diagonal: bool, count: bool) -> DataFrame:
    """(a, b, links): rows with b null hold links of representative a, if they are counted; the others are edges between components.

    ``members``: grp, blocks, askers (how many of the blocks hold those that ask), asks, rep, comp, copies, text. A unit of work is a
    pair of blocks with a member that asks: of one block with itself if ``diagonal``, else of two.
    """
    spot = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(F.col("asks"), F.col("askers")).otherwise(F.col("blocks") - F.col("askers"))))
    m = members.withColumn("mine", (spot + F.when(F.col("asks"), 0).otherwise(F.col("askers"))).cast("int"))
    if diagonal:
        m = m.where("asks").withColumn("other", F.col("mine"))
    else:
        others = F.sequence(F.lit(0), F.when(F.col("asks"), F.col("blocks")).otherwise(F.col("askers")) - 1)
        m = m.withColumn("other", F.explode(F.filter(others, lambda o: o != F.col("mine"))))
    m = m.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "comp", "copies", "text")
    dealt = m.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None

        def work() -> pd.DataFrame:
            d = pd.concat(held) if len(held) > 1 else held[0]
            links, forest = block_links(d, similar, count)
            some = (links > 0) & count
            rows = [(r, None, n) for r, n in zip(d.rep.to_numpy()[some].tolist(), links[some].tolist(), strict=True)]
            return pd.DataFrame(rows + [(x, y, 0) for x, y in forest], columns=["a", "b", "links"]).astype({"a": "int64", "b": "Int64", "links": "int64"})

        for batch in batches:
            marks = batch[["grp", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(batch)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y > x:
                    if held and key != tuple(marks[x]):
                        yield work()
                        held = []
                    key = tuple(marks[x])
                    held.append(batch.iloc[x:y])
        if held:
            yield work()

    return dealt.mapInPandas(run, "a long, b long, links long")


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (rep, comp) after joining the components that ``edges`` (a, b) connect."""
    if edges.isEmpty():
        return labels
    moved = stored(components(edges).withColumnRenamed("component", "_to"), "near-moved")
    return stored(labels.join(few(moved), F.col("comp") == F.col("node"), "left").select("rep", F.coalesce("_to", "comp").alias("comp")), "near-labels")


def compared(groups: DataFrame, labels: DataFrame, sets: DataFrame, texts: DataFrame, similar: float, count: bool) -> tuple[DataFrame, DataFrame | None]:
    """(labels after all links inside the groups, (rep, links) if counted). ``groups``: grp, rep.

    Blocks are first compared with themselves. What is linked there is one component when blocks meet, so a pair of blocks adds an edge
    or two for a family and not a forest. Without counting, groups that are one component need no comparison, and in the others
    only members outside the largest component ask.
    """
    about = groups.join(labels, "rep").join(texts.select("rep", "n"), "rep")
    parts = about.groupBy("grp", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("r"))
    most = F.max(F.struct("c", "r", (-F.col("comp")).alias("comp")))
    sizes = parts.groupBy("grp").agg(F.count("*").alias("parts"), F.sum("c").alias("all"), F.sum("r").alias("runs"), most.alias("most"))
    many = lambda rows, runs: F.ceil(F.greatest(rows / BLOCK, runs / BLOCK_RUNS)).cast("int")
    if count:
        sizes = sizes.where(F.col("all") > 1).select("grp", many(F.col("all"), F.col("runs")).alias("blocks"), many(F.col("all"), F.col("runs")).alias("askers"), F.lit(None).cast("long").alias("major"))
    else:
        askers = many(F.col("all") - F.col("most.c"), F.col("runs") - F.col("most.r"))
        sizes = sizes.where("parts > 1").select("grp", (askers + many(F.col("most.c"), F.col("most.r"))).alias("blocks"), askers.alias("askers"), (-F.col("most.comp")).alias("major"))
    sizes = stored(sizes, "near-sizes")
    most = sizes.agg(F.max("blocks")).first()[0]
    if most is None:
        return labels, None
    # Who asks stays as it is at the beginning, and with it the dealing to blocks.
    asks = F.col("major").isNull() | (F.col("comp") != F.col("major"))
    members = groups.join(few(sizes), "grp").join(labels, "rep").select("grp", "blocks", "askers", "rep", asks.alias("asks"))
    members = stored(members.join(sets.select("rep", "copies"), "rep"), "near-members")
    links = None
    for diagonal in (True, False)[: 1 + (most > 1)]:
        some = members if diagonal else members.where("blocks > 1")
        work = stored(unit_work(some.join(labels, "rep").join(texts.select("rep", "text"), "rep"), similar, diagonal, count), "near-links")
        labels = relabelled(labels, work.where("b is not null").select("a", "b"))
        if count:
            found = work.where("b is null").select(F.col("a").alias("rep"), "links")
            links = found if links is None else links.unionByName(found)
    return labels, links.groupBy("rep").agg(F.sum("links").alias("links")) if count else None


def starred(members: DataFrame) -> DataFrame:
    """band, hash, rep and the pair (a, b) of rep and its bucket's pivot. ``members``: band, hash, rep."""
    # Pivots in an order that differs by band.
    order = F.struct(F.xxhash64("rep", "band").alias("o"), F.col("rep").alias("pivot"))
    buckets = members.groupBy("band", "hash").agg(F.min(order).alias("p"), F.count("*").alias("c")).where("c > 1").select("band", "hash", "c", "p.pivot")
    both = members.join(buckets, ["band", "hash"]).where("rep <> pivot")
    return both.select("band", "hash", "c", "rep", F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))


def unsettled(star: DataFrame, near: DataFrame, similar: float) -> DataFrame:
    """band, hash, rep of the members whose links their pivot may not have shown.

    Those are the members less than LOOSE similar to it, and of the others those that may be linked to one of them: linked
    sets differ by at most 1 - ``similar`` in their similarity to any third (Jaccard distances obey the triangle inequality).
    """
    placed = star.where("c > 2").join(near, ["a", "b"]).select("band", "hash", "rep", "similar")
    far = placed.where(F.col("similar") < LOOSE).groupBy("band", "hash").agg(F.max("similar").alias("top"))
    left = placed.join(far, ["band", "hash"]).where((F.col("similar") < LOOSE) | (F.col("similar") - (1 - similar) <= F.col("top") + 1e-9))
    return left.select("band", "hash", "rep")


def tied(rows: DataFrame, names: dict[str, str], bands: DataFrame, similar: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs (a, b, similar) of representatives and pivots, (band, hash, rep) of the members that no pivot settled, (rep, n, text)
    of all that share a bucket)."""
    jaccard = F.pandas_udf(similarity, "double")
    left, near, texts = bands, None, None
    for _ in range(STARS):
        star = starred(left)
        pairs = stored(star.select("a", "b").distinct(), "near-pairs")
        if texts is None:
            needed = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
            texts = rows.select(F.col(names["row"]).alias("rep"), F.col(names["sign"])["n"].alias("n"), "text").join(few(needed), "rep", "left_semi")
            texts = stored(texts, "near-texts")
        found = stored(with_texts(pairs, texts.select("rep", "text")).select("a", "b", jaccard("text_a", "text_b").alias("similar")), "near-verified")
        near = found if near is None else near.unionByName(found)
        left = stored(unsettled(star, found, similar), "near-left")
        if left.isEmpty():
            break
    return near, left, texts


def classes(docs: DataFrame, similar: float = SIMILAR, count: bool = True) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(signed rows, (row, class row, links), names of the added columns); rows without runs are not in the second table.

    Links are null unless ``count``.
    """
    names = {k: free_name(docs, f"_vl_{k}") for k in ("row", "sign")}
    rows = signed(docs, names)
    s = rows.select(F.col(names["row"]).alias("row"), F.col(names["sign"]).alias("s"))
    keys = s.where("s.n > 0").select("row", "s.h1", "s.h2", "s.n")
    sets = stored(keys.groupBy("h1", "h2", "n").agg(F.min("row").alias("rep"), F.count("*").alias("copies")), "near-sets")
    bands = s.join(sets.select("rep"), F.col("row") == F.col("rep"), "left_semi").select(F.col("row").alias("rep"), F.posexplode("s.bands").alias("band", "hash"))
    bands = stored(bands, "near-bands")
    near, left, texts = tied(rows, names, bands, similar)
    # A pivot comparison that reaches the threshold is a link; those alone settle most classes.
    known = components(near.where(F.col("similar") >= similar - 1e-9).select("a", "b"))
    labels = stored(texts.select("rep").join(known, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("comp")), "near-labels")
    if not left.isEmpty():
        # What the pivots left is compared within its bucket.
        buckets = stored(left.select(F.xxhash64("band", "hash").alias("grp"), "rep").distinct(), "near-left-members")
        labels, _ = compared(buckets, labels, sets, texts, similar, False)
    # Groups are of classes; ties within one say nothing.
    a, b = (labels.select(F.col("rep").alias(f"_{k}"), F.col("comp").alias(f"comp_{k}")) for k in "ab")
    ties = near.where((F.col("similar") >= LOOSE) & (F.col("similar") < similar - 1e-9)).join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
    tops = components(ties.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    groups = labels.join(few(tops), F.col("comp") == F.col("node"), "left").select(F.coalesce("component", "comp").alias("grp"), "rep")
    groups = stored(groups, "near-groups")
    labels, links = compared(groups, labels, sets, texts, similar, count)
    by_rep = sets.join(labels, "rep", "left")
    by_rep = by_rep.join(links, "rep", "left") if links is not None else by_rep.withColumn("links", F.lit(None).cast("long"))
    more = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    by_rep = by_rep.select("h1", "h2", "n", F.coalesce("comp", "rep").alias("class"), (more if count else F.lit(None).cast("long")).alias("n_links"))
    return rows, keys.join(by_rep, ["h1", "h2", "n"]).select("row", "class", "n_links"), names


def join(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, n_links of every row."""
    rows, found, names = classes(docs.select("doc_id", "text"), similar)
    found = stored(found, "near-classes")
    all_rows = rows.select(F.col(names["row"]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    placed = all_rows.join(found, "row", "left").withColumn("class", F.coalesce("class", "row"))
    # Written, so that the join can split a class with many rows; a row alone is its own class.
    shared = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("c")).where("c > 1")
    shared = few(stored(shared.select(F.col("class").alias("_class"), "class_id", "c"), "near-ids"))
    found = placed.join(shared, F.col("class") == F.col("_class"), "left")
    return found.select("doc_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def dedupe(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows and columns of ``docs``, of each class only the row with the least doc_id (null last, then as read)."""
    rows, found, names = classes(docs, similar, count=False)
    found = stored(found, "near-classes")
    row = names["row"]
    ids = rows.select(F.col(row).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    first = found.join(ids, "row").groupBy("class").agg(F.min(F.struct("id", "row")).alias("f"), F.count("*").alias("c")).where("c > 1")
    first = few(stored(first.select("class", F.col("f.row").alias("kept")), "near-first"))
    lost = found.join(first, "class").where("row <> kept").select(F.col("row").alias("_vl_lost"))
    lost = few(stored(lost, "near-lost"))
    return rows.join(lost, rows[row] == lost["_vl_lost"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
