"""Conversation prefix trie: padded turn-id matrices, change masks, and boundary nodes recombined across shards.

1. Turns become two 64-bit hashes of (role, text) and the text's bytes; texts go no further. Conversations are rebuilt from
   arrays of these, and dealt by ranges of the order (turns, conv_id) into shards of consecutive rows. A shard also gets the
   row before and the row after it.
2. In a shard turns get dense ids, conversations become rows of padded matrices (BAND columns at a time), numpy's lexsort orders
   them, and OR-accumulated masks of the changes between neighbouring rows tell where nodes start. At every depth reduceat
   adds up the members of each node. All sums over subtrees are sums over members: a row that shares its first p turns with the
   row before it starts the nodes deeper than p, and repeats the bytes of those up to p.
3. A node that the neighbouring rows of other shards share is open: its parts are added up by the hash of its prefix. At most the
   paths of a shard's two edge rows are open, so this table is small, and sums leave tasks already added up. The ids
   that end in an open node are hashed as a stream in order.

A conversation is one row of 24 bytes a turn; shards are cut by rows and mean length, matrices by BAND columns.

Defined results: rows with null conv_id take no part; null role or text counts as empty; null turns come first; turns with
equal numbers are ordered by the hashes of role and text; repeated rows are turns of their own; conversations without turns after
rebuilding are members of the root; an empty table has no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import few, ranked, small_batches, stored
from .text_hash import mix

#: A rebuilt conversation takes the head of the one with the next smaller multiple of FAMILY as id; heads have fewer than HEADS turns.
FAMILY, HEADS = 5, 9
#: Columns of a matrix, and cells and rows of a shard.
BAND, CELLS, ROWS = 64, 1 << 16, 1024
EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = (
    "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
    "open boolean, k1 long, k2 long, parent_open boolean, p1 long, p2 long"
)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, sizes): the hashes of a rebuilt conversation's turns, two numbers each, and the bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes")
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_family"), F.slice("own", 1, HEADS - 1).alias("head"))
    both = own.withColumn("_of", family).join(heads, F.col("_of") == F.col("_family"), "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), h)).otherwise(F.slice("own", 1, 0))
    whole = both.select("conv_id", F.concat(head, F.slice("own", h + 1, F.size("own"))).alias("t"))
    return whole.select("conv_id", F.flatten(F.transform("t", lambda x: F.array(x["a"], x["b"]))).alias("turns"), F.col("t.bytes").alias("sizes"))


def dense(turns: np.ndarray) -> np.ndarray:
    """Ids of the rows of an (n, 2) array, in their order as signed numbers."""
    order = np.lexsort((turns[:, 1], turns[:, 0]))
    sorted_ = turns[order]
    ids = np.empty(len(turns), np.int32)
    ids[order] = np.concatenate([[0], np.cumsum((sorted_[1:] != sorted_[:-1]).any(1))]) if len(turns) else []
    return ids


def padded(ids: np.ndarray, first: np.ndarray, length: np.ndarray, rows: np.ndarray, at: int) -> np.ndarray:
    """The matrix of columns ``at`` to ``at`` + BAND of the given rows, -1 behind a row's end."""
    place = np.arange(at, at + min(BAND, max(1, int(length[rows].max()) - at)))
    inside = place < length[rows][:, None]
    out = np.full(inside.shape, -1, np.int32)
    out[inside] = ids[(first[rows][:, None] + place)[inside]]
    return out


def ordered(ids: np.ndarray, first: np.ndarray, length: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """The rows in the order of their turns (a beginning before what continues it), then of conv."""
    group = np.zeros(len(conv), np.int64)
    order = np.argsort(conv, kind="stable")
    live, at = order, 0
    while len(live):
        m = padded(ids, first, length, live, at)
        keys = np.lexsort((conv[live], *m.T[::-1], group[live]))
        m, rows = m[keys], live[keys]
        places = np.flatnonzero(np.isin(order, live))
        order[places] = rows
        change = np.concatenate([[True], (m[1:] != m[:-1]).any(1) | (group[rows][1:] != group[rows][:-1])])
        # Groups are named by their first place, so names of earlier and later groups stay in order.
        starts = np.flatnonzero(change)
        group[rows] = places[starts][np.cumsum(change) - 1]
        at += BAND
        sizes = np.diff([*starts, len(rows)])
        longest = np.maximum.reduceat(length[rows], starts)
        live = rows[np.repeat((sizes > 1) & (longest > at), sizes)]
    return order


def shared(ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many first turns each row shares with the row before it; -1 for the first row."""
    out = np.zeros(len(length), np.int64)
    out[:1] = -1
    live, at = np.arange(1, len(length)), 0
    while len(live):
        # Neighbours that stand between two live rows are part of the matrix.
        rows = np.unique(np.concatenate([live - 1, live]))
        m = padded(ids, first, length, rows, at)
        place = np.searchsorted(rows, live)
        changed = (m[place] != m[place - 1]) | (m[place] < 0)
        same = ~np.logical_or.accumulate(changed, axis=1)
        out[live] += same.sum(1)
        at += BAND
        live = live[same[:, -1] & (np.minimum(length[live], length[live - 1]) > at)]
    return out


def prefix_keys(turns: np.ndarray, depth: int) -> np.ndarray:
    """(depth + 1, 2) hashes of the first 0, 1, ... turns."""
    out = np.zeros((depth + 1, 2), np.uint64)
    t = turns[:depth].view(np.uint64)
    for d in range(depth):
        out[d + 1] = mix(out[d] * np.uint64(0x9E3779B97F4A7C15) + t[d])
    return out.view(np.int64)


def shard_nodes(conv: np.ndarray, side: np.ndarray, turns: list[np.ndarray], sizes: list[np.ndarray]) -> pd.DataFrame:
    """The nodes of a shard's own rows (side 0), open ones in part. A row of side -1 or 1 stands before or behind them."""
    length = np.array([len(s) for s in sizes], np.int64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    flat = np.concatenate([np.asarray(t, np.int64) for t in turns]).reshape(-1, 2)
    ids = dense(flat)
    order = ordered(ids, first, length, conv)
    conv, side, length, first = conv[order], side[order], length[order], first[order]
    lcp = shared(ids, first, length)
    total = np.concatenate([[0], np.cumsum(np.concatenate([np.asarray(s, np.int64) for s in sizes]))])
    before = lambda rows, n: total[first[rows] + n] - total[first[rows]]  # noqa: E731  bytes of the first n turns
    own = np.flatnonzero(side == 0)
    low, high = own[0], own[-1]
    behind = int(lcp[high + 1]) if high + 1 < len(conv) else -1
    ahead = int(lcp[low]) if low else -1
    after = np.append(lcp[low + 1 : high + 1], behind)
    lcp, n = lcp[own], length[own]
    if not low:
        lcp[0] = -1
    ids_of, repeated = conv[own], before(own, np.maximum(lcp, 0))
    leaf = (after < n).astype(np.int64)
    left, right = (prefix_keys(flat[first[r] : first[r] + length[r]], max(0, d)) for r, d in ((low, ahead), (high, behind)))
    out = []
    active = np.arange(len(own))
    segment = least = opened = keys = None
    for d in range(int(n.max()) + 1):
        active = active[n[active] >= d]
        l, more = lcp[active], n[active] > d
        start = l < d
        start[0] = True
        s = np.flatnonzero(start)
        rows = active[s]
        add = lambda x: np.add.reduceat(np.asarray(x, np.int64), s)  # noqa: B023, E731
        again = l >= d
        prior = before(own[rows], max(d - 1, 0))
        members = np.diff([*s, len(active)])
        conv_id = np.minimum.reduceat(ids_of[active], s)
        is_left = (rows == 0) & (ahead >= d)
        is_right = np.zeros(len(s), bool)
        is_right[-1] = behind >= d
        is_open = is_left | is_right
        key = np.zeros((len(s), 2), np.int64)
        key[is_left] = left[d] if d < len(left) else 0
        key[is_right] = right[d] if d < len(right) else 0
        ends = np.where(is_open, "", EMPTY).astype(object)
        over = ~more
        if over.any():
            stop = np.searchsorted(s, np.flatnonzero(over), "right") - 1
            who = ids_of[active][over]
            cuts = np.flatnonzero(np.diff(stop)) + 1
            for place, some in zip(stop[np.concatenate([[0], cuts])], np.split(who, cuts), strict=True):
                names = ",".join(map(str, some.tolist()))
                ends[place] = names if is_open[place] else hashlib.sha256(names.encode()).hexdigest()
        frame = {
            "depth": np.full(len(s), d), "conv_id": conv_id, "n_convs": members, "n_children": add((l <= d) & more), "n_leaves": add(leaf[active]),
            "saved_tokens": add(np.where(again, repeated[active], 0)) - add(again) * prior, "ends": ends, "open": is_open, "k1": key[:, 0], "k2": key[:, 1],
        }
        if segment is None:
            frame |= {"parent_conv_id": pd.array([None] * len(s), "Int64"), "parent_open": np.zeros(len(s), bool), "p1": 0, "p2": 0}
        else:
            up = segment[rows]
            frame |= {"parent_conv_id": pd.array(least[up], "Int64"), "parent_open": opened[up], "p1": keys[up, 0], "p2": keys[up, 1]}
        out.append(pd.DataFrame(frame))
        segment = np.zeros(len(own), np.int64)
        segment[active] = np.cumsum(start) - 1
        least, opened, keys = conv_id, is_open, key
    return pd.concat(out, ignore_index=True)


def nodes(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of all rebuilt conversations."""
    spark = conversations.sparkSession
    small_batches(spark)
    convs = stored(rebuilt(conversations), "trie-rebuilt")
    n, turns = convs.agg(F.count("*"), F.sum(F.size("sizes"))).first()
    rows = max(16, min(ROWS, int(CELLS // (1 + (turns or 0) / max(1, n)))))
    placed = ranked(convs, [F.col("turns"), F.col("conv_id")], "trie-ranked", "rank")
    shard, at = F.floor(F.col("rank") / rows), F.col("rank") % rows
    copy = lambda s, side: F.struct(s.cast("long").alias("shard"), F.lit(side).alias("side"))
    last = (at == rows - 1) & (F.col("rank") < n - 1)
    where = F.array_compact(F.array(copy(shard, 0), F.when((at == 0) & (shard > 0), copy(shard - 1, 1)), F.when(last, copy(shard + 1, -1))))
    dealt = placed.select("conv_id", "turns", "sizes", F.explode(where).alias("w")).select("w.shard", "w.side", "conv_id", "turns", "sizes")

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        return shard_nodes(group.conv_id.to_numpy(), group.side.to_numpy(), group.turns.tolist(), group.sizes.tolist()).assign(shard=group["shard"].iloc[0])

    parts = stored(dealt.groupBy("shard").applyInPandas(reduce, _NODE + ", shard long"), "trie-parts")
    key = ["depth", "k1", "k2"]
    opened = parts.where("open")
    sums = opened.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.first("p1").alias("p1"), F.first("p2").alias("p2")
    )
    stream = opened.where("ends <> ''").select(*key, "shard", "ends").repartition(*key).sortWithinPartitions(*key, "shard")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, h = None, None
        for batch in batches:
            out = []
            for *k, ends in zip(batch.depth, batch.k1, batch.k2, batch.ends, strict=True):
                if k != at:
                    if at:
                        out.append((*at, h.hexdigest()))
                    at, h = k, hashlib.sha256(ends.encode())
                else:
                    h.update(b"," + ends.encode())
            yield pd.DataFrame(out, columns=[*key, "sha"])
        if at:
            yield pd.DataFrame([(*at, h.hexdigest())], columns=[*key, "sha"])

    ended = stream.mapInPandas(digest, "depth long, k1 long, k2 long, sha string")
    whole = stored(sums.join(ended, key, "left").withColumn("ends", F.coalesce("sha", F.lit(EMPTY))).drop("sha"), "trie-open")
    parents = few(whole.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_parent")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    closed = parts.where("not open")
    settled = closed.where("not parent_open").select(*columns)
    under = closed.where("parent_open").drop("parent_conv_id").unionByName(whole, allowMissingColumns=True)
    return settled.unionByName(under.join(parents, ["depth", "p1", "p2"], "left").withColumnRenamed("_parent", "parent_conv_id").select(*columns))
