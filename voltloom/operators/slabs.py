"""Boosted trees grown in slabs of rounds, all folds together, until patience runs out.

Rows become blocks of binned inputs once. A level of a round is one pass over the blocks for all folds that still grow: tasks add
up residuals per (fold, node, input, bin), the sums of a (fold, node) meet in one task as a stream, and only its best split
reaches the driver. Within a slab the predictions of a row are those stored with its block and the slab's few trees; after a slab
they are stored anew, every fold is scored on its own later rows for each of the slab's rounds, and a fold whose loss has not
improved for ``patience`` rounds grows no further. So no pass depends on how many rounds there were before.

Splits minimise squared error with L1 and L2 penalties on the leaves; rows and inputs are drawn anew for each tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, ship
from .boosting import BoostConfig, best_round
from .windows import DEFAULT, Chunks, positions

#: Rows of a block, cut points of an input at most, rounds of a slab, folds that grow together.
BLOCK_ROWS, CUTS, SLAB, TOGETHER = 8192, 63, 10, 16
# Default penalties on leaf weights.
ALPHA, LAMBDA = 0.1, 1.0
_BLOCK = "block long, x binary, y binary, pos binary, total binary, past binary"
_SPLIT = "fold int, node int, feature int, bin int, gain double, left_sum double, left_rows double, sum double, rows double"


@dataclass
class Tree:
    """Heap-ordered nodes; ``feature`` -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of binned inputs ends in."""
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            f = self.feature[node[rows]]
            rows, f = rows[f >= 0], f[f >= 0]
            node[rows] = 2 * node[rows] + 1 + (x[rows, f] > self.bin[node[rows]])
        return node

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.place(x)]


@dataclass
class Fold:
    """Rows before ``train_end`` (and before the held-out end of their series) train; the next ``val_rows`` ones score."""

    train_end: int | None
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    val_rows: int = 0
    growing: bool = True


@dataclass
class GrownModel:
    """``cuts`` are by input; a value up to the first cut is in bin 0."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]

    def bins(self, values: np.ndarray) -> np.ndarray:
        return binned(values, self.cuts)

    def predict(self, values: np.ndarray) -> np.ndarray:
        x = self.bins(values)
        return self.base + sum((t(x) for t in self.trees), np.zeros(len(x)))

    def score(self, df: DataFrame) -> DataFrame:
        """``y_pred`` for every row; null where an input is missing."""
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def predict(inputs: pd.DataFrame) -> pd.Series:
            v = inputs.to_numpy(np.float64)
            out = np.full(len(v), np.nan)
            whole = ~np.isnan(v).any(1)
            out[whole] = shared.value.predict(v[whole])
            return pd.Series(out)

        found = predict(F.struct(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(self.features)]))
        return df.withColumn("y_pred", found).withColumn("y_pred", F.when(~F.isnan("y_pred"), F.col("y_pred")))


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, values[:, i], "left") for i, c in enumerate(cuts)], 1).astype(np.uint8)


def cut_points(rows: DataFrame, features: list[str], most: int = CUTS) -> list[np.ndarray]:
    """At most ``most`` ascending cuts of each input: all its values but the last if they are few, else quantiles.

    The cuts only decide where a split may be. Two passes over stored rows.
    """
    names = [f"c{i}" for i in range(len(features))]
    rows = rows.select(*[F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, names, strict=True)])
    few = rows.agg(*[F.approx_count_distinct(n).alias(n) for n in names]).first()
    small = [n for n in names if few[n] <= most // 2]
    exact = rows.agg(*[F.sort_array(F.collect_set(n)).alias(n) for n in small]).first().asDict() if small else {}
    large = [n for n in names if n not in exact]
    marks = [i / (most + 1) for i in range(1, most + 1)]
    found = dict(zip(large, rows.approxQuantile(large, marks, 1 / (4 * most)), strict=True)) if large else {}
    return [np.array(exact[n][:-1] if n in exact else sorted(set(found[n])), np.float64) for n in names]


def to_blocks(rows: DataFrame, features: list[str], label: str, cuts: list[np.ndarray]) -> DataFrame:
    """Blocks of binned complete rows with their place and the length of their series; stored."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(cuts)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                some = batch.iloc[at : at + BLOCK_ROWS]
                x = binned(some.iloc[:, 3:].to_numpy(np.float64), shared.value)
                yield pd.DataFrame({
                    "x": [x.tobytes()], "y": [some.y.to_numpy(np.float64).tobytes()], "pos": [some["pos"].to_numpy(np.int64).tobytes()],
                    "total": [some.total.to_numpy(np.int64).tobytes()], "past": [b""],
                })

    inputs = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    packed = rows.select(F.col(f"`{label}`").cast("double").alias("y"), F.col("_pos").alias("pos"), F.col("_total").alias("total"), *inputs)
    packed = packed.mapInPandas(pack, _BLOCK.removeprefix("block long, "))
    return checkpoint(packed.select(F.monotonically_increasing_id().alias("block"), "*"))


class Grower:
    """Grows the trees of some folds over the same blocks."""

    def __init__(self, blocks: DataFrame, width: int, config: BoostConfig, alpha: float = ALPHA, penalty: float = LAMBDA, slab: int = SLAB):
        self.blocks, self.width, self.config = blocks, width, config
        self.alpha, self.penalty, self.slab = alpha, penalty, slab

    # ── inside tasks ──

    def rows(self, block, folds: list[Fold], number: int):
        """(binned inputs, labels, training rows, scoring rows) of a block for one fold."""
        x = np.frombuffer(block.x, np.uint8).reshape(-1, self.width)
        y, pos, total = np.frombuffer(block.y), np.frombuffer(block.pos, np.int64), np.frombuffer(block.total, np.int64)
        limit = total - np.maximum((total * self.config.eval_fraction).astype(np.int64), self.config.val_size)
        end = folds[number].train_end
        if end is None:  # the final fit: everything before the held-out end, scored on it
            return x, y, pos < limit, pos >= limit
        inside = pos < limit
        return x, y, inside & (pos < end), inside & (pos >= end) & (pos < end + self.config.val_size)

    @staticmethod
    def past(block, folds: list[Fold], number: int, n: int) -> np.ndarray:
        """The stored predictions of one fold; before the first slab its base."""
        return np.frombuffer(block.past).reshape(len(folds), n)[number] if block.past else np.full(n, folds[number].base)

    def sums(self, blocks: Iterator, folds: list[Fold], slabs: list[list[Tree]], trees: list[Tree], level: int, draw: int) -> Iterator[tuple]:
        """(fold, node, sums, counts) of the nodes of a level, over all blocks of a task."""
        first, many = (1 << level) - 1, 1 << level
        size = self.width * (CUTS + 1)
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for block in blocks:
            for k, fold in enumerate(folds):
                if not fold.growing:
                    continue
                x, y, train, _ = self.rows(block, folds, k)
                rng = np.random.default_rng([self.config.seed, draw, k, block.block & 0xFFFFFFFF, block.block >> 32])
                rows = np.flatnonzero(train & (rng.random(len(y)) < self.config.subsample))
                x = x[rows]
                left = (y - self.past(block, folds, k, len(y)))[rows] - sum((t(x) for t in slabs[k]), np.zeros(len(rows)))
                node = trees[k].place(x) - first
                here = node >= 0
                x, left, node = x[here], left[here], node[here]
                cell = ((node[:, None] * self.width + np.arange(self.width)) * (CUTS + 1) + x).ravel()
                s, c = out.get(k) or (np.zeros(many * size), np.zeros(many * size))
                s += np.bincount(cell, np.repeat(left, self.width), many * size)
                c += np.bincount(cell, minlength=many * size)
                out[k] = s, c
        for k, (s, c) in out.items():
            for node in np.flatnonzero(c.reshape(many, size).any(1)).tolist():
                at = slice(node * size, (node + 1) * size)
                yield k, first + node, s[at].tobytes(), c[at].tobytes()

    def threshold(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.alpha, 0)

    def best(self, s: np.ndarray, c: np.ndarray, inputs: np.ndarray) -> tuple:
        """(input, bin, gain, left sum, left rows, sum, rows) of the best split among the inputs; input -1 if none is worth it."""
        s, c = s.reshape(self.width, -1), c.reshape(self.width, -1)
        total, rows = float(s[0].sum()), float(c[0].sum())
        left, below = np.cumsum(s, 1)[:, :-1], np.cumsum(c, 1)[:, :-1]
        worth = lambda g, h: self.threshold(g) ** 2 / (h + self.penalty)
        gain = worth(left, below) + worth(total - left, rows - below) - worth(np.array(total), rows)
        least = self.config.min_child_weight
        gain[(below < least) | (rows - below < least)] = -np.inf
        gain[~np.isin(np.arange(self.width), inputs)] = -np.inf
        f, b = divmod(int(gain.argmax()), gain.shape[1])
        if not gain[f, b] > 1e-9:
            return -1, 0, 0.0, 0.0, 0.0, total, rows
        return f, b, float(gain[f, b]), float(left[f, b]), float(below[f, b]), total, rows

    def leaf(self, g: float, h: float) -> float:
        return float(self.config.learning_rate * self.threshold(np.array(g)) / (h + self.penalty)) if h else 0.0

    # ── passes ──

    def splits(self, folds: list[Fold], slabs: list[list[Tree]], trees: list[Tree], level: int, draw: int, inputs: list[np.ndarray]) -> list:
        shared = self.blocks.sparkSession.sparkContext.broadcast((folds_only(folds), slabs, trees, inputs))
        grower = self.plain()

        def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            folds, slabs, trees, _ = shared.value
            found = list(grower.sums((b for batch in batches for b in batch.itertuples()), folds, slabs, trees, level, draw))
            yield pd.DataFrame(found, columns=["fold", "node", "s", "c"]).astype({"fold": "int32", "node": "int32"})

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            inputs = shared.value[3]
            key, s, c, out = None, 0.0, 0.0, []
            for batch in batches:
                for r in batch.itertuples():
                    if key not in (None, (r.fold, r.node)):
                        out.append((*key, *grower.best(s, c, inputs[key[0]])))
                        s, c = 0.0, 0.0
                    key = r.fold, r.node
                    s, c = s + np.frombuffer(r.s), c + np.frombuffer(r.c)
            if key:
                out.append((*key, *grower.best(s, c, inputs[key[0]])))
            yield pd.DataFrame(out, columns=[p.split()[0] for p in _SPLIT.split(", ")])

        sums = self.blocks.mapInPandas(add_up, "fold int, node int, s binary, c binary")
        return sums.repartition("fold", "node").sortWithinPartitions("fold", "node").mapInPandas(choose, _SPLIT).collect()

    def plain(self) -> Grower:
        """Without the blocks, for tasks."""
        return Grower(None, self.width, self.config, self.alpha, self.penalty, self.slab)

    def tree(self, folds: list[Fold], slabs: list[list[Tree]], draw: int) -> list[Tree]:
        """The next tree of each fold."""
        depth = self.config.max_depth
        trees = [Tree.of_depth(depth) for _ in folds]
        rng = np.random.default_rng([self.config.seed, draw])
        share = max(1, round(self.config.colsample * self.width))
        inputs = [np.sort(rng.choice(self.width, share, replace=False)) for _ in folds]
        for level in range(depth):
            # Only nodes that the level before split off are still open.
            open_ = False
            for r in self.splits(folds, slabs, trees, level, draw, inputs):
                t = trees[r.fold]
                t.value[r.node] = self.leaf(r["sum"], r.rows)
                if r.feature >= 0:
                    t.feature[r.node], t.bin[r.node] = r.feature, r.bin
                    t.value[2 * r.node + 1] = self.leaf(r.left_sum, r.left_rows)
                    t.value[2 * r.node + 2] = self.leaf(r["sum"] - r.left_sum, r.rows - r.left_rows)
                    open_ = True
            if not open_:
                break
        return trees

    def scored(self, folds: list[Fold], slabs: list[list[Tree]]) -> dict[tuple[int, int], tuple[float, int]]:
        """(squared error, rows) by fold and round of the slab, over the fold's scoring rows; round 0 is before the slab."""
        shared = self.blocks.sparkSession.sparkContext.broadcast((folds_only(folds), slabs))
        grower = self.plain()

        def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            folds, slabs = shared.value
            out = []
            for batch in batches:
                for block in batch.itertuples():
                    for k, fold in enumerate(folds):
                        x, y, _, val = grower.rows(block, folds, k)
                        if not fold.growing or not val.any():
                            continue
                        rest, x = (y - grower.past(block, folds, k, len(y)))[val], x[val]
                        out.append((k, 0, float(rest @ rest), len(rest)))
                        for i, t in enumerate(slabs[k]):
                            rest = rest - t(x)
                            out.append((k, i + 1, float(rest @ rest), len(rest)))
            yield pd.DataFrame(out, columns=["fold", "round", "error", "rows"]).astype({"fold": "int32", "round": "int32"})

        sums = self.blocks.mapInPandas(errors, "fold int, round int, error double, rows long").groupBy("fold", "round")
        return {(r.fold, r["round"]): (r.error, r.rows) for r in sums.agg(F.sum("error").alias("error"), F.sum("rows").alias("rows")).collect()}

    def stored(self, folds: list[Fold], slabs: list[list[Tree]]) -> DataFrame:
        """The blocks with predictions that include the slab."""
        shared = self.blocks.sparkSession.sparkContext.broadcast((folds_only(folds), slabs))
        grower = self.plain()

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            folds, slabs = shared.value
            for batch in batches:
                past = []
                for block in batch.itertuples():
                    x, y, _, _ = grower.rows(block, folds, 0)
                    past.append(np.stack([grower.past(block, folds, k, len(y)) + sum((t(x) for t in slabs[k]), np.zeros(len(y))) for k in range(len(folds))]).tobytes())
                yield batch.assign(past=past)

        return checkpoint(self.blocks.mapInPandas(add, _BLOCK))

    def start(self, folds: list[Fold]) -> None:
        """Each fold begins with the mean of its training labels; a fold without any does not grow."""
        shared = self.blocks.sparkSession.sparkContext.broadcast(folds_only(folds))
        grower = self.plain()

        def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = []
            for batch in batches:
                for block in batch.itertuples():
                    for k in range(len(shared.value)):
                        _, y, train, val = grower.rows(block, shared.value, k)
                        out.append((k, float(y[train].sum()), int(train.sum()), int(val.sum())))
            yield pd.DataFrame(out, columns=["fold", "s", "n", "v"])

        sums = self.blocks.mapInPandas(labels, "fold int, s double, n long, v long").groupBy("fold").agg(*[F.sum(c).alias(c) for c in "snv"])
        for f in folds:
            f.growing = False
        for r in sums.collect():
            f = folds[r.fold]
            f.base, f.val_rows, f.growing = r.s / max(1, r.n), r.v, r.n > 0

    def grow(self, folds: list[Fold], rounds: int, patience: int | None) -> list[Fold]:
        """Grow until ``rounds``, or until every fold is out of patience."""
        self.start(folds)
        first = self.blocks
        for at in range(0, rounds, self.slab):
            growing = [f for f in folds if f.growing]
            if not growing:
                break
            slabs: list[list[Tree]] = [[] for _ in folds]
            for i in range(at, min(rounds, at + self.slab)):
                for k, t in enumerate(self.tree(folds, slabs, i)):
                    if folds[k].growing:
                        slabs[k].append(t)
            if patience is not None:
                found = self.scored(folds, slabs)
                for k, f in enumerate(folds):
                    if f.growing:
                        f.losses += [found[k, i + 1][0] / found[k, i + 1][1] if (k, i + 1) in found else float("nan") for i in range(len(slabs[k]))]
            for k, f in enumerate(folds):
                f.trees += slabs[k]
            if patience is not None:
                for f in folds:
                    f.growing = f.growing and bool(f.val_rows) and len(f.losses) - 1 - best_round(f.losses, patience) < patience
            if at + self.slab < rounds and any(f.growing for f in folds):
                self.blocks = self.stored(folds, slabs)
        self.blocks = first
        return folds


def folds_only(folds: list[Fold]) -> list[Fold]:
    """What tasks need to know of the folds: not the trees of earlier slabs, whose predictions are stored."""
    return [Fold(f.train_end, f.base, growing=f.growing) for f in folds]


@dataclass
class Tuned:
    """``folds``: one row per fold; ``rounds`` of the final ``model``, fitted on all but the held-out end of each series; ``held``:
    the rows of that end with their ``y_pred``."""

    folds: DataFrame
    rounds: int
    model: GrownModel
    held: DataFrame


def tune_and_fit(
    df: DataFrame, features: list[str], config: BoostConfig = BoostConfig(), label: str = "price", chunks: Chunks = DEFAULT,
    cuts: list[np.ndarray] | None = None, slab: int = SLAB, together: int = TOGETHER,
) -> Tuned:
    """Expanding folds grown until patience runs out, then the final fit with the mean best round and ``spare_rounds`` more.

    Folds are cut by row number within a series; all series take part in every fold. Rows with a missing input or label are left
    out. Folds with fewer than ``min_val_rows`` scoring rows are not used; without any fold it fails.
    """
    complete = df.select(*chunks.keys, chunks.ts, *features, label).na.drop("any")
    rows = checkpoint(positions(complete, chunks, "_pos", "_total"))
    cuts = cuts or cut_points(rows, features)
    blocks = to_blocks(rows, features, label, cuts)
    total = rows.agg(F.max("_total")).first()[0] or 0
    limit = total - max(int(total * config.eval_fraction), config.val_size)
    starts = list(range(config.min_train_size, limit, config.step))
    folds: list[Fold] = []
    for at in range(0, len(starts), together):
        folds += Grower(blocks, len(features), config, slab=slab).grow([Fold(s) for s in starts[at : at + together]], config.n_estimators, config.patience)
    found = []
    for number, f in enumerate(folds):
        if f.val_rows >= config.min_val_rows and f.losses:
            best = best_round(f.losses, config.patience)
            found.append((number, f.train_end, f.val_rows, best, len(f.trees), float(f.losses[best])))
    if not found:
        raise ValueError("no training folds: more rows are needed")
    rounds = int(sum(f[3] for f in found) / len(found)) + config.spare_rounds
    final = Grower(blocks, len(features), config, slab=slab).grow([Fold(None)], rounds, None)[0]
    schema = "fold int, train_end int, val_rows int, best_round int, rounds_grown int, loss double"
    model = GrownModel(list(features), cuts, final.base, final.trees)
    held = F.greatest(F.floor(F.col("_total") * config.eval_fraction), F.lit(config.val_size))
    ends = model.score(rows.where(F.col("_pos") >= F.col("_total") - held)).select(*chunks.keys, chunks.ts, label, "y_pred")
    return Tuned(df.sparkSession.createDataFrame(found, schema), rounds, model, ends)


def fit_rounds(
    df: DataFrame, features: list[str], config: BoostConfig, rounds: int, label: str = "price", cuts: list[np.ndarray] | None = None
) -> GrownModel:
    """A model of so many rounds on all complete rows."""
    rows = df.select(*features, label).na.drop("any").withColumns({"_pos": F.lit(-1).cast("bigint"), "_total": F.lit(1 << 40).cast("bigint")})
    rows = checkpoint(rows)
    cuts = cuts or cut_points(rows, features)
    final = Grower(to_blocks(rows, features, label, cuts), len(features), config).grow([Fold(None)], rounds, None)[0]
    return GrownModel(list(features), cuts, final.base, final.trees)
