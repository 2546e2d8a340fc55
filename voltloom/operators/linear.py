"""Least squares and ridge per series from cross-product sums.

Rows are never gathered. Each task adds up X'X of the rows it reads (one small matrix per series),
the matrices are summed by cell, and only a (k+2) x (k+2) matrix per series is solved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookups import salted_lookup
from .windows import DEFAULT, Chunks

_FLUSH_AT = 512  # matrices a task holds before it hands them on
RIDGE_ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 50))


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def gram_cells(df: DataFrame, features: list[str], label: str, keys: list[str]) -> DataFrame:
    """(keys, cell, value): the upper triangle of Z'Z for Z = [1, features, label]."""
    size = len(features) + 2
    upper = np.triu_indices(size)
    schema = T.StructType([*_key_fields(df, keys), T.StructField("gram", T.ArrayType(T.DoubleType()))])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            rows = [(*key, total.tolist()) for key, total in sums.items()]
            sums.clear()
            return pd.DataFrame(rows, columns=[*keys, "gram"])

        for batch in batches:
            z = np.ones((len(batch), size))
            z[:, 1:] = batch[[*features, label]].to_numpy(dtype=float)
            for key, where in batch.groupby(keys, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                part = z[where]
                total = (part.T @ part)[upper]
                sums[key] = sums[key] + total if key in sums else total
            if len(sums) >= _FLUSH_AT:
                yield flush()
        if sums:
            yield flush()

    partials = df.select(*keys, *features, label).mapInPandas(partial, schema)
    cells = partials.select(*keys, F.posexplode("gram").alias("cell", "value"))
    return cells.groupBy(*keys, "cell").agg(F.sum("value").alias("value"))


def gram_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One array per series; its length is fixed by the number of features."""
    packed = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell", "value"))).alias("g"))
    return packed.select(*keys, F.col("g.value").alias("gram"))


def square(flat, size: int) -> np.ndarray:
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = flat
    return full + np.triu(full, 1).T


def solve_normal(gram: np.ndarray) -> np.ndarray:
    """Intercept and slopes; collinear columns share their weight (smallest norm)."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    sxx, sxy = centred[:-1, :-1], centred[:-1, -1]
    scale = np.sqrt(np.clip(np.diag(sxx), 0.0, None))
    flat = scale <= 1e-9 * np.sqrt(np.clip(np.diag(gram)[1:-1], 1e-300, None))
    scale = np.where(flat, 1.0, scale)
    corr = np.where(flat[:, None] | flat[None, :], 0.0, sxx / np.outer(scale, scale))
    slopes = np.linalg.pinv(corr, rcond=1e-10, hermitian=True) @ np.where(flat, 0.0, sxy / scale) / scale
    return np.concatenate([[mean[-1] - slopes @ mean[:-1]], slopes])


def solve_rows(grams: DataFrame, keys: list[str], n_features: int) -> DataFrame:
    """(keys, coef, rows) from one matrix per row."""
    size = n_features + 2
    schema = T.StructType(
        [
            *_key_fields(grams, keys),
            T.StructField("coef", T.ArrayType(T.DoubleType())),
            T.StructField("rows", T.LongType()),
        ]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            full = [square(g, size) for g in batch["gram"]]
            yield batch[keys].assign(
                coef=[solve_normal(g).tolist() for g in full], rows=[int(round(g[0, 0])) for g in full]
            )

    return grams.mapInPandas(solve, schema)


def fit_ols(df: DataFrame, features: list[str], label: str = "price", keys=("zone",)) -> DataFrame:
    """(keys, coef, rows): ordinary least squares per series, intercept first."""
    keys = list(keys)
    complete = df.na.drop("any", subset=[*features, label])
    return solve_rows(gram_rows(gram_cells(complete, features, label, keys), keys), keys, len(features))


def linear_value(features: list[str], coef: str = "coef") -> Column:
    """Intercept plus weighted features, as one expression."""
    total = F.element_at(coef, 1)
    for i, name in enumerate(features):
        total = total + F.element_at(coef, i + 2) * F.col(name)
    return total


def score_linear(
    df: DataFrame, coefs: DataFrame, features: list[str], keys=("zone",), out="y_pred", spread_by=("ts",)
) -> DataFrame:
    joined = salted_lookup(df, coefs.select(*keys, "coef"), list(keys), spread_by)
    return joined.withColumn(out, linear_value(features)).drop("coef")


def linear_importance(
    df: DataFrame, coefs: DataFrame, features: list[str], keys=("zone",), spread_by=("ts",)
) -> DataFrame:
    """(keys, feature, importance): mean |w (x - mean x)|, exact for a linear model."""
    keys = list(keys)
    complete = df.na.drop("any", subset=features)
    means = complete.groupBy(*keys).agg(F.array(*[F.avg(f) for f in features]).alias("_mean"))
    joined = salted_lookup(complete, means.join(coefs.select(*keys, "coef"), keys), keys, spread_by)
    parts = joined.groupBy(*keys).agg(
        *[
            F.avg(F.abs(F.element_at("coef", i + 2) * (F.col(f) - F.element_at("_mean", i + 1)))).alias(f)
            for i, f in enumerate(features)
        ]
    )
    return parts.unpivot(keys, features, "feature", "importance")


# ── every expanding fold in one pass ────────────────────────────────────────


def expanding_fits(
    df: DataFrame, features: list[str], label: str, step: str, keys=("zone",)
) -> DataFrame:
    """(keys, step, coef, rows): the fit on all rows with this or a smaller step number.

    Each row is read once, into the matrix of its own step. Fold matrices are running sums over
    the steps, per cell, so the growing training sets are never built.
    """
    keys = list(keys)
    complete = df.na.drop("any", subset=[*features, label])
    cells = gram_cells(complete, features, label, [*keys, step])
    along = Window.partitionBy(*keys, "cell").orderBy(step)
    running = cells.withColumn("value", F.sum("value").over(along))
    return solve_rows(gram_rows(running, [*keys, step]), [*keys, step], len(features))


# ── ridge ───────────────────────────────────────────────────────────────────


def fit_ridge_cv(
    df: DataFrame, features: list[str], label: str = "price", alphas=RIDGE_ALPHAS, chunks: Chunks = DEFAULT
) -> DataFrame:
    """(keys, alpha, loo_mse, coef): standardised ridge, the penalty chosen by leave-one-out error.

    Two passes. The first sums the matrices; the second gives, for every row and penalty, the exact
    error of leaving that row out, from its residual and leverage. It runs per (series, time chunk),
    each chunk meeting one copy of its series' matrix. ``coef`` applies to raw features.
    """
    keys = list(chunks.keys)
    size = len(features) + 2
    complete = df.na.drop("any", subset=[*features, label])
    grams = gram_rows(gram_cells(complete, features, label, keys), keys)
    by = [*keys, "_chunk"]
    rows = complete.withColumn("_chunk", chunks.number()).select(*by, *features, label)
    matrices = rows.select(*by).distinct().join(grams, keys)
    matrices = matrices.select(*[F.col(c).alias(c) for c in matrices.columns])  # columns of its own, for the cogroup
    schema = T.StructType(
        [*_key_fields(df, keys), T.StructField("errors", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]
    )

    def leave_one_out(key: tuple, block: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
        gram = square(matrix["gram"].iloc[0], size)
        mean, scale, lam, vec, xty, y_mean = _standard_eigen(gram)
        y = block[label].to_numpy(dtype=float) - y_mean
        z = ((block[features].to_numpy(dtype=float) - mean) / scale) @ vec
        errors = []
        for a in alphas:
            leverage = (z * z) @ (1.0 / (lam + a)) + 1.0 / gram[0, 0]
            left_out = (y - z @ (xty / (lam + a))) / (1.0 - leverage)
            errors.append(float(left_out @ left_out))
        return pd.DataFrame([(*key[:-1], errors, len(block))], columns=[*keys, "errors", "n"])

    partial = rows.groupBy(*by).cogroup(matrices.groupBy(*by)).applyInPandas(leave_one_out, schema)
    totals = (
        partial.select(*keys, "n", F.posexplode("errors").alias("i", "e"))
        .groupBy(*keys, "i")
        .agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    )
    best = totals.groupBy(*keys).agg(
        F.min_by(F.struct("i", F.try_divide(F.col("e"), F.col("n")).alias("mse")), F.struct("e", "i")).alias("b")
    )
    chosen = best.select(*keys, F.col("b.i").alias("i"), F.col("b.mse").alias("loo_mse")).join(grams, keys)
    out_schema = T.StructType(
        [
            *_key_fields(df, keys),
            T.StructField("alpha", T.DoubleType()),
            T.StructField("loo_mse", T.DoubleType()),
            T.StructField("coef", T.ArrayType(T.DoubleType())),
        ]
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coefs = []
            for i, flat in zip(batch["i"], batch["gram"]):
                mean, scale, lam, vec, xty, y_mean = _standard_eigen(square(flat, size))
                slopes = vec @ (xty / (lam + alphas[i])) / scale
                coefs.append([float(y_mean - slopes @ mean), *slopes.tolist()])
            yield batch[keys].assign(alpha=[alphas[i] for i in batch["i"]], loo_mse=batch["loo_mse"], coef=coefs)

    return chosen.mapInPandas(finish, out_schema)


def _standard_eigen(gram: np.ndarray):
    """Means, deviations, and the eigenvalues, eigenvectors and rotated X'y of the scaled X'X."""
    n = gram[0, 0]
    mean, y_mean = gram[0, 1:-1] / n, gram[0, -1] / n
    sxx = gram[1:-1, 1:-1] - n * np.outer(mean, mean)
    sxy = gram[1:-1, -1] - n * mean * y_mean
    scale = np.sqrt(np.clip(np.diag(sxx) / n, 0.0, None))
    scale = np.where(scale <= 1e-9 * np.maximum(np.abs(mean), 1e-12), 1.0, scale)
    lam, vec = np.linalg.eigh(sxx / np.outer(scale, scale))
    return mean, scale, np.clip(lam, 0.0, None), vec, vec.T @ (sxy / scale), y_mean
