"""Time-series statistics: autocorrelation, unit root, stationarity, normality.

Row-level work is cross-products of a chunk with its lagged self, done in numpy inside tasks on
chunks of fixed size; only sums per lag or per matrix cell are shuffled further.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import gram_rows, square
from .lookups import salted_lookup
from .windows import DEFAULT, Chunks, positions, spread

# Published tables of the unit-root and stationarity tests (constant, no trend).
ADF_TAU_RANGE = (-18.83, 2.74)
ADF_TAU_SWITCH = -1.61
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.04),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def _lag_rows(keys: list[str], df: DataFrame) -> T.StructType:
    return T.StructType(
        [
            *[df.schema[k] for k in keys],
            T.StructField("lag", T.IntegerType()),
            *[T.StructField(c, T.DoubleType()) for c in ("products", "late", "early")],
            T.StructField("pairs", T.LongType()),
        ]
    )


def lag_sums(df: DataFrame, value: str, max_lag: int, chunks: Chunks = DEFAULT) -> DataFrame:
    """(keys, lag, products, late, early, pairs): sums of x(t) x(t-lag), x(t), x(t-lag) over all pairs
    with both values present, for lags 0..max_lag."""
    keys = list(chunks.keys)
    size = chunks.size
    rows = df.select(*keys, chunks.slot().alias("_slot"), F.col(value).cast("double").alias("_x"))
    by_slot = Chunks(chunks.keys, ts="_slot", size=size, index="_slot")

    def per_chunk(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        chunk = int(key[-1])
        place = block["_slot"].to_numpy() - (chunk * size - max_lag)
        x = np.full(size + max_lag, np.nan)
        x[place] = block["_x"].to_numpy()
        known = ~np.isnan(x)
        filled = np.where(known, x, 0.0)
        now, now_known = filled[max_lag:], known[max_lag:]
        out = []
        for lag in range(max_lag + 1):
            then = slice(max_lag - lag, max_lag - lag + size)
            both = now_known & known[then]
            pairs = int(both.sum())
            if pairs:
                out.append((*key[:-1], lag, float(now @ filled[then]), float(now[both].sum()),
                            float(filled[then][both].sum()), pairs))
        return pd.DataFrame(out, columns=[*keys, "lag", "products", "late", "early", "pairs"])

    partial = spread(rows, max_lag, by_slot).groupBy(*keys, "_chunk").applyInPandas(per_chunk, _lag_rows(keys, df))
    return partial.groupBy(*keys, "lag").agg(*[F.sum(c).alias(c) for c in ("products", "late", "early", "pairs")])


def _centred(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Add n, and ``cross``: the sum of products of deviations from the series mean.

    At most max_lag + 1 rows per series meet in a window here.
    """
    series = Window.partitionBy(*keys)
    at_zero = lambda c: F.max(F.when(F.col("lag") == 0, F.col(c))).over(series)
    out = sums.withColumns({"n": at_zero("pairs"), "_sum": at_zero("late")})
    mean = F.col("_sum") / F.col("n")
    cross = F.col("products") - mean * (F.col("late") + F.col("early")) + F.col("pairs") * mean * mean
    return out.withColumn("cross", cross).drop("_sum")


def acf(df: DataFrame, value: str, max_lag: int = 400, chunks: Chunks = DEFAULT) -> DataFrame:
    """(keys, lag, acf): autocorrelation with denominator n."""
    keys = list(chunks.keys)
    sums = _centred(lag_sums(df, value, max_lag, chunks), keys)
    variance = F.max(F.when(F.col("lag") == 0, F.col("cross"))).over(Window.partitionBy(*keys))
    return sums.select(*keys, "lag", F.try_divide(F.col("cross"), variance).alias("acf"))


def pacf(df: DataFrame, value: str, max_lag: int = 72, chunks: Chunks = DEFAULT) -> DataFrame:
    """(keys, lag, pacf): partial autocorrelation by the Yule-Walker equations, from max_lag + 1 numbers per series."""
    keys = list(chunks.keys)
    r = acf(df, value, max_lag, chunks)
    schema = T.StructType(
        [*[df.schema[k] for k in keys], T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())]
    )

    def solve(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        rho = block.sort_values("lag")["acf"].to_numpy()
        out, coef, left = [1.0], np.zeros(0), 1.0
        for k in range(1, len(rho)):
            last = (rho[k] - coef @ rho[k - 1 : 0 : -1]) / left
            coef = np.concatenate([coef - last * coef[::-1], [last]])
            left *= 1.0 - last * last
            out.append(last)
        return pd.DataFrame([(*key, lag, float(v)) for lag, v in enumerate(out)], columns=[*keys, "lag", "pacf"])

    return r.groupBy(*keys).applyInPandas(solve, schema)


# ── unit root ───────────────────────────────────────────────────────────────


def adf_max_lag(n: int) -> int:
    return min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25))


def adf_p_value(stat: float) -> float:
    low, high = ADF_TAU_RANGE
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    terms = ADF_SMALL_P if stat <= ADF_TAU_SWITCH else ADF_LARGE_P
    z = sum(c * stat**i for i, c in enumerate(terms))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def adf_design(x: np.ndarray, lags: int) -> np.ndarray:
    """Rows [1, x(t-1), dx(t-1), …, dx(t-lags), dx(t)] for t = lags+1 … len(x)-1."""
    d = np.diff(x)
    n = len(x) - 1 - lags
    columns = [np.ones(n), x[lags : lags + n]] + [d[lags - i : lags - i + n] for i in range(1, lags + 1)] + [d[lags:]]
    return np.column_stack(columns)


def _regress(gram: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, inverse matrix and residual sum for the first ``size`` regressors."""
    scale = np.sqrt(np.diag(gram)[:size])
    inverse = np.linalg.pinv(gram[:size, :size] / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    xy = gram[:size, -1]
    coef = inverse @ xy
    return coef, inverse, max(float(gram[-1, -1] - coef @ xy), 0.0)


def adf_from_gram(gram: np.ndarray, head: np.ndarray, max_lag: int) -> tuple[float, float, int, int]:
    """Statistic, p-value, lags used and observations.

    ``gram`` covers the rows every lag order shares. The best order by AIC is then refitted on all
    the rows it can use: those of ``gram`` plus the few at the head of the series.
    """
    n = gram[0, 0]
    aic = []
    for lags in range(max_lag + 1):
        left = _regress(gram, lags + 2)[2]
        aic.append(n * (math.log(2 * math.pi) + math.log(max(left, 1e-300) / n) + 1) + 2 * (lags + 2))
    used = int(np.argmin(aic))
    keep = [*range(used + 2), len(gram) - 1]
    early = adf_design(head[: max_lag + 1], used)
    full = gram[np.ix_(keep, keep)] + early.T @ early
    coef, inverse, left = _regress(full, used + 2)
    rows = int(round(full[0, 0]))
    spread_of_level = math.sqrt(left / (rows - (used + 2)) * inverse[1, 1])
    stat = float(coef[1] / spread_of_level)
    return stat, adf_p_value(stat), used, rows


def adf(df: DataFrame, value: str, chunks: Chunks = DEFAULT) -> DataFrame:
    """(keys, statistic, p_value, lags_used, observations, crit_1, crit_5, crit_10).

    Unit-root test with constant; the lag order is chosen by AIC. Nulls are dropped first.
    """
    keys = list(chunks.keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, chunks.ts, F.col(value).cast("double").alias("_x"))
    rows = positions(present, chunks, "_pos", "_total").select(*keys, "_pos", "_total", "_x")
    longest = present.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    widest = max(adf_max_lag(longest), 0)  # the rule grows with the rows, so no series needs more
    by_pos = Chunks(chunks.keys, ts="_pos", size=chunks.size, index="_pos")
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("gram", T.ArrayType(T.DoubleType()))])

    def per_chunk(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_pos")
        lags = adf_max_lag(int(block["_total"].iloc[0]))
        start = max(int(key[-1]) * chunks.size - lags - 1, 0)
        x = block["_x"].to_numpy()[(block["_pos"] >= start).to_numpy()]
        if lags < 0 or len(x) < lags + 2:
            return pd.DataFrame(columns=[*keys, "gram"])
        z = adf_design(x, lags)
        total = (z.T @ z)[np.triu_indices(lags + 3)]
        return pd.DataFrame([(*key[:-1], total.tolist())], columns=[*keys, "gram"])

    partial = spread(rows, widest + 1, by_pos).groupBy(*keys, "_chunk").applyInPandas(per_chunk, schema)
    cells = partial.select(*keys, F.posexplode("gram").alias("cell", "value"))
    grams = gram_rows(cells.groupBy(*keys, "cell").agg(F.sum("value").alias("value")), keys)
    heads = (
        rows.where(F.col("_pos") <= widest)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_x"))).alias("h"), F.max("_total").alias("n"))
        .select(*keys, F.col("h._x").alias("head"), "n")
    )
    out_schema = T.StructType(
        [
            *[df.schema[k] for k in keys],
            T.StructField("statistic", T.DoubleType()),
            T.StructField("p_value", T.DoubleType()),
            T.StructField("lags_used", T.IntegerType()),
            T.StructField("observations", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in ADF_CRITICAL],
        ]
    )

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                lags = adf_max_lag(int(row.n))
                found = adf_from_gram(square(row.gram, lags + 3), np.asarray(row.head), lags)
                critical = [sum(c / found[3] ** i for i, c in enumerate(cs)) for cs in ADF_CRITICAL.values()]
                out.append((*[getattr(row, k) for k in keys], *found, *critical))
            yield pd.DataFrame(out, columns=out_schema.names)

    return grams.join(heads, keys).mapInPandas(finish, out_schema)


# ── stationarity ────────────────────────────────────────────────────────────


def kpss(df: DataFrame, value: str, chunks: Chunks = DEFAULT) -> DataFrame:
    """(keys, statistic, p_value, lags_used, rows): level stationarity, the lag window chosen from the data.

    Running sums are taken in two levels, per chunk and over the chunks of a series.
    """
    keys = list(chunks.keys)
    present = df.where(F.col(value).isNotNull()).select(*keys, chunks.ts, F.col(value).cast("double").alias("_x"))
    rows = positions(present, chunks, "_pos").select(*keys, "_pos", "_x")
    by_pos = Chunks(chunks.keys, ts="_pos", size=chunks.size, index="_pos")
    longest = present.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1

    n = F.col("n").cast("double")
    first_lags = F.floor(F.pow(n, F.lit(2.0 / 9.0)))
    short = _centred(lag_sums(rows, "_x", int(longest ** (2.0 / 9.0)), by_pos), keys)
    product = F.col("cross") / (n / 2.0)
    counted = (F.col("lag") >= 1) & (F.col("lag") <= first_lags)
    picked = short.groupBy(*keys, "n").agg(
        (F.sum(F.when(F.col("lag") == 0, F.col("cross") / n).when(counted, product))).alias("_s0"),
        F.coalesce(F.sum(F.when(counted, product * F.col("lag"))), F.lit(0.0)).alias("_s1"),
    )
    ratio = F.try_divide(F.col("_s1"), F.col("_s0"))
    auto = F.floor(F.pow(ratio * ratio, F.lit(1.0 / 3.0)) * 1.1447 * F.pow(n, F.lit(1.0 / 3.0)))
    windows = picked.select(*keys, F.least(auto, F.col("n") - 1).cast("int").alias("lags_used"))
    widest = windows.agg(F.max("lags_used")).first()[0] or 0

    full = _centred(lag_sums(rows, "_x", int(widest), by_pos), keys).join(windows, keys)
    weight = F.lit(2.0) * (1.0 - F.col("lag") / (F.col("lags_used") + 1.0))
    long_run = full.groupBy(*keys, "n", "lags_used").agg(
        (F.sum(F.when(F.col("lag") == 0, F.col("cross")).when(F.col("lag") <= F.col("lags_used"), F.col("cross") * weight))
         / F.max(n)).alias("_variance")
    )

    means = rows.groupBy(*keys).agg(F.avg("_x").alias("_mean"))
    centred = salted_lookup(rows, means, keys, ("_pos",)).select(
        *keys, "_pos", (F.col("_x") - F.col("_mean")).alias("_e"), F.floor(F.col("_pos") / chunks.size).alias("_chunk")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    per_chunk = (
        centred.withColumn("_c", F.sum("_e").over(inside))
        .groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_m"), F.sum("_c").alias("_c1"), F.sum(F.col("_c") * F.col("_c")).alias("_c2"),
             F.sum("_e").alias("_all"))
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("_all").over(before), F.lit(0.0))
    squares = per_chunk.withColumn("_off", off).groupBy(*keys).agg(
        F.sum(F.col("_m") * F.col("_off") * F.col("_off") + 2.0 * F.col("_off") * F.col("_c1") + F.col("_c2")).alias("_ss")
    )
    stat = F.try_divide(F.col("_ss") / (n * n), F.col("_variance"))
    joined = squares.join(long_run, keys).select(*keys, stat.alias("statistic"), "lags_used", F.col("n").alias("rows"))
    return joined.withColumn("p_value", kpss_p_value(F.col("statistic")))


def kpss_p_value(stat):
    """Between the table's points by straight lines, held at its ends."""
    p = F.when(stat <= KPSS_CRITICAL[0], F.lit(KPSS_P[0]))
    for (a, pa), (b, pb) in zip(zip(KPSS_CRITICAL, KPSS_P), list(zip(KPSS_CRITICAL, KPSS_P))[1:]):
        p = p.when(stat <= b, F.lit(pa) + (stat - a) * ((pb - pa) / (b - a)))
    return p.when(stat.isNotNull(), F.lit(KPSS_P[-1]))


# ── normality ───────────────────────────────────────────────────────────────


def normality(df: DataFrame, value: str, keys=("zone",)) -> DataFrame:
    """(keys, rows, skewness, kurtosis, statistic, p_value): Jarque-Bera test, one aggregate."""
    c = F.col(value)
    parts = df.groupBy(*keys).agg(
        F.count(c).alias("rows"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis")
    )
    jb = F.col("rows") / 6.0 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4.0)
    return parts.withColumn("statistic", jb).withColumn("p_value", F.exp(-F.col("statistic") / 2.0))


def ks_normality(df: DataFrame, value: str) -> DataFrame:
    """One row: distance of the whole column from the normal law with its own mean and deviation."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    present = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    mean, std = present.agg(F.avg("x"), F.stddev_samp("x")).first()
    return KolmogorovSmirnovTest.test(present, "x", "norm", float(mean), float(std)).select(
        F.col("pValue").alias("p_value"), "statistic"
    )
