"""Baseline forecasters and their comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from . import linear
from .grid import future_index
from .lookups import salted_lookup, seasonal_lookup, seasonal_means
from .reshape import INDICATORS, indicator_columns, last_rows, split_by_position
from .windows import DEFAULT, Chunks, full_window, over_chunks, positions, time_lag_join

LINEAR_LAGS = (24, 48, 168)
LINEAR_WINDOWS = (24, 168)


def persistence_tail(df: DataFrame, n_ahead: int = 24, value="price", chunks: Chunks = DEFAULT) -> DataFrame:
    """(keys, origin, horizon, ts, y_pred): the last n values become the next n; null if too few."""
    keys = list(chunks.keys)
    tail = last_rows(df.select(*keys, chunks.ts, value), n_ahead, chunks).select(
        *keys, (F.lit(n_ahead + 1) - F.col("from_end")).alias("horizon"), F.col(value).alias("y_pred")
    )
    enough = tail.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ends = df.groupBy(*keys).agg(F.max(chunks.ts).alias(chunks.ts))
    ahead = future_index(ends, n_ahead, chunks.ts).join(enough, keys, "left")
    joined = ahead.join(tail, [*keys, "horizon"], "left")
    return joined.withColumn("y_pred", F.when(F.col("_n") == n_ahead, F.col("y_pred"))).select(
        *keys, "origin", "horizon", chunks.ts, "y_pred"
    )


def persistence_lag(df: DataFrame, value="price", hours: int = 24, keys=("zone",)) -> DataFrame:
    """Forecast = the value ``hours`` earlier."""
    return time_lag_join(df, value, hours, "y_pred", keys)


def recent_hourly_means(df: DataFrame, weeks: int = 4, value="price", chunks: Chunks = DEFAULT) -> DataFrame:
    """(keys, hour, y_pred): hour-of-day means over the last 24 * weeks rows; null if there are fewer."""
    keys = list(chunks.keys)
    n = 24 * weeks
    recent = last_rows(df.select(*keys, chunks.ts, value), n, chunks)
    sums = recent.groupBy(*keys, F.hour(chunks.ts).alias("hour")).agg(F.avg(value).alias("_m"))
    sizes = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sums.join(sizes, keys).select(*keys, "hour", F.when(F.col("_n") == n, F.col("_m")).alias("y_pred"))


def historical_hourly(df: DataFrame, weeks: int = 4, horizon: int = 24, value="price", chunks: Chunks = DEFAULT):
    """The hourly means as the next ``horizon`` hours, each matched on its own hour of day."""
    keys = list(chunks.keys)
    ends = df.groupBy(*keys).agg(F.max(chunks.ts).alias(chunks.ts))
    ahead = future_index(ends, horizon, chunks.ts).withColumn("hour", F.hour(chunks.ts))
    means = recent_hourly_means(df, weeks, value, chunks)
    return ahead.join(means, [*keys, "hour"], "left").select(*keys, "origin", "horizon", chunks.ts, "y_pred")


def seasonal_forecast(
    train: DataFrame, target: DataFrame, value="price", weeks: int | None = None, keys=("zone",), ts="ts"
) -> DataFrame:
    """Attach the training mean of the same weekday and hour; ``weeks`` limits how far back it looks."""
    if weeks is not None:
        ends = train.groupBy(*keys).agg(F.max(ts).alias("_end"))
        train = salted_lookup(train, ends, list(keys), (ts,))
        train = train.where(F.col(ts) > F.col("_end") - F.expr(f"INTERVAL {7 * weeks} DAYS")).drop("_end")
    return seasonal_lookup(target, seasonal_means(train, value, keys, ts, out="y_pred"), keys, ts)


def linear_feature_names(lags=LINEAR_LAGS, windows=LINEAR_WINDOWS) -> list[str]:
    rolls = [f"roll_{kind}_{n}h" for n in windows for kind in ("mean", "std")]
    return [f"lag_{k}h" for k in lags] + rolls + list(INDICATORS)


def linear_features(
    df: DataFrame, value="price", lags=LINEAR_LAGS, windows=LINEAR_WINDOWS, chunks: Chunks = DEFAULT
) -> DataFrame:
    """Lags, strict rolling mean and deviation, and indicators; complete rows only."""

    def build(w):
        out = {f"lag_{k}h": F.lag(value, k).over(w) for k in lags}
        for n in windows:
            out[f"roll_mean_{n}h"] = full_window(value, n, w, F.avg)
            out[f"roll_std_{n}h"] = full_window(value, n, w, F.stddev_samp)
        return out

    halo = max(*lags, *windows)
    rows = over_chunks(df.select(*chunks.keys, chunks.ts, value), halo, build, chunks)
    return rows.na.drop("any").withColumns(indicator_columns(F.col(chunks.ts)))


def run_baselines(df: DataFrame, train_split: float = 0.8, value="price", chunks: Chunks = DEFAULT) -> DataFrame:
    """(keys, model, mae, rmse, mape, rows) for persistence, hourly means and linear regression.

    The first part of each series trains, the rest tests. All predictions go into one table, so the
    metrics are one group-by.
    """
    keys, ts = list(chunks.keys), chunks.ts
    series = df.select(*keys, ts, F.col(value).alias("y_true"))
    placed = positions(series, chunks, "_pos", "_total")
    placed = placed.withColumn("_split", F.floor(F.col("_total") * F.lit(float(train_split))))
    test = placed.where(F.col("_pos") >= F.col("_split"))
    train = placed.where(F.col("_pos") < F.col("_split"))

    # Persistence: the last rows of the training part, as many as there are test rows, in order.
    carried = train.select(
        *keys, (F.col("_pos") + F.col("_total") - F.col("_split")).alias("_pos"), F.col("y_true").alias("y_pred")
    )
    persistence = test.join(carried, [*keys, "_pos"], "left")

    means = recent_hourly_means(train.select(*keys, ts, "y_true"), 4, "y_true", chunks)
    hourly = test.withColumn("hour", F.hour(ts)).join(means, [*keys, "hour"], "left")

    names = linear_feature_names()
    matrix = linear_features(df, value, chunks=chunks)
    marked = matrix.join(placed.select(*keys, ts, "_pos", "_split"), [*keys, ts])
    coefs = linear.fit_ols(marked.where(F.col("_pos") < F.col("_split")), names, value, keys)
    regression = linear.score_linear(
        marked.where(F.col("_pos") >= F.col("_split")), coefs, names, keys, spread_by=(ts,)
    ).withColumn("y_true", F.col(value))

    named = {"persistence": persistence, "historical_avg_4wk": hourly, "linear_regression": regression}
    log = reduce(
        DataFrame.unionByName,
        [d.select(*keys, F.lit(name).alias("model"), "y_true", "y_pred") for name, d in named.items()],
    )
    both = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    return log.where(both).groupBy(*keys, "model").agg(*metrics.baseline_metrics(), F.count(F.lit(1)).alias("rows"))


def baseline_table(
    df: DataFrame, test_start=None, train_split: float = 0.8, value="price", weeks: int | None = None,
    chunks: Chunks = DEFAULT,
) -> DataFrame:
    """(keys, ts, y_true, persistence, seasonal_avg_4w) over the whole test period."""
    keys, ts = list(chunks.keys), chunks.ts
    if test_start is None:
        marked = split_by_position(df.select(*keys, ts, value), train_split, chunks)
    else:
        marked = df.select(*keys, ts, value).withColumn("is_train", F.col(ts) < F.lit(test_start).cast("timestamp"))
    lagged = persistence_lag(marked, value, 24, keys).withColumnRenamed("y_pred", "persistence")
    train = marked.where("is_train").select(*keys, ts, value)
    test = lagged.where(~F.col("is_train"))
    scored = seasonal_forecast(train, test, value, weeks, keys, ts).withColumnRenamed("y_pred", "seasonal_avg_4w")
    return scored.select(*keys, ts, F.col(value).alias("y_true"), "persistence", "seasonal_avg_4w")


def compare_baselines(table: DataFrame, keys=("zone",)) -> DataFrame:
    """Metrics of each baseline column of ``baseline_table``."""
    log = table.unpivot([*keys, "y_true"], ["persistence", "seasonal_avg_4w"], "model", "y_pred")
    both = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    return log.where(both).groupBy(*keys, "model").agg(*metrics.all_metrics(), F.count(F.lit(1)).alias("rows"))


