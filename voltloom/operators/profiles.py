"""Descriptive statistics: profiles, moments, summaries, outliers, error breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, metrics
from .lookups import salted_lookup
from .ranking import exact_quantiles

FUEL_PREFIX = "gen_"
FIVE_NUMBERS = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


# ── profiles ────────────────────────────────────────────────────────────────


def profile_hour(df: DataFrame, value: str, keys=("zone",), ts="ts") -> DataFrame:
    """Mean, deviation and exact median by hour of day."""
    by = [*keys, "hour"]
    marked = df.withColumn("hour", F.hour(ts))
    spread = marked.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return spread.join(exact_quantiles(marked, by, value, {"median": 0.5}), by, "left")


def profile_dow(df: DataFrame, value: str, keys=("zone",), ts="ts") -> DataFrame:
    return df.groupBy(*keys, F.weekday(ts).alias("dow")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")
    )


def profile_month(df: DataFrame, value: str, keys=("zone",), ts="ts") -> DataFrame:
    return df.groupBy(*keys, F.month(ts).alias("month")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def describe(df: DataFrame, columns: list[str], keys=()) -> DataFrame:
    """count, mean, std, min, quartiles, max per column, in long form; quartiles exact."""
    by = [*keys, "column"]
    long = df.unpivot(list(keys), columns, "column", "value")
    basics = long.groupBy(*by).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, by, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basics.join(quartiles, by, "left")


def moments(df: DataFrame, value: str, keys=("zone",)) -> DataFrame:
    """Describe plus bias-adjusted skewness and kurtosis."""
    c = F.col(value)
    basics = df.groupBy(*keys).agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        metrics.sample_skewness(c).alias("skewness"),
        metrics.sample_kurtosis(c).alias("kurtosis"),
    )
    quartiles = exact_quantiles(df, list(keys), value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basics.join(quartiles, list(keys), "left")


def table_summary(df: DataFrame, keys=("zone",), ts="ts", spike: float = 100.0) -> DataFrame:
    """Range, price and load statistics, negative and spike hours, mean per fuel."""
    price, load = F.col("price"), F.col("load")
    hours = F.count(F.lit(1))
    fuels = [c for c in df.columns if c.startswith(FUEL_PREFIX)]

    def share(test: Column) -> Column:
        return F.count_if(test) * 100.0 / hours

    basics = df.groupBy(*keys).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        hours.alias("hours"),
        (hours / F.lit(24.0)).alias("days"),
        F.avg(price).alias("price_mean"),
        F.stddev_samp(price).alias("price_std"),
        F.min(price).alias("price_min"),
        F.max(price).alias("price_max"),
        F.count_if(price < 0).alias("negative_hours"),
        share(price < 0).alias("negative_pct"),
        F.count_if(price > spike).alias("spike_hours"),
        share(price > spike).alias("spike_pct"),
        F.avg(load).alias("load_mean"),
        F.max(load).alias("load_peak"),
        F.min(load).alias("load_min"),
        *[F.avg(c).alias(f"{c}_mean") for c in fuels],
    )
    return basics.join(exact_quantiles(df, list(keys), "price", {"price_median": 0.5}), list(keys), "left")


def quality_profile(df: DataFrame, value: str, keys=("zone",), ts="ts") -> DataFrame:
    """Rows, columns, range, span in whole days and missing values."""
    day = 86_400
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.floor((F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts))) / day).alias("span_days"),
        F.count_if(F.col(value).isNull()).alias("missing"),
    )


def zscores(df: DataFrame, value: str, keys=("zone",), spread_by=("ts",)) -> DataFrame:
    """Add the z-score within the series."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    joined = salted_lookup(df, stats, list(keys), spread_by)
    return joined.withColumn("z_score", F.try_divide(F.col(value) - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def outlier_counts(df: DataFrame, value: str, keys=("zone",), limits=(2, 3, 4)) -> DataFrame:
    """Rows and percentage with |z| over each limit."""
    z = F.abs(F.col("z_score"))
    return (
        zscores(df, value, keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(z > k).alias(f"over_{k}") for k in limits],
            *[(F.count_if(z > k) * 100.0 / F.count(F.lit(1))).alias(f"over_{k}_pct") for k in limits],
        )
    )


def outlier_rows(df: DataFrame, value: str, keys=("zone",), limit: float = 2.0) -> DataFrame:
    return zscores(df, value, keys).where(F.abs("z_score") > limit)


def holiday_effect(df: DataFrame, value: str, keys=("zone",), ts="ts", flag="is_holiday") -> DataFrame:
    """Mean on holidays or weekends against other days, the difference and its percentage."""
    off = (F.col(flag) == 1) | (F.weekday(ts) >= 5)
    sides = df.groupBy(*keys).agg(
        F.avg(F.when(off, F.col(value))).alias("holiday_mean"),
        F.avg(F.when(~off, F.col(value))).alias("weekday_mean"),
    )
    gap = F.col("weekday_mean") - F.col("holiday_mean")
    return sides.withColumns({"difference": gap, "difference_pct": F.try_divide(gap * 100.0, F.col("weekday_mean"))})


# ── forecast errors ─────────────────────────────────────────────────────────


def with_errors(log: DataFrame) -> DataFrame:
    e = F.col("y_true") - F.col("y_pred")
    return log.withColumns({"error": e, "abs_error": F.abs(e)})


def _error_columns() -> list[Column]:
    return [F.avg("error").alias("error_mean"), F.avg("abs_error").alias("mae"), F.count("error").alias("count")]


def error_by_hour(log: DataFrame, keys=(), ts="ts") -> DataFrame:
    return with_errors(log).groupBy(*keys, F.hour(ts).alias("hour")).agg(*_error_columns())


def day_name(dow: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in clock.DAY_NAMES]), dow + 1)


def error_by_dow(log: DataFrame, keys=(), ts="ts") -> DataFrame:
    by = with_errors(log).groupBy(*keys, F.weekday(ts).alias("dow")).agg(*_error_columns())
    return by.withColumn("dow_name", day_name(F.col("dow")))


def error_by_horizon(log: DataFrame, keys=()) -> DataFrame:
    return with_errors(log).groupBy(*keys, "horizon").agg(*_error_columns())


def error_rollup(log: DataFrame, ts="ts") -> DataFrame:
    """The three breakdowns and the total from one scan.

    Sums go to the finest cell first (at most 24 x 7 x horizons), so the grouping sets multiply
    only those cells and not the log.
    """
    cells = (
        with_errors(log)
        .groupBy(F.hour(ts).alias("hour"), F.weekday(ts).alias("dow"), "horizon")
        .agg(F.sum("error").alias("_e"), F.sum("abs_error").alias("_a"), F.count("error").alias("_n"))
    )
    hour, dow, horizon = F.col("hour"), F.col("dow"), F.col("horizon")
    total = F.sum("_n")
    return cells.groupingSets([[hour], [dow], [horizon], []], hour, dow, horizon).agg(
        F.grouping_id().alias("level"),
        F.try_divide(F.sum("_e"), total).alias("error_mean"),
        F.try_divide(F.sum("_a"), total).alias("mae"),
        total.alias("count"),
    )


def daily_metrics(folds: DataFrame, keys=(), start="test_start") -> DataFrame:
    """Mean of the fold metrics by date of the test start."""
    return folds.groupBy(*keys, F.to_date(start).alias("date")).agg(
        *[F.avg(m).alias(m) for m in ("mae", "rmse", "mape", "smape")]
    )


def error_histogram(log: DataFrame, keys=("zone",), bins: int = 50, spread_by=("ts",)) -> DataFrame:
    """Counts in equal bins between the smallest and largest error; the last bin is closed."""
    errors = with_errors(log).where(F.col("error").isNotNull()).select(*keys, "error", *spread_by)
    limits = errors.groupBy(*keys).agg(F.min("error").alias("_low"), F.max("error").alias("_high"))
    placed = salted_lookup(errors, limits, list(keys), spread_by)
    width = (F.col("_high") - F.col("_low")) / bins
    raw = F.floor(F.try_divide(F.col("error") - F.col("_low"), width))
    number = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)) + 1
    return placed.groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def horizon_band(horizon: Column) -> Column:
    return (
        F.when(horizon.between(1, 6), "1-6h")
        .when(horizon.between(7, 12), "7-12h")
        .when(horizon.between(13, 18), "13-18h")
        .when(horizon.between(19, 24), "19-24h")
    )


def error_box(log: DataFrame, keys=()) -> DataFrame:
    """Five-number summary of the error per horizon band."""
    banded = with_errors(log).withColumn("band", horizon_band(F.col("horizon")))
    return exact_quantiles(banded.where(F.col("band").isNotNull()), [*keys, "band"], "error", FIVE_NUMBERS)


def horizon_pick(log: DataFrame, horizons=(1, 24), keys=()) -> DataFrame:
    return error_by_horizon(log.where(F.col("horizon").isin(*horizons)), keys).select(*keys, "horizon", "mae")


def metrics_by(log: DataFrame, keys=("zone",)) -> DataFrame:
    """MAE, RMSE, MAPE, sMAPE and the row count, over rows with both values."""
    both = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    return log.where(both).groupBy(*keys).agg(*metrics.all_metrics(), F.count(F.lit(1)).alias("rows"))


def top_importance(importance: DataFrame, n: int = 20, keys=("zone",), name="feature", score="importance") -> DataFrame:
    """The n highest scores per series. Input is one row per series and feature."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc(score), name)
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
