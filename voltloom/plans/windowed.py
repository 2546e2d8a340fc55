"""Queries over trailing windows and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, profiles, ranking, windows
from ..operators.windows import Chunks
from ..sources import market
from .catalog import DAILY, LOG, MARKET, TOTAL, register, sql
from .clockwork import lag_sql

WEATHER = ("temperature", "wind_speed", "cloud_cover", "solar_irradiance")
DAYS = Chunks(step_seconds=86_400, size=364)


def frame(n: int) -> str:
    return f"OVER (PARTITION BY zone ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _price(spark, sf_dir):
    return market.hourly_market(spark, sf_dir).select("zone", "ts", "price")


@register("lag_k", sql([*MARKET], lag_sql(", ".join(f"lag(price, {k}) OVER w AS price_lag_{k}h" for k in features.LAGS)),
                       "zone ts", " ".join(f"price_lag_{k}h" for k in features.LAGS)))
def lag_k(spark, sf_dir):
    out = windows.over_chunks(_price(spark, sf_dir), max(features.LAGS),
                              lambda w: {f"price_lag_{k}h": F.lag("price", k).over(w) for k in features.LAGS})
    return out.drop("price")


def _rolled(name: str, expressions: dict[str, str], build, source=_price, ctes=None, keep: str = "zone ts"):
    body = "SELECT zone, ts, " + ", ".join(f"{e} AS {c}" for c, e in expressions.items()) + " FROM market"

    @register(name, sql(ctes or [*MARKET], body, keep, " ".join(expressions)))
    def run(spark, sf_dir):
        rows = windows.over_chunks(source(spark, sf_dir), 720, build)
        return rows.select("zone", "ts", *expressions)


_rolled("roll_mean", {f"mean_{n}": f"avg(price) {frame(n)}" for n in (24, 168)},
        lambda w: {f"mean_{n}": windows.roll_mean("price", n, w) for n in (24, 168)})
_rolled("roll_std", {f"std_{n}": f"stddev_samp(price) {frame(n)}" for n in (24, 168)},
        lambda w: {f"std_{n}": windows.roll_std("price", n, w) for n in (24, 168)})
_rolled("roll_zscore", {f"z_{n}": f"(price - avg(price) {frame(n)}) / nullif(stddev_samp(price) {frame(n)}, 0)" for n in (24, 168)},
        lambda w: {f"z_{n}": windows.roll_zscore("price", n, w) for n in (24, 168)})
_rolled("roll_vs_7d", {"price_vs_7d_mean": f"price - avg(price) {frame(168)}"},
        lambda w: {"price_vs_7d_mean": F.col("price") - windows.roll_mean("price", 168, w)})
_rolled("roll_strict", {f"{kind}_{n}": f"CASE WHEN count(price) {frame(n)} = {n} THEN {fn}(price) {frame(n)} END"
                        for n in (24, 168) for kind, fn in (("mean", "avg"), ("std", "stddev_samp"))},
        lambda w: {f"{kind}_{n}": windows.full_window("price", n, w, fn)
                   for n in (24, 168) for kind, fn in (("mean", F.avg), ("std", F.stddev_samp))})


def _weather(name: str, suffix: str, expr) -> None:
    columns = {f"weather_{v}_{suffix}": expr(v) for v in WEATHER}

    def build(w):
        return {c: e for v in WEATHER for c, e in features.weather_windows(v, w).items() if c in columns}

    _rolled(name, columns, build, lambda spark, sf_dir: market.hourly_market(spark, sf_dir).select("zone", "ts", *WEATHER))


_weather("weather_raw", "raw", lambda v: v)
_weather("weather_6h", "roll6h", lambda v: f"avg({v}) {frame(6)}")
_weather("weather_24h", "roll24h", lambda v: f"avg({v}) {frame(24)}")
_weather("weather_anomaly", "anomaly", lambda v: f"{v} - avg({v}) {frame(24)}")


def _load(spark, sf_dir):
    return market.hourly_market(spark, sf_dir).select("zone", "ts", "load")


_rolled("load_roll24", {"load_roll24h": f"avg(load) {frame(24)}"},
        lambda w: {"load_roll24h": windows.roll_mean("load", 24, w)}, _load)
_rolled("load_ratio", {"load_pct_of_7d": f"load / nullif(avg(load) {frame(24)}, 0)"},
        lambda w: {"load_pct_of_7d": features.load_windows(w)["load_pct_of_7d"]}, _load)
_rolled("roll_7d", {"roll_mean_7d": f"avg(load) {frame(168)}", "roll_std_7d": f"stddev_samp(load) {frame(168)}"},
        lambda w: {"roll_mean_7d": windows.roll_mean("load", 168, w), "roll_std_7d": windows.roll_std("load", 168, w)},
        lambda spark, sf_dir: market.hourly_total(spark, sf_dir).select("zone", "ts", "load"), [*TOTAL])
_rolled("roll_30d", {"roll_mean_30d": f"avg(load) {frame(720)}"},
        lambda w: {"roll_mean_30d": windows.roll_mean("load", 720, w)},
        lambda spark, sf_dir: market.hourly_total(spark, sf_dir).select("zone", "ts", "load"), [*TOTAL])

RESIDUAL = "res AS (SELECT zone, ts, load - gen_solar - gen_wind AS residual_load FROM market)"
PCT = ("CASE WHEN residual_load IS NOT NULL THEN (rank() OVER (PARTITION BY zone, residual_load IS NULL ORDER BY residual_load) + "
       "(count(*) OVER (PARTITION BY zone, residual_load) - 1) / 2.0) / count(residual_load) OVER (PARTITION BY zone) END AS residual_load_pct")


@register("residual_pct_rank", sql([*MARKET, RESIDUAL], f"SELECT zone, ts, {PCT} FROM res", "zone ts", "residual_load_pct"))
def residual_pct_rank(spark, sf_dir):
    hourly = market.hourly_market(spark, sf_dir)
    residual = market.stored(
        hourly.select("zone", "ts", (F.col("load") - F.col("gen_solar") - F.col("gen_wind")).alias("residual_load"))
    )  # the rank reads it three times
    return ranking.percent_rank(residual, ["zone"], "residual_load", "residual_load_pct").drop("residual_load")


@register("smooth_daily", sql([*LOG, """d AS (SELECT CAST(ts AS DATE) AS ts, avg(abs_error) AS mae, sqrt(avg(error * error)) AS rmse
  FROM errs WHERE error IS NOT NULL GROUP BY 1)"""], """SELECT CAST(ts AS TIMESTAMP) AS ts, mae, rmse,
  avg(mae) OVER (ORDER BY ts ROWS 6 PRECEDING) AS mae_smooth, avg(rmse) OVER (ORDER BY ts ROWS 6 PRECEDING) AS rmse_smooth FROM d""",
                              "ts", "mae rmse mae_smooth rmse_smooth"))
def smooth_daily(spark, sf_dir):
    log = market.prediction_log(market.hourly_market(spark, sf_dir))
    daily = profiles.metrics_by(log.withColumn("ts", F.date_trunc("day", "ts")), ("ts",)).withColumn("zone", F.lit("all"))
    return windows.smooth(daily.select("zone", "ts", "mae", "rmse"), ["mae", "rmse"], 7, DAYS).drop("zone")


@register("long_series_window", sql([*DAILY], f"SELECT zone, ts, load, avg(load) {frame(90)} AS mean_90d, "
                                    f"stddev_samp(load) {frame(90)} AS std_90d FROM daily", "zone ts", "load mean_90d std_90d"))
def long_series_window(spark, sf_dir):
    """Six years of days per zone, cut into chunks of a quarter."""
    days = market.daily_orders(spark, sf_dir).select("zone", "ts", "load")
    return windows.over_chunks(
        days, 89, lambda w: {"mean_90d": windows.roll_mean("load", 90, w), "std_90d": windows.roll_std("load", 90, w)},
        Chunks(step_seconds=86_400, size=91))
