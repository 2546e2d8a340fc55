"""Queries on intervals, pinball loss, ramps, unusual errors and spreads."""

from __future__ import annotations

from ..operators import targets, windows
from ..sources import market
from .catalog import LOG, MARKET, register, sql
from .windowed import frame


def _log(spark, sf_dir):
    return market.stored(market.prediction_log(market.hourly_market(spark, sf_dir)))


SHIFTS = """shifts AS (SELECT *, quantile_cont(error, 0.1) OVER w AS l80, quantile_cont(error, 0.9) OVER w AS h80,
  quantile_cont(error, 0.025) OVER w AS l95, quantile_cont(error, 0.975) OVER w AS h95, count(error) OVER w AS known FROM errs
  WINDOW w AS (PARTITION BY zone, horizon ORDER BY ts RANGE BETWEEN INTERVAL 2160 HOUR PRECEDING AND INTERVAL 1 SECOND PRECEDING))"""
BOUNDS = """bounds AS (SELECT zone, ts, horizon, y_true, y_pred, y_pred + l80 AS low_80, y_pred + h80 AS high_80, y_pred + l95 AS low_95,
  y_pred + h95 AS high_95 FROM (SELECT zone, ts, horizon, y_true, y_pred, CASE WHEN known >= 8 THEN l80 END AS l80, CASE WHEN known >= 8 THEN h80 END AS h80,
  CASE WHEN known >= 8 THEN l95 END AS l95, CASE WHEN known >= 8 THEN h95 END AS h95 FROM shifts))"""


@register("prediction_intervals", sql([*LOG, SHIFTS, BOUNDS], "SELECT zone, ts, horizon, y_pred, low_80, high_80, low_95, high_95 FROM bounds",
                                      "zone ts", "y_pred low_80 high_80 low_95 high_95", "horizon"))
def prediction_intervals(spark, sf_dir):
    return targets.intervals(_log(spark, sf_dir)).select("zone", "ts", "horizon", "y_pred", "low_80", "high_80", "low_95", "high_95")


@register("pinball_loss", sql([*LOG, SHIFTS, BOUNDS], """SELECT zone, avg(high_80 - low_80) AS width,
  avg(greatest(0.1 * (y_true - low_80), -0.9 * (y_true - low_80))) AS pinball_low,
  avg(greatest(0.9 * (y_true - high_80), -0.1 * (y_true - high_80))) AS pinball_high
  FROM bounds WHERE y_true IS NOT NULL AND low_80 IS NOT NULL GROUP BY zone""", "zone", "width pinball_low pinball_high"))
def pinball_loss(spark, sf_dir):
    return targets.interval_scores(targets.intervals(_log(spark, sf_dir), (80,)), 80).drop("coverage")


@register("deviation_flags", sql([*LOG, """d AS (SELECT *, stddev_samp(error) OVER (PARTITION BY zone ORDER BY ts
  ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING) AS sigma FROM errs)"""], "SELECT zone, ts, error, sigma, abs(error) > 3 * sigma AS deviates FROM d",
                                 "zone ts", "error sigma", "deviates"))
def deviation_flags(spark, sf_dir):
    return targets.deviation_flags(_log(spark, sf_dir)).select("zone", "ts", "error", "sigma", "deviates")


def _ramps(name: str, threshold: float) -> None:
    moves = f"""moves AS (SELECT zone, abs(y_true - lag(y_true) OVER w) > {threshold} AS "real", abs(y_pred - lag(y_pred) OVER w) > {threshold} AS seen
  FROM log WINDOW w AS (PARTITION BY zone ORDER BY ts))"""
    counts = """counts AS (SELECT zone, count(*) FILTER (WHERE "real") AS ramps, count(*) FILTER (WHERE seen) AS foreseen,
  count(*) FILTER (WHERE "real" AND seen) AS hits FROM moves WHERE "real" IS NOT NULL AND seen IS NOT NULL GROUP BY zone)"""

    @register(name, sql([*LOG, moves, counts], """SELECT *, hits / nullif(foreseen, 0) AS "precision", hits / nullif(ramps, 0) AS recall FROM counts""",
                        "zone", '"precision" recall', "ramps foreseen hits"))
    def run(spark, sf_dir):
        return targets.ramp_scores(_log(spark, sf_dir), threshold)


_ramps("ramp_scores", 50.0)
_ramps("ramp_scores_low", 20.0)


@register("zone_spread", sql([*MARKET], """SELECT a.zone, a.ts, a.price, a.price - avg(b.price) AS spread FROM market a
  LEFT JOIN market b ON a.ts = b.ts AND a.zone <> b.zone GROUP BY a.zone, a.ts, a.price""", "zone ts", "price spread"))
def zone_spread(spark, sf_dir):
    return targets.zone_spread(market.hourly_market(spark, sf_dir).select("zone", "ts", "price"))


@register("price_roll_30d", sql([*MARKET], f"SELECT zone, ts, avg(price) {frame(720)} AS price_mean_30d, "
                                f"stddev_samp(price) {frame(720)} AS price_std_30d FROM market", "zone ts", "price_mean_30d price_std_30d"))
def price_roll_30d(spark, sf_dir):
    price = market.hourly_market(spark, sf_dir).select("zone", "ts", "price")
    out = windows.over_chunks(price, 720, lambda w: {"price_mean_30d": windows.roll_mean("price", 720, w), "price_std_30d": windows.roll_std("price", 720, w)})
    return out.drop("price")
