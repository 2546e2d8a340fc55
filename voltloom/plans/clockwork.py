"""Queries over joins, the time grid and scalar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numeric import percent_change
from ..operators import features, grid, lookups, windows
from ..session import work_path
from ..sources import market
from ..streaming import resample
from .catalog import DAILY, HOURS, MARKET, READINGS, TOTAL, register, sql

_HOLIDAYS = ", ".join(f"(DATE '{d}')" for d in clock.holiday_dates())
HOLIDAYS = f"hol AS (SELECT * FROM (VALUES {_HOLIDAYS}) v(day))"


def holiday_flags(ts: str) -> str:
    day = f"CAST({ts} AS DATE)"
    return (f"(CASE WHEN {day} IN (SELECT day FROM hol) THEN 1 ELSE 0 END) AS is_holiday, "
            f"(CASE WHEN CAST({ts} + INTERVAL 1 DAY AS DATE) IN (SELECT day FROM hol) THEN 1 ELSE 0 END) AS is_holiday_eve")


# ── joins and alignment ─────────────────────────────────────────────────────


@register("align_outer", sql([READINGS, HOURS], """SELECT zone, ts, CASE WHEN price > 0 THEN price END AS price,
  CASE WHEN load > 30 THEN load END AS load, CASE WHEN gen_solar > 0 THEN gen_solar END AS gen_solar
  FROM hours WHERE price > 0 OR load > 30 OR gen_solar > 0""", "zone ts", "price load gen_solar"))
def align_outer(spark, sf_dir):
    hours = market.hourly_observed(spark, sf_dir)
    parts = [hours.where(F.col(c) > least).select("zone", "ts", c) for c, least in (("price", 0), ("load", 30), ("gen_solar", 0))]
    return grid.align_outer(parts)


@register("reindex_left", sql([*MARKET], "SELECT m.zone, m.ts, h.load FROM market m LEFT JOIN hours h ON h.zone = m.zone AND h.ts = m.ts "
                              "AND h.price > 0", "zone ts", "load"))
def reindex_left(spark, sf_dir):
    hours = market.hourly_observed(spark, sf_dir)
    index = grid.spine(grid.time_bounds(market.readings(spark, sf_dir)))
    return grid.reindex_left(index, hours.where(F.col("price") > 0).select("zone", "ts", "load"))


@register("holiday_lookup", sql([*MARKET, HOLIDAYS], f"SELECT zone, ts, {holiday_flags('ts')} FROM market", "zone ts",
                                whole="is_holiday is_holiday_eve"))
def holiday_lookup(spark, sf_dir):
    return lookups.holiday_lookup(market.hourly_market(spark, sf_dir).select("zone", "ts"))


@register("seasonal_lookup", sql([*MARKET], """SELECT zone, ts, price, avg(price) OVER (PARTITION BY zone, isodow(ts), hour(ts)) AS seasonal
  FROM market""", "zone ts", "price seasonal"))
def seasonal_lookup(spark, sf_dir):
    hourly = market.hourly_market(spark, sf_dir).select("zone", "ts", "price")
    return lookups.seasonal_lookup(hourly, lookups.seasonal_means(hourly, "price"))


# An order's clock time: its date plus its price in minutes of a day.
STAMPS = ("stamps AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(floor(o_totalprice / 350) AS INT)) AS ts FROM orders)")


def stamps(spark, sf_dir):
    minutes = F.floor(F.col("o_totalprice") / 350).cast("int")
    return market.read_table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=minutes)).alias("ts"))


def _change(month: int, hour: int) -> str:
    end = f"last_day(make_date(year(ts), {month}, 1))"
    return f"(CAST({end} - CAST(isodow({end}) % 7 AS INT) AS TIMESTAMP) + INTERVAL {hour} HOUR)"


SPRING, AUTUMN = _change(3, 3), _change(10, 4)


@register("dst_range_join", sql([STAMPS, f"c AS (SELECT *, {SPRING} AS spring, {AUTUMN} AS autumn FROM stamps)"], """
  SELECT o_orderkey, ts, 'spring' AS kind, spring AS change, epoch(ts) - epoch(spring) AS seconds_from_change FROM c
   WHERE abs(epoch(ts) - epoch(spring)) <= 86400
  UNION ALL SELECT o_orderkey, ts, 'autumn', autumn, epoch(ts) - epoch(autumn) FROM c WHERE abs(epoch(ts) - epoch(autumn)) <= 86400""",
                                "o_orderkey ts kind change", "seconds_from_change"))
def dst_range_join(spark, sf_dir):
    return lookups.dst_range_join(stamps(spark, sf_dir))


@register("nearest_lag_join", sql([READINGS, HOURS], """SELECT a.zone, a.ts, a.price, b.price AS price_24h_ago FROM hours a
  LEFT JOIN hours b ON b.zone = a.zone AND b.ts = a.ts - INTERVAL 24 HOUR""", "zone ts", "price price_24h_ago"))
def nearest_lag_join(spark, sf_dir):
    hours = market.hourly_observed(spark, sf_dir).select("zone", "ts", "price")
    return windows.time_lag_join(hours, "price", 24, "price_24h_ago")


# ── resampling and the grid ─────────────────────────────────────────────────


@register("resample_hourly", sql([READINGS, "means AS (SELECT zone, date_trunc('hour', ts) AS ts, avg(value) AS value, avg(k) AS k FROM readings GROUP BY 1, 2)",
                                  MARKET[2]], "SELECT zone, ts, value, k FROM spine LEFT JOIN means USING (zone, ts)", "zone ts", "value k"))
def resample_hourly(spark, sf_dir):
    return grid.regular_grid(grid.resample_mean(market.readings(spark, sf_dir), ["value", "k"]))


def _live(spark, sf_dir):
    source = market.read_table(spark, sf_dir, "events")
    return spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").select(
        F.col("event_type").alias("zone"), F.col("ts").cast("timestamp").alias("ts"), "value")


@register("resample_stream", sql([READINGS], "SELECT zone, date_trunc('hour', ts) AS ts, avg(value) AS value FROM readings GROUP BY 1, 2",
                                 "zone ts", "value"))
def resample_stream(spark, sf_dir):
    """The same means from a stream of the readings, hours still open at its end included."""
    base = work_path(spark, "stream")
    run = resample.write_updates(resample.resample_stream(_live(spark, sf_dir), ["value"]), f"{base}/out", f"{base}/state")
    run.awaitTermination()
    return resample.newest(spark.read.parquet(f"{base}/out"))


@register("resample_stream_final", sql([READINGS], """SELECT zone, date_trunc('hour', ts) AS ts, avg(value) AS value FROM readings GROUP BY 1, 2
  HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM readings) - INTERVAL 1 HOUR""", "zone ts", "value"))
def resample_stream_final(spark, sf_dir):
    """Only the hours that no later reading can change."""
    base = work_path(spark, "stream")
    run = resample.write_stream(resample.resample_stream(_live(spark, sf_dir), ["value"]), f"{base}/out", f"{base}/state")
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register("regular_grid", sql([*MARKET], "SELECT zone, ts, price FROM market", "zone ts", "price"))
def regular_grid(spark, sf_dir):
    return grid.regular_grid(market.hourly_observed(spark, sf_dir).select("zone", "ts", "price"))


@register("regular_grid_daily", sql([*DAILY], "SELECT * FROM daily", "zone ts", "price load"))
def regular_grid_daily(spark, sf_dir):
    return market.daily_orders(spark, sf_dir)


@register("future_index", sql([READINGS, HOURS], """SELECT zone, origin, h AS horizon, origin + to_hours(CAST(h AS INT)) AS ts FROM
  (SELECT zone, max(ts) AS origin FROM hours GROUP BY zone), range(1, 25) r(h)""", "zone origin ts", whole="horizon"))
def future_index(spark, sf_dir):
    ends = market.readings(spark, sf_dir).groupBy("zone").agg(F.date_trunc("hour", F.max("ts")).alias("ts"))
    return grid.future_index(ends, 24)


@register("to_utc", sql([STAMPS], "SELECT o_orderkey, (ts AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC' AS ts FROM stamps", "o_orderkey ts"))
def to_utc(spark, sf_dir):
    return grid.to_utc(stamps(spark, sf_dir), "Asia/Tokyo")


@register("to_local", sql([STAMPS], "SELECT o_orderkey, ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Athens' AS local_ts FROM stamps",
                          "o_orderkey ts local_ts"))
def to_local(spark, sf_dir):
    return grid.to_local(stamps(spark, sf_dir), "Europe/Athens")


@register("sort_time", sql([READINGS, HOURS], "SELECT zone, ts, price FROM hours ORDER BY zone, ts", "zone ts", "price"))
def sort_time(spark, sf_dir):
    return grid.sort_time(market.hourly_observed(spark, sf_dir).select("zone", "ts", "price"))


# ── calendar, cyclical, clock change ────────────────────────────────────────


@register("cal_basic", sql([STAMPS], """SELECT o_orderkey, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
  isodow(ts) >= 6 AS is_weekend, dayofyear(ts) AS day_of_year, week(ts) AS week_of_year FROM stamps""",
                           "o_orderkey", whole="hour day_of_week month is_weekend day_of_year week_of_year"))
def cal_basic(spark, sf_dir):
    return stamps(spark, sf_dir).select("o_orderkey", *[c.alias(n) for n, c in clock.basic(F.col("ts")).items()])


@register("cal_holiday", sql([*MARKET, HOLIDAYS], f"SELECT zone, ts, {holiday_flags('ts + INTERVAL 2 HOUR')} FROM market", "zone ts",
                             whole="is_holiday is_holiday_eve"))
def cal_holiday(spark, sf_dir):
    """On the local clock of Athens, two hours ahead in January."""
    return lookups.holiday_lookup(market.hourly_market(spark, sf_dir).select("zone", "ts"), tz="Europe/Athens")


@register("cal_part_of_day", sql([STAMPS], """SELECT o_orderkey, CASE WHEN hour(ts) <= 6 THEN 0 WHEN hour(ts) <= 12 THEN 1
  WHEN hour(ts) <= 18 THEN 2 ELSE 3 END AS part_of_day FROM stamps""", "o_orderkey", whole="part_of_day"))
def cal_part_of_day(spark, sf_dir):
    return stamps(spark, sf_dir).select("o_orderkey", clock.part_of_day(F.col("ts")).alias("part_of_day"))


def _circle_sql(name: str, value: str, period: int) -> str:
    return f"sin(2 * pi() * ({value}) / {period}.0) AS {name}_sin, cos(2 * pi() * ({value}) / {period}.0) AS {name}_cos"


_FRACTIONAL = "hour(ts) + minute(ts) / 60.0"
CYCLES = {
    "hour": f"(isodow(ts) - 1) * 24 + {_FRACTIONAL} AS hour_of_week, " + _circle_sql("hour", _FRACTIONAL, 24),
    "dow": _circle_sql("dow", "isodow(ts) - 1", 7),
    "doy": _circle_sql("doy", "dayofyear(ts)", 365),
    "month": _circle_sql("month", "month(ts)", 12),
}


def _register_cycle(query: str, key: str, build, extra: str = ""):
    oracle = sql([STAMPS], f"SELECT o_orderkey, {CYCLES[key]} FROM stamps", "o_orderkey", f"{extra} {key}_sin {key}_cos")

    @register(query, oracle)
    def run(spark, sf_dir):
        return stamps(spark, sf_dir).select("o_orderkey", *[c.alias(n) for n, c in build(F.col("ts")).items()])


_register_cycle("cyc_hour", "hour", clock.cyclical_hour, "hour_of_week")
_register_cycle("cyc_dow", "dow", clock.cyclical_day_of_week)
_register_cycle("cyc_doy", "doy", clock.cyclical_day_of_year)
_register_cycle("cyc_month", "month", clock.cyclical_month)


@register("dst_dates", sql([STAMPS], f"SELECT DISTINCT year(ts) AS year, {SPRING} AS spring, {AUTUMN} AS autumn FROM stamps",
                           "spring autumn", whole="year"))
def dst_dates(spark, sf_dir):
    years = stamps(spark, sf_dir).select(F.year("ts").alias("year")).distinct()
    y = F.col("year")
    return years.select("year", clock.spring_change(y).alias("spring"), clock.autumn_change(y).alias("autumn"))


DST = (f"(CASE WHEN abs(epoch(ts) - epoch({SPRING})) <= 86400 THEN 1 ELSE 0 END) AS is_dst_spring, "
       f"(CASE WHEN abs(epoch(ts) - epoch({AUTUMN})) <= 86400 THEN 1 ELSE 0 END) AS is_dst_autumn")


@register("dst_flags", sql([STAMPS, f"f AS (SELECT o_orderkey, {DST} FROM stamps)"],
                           "SELECT *, greatest(is_dst_spring, is_dst_autumn) AS is_dst_transition FROM f",
                           "o_orderkey", whole="is_dst_spring is_dst_autumn is_dst_transition"))
def dst_flags(spark, sf_dir):
    return stamps(spark, sf_dir).select("o_orderkey", *[c.alias(n) for n, c in clock.dst_flags(F.col("ts")).items()])


# ── scalar grid and price features ──────────────────────────────────────────


@register("solar_cf", sql([*MARKET], """SELECT zone, ts, CASE WHEN solar_irradiance IS NOT NULL THEN
  least(greatest(solar_irradiance / 1000.0, 0), 1) END AS solar_estimated_cf FROM market""", "zone ts", "solar_estimated_cf"))
def solar_cf(spark, sf_dir):
    cf = features.solar_capacity_factor(F.col("solar_irradiance"))
    return market.hourly_market(spark, sf_dir).select("zone", "ts", cf.alias("solar_estimated_cf"))


def _grid(spark, sf_dir, *names):
    columns = features.grid_columns(F.col("load"), F.col("gen_solar"), F.col("gen_wind"))
    return market.hourly_market(spark, sf_dir).select("zone", "ts", *[columns[n].alias(n) for n in names])


@register("grid_residual", sql([*MARKET], "SELECT zone, ts, load - gen_solar - gen_wind AS residual_load FROM market", "zone ts", "residual_load"))
def grid_residual(spark, sf_dir):
    return _grid(spark, sf_dir, "residual_load")


SHARE = ("CASE WHEN load IS NULL THEN NULL WHEN load = 0 THEN CASE WHEN gen_solar + gen_wind > 0 THEN 2 WHEN gen_solar + gen_wind < 0 THEN 0 END "
         "ELSE least(greatest((gen_solar + gen_wind) / load, 0), 2) END AS renewable_share")
SOLAR_RATIO = ("CASE WHEN load - gen_solar - gen_wind <> 0 THEN least(greatest(gen_solar / (load - gen_solar - gen_wind), -2), 5) END "
               "AS solar_to_residual")


@register("grid_share", sql([*MARKET], f"SELECT zone, ts, {SHARE} FROM market", "zone ts", "renewable_share"))
def grid_share(spark, sf_dir):
    return _grid(spark, sf_dir, "renewable_share")


@register("grid_solar_ratio", sql([*MARKET], f"SELECT zone, ts, {SOLAR_RATIO} FROM market", "zone ts", "solar_to_residual"))
def grid_solar_ratio(spark, sf_dir):
    return _grid(spark, sf_dir, "solar_to_residual")


@register("grid_net_import", sql([*MARKET], "SELECT zone, ts, net_flow AS net_import FROM market", "zone ts", "net_import"))
def grid_net_import(spark, sf_dir):
    return market.hourly_market(spark, sf_dir).select("zone", "ts", F.col("net_flow").alias("net_import"))


def lag_sql(expr: str, frm: str = "market") -> str:
    return f"SELECT zone, ts, {expr} FROM {frm} WINDOW w AS (PARTITION BY zone ORDER BY ts)"


@register("price_delta", sql([*MARKET], lag_sql("price - lag(price, 168) OVER w AS price_weekly_delta"), "zone ts", "price_weekly_delta"))
def price_delta(spark, sf_dir):
    hourly = market.hourly_market(spark, sf_dir).select("zone", "ts", "price")
    out = windows.over_chunks(hourly, 168, lambda w: {"price_weekly_delta": F.col("price") - F.lag("price", 168).over(w)})
    return out.drop("price")


@register("price_pct_change", sql([*MARKET], lag_sql("(price - lag(price, 24) OVER w) / nullif(abs(lag(price, 24) OVER w), 0) "
                                                     "AS price_pct_change_24h"), "zone ts", "price_pct_change_24h"))
def price_pct_change(spark, sf_dir):
    hourly = market.hourly_market(spark, sf_dir).select("zone", "ts", "price")
    out = windows.over_chunks(hourly, 24, lambda w: {"price_pct_change_24h": percent_change(F.col("price"), F.lag("price", 24).over(w))})
    return out.drop("price")


@register("difference", sql([*TOTAL], lag_sql("load, load - lag(load) OVER w AS load_diff_1, load - lag(load, 24) OVER w AS load_diff_24"),
                            "zone ts", "load load_diff_1 load_diff_24"))
def difference(spark, sf_dir):
    return windows.difference(market.hourly_total(spark, sf_dir).select("zone", "ts", "load"), "load", (1, 24))


