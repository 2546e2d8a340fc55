"""Queries over sources, sinks, projections and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import lookups, reshape, roles
from ..sources import landing, market, sinks, weather
from ..session import work_path
from .catalog import DAILY, HOURS, LOG, MARKET, READINGS, register, sql

FROM, TO = "2024-01-08", "2024-01-22"
FUEL_NAMES = ["Solar", "Wind Onshore", "Fossil Gas", "Hydro Water Reservoir", "Other"]
ROLE_COLUMNS = (
    "price load gen_solar gen_wind gen_gas gen_hydro temperature wind_speed cloud_cover solar_irradiance net_flow"
)


def _land(spark: SparkSession, df: DataFrame, label: str) -> str:
    path = work_path(spark, label)
    sinks.sink_raw(df, path)
    return path


@register("scan_hourly", sql([*MARKET], f"SELECT * FROM market WHERE zone = 'view' AND ts >= TIMESTAMP '{FROM}' "
                             f"AND ts < TIMESTAMP '{TO}'", "zone ts", ROLE_COLUMNS))
def scan_hourly(spark, sf_dir):
    hourly = market.hourly_market(spark, sf_dir)
    path = _land(spark, hourly, "hourly")
    return landing.scan_hourly(spark, path, hourly.schema, "view", FROM, TO)


@register("sink_raw", sql([*MARKET], "SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM market",
                          "zone ts date", ROLE_COLUMNS))
def sink_raw(spark, sf_dir):
    return spark.read.parquet(_land(spark, market.hourly_market(spark, sf_dir), "raw"))


def _snapshots(spark, sf_dir) -> str:
    """Two snapshots of the hourly means: the later one holds corrected values from FROM on."""
    hours = market.hourly_observed(spark, sf_dir)
    price = hours.select("zone", "ts", F.col("price").alias("value"))
    path = work_path(spark, "snapshots")
    price.write.parquet(f"{path}/load_2024-01-07")
    later = price.where(F.col("ts") >= F.lit(FROM).cast("timestamp")).withColumn("value", F.col("value") + 1000.0)
    later.write.parquet(f"{path}/load_2024-01-30")
    return path


@register("latest_snapshot", sql([READINGS, HOURS], f"SELECT zone, ts, price + CASE WHEN ts >= TIMESTAMP '{FROM}' "
                                 "THEN 1000 ELSE 0 END AS value FROM hours", "zone ts", "value"))
def latest_snapshot(spark, sf_dir):
    path = _snapshots(spark, sf_dir)
    rows = landing.read_snapshots(spark, [f"{path}/load_2024-01-07", f"{path}/load_2024-01-30"], landing.SERIES_SCHEMA)
    return landing.latest_snapshot(rows, ["zone", "ts"]).select("zone", "ts", "value")


@register("newest_snapshot_only", sql([READINGS, HOURS], f"SELECT zone, ts, price + 1000 AS value FROM hours "
                                      f"WHERE ts >= TIMESTAMP '{FROM}'", "zone ts", "value"))
def newest_snapshot_only(spark, sf_dir):
    """The files are chosen by name, so the older snapshot is not read."""
    path = _snapshots(spark, sf_dir)
    paths = [f"{path}/load_2024-01-07", f"{path}/load_2024-01-30"]
    return landing.read_newest(spark, paths, landing.SERIES_SCHEMA, r"([a-z]+)_([0-9-]+)/[^/]+$", [1], 2).select("zone", "ts", "value")


@register("newest_snapshot_by_zone", sql([READINGS, HOURS], f"SELECT zone, ts, price + CASE WHEN zone IN ('click', 'view') THEN 1000 ELSE 0 END AS value FROM hours "
                                         f"WHERE zone NOT IN ('click', 'view') OR ts >= TIMESTAMP '{FROM}'", "zone ts", "value"))
def newest_snapshot_by_zone(spark, sf_dir):
    """Two zones have a newer snapshot than the others; each zone is read from its own newest files."""
    hours = market.hourly_observed(spark, sf_dir).select("zone", "ts", F.col("price").alias("value"))
    path = work_path(spark, "snapshots")
    hours.withColumn("day", F.lit("2024-01-07")).write.partitionBy("zone", "day").parquet(path)
    later = hours.where((F.col("ts") >= F.lit(FROM).cast("timestamp")) & F.col("zone").isin("click", "view")).withColumn("value", F.col("value") + 1000.0)
    later.withColumn("day", F.lit("2024-01-30")).write.mode("append").partitionBy("zone", "day").parquet(path)
    name = r"zone=([^/]+)/day=([0-9-]+)/[^/]+$"
    rows = landing.read_newest(spark, path, T.StructType([f for f in landing.SERIES_SCHEMA if f.name != "zone"]), name, [1], 2)
    return rows.select(F.regexp_extract("snapshot", name, 1).alias("zone"), "ts", "value")


def _series(spark, sf_dir, column, name):
    hours = market.hourly_observed(spark, sf_dir).select("zone", "ts", F.col(column).alias("value"))
    return landing.landed_series(spark, _land(spark, hours, name), name, FROM, TO, "click")


def _series_sql(column: str) -> str:
    return sql([READINGS, HOURS], f"SELECT * FROM hours WHERE zone = 'click' AND ts >= TIMESTAMP '{FROM}' "
               f"AND ts < TIMESTAMP '{TO}'", "zone ts", column)


@register("landed_prices", _series_sql("price"))
def landed_prices(spark, sf_dir):
    return _series(spark, sf_dir, "price", "price")


@register("landed_load", _series_sql("load"))
def landed_load(spark, sf_dir):
    return _series(spark, sf_dir, "load", "load")


_FUEL_SQL = ["gen_solar", "gen_wind_onshore", "gen_fossil_gas", "gen_hydro_water_reservoir", "gen_other"]


def _fuel_sql(columns: dict[str, str]) -> str:
    wanted = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    return f"SELECT zone, date_trunc('hour', ts) AS ts, {wanted} FROM readings WHERE ts >= TIMESTAMP '{FROM}' AND ts < TIMESTAMP '{TO}' GROUP BY 1, 2"


_FUEL_MEANS = {c: f"avg(value) FILTER (WHERE CAST(floor(k / 20) AS INT) = {i})" for i, c in enumerate(_FUEL_SQL)}


def _landed_fuels(spark, sf_dir):
    events = market.readings(spark, sf_dir)
    names = F.array(*[F.lit(f) for f in FUEL_NAMES])
    tidy = events.groupBy(
        "zone", F.date_trunc("hour", "ts").alias("ts"), F.element_at(names, F.floor(F.col("k") / 20).cast("int") + 1).alias("fuel")
    ).agg(F.avg("value").alias("mw"))
    return _land(spark, tidy, "generation")


@register("landed_generation", sql([READINGS], _fuel_sql(_FUEL_MEANS), "zone ts", " ".join(_FUEL_SQL)))
def landed_generation(spark, sf_dir):
    return landing.landed_generation(spark, _landed_fuels(spark, sf_dir), FUEL_NAMES, FROM, TO)


_REST = " + ".join(f"coalesce({m}, 0)" for m in list(_FUEL_MEANS.values())[2:])
_ANY = "count(*) FILTER (WHERE CAST(floor(k / 20) AS INT) >= 2)"
_LISTED = {c: _FUEL_MEANS[c] for c in _FUEL_SQL[:2]}


@register("landed_generation_rest", sql(
    [READINGS], _fuel_sql(_LISTED | {"gen_unlisted": f"CASE WHEN {_ANY} > 0 THEN {_REST} END"}), "zone ts", " ".join([*_LISTED, "gen_unlisted"])))
def landed_generation_rest(spark, sf_dir):
    return landing.landed_generation(spark, _landed_fuels(spark, sf_dir), FUEL_NAMES[:2], FROM, TO, rest="gen_unlisted")


_FLOWS = """flows AS (SELECT l_shipdate AS ts, a.r_name AS out_zone, b.r_name AS in_zone, sum(l_quantity) AS mw
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation n ON n.n_nationkey = s_nationkey
  JOIN region a ON a.r_regionkey = n.n_regionkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation m ON m.n_nationkey = c_nationkey
  JOIN region b ON b.r_regionkey = m.n_regionkey GROUP BY 1, 2, 3)"""


@register("landed_flows", sql([_FLOWS], """SELECT ts, sum(CASE WHEN out_zone = 'ASIA' THEN mw ELSE -mw END) AS flow
  FROM flows WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01' AND
  ((out_zone = 'ASIA' AND in_zone = 'EUROPE') OR (out_zone = 'EUROPE' AND in_zone = 'ASIA')) GROUP BY ts""", "ts", "flow"))
def landed_flows(spark, sf_dir):
    read = lambda name: market.read_table(spark, sf_dir, name)
    areas = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    sellers = read("supplier").join(areas, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("out_zone"))
    buyers = read("customer").join(areas, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("r_name").alias("in_zone"))
    orders = read("orders").join(buyers, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "in_zone")
    flows = (
        read("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", F.col("l_shipdate").cast("timestamp").alias("ts"))
        .join(sellers, "l_suppkey").join(orders, "l_orderkey")
        .groupBy("ts", "out_zone", "in_zone").agg(F.sum("l_quantity").alias("mw"))
    )
    path = work_path(spark, "flows")
    flows.write.parquet(path)
    return landing.landed_flows(spark, path, "1996-01-01", "1999-01-01", "ASIA", "EUROPE")


_PAYLOAD = {
    "temperature_2m": (F.avg, "k"), "temperature_80m": (F.max, "k"), "wind_speed_10m": (F.min, "value"),
    "wind_speed_80m": (F.max, "value"), "cloud_cover": (F.min, "k"), "shortwave_radiation_instant": (F.sum, "value"),
    "direct_radiation_instant": (F.sum, "k"),
}
_WEATHER_COLUMNS = " ".join(weather.WEATHER_VARIABLES.values())


@register("parse_weather", sql(
    [READINGS], """SELECT zone, date_trunc('hour', ts) - INTERVAL 2 HOUR AS ts, avg(k) AS temperature_2m_c,
    max(k) AS temperature_80m_c, min(value) AS wind_speed_10m_ms, max(value) AS wind_speed_80m_ms,
    min(k) AS cloud_cover, sum(value) AS solar_irradiance_wm2, sum(k) AS direct_radiation_wm2
    FROM readings GROUP BY zone, date_trunc('hour', ts)""", "zone ts", _WEATHER_COLUMNS))
def parse_weather(spark, sf_dir):
    """Payloads hold a zone's day; January in Athens is two hours ahead of UTC."""
    hours = market.readings(spark, sf_dir).groupBy("zone", F.date_trunc("hour", "ts").alias("ts")).agg(
        *[fn(c).alias(name) for name, (fn, c) in _PAYLOAD.items()])
    stamped = hours.withColumn("time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))
    per_day = stamped.groupBy("zone", F.to_date("ts").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct("time", *_PAYLOAD))).alias("h"))
    hourly = F.struct(*[F.col(f"h.{c}").alias(c) for c in ("time", *_PAYLOAD)])
    payloads = per_day.select("zone", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))
    return weather.parse_weather(payloads, "payload")


@register("sink_forecast", sql([*LOG], "SELECT zone, ts, y_pred AS forecast_eur_mwh, CAST(CAST(ts - INTERVAL 1 DAY AS DATE) "
                               "AS VARCHAR) AS reference_date FROM log WHERE y_pred IS NOT NULL",
                               "zone ts reference_date", "forecast_eur_mwh"))
def sink_forecast(spark, sf_dir):
    log = market.prediction_log(market.hourly_market(spark, sf_dir)).where(F.col("y_pred").isNotNull())
    rows = log.select("zone", "ts", F.col("y_pred").alias("forecast_eur_mwh"), F.date_sub(F.to_date("ts"), 1).alias("reference_date"))
    path = work_path(spark, "forecast")
    sinks.sink_forecast(rows, path)
    return spark.read.parquet(path)


@register("sink_reports", sql([*LOG], """SELECT 'per_hour' AS report, CAST(count(*) AS BIGINT) AS lines FROM (SELECT DISTINCT hour(ts) FROM log)
  UNION ALL SELECT 'per_dow', count(*) FROM (SELECT DISTINCT isodow(ts) FROM log)
  UNION ALL SELECT 'per_horizon', count(*) FROM (SELECT DISTINCT horizon FROM log)
  UNION ALL SELECT 'iterations', count(*) FROM (SELECT DISTINCT zone, iteration FROM log WHERE error IS NOT NULL)
  UNION ALL SELECT 'daily', count(*) FROM (SELECT DISTINCT iteration FROM log WHERE error IS NOT NULL)
  UNION ALL SELECT 'predictions', count(*) FROM log""".replace("FROM log", "FROM errs"), "report", whole="lines"))
def sink_reports(spark, sf_dir):
    from ..operators import profiles

    log = market.prediction_log(market.hourly_market(spark, sf_dir))
    folds = profiles.metrics_by(log.withColumn("test_start", F.date_trunc("day", "ts")), ("zone", "iteration", "test_start"))
    tables = {
        "iterations": folds, "daily": profiles.daily_metrics(folds), "per_hour": profiles.error_by_hour(log),
        "per_horizon": profiles.error_by_horizon(log), "per_dow": profiles.error_by_dow(log), "predictions": log,
    }
    path = work_path(spark, "reports")
    sinks.sink_reports(tables, path)
    counts = [
        spark.read.option("header", True).csv(f"{path}/{t}").groupBy().agg(F.count(F.lit(1)).alias("lines"))
        .select(F.lit(t).alias("report"), "lines") for t in tables
    ]
    return reshape.append_rows(*counts)


@register("sink_sample", sql([*MARKET], "SELECT * FROM market ORDER BY ts DESC, zone LIMIT 720", "zone ts", "price load"))
def sink_sample(spark, sf_dir):
    hourly = market.hourly_market(spark, sf_dir).select("zone", "ts", "price", "load")
    path = work_path(spark, "sample")
    sinks.sink_sample(hourly, path)
    return spark.read.schema(hourly.schema).option("header", True).csv(path)


@register("cached_fallback", sql([READINGS, HOURS], """SELECT zone, ts, CASE WHEN load > 50 THEN price ELSE price + 1000 END AS price
  FROM hours""", "zone ts", "price"))
def cached_fallback(spark, sf_dir):
    hours = market.hourly_observed(spark, sf_dir).select("zone", "ts", "price", "load")
    live = hours.where(F.col("load") > 50).drop("load")
    cache = hours.withColumn("price", F.col("price") + 1000.0).drop("load")
    return landing.with_fallback(live, cache)


# ── projections, filters, reshape ───────────────────────────────────────────


@register("role_projection", sql([*MARKET], "SELECT zone, ts, price, load, gen_solar, gen_wind, temperature, wind_speed, net_flow "
                                 "FROM market", "zone ts", "price load gen_solar gen_wind temperature wind_speed net_flow"))
def role_projection(spark, sf_dir):
    raw = market.hourly_market(spark, sf_dir).withColumnsRenamed({
        "price": "Price_EUR_MWh", "gen_solar": "gen_gr_solar", "gen_wind": "gen_gr_wind_onshore",
        "temperature": "temperature_2m_c", "wind_speed": "wind_speed_100m_km_h", "net_flow": "flow_gr_bg",
    }).withColumns({"load_forecast": F.lit(1.0), "import_flow": F.lit(2.0)}).drop(
        "gen_gas", "gen_hydro", "cloud_cover", "solar_irradiance")
    return roles.role_projection(raw, "GR")


@register("map_domain", sql([READINGS], """SELECT zone, CASE zone WHEN 'click' THEN '10YGR-HTSO-----Y' WHEN 'view' THEN '10YFR-RTE------C'
  WHEN 'error' THEN '10YIT-GRTN-----B' ELSE zone END AS domain_code, count(*) AS rows FROM readings GROUP BY 1""",
                            "zone domain_code", whole="rows"))
def map_domain(spark, sf_dir):
    codes = {"CLICK": roles.DOMAIN_CODES["GR"], "VIEW": roles.DOMAIN_CODES["FR"], "ERROR": roles.DOMAIN_CODES["IT"]}
    zones = market.readings(spark, sf_dir).groupBy("zone").agg(F.count(F.lit(1)).alias("rows"))
    return lookups.domain_lookup(zones, codes)


@register("rename_roles", sql([READINGS, HOURS], "SELECT zone, ts, load AS load_gr, gen_solar AS gen_gr_solar, gen_wind AS gen_gr_wind "
                              "FROM hours", "zone ts", "load_gr gen_gr_solar gen_gr_wind"))
def rename_roles(spark, sf_dir):
    hours = market.hourly_observed(spark, sf_dir).select("zone", "ts", F.col("load").alias("load_mw"),
                                                         F.col("gen_solar").alias("solar"), F.col("gen_wind").alias("wind"))
    return roles.rename_roles(hours, {"load_mw": "load_gr"}, "gen_gr_", ("solar", "wind"))


@register("drop_leaked", sql([READINGS, HOURS], "SELECT zone, ts, price FROM hours", "zone ts", "price"))
def drop_leaked(spark, sf_dir):
    hours = market.hourly_observed(spark, sf_dir).select("zone", "ts", "price")
    return roles.drop_leaked(hours.withColumns({"Unnamed: 0": F.lit(0), "MTU (UTC)": F.col("ts").cast("string")}))


@register("select_numeric", sql([READINGS, HOURS], "SELECT * FROM hours", "zone ts", ROLE_COLUMNS.replace("price ", "")))
def select_numeric(spark, sf_dir):
    hours = market.hourly_observed(spark, sf_dir).withColumn("note", F.lit("x"))
    return roles.select_numeric(hours, "price", ("zone", "ts"))


@register("drop_incomplete", sql([*MARKET], "SELECT * FROM market WHERE price IS NOT NULL", "zone ts", ROLE_COLUMNS))
def drop_incomplete(spark, sf_dir):
    return reshape.drop_incomplete(market.hourly_market(spark, sf_dir))


@register("min_rows_guard", sql([*MARKET], "SELECT zone, count(price) AS rows, count(price) >= 680 AS enough FROM market GROUP BY zone",
                                "zone", whole="rows enough"))
def min_rows_guard(spark, sf_dir):
    return reshape.count_guard(reshape.drop_incomplete(market.hourly_market(spark, sf_dir)), 680)


@register("time_filter", sql([READINGS, HOURS], f"SELECT zone, ts, price FROM hours WHERE ts < TIMESTAMP '{TO}'", "zone ts", "price"))
def time_filter(spark, sf_dir):
    return reshape.time_filter(market.hourly_observed(spark, sf_dir), before=TO).select("zone", "ts", "price")


@register("positional_slice", sql([READINGS, HOURS], """SELECT zone, ts, price, row_number() OVER (PARTITION BY zone ORDER BY ts) - 1
  < floor(count(*) OVER (PARTITION BY zone) * 0.8) AS is_train FROM hours""", "zone ts", "price", "is_train"))
def positional_slice(spark, sf_dir):
    hours = market.hourly_observed(spark, sf_dir).select("zone", "ts", "price")
    return reshape.split_by_position(hours, 0.8)


@register("median_impute", sql([*MARKET, "m AS (SELECT zone, median(price) AS p, median(load) AS l FROM market GROUP BY zone)"],
                               "SELECT zone, ts, coalesce(price, p) AS price, coalesce(load, l) AS load FROM market JOIN m USING (zone)",
                               "zone ts", "price load"))
def median_impute(spark, sf_dir):
    return reshape.median_impute(market.hourly_market(spark, sf_dir).select("zone", "ts", "price", "load"), ["price", "load"])


@register("zero_impute", sql([*MARKET], "SELECT zone, ts, coalesce(price, 0) AS price, coalesce(load, 0) AS load FROM market",
                             "zone ts", "price load"))
def zero_impute(spark, sf_dir):
    return reshape.zero_impute(market.hourly_market(spark, sf_dir).select("zone", "ts", "price", "load"), ["price", "load"])


_IND = {
    **{f"h_{k}": f"hour(ts) = {k}" for k in range(24)},
    **{f"dow_{k}": f"isodow(ts) - 1 = {k}" for k in range(7)},
    **{f"mon_{k}": f"month(ts) = {k}" for k in range(1, 13)},
}


@register("one_hot", sql([*DAILY], "SELECT zone, ts, " + ", ".join(f"{e} AS {c}" for c, e in _IND.items()) + " FROM daily",
                         "zone ts", whole=" ".join(_IND)))
def one_hot(spark, sf_dir):
    return market.daily_orders(spark, sf_dir).select("zone", "ts").withColumns(reshape.indicator_columns(F.col("ts")))


@register("unpivot_horizon", sql([*MARKET], """SELECT d.zone, d.day - INTERVAL 1 HOUR AS origin, h + 1 AS horizon, d.day + to_hours(CAST(h AS INT)) AS ts,
  m.price AS y_pred FROM (SELECT DISTINCT zone, date_trunc('day', ts) AS day FROM market) d CROSS JOIN range(24) r(h)
  LEFT JOIN market m ON m.zone = d.zone AND m.ts = d.day + to_hours(CAST(h AS INT))""", "zone origin ts", "y_pred", "horizon"))
def unpivot_horizon(spark, sf_dir):
    """A day's 24 prices as the vector issued the hour before."""
    hourly = market.hourly_market(spark, sf_dir)
    vector = F.array(*[F.max(F.when(F.hour("ts") == h, F.col("price"))) for h in range(24)])
    days = hourly.groupBy("zone", (F.date_trunc("day", "ts") - F.expr("INTERVAL 1 HOUR")).alias("origin"))
    return reshape.unpivot_horizon(days.agg(vector.alias("forecast")), "forecast", ["zone"])


def _heat_sql(row: str, name: str) -> str:
    cells = ", ".join(f"avg(load) FILTER (WHERE hour(ts) = {h}) AS h{h}" for h in range(24))
    return sql([READINGS, HOURS], f"SELECT zone, {row} AS {name}, {cells} FROM hours GROUP BY 1, 2",
               "zone", " ".join(f"h{h}" for h in range(24)), name)


@register("heatmap_pivot", _heat_sql("month(ts)", "month"))
def heatmap_pivot(spark, sf_dir):
    return reshape.heatmap(market.hourly_observed(spark, sf_dir), F.month("ts"), "month", "load")


@register("heatmap_pivot_dow", _heat_sql("isodow(ts) - 1", "dow"))
def heatmap_pivot_dow(spark, sf_dir):
    return reshape.heatmap(market.hourly_observed(spark, sf_dir), F.weekday("ts"), "dow", "load")
