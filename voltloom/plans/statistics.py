"""Queries over aggregates, breakdowns, top-k and time-series statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import lookups, profiles, reshape, stats
from ..operators.windows import Chunks
from ..sources import market
from .catalog import DAILY, HOURS, LOG, MARKET, READINGS, TOTAL, register, sql
from .clockwork import DST, HOLIDAYS, STAMPS, holiday_flags

DAY_CHUNKS = Chunks(step_seconds=86_400, size=364)


def _log(spark, sf_dir):
    return market.prediction_log(market.hourly_market(spark, sf_dir))


def _scored(spark, sf_dir):
    return _log(spark, sf_dir).where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


METRIC_SQL = {
    "mae": "avg(abs_error)",
    "rmse": "sqrt(avg(error * error))",
    "mape": "100 * avg(abs(error / y_true)) FILTER (WHERE abs(y_true) > 1e-8)",
    "smape": "100 * avg(abs_error / ((abs(y_true) + abs(y_pred)) / 2)) FILTER (WHERE (abs(y_true) + abs(y_pred)) / 2 > 1e-8)",
}
ALL_METRICS = ", ".join(f"{e} AS {m}" for m, e in METRIC_SQL.items())


def _metric(name: str, metric: str, build) -> None:
    oracle = sql([*LOG], f"SELECT zone, {METRIC_SQL[metric]} AS {metric} FROM errs WHERE error IS NOT NULL GROUP BY zone", "zone", metric)

    @register(name, oracle)
    def run(spark, sf_dir):
        return _scored(spark, sf_dir).groupBy("zone").agg(build().alias(metric))


_metric("agg_mae", "mae", metrics.mae)
_metric("agg_rmse", "rmse", metrics.rmse)
_metric("agg_mape", "mape", metrics.mape)
_metric("agg_smape", "smape", metrics.smape)


@register("metrics_all", sql([*LOG], f"SELECT zone, {ALL_METRICS}, count(*) AS rows FROM errs WHERE error IS NOT NULL GROUP BY zone",
                             "zone", "mae rmse mape smape", "rows"))
def metrics_all(spark, sf_dir):
    return profiles.metrics_by(_log(spark, sf_dir))


@register("metrics_baseline", sql([*LOG], """SELECT zone, avg(abs_error) AS mae, sqrt(avg(error * error)) AS rmse,
  coalesce(100 * avg(abs(error / y_true)) FILTER (WHERE y_true <> 0), 'inf'::DOUBLE) AS mape FROM errs WHERE error IS NOT NULL GROUP BY zone""",
                                  "zone", "mae rmse mape"))
def metrics_baseline(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("zone").agg(*metrics.baseline_metrics())


_ERR = "avg(error) AS error_mean, avg(abs_error) AS mae, count(error) AS count"


@register("err_by_hour", sql([*LOG], f"SELECT hour(ts) AS hour, {_ERR} FROM errs GROUP BY 1", "", "error_mean mae", "hour count"))
def err_by_hour(spark, sf_dir):
    return profiles.error_by_hour(_log(spark, sf_dir))


@register("err_by_dow", sql([*LOG], f"SELECT isodow(ts) - 1 AS dow, strftime(ts, '%a') AS dow_name, {_ERR} FROM errs GROUP BY 1, 2",
                            "dow_name", "error_mean mae", "dow count"))
def err_by_dow(spark, sf_dir):
    return profiles.error_by_dow(_log(spark, sf_dir))


@register("err_by_horizon", sql([*LOG], f"SELECT horizon, {_ERR} FROM errs GROUP BY 1", "", "error_mean mae", "horizon count"))
def err_by_horizon(spark, sf_dir):
    return profiles.error_by_horizon(_log(spark, sf_dir))


@register("err_rollup", sql([*LOG], f"""SELECT coalesce(hour, -1) AS hour, coalesce(dow, -1) AS dow,
  coalesce(horizon, -1) AS horizon, {_ERR}, grouping(hour, dow, horizon) AS level FROM
  (SELECT hour(ts) AS hour, isodow(ts) - 1 AS dow, horizon, error, abs_error FROM errs)
  GROUP BY GROUPING SETS ((hour), (dow), (horizon), ())""", "", "error_mean mae", "hour dow horizon level count"))
def err_rollup(spark, sf_dir):
    rolled = profiles.error_rollup(_log(spark, sf_dir))
    return rolled.na.fill(-1, ["hour", "dow", "horizon"])


FOLDS = f"""folds AS (SELECT zone, iteration, date_trunc('day', ts) AS test_start, {ALL_METRICS} FROM errs
  WHERE error IS NOT NULL GROUP BY 1, 2, 3)"""


def _folds(spark, sf_dir):
    days = _log(spark, sf_dir).withColumn("test_start", F.date_trunc("day", "ts"))
    return profiles.metrics_by(days, ("zone", "iteration", "test_start"))


@register("daily_metrics", sql([*LOG, FOLDS], """SELECT CAST(CAST(test_start AS DATE) AS VARCHAR) AS date, avg(mae) AS mae, avg(rmse) AS rmse,
  avg(mape) AS mape, avg(smape) AS smape FROM folds GROUP BY 1""", "date", "mae rmse mape smape"))
def daily_metrics(spark, sf_dir):
    return profiles.daily_metrics(_folds(spark, sf_dir))


_DESCRIBE = """count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75"""


@register("fold_describe", sql([*LOG, FOLDS], f"""SELECT "column", {_DESCRIBE} FROM (SELECT 'mae' AS "column", mae AS value FROM folds
  UNION ALL SELECT 'rmse', rmse FROM folds UNION ALL SELECT 'mape', mape FROM folds) GROUP BY 1""",
                               '"column"', "mean std min max q25 q50 q75", "count"))
def fold_describe(spark, sf_dir):
    return profiles.describe(_folds(spark, sf_dir), ["mae", "rmse", "mape"])


@register("err_hist", sql([*LOG, "lim AS (SELECT zone, min(error) AS lo, max(error) AS hi FROM errs GROUP BY zone)"], """SELECT zone,
  least(coalesce(floor((error - lo) / nullif((hi - lo) / 50, 0)), 0), 49) + 1 AS bin, count(*) AS count FROM errs JOIN lim USING (zone)
  WHERE error IS NOT NULL GROUP BY 1, 2""", "zone", "", "bin count"))
def err_hist(spark, sf_dir):
    return profiles.error_histogram(_log(spark, sf_dir))


@register("err_box_by_band", sql([*LOG], """SELECT CASE WHEN horizon <= 6 THEN '1-6h' WHEN horizon <= 12 THEN '7-12h'
  WHEN horizon <= 18 THEN '13-18h' ELSE '19-24h' END AS band, min(error) AS low, quantile_cont(error, 0.25) AS q1, median(error) AS median,
  quantile_cont(error, 0.75) AS q3, max(error) AS high FROM errs WHERE error IS NOT NULL GROUP BY 1""", "band", "low q1 median q3 high"))
def err_box_by_band(spark, sf_dir):
    return profiles.error_box(_log(spark, sf_dir))


@register("profile_hour", sql([READINGS, HOURS], """SELECT zone, hour(ts) AS hour, avg(load) AS mean, stddev_samp(load) AS std,
  median(load) AS median FROM hours GROUP BY 1, 2""", "zone", "mean std median", "hour"))
def profile_hour(spark, sf_dir):
    return profiles.profile_hour(market.hourly_observed(spark, sf_dir), "load")


@register("profile_dow", sql([*DAILY], """SELECT zone, isodow(ts) - 1 AS dow, avg(load) AS mean, stddev_samp(load) AS std, count(load) AS count
  FROM daily GROUP BY 1, 2""", "zone", "mean std", "dow count"))
def profile_dow(spark, sf_dir):
    return profiles.profile_dow(market.daily_orders(spark, sf_dir), "load")


@register("profile_month", sql([*DAILY], "SELECT zone, month(ts) AS month, avg(load) AS mean, stddev_samp(load) AS std FROM daily GROUP BY 1, 2",
                               "zone", "mean std", "month"))
def profile_month(spark, sf_dir):
    return profiles.profile_month(market.daily_orders(spark, sf_dir), "load")


@register("moments", sql([READINGS, HOURS], f"""SELECT zone, {_DESCRIBE}, skewness(value) AS skewness, kurtosis(value) AS kurtosis
  FROM (SELECT zone, load AS value FROM hours) GROUP BY zone""", "zone", "mean std min max q25 q50 q75 skewness kurtosis", "count"))
def moments(spark, sf_dir):
    return profiles.moments(market.hourly_observed(spark, sf_dir), "load")


_FUELS = ("gen_solar", "gen_wind", "gen_gas", "gen_hydro")


@register("table_summary", sql([*MARKET], f"""SELECT zone, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS hours, count(*) / 24.0 AS days,
  avg(price) AS price_mean, median(price) AS price_median, stddev_samp(price) AS price_std, min(price) AS price_min, max(price) AS price_max,
  count(*) FILTER (WHERE price < 0) AS negative_hours, 100.0 * count(*) FILTER (WHERE price < 0) / count(*) AS negative_pct,
  count(*) FILTER (WHERE price > 100) AS spike_hours, 100.0 * count(*) FILTER (WHERE price > 100) / count(*) AS spike_pct,
  avg(load) AS load_mean, max(load) AS load_peak, min(load) AS load_min, {", ".join(f"avg({f}) AS {f}_mean" for f in _FUELS)}
  FROM market GROUP BY zone""", "zone first_ts last_ts", "days price_mean price_median price_std price_min price_max negative_pct spike_pct "
  "load_mean load_peak load_min " + " ".join(f"{f}_mean" for f in _FUELS), "hours negative_hours spike_hours"))
def table_summary(spark, sf_dir):
    return profiles.table_summary(market.hourly_market(spark, sf_dir))


@register("quality_profile", sql([*MARKET], """SELECT zone, count(*) AS rows, 13 AS columns, min(ts) AS first_ts, max(ts) AS last_ts,
  floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS span_days, count(*) - count(load) AS missing FROM market GROUP BY zone""",
                                 "zone first_ts last_ts", "", "rows columns span_days missing"))
def quality_profile(spark, sf_dir):
    return profiles.quality_profile(market.hourly_market(spark, sf_dir), "load")


ZS = "zs AS (SELECT zone, ts, load, (load - avg(load) OVER (PARTITION BY zone)) / stddev_samp(load) OVER (PARTITION BY zone) AS z_score FROM hours)"


@register("zscore_outliers", sql([READINGS, HOURS, ZS], "SELECT zone, count(*) AS rows, " + ", ".join(
    f"count(*) FILTER (WHERE abs(z_score) > {k}) AS over_{k}, 100.0 * count(*) FILTER (WHERE abs(z_score) > {k}) / count(*) AS over_{k}_pct"
    for k in (2, 3, 4)) + " FROM zs GROUP BY zone", "zone", "over_2_pct over_3_pct over_4_pct", "rows over_2 over_3 over_4"))
def zscore_outliers(spark, sf_dir):
    return profiles.outlier_counts(market.hourly_observed(spark, sf_dir).select("zone", "ts", "load"), "load")


@register("zscore_outlier_rows", sql([READINGS, HOURS, ZS], "SELECT * FROM zs WHERE abs(z_score) > 2", "zone ts", "load z_score"))
def zscore_outlier_rows(spark, sf_dir):
    return profiles.outlier_rows(market.hourly_observed(spark, sf_dir).select("zone", "ts", "load"), "load")


@register("holiday_effect", sql([READINGS, HOURS, HOLIDAYS, f"m AS (SELECT zone, ts, load, {holiday_flags('ts')} FROM hours)",
                                 """s AS (SELECT zone, avg(load) FILTER (WHERE is_holiday = 1 OR isodow(ts) >= 6) AS holiday_mean,
  avg(load) FILTER (WHERE NOT (is_holiday = 1 OR isodow(ts) >= 6)) AS weekday_mean FROM m GROUP BY zone)"""],
                                "SELECT *, weekday_mean - holiday_mean AS difference, 100 * (weekday_mean - holiday_mean) / weekday_mean AS difference_pct FROM s",
                                "zone", "holiday_mean weekday_mean difference difference_pct"))
def holiday_effect(spark, sf_dir):
    flagged = lookups.holiday_lookup(market.hourly_observed(spark, sf_dir).select("zone", "ts", "load"))
    return profiles.holiday_effect(flagged, "load")


@register("seasonal_bucket", sql([READINGS, HOURS], "SELECT zone, isodow(ts) - 1 AS dow, hour(ts) AS hour, avg(price) AS seasonal FROM hours GROUP BY 1, 2, 3",
                                 "zone", "seasonal", "dow hour"))
def seasonal_bucket(spark, sf_dir):
    return lookups.seasonal_means(market.hourly_observed(spark, sf_dir), "price")


@register("horizon_pick", sql([*LOG], "SELECT horizon, avg(abs_error) AS mae FROM errs WHERE horizon IN (1, 24) GROUP BY 1", "", "mae", "horizon"))
def horizon_pick(spark, sf_dir):
    return profiles.horizon_pick(_log(spark, sf_dir))


# ── last rows, set operations ───────────────────────────────────────────────


@register("last_n_rows", sql([READINGS, HOURS], """SELECT zone, ts, price, from_end FROM (SELECT *, row_number() OVER (PARTITION BY zone
  ORDER BY ts DESC) AS from_end FROM hours) WHERE from_end <= 100""", "zone ts", "price", "from_end"))
def last_n_rows(spark, sf_dir):
    hours = market.hourly_observed(spark, sf_dir).select("zone", "ts", "price")
    return reshape.last_rows(hours, 100, Chunks(size=48))


@register("last_row", sql([READINGS, HOURS], "SELECT zone, ts, price, load FROM hours QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts DESC) = 1",
                          "zone ts", "price load"))
def last_row(spark, sf_dir):
    return reshape.last_row(market.hourly_observed(spark, sf_dir).select("zone", "ts", "price", "load"))


@register("append_rows", sql([*LOG], """SELECT zone, ts, price FROM hours UNION ALL SELECT zone, ts + INTERVAL 24 HOUR, price FROM hours
  QUALIFY row_number() OVER (PARTITION BY zone ORDER BY ts DESC) <= 24""", "zone ts", "price"))
def append_rows(spark, sf_dir):
    hours = market.hourly_observed(spark, sf_dir).select("zone", "ts", "price")
    ahead = reshape.last_rows(hours, 24).select("zone", (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("ts"), "price")
    return reshape.append_rows(hours, ahead)


@register("flag_or", sql([STAMPS, f"f AS (SELECT o_orderkey, isodow(ts) >= 6 AS is_weekend, {DST} FROM stamps)"], """SELECT o_orderkey,
  is_dst_spring = 1 OR is_dst_autumn = 1 OR is_weekend AS special FROM f""", "o_orderkey", "", "special"))
def flag_or(spark, sf_dir):
    from ..functions import clock
    from .clockwork import stamps

    ts = F.col("ts")
    flags = {**clock.dst_flags(ts), "is_weekend": clock.basic(ts)["is_weekend"]}
    marked = stamps(spark, sf_dir).withColumns(flags)
    return marked.select("o_orderkey", reshape.any_flag("is_dst_spring", "is_dst_autumn", "is_weekend").alias("special"))


# ── time-series statistics ──────────────────────────────────────────────────


def _acf_ctes(ctes, frm: str, value: str, lags: int, unit: str) -> list[str]:
    return [*ctes, f"s AS (SELECT zone, ts, {value} AS x FROM {frm} WHERE {value} IS NOT NULL)",
            "m AS (SELECT zone, avg(x) AS mu, count(*) AS n, var_pop(x) AS v FROM s GROUP BY zone)",
            "e AS (SELECT s.zone, ts, x - mu AS d, v, n FROM s JOIN m USING (zone))",
            f"""r AS (SELECT a.zone, l AS lag, sum(a.d * b.d) / any_value(a.n * a.v) AS acf FROM e a CROSS JOIN range(0, {lags + 1}) q(l)
  JOIN e b ON b.zone = a.zone AND b.ts = a.ts - {unit}(CAST(l AS INT)) GROUP BY 1, 2)"""]


def _acf_sql(*args) -> str:
    return sql(_acf_ctes(*args), "SELECT * FROM r", "zone", "acf", "lag")


# Partial autocorrelations by the order recursion, one order per step.
PACF_SQL = sql([
    *_acf_ctes(TOTAL, "market", "load", 72, "to_hours"),
    "rl AS (SELECT zone, list(acf ORDER BY lag) FILTER (WHERE lag > 0) AS rho FROM r GROUP BY zone)",
    """dl AS (SELECT zone, 0 AS k, []::DOUBLE[] AS phi, 1.0::DOUBLE AS v, 1.0::DOUBLE AS p, rho FROM rl UNION ALL
  SELECT zone, k + 1, list_concat(list_transform(phi, lambda x, i: x - nx * phi[k - i + 1]), [nx]), v * (1 - nx * nx), nx, rho FROM
  (SELECT *, (rho[k + 1] - CASE WHEN k = 0 THEN 0 ELSE list_inner_product(phi, list_reverse(rho[1:k])) END) / v AS nx FROM dl WHERE k < 72))""",
], "SELECT zone, k AS lag, p AS pacf FROM dl", "zone", "pacf", "lag")


def _eliminate(name: str, rows: str) -> list[str]:
    """One pivot per step on the cross-products of the lists ``z``; the last corner is the residual sum."""
    return [
        f"{name}c AS (SELECT zone, series, i, j, sum(z[i] * z[j]) AS v FROM (SELECT zone, series, z, unnest(range(1, len(z) + 1)) AS i FROM {rows}), "
        f"range(1, 300) b(j) WHERE j <= len(z) GROUP BY ALL)",
        f"{name}r AS (SELECT zone, series, i, list(v ORDER BY j) AS r FROM {name}c GROUP BY ALL)",
        f"{name}m AS (SELECT zone, series, list(r ORDER BY i) AS m FROM {name}r GROUP BY ALL)",
        f"{name} AS (SELECT zone, series, 0 AS p, m FROM {name}m UNION ALL SELECT zone, series, p + 1, list_transform(m, lambda r, i: CASE WHEN i = p + 1 "
        f"THEN list_transform(r, lambda x: x / m[p + 1][p + 1]) ELSE list_transform(r, lambda x, j: x - r[p + 1] * m[p + 1][j] / m[p + 1][p + 1]) END) "
        f"FROM {name} WHERE p < len(m) - 1)",
    ]


def _poly(terms) -> str:
    return " + ".join(f"({c}) * pow(statistic, {i})" for i, c in enumerate(terms))


_NORMAL = ("0.5 + exp(-zz * zz / 2) / sqrt(2 * pi()) * sign(zz) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(greatest(abs(zz), 1e-300)) "
           "- lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))")
ADF_SQL = sql([
    *TOTAL,
    "lv AS (SELECT zone, ts, load, load - lag(load) OVER w AS load_diff_1, load - lag(load, 24) OVER w AS load_diff_24 FROM market "
    "WINDOW w AS (PARTITION BY zone ORDER BY ts))",
    "ser AS (" + " UNION ALL ".join(f"SELECT zone, '{c}' AS series, ts, {c} AS x FROM lv WHERE {c} IS NOT NULL" for c in ("load", "load_diff_1", "load_diff_24")) + ")",
    "pos AS (SELECT zone, series, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY zone, series) AS n, lag(x) OVER w AS x1, x - lag(x) OVER w AS dx "
    "FROM ser WINDOW w AS (PARTITION BY zone, series ORDER BY ts))",
    "lg AS (SELECT *, least(n // 2 - 2, CAST(ceil(12 * pow(n / 100.0, 0.25)) AS BIGINT)) AS top, list_reverse(list(dx) OVER (PARTITION BY zone, series "
    "ORDER BY t ROWS BETWEEN 254 PRECEDING AND 1 PRECEDING)) AS past FROM pos)",
    "za AS (SELECT zone, series, list_concat([1.0::DOUBLE, x1], past[1:top], [dx]) AS z FROM lg WHERE t >= top + 1)",
    *_eliminate("ea", "za"),
    "best AS (SELECT ea.zone, ea.series, n, arg_min(p - 2, n1 * (ln(2 * pi() * m[len(m)][len(m)] / n1) + 1) + 2 * p) AS used FROM ea JOIN "
    "(SELECT DISTINCT zone, series, n, n - top - 1 AS n1 FROM lg) q ON q.zone = ea.zone AND q.series = ea.series WHERE p >= 2 GROUP BY ALL)",
    "zb AS (SELECT lg.zone, lg.series, list_concat([1.0::DOUBLE], past[1:used], [x1, dx]) AS z FROM lg JOIN best b ON b.zone = lg.zone AND b.series = lg.series "
    "WHERE t >= used + 1)",
    *_eliminate("eb", "zb"),
    "st AS (SELECT a.zone, a.series, used AS lags_used, n - used - 1 AS observations, sign(a.m[len(a.m) - 1][len(a.m)]) * sqrt((a.m[len(a.m)][len(a.m)] "
    "- b.m[len(b.m)][len(b.m)]) / (b.m[len(b.m)][len(b.m)] / (n - 2 * used - 3))) AS statistic FROM eb a JOIN eb b ON b.zone = a.zone AND b.series = a.series "
    "AND b.p = a.p + 1 AND b.p = len(b.m) - 1 JOIN best ON best.zone = a.zone AND best.series = a.series)",
    f"pz AS (SELECT *, CASE WHEN statistic <= {stats.ADF_TAU_SWITCH} THEN {_poly(stats.ADF_SMALL_P)} ELSE {_poly(stats.ADF_LARGE_P)} END AS zz FROM st)",
], f"""SELECT zone, series, statistic, CASE WHEN statistic > {stats.ADF_TAU_RANGE[1]} THEN 1 WHEN statistic < {stats.ADF_TAU_RANGE[0]} THEN 0
  WHEN zz < -8 THEN 0 ELSE {_NORMAL} END AS p_value, lags_used, observations, """ + ", ".join(
    " + ".join(f"({c}) / pow(observations, {i})" for i, c in enumerate(cs)) + f" AS {name}" for name, cs in stats.ADF_CRITICAL.items()
) + " FROM pz", "zone series", "statistic p_value crit_1 crit_5 crit_10", "lags_used observations", digits=4)


@register("acf", _acf_sql(TOTAL, "market", "load", 400, "to_hours"))
def acf(spark, sf_dir):
    return stats.acf(market.hourly_total(spark, sf_dir).select("zone", "ts", "load"), "load", 400)


@register("acf_by_zone", _acf_sql(DAILY, "daily", "load", 60, "to_days"))
def acf_by_zone(spark, sf_dir):
    return stats.acf(market.daily_orders(spark, sf_dir), "load", 60, DAY_CHUNKS)


@register("pacf", PACF_SQL)
def pacf(spark, sf_dir):
    return stats.pacf(market.hourly_total(spark, sf_dir).select("zone", "ts", "load"), "load", 72)


def _adf(spark, sf_dir):
    """Level, first and 24-hour difference of the total load."""
    from ..operators.windows import difference

    hourly = market.hourly_total(spark, sf_dir).select("zone", "ts", "load")
    parts = difference(hourly, "load", (1, 24))
    return parts.unpivot(["zone", "ts"], ["load", "load_diff_1", "load_diff_24"], "series", "x")


@register("adf", ADF_SQL, digits=4)
def adf(spark, sf_dir):
    return stats.adf(_adf(spark, sf_dir), "x", Chunks(keys=("zone", "series")))


KPSS_SQL = sql([
    *DAILY,
    "s AS (SELECT zone, row_number() OVER (PARTITION BY zone ORDER BY ts) AS pos, load AS x FROM daily WHERE load IS NOT NULL)",
    "m AS (SELECT zone, avg(x) AS mu, count(*) AS n FROM s GROUP BY zone)",
    "e AS (SELECT zone, pos, x - mu AS d, n FROM s JOIN m USING (zone))",
    "p AS (SELECT a.zone, any_value(a.n) AS n, l, sum(a.d * b.d) AS cp FROM e a CROSS JOIN range(0, 400) r(l) JOIN e b ON b.zone = a.zone "
    "AND b.pos = a.pos - l GROUP BY 1, 3)",
    "h AS (SELECT zone, n, sum(CASE WHEN l = 0 THEN cp / n ELSE cp / (n / 2.0) END) AS s0, sum(l * cp / (n / 2.0)) AS s1 FROM p "
    "WHERE l <= floor(pow(n, 2.0 / 9)) GROUP BY 1, 2)",
    "w AS (SELECT zone, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS lags_used FROM h)",
    "v AS (SELECT zone, n, lags_used, sum(CASE WHEN l = 0 THEN cp ELSE 2 * cp * (1 - l / (lags_used + 1)) END) / n AS lr FROM p "
    "JOIN w USING (zone) WHERE l <= lags_used GROUP BY 1, 2, 3)",
    "c AS (SELECT zone, sum(d) OVER (PARTITION BY zone ORDER BY pos) AS s FROM e)",
    "t AS (SELECT zone, sum(s * s) AS ss FROM c GROUP BY zone)",
    "z AS (SELECT zone, ss / (n * n) / lr AS statistic, lags_used, n AS rows FROM t JOIN v USING (zone))",
], """SELECT *, CASE WHEN statistic <= 0.347 THEN 0.1 WHEN statistic <= 0.463 THEN 0.1 - (statistic - 0.347) * 0.05 / 0.116
  WHEN statistic <= 0.574 THEN 0.05 - (statistic - 0.463) * 0.025 / 0.111 WHEN statistic <= 0.739
  THEN 0.025 - (statistic - 0.574) * 0.015 / 0.165 ELSE 0.01 END AS p_value FROM z""", "zone", "statistic p_value", "lags_used rows")


@register("kpss", KPSS_SQL)
def kpss(spark, sf_dir):
    return stats.kpss(market.daily_orders(spark, sf_dir), "load", DAY_CHUNKS)


@register("normality", sql([READINGS, HOURS, """m AS (SELECT zone, avg(load) AS mu FROM hours GROUP BY zone)""",
                            """c AS (SELECT zone, count(*) AS rows, avg(pow(load - mu, 2)) AS m2, avg(pow(load - mu, 3)) AS m3,
  avg(pow(load - mu, 4)) AS m4 FROM hours JOIN m USING (zone) GROUP BY zone)""",
                            "k AS (SELECT zone, rows, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM c)",
                            "j AS (SELECT *, rows / 6.0 * (skewness * skewness + kurtosis * kurtosis / 4) AS statistic FROM k)"],
                           "SELECT *, exp(-statistic / 2) AS p_value FROM j", "zone", "skewness kurtosis statistic p_value", "rows"))
def normality(spark, sf_dir):
    return stats.normality(market.hourly_observed(spark, sf_dir), "load")


@register("normality_ks")
def normality_ks(spark, sf_dir):
    return stats.ks_normality(market.hourly_observed(spark, sf_dir), "load")
