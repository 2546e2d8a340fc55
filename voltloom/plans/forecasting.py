"""Queries over baselines, models, forecasts and backtests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..operators import backtest as walk
from ..operators import baselines, boosting, features, forecast, linear, profiles, slabs
from ..operators.reshape import median_impute
from ..session import checkpoint
from ..sources import market
from .catalog import MARKET, TOTAL, register, sql
from .clockwork import CYCLES, DST, HOLIDAYS, SHARE, SOLAR_RATIO, holiday_flags
from .statistics import METRIC_SQL
from .windowed import PCT, WEATHER, frame

# Small enough for a test machine; every row still takes part.
BOOST = boosting.BoostConfig(max_depth=4, n_estimators=10, learning_rate=0.3, min_train_size=120, val_size=72, step=72)
WALK = walk.BacktestConfig(train_min=480, step=72, horizon=24, n_estimators=5, max_depth=4)
MODEL_FEATURES = (
    [f"price_lag_{k}h" for k in features.LAGS]
    + ["price_weekly_delta", "price_pct_change_24h", "price_roll_mean_24h", "price_roll_zscore_24h",
       "price_roll_mean_168h", "price_roll_zscore_168h", "price_vs_7d_mean"]
    + [f"weather_{v}_{kind}" for v in WEATHER for kind in ("raw", "roll6h", "roll24h", "anomaly")]
    + ["solar_estimated_cf", "residual_load", "renewable_share", "net_import", "load_roll24h", "load_pct_of_7d",
       "is_holiday", "is_holiday_eve", "hour", "day_of_week", "month", "is_weekend", "day_of_year", "week_of_year", "part_of_day",
       "is_dst_spring", "is_dst_autumn", "is_dst_transition", "hour_of_week", "hour_sin", "hour_cos",
       "dow_sin", "dow_cos", "doy_sin", "doy_cos", "month_sin", "month_cos"]
)


def _market(spark, sf_dir):
    return market.hourly_market(spark, sf_dir)


def _stored_market(spark, sf_dir):
    return market.stored(market.hourly_market(spark, sf_dir))


def _price(spark, sf_dir):
    return _market(spark, sf_dir).select("zone", "ts", "price")


def _total_price(spark, sf_dir):
    """One series over all zones: strict rolling windows need unbroken hours."""
    return market.hourly_total(spark, sf_dir).select("zone", "ts", "price")


# ── baselines ───────────────────────────────────────────────────────────────

ENDS = "ends AS (SELECT zone, max(ts) AS origin, count(*) AS n FROM market GROUP BY zone)"
AHEAD = "ahead AS (SELECT zone, n, origin, h AS horizon, origin + to_hours(CAST(h AS INT)) AS ts FROM ends, range(1, 25) r(h))"


@register("fc_persist_tail", sql([*MARKET, ENDS, AHEAD], """SELECT a.zone, a.origin, a.horizon, a.ts, m.price AS y_pred FROM ahead a
  LEFT JOIN market m ON m.zone = a.zone AND m.ts = a.ts - INTERVAL 24 HOUR""", "zone origin ts", "y_pred", "horizon"))
def fc_persist_tail(spark, sf_dir):
    return baselines.persistence_tail(_price(spark, sf_dir), 24)


@register("fc_persist_lag24", sql([*MARKET], """SELECT a.zone, a.ts, a.price, b.price AS y_pred FROM market a LEFT JOIN market b
  ON b.zone = a.zone AND b.ts = a.ts - INTERVAL 24 HOUR""", "zone ts", "price y_pred"))
def fc_persist_lag24(spark, sf_dir):
    return baselines.persistence_lag(_price(spark, sf_dir))


@register("fc_hist_hourly", sql([*MARKET, ENDS, AHEAD, """recent AS (SELECT m.zone, hour(ts) AS hour, avg(price) AS y_pred FROM market m
  JOIN ends e ON e.zone = m.zone AND m.ts > e.origin - INTERVAL 96 HOUR GROUP BY 1, 2)"""], """SELECT a.zone, origin, horizon, ts, y_pred
  FROM ahead a LEFT JOIN recent r ON r.zone = a.zone AND r.hour = hour(a.ts)""", "zone origin ts", "y_pred", "horizon"))
def fc_hist_hourly(spark, sf_dir):
    return baselines.historical_hourly(_price(spark, sf_dir), 4)


@register("fc_seasonal", sql([*MARKET, ENDS, """s AS (SELECT m.zone, isodow(ts) AS dow, hour(ts) AS hour, avg(price) AS y_pred FROM market m
  JOIN ends e ON e.zone = m.zone AND m.ts > e.origin - INTERVAL 28 DAY GROUP BY 1, 2, 3)"""], """SELECT m.zone, m.ts, m.price, y_pred FROM market m
  LEFT JOIN s ON s.zone = m.zone AND s.dow = isodow(m.ts) AND s.hour = hour(m.ts)""", "zone ts", "price y_pred"))
def fc_seasonal(spark, sf_dir):
    prices = _price(spark, sf_dir)
    return baselines.seasonal_forecast(prices, prices, weeks=4)


LINEAR_NAMES = baselines.linear_feature_names()
_INDICATORS = {
    **{f"h_{k}": f"CASE WHEN hour(ts) = {k} THEN 1 ELSE 0 END" for k in range(24)},
    **{f"dow_{k}": f"CASE WHEN isodow(ts) = {k + 1} THEN 1 ELSE 0 END" for k in range(7)},
    **{f"mon_{k}": f"CASE WHEN month(ts) = {k} THEN 1 ELSE 0 END" for k in range(1, 13)},
}
LINEAR = [
    *TOTAL,
    "num AS (SELECT zone, ts, price, row_number() OVER (PARTITION BY zone ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY zone) AS n, "
    + ", ".join(f"lag(price, {k}) OVER (PARTITION BY zone ORDER BY ts) AS lag_{k}h" for k in baselines.LINEAR_LAGS) + ", "
    + ", ".join(f"CASE WHEN count(price) {frame(n)} = {n} THEN {fn}(price) {frame(n)} END AS roll_{kind}_{n}h"
                for n in baselines.LINEAR_WINDOWS for kind, fn in (("mean", "avg"), ("std", "stddev_samp")))
    + ", " + ", ".join(f"{e} AS {c}" for c, e in _INDICATORS.items()) + " FROM market)",
    "lin AS (SELECT * FROM num WHERE price IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in LINEAR_NAMES[:7]) + ")",
]


@register("linear_features", sql(LINEAR, "SELECT * FROM lin", "zone ts", "price " + " ".join(LINEAR_NAMES[:7]), " ".join(LINEAR_NAMES[7:])))
def linear_features(spark, sf_dir):
    return baselines.linear_features(_total_price(spark, sf_dir))


def least_squares(rows: str, by: str, names=tuple(LINEAR_NAMES)) -> list[str]:
    """Normal equations by elimination, one pivot per recursion step; a pivot lost to collinearity is
    skipped and its weight is zero, which leaves the fitted values as they are. Leaves ``coefs``."""
    k = len(names) + 1
    z = "[1.0::DOUBLE, " + ", ".join(f"{c}::DOUBLE" for c in names) + ", price::DOUBLE]"
    keys = ", ".join(by.split())
    return [
        f"zrows AS (SELECT {keys}, {z} AS z FROM {rows})",
        f"cells AS (SELECT {keys}, i, j, sum(z[i] * z[j]) AS v FROM zrows, range(1, {k + 1}) a(i), range(1, {k + 2}) b(j) GROUP BY ALL)",
        f"lines AS (SELECT {keys}, i, list(v ORDER BY j) AS r FROM cells GROUP BY {keys}, i)",
        f"mats AS (SELECT {keys}, list(r ORDER BY i) AS m, list(r[i] ORDER BY i) AS d FROM lines GROUP BY {keys})",
        f"elim AS (SELECT {keys}, 1 AS p, m, d FROM mats UNION ALL SELECT {keys}, p + 1, "
        "CASE WHEN m[p][p] <= 1e-6 * d[p] OR d[p] = 0 THEN m ELSE list_transform(m, lambda r, i: CASE WHEN i = p "
        "THEN list_transform(r, lambda x: x / m[p][p]) ELSE list_transform(r, lambda x, j: x - r[p] * m[p][j] / m[p][p]) END) END, d "
        f"FROM elim WHERE p <= {k})",
        f"coefs AS (SELECT {keys}, list_transform(m, lambda r, i: CASE WHEN abs(r[i] - 1) < 0.01 THEN r[{k + 1}] ELSE 0 END) AS c FROM elim WHERE p = {k + 1})",
    ]


def fitted(table: str) -> str:
    return "c[1] + " + " + ".join(f"c[{i + 2}] * {table}.{f}" for i, f in enumerate(LINEAR_NAMES))


@register("fit_ols", sql([*LINEAR, *least_squares("lin", "zone")], f"SELECT lin.zone, ts, price, {fitted('lin')} AS y_pred FROM lin JOIN coefs USING (zone)",
                         "zone ts", "price y_pred", digits=4), digits=4)
def fit_ols(spark, sf_dir):
    matrix = baselines.linear_features(_total_price(spark, sf_dir))
    coefs = linear.fit_ols(matrix, LINEAR_NAMES)
    return linear.score_linear(matrix, coefs, LINEAR_NAMES).select("zone", "ts", "price", "y_pred")


RIDGE_NAMES = ["price_lag_24h", "price_lag_48h", "price_lag_168h", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
_K = len(RIDGE_NAMES)
_DOT = "list_inner_product({}, z)".format
RIDGE = [
    *MARKET,
    "fr AS (SELECT zone, ts, price, " + ", ".join(f"lag(price, {k}) OVER (PARTITION BY zone ORDER BY ts) AS price_lag_{k}h" for k in (24, 48, 168))
    + f", {CYCLES['hour']}, {CYCLES['dow']} FROM market)",
    "fm AS (SELECT zone, " + ", ".join(f"median({c}) AS {c}" for c in RIDGE_NAMES[:3]) + " FROM fr WHERE price IS NOT NULL GROUP BY zone)",
    "fi AS (SELECT fr.zone, ts, price, [" + ", ".join(f"coalesce(fr.{c}, fm.{c})" for c in RIDGE_NAMES[:3]) + ", " + ", ".join(RIDGE_NAMES[3:])
    + "]::DOUBLE[] AS x FROM fr JOIN fm ON fm.zone = fr.zone WHERE price IS NOT NULL)",
    "fs AS (SELECT zone, avg(price) AS my, CAST(count(*) AS DOUBLE) AS n, [" + ", ".join(f"avg(x[{i + 1}])" for i in range(_K)) + "] AS mx, ["
    + ", ".join(f"stddev_pop(x[{i + 1}])" for i in range(_K)) + "] AS sx FROM fi GROUP BY zone)",
    "zr AS (SELECT fi.zone, ts, price, price - my AS y, my, n, list_transform(x, lambda v, i: (v - mx[i]) / sx[i]) AS z FROM fi JOIN fs ON fs.zone = fi.zone)",
    f"ga AS (SELECT zone, i, j, sum(z[i] * z[j]) AS v, sum(z[i] * y) AS b FROM zr, range(1, {_K + 1}) a(i), range(1, {_K + 1}) b(j) GROUP BY ALL)",
    "gl AS (SELECT zone, q, i, list_concat(list(v + CASE WHEN i = j THEN pow(10, -3 + 6 * q / 49.0) ELSE 0 END ORDER BY j), [any_value(b)], "
    f"list_transform(range(1, {_K + 1}), lambda c: CASE WHEN c = i THEN 1.0 ELSE 0.0 END)) AS r FROM ga, range(0, 50) a(q) GROUP BY zone, q, i)",
    "gm AS (SELECT zone, q, list(r ORDER BY i) AS m FROM gl GROUP BY zone, q)",
    "ge AS (SELECT zone, q, 0 AS p, m FROM gm UNION ALL SELECT zone, q, p + 1, list_transform(m, lambda r, i: CASE WHEN i = p + 1 "
    "THEN list_transform(r, lambda v: v / m[p + 1][p + 1]) ELSE list_transform(r, lambda v, j: v - r[p + 1] * m[p + 1][j] / m[p + 1][p + 1]) END) "
    f"FROM ge WHERE p < {_K})",
    f"gs AS (SELECT zone, q, list_transform(m, lambda r: r[{_K + 1}]) AS w, list_transform(m, lambda r: r[{_K + 2}:{2 * _K + 1}]) AS inv FROM ge WHERE p = {_K})",
    f"lo AS (SELECT gs.zone, q, avg(pow((y - {_DOT('w')}) / (1 - 1 / n - list_sum(list_transform(inv, lambda r, i: z[i] * {_DOT('r')}))), 2)) AS loo_mse "
    "FROM zr JOIN gs ON gs.zone = zr.zone GROUP BY 1, 2)",
    "bq AS (SELECT zone, arg_min(q, loo_mse) AS q, min(loo_mse) AS loo_mse FROM lo GROUP BY zone)",
    f"rp AS (SELECT zr.zone, ts, price, my + {_DOT('w')} AS y_pred, pow(10, -3 + 6 * bq.q / 49.0) AS alpha, loo_mse FROM zr JOIN bq ON bq.zone = zr.zone "
    "JOIN gs ON gs.zone = bq.zone AND gs.q = bq.q)",
]


def _ridge(spark, sf_dir):
    """Lag and cyclical features with medians for missing lags, and the ridge fit on them."""
    table = features.build_features(_price(spark, sf_dir), features.FeatureSpec())
    rows = median_impute(table.where(F.col("price").isNotNull()).select("zone", "ts", "price", *RIDGE_NAMES), RIDGE_NAMES[:3])
    rows = checkpoint(rows)  # the fit and the scoring pass over it several times
    return rows, linear.fit_ridge_cv(rows, RIDGE_NAMES)


@register("fit_ridge_cv", sql(RIDGE, """SELECT zone, any_value(alpha) AS alpha, any_value(loo_mse) AS loo_mse, avg(abs(price - y_pred)) AS mae,
  sqrt(avg(pow(price - y_pred, 2))) AS rmse, count(*) AS rows FROM rp GROUP BY zone""", "zone", "alpha loo_mse mae rmse", "rows", digits=4), digits=4)
def fit_ridge_cv(spark, sf_dir):
    rows, fit = _ridge(spark, sf_dir)
    scored = linear.score_linear(rows, fit, RIDGE_NAMES).withColumn("y_true", F.col("price"))
    return fit.select("zone", "alpha", "loo_mse").join(profiles.metrics_by(scored), "zone").drop("mape", "smape")


@register("ridge_impute_fit", sql(RIDGE, "SELECT zone, ts, price, y_pred FROM rp", "zone ts", "price y_pred", digits=4), digits=4)
def ridge_impute_fit(spark, sf_dir):
    rows, fit = _ridge(spark, sf_dir)
    return linear.score_linear(rows, fit, RIDGE_NAMES).select("zone", "ts", "price", "y_pred")


@register("ridge_linear_matrix")
def ridge_linear_matrix(spark, sf_dir):
    """Penalty, leave-one-out error and errors of the fit on the whole linear feature matrix."""
    matrix = baselines.linear_features(_total_price(spark, sf_dir))
    fit = linear.fit_ridge_cv(matrix, LINEAR_NAMES)
    scored = linear.score_linear(matrix, fit, LINEAR_NAMES).withColumn("y_true", F.col("price"))
    return fit.select("zone", "alpha", "loo_mse").join(profiles.metrics_by(scored), "zone")


_BASE = """log AS (
  SELECT a.zone, 'persistence' AS model, a.price AS y_true, b.price AS y_pred FROM num a JOIN num b ON b.zone = a.zone
    AND b.pos = a.pos - (a.n - floor(a.n * 0.8)) WHERE a.pos >= floor(a.n * 0.8) AND b.pos < floor(b.n * 0.8)
  UNION ALL SELECT a.zone, 'historical_avg_4wk', a.price, h.m FROM num a JOIN (SELECT zone, hour(ts) AS hour, avg(price) AS m FROM num
    WHERE pos < floor(n * 0.8) AND pos >= floor(n * 0.8) - 96 GROUP BY 1, 2) h ON h.zone = a.zone AND h.hour = hour(a.ts) WHERE a.pos >= floor(a.n * 0.8)
  UNION ALL SELECT lin.zone, 'linear_regression', lin.price, """ + fitted("lin") + """ FROM lin JOIN coefs USING (zone) WHERE pos >= floor(n * 0.8))"""


@register("run_baselines", sql([*LINEAR, "trainrows AS (SELECT * FROM lin WHERE pos < floor(n * 0.8))", *least_squares("trainrows", "zone"), _BASE],
                               """SELECT zone, model, avg(abs(y_true - y_pred)) AS mae, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse,
  100 * avg(abs((y_true - y_pred) / y_true)) FILTER (WHERE y_true <> 0) AS mape, count(*) AS rows FROM log
  WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY 1, 2""", "zone model", "mae rmse mape", "rows", digits=4), digits=4)
def run_baselines(spark, sf_dir):
    return baselines.run_baselines(_total_price(spark, sf_dir))


_COMPARE = [
    *MARKET,
    "num AS (SELECT zone, ts, price, row_number() OVER (PARTITION BY zone ORDER BY ts) - 1 < floor(count(*) OVER (PARTITION BY zone) * 0.8) AS tr, "
    "lag(price, 24) OVER (PARTITION BY zone ORDER BY ts) AS persistence FROM market)",
    "s AS (SELECT zone, isodow(ts) AS dow, hour(ts) AS hour, avg(price) AS m FROM num WHERE tr GROUP BY 1, 2, 3)",
    "t AS (SELECT n.zone, ts, price AS y_true, persistence, m AS seasonal_avg_4w FROM num n LEFT JOIN s ON s.zone = n.zone AND s.dow = isodow(ts) "
    "AND s.hour = hour(ts) WHERE NOT tr)",
]


@register("baseline_table", sql(_COMPARE, "SELECT * FROM t", "zone ts", "y_true persistence seasonal_avg_4w"))
def baseline_table(spark, sf_dir):
    return baselines.baseline_table(_price(spark, sf_dir))


@register("compare_baselines", sql([*_COMPARE, """errs AS (SELECT zone, model, y_true, y_pred, y_true - y_pred AS error, abs(y_true - y_pred) AS abs_error FROM
  (SELECT zone, 'persistence' AS model, y_true, persistence AS y_pred FROM t UNION ALL SELECT zone, 'seasonal_avg_4w', y_true, seasonal_avg_4w FROM t)
  WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"""], "SELECT zone, model, " + ", ".join(f"{e} AS {m}" for m, e in METRIC_SQL.items())
                                   + ", count(*) AS rows FROM errs GROUP BY 1, 2", "zone model", "mae rmse mape smape", "rows"))
def compare_baselines(spark, sf_dir):
    return baselines.compare_baselines(baselines.baseline_table(_price(spark, sf_dir)))


# ── the feature table ───────────────────────────────────────────────────────

_W = "OVER (PARTITION BY zone ORDER BY ts)"
_PRICE_FEATURES = {
    **{f"price_lag_{k}h": f"lag(price, {k}) {_W}" for k in features.LAGS},
    "price_weekly_delta": f"price - lag(price, 168) {_W}",
    "price_pct_change_24h": f"(price - lag(price, 24) {_W}) / nullif(abs(lag(price, 24) {_W}), 0)",
    **{f"price_roll_mean_{n}h": f"avg(price) {frame(n)}" for n in features.WINDOWS},
    **{f"price_roll_zscore_{n}h": f"(price - avg(price) {frame(n)}) / nullif(stddev_samp(price) {frame(n)}, 0)" for n in features.WINDOWS},
    "price_vs_7d_mean": f"price - avg(price) {frame(168)}",
}
_WEATHER_FEATURES = {
    f"weather_{v}_{kind}": e for v in WEATHER for kind, e in (
        ("raw", v), ("roll6h", f"avg({v}) {frame(6)}"), ("roll24h", f"avg({v}) {frame(24)}"), ("anomaly", f"{v} - avg({v}) {frame(24)}"))
}
_GRID_FEATURES = {
    "solar_estimated_cf": "CASE WHEN solar_irradiance IS NOT NULL THEN least(greatest(solar_irradiance / 1000.0, 0), 1) END",
    "residual_load": "load - gen_solar - gen_wind",
    "net_import": "net_flow",
    "load_roll24h": f"avg(load) {frame(24)}",
    "load_pct_of_7d": f"load / nullif(avg(load) {frame(24)}, 0)",
}
_REAL = {**_PRICE_FEATURES, **_WEATHER_FEATURES, **_GRID_FEATURES}
_CAL_WHOLE = ("hour day_of_week month is_weekend is_holiday is_holiday_eve day_of_year week_of_year part_of_day is_dst_spring is_dst_autumn "
              "is_dst_transition")
_CYCLIC = "hour_of_week hour_sin hour_cos dow_sin dow_cos doy_sin doy_cos month_sin month_cos"
FEATURE_SQL = sql(
    [*MARKET, HOLIDAYS,
     "f AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in _REAL.items()) + f", {SHARE}, {SOLAR_RATIO} FROM market)",
     f"""g AS (SELECT *, {PCT}, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month, isodow(ts) >= 6 AS is_weekend,
  dayofyear(ts) AS day_of_year, week(ts) AS week_of_year, CASE WHEN hour(ts) <= 6 THEN 0 WHEN hour(ts) <= 12 THEN 1 WHEN hour(ts) <= 18 THEN 2
  ELSE 3 END AS part_of_day, {holiday_flags('ts')}, {DST}, {", ".join(CYCLES.values())} FROM f)"""],
    "SELECT *, greatest(is_dst_spring, is_dst_autumn) AS is_dst_transition FROM g",
    "zone ts",
    " ".join(["price", "load", "gen_solar", "gen_wind", "gen_gas", "gen_hydro", *WEATHER, "net_flow", *_REAL, "renewable_share",
              "solar_to_residual", "residual_load_pct", _CYCLIC]),
    _CAL_WHOLE,
)


@register("feature_table", FEATURE_SQL)
def feature_table(spark, sf_dir):
    """Estimator fitted on the table, then applied to it: every feature group."""
    raw = _stored_market(spark, sf_dir)
    return features.FeatureBuilder().fit(raw).transform(raw)


# ── boosted trees ───────────────────────────────────────────────────────────

SPLIT = "2024-01-25"


def _strict_rows(raw):
    """Next-hour features without the hour's own price, cut into training and test time."""
    rows = features.build_features(raw, forecast.strict_spec())
    since = F.lit(SPLIT).cast("timestamp")
    return rows.where(F.col("ts") < since), rows.where(F.col("ts") >= since)


@register("fit_gbt")
def fit_gbt(spark, sf_dir):
    """Training and test error of the trees, per zone."""
    train, test = _strict_rows(_stored_market(spark, sf_dir))
    train = boosting.trainable_rows(train, MODEL_FEATURES, BOOST.min_train_size)
    model = boosting.fit_gbt(train, MODEL_FEATURES, BOOST)
    parts = [boosting.evaluate(model, d).withColumn("part", F.lit(name)) for name, d in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


# More rounds than patience, several folds, and every feature, the rank among the training rows included.
TUNE = boosting.BoostConfig(
    max_depth=4, n_estimators=200, learning_rate=0.3, min_train_size=96, val_size=48, step=48, patience=10, min_child_weight=5
)
ALL_FEATURES = [*MODEL_FEATURES, "solar_to_residual", "residual_load_pct"]


@register("tune_rounds")
def tune_rounds(spark, sf_dir):
    """Folds grown until patience runs out, and the final fit's error on the held-out end of every series."""
    spec = replace(forecast.strict_spec(), rank="train", train_before=SPLIT)
    rows = features.build_features(_stored_market(spark, sf_dir), spec)
    tuned = slabs.tune_and_fit(rows, ALL_FEATURES, TUNE)
    held = tuned.held.agg(F.avg(F.abs(F.col("price") - F.col("y_pred"))), F.count("y_pred")).first()
    return tuned.folds.withColumns({
        "final_rounds": F.lit(tuned.rounds), "final_trees": F.lit(len(tuned.model.trees)), "held_mae": F.lit(held[0]), "held_rows": F.lit(held[1])})


_STUMP = boosting.BoostConfig(max_depth=1, subsample=1.0, colsample=1.0)
_SOFT = f"(CASE WHEN abs(%s) > {slabs.ALPHA} THEN abs(%s) - {slabs.ALPHA} ELSE 0 END)"


def _worth(g: str, n: str) -> str:
    return f"power({_SOFT % (g, g)}, 2) / ({n} + {slabs.LAMBDA})"


def _leaf(g: str, n: str) -> str:
    return f"{_STUMP.learning_rate} * sign({g}) * {_SOFT % (g, g)} / ({n} + {slabs.LAMBDA})"


@register("tree_stump", sql(
    [*MARKET, "r AS (SELECT zone, ts, price, hour(ts) AS hour, isodow(ts) - 1 AS dow, avg(price) OVER () AS base FROM market WHERE price IS NOT NULL)",
     "c AS (SELECT 0 AS f, hour AS v, sum(price - base) AS g, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 1, dow, sum(price - base), count(*) FROM r GROUP BY 2)",
     "s AS (SELECT f, v, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY f) AS g, sum(n) OVER (PARTITION BY f) AS n FROM c WINDOW w AS (PARTITION BY f ORDER BY v))",
     f"b AS (SELECT *, {_worth('gl', 'nl')} + {_worth('(g - gl)', '(n - nl)')} - {_worth('g', 'n')} AS gain FROM s "
     f"WHERE nl >= {_STUMP.min_child_weight} AND n - nl >= {_STUMP.min_child_weight} ORDER BY gain DESC, f, v LIMIT 1)"],
    f"""SELECT zone, ts, price, base + CASE WHEN CASE WHEN f = 0 THEN hour ELSE dow END <= v THEN {_leaf('gl', 'nl')} ELSE {_leaf('(g - gl)', '(n - nl)')} END AS y_pred
  FROM r, b""", "zone ts", "price y_pred"))
def tree_stump(spark, sf_dir):
    """One round at depth 1 on hour and weekday, small enough for SQL to find the same split and leaves."""
    rows = market.hourly_observed(spark, sf_dir).select("zone", "ts", "price", F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"))
    rows = rows.where("price is not null")
    return slabs.fit_rounds(rows, ["hour", "dow"], _STUMP, 1).score(rows).select("zone", "ts", "price", "y_pred")


@register("predict_batch")
def predict_batch(spark, sf_dir):
    train, test = _strict_rows(_stored_market(spark, sf_dir))
    model = boosting.fit_gbt(train, MODEL_FEATURES, BOOST)
    return boosting.score(model, test).select("zone", "ts", "price", "y_pred")


@register("eval_single_step")
def eval_single_step(spark, sf_dir):
    train, test = _strict_rows(_stored_market(spark, sf_dir))
    return boosting.evaluate(boosting.fit_gbt(train, MODEL_FEATURES, BOOST), test)


@register("permutation_importance")
def permutation_importance(spark, sf_dir):
    train, test = _strict_rows(_stored_market(spark, sf_dir))
    model = boosting.fit_gbt(train, MODEL_FEATURES, BOOST)
    return boosting.permutation_importance(model, test, MODEL_FEATURES)


@register("importance_topk")
def importance_topk(spark, sf_dir):
    return profiles.top_importance(permutation_importance(spark, sf_dir), 20)


# One level of each group of indicators is left out, so that the weights are unique and every column can rank.
RANKED_NAMES = tuple(f for f in LINEAR_NAMES if f not in ("h_0", "dow_0", "mon_1"))
_LIN_MEAN = ", ".join(f"avg({f}) AS {f}" for f in RANKED_NAMES)


@register("linear_importance_topk", sql(
    [*LINEAR, *least_squares("lin", "zone", RANKED_NAMES), f"mu AS (SELECT zone, {_LIN_MEAN} FROM lin GROUP BY zone)",
     "imp AS (" + " UNION ALL ".join(
         f"SELECT zone, '{f}' AS feature, avg(abs(c[{i + 2}] * (lin.{f} - mu.{f}))) AS importance FROM lin JOIN mu USING (zone) JOIN coefs USING (zone) GROUP BY zone"
         for i, f in enumerate(RANKED_NAMES)) + ")"],
    "SELECT * FROM (SELECT zone, feature, importance, row_number() OVER (PARTITION BY zone ORDER BY importance DESC, feature) AS rank FROM imp) WHERE rank <= 20",
    "zone feature", "importance", "rank", digits=4), digits=4)
def linear_importance_topk(spark, sf_dir):
    """Mean |w (x - mean x)| of all columns, the top 20; exact for the linear model."""
    matrix = baselines.linear_features(_total_price(spark, sf_dir))
    names = list(RANKED_NAMES)
    return profiles.top_importance(linear.linear_importance(matrix, linear.fit_ols(matrix, names), names), 20)


# ── forecasts ───────────────────────────────────────────────────────────────


@register("history_guard", sql([*MARKET], "SELECT zone, count(*) AS rows, 336 AS needed, count(*) >= 336 AS enough FROM market GROUP BY zone",
                               "zone", "", "rows needed enough"))
def history_guard(spark, sf_dir):
    return forecast.history_guard(_price(spark, sf_dir), features.LAGS)


# A linear model on six inputs, so that SQL can repeat fit and recursion.
STEP_NAMES = ["price_lag_24h", "price_lag_168h", "price_roll_mean_24h", "load_roll24h", "hour_sin", "hour_cos"]


def _ols():
    return LinearRegression(labelCol="price", predictionCol="y_pred", solver="normal", regParam=0.0)


def _linear_model(train):
    return boosting.fit_model(train, STEP_NAMES, _ols())


_STEP_ROWS = [
    *MARKET,
    "rf AS (SELECT zone, ts, price, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY zone) AS n, lag(price, 24) OVER w AS price_lag_24h, "
    "lag(price, 168) OVER w AS price_lag_168h, avg(price) OVER (PARTITION BY zone ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS price_roll_mean_24h, "
    f"avg(load) {frame(24)} AS load_roll24h, {CYCLES['hour']} FROM market WINDOW w AS (PARTITION BY zone ORDER BY ts))",
    "rk AS (SELECT * FROM rf WHERE price IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in STEP_NAMES) + ")",
]
_STEP_FIT = [*_STEP_ROWS, f"rt AS (SELECT *, 0 AS g FROM rk WHERE ts < TIMESTAMP '{SPLIT}')", *least_squares("rt", "g", STEP_NAMES)]


def _recursion(origins: str, horizon: int, keys: str = "zone, origin", on: str = "true") -> list[str]:
    """The recursion in SQL: ``rc`` holds one row per origin and step, ``ro`` the forecasts."""
    hour = "hour(origin + to_hours(CAST(h + 1 AS INT)))"
    return [
        f"og AS ({origins})",
        f"hs AS (SELECT {', '.join('og.' + k for k in keys.split(', '))}, list(m.price ORDER BY m.ts) AS pr, list(m.load ORDER BY m.ts)[-24:] AS ld FROM og "
        f"JOIN market m ON m.zone = og.zone AND m.ts <= og.origin AND m.ts > og.origin - INTERVAL 337 HOUR GROUP BY ALL HAVING count(*) >= 336)",
        f"rc AS (SELECT {keys}, 0 AS h, pr, ld, NULL::DOUBLE AS y FROM hs UNION ALL SELECT {keys}, h + 1, list_concat(pr[2:], [y2]), ld2, y2 FROM "
        f"(SELECT q.*, c[1] + c[2] * pr[-24] + c[3] * pr[-168] + c[4] * list_avg(pr[-24:]) + c[5] * list_avg(ld2) + c[6] * sin(2 * pi() * {hour} / 24) "
        f"+ c[7] * cos(2 * pi() * {hour} / 24) AS y2 FROM (SELECT *, list_concat(ld[2:], [ld[-1]]) AS ld2 FROM rc WHERE h < {horizon}) q JOIN coefs ON {on}))",
        f"ro AS (SELECT {', '.join('rc.' + k for k in keys.split(', '))}, h AS horizon, origin + to_hours(CAST(h AS INT)) AS ts, y AS y_pred, price AS y_true FROM rc "
        "LEFT JOIN market m ON m.zone = rc.zone AND m.ts = origin + to_hours(CAST(h AS INT)) WHERE h > 0)",
    ]


_BLOCKS = "SELECT zone, ts AS origin FROM rf WHERE pos >= 335 AND (pos - 335) % 24 = 0 AND pos + 1 < n - 24"


@register("forecast_recursive")
def forecast_recursive(spark, sf_dir):
    raw = _stored_market(spark, sf_dir)
    spec = forecast.strict_spec()
    model = boosting.fit_gbt(features.build_features(raw, spec), MODEL_FEATURES, BOOST)
    return forecast.forecast_recursive(raw, forecast.latest_origins(raw), model, MODEL_FEATURES, spec)


@register("forecast_recursive_same_hour")
def forecast_recursive_same_hour(spark, sf_dir):
    """The other known behaviour: features hold the current price and step 1 scores the last known hour."""
    raw = _stored_market(spark, sf_dir)
    spec = features.FeatureSpec(rank="none")
    model = boosting.fit_gbt(features.build_features(raw, spec), MODEL_FEATURES, BOOST)
    return forecast.forecast_recursive(raw, forecast.latest_origins(raw), model, MODEL_FEATURES, spec, same_hour=True)


@register("forecast_direct")
def forecast_direct(spark, sf_dir):
    raw = _stored_market(spark, sf_dir)
    spec = forecast.direct_spec(24)
    model = boosting.fit_gbt(features.build_features(raw, spec), MODEL_FEATURES, BOOST)
    return forecast.forecast_direct(raw, model, spec, 24)


@register("forecast_direct_linear", sql(
    [*MARKET, ENDS, AHEAD, "grid AS (SELECT zone, ts, price, load FROM market UNION ALL SELECT zone, ts, NULL, NULL FROM ahead)",
     "df AS (SELECT zone, ts, price, lag(price, 24) OVER w AS price_lag_24h, lag(price, 168) OVER w AS price_lag_168h, "
     "avg(price) OVER (PARTITION BY zone ORDER BY ts ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING) AS price_roll_mean_24h, "
     "avg(load) OVER (PARTITION BY zone ORDER BY ts ROWS BETWEEN 47 PRECEDING AND 24 PRECEDING) AS load_roll24h, "
     f"{CYCLES['hour']}, 0 AS g FROM grid WINDOW w AS (PARTITION BY zone ORDER BY ts))",
     "dt AS (SELECT * FROM df WHERE price IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in STEP_NAMES) + ")",
     *least_squares("dt", "g", STEP_NAMES)],
    "SELECT a.zone, a.origin, a.horizon, a.ts, " + " + ".join(["c[1]", *[f"c[{i + 2}] * {c}" for i, c in enumerate(STEP_NAMES)]])
    + " AS y_pred FROM ahead a JOIN df ON df.zone = a.zone AND df.ts = a.ts, coefs", "zone origin ts", "y_pred", "horizon", digits=4), digits=4)
def forecast_direct_linear(spark, sf_dir):
    raw = _stored_market(spark, sf_dir)
    spec = forecast.direct_spec(24)
    return forecast.forecast_direct(raw, _linear_model(features.build_features(raw, spec)), spec, 24)


def _recursive_log(spark, sf_dir):
    raw = _stored_market(spark, sf_dir)
    train, _ = _strict_rows(raw)
    return forecast.evaluate_recursive(raw, _linear_model(train), STEP_NAMES, forecast.strict_spec())


@register("eval_recursive", sql([*_STEP_FIT, *_recursion(_BLOCKS, 24)], "SELECT * FROM ro", "zone origin ts", "y_true y_pred", "horizon", digits=4), digits=4)
def eval_recursive(spark, sf_dir):
    return _recursive_log(spark, sf_dir)


@register("single_vs_recursive", sql([*_STEP_FIT, *_recursion(_BLOCKS, 24), f"""errs AS (SELECT *, y_true - y_pred AS error, abs(y_true - y_pred) AS abs_error FROM
  (SELECT zone, 'single_step' AS mode, price AS y_true, c[1] + c[2] * price_lag_24h + c[3] * price_lag_168h + c[4] * price_roll_mean_24h + c[5] * load_roll24h
     + c[6] * hour_sin + c[7] * hour_cos AS y_pred FROM rk, coefs WHERE ts >= TIMESTAMP '{SPLIT}'
   UNION ALL SELECT zone, 'recursive', y_true, y_pred FROM ro WHERE ts >= TIMESTAMP '{SPLIT}') WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"""],
  "SELECT zone, mode, " + ", ".join(f"{e} AS {m}" for m, e in METRIC_SQL.items()) + ", count(*) AS rows FROM errs GROUP BY 1, 2",
  "zone mode", "mae rmse mape smape", "rows", digits=4), digits=4)
def single_vs_recursive(spark, sf_dir):
    """Both kinds of error over the test time, side by side."""
    raw = _stored_market(spark, sf_dir)
    train, test = _strict_rows(raw)
    model = _linear_model(train)
    since = F.lit(SPLIT).cast("timestamp")
    complete = test.select("zone", "price", *STEP_NAMES).na.drop("any")
    single = boosting.score(model, complete).select("zone", F.col("price").alias("y_true"), "y_pred")
    steps = forecast.evaluate_recursive(raw, model, STEP_NAMES, forecast.strict_spec()).where(F.col("ts") >= since)
    both = single.withColumn("mode", F.lit("single_step")).unionByName(
        steps.select("zone", "y_true", "y_pred", F.lit("recursive").alias("mode")))
    return profiles.metrics_by(both, ("zone", "mode"))


@register("forecast_overlay", sql([*_STEP_FIT, *_recursion("SELECT zone, TIMESTAMP '2024-01-24 23:00:00' AS origin FROM rf GROUP BY zone", 72)],
                                  "SELECT * FROM ro", "zone origin ts", "y_true y_pred", "horizon", digits=4), digits=4)
def forecast_overlay(spark, sf_dir):
    """Three days of forecast from one origin per zone beside the actual prices."""
    raw = _stored_market(spark, sf_dir)
    train, _ = _strict_rows(raw)
    origin = F.lit("2024-01-24 23:00:00").cast("timestamp")
    origins = raw.select("zone").distinct().withColumn("origin", origin)
    ahead = forecast.forecast_recursive(raw, origins, _linear_model(train), STEP_NAMES, forecast.strict_spec(), 72)
    return forecast.with_actuals(ahead, raw)


# ── backtests ───────────────────────────────────────────────────────────────

_POS = "num0 AS (SELECT zone, ts, price, row_number() OVER (PARTITION BY zone ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY zone) AS n FROM market)"
_FOLDS = (f"f AS (SELECT zone, n, t0, i AS iteration, {WALK.train_min} + i * {WALK.step} AS train_rows FROM (SELECT zone, count(*) AS n, min(ts) AS t0 FROM market "
          f"GROUP BY zone), range(0, 1000) r(i) WHERE {WALK.train_min} + i * {WALK.step} + {WALK.horizon} < n)")


@register("fold_table", sql([*MARKET, _FOLDS], f"""SELECT zone, iteration, train_rows, t0 + to_hours(CAST(train_rows - 1 AS INT)) AS train_end,
  t0 + to_hours(CAST(train_rows AS INT)) AS test_start, t0 + to_hours(CAST(train_rows + {WALK.horizon - 1} AS INT)) AS test_end FROM f""",
                            "zone train_end test_start test_end", "", "iteration train_rows"))
def fold_table(spark, sf_dir):
    return walk.fold_table(_price(spark, sf_dir), WALK)


@register("fold_theta_join", sql([*MARKET, _POS, _FOLDS], f"""SELECT f.zone, iteration, count(price) FILTER (WHERE pos < train_rows) AS train_count,
  avg(price) FILTER (WHERE pos < train_rows) AS train_mean, count(price) FILTER (WHERE pos >= train_rows) AS test_count,
  avg(price) FILTER (WHERE pos >= train_rows) AS test_mean FROM f JOIN num0 m ON m.zone = f.zone AND m.pos < train_rows + {WALK.horizon}
  GROUP BY 1, 2""", "zone", "train_mean test_mean", "iteration train_count test_count"))
def fold_theta_join(spark, sf_dir):
    return walk.fold_statistics(_price(spark, sf_dir), "price", WALK)


@register("expanding_ols", sql(
    [*LINEAR, _FOLDS, "foldrows AS (SELECT lin.*, iteration FROM lin JOIN f ON f.zone = lin.zone AND lin.pos < f.train_rows)",
     *least_squares("foldrows", "zone iteration")],
    f"""SELECT lin.zone, f.iteration, lin.ts, lin.pos - train_rows + 1 AS horizon, price AS y_true, {fitted('lin')} AS y_pred FROM lin
  JOIN f ON f.zone = lin.zone AND lin.pos >= train_rows AND lin.pos < train_rows + {WALK.horizon}
  JOIN coefs ON coefs.zone = lin.zone AND coefs.iteration = f.iteration""", "zone ts", "y_true y_pred", "iteration horizon", digits=4), digits=4)
def expanding_ols(spark, sf_dir):
    """A fold's rows are complete feature rows placed by their hour on the whole grid."""
    prices = _total_price(spark, sf_dir)
    matrix = prices.select("zone", "ts").join(baselines.linear_features(prices), ["zone", "ts"], "left")
    return walk.expanding_ols(matrix, LINEAR_NAMES, WALK).where(F.col("y_true").isNotNull())


@register("backtest")
def backtest(spark, sf_dir):
    return walk.backtest(_stored_market(spark, sf_dir), MODEL_FEATURES, WALK)["iterations"]


@register("backtest_predictions", sql(
    [*_STEP_ROWS, _FOLDS, "ft AS (SELECT rk.*, iteration FROM rk JOIN f ON f.zone = rk.zone AND rk.pos < train_rows)", *least_squares("ft", "iteration", STEP_NAMES),
     *_recursion("SELECT rf.zone, ts AS origin, iteration FROM rf JOIN f ON f.zone = rf.zone AND rf.pos = train_rows - 1", WALK.horizon, "zone, origin, iteration",
                 "coefs.iteration = q.iteration")],
    "SELECT zone, iteration, ts, horizon, y_true, y_pred, origin AS train_end FROM ro", "zone ts train_end", "y_true y_pred", "iteration horizon", digits=4), digits=4)
def backtest_predictions(spark, sf_dir):
    """The prediction table of a walk-forward run with another regressor passed in."""
    return walk.backtest(_stored_market(spark, sf_dir), STEP_NAMES, WALK, _ols)["predictions"]
