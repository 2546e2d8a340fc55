from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from conftest import hourly, to_spark
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from voltloom.operators import backtest, boosting, features, forecast, profiles
from voltloom.operators.features import FeatureSpec
from voltloom.operators.windows import Chunks

SPEC = FeatureSpec(lags=(24, 48), windows=(24,), years=(2025,), rank="none", chunks=Chunks(size=100))
NAMES = [
    "price_lag_24h", "price_lag_48h", "price_pct_change_24h", "price_roll_mean_24h", "price_roll_zscore_24h",
    "weather_temperature_roll6h", "weather_temperature_anomaly", "residual_load", "load_roll24h", "net_import", "hour_sin", "hour_cos",
    "is_holiday", "part_of_day",
]


def linear_model(spark, frame, spec):
    rows = features.build_features(to_spark(spark, frame), spec)
    return boosting.fit_model(rows, NAMES, LinearRegression(labelCol="price", predictionCol="y_pred", regParam=0.1))


def by_hand(spark, frame, model, spec, horizon, same_hour):
    """Rebuild the whole feature table for each step, append the prediction, carry the rest forward."""
    rows = frame.copy()
    out = []
    for _ in range(horizon):
        added = rows.iloc[[-1]].copy()
        added["ts"] += pd.Timedelta(hours=1)
        if same_hour:
            table = features.build_features(to_spark(spark, rows), spec)
            last = rows["ts"].iloc[-1]
        else:
            target = added.assign(price=np.nan)
            table = features.build_features(to_spark(spark, pd.concat([rows, target], ignore_index=True)), spec)
            last = added["ts"].iloc[0]
        value = model.transform(table.where(F.col("ts") == F.lit(str(last)).cast("timestamp"))).first().y_pred
        out.append(value)
        rows = pd.concat([rows, added.assign(price=value)], ignore_index=True)
    return out


@pytest.mark.parametrize("same_hour", [False, True])
def test_recursion_equals_rebuilding_the_table(spark, same_hour):
    frame = hourly(150, ("A",), start="2025-04-14")
    spec = SPEC if same_hour else replace(SPEC, price_shift=1)
    model = linear_model(spark, frame, spec)
    df = to_spark(spark, frame)
    got = forecast.forecast_recursive(df, forecast.latest_origins(df), model, NAMES, spec, 5, same_hour, steps_per_stage=2)
    got = got.orderBy("horizon").toPandas()
    assert got["ts"].tolist() == [frame["ts"].iloc[-1] + pd.Timedelta(hours=h) for h in range(1, 6)]
    np.testing.assert_allclose(got["y_pred"], by_hand(spark, frame, model, spec, 5, same_hour), rtol=1e-9)


def test_zones_do_not_touch_each_other(spark):
    frame = hourly(150, ("A", "B"))
    spec = replace(SPEC, price_shift=1)
    model = linear_model(spark, frame, spec)
    changed = frame.copy()
    changed.loc[changed.zone == "B", "price"] *= 4

    def run(f):
        df = to_spark(spark, f)
        rows = forecast.forecast_recursive(df, forecast.latest_origins(df), model, NAMES, spec, 3)
        return rows.where("zone = 'A'").orderBy("horizon").toPandas()["y_pred"]

    np.testing.assert_allclose(run(frame), run(changed))


def test_recursive_evaluation_blocks(spark):
    frame = hourly(150, ("A",))
    spec = replace(SPEC, price_shift=1)
    model = linear_model(spark, frame, spec)
    got = forecast.evaluate_recursive(to_spark(spark, frame), model, NAMES, spec, 24).orderBy("ts").toPandas()
    assert got["ts"].min() == frame["ts"].iloc[48] and len(got) == 24 * len(range(48, 150 - 24, 24))
    np.testing.assert_allclose(got["y_true"], frame["price"].iloc[48:48 + len(got)])
    # A block's forecast equals one made from the history alone.
    df = to_spark(spark, frame.iloc[:72])
    alone = forecast.forecast_recursive(df, forecast.latest_origins(df), model, NAMES, spec, 24).orderBy("ts").toPandas()
    np.testing.assert_allclose(got["y_pred"].iloc[24:48], alone["y_pred"])


def test_history_guard(spark):
    df = to_spark(spark, hourly(30))
    assert forecast.history_guard(df, (24, 48)).first().enough is False
    with pytest.raises(ValueError, match="needs at least 48"):
        forecast.require_history(df, (24, 48))
    spec = replace(SPEC, price_shift=1)
    model = linear_model(spark, hourly(150), spec)
    assert forecast.forecast_recursive(df, forecast.latest_origins(df), model, NAMES, spec, 3).count() == 0


def test_direct_forecast(spark):
    frame = hourly(200, ("A", "B"))
    spec = replace(forecast.direct_spec(24), lags=(24, 48), windows=(24,), chunks=Chunks(size=64))
    names = ["price_lag_24h", "price_lag_48h", "price_roll_mean_24h", "load_roll24h", "hour_sin", "hour_cos"]
    df = to_spark(spark, frame)
    model = boosting.fit_model(features.build_features(df, spec), names, LinearRegression(labelCol="price", predictionCol="y_pred"))
    got = forecast.forecast_direct(df, model, spec, 24).orderBy("zone", "horizon").toPandas()
    assert len(got) == 48 and got["y_pred"].notna().all()
    assert got["ts"].min() == frame["ts"].max() + pd.Timedelta(hours=1)
    with pytest.raises(ValueError, match="horizon"):
        forecast.forecast_direct(df, model, SPEC, 24)


CONFIG = boosting.BoostConfig(max_depth=3, n_estimators=4, learning_rate=0.3, min_train_size=60, val_size=24, step=24, min_val_rows=12)


def test_trees_rounds_and_importance(spark):
    frame = hourly(200, ("A", "B"))
    rows = features.build_features(to_spark(spark, frame), replace(SPEC, price_shift=1)).withColumn("noise", F.lit(1.0))
    names = [*NAMES, "noise"]
    folds, rounds = boosting.tune_rounds(rows, names, CONFIG)
    found = folds.toPandas()
    assert rounds == int(found["best_round"].mean()) + 5 and (found["val_rows"] <= 48).all()
    model = boosting.fit_gbt(rows, names, CONFIG)
    scores = boosting.permutation_importance(model, rows, names, block_rows=50).toPandas()
    assert len(scores) == 2 * len(names) and (scores[scores.feature == "noise"]["importance"] == 0).all()
    top = profiles.top_importance(spark.createDataFrame(scores), 3).toPandas()
    assert len(top) == 6 and top["importance"].min() > 0
    again = boosting.permutation_importance(model, rows, names, block_rows=50).toPandas()
    pd.testing.assert_frame_equal(*(d.sort_values(["zone", "feature"], ignore_index=True) for d in (scores, again)))
    assert boosting.evaluate(model, rows).toPandas()["mae"].max() < 20


def test_short_series_are_not_trained(spark):
    frame = pd.concat([hourly(120, ("A",)), hourly(60, ("B",))])
    rows = features.build_features(to_spark(spark, frame), replace(SPEC, price_shift=1))
    kept = boosting.trainable_rows(rows, NAMES, 30).select("zone").distinct().collect()
    assert [r.zone for r in kept] == ["A"]  # B has 12 complete rows
    with pytest.raises(ValueError, match="needs at least 500"):
        boosting.trainable_rows(rows, NAMES, 500)


def test_best_round_has_patience():
    assert boosting.best_round([5, 4, 3, 4, 4, 1], 2) == 2
    assert boosting.best_round([5, 4, 3, 4, 4, 1], 9) == 5


class _Breaks(LinearRegression):
    def _fit(self, dataset):
        raise RuntimeError("does not fit")


def test_backtest(spark):
    frame = hourly(200, ("A", "B"))
    df = to_spark(spark, frame)
    config = backtest.BacktestConfig(train_min=100, step=48, horizon=12)
    made = []

    def factory():
        made.append(1)
        return LinearRegression(labelCol="price", predictionCol="y_pred", regParam=0.1)

    out = backtest.backtest(df, NAMES, config, factory, replace(SPEC, price_shift=1))
    folds = backtest.fold_table(df, config).orderBy("zone", "iteration").toPandas()
    got = out["iterations"].orderBy("zone", "iteration").toPandas()
    assert len(made) == 2 and len(got) == len(folds) == 4
    assert got["train_end"].tolist() == folds["train_end"].tolist() and got["test_start"].tolist() == folds["test_start"].tolist()
    assert got["train_rows"].tolist() == folds["train_rows"].tolist()
    log = out["predictions"].toPandas()
    assert len(log) == 48 and set(log["horizon"]) == set(range(1, 13)) and log["y_pred"].notna().all()
    assert {r.status for r in out["status"].collect()} == {"ok"}


def test_failed_folds_are_reported(spark):
    df = to_spark(spark, hourly(200))
    config = backtest.BacktestConfig(train_min=100, step=48, horizon=12)
    turn = iter([_Breaks(labelCol="price", predictionCol="y_pred"), LinearRegression(labelCol="price", predictionCol="y_pred")])
    out = backtest.backtest(df, NAMES, config, lambda: next(turn), replace(SPEC, price_shift=1), workers=1)
    status = {r.iteration: r for r in out["status"].collect()}
    assert status[0].status == "failed" and "does not fit" in status[0].error and status[1].status == "ok"
    assert {(r.iteration, r.run_status, r.zone is None) for r in out["iterations"].collect()} == {(0, "failed", True), (1, "ok", False)}


def test_importance_does_not_shrink_with_more_series(spark):
    rng = np.random.default_rng(5)
    rows = [(f"z{z}", t, float(x), float(10 * x + rng.normal())) for z in range(60) for t, x in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(rows, "zone string, ts long, x double, price double")
    model = boosting.fit_model(df, ["x"], LinearRegression(labelCol="price", featuresCol="features", predictionCol="y_pred"))
    whole = boosting.permutation_importance(model, df, ["x"]).agg({"importance": "avg"}).first()[0]
    small = boosting.permutation_importance(model, df, ["x"], block_rows=50).agg({"importance": "avg"}).first()[0]
    assert small == pytest.approx(whole, rel=0.05) and small > 100


def test_incomplete_rows_get_no_prediction(spark):
    df = spark.createDataFrame([("A", i, float(i), float(i)) for i in range(20)] + [("A", 20, None, 5.0)], "zone string, ts long, x double, price double")
    model = boosting.fit_model(df, ["x"], LinearRegression(labelCol="price", featuresCol="features", predictionCol="y_pred"))
    got = {r.ts: r.y_pred for r in boosting.score(model, df).collect()}
    assert got[20] is None and got[3] == pytest.approx(3.0, abs=1e-3)
    assert boosting.evaluate(model, df.withColumn("other", F.lit(None).cast("double"))).first()["rows"] == 20
