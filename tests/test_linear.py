import numpy as np
import pytest
from conftest import hourly, to_spark
from pyspark.sql import functions as F

from voltloom.operators import backtest, baselines, linear
from voltloom.operators.windows import Chunks

NAMES = ["load", "gen_wind", "temperature", "net_flow"]


def arrays(frame, zone):
    part = frame[(frame.zone == zone)].dropna(subset=[*NAMES, "price"])
    return part[NAMES].to_numpy(), part["price"].to_numpy()


def test_ols_per_zone(spark):
    frame = hourly(300, ("A", "B"), gaps=0.05)
    got = {r.zone: r for r in linear.fit_ols(to_spark(spark, frame), NAMES).collect()}
    for zone in "AB":
        x, y = arrays(frame, zone)
        want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
        np.testing.assert_allclose(got[zone].coef, want, rtol=1e-6, atol=1e-8)
        assert got[zone].rows == len(y)


def test_collinear_columns_do_not_change_the_fit(spark):
    df = to_spark(spark, hourly(200)).withColumns({"twin": F.col("load") * 2, "flat": F.lit(3.0)})
    a = linear.score_linear(df, linear.fit_ols(df, NAMES), NAMES).orderBy("ts").toPandas()["y_pred"]
    more = [*NAMES, "twin", "flat"]
    b = linear.score_linear(df, linear.fit_ols(df, more), more).orderBy("ts").toPandas()["y_pred"]
    np.testing.assert_allclose(a, b, rtol=1e-6)


def test_ridge_leave_one_out_is_exact(spark):
    frame = hourly(60, ("A", "B"))
    alphas = (0.01, 1.0, 30.0, 1000.0)
    got = {r.zone: r for r in linear.fit_ridge_cv(to_spark(spark, frame), NAMES, alphas=alphas, chunks=Chunks(size=25)).collect()}
    for zone in "AB":
        x, y = arrays(frame, zone)
        mean, std = x.mean(0), x.std(0)
        z = (x - mean) / std

        def fit(z, y, a):
            zc, yc = z - z.mean(0), y - y.mean()
            b = np.linalg.solve(zc.T @ zc + a * np.eye(z.shape[1]), zc.T @ yc)
            return b, y.mean() - z.mean(0) @ b

        losses = []
        for a in alphas:
            errors = []
            for i in range(len(y)):
                keep = np.arange(len(y)) != i
                b, c = fit(z[keep], y[keep], a)
                errors.append((y[i] - z[i] @ b - c) ** 2)
            losses.append(np.mean(errors))
        best = int(np.argmin(losses))
        assert got[zone].alpha == alphas[best]
        assert got[zone].loo_mse == pytest.approx(losses[best], rel=1e-8)
        b, c = fit(z, y, alphas[best])
        np.testing.assert_allclose(got[zone].coef, [c - mean @ (b / std), *(b / std)], rtol=1e-7)


def test_expanding_fits_equal_one_fit_per_fold(spark):
    frame = hourly(260, ("A", "B"))
    df = to_spark(spark, frame)
    config = backtest.BacktestConfig(train_min=100, step=40, horizon=24)
    got = backtest.expanding_ols(df, NAMES, config).toPandas()
    assert sorted(got.iteration.unique()) == [0, 1, 2, 3]
    for (zone, i), part in got.groupby(["zone", "iteration"]):
        x, y = arrays(frame, zone)
        cut = 100 + 40 * i
        b = np.linalg.lstsq(np.column_stack([np.ones(cut), x[:cut]]), y[:cut], rcond=None)[0]
        want = b[0] + x[cut:cut + 24] @ b[1:]
        np.testing.assert_allclose(part.sort_values("ts")["y_pred"], want, rtol=1e-6)
        assert part.sort_values("ts")["horizon"].tolist() == list(range(1, 25))


def test_a_fold_without_new_complete_rows_uses_the_fit_before_it(spark):
    frame = hourly(260, ("A", "B"))
    gap = frame.groupby("zone").cumcount().between(100, 139)
    frame.loc[gap & (frame.zone == "A"), "load"] = np.nan  # the whole step of fold 1
    frame.loc[frame.zone == "B", "load"] = np.nan
    config = backtest.BacktestConfig(train_min=100, step=40, horizon=24)
    got = backtest.expanding_ols(to_spark(spark, frame), NAMES, config).toPandas()
    assert got.groupby("zone").iteration.unique().map(sorted).to_dict() == {"A": [0, 1, 2, 3], "B": [0, 1, 2, 3]}
    assert got[got.zone == "B"].y_pred.isna().all()
    x, y = arrays(frame, "A")
    b = np.linalg.lstsq(np.column_stack([np.ones(100), x[:100]]), y[:100], rcond=None)[0]
    part = got[(got.zone == "A") & (got.iteration == 1)].sort_values("ts")
    rows = frame[frame.zone == "A"].iloc[140:164]
    np.testing.assert_allclose(part["y_pred"], b[0] + rows[NAMES].to_numpy() @ b[1:], rtol=1e-6)


def test_test_blocks_longer_than_the_step_overlap(spark):
    config = backtest.BacktestConfig(train_min=20, step=10, horizon=24)
    rows = backtest.test_rows(to_spark(spark, hourly(80)), config).groupBy("iteration").count().orderBy("iteration").collect()
    assert [(r.iteration, r["count"]) for r in rows] == [(0, 24), (1, 24), (2, 24), (3, 24)]
    folds = backtest.fold_table(to_spark(spark, hourly(80)), config).collect()
    assert len(folds) == 4  # 20 + 10 i + 24 < 80


def test_linear_importance(spark):
    frame = hourly(100)
    df = to_spark(spark, frame)
    coefs = linear.fit_ols(df, NAMES)
    got = {r.feature: r.importance for r in linear.linear_importance(df, coefs, NAMES).collect()}
    w = coefs.first().coef[1:]
    for name, weight in zip(NAMES, w):
        assert got[name] == pytest.approx(np.abs(weight * (frame[name] - frame[name].mean())).mean())


def test_baselines_by_hand(spark):
    frame = hourly(400, ("A",))
    df = to_spark(spark, frame)
    price = frame["price"].to_numpy()
    tail = baselines.persistence_tail(df, 24).orderBy("horizon").toPandas()
    np.testing.assert_allclose(tail["y_pred"], price[-24:])
    assert tail["ts"].iloc[0] == frame["ts"].iloc[-1] + np.timedelta64(1, "h")
    short = baselines.persistence_tail(to_spark(spark, frame.head(10)), 24).toPandas()
    assert len(short) == 24 and short["y_pred"].isna().all()
    lagged = baselines.persistence_lag(df).orderBy("ts").toPandas()["y_pred"]
    assert lagged.iloc[:24].isna().all() and lagged.iloc[48] == pytest.approx(price[24])
    hist = baselines.historical_hourly(df, 4).orderBy("horizon").toPandas()
    recent = frame.tail(96)
    want = recent.groupby(recent.ts.dt.hour)["price"].mean()
    np.testing.assert_allclose(hist["y_pred"], want.loc[hist["ts"].dt.hour].to_numpy())
    season = baselines.seasonal_forecast(df, df).toPandas()
    assert season.groupby([season.ts.dt.dayofweek, season.ts.dt.hour])["y_pred"].nunique().max() == 1


def test_run_baselines_splits_by_time(spark):
    got = {r.model: r for r in baselines.run_baselines(to_spark(spark, hourly(500))).collect()}
    assert set(got) == {"persistence", "historical_avg_4wk", "linear_regression"}
    assert all(r.rows == 100 for r in got.values())
    assert got["linear_regression"].mae < got["persistence"].mae
