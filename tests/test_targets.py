"""Intervals, pinball loss, ramps, unusual errors, spreads, and the joins over all zones."""

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL, to_spark

from voltloom.operators import targets
from voltloom.operators.windows import Chunks
from voltloom.plans import all_queries
from voltloom.streaming.resample import newest


def log(hours: int = 240, zones=("A", "B"), seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    frames = []
    for zone in zones:
        ts = pd.date_range("2025-01-01", periods=hours, freq="h")
        y = rng.normal(40, 30, hours)
        p = y + rng.normal(0, 5, hours)
        y[rng.random(hours) < 0.1] = np.nan
        frames.append(pd.DataFrame({"zone": zone, "ts": ts, "horizon": ts.hour + 1, "y_true": y, "y_pred": p}))
    return pd.concat(frames, ignore_index=True)


@pytest.mark.parametrize("size", [48, 2016])
def test_intervals_and_pinball_by_hand(spark, size):
    frame = log()
    cut = lambda f: targets.intervals(to_spark(spark, f), (80,), hours=120, least=3, chunks=Chunks(size=size))
    rows = cut(frame).toPandas().sort_values(["zone", "ts"]).reset_index(drop=True)
    frame["error"] = frame.y_true - frame.y_pred

    def earlier(q):
        # One row a day in each group, so 120 hours are five rows.
        roll = lambda e: e.shift(1).rolling(5, min_periods=3).quantile(q)
        return frame.y_pred + frame.groupby(["zone", "horizon"]).error.transform(roll)

    low, high = earlier(0.1), earlier(0.9)
    assert low.notna().any() and np.allclose(rows.low_80, low, equal_nan=True) and np.allclose(rows.high_80, high, equal_nan=True)

    scores = targets.interval_scores(cut(frame.drop(columns="error")), 80).toPandas().set_index("zone")
    known = frame.y_true.notna() & low.notna()
    off = frame.y_true - high
    loss = np.maximum(0.9 * off, -0.1 * off)[known].groupby(frame.zone[known]).mean()
    inside = frame.y_true.between(low, high)[known].groupby(frame.zone[known]).mean()
    assert np.allclose(scores.pinball_high[loss.index], loss) and np.allclose(scores.coverage[inside.index], inside)


def test_later_errors_do_not_change_earlier_intervals(spark):
    frame = log()
    changed = frame.copy()
    changed.loc[changed.ts >= "2025-01-07", "y_true"] += 1e6
    before = [targets.intervals(to_spark(spark, f), least=2).where("ts <= '2025-01-07'").toPandas().sort_values(["zone", "ts"], ignore_index=True) for f in (frame, changed)]
    names = ["low_80", "high_80", "low_95", "high_95"]
    assert before[0].low_95.notna().any()
    pd.testing.assert_frame_equal(before[0][names], before[1][names])


def test_sigma_uses_earlier_errors_only(spark):
    frame = log(60, ("A",))
    frame.loc[50, "y_true"] = frame.loc[50, "y_pred"] + 1000.0
    rows = targets.deviation_flags(to_spark(spark, frame), hours=24).toPandas().sort_values("ts").reset_index(drop=True)
    error = frame.y_true - frame.y_pred
    want = error.shift(1).rolling(24, min_periods=2).std()
    assert np.allclose(rows.sigma.astype(float), want, equal_nan=True)
    assert rows.deviates[50] and rows.sigma[50] < 20


def test_ramps(spark):
    frame = pd.DataFrame({
        "zone": "A", "ts": pd.date_range("2025-01-01", periods=6, freq="h"),
        "y_true": [0.0, 100.0, 100.0, 0.0, 0.0, np.nan], "y_pred": [0.0, 90.0, 10.0, 10.0, 10.0, 90.0],
    })
    got = targets.ramp_scores(to_spark(spark, frame)).first()
    assert (got.ramps, got.foreseen, got.hits, got.precision, got.recall) == (2, 2, 1, 0.5, 0.5)
    calm = targets.ramp_scores(to_spark(spark, frame), threshold=500.0).first()
    assert calm.ramps == 0 and calm.precision is None and calm.recall is None


def test_spread_leaves_out_missing_zones(spark):
    frame = pd.DataFrame({
        "zone": ["A", "B", "C", "A", "B"], "ts": pd.to_datetime(["2025-01-01"] * 3 + ["2025-01-02"] * 2), "price": [10.0, 20.0, np.nan, 5.0, np.nan],
    })
    got = {(r.zone, r.ts.day): r.spread for r in targets.zone_spread(to_spark(spark, frame)).collect()}
    assert got == {("A", 1): -10.0, ("B", 1): 10.0, ("C", 1): None, ("A", 2): None, ("B", 2): None}


def test_newest_update_wins(spark):
    updates = spark.createDataFrame([("A", 1, 5.0, 0), ("A", 1, 7.0, 1), ("B", 1, None, 2), ("B", 1, 3.0, 1)], "zone string, ts int, value double, batch int")
    assert {tuple(r) for r in newest(updates).collect()} == {("A", 1, 7.0), ("B", 1, None)}


@pytest.mark.parametrize("name", ["run_baselines", "linear_importance_topk"])
def test_no_product_of_both_sides(spark, name):
    plan = all_queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
