import math

import numpy as np
import pandas as pd
import pytest
from conftest import hourly, to_spark
from pyspark.sql import functions as F

from voltloom.operators import stats
from voltloom.operators.windows import Chunks


def series(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = 0.8 * x[t - 1] + rng.normal()
    return x + 50


def framed(spark, x):
    frame = pd.DataFrame({"zone": "A", "ts": pd.date_range("2025-01-01", periods=len(x), freq="h"), "x": x})
    return to_spark(spark, frame)


def acf_by_hand(x, lags):
    d = x - x.mean()
    return np.array([d[k:] @ d[: len(d) - k] for k in range(lags + 1)]) / (d @ d)


@pytest.mark.parametrize("size", [40, 2016])
def test_acf(spark, size):
    x = series()
    got = stats.acf(framed(spark, x), "x", 60, Chunks(size=size)).orderBy("lag").toPandas()["acf"]
    np.testing.assert_allclose(got, acf_by_hand(x, 60), rtol=1e-8, atol=1e-10)


def test_pacf_solves_the_yule_walker_equations(spark):
    x = series()
    got = stats.pacf(framed(spark, x), "x", 20, Chunks(size=64)).orderBy("lag").toPandas()["pacf"]
    r = acf_by_hand(x, 20)
    want = [1.0]
    for k in range(1, 21):
        toeplitz = r[np.abs(np.subtract.outer(range(k), range(k)))]
        want.append(np.linalg.solve(toeplitz, r[1 : k + 1])[-1])
    np.testing.assert_allclose(got, want, rtol=1e-7, atol=1e-9)


def adf_by_hand(x):
    n = len(x)
    top = stats.adf_max_lag(n)
    d = np.diff(x)

    def regress(lags, first):
        t = np.arange(first, n)
        cols = [np.ones(len(t)), x[t - 1]] + [d[t - 1 - i] for i in range(1, lags + 1)]
        design, y = np.column_stack(cols), d[t - 1]
        b, *_ = np.linalg.lstsq(design, y, rcond=None)
        left = ((y - design @ b) ** 2).sum()
        return design, b, left, len(t)

    aic = []
    for lags in range(top + 1):
        _, _, left, m = regress(lags, top + 1)
        aic.append(m * (math.log(2 * math.pi * left / m) + 1) + 2 * (lags + 2))
    used = int(np.argmin(aic))
    design, b, left, m = regress(used, used + 1)
    se = math.sqrt(left / (m - used - 2) * np.linalg.inv(design.T @ design)[1, 1])
    return b[1] / se, used, m


@pytest.mark.parametrize("size", [70, 2016])
def test_adf(spark, size):
    for x in (series(), series(300, 5).cumsum()):
        got = stats.adf(framed(spark, x), "x", Chunks(size=size)).first()
        stat, used, rows = adf_by_hand(x)
        assert got.statistic == pytest.approx(stat, rel=1e-5)
        assert (got.lags_used, got.observations) == (used, rows)
        assert 0 <= got.p_value <= 1 and got.crit_1 < got.crit_5 < got.crit_10


def test_adf_drops_gaps_first(spark):
    x = series(400)
    with_gaps = np.insert(x, [50, 51, 200], np.nan)
    assert stats.adf(framed(spark, with_gaps), "x").first().statistic == pytest.approx(stats.adf(framed(spark, x), "x").first().statistic)


def test_adf_lag_rule_has_no_upper_bound():
    assert stats.adf_max_lag(100_000_000) == 380


def test_adf_of_a_short_series_beside_a_long_one(spark):
    long, short = series(300, 5).cumsum(), series(60, 6)
    both = framed(spark, long).withColumn("zone", F.lit("long")).unionByName(framed(spark, short).withColumn("zone", F.lit("short")))
    got = {r.zone: r for r in stats.adf(both, "x").collect()}
    for zone, x in (("long", long), ("short", short)):
        stat, used, rows = adf_by_hand(x)
        assert got[zone].statistic == pytest.approx(stat, rel=1e-5) and (got[zone].lags_used, got[zone].observations) == (used, rows)


def test_adf_p_value_known_points():
    assert stats.adf_p_value(-2.86154) == pytest.approx(0.05, abs=2e-3)
    assert stats.adf_p_value(-3.43035) == pytest.approx(0.01, abs=2e-3)
    assert stats.adf_p_value(5) == 1.0 and stats.adf_p_value(-30) == 0.0


def kpss_by_hand(x):
    n, e = len(x), x - x.mean()
    covlags = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, covlags + 1):
        prod = e[i:] @ e[: n - i] / (n / 2)
        s0, s1 = s0 + prod, s1 + i * prod
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = e @ e
    for i in range(1, lags + 1):
        var += 2 * (e[i:] @ e[: n - i]) * (1 - i / (lags + 1))
    stat = (e.cumsum() ** 2).sum() / n**2 / (var / n)
    p = np.interp(stat, stats.KPSS_CRITICAL, stats.KPSS_P)
    return stat, p, lags


@pytest.mark.parametrize("size", [33, 2016])
def test_kpss(spark, size):
    for x in (series(), np.linspace(0, 10, 300) + series(300, 9)):
        got = stats.kpss(framed(spark, x), "x", Chunks(size=size)).first()
        stat, p, lags = kpss_by_hand(x)
        assert got.statistic == pytest.approx(stat, rel=1e-8)
        assert got.p_value == pytest.approx(p, abs=1e-9) and got.lags_used == lags


def test_normality(spark):
    frame = hourly(300)
    df = to_spark(spark, frame)
    x = frame["net_flow"].to_numpy()
    z = (x - x.mean()) / x.std()
    jb = len(x) / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4)
    got = stats.normality(df, "net_flow").first()
    assert got.statistic == pytest.approx(jb) and got.p_value == pytest.approx(math.exp(-jb / 2))
    assert stats.ks_normality(df, "net_flow").first().p_value > 0.05
