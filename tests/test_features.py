import numpy as np
import pandas as pd
import pytest
from conftest import hourly, to_spark
from pyspark.sql import functions as F

from voltloom.functions import clock, metrics
from voltloom.operators import features, roles
from voltloom.operators.features import FeatureBuilder, FeatureModel, FeatureSpec, build_features, engineer_features


def grid_frame(hours: int, start="2025-03-30", **overrides) -> pd.DataFrame:
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({
        "zone": "GR", "ts": pd.date_range(start, periods=hours, freq="h"),
        "price_eur_mwh": np.linspace(30, 80, hours) + rng.normal(0, 2, hours), "load_mw": 5000.0, "gen_gr_solar": 800.0,
        "gen_gr_wind_onshore": 400.0, "temperature_2m_c": 18.0, "wind_speed_100m_km_h": 15.0, "cloud_cover": 50.0, "solar_radiation": 500.0,
    })
    return frame.assign(**overrides)


def made(spark, frame, **params) -> pd.DataFrame:
    return engineer_features(to_spark(spark, frame), zoneName="gr", **params).orderBy("ts").toPandas()


def test_holidays():
    days = set(clock.holiday_dates())
    assert len(days) == 85
    assert {"2025-04-20", "2026-04-19", "2025-03-25", "2026-11-17", "2025-03-03"} <= days
    assert all(len(set(line.split())) == len(line.split()) for line in clock.GREEK_HOLIDAYS.values())


def test_dst_dates(spark):
    y = F.col("year")
    df = spark.createDataFrame([(2024,), (2025,), (2026,)], "year int").select("year", clock.spring_change(y), clock.autumn_change(y))
    got = [tuple(str(v) for v in r) for r in df.orderBy("year").collect()]
    assert got == [
        ("2024", "2024-03-31 03:00:00", "2024-10-27 04:00:00"),
        ("2025", "2025-03-30 03:00:00", "2025-10-26 04:00:00"),
        ("2026", "2026-03-29 03:00:00", "2026-10-25 04:00:00"),
    ]


def test_role_detection():
    assert roles.resolve_roles(["PRICE_EUR_MWH", "load_mw"])["price"] == "PRICE_EUR_MWH"
    assert roles.resolve_roles(["load_forecast_mw", "load_mw"])["load"] == "load_mw"
    found = roles.resolve_roles(["temperature_2m_c", "temp_c", "wind_speed_100m_km_h", "cloud_cover", "foo"])
    assert found == {"temperature": "temp_c", "wind_speed": "wind_speed_100m_km_h", "cloud_cover": "cloud_cover"}
    fuels = roles.resolve_roles(["gen_gr_solar", "gen_gr_wind_onshore", "gen_gr_wind_offshore", "gen_gr_gas", "gen_de_hydro"], "GR")
    assert fuels == {"gen_solar": "gen_gr_solar", "gen_wind": "gen_gr_wind_onshore", "gen_gas": "gen_gr_gas"}
    assert roles.resolve_roles(["import_flow", "flow_gr_bg"])["net_flow"] == "flow_gr_bg"
    with pytest.raises(ValueError, match="no price"):
        roles.require_price(["load_mw"])


def test_grid_values(spark):
    got = made(spark, grid_frame(50))
    np.testing.assert_allclose(got["residual_load"], 3800.0)
    np.testing.assert_allclose(got["renewable_share"], 0.24)
    np.testing.assert_allclose(got["solar_to_residual"], 800 / 3800)
    np.testing.assert_allclose(got["load_pct_of_7d"], 1.0)
    np.testing.assert_allclose(got["solar_estimated_cf"], 0.5)
    assert got["residual_load_pct"].nunique() == 1 and got["residual_load_pct"].iloc[0] == pytest.approx((50 + 1) / 2 / 50)
    assert got["price_roll_zscore_24h"].notna().sum() == 49


def test_feature_count_on_the_usual_layout(spark):
    got = made(spark, grid_frame(30))
    base = {"zone", "ts", "price", "load", "gen_solar", "gen_wind", "temperature", "wind_speed", "cloud_cover", "solar_irradiance"}
    assert len(set(got.columns) - base) == 55


def test_zero_load_and_zero_lag(spark):
    frame = grid_frame(30, load_mw=0.0)
    frame.loc[3:5, ["gen_gr_solar", "gen_gr_wind_onshore"]] = 0.0
    frame.loc[0, "price_eur_mwh"] = 0.0
    got = made(spark, frame)
    assert got["renewable_share"].iloc[0] == 2.0 and got["renewable_share"].iloc[3:6].isna().all()
    assert got["load_pct_of_7d"].isna().all()
    assert np.isnan(got["price_pct_change_24h"].iloc[24]) and not np.isnan(got["price_pct_change_24h"].iloc[25])


def test_lags(spark):
    got = made(spark, grid_frame(200))
    assert got["price_lag_168h"].iloc[:168].isna().all() and got["price_lag_168h"].iloc[168:].notna().all()
    np.testing.assert_allclose(got["price_weekly_delta"].iloc[168:], got["price"].iloc[168:] - got["price"].iloc[:32].to_numpy())


def test_lag_choice(spark):
    got = made(spark, grid_frame(40), lags=[24, 48])
    assert "price_lag_48h" in got and "price_lag_336h" not in got and "price_weekly_delta" not in got


def test_holiday_flags(spark):
    assert made(spark, grid_frame(24, "2025-03-03"))["is_holiday"].all()
    assert made(spark, grid_frame(24, "2025-03-02"))["is_holiday_eve"].all()
    assert not made(spark, grid_frame(24, "2025-02-19"))["is_holiday"].any()


def test_dst_window_is_a_day_on_both_sides(spark):
    got = made(spark, grid_frame(72, "2025-03-29"))
    flagged = got[got["is_dst_spring"] == 1]["ts"]
    assert (str(flagged.min()), str(flagged.max())) == ("2025-03-29 03:00:00", "2025-03-31 03:00:00")
    assert not got["is_dst_autumn"].any() and (got["is_dst_transition"] == got["is_dst_spring"]).all()


def test_autumn_flag_on_every_row_on_request(spark):
    got = made(spark, grid_frame(24, "2025-06-01"), everyRowIsAutumn=True)
    assert got["is_dst_autumn"].all() and got["is_dst_transition"].all()


def test_missing_inputs_are_skipped(spark):
    got = made(spark, grid_frame(30).drop(columns=["price_eur_mwh", "temperature_2m_c"]))
    assert "price_lag_24h" not in got and "weather_temperature_raw" not in got and "residual_load" in got
    assert len(made(spark, grid_frame(1))) == 1


def test_switches(spark):
    got = made(spark, grid_frame(30), cyclical=False, dst=False)
    assert "hour_sin" not in got and "is_dst_spring" not in got and "hour" in got


def test_builder_is_fitted_first(spark):
    with pytest.raises(ValueError, match="not been fitted"):
        FeatureBuilder().transform(to_spark(spark, grid_frame(5)))


def test_fitted_state_is_kept(spark, tmp_path):
    train, test = to_spark(spark, grid_frame(48, "2025-06-01")), to_spark(spark, grid_frame(24, "2025-10-26"))
    model = FeatureBuilder(zoneName="gr", dst=True, years=[2025], rank="none").fit(train)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = FeatureModel.load(str(tmp_path / "m"))
    assert loaded.spec() == model.spec() and loaded.role_map() == model.role_map()
    a, b = (m.transform(test).orderBy("ts").toPandas() for m in (model, loaded))
    pd.testing.assert_frame_equal(a, b)
    assert a["is_dst_autumn"].any()


def test_train_rank_ignores_later_rows(spark):
    frame = hourly(60)
    spec = FeatureSpec(rank="train", train_before="2025-06-02")
    changed = frame.copy()
    changed.loc[30:, "load"] *= 3
    a, b = (build_features(to_spark(spark, f), spec).orderBy("ts").toPandas()["residual_load_pct"] for f in (frame, changed))
    np.testing.assert_allclose(a[:24], b[:24])


def test_shifted_features_do_not_see_the_future(spark):
    frame = hourly(240)
    changed = frame.copy()
    changed.loc[200:, ["price", "load", "gen_wind", "temperature", "net_flow"]] += 1000.0
    spec = FeatureSpec(lags=(24, 48), price_shift=24, exog_shift=24, rank="none")
    a, b = (build_features(to_spark(spark, f), spec).orderBy("ts").toPandas() for f in (frame, changed))
    known = [c for c in a.columns if c not in frame.columns]
    pd.testing.assert_frame_equal(a.loc[:223, known], b.loc[:223, known])
    assert not np.allclose(a.loc[224, "price_roll_mean_24h"], b.loc[224, "price_roll_mean_24h"])


def test_calendar_parts(spark):
    got = made(spark, grid_frame(24, "2025-06-01"))  # a Sunday
    assert got["part_of_day"].tolist() == [0] * 7 + [1] * 6 + [2] * 6 + [3] * 5
    assert set(got["day_of_week"]) == {6} and set(got["is_weekend"]) == {1} and set(got["week_of_year"]) == {22}
    np.testing.assert_allclose(got["hour_sin"] ** 2 + got["hour_cos"] ** 2, 1.0)


def test_local_clock(spark):
    got = made(spark, grid_frame(3, "2025-06-01"), tz="Europe/Athens")
    assert got["hour"].tolist() == [3, 4, 5]


def metric(spark, y, p):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y_true double, y_pred double")
    return df.agg(*metrics.all_metrics()).first()


def test_metric_vectors(spark):
    assert metric(spark, [1, 2, 3], [1.1, 2.1, 2.9]).mae == pytest.approx(0.1)
    assert metric(spark, [1, 2, 3], [1, 2, 3]).rmse == 0
    assert metric(spark, [0, 10], [5, 10]).mape == 0
    assert metric(spark, [0, 0], [5, 5]).mape is None
    assert metric(spark, [100, 100], [110, 90]).smape == pytest.approx(10.025, abs=1e-4)
    df = spark.createDataFrame([(0.0, 1.0)], "y_true double, y_pred double")
    assert df.agg(*metrics.baseline_metrics()).first().mape == float("inf")


def test_spec_defaults_cover_all_groups():
    assert FeatureSpec().halo() >= max(features.LAGS)
