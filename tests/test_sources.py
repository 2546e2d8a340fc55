import json

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL, hourly, to_spark
from pyspark.sql import functions as F

from voltloom import session
from voltloom.operators import grid, lookups, roles
from voltloom.sources import landing, market, sinks, weather
from voltloom.streaming import resample


def test_nothing_landed_gives_an_empty_table(spark, tmp_path):
    df = landing.scan(spark, str(tmp_path / "absent"), landing.SERIES_SCHEMA)
    assert df.count() == 0 and df.schema == landing.SERIES_SCHEMA


def test_rewriting_a_date_leaves_the_others(spark, tmp_path):
    df = to_spark(spark, hourly(48, ("A", "B")))
    path = str(tmp_path / "raw")
    sinks.sink_raw(df, path)
    second = df.where(F.to_date("ts") == F.lit("2025-06-02").cast("date"))
    sinks.sink_raw(second.withColumn("price", F.lit(-1.0)), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 96 and rows.where("price = -1").count() == 48


def test_scan_prunes_dates_and_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = to_spark(spark, hourly(96, ("A", "B")))
    sinks.sink_raw(df, path)
    scan = landing.scan_hourly(spark, path, df.schema, "A", "2025-06-02", "2025-06-03")
    plan = scan.select("price")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "PartitionFilters: [(date" in plan
    assert "EqualTo(zone,A)" in plan and "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<zone:string,ts:timestamp,price:double>" in plan
    assert scan.count() == 24


def test_weather_payload_local_time(spark):
    hours = ["2025-07-01T00:00", "2025-07-01T01:00"]
    payload = json.dumps({"hourly": {"time": hours, **{v: [1.5, None] for v in weather.WEATHER_VARIABLES}}})
    df = spark.createDataFrame([("GR", payload)], "zone string, payload string")
    rows = weather.parse_weather(df, "payload").orderBy("ts").collect()
    assert [str(r.ts) for r in rows] == ["2025-06-30 21:00:00", "2025-06-30 22:00:00"]
    assert rows[0].solar_irradiance_wm2 == 1.5 and rows[1].temperature_2m_c is None


def test_to_utc_over_a_clock_change(spark):
    df = spark.createDataFrame([("2025-03-30 02:30:00",), ("2025-03-30 04:30:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    assert [str(r.ts) for r in grid.to_utc(df, "Europe/Athens").orderBy("ts").collect()] == ["2025-03-30 00:30:00", "2025-03-30 01:30:00"]


def test_domain_codes_pass_unknown_zones_through(spark):
    df = spark.createDataFrame([("gr",), ("XX",)], "zone string")
    assert {r.zone: r.domain_code for r in lookups.domain_lookup(df, roles.DOMAIN_CODES).collect()} == {"gr": "10YGR-HTSO-----Y", "XX": "XX"}


def test_align_needs_tables_with_columns(spark):
    df = to_spark(spark, hourly(3))
    with pytest.raises(ValueError, match="nothing"):
        grid.align_outer([df.select("zone", "ts")])
    merged = grid.align_outer([df.select("zone", "ts", "price"), df.select("zone", "ts"), df.select("zone", "ts", "load").limit(2)])
    assert merged.count() == 3 and merged.where("load is null").count() == 1


def test_gap_hours_appear_as_null_rows(spark):
    frame = hourly(10, ("A",)).drop(index=[3, 4])
    full = grid.regular_grid(to_spark(spark, frame)).orderBy("ts").toPandas()
    assert len(full) == 10 and full["price"].isna().tolist() == [i in (3, 4) for i in range(10)]


def test_newest_files_are_chosen_before_reading(spark, tmp_path):
    for kind, zone, day, value in (("load", "A", "2024-01-07", 1.0), ("load", "A", "2024-01-30", 2.0), ("load", "B", "2024-01-07", 3.0), ("price", "A", "2023-12-31", 4.0)):
        rows = spark.createDataFrame([(zone, None, value)] * 6, landing.SERIES_SCHEMA).repartition(2)
        rows.write.parquet(str(tmp_path / f"{kind}_{zone}_{day}"))
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    name = r"/([a-z]+)_([A-Z])_([0-9-]+)/[^/]+$"
    chosen = landing.newest_files(spark, paths, name, [1, 2], 3)
    found = spark.read.schema(landing.SERIES_SCHEMA).parquet(*chosen)
    assert len(chosen) == 6 and not any("load_A_2024-01-07" in f for f in chosen)
    assert sorted(f.removeprefix("file://") for f in found.inputFiles()) == sorted(f.removeprefix("file:") for f in chosen)
    rows = landing.read_newest(spark, paths, landing.SERIES_SCHEMA, name, [1], 3)
    assert {(r.zone, r.value) for r in rows.collect()} == {("A", 2.0), ("A", 4.0)}
    none = landing.read_newest(spark, paths[-1], landing.SERIES_SCHEMA, "nothing_([0-9]+)", [1], 1)
    assert none.count() == 0 and none.columns == rows.columns


@pytest.mark.parametrize("chunk", [5, 24, 2016])
def test_gaps_are_filled_across_chunks(spark, chunk):
    rng = np.random.default_rng(chunk)
    parts = []
    for zone, hours in (("A", 400), ("B", 90), ("C", 1), (None, 40)):
        frame = hourly(hours, (zone,))
        keep = rng.random(hours) < (0.2 if zone == "A" else 0.7)
        keep[[0, -1]] = True
        if zone == "A":
            keep[100:290] = False  # a gap over many chunks
        parts.append(frame[keep])
    frame = pd.concat(parts, ignore_index=True)
    got = grid.regular_grid(to_spark(spark, frame[["zone", "ts", "price"]]).repartition(5), chunk_steps=chunk).toPandas()
    for zone, own in frame.groupby("zone", dropna=False):
        want = own.set_index("ts").price.asfreq("h")
        mine = got[got.zone.isna() if zone is None or zone != zone else got.zone == zone].sort_values("ts").set_index("ts").price
        pd.testing.assert_series_equal(mine, want, check_freq=False, check_index_type=False)


def test_gap_filling_of_odd_tables(spark):
    day = spark.createDataFrame([("A", "2024-02-27", 1.0), ("A", "2024-03-02", 2.0), ("A", "2024-03-02", 3.0), ("A", None, 4.0)], "zone string, ts string, price double")
    full = grid.regular_grid(day.withColumn("ts", F.col("ts").cast("timestamp")), step="day").orderBy("ts", "price").collect()
    assert [(r.ts.day, r.price) for r in full] == [(27, 1.0), (28, None), (29, None), (1, None), (2, 2.0), (2, 3.0)]
    assert grid.regular_grid(day.limit(0).withColumn("ts", F.col("ts").cast("timestamp")), step="day").count() == 0


@pytest.mark.parametrize("name", ["resample_hourly", "regular_grid", "regular_grid_daily", "lag_k", "roll_mean", "weather_24h", "difference", "to_local"])
def test_market_queries_scan_the_source_once(spark, name):
    from voltloom import plans

    plan = plans.all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan


def test_salted_lookup_splits_a_hot_series(spark):
    df = to_spark(spark, hourly(500, ("A",)))
    table = spark.createDataFrame([("A", 1.0)], "zone string, v double")
    assert lookups.salted_lookup(df, table, ["zone"]).where("v = 1").count() == 500
    salts = df.select(F.pmod(F.xxhash64("ts"), F.lit(16)).alias("s")).groupBy("s").count().toPandas()["count"]
    assert len(salts) == 16 and salts.max() < 100


def test_late_readings_are_counted_in_their_hour(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    first = pd.DataFrame({"zone": "A", "ts": pd.date_range("2025-01-01", periods=12, freq="15min"), "value": range(12)})
    late = pd.DataFrame({"zone": ["A", "A"], "ts": pd.to_datetime(["2025-01-01 02:50", "2025-01-01 09:00"]), "value": [100, 0]})
    schema = "zone string, ts timestamp, value double"
    for i, part in enumerate((first, late)):
        to_spark(spark, part.astype({"value": float})).coalesce(1).write.mode("append").parquet(str(source))
        live = resample.resample_stream(spark.readStream.schema(schema).parquet(str(source)), ["value"])
        resample.write_stream(live, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(str(r.ts)[11:13], r.value) for r in rows] == [("00", 1.5), ("01", 5.5), ("02", (8 + 9 + 10 + 11 + 100) / 5)]


def test_shared_folder_is_read_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert session.work_path(spark, "x").startswith(named or "/tmp/voltloom-")


def test_market_tables(spark):
    hourly_rows = market.hourly_market(spark, SMALL)
    assert hourly_rows.groupBy("zone").count().count() == 5
    assert hourly_rows.count() == hourly_rows.select("zone", "ts").distinct().count()
