import numpy as np
import pandas as pd
import pytest
from conftest import hourly, to_spark
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from voltloom.operators import ranking, reshape, windows
from voltloom.operators.windows import Chunks


@pytest.mark.parametrize("size", [24, 50, 500])
def test_chunked_window_equals_plain_window(spark, size):
    df = to_spark(spark, hourly(200, ("A", "B"), gaps=0.1))
    build = lambda w: {
        "lag": F.lag("price", 30).over(w), "mean": windows.roll_mean("price", 48, w), "std": windows.roll_std("price", 24, w),
        "strict": windows.full_window("price", 24, w, F.avg), "z": windows.roll_zscore("price", 24, w),
    }
    chunked = windows.over_chunks(df, 48, build, Chunks(size=size)).orderBy("zone", "ts").toPandas()
    plain = df.withColumns(build(Window.partitionBy("zone").orderBy("ts"))).orderBy("zone", "ts").toPandas()
    pd.testing.assert_frame_equal(chunked[plain.columns], plain, rtol=1e-9)


def test_no_chunk_holds_a_whole_series(spark):
    df = to_spark(spark, hourly(400))
    largest = windows.spread(df, 30, Chunks(size=40)).groupBy("zone", "_chunk").count().agg(F.max("count")).first()[0]
    assert largest <= 70


def test_positions_over_chunks(spark):
    frame = hourly(150, ("A", "B")).iloc[3:]
    got = windows.positions(to_spark(spark, frame), Chunks(size=17), "pos", "n").orderBy("zone", "ts").toPandas()
    assert got[got.zone == "A"]["pos"].tolist() == list(range(147))
    assert set(got[got.zone == "B"]["n"]) == {150}


def test_last_rows_and_split(spark):
    df = to_spark(spark, hourly(100, ("A", "B")))
    tail = reshape.last_rows(df, 30, Chunks(size=8)).toPandas()
    assert len(tail) == 60 and tail.groupby("zone").ts.min().nunique() == 1
    assert tail.sort_values(["zone", "ts"]).groupby("zone").from_end.apply(list).tolist() == [list(range(30, 0, -1))] * 2
    marked = reshape.split_by_position(df, 0.83, Chunks(size=8)).groupBy("zone").agg(F.sum(F.col("is_train").cast("int")).alias("n"))
    assert {r.n for r in marked.collect()} == {83}


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_percent_rank_averages_ties(spark, hot_rows):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"zone": rng.choice(["A", "B"], 400), "ts": range(400), "x": rng.integers(0, 40, 400).astype(float)})
    frame.loc[:130, "x"] = 7.0  # a third of the rows share one value
    frame.loc[rng.random(400) < 0.1, "x"] = np.nan
    df = spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = ranking.percent_rank(df, ["zone"], "x", "pct", "ts", hot_rows, buckets=5).orderBy("ts").toPandas()
    want = frame.groupby("zone")["x"].rank(pct=True)
    np.testing.assert_allclose(got["pct"].to_numpy(dtype=float), want.to_numpy(), rtol=1e-12)


def test_percent_rank_against_training_rows(spark):
    frame = pd.DataFrame({"zone": "A", "ts": range(6), "x": [1.0, 2.0, 3.0, 4.0, 2.5, 9.0]})
    df = spark.createDataFrame(frame)
    got = ranking.percent_rank(df, ["zone"], "x", "pct", counted=F.col("ts") < 4).orderBy("ts").toPandas()["pct"]
    assert got.tolist() == [0.25, 0.5, 0.75, 1.0, 0.5, 1.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_exact_quantiles(spark, values, q):
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": np.array(values, dtype=float)}))
    got = ranking.exact_quantiles(df, ["k"], "x", {"q": q}, buckets=4).first()["q"]
    assert got == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_median_impute_without_keys(spark):
    df = to_spark(spark, hourly(60, gaps=0.2))
    want = hourly(60, gaps=0.2)
    want["price"] = want["price"].fillna(want["price"].median())
    got = reshape.median_impute(df, ["price"], keys=()).orderBy("ts").toPandas()
    np.testing.assert_allclose(got["price"], want["price"])


def test_guard_reports_short_series(spark):
    df = to_spark(spark, pd.concat([hourly(30, ("A",)), hourly(10, ("B",))]))
    rows = {r.zone: r.enough for r in reshape.count_guard(df, 20).collect()}
    assert rows == {"A": True, "B": False}
