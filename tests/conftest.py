import os
import sys

import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from voltloom.session import build  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "8", 4)
    yield session
    session.stop()


def hourly(hours: int, zones=("A",), start="2025-06-01", seed=7, gaps: float = 0.0) -> pd.DataFrame:
    """Hourly rows per zone: a daily and weekly rhythm with noise."""
    rng = np.random.default_rng(seed)
    frames = []
    for i, zone in enumerate(zones):
        ts = pd.date_range(start, periods=hours, freq="h")
        t = np.arange(hours)
        price = 50 + 10 * i + 20 * np.sin(2 * np.pi * t / 24) + 5 * np.sin(2 * np.pi * t / 168) + rng.normal(0, 3, hours)
        frame = pd.DataFrame({
            "zone": zone, "ts": ts, "price": price, "load": 5000 + 30 * price + rng.normal(0, 50, hours),
            "gen_solar": np.clip(800 * np.sin(2 * np.pi * (t - 6) / 24), 0, None), "gen_wind": rng.uniform(100, 700, hours),
            "temperature": 15 + 8 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 1, hours), "net_flow": rng.normal(0, 100, hours),
        })
        if gaps:
            frame.loc[rng.random(hours) < gaps, ["price", "load"]] = np.nan
        frames.append(frame)
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, frame: pd.DataFrame):
    from pyspark.sql import functions as F

    from voltloom.functions.numeric import clean

    df = spark.createDataFrame(frame)
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: clean(F.col(c)) for c in doubles}).withColumn("ts", F.col("ts").cast("timestamp"))
