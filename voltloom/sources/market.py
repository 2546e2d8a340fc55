"""The hourly and daily market tables, built from the event and order facts.

A zone is an event type (or an order priority, by day). Roles are conditional aggregates of the
readings in an hour; every reading counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import regular_grid
from ..operators.windows import over_chunks
from ..session import work_path
from .sinks import sink_raw

# Which band of the reading's key stands for which fuel: lower bound, upper bound (exclusive).
FUEL_BANDS = {"solar": (0, 20), "wind": (20, 40), "gas": (40, 60), "hydro": (60, 80)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, ts, value, k): one row per event."""
    return read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("zone"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def aggregate_hours(events: DataFrame, step: str = "hour") -> DataFrame:
    k, value = F.col("k"), F.col("value")

    def where(test) -> Column:
        return F.sum(F.when(test, value).otherwise(0.0))

    return events.groupBy("zone", F.date_trunc(step, "ts").alias("ts")).agg(
        (F.avg(value) - 25.0).alias("price"),
        F.sum(value).alias("load"),
        *[where((k >= low) & (k < high)).alias(f"gen_{fuel}") for fuel, (low, high) in FUEL_BANDS.items()],
        F.avg(k).alias("temperature"),
        F.min(value).alias("wind_speed"),
        (F.max(k) / 100.0).alias("cloud_cover"),
        (F.max(value) * 10.0).alias("solar_irradiance"),
        F.sum(F.when(k < 50, value).otherwise(-value)).alias("net_flow"),
    )


def hourly_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rows per zone on the complete grid; empty hours are null."""
    return regular_grid(aggregate_hours(readings(spark, sf_dir)))


def hourly_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rows per zone, only where readings exist."""
    return aggregate_hours(readings(spark, sf_dir))


def hourly_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series over all zones."""
    # Read off each row: the optimizer drops a literal from join keys, which leaves a product of both sides.
    one = F.concat_ws("", F.lit("ALL"), F.substring("zone", 1, 0))
    events = readings(spark, sf_dir).withColumn("zone", one)
    return regular_grid(aggregate_hours(events))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows per order priority on the complete day grid."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("zone"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        (F.col("o_totalprice") / 1000.0).alias("p"),
    )
    days = orders.groupBy("zone", F.date_trunc("day", "ts").alias("ts")).agg(
        F.avg("p").alias("price"), F.count(F.lit(1)).cast("double").alias("load")
    )
    return regular_grid(days, step="day")


def prediction_log(market: DataFrame) -> DataFrame:
    """Day-ahead persistence as a prediction log: zone, iteration, ts, horizon, y_true, y_pred."""
    lagged = over_chunks(market.select("zone", "ts", "price"), 24, lambda w: {"y_pred": F.lag("price", 24).over(w)})
    return lagged.select(
        "zone",
        F.floor(F.unix_seconds("ts") / 86_400).alias("iteration"),
        "ts",
        (F.hour("ts") + 1).alias("horizon"),
        F.col("price").alias("y_true"),
        "y_pred",
    )


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back, for jobs that pass over it many times."""
    path = work_path(df.sparkSession, "market")
    sink_raw(df, path)
    return df.sparkSession.read.parquet(path).select(*df.columns)
