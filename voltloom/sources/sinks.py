"""Writers. Every one is a plain partitioned Spark write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORTS = ("iterations", "daily", "per_hour", "per_horizon", "per_dow", "predictions")


def sink_raw(df: DataFrame, path: str, ts="ts") -> None:
    """Parquet by date, rows of a zone together; a rerun replaces only the dates it holds.

    Rows of a date are brought together, and adaptive execution splits a large date and joins small
    ones by their size. Sorted by zone, a zone filter skips row groups; a folder per zone and date
    would hold 24 rows.
    """
    dated = df.withColumn("date", F.to_date(ts))
    (
        dated.hint("rebalance", "date")
        .sortWithinPartitions("date", "zone", ts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(path)
    )


def sink_forecast(df: DataFrame, path: str) -> None:
    """(zone, ts, forecast_eur_mwh) by reference date; a rerun replaces that date."""
    (
        df.hint("rebalance", "reference_date")
        .sortWithinPartitions("reference_date", "zone", "ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("reference_date")
        .parquet(path)
    )


def sink_reports(tables: dict[str, DataFrame], path: str) -> None:
    """The report tables, each as a folder of CSV files."""
    unknown = set(tables) - set(REPORTS)
    if unknown:
        raise ValueError(f"unknown reports: {sorted(unknown)}")
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def sink_sample(df: DataFrame, path: str, rows: int = 720, ts="ts", keys=("zone",)) -> None:
    """The latest rows for a quick look, as CSV."""
    latest = df.orderBy(F.desc(ts), *keys).limit(rows)
    latest.write.mode("overwrite").option("header", True).csv(path)
