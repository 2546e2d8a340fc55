"""Hourly means of readings that arrive as a stream, some of them late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def resample_stream(readings: DataFrame, values: list[str], delay: str = "1 hour", keys=("zone",), ts="ts") -> DataFrame:
    """Mean per series and hour. An hour is final once no reading younger than ``delay`` can change it."""
    hour = F.window(ts, "1 hour")
    means = readings.withWatermark(ts, delay).groupBy(*keys, hour.alias("_hour"))
    return means.agg(*[F.avg(v).alias(v) for v in values]).select(*keys, F.col("_hour.start").alias(ts), *values)


def write_stream(df: DataFrame, path: str, checkpoint_path: str) -> StreamingQuery:
    """Append finished hours to Parquet, working through all input there is and then stopping."""
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def write_updates(df: DataFrame, path: str, checkpoint_path: str) -> StreamingQuery:
    """Write every hour that a batch changed, open or finished, to a folder of the batch; a repeated batch replaces its own.

    ``newest`` reads the table back. Hours still open when the input ends are therefore not lost.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def newest(updates: DataFrame, keys=("zone", "ts"), batch: str = "batch") -> DataFrame:
    """The last written state of every hour."""
    values = [c for c in updates.columns if c not in (*keys, batch)]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), batch).alias("_last")).select(*keys, "_last.*")
