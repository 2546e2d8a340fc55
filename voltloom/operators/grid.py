"""Resampling, the complete time grid, and alignment of landed series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP_SECONDS = {"hour": 3600, "day": 86_400}


def resample_mean(df: DataFrame, values: list[str], keys=("zone",), ts="ts", step="hour") -> DataFrame:
    """Mean per step; nulls are skipped. Partial sums combine before the shuffle on (keys, step)."""
    return df.groupBy(*keys, F.date_trunc(step, ts).alias(ts)).agg(*[F.avg(v).alias(v) for v in values])


def time_bounds(df: DataFrame, keys=("zone",), ts="ts", step="hour") -> DataFrame:
    """First and last step per series."""
    return df.groupBy(*keys).agg(
        F.date_trunc(step, F.min(ts)).alias("_first"), F.date_trunc(step, F.max(ts)).alias("_last")
    )


def spine(bounds: DataFrame, keys=("zone",), ts="ts", step="hour") -> DataFrame:
    """Every step between the bounds. Hours are expanded day by day, so no long array is built."""
    days = bounds.select(
        *keys,
        "_first",
        "_last",
        F.explode(
            F.sequence(F.date_trunc("day", "_first"), F.date_trunc("day", "_last"), F.expr("INTERVAL 1 DAY"))
        ).alias("_day"),
    )
    if step == "day":
        return days.select(*keys, F.col("_day").alias(ts))
    hours = days.select(
        *keys,
        "_first",
        "_last",
        F.explode(
            F.sequence("_day", F.col("_day") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))
        ).alias(ts),
    )
    return hours.where(F.col(ts).between(F.col("_first"), F.col("_last"))).select(*keys, ts)


def regular_grid(df: DataFrame, keys=("zone",), ts="ts", step="hour", chunk_steps: int = 2016) -> DataFrame:
    """Put a series on its complete grid, from its first row to its last; missing steps become null rows.

    Each row makes the missing steps behind it, up to the next row of its time chunk. The last row of a chunk finds its next one
    among the first and last rows of all chunks, two a chunk, so nothing is read twice, no spine is joined, and no group is
    larger than a chunk however large one series is. Rows must stand on the steps (see ``resample_mean``); rows without a time are left
    out, and rows of equal key and time all stay.
    """
    keys, seconds = list(keys), STEP_SECONDS[step]
    slot = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)
    values = [c for c in df.columns if c not in (*keys, ts)]
    rows = df.where(F.col(ts).isNotNull()).withColumns({"_slot": slot, "_chunk": F.floor(slot / chunk_steps)})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    rows = rows.withColumns({"_next": F.lead("_slot").over(inside), "_edge": F.lead("_slot").over(inside).isNull() | F.lag("_slot").over(inside).isNull()})
    edges = Window.partitionBy(*keys, "_edge", "_part").orderBy(ts)
    rows = rows.withColumn("_part", F.when(F.col("_edge"), F.lit(0).cast("bigint")).otherwise(F.col("_chunk")))
    rows = rows.withColumn("_to", F.coalesce("_next", F.lead("_slot").over(edges)))
    # A long gap is opened in two levels, so that no long array is built.
    rows = rows.withColumn("_n", F.greatest(F.coalesce(F.col("_to") - F.col("_slot"), F.lit(1)), F.lit(1)) - 1)
    rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"), F.lit(chunk_steps).cast("bigint"))))
    rows = rows.withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_from") + (chunk_steps - 1), F.col("_n")))))
    at = F.col(ts) + (F.make_dt_interval(hours=F.col("_k").cast("int")) if step == "hour" else F.make_dt_interval(days=F.col("_k").cast("int")))
    return rows.select(*keys, at.alias(ts), *[F.when(F.col("_k") == 0, F.col(c)).alias(c) for c in values])


def align_outer(frames: list[DataFrame], keys=("zone", "ts")) -> DataFrame:
    """Full outer merge of any number of tables on the keys, in one shuffle.

    The tables are stacked with nulls for each other's columns and folded back by key, so adding
    a table adds no join. Tables without columns of their own are left out.
    """
    kept = [f for f in frames if set(f.columns) - set(keys)]
    if not kept:
        raise ValueError("nothing to align")
    values = [c for f in kept for c in f.columns if c not in keys]
    if len(values) != len(set(values)):
        raise ValueError("tables to align share a value column")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)
    return stacked.groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def reindex_left(index: DataFrame, series: DataFrame, keys=("zone", "ts")) -> DataFrame:
    """The series on another table's index; null where it has no row."""
    return index.select(*keys).join(series, list(keys), "left")


def future_index(last: DataFrame, horizon: int, ts="ts", origin="origin") -> DataFrame:
    """(…, origin, horizon, ts): the ``horizon`` hours after each row's timestamp."""
    return last.withColumnRenamed(ts, origin).withColumn(
        "horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    ).withColumn(ts, hours_after(F.col(origin), F.col("horizon")))


def hours_after(ts: Column, hours: Column | int) -> Column:
    n = F.lit(hours) if isinstance(hours, int) else hours
    return ts + F.make_dt_interval(hours=n)


def to_utc(df: DataFrame, tz: str, ts="ts") -> DataFrame:
    return df.withColumn(ts, F.to_utc_timestamp(ts, tz))


def to_local(df: DataFrame, tz: str, ts="ts", out="local_ts") -> DataFrame:
    return df.withColumn(out, F.from_utc_timestamp(ts, tz))


def sort_time(df: DataFrame, keys=("zone",), ts="ts") -> DataFrame:
    """Global order for a sink: a range shuffle, not one task."""
    return df.orderBy(*keys, ts)
