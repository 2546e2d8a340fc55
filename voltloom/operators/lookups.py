"""Joins to small tables: holidays, seasonal means, clock changes, folds, per-series statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock


def salted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread_by=("ts",), fanout: int = 16) -> DataFrame:
    """Left join to a table with one row per series, safe for a hot series.

    Rows of a series are scattered over ``fanout`` sub-keys and the table is repeated once for
    each. Nothing is forced to broadcast: at run time the planner does so only if the table is small.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(fanout)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def holiday_lookup(df: DataFrame, ts="ts", tz: str | None = None, years=None, dates=None) -> DataFrame:
    """Add is_holiday and is_holiday_eve for the local date, with one broadcast join."""
    table = F.broadcast(clock.holiday_table(df.sparkSession, years, dates))
    marked = df.withColumn("day", F.to_date(clock.local_clock(F.col(ts), tz)))
    return (
        marked.join(table, "day", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("is_holiday", "is_holiday_eve")})
        .drop("day")
    )


def seasonal_means(df: DataFrame, value: str, keys=("zone",), ts="ts", tz: str | None = None, out="seasonal") -> DataFrame:
    """Mean by (series, day of week, hour): 168 rows per series."""
    local = clock.local_clock(F.col(ts), tz)
    return df.groupBy(*keys, F.weekday(local).alias("dow"), F.hour(local).alias("hour")).agg(F.avg(value).alias(out))


def seasonal_lookup(df: DataFrame, means: DataFrame, keys=("zone",), ts="ts", tz: str | None = None) -> DataFrame:
    """Attach the bucket mean. The key has 168 values per series, so a hot series is spread."""
    local = clock.local_clock(F.col(ts), tz)
    marked = df.withColumns({"dow": F.weekday(local), "hour": F.hour(local)})
    return marked.join(means, [*keys, "dow", "hour"], "left").drop("dow", "hour")


def dst_table(years: DataFrame, year="year") -> DataFrame:
    """(year, kind, change): two clock changes per year."""
    y = F.col(year)
    return years.select(
        y.alias("year"),
        F.explode(
            F.array(
                F.struct(F.lit("spring").alias("kind"), clock.spring_change(y).alias("change")),
                F.struct(F.lit("autumn").alias("kind"), clock.autumn_change(y).alias("change")),
            )
        ).alias("t"),
    ).select("year", "t.kind", "t.change")


def dst_range_join(df: DataFrame, ts="ts", tz: str | None = None) -> DataFrame:
    """Rows within a day of a clock change, with the change.

    A range condition, run as an equi-join on the year with the distance as a residual test.
    The table holds two rows for each calendar year present, so its size is bounded by the
    calendar, and it may be broadcast.
    """
    marked = df.withColumn("_clock", clock.local_clock(F.col(ts), tz)).withColumn("year", F.year("_clock"))
    changes = F.broadcast(dst_table(marked.select("year").distinct()))
    gap = F.unix_micros("_clock") - F.unix_micros("change")
    near = marked.join(changes, "year").where(F.abs(gap) <= clock.DST_REACH_SECONDS * 1_000_000)
    return near.withColumn("seconds_from_change", F.try_divide(gap, F.lit(1_000_000.0))).drop("_clock", "year")


def domain_lookup(df: DataFrame, codes: dict[str, str], zone="zone", out="domain_code") -> DataFrame:
    """Zone to area code by upper-cased key; an unknown zone passes through."""
    listed = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in codes.items())
    table = df.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS v(_zone, _code)")
    joined = df.join(F.broadcast(table), F.upper(zone) == F.col("_zone"), "left")
    return joined.withColumn(out, F.coalesce("_code", zone)).drop("_zone", "_code")
