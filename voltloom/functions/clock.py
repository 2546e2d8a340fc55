"""Calendar, cyclical and clock-change columns of a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public holidays of Greece, one line per year.
GREEK_HOLIDAYS = {
    2024: "01-01 01-06 02-12 03-25 03-31 05-01 05-03 05-05 05-06 08-15 10-28 12-25 12-26",
    2025: "01-01 01-06 03-03 03-25 04-18 04-20 04-21 05-01 08-15 10-28 11-17 12-25 12-26",
    2026: "01-01 01-06 02-23 03-25 04-19 04-20 05-01 08-15 10-28 11-17 12-25 12-26",
    2027: "01-01 01-06 03-15 03-25 05-01 05-09 05-10 08-15 10-28 11-17 12-25 12-26",
    2028: "01-01 01-06 03-06 03-25 04-30 05-01 08-15 10-28 11-17 12-25 12-26",
    2029: "01-01 01-06 02-19 03-25 04-15 04-16 05-01 08-15 10-28 11-17 12-25 12-26",
    2030: "01-01 01-06 03-11 03-25 05-01 05-05 05-06 08-15 10-28 11-17 12-25 12-26",
}
# Clock-change hours, and how far around one an hour is flagged.
SPRING_HOUR, AUTUMN_HOUR, DST_REACH_SECONDS = 3, 4, 86_400

DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def holiday_dates(years=None) -> list[str]:
    return [
        f"{year}-{day}"
        for year, days in GREEK_HOLIDAYS.items()
        if years is None or year in years
        for day in days.split()
    ]


def holiday_table(spark: SparkSession, years=None, dates: list[str] | None = None) -> DataFrame:
    """(day, is_holiday, is_holiday_eve): every holiday and every eve, one row per day.

    The list is a parameter of at most a few hundred days, so it is safe to broadcast.
    """
    days = holiday_dates(years) if dates is None else sorted(set(dates))
    if not days:
        return spark.sql("SELECT DATE'1970-01-01' AS day, 0 AS is_holiday, 0 AS is_holiday_eve WHERE false")
    listed = ", ".join(f"(DATE'{d}')" for d in days)
    return spark.sql(
        f"""SELECT day, max(h) AS is_holiday, max(e) AS is_holiday_eve FROM (
              SELECT day, 1 AS h, 0 AS e FROM VALUES {listed} AS v(day)
              UNION ALL
              SELECT date_sub(day, 1), 0, 1 FROM VALUES {listed} AS v(day)) GROUP BY day"""
    )


def local_clock(ts: Column, tz: str | None) -> Column:
    """The zone's wall clock for a UTC instant."""
    return ts if tz is None else F.from_utc_timestamp(ts, tz)


def basic(clock: Column) -> dict[str, Column]:
    """hour, day_of_week (Monday 0), month, is_weekend, day_of_year and ISO week."""
    return {
        "hour": F.hour(clock),
        "day_of_week": F.weekday(clock),
        "month": F.month(clock),
        "is_weekend": (F.weekday(clock) >= 5).cast("int"),
        "day_of_year": F.dayofyear(clock),
        "week_of_year": F.weekofyear(clock),
    }


def part_of_day(clock: Column) -> Column:
    """0 night (0-6), 1 morning (7-12), 2 afternoon (13-18), 3 evening (19-23)."""
    h = F.hour(clock)
    return F.when(h <= 6, 0).when(h <= 12, 1).when(h <= 18, 2).otherwise(3)


def _circle(name: str, value: Column, period: int) -> dict[str, Column]:
    angle = value * (2.0 * math.pi / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def cyclical_hour(clock: Column) -> dict[str, Column]:
    hour = F.hour(clock) + F.minute(clock) / 60.0
    return {"hour_of_week": F.weekday(clock) * 24.0 + hour, **_circle("hour", hour, 24)}


def cyclical_day_of_week(clock: Column) -> dict[str, Column]:
    return _circle("dow", F.weekday(clock), 7)


def cyclical_day_of_year(clock: Column) -> dict[str, Column]:
    return _circle("doy", F.dayofyear(clock), 365)


def cyclical_month(clock: Column) -> dict[str, Column]:
    return _circle("month", F.month(clock), 12)


def cyclical(clock: Column) -> dict[str, Column]:
    return {
        **cyclical_hour(clock),
        **cyclical_day_of_week(clock),
        **cyclical_day_of_year(clock),
        **cyclical_month(clock),
    }


def _last_sunday(year: Column, month: int) -> Column:
    month_end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(month_end, 7), "Sun")


def spring_change(year: Column) -> Column:
    """Last Sunday of March, 03:00."""
    return _last_sunday(year, 3).cast("timestamp") + F.expr(f"INTERVAL {SPRING_HOUR} HOURS")


def autumn_change(year: Column) -> Column:
    """Last Sunday of October, 04:00."""
    return _last_sunday(year, 10).cast("timestamp") + F.expr(f"INTERVAL {AUTUMN_HOUR} HOURS")


def _near(clock: Column, change: Column) -> Column:
    return F.abs(F.unix_micros(clock) - F.unix_micros(change)) <= DST_REACH_SECONDS * 1_000_000


def dst_flags(clock: Column, years=None, every_row_is_autumn: bool = False) -> dict[str, Column]:
    """Flags for hours within a day of a clock change.

    A clock change never lies within a day of New Year, so each row needs only the changes of
    its own year, and no join. ``every_row_is_autumn`` gives the other known behaviour, in which
    the autumn flag is set on every row.
    """
    year = F.year(clock)
    covered = F.lit(True) if years is None else year.isin([int(y) for y in years])
    spring = (covered & _near(clock, spring_change(year))).cast("int")
    autumn = F.lit(1) if every_row_is_autumn else (covered & _near(clock, autumn_change(year))).cast("int")
    return {
        "is_dst_spring": spring,
        "is_dst_autumn": autumn,
        "is_dst_transition": F.greatest(spring, autumn),
    }
