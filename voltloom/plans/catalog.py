"""The registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# Means of cents often lie exactly on a rounding tie, where the last bit of a sum decides. Adding a
# small part of the last digit settles them the same way on both sides.
NUDGE = 0.031


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """One representation per kind of value: rounded doubles, BIGINT counts, dates as text."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + NUDGE * 10.0**-digits, digits)
        elif isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def sql(ctes: list[str], body: str, keep: str = "", real: str = "", whole: str = "", digits: int = DIGITS) -> str:
    """Wrap a query so that its columns are represented the way ``tidy`` does it."""
    columns = [
        *keep.split(),
        *[f"round(CAST({c} AS DOUBLE) + {NUDGE * 10.0**-digits!r}, {digits}) AS {c}" for c in real.split()],
        *[f"CAST({c} AS BIGINT) AS {c}" for c in whole.split()],
    ]
    head = ",\n".join(ctes)
    return f"WITH RECURSIVE {head + ',' if head else ''}\nanswer AS ({body})\nSELECT {', '.join(columns)} FROM answer"


def register(name: str, oracle: str | None = None, digits: int = DIGITS):
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(prepare(spark), sf_dir), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


# ── SQL building blocks for the checks ──────────────────────────────────────

_ROLES = """avg(value) - 25 AS price, sum(value) AS load,
  sum(CASE WHEN k >= 0 AND k < 20 THEN value ELSE 0 END) AS gen_solar,
  sum(CASE WHEN k >= 20 AND k < 40 THEN value ELSE 0 END) AS gen_wind,
  sum(CASE WHEN k >= 40 AND k < 60 THEN value ELSE 0 END) AS gen_gas,
  sum(CASE WHEN k >= 60 AND k < 80 THEN value ELSE 0 END) AS gen_hydro,
  avg(k) AS temperature, min(value) AS wind_speed, max(k) / 100.0 AS cloud_cover,
  max(value) * 10.0 AS solar_irradiance,
  sum(CASE WHEN k < 50 THEN value ELSE -value END) AS net_flow"""

READINGS = (
    "readings AS (SELECT event_type AS zone, ts, value, CAST(props->>'$.k' AS DOUBLE) AS k FROM events)"
)
HOURS = f"hours AS (SELECT zone, date_trunc('hour', ts) AS ts, {_ROLES} FROM readings GROUP BY 1, 2)"
SPINE = (
    "spine AS (SELECT zone, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), "
    "INTERVAL 1 HOUR)) AS ts FROM readings GROUP BY zone)"
)
MARKET = [READINGS, HOURS, SPINE, "market AS (SELECT * FROM spine LEFT JOIN hours USING (zone, ts))"]
TOTAL = [READINGS.replace("event_type AS zone", "'ALL' AS zone"), *MARKET[1:]]
DAILY = [
    "days AS (SELECT o_orderpriority AS zone, date_trunc('day', o_orderdate) AS ts, "
    "avg(o_totalprice / 1000.0) AS price, CAST(count(*) AS DOUBLE) AS load FROM orders GROUP BY 1, 2)",
    "dspine AS (SELECT zone, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS TIMESTAMP) AS ts "
    "FROM days GROUP BY zone)",
    "daily AS (SELECT * FROM dspine LEFT JOIN days USING (zone, ts))",
]
LOG = [
    *MARKET,
    "log AS (SELECT a.zone, CAST(floor(epoch(a.ts) / 86400) AS BIGINT) AS iteration, a.ts, hour(a.ts) + 1 AS horizon, "
    "a.price AS y_true, b.price AS y_pred FROM market a LEFT JOIN market b "
    "ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 24 HOUR)",
    "errs AS (SELECT *, y_true - y_pred AS error, abs(y_true - y_pred) AS abs_error FROM log)",
]
