"""Row selection, filling, and changes between wide and long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookups import salted_lookup
from .ranking import exact_quantiles
from .windows import DEFAULT, Chunks, positions


INDICATORS = (
    *[f"h_{k}" for k in range(24)],
    *[f"dow_{k}" for k in range(7)],
    *[f"mon_{k}" for k in range(1, 13)],
)


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=columns)


def count_guard(df: DataFrame, at_least: int, keys=("zone",)) -> DataFrame:
    """(keys, rows, enough): which series have the rows a step needs. Short ones are reported."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.withColumn("enough", F.col("rows") >= at_least)


def guard_message(have: int, need: int, purpose: str) -> str:
    return f"{purpose}: has {have} rows but needs at least {need}"


def time_filter(df: DataFrame, before=None, since=None, ts="ts") -> DataFrame:
    """Rows in [since, before); a plain comparison, so file scans can skip by it."""
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since).cast("timestamp"))
    if before is not None:
        df = df.where(F.col(ts) < F.lit(before).cast("timestamp"))
    return df


def split_by_position(df: DataFrame, fraction: float, chunks: Chunks = DEFAULT, out: str = "is_train") -> DataFrame:
    """Mark the first int(n * fraction) rows of each series."""
    numbered = positions(df, chunks, "_pos", "_total")
    cut = F.floor(F.col("_total") * F.lit(float(fraction)))
    return numbered.withColumn(out, F.col("_pos") < cut).drop("_pos", "_total")


def last_rows(df: DataFrame, n: int, chunks: Chunks = DEFAULT, out: str = "from_end") -> DataFrame:
    """The last ``n`` rows of each series, numbered 1 = latest.

    Latest rows are first kept per chunk and only then per series, so no task sees a whole series.
    """
    keys = list(chunks.keys)
    marked = df.withColumn("_chunk", chunks.number())
    near = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(chunks.ts))
    sifted = marked.withColumn("_rn", F.row_number().over(near)).where(F.col("_rn") <= n)
    # Chunks older than those that already hold n later rows cannot contribute.
    sizes = sifted.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    ranked = sifted.join(ahead, [*keys, "_chunk"]).withColumn(out, F.col("_later") + F.col("_rn"))
    return ranked.where(F.col(out) <= n).drop("_chunk", "_rn", "_later")


def last_row(df: DataFrame, keys=("zone",), ts="ts") -> DataFrame:
    """The latest row of each series, by a partial-then-final aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ts).alias("_r")).select(*keys, "_r.*")


def median_impute(df: DataFrame, columns: list[str], keys=("zone",), spread_by=("zone", "ts")) -> DataFrame:
    """Fill nulls with the exact median of the column in its series."""
    if not keys:
        one = median_impute(df.withColumn("_all", F.lit(0)), columns, ("_all",), spread_by)
        return one.drop("_all")
    keys = list(keys)
    long = df.select(*keys, F.explode(_named_values(columns)).alias("_kv")).select(*keys, "_kv.name", "_kv.value")
    medians = exact_quantiles(long, [*keys, "name"], "value", {"median": 0.5})
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"_median_{c}") for c in columns]
    )
    filled = salted_lookup(df, wide, keys, spread_by)
    return filled.withColumns({c: F.coalesce(c, f"_median_{c}") for c in columns}).drop(
        *[f"_median_{c}" for c in columns]
    )


def _named_values(columns: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])


def melt(df: DataFrame, keys: list[str], columns: list[str], name="name", value="value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def zero_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.fill(0.0, subset=columns)


def indicator_columns(clock: Column) -> dict[str, Column]:
    """h_0..h_23, dow_0..dow_6, mon_1..mon_12 over their fixed domains."""
    parts = {"h": F.hour(clock), "dow": F.weekday(clock), "mon": F.month(clock)}
    split = {name: name.split("_") for name in INDICATORS}
    return {name: (parts[part] == int(k)).cast("int") for name, (part, k) in split.items()}


def unpivot_horizon(df: DataFrame, vector: str, keys: list[str], origin="origin") -> DataFrame:
    """A forecast vector to rows (keys, origin, horizon, ts, y_pred)."""
    rows = df.select(*keys, origin, F.posexplode(vector).alias("_i", "y_pred"))
    return rows.select(
        *keys,
        origin,
        (F.col("_i") + 1).alias("horizon"),
        (F.col(origin) + F.make_dt_interval(hours=F.col("_i") + 1)).alias("ts"),
        "y_pred",
    )


def heatmap(df: DataFrame, row: Column, row_name: str, value: str, keys=("zone",), ts="ts") -> DataFrame:
    """Mean by (row, hour) with the 24 hours as columns h0..h23; the hour list is fixed, so one pass."""
    by_hour = df.groupBy(*keys, row.alias(row_name), F.hour(ts).alias("_h")).agg(F.avg(value).alias("_m"))
    return by_hour.groupBy(*keys, row_name).agg(
        *[F.max(F.when(F.col("_h") == h, F.col("_m"))).alias(f"h{h}") for h in range(24)]
    )


def append_rows(first: DataFrame, *more: DataFrame) -> DataFrame:
    for other in more:
        first = first.unionByName(other)
    return first


def any_flag(*flags: str) -> Column:
    """1 where any flag is set."""
    test = F.lit(False)
    for f in flags:
        test = test | (F.col(f) == 1)
    return test.cast("int")
