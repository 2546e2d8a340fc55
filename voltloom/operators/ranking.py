"""Exact ranks and quantiles without a whole group in one task.

Equal values are counted first (map-side combined), the distinct values are split into buckets of
about equal size by cut points over all groups, and ranks are prefix sums inside a bucket plus the
bucket's offset. The cut points only balance the work; any cut points give the same result.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_count(df: DataFrame) -> int:
    """A few buckets per shuffle partition, so that a bucket is no larger than a task's usual share."""
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, column: str, buckets: int) -> list[float]:
    """At most ``buckets - 1`` split values, from a bounded sketch."""
    wanted = [i / buckets for i in range(1, buckets)]
    found = df.stat.approxQuantile(column, wanted, 1.0 / (4 * buckets))
    return sorted(set(found))


def _bucketed(counts: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    if not cuts:
        return counts.withColumn("_bucket", F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol="_bucket", handleInvalid="keep").transform(counts)


def distinct_ranks(
    df: DataFrame, keys: list[str], column: str, buckets: int | None = None, counted: Column | None = None
) -> DataFrame:
    """(keys, column, _n, _rows, _before, _total): per distinct value its count, the number of
    smaller values in the group, and the group's size. Only rows where ``counted`` holds are
    counted, but every value gets its place among them; ``_rows`` is the count of all rows."""
    present = df.where(F.col(column).isNotNull())
    rows = F.count(F.lit(1))
    counts = present.groupBy(*keys, column).agg(
        (rows if counted is None else F.count_if(counted)).alias("_n"), rows.alias("_rows")
    )
    counts = _bucketed(counts, column, cut_points(present, column, buckets or bucket_count(df)))
    sizes = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_bn"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(
            F.sum("_bn").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_bn").over(group).alias("_total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return ranked.join(offsets, [*keys, "_bucket"]).select(
        *keys, column, "_n", "_rows", (F.col("_offset") + F.col("_inside")).alias("_before"), "_total"
    )


def percent_rank(
    df: DataFrame,
    keys: list[str],
    column: str,
    out: str,
    spread_by: str = "ts",
    hot_rows: int = 1_000_000,
    buckets: int | None = None,
    counted: Column | None = None,
) -> DataFrame:
    """Rank with ties averaged, over the group's count; null values get null.

    With ``counted`` the rank is against those rows only (say, the training period); a value that
    does not occur there gets the share of those rows that are smaller.

    Ranks come back by value. Values with ``hot_rows`` rows or more number at most
    rows / hot_rows, so those few are broadcast; all other rows meet their rank in a shuffle
    join, with hot and null rows scattered over spare keys.
    """
    place = F.col("_before") + F.when(F.col("_n") > 0, (F.col("_n") + 1) / 2.0).otherwise(0.0)
    ranks = distinct_ranks(df, keys, column, buckets, counted).select(
        *keys, column, "_rows", F.try_divide(place, F.col("_total")).alias(out)
    )
    hot = ranks.where(F.col("_rows") >= hot_rows).select(*keys, column, F.col(out).alias("_hot"))
    cold = ranks.where(F.col("_rows") < hot_rows).select(*keys, column, F.lit(0).cast("bigint").alias("_salt"), out)
    rows = df.join(F.broadcast(hot), [*keys, column], "left")
    aside = F.col("_hot").isNotNull() | F.col(column).isNull()
    scatter = F.pmod(F.xxhash64(*keys, spread_by), F.lit(1024)) + 1
    rows = rows.withColumn("_salt", F.when(aside, scatter).otherwise(F.lit(0).cast("bigint")))
    rows = rows.withColumn("_value", F.when(~aside, F.col(column)).otherwise(F.lit(0.0)))
    cold = cold.withColumnRenamed(column, "_value")
    joined = rows.join(cold, [*keys, "_value", "_salt"], "left")
    return joined.withColumn(out, F.coalesce("_hot", out)).drop("_hot", "_salt", "_value")


def exact_quantiles(
    df: DataFrame, keys: list[str], column: str, wanted: dict[str, float], buckets: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles per group, e.g. ``{"median": 0.5}``."""
    ranks = distinct_ranks(df, keys, column, buckets)

    def at(position: Column) -> Column:
        here = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_n"))
        return F.max(F.when(here, F.col(column)))

    aggregates = []
    for name, q in wanted.items():
        place = F.lit(float(q)) * (F.col("_total") - 1)
        aggregates += [
            at(F.floor(place)).alias(f"_{name}_low"),
            at(F.ceil(place)).alias(f"_{name}_high"),
            F.max(place - F.floor(place)).alias(f"_{name}_part"),
        ]
    picked = ranks.groupBy(*keys).agg(*aggregates)
    return picked.select(
        *keys,
        *[
            (F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n)
            for n in wanted
        ],
    )
