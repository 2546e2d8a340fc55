"""Readers of landed files: prices, load, generation, flows, snapshots and fallbacks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import time_filter

SERIES_SCHEMA = T.StructType(
    [
        T.StructField("zone", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)
GENERATION_SCHEMA = T.StructType(
    [
        T.StructField("zone", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("fuel", T.StringType()),
        T.StructField("mw", T.DoubleType()),
    ]
)
FLOW_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("out_zone", T.StringType()),
        T.StructField("in_zone", T.StringType()),
        T.StructField("mw", T.DoubleType()),
    ]
)


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with a declared schema; an empty one where nothing has landed."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_hourly(
    spark: SparkSession, path: str, schema: T.StructType, zone: str | None = None, start=None, end=None
) -> DataFrame:
    """The hourly table, optionally one zone and a time range.

    The range prunes date folders where there are any, and both filters reach the file scan.
    """
    df = scan(spark, path, schema)
    if "date" in df.columns and "date" not in schema.names:
        if start is not None:
            df = df.where(F.col("date") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if zone is not None:
        df = df.where(F.col("zone") == zone)
    return time_filter(df, before=end, since=start).select(*schema.names)


def landed_series(spark: SparkSession, path: str, name: str, start, end, zone: str | None = None) -> DataFrame:
    """Prices or load in [start, end): (zone, ts, <name>)."""
    return scan_hourly(spark, path, SERIES_SCHEMA, zone, start, end).withColumnRenamed("value", name)


def fuel_column(fuel: Column) -> Column:
    return F.concat(F.lit("gen_"), F.regexp_replace(F.lower(fuel), " ", "_"))


def landed_generation(
    spark: SparkSession, path: str, fuels: list[str], start, end, zone: str | None = None, rest: str | None = None
) -> DataFrame:
    """One column ``gen_<fuel>`` per listed fuel. The list is fixed, so no extra pass looks for fuels.

    ``rest`` names a column for the fuels that are not listed: the sum of what each of them generated.
    """
    tidy = scan_hourly(spark, path, GENERATION_SCHEMA, zone, start, end).withColumn("fuel", fuel_column(F.col("fuel")))
    names = ["gen_" + f.lower().replace(" ", "_") for f in fuels]
    means = [F.avg(F.when(F.col("fuel") == n, F.col("mw"))).alias(n) for n in names]
    if rest is None:
        return tidy.groupBy("zone", "ts").agg(*means)
    # Means per fuel first, so that repeated readings of an unlisted fuel count once.
    each = tidy.groupBy("zone", "ts", "fuel").agg(F.avg("mw").alias("mw"))
    listed = F.coalesce(F.col("fuel").isin(names), F.lit(False))
    return each.groupBy("zone", "ts").agg(*means, F.sum(F.when(~listed, F.col("mw"))).alias(rest))


def landed_flows(spark: SparkSession, path: str, start, end, out_zone: str, in_zone: str) -> DataFrame:
    """(ts, flow): net flow between two zones, positive from ``out_zone`` to ``in_zone``."""
    flows = time_filter(scan(spark, path, FLOW_SCHEMA), before=end, since=start)
    forward = (F.col("out_zone") == out_zone) & (F.col("in_zone") == in_zone)
    back = (F.col("out_zone") == in_zone) & (F.col("in_zone") == out_zone)
    signed = F.when(forward, F.col("mw")).otherwise(-F.col("mw"))
    return flows.where(forward | back).groupBy("ts").agg(F.sum(signed).alias("flow"))


def read_snapshots(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """All snapshot files with the name each row came from."""
    return spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths)).withColumn(
        "snapshot", F.col("_metadata.file_path")
    )


def latest_snapshot(df: DataFrame, keys: list[str], snapshot="snapshot") -> DataFrame:
    """The row of the newest snapshot per key, newest by name. An aggregate, so duplicates combine
    before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), snapshot).alias("_r")).select(*keys, "_r.*")


def newest_files(spark: SparkSession, paths: str | list[str], name: str, by: list[int], version: int) -> list[str]:
    """The files of the newest snapshot of each kind, chosen by name before any row is read.

    ``name`` is a pattern over a file's path; its groups ``by`` say what is a kind of its own (say, table and zone), its group
    ``version`` orders the snapshots, as text. Files whose path does not match are left out. Only the paths are read, and
    the files of older snapshots never.
    """
    found = spark.read.format("parquet").schema("_none int").load([paths] if isinstance(paths, str) else list(paths))
    found = found.select(F.col("_metadata.file_path").alias("path")).distinct().where(F.col("path").rlike(name))
    kind = F.array(*[F.regexp_extract("path", name, g) for g in by])
    named = found.select("path", kind.alias("kind"), F.regexp_extract("path", name, version).alias("version"))
    files = named.groupBy("kind", "version").agg(F.sort_array(F.collect_list("path")).alias("files"))
    newest = files.groupBy("kind").agg(F.max_by("files", "version").alias("files"))
    return sorted(f for r in newest.collect() for f in r.files)


def read_newest(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, name: str, by: list[int], version: int
) -> DataFrame:
    """The rows of the newest snapshot of each kind; empty if no file matches. See ``newest_files``."""
    chosen = newest_files(spark, paths, name, by, version)
    return read_snapshots(spark, chosen, schema) if chosen else spark.createDataFrame([], schema).withColumn("snapshot", F.lit(""))


def with_fallback(live: DataFrame, *fallbacks: DataFrame, keys=("zone", "ts")) -> DataFrame:
    """Live rows, then rows of each fallback for keys still missing."""
    result = live
    for other in fallbacks:
        result = result.unionByName(other.join(result.select(*keys), list(keys), "left_anti"))
    return result
