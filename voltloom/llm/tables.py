"""Shared helpers: stored intermediate tables, size-checked broadcasts, global ranks and batch sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, work_path

#: Rows of a Python batch; whole texts of any length must fit in a worker's memory this many at a time.
BATCH_ROWS = 512
#: Bytes of a batch, unless a single row is longer.
BATCH_BYTES = 4 << 20
#: A worker gives freed memory back to the machine instead of keeping it for later tasks.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: A side with at most this many rows of a few numbers each may be broadcast.
BROADCAST_ROWS = 1_000_000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Limit what Spark hands to a Python worker at once and what the worker keeps, and make sure that workers have this package."""
    ship(spark)
    for name, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, is computed once.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(hadoop).deleteOnExit(target)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored side if it is counted to be small, else leave the join to a shuffle. The result is the same."""
    return F.broadcast(df) if df.count() <= rows else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, order: list, label: str, rank: str = "rank") -> DataFrame:
    """Add the global position (from 0) under ``order``, without a task that sees all rows.

    Rows are dealt by ranges of the order and sorted in each; the number of rows before a range is added afterwards.
    Equal rows may take any of their places. Only counts of ranges reach the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The written order of a range is kept by the id: its upper bits name the range, its lower 33 bits the place in it.
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), label)
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("part")).count().collect()
    before, total = [], 0
    for part, count in sorted((r["part"], r["count"]) for r in ranges):
        before.append((part, total))
        total += count
    offsets = F.create_map(*[F.lit(x) for pair in before for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    start = F.element_at(offsets.cast("map<bigint,bigint>"), F.shiftright("_at", 33).cast("bigint"))
    return placed.withColumn(rank, start + local).drop("_at")
