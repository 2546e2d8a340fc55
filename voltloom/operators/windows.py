"""Trailing windows that never need a whole series in one task.

A series is cut into time chunks. Each row is copied into the later chunks that can still see it
through a window of ``halo`` steps, the window runs inside (keys, chunk), and only the rows a chunk
owns are kept. On a complete grid this equals the window over the whole series, while the largest
group is ``size + halo`` rows however long or hot a zone is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import ratio


@dataclass(frozen=True)
class Chunks:
    keys: tuple[str, ...] = ("zone",)
    ts: str = "ts"
    step_seconds: int = 3600
    size: int = 2016  # steps a chunk owns: twelve weeks of hours
    index: str | None = None  # an integer column to use as the step number instead of the time

    def slot(self) -> Column:
        """The step number of a row: its index, or the steps since the epoch."""
        if self.index is not None:
            return F.col(self.index)
        return F.floor(F.unix_seconds(self.ts) / self.step_seconds)

    def number(self) -> Column:
        return F.floor(self.slot() / self.size)


DEFAULT = Chunks()


def spread(df: DataFrame, halo: int, chunks: Chunks = DEFAULT) -> DataFrame:
    """Add ``_chunk`` and ``_own``, copying each row to the later chunks within ``halo`` steps."""
    last = F.floor((chunks.slot() + halo) / chunks.size)
    return df.withColumn("_chunk", F.explode(F.sequence(chunks.number(), last))).withColumn(
        "_own", F.col("_chunk") == chunks.number()
    )


def over_chunks(
    df: DataFrame,
    halo: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    chunks: Chunks = DEFAULT,
) -> DataFrame:
    """Add the columns ``build(w)`` names; ``w`` is ordered by time inside (keys, chunk).

    Give all windows of one table in one call: they share one shuffle and one sort.
    """
    w = Window.partitionBy(*chunks.keys, "_chunk").orderBy(chunks.ts)
    return spread(df, halo, chunks).withColumns(build(w)).where("_own").drop("_chunk", "_own")


def trailing(w: WindowSpec, n: int, shift: int = 0) -> WindowSpec:
    """The last ``n`` rows up to ``shift`` rows ago."""
    return w.rowsBetween(-(n - 1 + shift), -shift)


def roll_mean(c: str, n: int, w: WindowSpec, shift: int = 0) -> Column:
    return F.avg(c).over(trailing(w, n, shift))


def roll_std(c: str, n: int, w: WindowSpec, shift: int = 0) -> Column:
    """Sample deviation; null on a single value."""
    return F.stddev_samp(c).over(trailing(w, n, shift))


def roll_zscore(c: str, n: int, w: WindowSpec, shift: int = 0) -> Column:
    value = F.col(c) if shift == 0 else F.lag(c, shift).over(w)
    return ratio(value - roll_mean(c, n, w, shift), roll_std(c, n, w, shift))


def full_window(c: str, n: int, w: WindowSpec, aggregate: Callable[[str], Column]) -> Column:
    """The aggregate, null until ``n`` values are present."""
    frame = trailing(w, n)
    return F.when(F.count(c).over(frame) == n, aggregate(c).over(frame))


def smooth(df: DataFrame, columns: list[str], n: int, chunks: Chunks) -> DataFrame:
    """Trailing means ``<column>_smooth`` over ``n`` steps."""
    return over_chunks(df, n - 1, lambda w: {f"{c}_smooth": roll_mean(c, n, w) for c in columns}, chunks)


def difference(df: DataFrame, column: str, steps: tuple[int, ...], chunks: Chunks = DEFAULT) -> DataFrame:
    """``<column>_diff_<k>``: the change over k steps."""
    return over_chunks(
        df,
        max(steps),
        lambda w: {f"{column}_diff_{k}": F.col(column) - F.lag(column, k).over(w) for k in steps},
        chunks,
    )


def time_lag_join(df: DataFrame, column: str, hours: int, out: str, keys=("zone",), ts="ts") -> DataFrame:
    """The value exactly ``hours`` earlier by clock, whatever rows are missing in between."""
    earlier = df.select(*keys, (F.col(ts) + F.make_dt_interval(hours=F.lit(hours))).alias(ts), F.col(column).alias(out))
    return df.join(earlier, [*keys, ts], "left")


def positions(df: DataFrame, chunks: Chunks = DEFAULT, out: str = "pos", total: str | None = None) -> DataFrame:
    """0-based row number per series in time order, in two levels.

    Rows are counted per chunk, the counts are summed up along the (few) chunks of a series, and
    rows are numbered inside their chunk.
    """
    keys = list(chunks.keys)
    marked = df.withColumn("_chunk", chunks.number())
    sizes = marked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    offsets = sizes.select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_all"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(chunks.ts)
    numbered = marked.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, "_chunk"])
    result = numbered.withColumn(out, F.col("_ahead") + F.col("_rn") - 1)
    if total is not None:
        result = result.withColumn(total, F.col("_all"))
    return result.drop("_chunk", "_rn", "_ahead", "_all")
