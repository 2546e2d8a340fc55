"""Measures of a forecast beyond its mean error: intervals, pinball loss, ramps, unusual errors, spreads between zones."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import pinball
from .ranking import exact_quantiles
from .windows import DEFAULT, Chunks, over_chunks, roll_std, spread

LEVELS = (80, 95)


def _edges(level: int) -> tuple[float, float]:
    tail = (100 - level) / 200.0
    return tail, 1.0 - tail


def residual_quantiles(log: DataFrame, levels: tuple[int, ...] = LEVELS, by: tuple[str, ...] = ("zone", "horizon")) -> DataFrame:
    """Exact quantiles of y_true - y_pred per group: ``shift_low_<level>`` and ``shift_high_<level>``, a row per group."""
    errors = log.select(*by, (F.col("y_true") - F.col("y_pred")).alias("error")).where("error is not null")
    wanted = {}
    for level in levels:
        low, high = _edges(level)
        wanted |= {f"shift_low_{level}": low, f"shift_high_{level}": high}
    return exact_quantiles(errors, list(by), "error", wanted)


def intervals(
    log: DataFrame, levels: tuple[int, ...] = LEVELS, by: tuple[str, ...] = ("zone", "horizon"), hours: int = 2160, least: int = 8, chunks: Chunks = DEFAULT
) -> DataFrame:
    """Add ``low_<level>`` and ``high_<level>``: the prediction plus exact quantiles of its group's errors of the ``hours`` before.

    A row's own error and later ones play no part, so coverage is not met by construction. Null where there is no prediction, or
    fewer than ``least`` such errors are known. One shuffle; a group is a chunk of hours and those before it.
    """
    sides = [(f"{side}_{level}", edge) for level in levels for side, edge in zip(("low", "high"), _edges(level), strict=True)]
    rows = log.withColumn("_error", F.col("y_true") - F.col("y_pred"))
    parts = replace(chunks, keys=tuple(by))
    before = Window.partitionBy(*by, "_chunk").orderBy(F.unix_seconds(F.col(chunks.ts))).rangeBetween(-hours * 3600, -1)
    marks = F.percentile("_error", F.array(*[F.lit(edge) for _, edge in sides]))
    known = F.when(F.count("_error").over(before) >= least, marks.over(before))
    rows = spread(rows, hours, parts).withColumn("_marks", known).where("_own")
    return rows.select(*log.columns, *[(F.col("y_pred") + F.col("_marks")[i]).alias(name) for i, (name, _) in enumerate(sides)])


def interval_scores(rows: DataFrame, level: int, by: tuple[str, ...] = ("zone",)) -> DataFrame:
    """Per group: the share of actual values inside the interval, its mean width, and the pinball loss of both bounds."""
    low, high = f"low_{level}", f"high_{level}"
    below, above = _edges(level)
    known = rows.where(F.col("y_true").isNotNull() & F.col(low).isNotNull())
    return known.groupBy(*by).agg(
        F.avg(F.col("y_true").between(F.col(low), F.col(high)).cast("double")).alias("coverage"),
        F.avg(F.col(high) - F.col(low)).alias("width"),
        pinball("y_true", low, below).alias("pinball_low"),
        pinball("y_true", high, above).alias("pinball_high"),
    )


def deviation_flags(log: DataFrame, hours: int = 720, factor: float = 3.0, chunks: Chunks = DEFAULT) -> DataFrame:
    """Add ``sigma``, the deviation of the errors of the ``hours`` before, and whether this error is over ``factor`` of them.

    Null where the error or sigma is not known.
    """
    errors = log.withColumn("error", F.col("y_true") - F.col("y_pred"))
    rows = over_chunks(errors, hours, lambda w: {"sigma": roll_std("error", hours, w, 1)}, chunks)
    return rows.withColumn("deviates", F.abs("error") > F.lit(float(factor)) * F.col("sigma"))


def ramp_scores(log: DataFrame, threshold: float = 50.0, by: tuple[str, ...] = ("zone",), chunks: Chunks = DEFAULT) -> DataFrame:
    """Per group: moves over ``threshold`` from one hour to the next, foreseen and real, with precision and recall.

    Only hours whose real and foreseen moves are both known count; precision or recall without a case is null.
    """
    moves = over_chunks(
        log,
        1,
        lambda w: {
            "real": F.abs(F.col("y_true") - F.lag("y_true", 1).over(w)) > threshold,
            "seen": F.abs(F.col("y_pred") - F.lag("y_pred", 1).over(w)) > threshold,
        },
        chunks,
    ).where("real is not null and seen is not null")
    counted = moves.groupBy(*by).agg(
        F.count_if("real").alias("ramps"),
        F.count_if("seen").alias("foreseen"),
        F.count_if(F.col("real") & F.col("seen")).alias("hits"),
    )
    return counted.withColumns({
        "precision": F.try_divide(F.col("hits").cast("double"), F.col("foreseen")),
        "recall": F.try_divide(F.col("hits").cast("double"), F.col("ramps")),
    })


def zone_spread(market: DataFrame, column: str = "price", ts: str = "ts", out: str = "spread") -> DataFrame:
    """Add the value less the mean of the other zones in the same hour; null where either is missing.

    A group is one hour, with as many rows as there are zones.
    """
    hour = Window.partitionBy(ts)
    others = F.count(column).over(hour) - 1
    mean = F.try_divide(F.sum(column).over(hour) - F.col(column), others)
    return market.withColumn(out, F.col(column) - mean)
