"""Forecast-error aggregates. Every function returns an aggregate column usable in any ``groupBy``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import MAPE_FLOOR


def _pair(y: str, p: str) -> tuple[Column, Column]:
    return F.col(y), F.col(p)


def mae(y: str = "y_true", p: str = "y_pred") -> Column:
    a, b = _pair(y, p)
    return F.avg(F.abs(a - b))


def rmse(y: str = "y_true", p: str = "y_pred") -> Column:
    a, b = _pair(y, p)
    return F.sqrt(F.avg((a - b) * (a - b)))


def mape(y: str = "y_true", p: str = "y_pred", floor: float = MAPE_FLOOR) -> Column:
    a, b = _pair(y, p)
    return F.avg(F.when(F.abs(a) > floor, F.abs(F.try_divide(a - b, a)))) * 100.0


def smape(y: str = "y_true", p: str = "y_pred") -> Column:
    a, b = _pair(y, p)
    half = (F.abs(a) + F.abs(b)) / 2.0
    return F.avg(F.when(half > MAPE_FLOOR, F.try_divide(F.abs(a - b), half))) * 100.0


def pinball(y: str, p: str, quantile: float) -> Column:
    """Loss of ``p`` as a forecast of a quantile: errors below and above cost by its two sides."""
    a, b = _pair(y, p)
    return F.avg(F.greatest(F.lit(quantile) * (a - b), F.lit(quantile - 1.0) * (a - b)))


def all_metrics(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    return [
        mae(y, p).alias("mae"),
        rmse(y, p).alias("rmse"),
        mape(y, p).alias("mape"),
        smape(y, p).alias("smape"),
    ]


def baseline_metrics(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    """MAE, RMSE and MAPE; MAPE is +inf where every actual is zero."""
    return [
        mae(y, p).alias("mae"),
        rmse(y, p).alias("rmse"),
        F.coalesce(mape(y, p, 0.0), F.lit(float("inf"))).alias("mape"),
    ]


def sample_skewness(c: Column) -> Column:
    """Bias-adjusted skewness (Spark's own is the population form)."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column) -> Column:
    """Bias-adjusted excess kurtosis."""
    n = F.count(c).cast("double")
    inner = (n + 1) * F.kurtosis(c) + 6.0
    return F.when(n > 3, F.try_divide((n - 1) * inner, (n - 2) * (n - 3)))
