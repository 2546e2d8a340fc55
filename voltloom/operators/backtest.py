"""Walk-forward backtests over expanding training windows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..session import work_path
from . import linear
from .boosting import BoostConfig, ModelFactory, fit_model, gbt, score
from .features import FeatureSpec, build_features
from .forecast import forecast_recursive, strict_spec, with_actuals
from .lookups import salted_lookup


@dataclass(frozen=True)
class BacktestConfig:
    # Default walk-forward settings, in hours.
    train_min: int = 24 * 180
    step: int = 168
    horizon: int = 24
    n_estimators: int = 50
    max_depth: int = 6
    seed: int = 42


def fold_table(df: DataFrame, config: BacktestConfig, keys=("zone",), ts="ts") -> DataFrame:
    """(keys, iteration, train_rows, train_end, test_start, test_end) on a complete hourly grid.

    Fold i trains on the first train_min + i * step rows; folds stop when the test block would reach
    the end of the series.
    """
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_first"), F.count(F.lit(1)).alias("_n"))
    room = F.col("_n") - 1 - config.horizon - config.train_min
    folds = ends.where(room >= 0).withColumn(
        "iteration", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(room / config.step)))
    )
    rows = F.col("iteration") * config.step + config.train_min

    def at(row):
        return F.col("_first") + F.make_dt_interval(hours=row.cast("int"))

    return folds.select(
        *keys,
        "iteration",
        rows.alias("train_rows"),
        at(rows - 1).alias("train_end"),
        at(rows).alias("test_start"),
        at(rows + config.horizon - 1).alias("test_end"),
    )


def row_numbers(df: DataFrame, keys=("zone",), ts="ts", out="_row", step_seconds: int = 3600) -> DataFrame:
    """0-based row number on a complete grid, by arithmetic on the time instead of a sort."""
    firsts = df.groupBy(*keys).agg(F.min(ts).alias("_first"), F.count(F.lit(1)).alias("_n"))
    joined = salted_lookup(df, firsts, list(keys), (ts,))
    number = F.floor((F.unix_seconds(ts) - F.unix_seconds("_first")) / step_seconds)
    return joined.withColumn(out, number).drop("_first")


def test_rows(df: DataFrame, config: BacktestConfig, keys=("zone",), ts="ts") -> DataFrame:
    """Each row once per fold whose test block holds it, with ``iteration`` and ``horizon``.

    The range condition is solved for the fold number, so it is an expansion of the row and not a join.
    """
    rows = row_numbers(df, keys, ts)
    past = F.col("_row") - config.train_min
    low = F.greatest(F.ceil((past - config.horizon + 1) / config.step), F.lit(0))
    high = F.least(F.floor(past / config.step), F.floor((F.col("_n") - 1 - config.horizon - config.train_min) / config.step))
    inside = rows.withColumns({"_low": low, "_high": high}).where((past >= 0) & (F.col("_low") <= F.col("_high")))
    folds = inside.withColumn("iteration", F.explode(F.sequence("_low", "_high")))
    horizon = F.col("_row") - (F.col("iteration") * config.step + config.train_min) + 1
    return folds.withColumn("horizon", horizon).drop("_low", "_high", "_row", "_n")


def fold_step(df: DataFrame, config: BacktestConfig, keys=("zone",), ts="ts", out="step") -> DataFrame:
    """Number each row by the first fold that trains on it."""
    rows = row_numbers(df, keys, ts)
    number = F.greatest(F.floor((F.col("_row") - config.train_min) / config.step) + 1, F.lit(0))
    return rows.withColumn(out, number).drop("_row", "_n")


def fold_statistics(df: DataFrame, value: str, config: BacktestConfig, keys=("zone",), ts="ts") -> DataFrame:
    """(keys, iteration, train_count, train_mean, test_count, test_mean) for every fold.

    Training sides come from running sums over the fold steps, so a row is read once and not once
    for every fold it belongs to.
    """
    keys = list(keys)
    sums = fold_step(df, config, keys, ts).groupBy(*keys, "step").agg(
        F.sum(value).alias("_s"), F.count(value).alias("_c"), F.count(F.lit(1)).alias("_r"))
    along = Window.partitionBy(*keys).orderBy("step")
    running = sums.select(*keys, F.col("step").alias("iteration"), F.sum("_s").over(along).alias("_s"), F.sum("_c").over(along).alias("train_count"))
    train = running.select(*keys, "iteration", "train_count", F.try_divide("_s", "train_count").alias("train_mean"))
    test = test_rows(df, config, keys, ts).groupBy(*keys, "iteration").agg(
        F.count(value).alias("test_count"), F.avg(value).alias("test_mean"))
    return train.join(test, [*keys, "iteration"])


def expanding_ols(
    df: DataFrame, features: list[str], config: BacktestConfig, label="price", keys=("zone",), ts="ts"
) -> DataFrame:
    """(keys, iteration, ts, horizon, y_true, y_pred): a linear model for every fold, all in one job.

    A step without complete rows adds nothing to train on, so its fold uses the newest fit before it. A fold with
    no complete row at all comes back with null predictions.
    """
    keys = list(keys)
    fits = linear.expanding_fits(fold_step(df, config, keys, ts), features, label, "step", keys)
    fits = fits.select(*keys, F.col("step").cast("bigint").alias("iteration"), "coef")
    folds = fold_table(df, config, keys, ts).select(*keys, "iteration", F.lit(None).cast("array<double>").alias("coef"))
    along = Window.partitionBy(*keys).orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    each = folds.unionByName(fits).groupBy(*keys, "iteration").agg(F.first("coef", ignorenulls=True).alias("coef"))
    latest = each.withColumn("coef", F.last("coef", ignorenulls=True).over(along))
    test = test_rows(df, config, keys, ts)
    scored = test.join(latest, [*keys, "iteration"])
    return scored.select(
        *keys, "iteration", ts, "horizon", F.col(label).alias("y_true"), linear.linear_value(features).alias("y_pred")
    )


def backtest(
    df: DataFrame,
    features: list[str],
    config: BacktestConfig = BacktestConfig(),
    factory: ModelFactory | None = None,
    spec: FeatureSpec | None = None,
    workers: int = 3,
) -> dict[str, DataFrame]:
    """Fit, single-step errors and recursive forecast for every fold.

    Returns ``iterations`` (one row per series and fold, with the fold's ``run_status``; a failed fold has one row of
    nulls), ``predictions`` (one per series, fold and hour) and ``status`` (one per fold). The feature table is written once and read by every fold;
    folds are separate Spark jobs, started side by side, and append to one table. A fold that fails
    is reported in ``status`` with its error and leaves no predictions.
    """
    spark = df.sparkSession
    spec = spec or strict_spec()
    keys, ts = list(spec.chunks.keys), spec.chunks.ts
    boost = BoostConfig(max_depth=config.max_depth, n_estimators=config.n_estimators, seed=config.seed)
    make = factory or (lambda: gbt(boost))
    base = work_path(spark, "backtest")
    row_numbers(build_features(df, spec), keys, ts).write.parquet(f"{base}/features")
    table = spark.read.parquet(f"{base}/features")
    longest = table.agg(F.max("_n")).first()[0] or 0
    folds = range(0, max((longest - 1 - config.horizon - config.train_min) // config.step + 1, 0))

    def run(i: int) -> tuple[int, str, str | None]:
        try:
            start = config.train_min + i * config.step
            fits_in = F.col("_n") - 1 - config.horizon >= start
            model = fit_model(table.where(fits_in & (F.col("_row") < start)), features, make())
            test = table.where(fits_in & F.col("_row").between(start, start + config.horizon - 1))
            single = score(model, test).where(F.col("price").isNotNull()).withColumns(
                {"y_true": F.col("price"), "y_pred": F.when(~F.isnan("y_pred"), F.col("y_pred"))})
            origins = table.where(fits_in & (F.col("_row") == start - 1)).select(*keys, F.col(ts).alias("origin"))
            ahead = forecast_recursive(df, origins, model, features, spec, config.horizon)
            single.groupBy(*keys).agg(
                *metrics.all_metrics(), F.count(F.lit(1)).alias("test_rows"), F.min(ts).alias("first_test")
            ).join(origins, keys).write.parquet(f"{base}/iterations/iteration={i}")
            ahead.write.parquet(f"{base}/forecasts/iteration={i}")
            return i, "ok", None
        except Exception as err:  # noqa: BLE001 - one fold must not end the others
            return i, "failed", f"{type(err).__name__}: {str(err)[:500]}"

    with ThreadPoolExecutor(workers) as pool:
        outcome = list(pool.map(run, folds))
    status = spark.createDataFrame(outcome, "iteration int, status string, error string")
    good = [i for i, state, _ in outcome if state == "ok"]
    if not good:
        raise ValueError(f"no fold succeeded: {outcome[:3]}")
    option = spark.read.option("basePath", f"{base}/iterations")
    iterations = option.parquet(*[f"{base}/iterations/iteration={i}" for i in good])
    iterations = iterations.withColumnRenamed("origin", "train_end").withColumns(
        {
            "test_start": F.col("train_end") + F.expr("INTERVAL 1 HOUR"),
            "train_rows": F.col("iteration") * config.step + config.train_min,
        }
    ).drop("first_test")
    iterations = status.select("iteration", F.col("status").alias("run_status")).join(iterations, "iteration", "left")
    forecasts = spark.read.option("basePath", f"{base}/forecasts").parquet(*[f"{base}/forecasts/iteration={i}" for i in good])
    predictions = with_actuals(forecasts, df, "price", keys, ts).withColumnRenamed("origin", "train_end")
    return {"iterations": iterations, "predictions": predictions, "status": status}
