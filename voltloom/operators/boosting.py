"""Boosted trees on the pooled feature table, the number of rounds, and permutation importance."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from .lookups import salted_lookup
from .reshape import count_guard, guard_message
from .windows import DEFAULT, Chunks, positions


@dataclass(frozen=True)
class BoostConfig:
    # Default training settings.
    max_depth: int = 6
    min_child_weight: int = 10
    subsample: float = 0.8
    colsample: float = 0.8
    learning_rate: float = 0.05
    n_estimators: int = 2000
    min_train_size: int = 24 * 180
    val_size: int = 168
    step: int = 168
    eval_fraction: float = 0.1
    patience: int = 50
    min_val_rows: int = 24
    spare_rounds: int = 5
    seed: int = 42


def assembler(features: list[str]) -> VectorAssembler:
    """A missing input stays NaN; ``score`` gives no prediction for such a row."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def gbt(config: BoostConfig, label: str = "price", rounds: int | None = None) -> GBTRegressor:
    return GBTRegressor(
        labelCol=label,
        featuresCol="features",
        predictionCol="y_pred",
        maxIter=rounds or config.n_estimators,
        maxDepth=config.max_depth,
        minInstancesPerNode=config.min_child_weight,
        stepSize=config.learning_rate,
        subsamplingRate=config.subsample,
        featureSubsetStrategy=str(config.colsample),
        seed=config.seed,
        checkpointInterval=10,
        cacheNodeIds=True,
    )


def fit_model(train: DataFrame, features: list[str], estimator: Estimator, label: str = "price") -> PipelineModel:
    """Fit any regressor on the complete rows of all series together.

    Training passes over its input several times, so the assembled rows are kept while it runs.
    """
    vectors = assembler(features)
    rows = vectors.transform(train.select(*features, label).na.drop("any")).select("features", label).persist()
    try:
        return PipelineModel([vectors, estimator.fit(rows)])
    finally:
        rows.unpersist()


def trainable_rows(
    df: DataFrame, features: list[str], at_least: int, label: str = "price", keys=("zone",), spread_by=("ts",)
) -> DataFrame:
    """Complete rows of the series that have ``at_least`` of them; fails if no series does.

    ``reshape.count_guard`` on the complete rows lists the series left out.
    """
    complete = df.na.drop("any", subset=[*features, label])
    sizes = count_guard(complete, at_least, keys)
    most = sizes.agg(F.max("rows")).first()[0] or 0
    if most < at_least:
        raise ValueError(guard_message(most, at_least, "training"))
    kept = salted_lookup(complete, sizes.select(*keys, "enough"), list(keys), spread_by)
    return kept.where("enough").drop("enough")


def fit_gbt(
    train: DataFrame, features: list[str], config: BoostConfig = BoostConfig(), label: str = "price",
    rounds: int | None = None,
) -> PipelineModel:
    return fit_model(train, features, gbt(config, label, rounds), label)


def best_round(losses: list[float], patience: int) -> int:
    """0-based index of the smallest loss before ``patience`` rounds bring no better one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def tune_rounds(
    df: DataFrame, features: list[str], config: BoostConfig = BoostConfig(), label: str = "price",
    chunks: Chunks = DEFAULT, workers: int = 4,
) -> tuple[DataFrame, int]:
    """Weekly expanding folds: the best round of each, and the number of rounds for the final fit.

    Folds are cut by row number within a series, so every series takes part in every fold. They are
    separate Spark jobs, started side by side.
    """
    spark = df.sparkSession
    complete = df.select(*chunks.keys, chunks.ts, *features, label).na.drop("any")
    rows = positions(complete, chunks, "_pos", "_total")
    held = F.greatest(F.floor(F.col("_total") * config.eval_fraction), F.lit(config.val_size))
    rows = assembler(features).transform(rows.withColumn("_limit", F.col("_total") - held))
    rows = rows.select("_pos", "_limit", "features", label).persist()
    limit = rows.agg(F.max("_limit")).first()[0]
    starts = list(range(config.min_train_size, limit or 0, config.step))

    def fold(number: int) -> tuple | None:
        start = starts[number]
        train = rows.where((F.col("_pos") < start) & (F.col("_pos") < F.col("_limit")))
        val = rows.where(F.col("_pos").between(start, start + config.val_size - 1) & (F.col("_pos") < F.col("_limit")))
        val_rows = val.count()
        if val_rows < config.min_val_rows:
            return None
        model = gbt(config, label).fit(train)
        losses = model.evaluateEachIteration(val, "squared")
        best = best_round(losses, config.patience)
        return number, start, val_rows, best, float(losses[best])

    with ThreadPoolExecutor(workers) as pool:
        found = [f for f in pool.map(fold, range(len(starts))) if f is not None]
    rows.unpersist()
    if not found:
        raise ValueError("no training folds: more rows are needed")
    rounds = int(sum(f[3] for f in found) / len(found)) + config.spare_rounds
    schema = "fold int, train_end int, val_rows int, best_round int, loss double"
    return spark.createDataFrame(found, schema), rounds


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Independent prediction of every row, as ``y_pred``; null where an input is missing, as training saw no such row.

    Missing inputs are looked for in the assembled vector, so an input given by a long expression is computed once.
    """
    scored = model.transform(df)
    missing = F.exists(vector_to_array("features"), F.isnan)
    return scored.withColumn("y_pred", F.when(~missing, F.col("y_pred"))).drop("features")


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: list[str], label: str = "price", keys=("zone",),
    spread_by=("ts",), seed: int = 42, block_rows: int = 4096,
) -> DataFrame:
    """(keys, feature, importance): how much the squared error grows when one feature is shuffled.

    Rows of a series fall into random blocks; inside a block, in random order, each row takes the
    feature of the next one, and the last of the first. That is one shuffle for all features. The
    variants of a row then differ in a single column and are scored as they are made.
    """
    keys = list(keys)
    rows = df.select(*keys, *[c for c in spread_by if c not in keys], *features, label).na.drop("any")
    # Blocks per series: a block holds about block_rows rows of its series, whatever the number of series.
    sizes = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / block_rows)).alias("_blocks"))
    draw = F.xxhash64(*keys, *spread_by, F.lit(seed))
    placed = rows.join(sizes, keys).withColumns({"_block": F.pmod(draw, F.col("_blocks")), "_order": F.xxhash64(draw, F.lit(seed))})
    w = Window.partitionBy(*keys, "_block").orderBy("_order", *spread_by)
    packed = F.struct(*features)
    moved = placed.withColumn(
        "_other", F.coalesce(F.lead(packed).over(w), F.first(packed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    )
    variants = moved.withColumn("_which", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    mixed = variants.select(
        *keys, label, "_which",
        *[F.when(F.col("_which") == i + 1, F.col(f"_other.{f}")).otherwise(F.col(f)).alias(f) for i, f in enumerate(features)],
    )
    losses = score(model, mixed).groupBy(*keys, "_which").agg(
        F.avg(F.pow(F.col(label) - F.col("y_pred"), F.lit(2.0))).alias("_loss")
    )
    base = F.max(F.when(F.col("_which") == 0, F.col("_loss"))).over(Window.partitionBy(*keys))
    names = F.array(*[F.lit(f) for f in features])
    return (
        losses.withColumn("importance", F.col("_loss") - base)
        .where(F.col("_which") > 0)
        .select(*keys, F.element_at(names, F.col("_which")).alias("feature"), "importance")
    )


def evaluate(model: PipelineModel, df: DataFrame, label: str = "price", keys=("zone",)) -> DataFrame:
    """Single-step errors per series over rows whose inputs and label are complete."""
    needed = [*model.stages[0].getInputCols(), label]
    scored = score(model, df.na.drop("any", subset=needed)).withColumn("y_true", F.col(label))
    return scored.groupBy(*keys).agg(*metrics.all_metrics(), F.count(F.lit(1)).alias("rows"))


ModelFactory = Callable[[], Estimator]
