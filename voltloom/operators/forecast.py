"""Day-ahead forecasts: step by step for all series and origins at once, or direct in one pass."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numeric import percent_change, ratio
from ..session import checkpoint
from .boosting import score
from .features import WEATHER_WINDOWS, FeatureSpec, build_features, grid_columns, solar_capacity_factor
from .grid import future_index
from .lookups import holiday_lookup
from .reshape import guard_message
from .roles import FLOW, LOAD, PRICE, WEATHER_NAMES
from .windows import spread

CARRIED = ("gen_solar", "gen_wind", FLOW, "residual_load_pct")


def history_guard(df: DataFrame, lags: tuple[int, ...], keys=("zone",)) -> DataFrame:
    """(keys, rows, needed, enough): whether a series is as long as its longest lag."""
    need = max(lags)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"needed": F.lit(need), "enough": F.col("rows") >= need}
    )


def require_history(df: DataFrame, lags: tuple[int, ...], keys=("zone",)) -> None:
    """Fail if any series is too short. Only the shortest length comes to the driver."""
    shortest = history_guard(df, lags, keys).agg(F.min("rows")).first()[0] or 0
    if shortest < max(lags):
        raise ValueError(guard_message(shortest, max(lags), "history"))


def strict_spec(spec: FeatureSpec = FeatureSpec()) -> FeatureSpec:
    """Features for the next hour that use no price of that hour, and no rank over later rows."""
    return replace(spec, price_shift=1, rank="none")


def direct_spec(horizon: int = 24, spec: FeatureSpec = FeatureSpec()) -> FeatureSpec:
    """Features that are all known ``horizon`` hours ahead."""
    return replace(spec, price_shift=horizon, exog_shift=horizon, rank="none")


# ── recursion ───────────────────────────────────────────────────────────────


def _last(array: Column, n: int) -> Column:
    """The last n elements, or all if there are fewer."""
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), F.lit(n))


def _back(array: Column, k: int) -> Column:
    """The k-th element from the end (1 = last); null if there is none."""
    return F.when(F.size(array) >= k, F.element_at(array, -k))


def _mean(array: Column) -> Column:
    known = F.array_compact(array)
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known).cast("double"))


def _std(array: Column, mean: Column) -> Column:
    known = F.array_compact(array)
    squares = F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    n = F.size(known)
    return F.when(n > 1, F.sqrt(F.try_divide(squares, (n - 1).cast("double"))))


def _state_lengths(spec: FeatureSpec, columns: list[str]) -> dict[str, int]:
    """How many of the latest values of each column the next feature row can depend on."""
    lengths = {PRICE: max(max(spec.lags) + 1, 169, *spec.windows)}
    lengths |= {v: max(WEATHER_WINDOWS) for v in WEATHER_NAMES if v in columns}
    if LOAD in columns:
        lengths[LOAD] = max(24, spec.load_ratio_window)
    return lengths


def origin_state(df: DataFrame, origins: DataFrame, spec: FeatureSpec) -> DataFrame:
    """One row per (series, origin): the latest values up to the origin, as arrays of fixed length.

    Rows are packed once per time chunk, and each origin cuts its stretch out of its chunk; chunks
    have a fixed size, so no array grows with the series.
    """
    chunks = spec.chunks
    keys, ts = list(chunks.keys), chunks.ts
    lengths = _state_lengths(spec, df.columns)
    carried = [c for c in CARRIED if c in df.columns]
    longest = max(lengths.values())
    span = origins.agg(F.min("origin"), F.max("origin")).first()
    if span[0] is not None:
        # Only hours that some origin can see are packed; the literals reach the file scan.
        first = F.lit(span[0]).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(longest * chunks.step_seconds)))
        df = df.where((F.col(ts) > first) & (F.col(ts) <= F.lit(span[1]).cast("timestamp")))
    rows = spread(df.select(*keys, ts, *lengths, *carried), longest, chunks)
    packed = rows.groupBy(*keys, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct(ts, *lengths, *carried))).alias("_h")
    )
    at = origins.select(*keys, F.col("origin")).withColumn(
        "_chunk", F.floor(F.floor(F.unix_seconds("origin") / chunks.step_seconds) / chunks.size)
    )
    first = F.unix_seconds(F.element_at("_h", 1)[ts])
    place = F.floor((F.unix_seconds("origin") - first) / chunks.step_seconds).cast("int") + 1
    joined = at.join(packed, [*keys, "_chunk"]).withColumn("_place", place)
    joined = joined.where((F.col("_place") >= 1) & (F.col("_place") <= F.size("_h")))
    cut = joined.withColumn(
        "_h", F.slice("_h", F.greatest(F.col("_place") - longest + 1, F.lit(1)), F.least(F.col("_place"), F.lit(longest)))
    )
    return cut.select(
        *keys,
        "origin",
        F.size("_h").alias("_known"),
        *[_last(F.col(f"_h.{c}"), n).alias(f"_{c}") for c, n in lengths.items()],
        *[F.element_at(F.col(f"_h.{c}"), -1).alias(f"_{c}") for c in carried],
    )


def _price_features(spec: FeatureSpec, same_hour: bool) -> dict[str, Column]:
    """Price features of one row from the newest prices. ``same_hour``: the newest is the row's own."""
    price = F.col(f"_{PRICE}")
    own = 1 if same_hour else 0
    now = _back(price, 1)
    out = {f"price_lag_{k}h": _back(price, k + own) for k in spec.lags}
    if 168 in spec.lags:
        out["price_weekly_delta"] = now - _back(price, 169)
    if 24 in spec.lags:
        out["price_pct_change_24h"] = percent_change(now, _back(price, 25))
    for n in spec.windows:
        mean = _mean(_last(price, n))
        out[f"price_roll_mean_{n}h"] = mean
        out[f"price_roll_zscore_{n}h"] = ratio(now - mean, _std(_last(price, n), mean))
    if 168 in spec.windows:
        out["price_vs_7d_mean"] = now - _mean(_last(price, 168))
    return out


def _carried_features(spec: FeatureSpec, columns: list[str]) -> dict[str, Column]:
    """Weather, load and grid features of one row from the newest values of each input."""
    out: dict[str, Column] = {}
    for var in WEATHER_NAMES:
        if var in columns:
            values = F.col(f"_{var}")
            raw, (short, long) = _back(values, 1), (_mean(_last(values, n)) for n in WEATHER_WINDOWS)
            out |= {f"weather_{var}_raw": raw, f"weather_{var}_roll6h": short,
                    f"weather_{var}_roll24h": long, f"weather_{var}_anomaly": raw - long}
    if "solar_irradiance" in columns:
        out["solar_estimated_cf"] = solar_capacity_factor(_back(F.col("_solar_irradiance"), 1))
    if LOAD in columns:
        load = F.col(f"_{LOAD}")
        out["load_roll24h"] = _mean(_last(load, 24))
        out["load_pct_of_7d"] = ratio(_back(load, 1), _mean(_last(load, spec.load_ratio_window)))
        if {"gen_solar", "gen_wind"} <= set(columns):
            out |= grid_columns(_back(load, 1), F.col("_gen_solar"), F.col("_gen_wind"))
    if "residual_load_pct" in columns:
        out["residual_load_pct"] = F.col("_residual_load_pct")
    if FLOW in columns:
        out["net_import"] = F.col(f"_{FLOW}")
    return out


def _calendar(spec: FeatureSpec, ts: Column) -> dict[str, Column]:
    local = clock.local_clock(ts, spec.tz)
    out = {**clock.basic(local), "part_of_day": clock.part_of_day(local)}
    if spec.dst:
        out |= clock.dst_flags(local, spec.years, spec.every_row_is_autumn)
    if spec.cyclical:
        out |= clock.cyclical(local)
    return out


def forecast_recursive(
    df: DataFrame,
    origins: DataFrame,
    model: PipelineModel,
    features: list[str],
    spec: FeatureSpec,
    horizon: int = 24,
    same_hour: bool = False,
    steps_per_stage: int = 6,
) -> DataFrame:
    """(keys, origin, horizon, ts, y_pred) for every row of ``origins`` (keys, origin).

    Each (series, origin) is one row holding its recent prices and, for every step, the features
    that do not depend on the forecast; other inputs are carried forward from the origin. A step
    computes the price features, scores the row and appends the prediction to the row's own prices,
    so no step shuffles. The small state is checkpointed every ``steps_per_stage`` steps to keep
    plans short. With ``same_hour`` a step scores the newest known hour and labels it an hour later.
    """
    keys = list(spec.chunks.keys)
    state = origin_state(df, origins, spec).where(F.col("_known") >= max(spec.lags))
    length = _state_lengths(spec, df.columns)[PRICE]
    from_price = {f: c for f, c in _price_features(spec, same_hour).items() if f in features}
    others = [f for f in features if f not in from_price]
    state = _known_steps(state, others, df.columns, spec, horizon, same_hour)

    inputs = {**from_price, **{f: F.element_at("_steps", F.col("_step"))[f] for f in others}}
    predicted = F.when(~F.isnan("y_pred"), F.col("y_pred"))
    following = [
        *keys, "origin", "_steps", (F.col("_step") + 1).alias("_step"),
        _last(F.concat(f"_{PRICE}", F.array(predicted)), length).alias(f"_{PRICE}"),
        F.concat("_out", F.array(predicted)).alias("_out"),
    ]
    state = state.withColumns({"_out": F.array().cast("array<double>"), "_step": F.lit(1)})
    for h in range(1, horizon + 1):
        state = score(model, state.withColumns(inputs)).select(*following)
        if h % steps_per_stage == 0 and h < horizon:
            state = checkpoint(state)
    rows = state.select(*keys, "origin", F.posexplode("_out").alias("_i", "y_pred"))
    return rows.select(
        *keys, "origin", (F.col("_i") + 1).alias("horizon"),
        (F.col("origin") + F.make_dt_interval(hours=F.col("_i") + 1)).alias(spec.chunks.ts), "y_pred",
    )


def _known_steps(
    state: DataFrame, wanted: list[str], columns: list[str], spec: FeatureSpec, horizon: int, same_hour: bool
) -> DataFrame:
    """(keys, origin, _price, _steps): the wanted features of all steps, as one array of ``horizon`` structs."""
    keys = list(spec.chunks.keys)
    ahead = F.col("_step") - 1 if same_hour else F.col("_step")
    lengths = {c: n for c, n in _state_lengths(spec, columns).items() if c != PRICE}
    rows = state.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    rows = rows.withColumns({
        "_ts": F.col("origin") + F.make_dt_interval(hours=ahead),
        f"_{PRICE}": F.when(F.col("_step") == 1, F.col(f"_{PRICE}")),
        **{f"_{c}": _last(F.concat(f"_{c}", F.array_repeat(_back(F.col(f"_{c}"), 1), ahead)), n) for c, n in lengths.items()},
    })
    rows = holiday_lookup(rows, "_ts", spec.tz, spec.years)
    made = {**_carried_features(spec, columns), **_calendar(spec, F.col("_ts"))}
    rows = rows.withColumns({f: made[f] for f in wanted if f in made})
    return rows.groupBy(*keys, "origin").agg(
        F.first(f"_{PRICE}", ignorenulls=True).alias(f"_{PRICE}"),
        F.sort_array(F.collect_list(F.struct("_step", *wanted))).alias("_steps"),
    )


def latest_origins(df: DataFrame, keys=("zone",), ts="ts") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(ts).alias("origin"))


def block_origins(df: DataFrame, first_row: int, horizon: int = 24, keys=("zone",), ts="ts") -> DataFrame:
    """Origins of the non-overlapping test blocks of a complete hourly grid.

    Blocks start at rows first_row, first_row + horizon, … while below n - horizon.
    """
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_first"), F.count(F.lit(1)).alias("_n"))
    last = F.col("_n") - horizon - 1
    starts = ends.where(last >= first_row).withColumn("_start", F.explode(F.sequence(F.lit(first_row).cast("bigint"), last, F.lit(horizon).cast("bigint"))))
    return starts.select(*keys, (F.col("_first") + F.make_dt_interval(hours=(F.col("_start") - 1).cast("int"))).alias("origin"))


def with_actuals(forecast: DataFrame, df: DataFrame, price: str = PRICE, keys=("zone",), ts="ts") -> DataFrame:
    return forecast.join(df.select(*keys, ts, F.col(price).alias("y_true")), [*keys, ts], "left")


def evaluate_recursive(
    df: DataFrame, model: PipelineModel, features: list[str], spec: FeatureSpec, horizon: int = 24, same_hour: bool = False
) -> DataFrame:
    """Forecast every block of the table in one run and attach what happened."""
    keys, ts = spec.chunks.keys, spec.chunks.ts
    origins = block_origins(df, max(spec.lags), horizon, keys, ts)
    return with_actuals(forecast_recursive(df, origins, model, features, spec, horizon, same_hour), df, PRICE, keys, ts)


# ── direct ──────────────────────────────────────────────────────────────────


def extend(df: DataFrame, horizon: int, keys=("zone",), ts="ts") -> DataFrame:
    """Append the next ``horizon`` empty hours of each series."""
    ends = df.groupBy(*keys).agg(F.max(ts).alias(ts))
    ahead = future_index(ends, horizon, ts).select(*keys, ts)
    return df.unionByName(ahead, allowMissingColumns=True)


def forecast_direct(
    df: DataFrame, model: PipelineModel, spec: FeatureSpec, horizon: int = 24
) -> DataFrame:
    """(keys, origin, horizon, ts, y_pred): the next hours from features that are at least that old.

    One pass and no recursion: every input of the target hours is already known.
    """
    keys, ts = list(spec.chunks.keys), spec.chunks.ts
    if min(spec.price_shift, spec.exog_shift) < horizon:
        raise ValueError("direct forecasts need features shifted by at least the horizon")
    ends = latest_origins(df, keys, ts)
    rows = build_features(extend(df, horizon, keys, ts), spec)
    # Only the target hours are scored.
    targets = future_index(ends.withColumnRenamed("origin", ts), horizon, ts)
    scored = score(model, targets.join(rows, [*keys, ts]))
    return scored.select(*keys, "origin", "horizon", ts, F.when(~F.isnan("y_pred"), F.col("y_pred")).alias("y_pred"))
