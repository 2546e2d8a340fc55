"""The feature table: calendar, lag, rolling, weather, grid, clock-change and cyclical columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numeric import clean, clip, percent_change, ratio, ratio_to_infinity
from .lookups import holiday_lookup
from .ranking import percent_rank
from .roles import FLOW, LOAD, PRICE, WEATHER_NAMES, resolve_roles
from .windows import DEFAULT, Chunks, over_chunks, roll_mean, roll_std

# Default lags and windows in hours, and clip bounds.
LAGS = (24, 48, 168, 336)
WINDOWS = (24, 168)
WEATHER_WINDOWS = (6, 24)
SHARE_BOUNDS = (0.0, 2.0)
SOLAR_RATIO_BOUNDS = (-2.0, 5.0)
FULL_SUN = 1000.0


@dataclass(frozen=True)
class FeatureSpec:
    """What to build.

    ``price_shift`` and ``exog_shift`` say how many hours old the newest price, and the newest load,
    generation, flow and weather, may be. Zero reproduces features that contain the current price;
    a forecast for h hours ahead needs ``price_shift >= h``.
    """

    lags: tuple[int, ...] = LAGS
    windows: tuple[int, ...] = WINDOWS
    years: tuple[int, ...] | None = tuple(clock.GREEK_HOLIDAYS)
    cyclical: bool = True
    dst: bool = True
    tz: str | None = None
    price_shift: int = 0
    exog_shift: int = 0
    load_ratio_window: int = 24
    rank: str = "whole"  # "whole", "train" or "none"
    train_before: str | None = None
    every_row_is_autumn: bool = False
    chunks: Chunks = field(default=DEFAULT)

    def halo(self) -> int:
        return max(
            max(self.lags, default=0),
            max(self.windows, default=0) + self.price_shift,
            168 + self.price_shift,
            max(24, self.load_ratio_window) + self.exog_shift,
        )


def _at(c: str, shift: int, w: WindowSpec) -> Column:
    return F.lag(c, shift).over(w) if shift else F.col(c)


def price_windows(spec: FeatureSpec, w: WindowSpec, price: str = PRICE) -> dict[str, Column]:
    """Lags, change columns and rolling statistics of the price."""
    s = spec.price_shift
    now = _at(price, s, w)
    out = {f"price_lag_{k}h": F.lag(price, k).over(w) for k in spec.lags if k >= s}
    if 168 in spec.lags:
        out["price_weekly_delta"] = now - F.lag(price, 168 + s).over(w)
    if 24 in spec.lags:
        out["price_pct_change_24h"] = percent_change(now, F.lag(price, 24 + s).over(w))
    for n in spec.windows:
        mean = roll_mean(price, n, w, s)
        out[f"price_roll_mean_{n}h"] = mean
        out[f"price_roll_zscore_{n}h"] = ratio(now - mean, roll_std(price, n, w, s))
    if 168 in spec.windows:
        out["price_vs_7d_mean"] = now - roll_mean(price, 168, w, s)
    return out


def weather_windows(var: str, w: WindowSpec, shift: int = 0) -> dict[str, Column]:
    """Raw value, 6- and 24-row means, and the distance from the 24-row mean."""
    raw = _at(var, shift, w)
    short, long = (roll_mean(var, n, w, shift) for n in WEATHER_WINDOWS)
    return {
        f"weather_{var}_raw": raw,
        f"weather_{var}_roll6h": short,
        f"weather_{var}_roll24h": long,
        f"weather_{var}_anomaly": raw - long,
    }


def solar_capacity_factor(irradiance: Column) -> Column:
    return clip(irradiance / FULL_SUN, 0.0, 1.0)


def load_windows(w: WindowSpec, shift: int = 0, ratio_window: int = 24, load: str = LOAD) -> dict[str, Column]:
    return {
        "load_roll24h": roll_mean(load, 24, w, shift),
        "load_pct_of_7d": ratio(_at(load, shift, w), roll_mean(load, ratio_window, w, shift)),
    }


def grid_columns(load: Column, solar: Column, wind: Column) -> dict[str, Column]:
    """Residual load, renewable share and solar over residual."""
    residual = load - solar - wind
    return {
        "residual_load": residual,
        "renewable_share": clip(ratio_to_infinity(solar + wind, load), *SHARE_BOUNDS),
        "solar_to_residual": clip(ratio(solar, residual), *SOLAR_RATIO_BOUNDS),
    }


def build_features(df: DataFrame, spec: FeatureSpec, data_years=None) -> DataFrame:
    """Add every feature the canonical columns of ``df`` allow; absent inputs are skipped.

    The rank joins first, while rows are narrow. Then all windows share one chunked shuffle and one
    sort, and the scalar groups fuse into it. The rank reads the table more than once: hand over a
    stored table and not a long plan.
    """
    present = set(df.columns)
    weather = [v for v in WEATHER_NAMES if v in present]
    has_grid = {LOAD, "gen_solar", "gen_wind"} <= present
    ranked = has_grid and spec.rank != "none"
    s = spec.exog_shift

    def windows(w: WindowSpec) -> dict[str, Column]:
        out: dict[str, Column] = {}
        if PRICE in present:
            out |= price_windows(spec, w)
        for var in weather:
            out |= weather_windows(var, w, s)
        if "solar_irradiance" in present:
            out["solar_estimated_cf"] = solar_capacity_factor(_at("solar_irradiance", s, w))
        if has_grid:
            out |= grid_columns(*[_at(c, s, w) for c in (LOAD, "gen_solar", "gen_wind")])
            if s and ranked:
                out["residual_load_pct"] = F.lag("residual_load_pct", s).over(w)
        if FLOW in present:
            out["net_import"] = _at(FLOW, s, w)
        if LOAD in present:
            out |= load_windows(w, s, spec.load_ratio_window)
        return out

    if ranked:
        counted = None
        if spec.rank == "train":
            if spec.train_before is None:
                raise ValueError("rank='train' needs train_before")
            counted = F.col(spec.chunks.ts) < F.lit(spec.train_before).cast("timestamp")
        residual = grid_columns(F.col(LOAD), F.col("gen_solar"), F.col("gen_wind"))["residual_load"]
        df = percent_rank(
            df.withColumn("_residual", residual), list(spec.chunks.keys), "_residual", "residual_load_pct",
            spec.chunks.ts, counted=counted,
        ).drop("_residual")
    return calendar_features(over_chunks(df, spec.halo(), windows, spec.chunks), spec, data_years)


def calendar_features(df: DataFrame, spec: FeatureSpec, data_years=None) -> DataFrame:
    ts = spec.chunks.ts
    local = clock.local_clock(F.col(ts), spec.tz)
    columns = {**clock.basic(local), "part_of_day": clock.part_of_day(local)}
    if spec.dst:
        years = spec.years
        if years is not None and data_years is not None:
            years = [y for y in years if y in set(data_years)]
        autumn = spec.every_row_is_autumn and (years is None or bool(years))
        columns |= clock.dst_flags(local, years, autumn)
    if spec.cyclical:
        columns |= clock.cyclical(local)
    return holiday_lookup(df, ts, spec.tz, spec.years).withColumns(columns)


def feature_names(df: DataFrame, before: DataFrame) -> list[str]:
    """The columns a build added."""
    return [c for c in df.columns if c not in before.columns]


# ── ML stages ───────────────────────────────────────────────────────────────


class _SpecParams(Params):
    lags = Param(Params._dummy(), "lags", "price lags in hours", TypeConverters.toListInt)
    windows = Param(Params._dummy(), "windows", "price windows in hours", TypeConverters.toListInt)
    years = Param(Params._dummy(), "years", "holiday and clock-change years; empty for all", TypeConverters.toListInt)
    cyclical = Param(Params._dummy(), "cyclical", "add sin/cos columns", TypeConverters.toBoolean)
    dst = Param(Params._dummy(), "dst", "add clock-change flags", TypeConverters.toBoolean)
    tz = Param(Params._dummy(), "tz", "zone clock; empty for UTC", TypeConverters.toString)
    priceShift = Param(Params._dummy(), "priceShift", "age of the newest price", TypeConverters.toInt)
    exogShift = Param(Params._dummy(), "exogShift", "age of the newest other input", TypeConverters.toInt)
    loadRatioWindow = Param(Params._dummy(), "loadRatioWindow", "window under load_pct_of_7d", TypeConverters.toInt)
    rank = Param(Params._dummy(), "rank", "whole, train or none", TypeConverters.toString)
    trainBefore = Param(Params._dummy(), "trainBefore", "end of the ranked period", TypeConverters.toString)
    everyRowIsAutumn = Param(Params._dummy(), "everyRowIsAutumn", "autumn flag on all rows", TypeConverters.toBoolean)
    zoneName = Param(Params._dummy(), "zoneName", "zone in generation column names", TypeConverters.toString)
    chunkSize = Param(Params._dummy(), "chunkSize", "hours per window chunk", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(
            lags=list(LAGS),
            windows=list(WINDOWS),
            years=list(clock.GREEK_HOLIDAYS),
            cyclical=True,
            dst=True,
            tz="",
            priceShift=0,
            exogShift=0,
            loadRatioWindow=24,
            rank="whole",
            trainBefore="",
            everyRowIsAutumn=False,
            zoneName="",
            chunkSize=DEFAULT.size,
        )

    def spec(self) -> FeatureSpec:
        get = self.getOrDefault
        return FeatureSpec(
            lags=tuple(get("lags")),
            windows=tuple(get("windows")),
            years=tuple(get("years")) or None,
            cyclical=get("cyclical"),
            dst=get("dst"),
            tz=get("tz") or None,
            price_shift=get("priceShift"),
            exog_shift=get("exogShift"),
            load_ratio_window=get("loadRatioWindow"),
            rank=get("rank"),
            train_before=get("trainBefore") or None,
            every_row_is_autumn=get("everyRowIsAutumn"),
            chunks=Chunks(size=get("chunkSize")),
        )


class FeatureBuilder(Estimator, _SpecParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns which columns play which role and which years the data covers."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._defaults()
        self._set(**params)

    def transform(self, dataset, params=None):
        raise ValueError("FeatureBuilder has not been fitted; call fit first")

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        keys = ("zone", "ts")
        roles = resolve_roles([c for c in dataset.columns if c not in keys], self.getOrDefault("zoneName") or None)
        local = clock.local_clock(F.col("ts"), self.getOrDefault("tz") or None)
        first, last = dataset.agg(F.min(F.year(local)), F.max(F.year(local))).first()
        seen = [] if first is None else list(range(first, last + 1))
        model = FeatureModel(roles=json.dumps(roles), dataYears=seen)
        return self._copyValues(model)


class FeatureModel(Model, _SpecParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the feature columns; never relearns roles or years."""

    roles = Param(Params._dummy(), "roles", "source column per role, as JSON", TypeConverters.toString)
    dataYears = Param(Params._dummy(), "dataYears", "years seen while fitting", TypeConverters.toListInt)

    def __init__(self, **params) -> None:
        super().__init__()
        self._defaults()
        self._set(**params)

    def role_map(self) -> dict[str, str]:
        return json.loads(self.getOrDefault("roles"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        canonical = dataset.select(
            "zone", "ts", *[clean(F.col(src).cast("double")).alias(role) for role, src in self.role_map().items()]
        )
        return build_features(canonical, self.spec(), self.getOrDefault("dataYears"))


def engineer_features(df: DataFrame, **params) -> DataFrame:
    """Fit and transform in one call."""
    return FeatureBuilder(**params).fit(df).transform(df)
