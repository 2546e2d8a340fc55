"""Which source column plays which part, found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import clean

PRICE, LOAD, FLOW = "price", "load", "net_flow"
FUELS = ("solar", "wind", "gas", "hydro")

# Accepted names of weather columns.
WEATHER_NAMES = {
    "temperature": (
        "temperature_2m_c", "temperature_2m", "temperature", "temperature_c", "temp_c", "temperature_celsius",
    ),
    "wind_speed": (
        "wind_speed_100m_km_h", "wind_speed_100m", "wind_speed_10m_ms", "wind_speed", "wind_speed_ms",
    ),
    "cloud_cover": ("cloud_cover", "cloudcover", "cloud_fraction", "total_cloud_cover"),
    "solar_irradiance": (
        "solar_radiation", "solar_radiance", "shortwave_radiation", "solar_irradiance", "solar_irradiance_wm2",
    ),
    "precipitation": ("precipitation", "precip"),
}

# Area codes of the supported zones.
DOMAIN_CODES = {
    "GR": "10YGR-HTSO-----Y",
    "DE_LU": "10Y1001A1001A63L",
    "FR": "10YFR-RTE------C",
    "IT": "10YIT-GRTN-----B",
    "ES": "10YES-REE------0",
    "UK": "10YGB----------A",
}


def resolve_roles(columns: list[str], zone: str | None = None) -> dict[str, str]:
    """{role: source column}. Price, load, fuels and flow take the first match, weather the last.

    ``zone`` is the part of generation names between ``gen_`` and the fuel; without it
    the plain ``gen_<fuel>`` names are meant.
    """
    low = {c: c.lower() for c in columns}
    prefix = f"gen_{zone.lower()}_" if zone else "gen_"

    def first(test) -> str | None:
        return next((c for c in columns if test(low[c])), None)

    # A generation column counts for the first fuel its name contains that is still open.
    fuels: dict[str, str] = {}
    for c in columns:
        if low[c].startswith(prefix):
            rest = low[c].replace(prefix, "")
            fuel = next((f for f in FUELS if f in rest and f not in fuels), None)
            if fuel:
                fuels[fuel] = c
    weather = {role: c for c in columns for role, names in WEATHER_NAMES.items() if low[c] in names}
    found = {
        PRICE: first(lambda n: "price" in n),
        LOAD: first(lambda n: n.startswith("load") and "forecast" not in n),
        **{f"gen_{f}": fuels.get(f) for f in FUELS},
        **{w: weather.get(w) for w in WEATHER_NAMES},
        FLOW: first(lambda n: "flow" in n and "import" not in n),
    }
    return {role: c for role, c in found.items() if c is not None}


def role_projection(df: DataFrame, zone: str | None = None, keys=("zone", "ts")) -> DataFrame:
    """The keys and one double column per role found; NaN becomes null."""
    roles = resolve_roles([c for c in df.columns if c not in keys], zone)
    return df.select(*keys, *[clean(F.col(src).cast("double")).alias(role) for role, src in roles.items()])


def require_price(columns: list[str]) -> None:
    if PRICE not in resolve_roles(list(columns)):
        raise ValueError("the table has no price column")


def rename_roles(df: DataFrame, names: dict[str, str] | None = None, prefix: str = "", on=()) -> DataFrame:
    """Rename by map, then prefix the columns listed in ``on``."""
    renamed = df.withColumnsRenamed(names or {})
    return renamed.withColumnsRenamed({c: prefix + c for c in on})


def drop_leaked(df: DataFrame) -> DataFrame:
    """Drop index and clock columns that leaked in from files."""
    return df.drop(*[c for c in df.columns if "UTC" in c or c.startswith("Unnamed")])


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def select_numeric(df: DataFrame, target: str, keys=()) -> DataFrame:
    """The keys and every numeric column except the target."""
    return df.select(*keys, *numeric_columns(df, (target, *keys)))
