"""Weather payloads: one JSON document holding parallel hourly arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Payload variable to column name.
WEATHER_VARIABLES = {
    "temperature_2m": "temperature_2m_c",
    "temperature_80m": "temperature_80m_c",
    "wind_speed_10m": "wind_speed_10m_ms",
    "wind_speed_80m": "wind_speed_80m_ms",
    "cloud_cover": "cloud_cover",
    "shortwave_radiation_instant": "solar_irradiance_wm2",
    "direct_radiation_instant": "direct_radiation_wm2",
}

PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    *[T.StructField(v, T.ArrayType(T.DoubleType())) for v in WEATHER_VARIABLES],
                ]
            ),
        )
    ]
)


def parse_weather(df: DataFrame, payload: str, keys=("zone",), tz: str | None = "Europe/Athens") -> DataFrame:
    """Hourly rows (keys, ts, variables) of the payload column; local times become instants."""
    parsed = df.select(*keys, F.from_json(payload, PAYLOAD_SCHEMA).alias("p"))
    zipped = F.arrays_zip("p.hourly.time", *[f"p.hourly.{v}" for v in WEATHER_VARIABLES])
    rows = parsed.select(*keys, F.explode(zipped).alias("r"))
    local = F.to_timestamp("r.time", "yyyy-MM-dd'T'HH:mm")
    return rows.select(
        *keys,
        (local if tz is None else F.to_utc_timestamp(local, tz)).alias("ts"),
        *[F.col(f"r.{v}").alias(name) for v, name in WEATHER_VARIABLES.items()],
    )
