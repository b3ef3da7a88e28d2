"""Column lists and explicit schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: column names and their order -----------------------------

WEATHER = [
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "precipitation",
    "weather_code",
    "pressure_msl",
    "cloud_cover_low",
    "cloud_cover_high",
    "visibility",
    "wind_speed_10m",
    "wind_speed_180m",
    "wind_direction_10m",
    "wind_direction_180m",
    "cape",
    "geopotential_height_850hPa",
]

FLIGHT = {
    "icao24": T.StringType(),
    "firstSeen": T.TimestampType(),
    "estDepartureAirport": T.StringType(),
    "lastSeen": T.TimestampType(),
    "estArrivalAirport": T.StringType(),
    "callsign": T.StringType(),
    "estDepartureAirportHorizDistance": T.DoubleType(),
    "estDepartureAirportVertDistance": T.DoubleType(),
    "estArrivalAirportHorizDistance": T.DoubleType(),
    "estArrivalAirportVertDistance": T.DoubleType(),
    "departureAirportCandidatesCount": T.IntegerType(),
    "arrivalAirportCandidatesCount": T.IntegerType(),
    "destination_airport": T.StringType(),
    "route": T.StringType(),
}

DEP_WEATHER = [f"dep_{name}" for name in WEATHER]
ARR_WEATHER = [f"arr_{name}" for name in WEATHER]

REQUIRED_FLIGHT = list(FLIGHT)

FEATURES = [
    *FLIGHT,
    "firstSeen_hourly_utc",
    "lastSeen_hourly_utc",
    "dep_merge_key",
    "arr_merge_key",
    *DEP_WEATHER,
    *ARR_WEATHER,
    "flight_duration",
    "airline",
    "hour_of_day",
    "month",
    "flight_date_parsed",
]

NOT_NULL = [
    "icao24",
    "firstSeen",
    "estDepartureAirport",
    "lastSeen",
    "estArrivalAirport",
    "callsign",
    "destination_airport",
    "route",
    "dep_merge_key",
    "arr_merge_key",
    "airline",
    "flight_date_parsed",
]

TRAINING_REQUIRED = [
    "icao24",
    "firstSeen",
    "lastSeen",
    "route",
    "airline",
    "flight_duration",
    "hour_of_day",
    "month",
    "flight_date_parsed",
    *DEP_WEATHER,
    *ARR_WEATHER,
]

MODEL_NUMERIC = [*DEP_WEATHER, *ARR_WEATHER, "hour_of_day", "month"]
MODEL_POOLED = [*MODEL_NUMERIC, "airline"]

LEAKAGE = ["flight_duration", "route", "flight_date_parsed", "median_flight_time"]

# identity of a flight in the merge step, and in the quality gates
MERGE_KEY = ["icao24", "firstSeen", "lastSeen"]
FLIGHT_KEY = [*MERGE_KEY, "estDepartureAirport", "estArrivalAirport"]
WEATHER_KEY = ["airport", "time"]

# --- schemas -----------------------------------------------------------------

FLIGHT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in FLIGHT.items()])

WEATHER_SCHEMA = T.StructType(
    [T.StructField("airport", T.StringType()), T.StructField("time", T.TimestampType())]
    + [T.StructField(n, T.DoubleType()) for n in WEATHER]
)

_DERIVED = {
    **{n: T.TimestampType() for n in FEATURES if n.endswith("_hourly_utc") or n.endswith("_merge_key")},
    **{n: T.DoubleType() for n in (*DEP_WEATHER, *ARR_WEATHER, "flight_duration")},
    "airline": T.StringType(),
    "hour_of_day": T.IntegerType(),
    "month": T.IntegerType(),
    "flight_date_parsed": T.DateType(),
}
FEATURE_SCHEMA = T.StructType([T.StructField(n, {**FLIGHT, **_DERIVED}[n]) for n in FEATURES])

CONTROL_SCHEMA = T.StructType([
    T.StructField("route", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("updated_utc", T.TimestampType()),
    T.StructField("error", T.StringType()),
])

STAGE_STATS_SCHEMA = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("timestamp_utc", T.TimestampType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("n_cols", T.IntegerType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("null_rates_pct", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("sample_rows", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("extra", T.StringType()),
])


class SchemaError(ValueError):
    """A frame lacks columns, or has them in the wrong order."""


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    """Fail with every missing column named, not only the first."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"{name} is missing required columns: {missing}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add absent columns as typed null, drop extra ones, fix the order."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def add_missing(df: DataFrame, columns: Iterable[str], dtype: str = "double") -> DataFrame:
    """Add absent columns as null and keep everything else."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast(dtype) for c in columns if c not in have})


def check_model_columns(columns: list[str], pooled: bool) -> None:
    """The model matrix must have exactly the expected columns, in order."""
    expected = MODEL_POOLED if pooled else MODEL_NUMERIC
    if list(columns) != expected:
        raise SchemaError(
            "model columns differ: missing "
            f"{[c for c in expected if c not in columns]}, unexpected "
            f"{[c for c in columns if c not in expected]}, order matters"
        )


def check_candidates(df: DataFrame) -> None:
    """Every numeric model column must be present before selection."""
    require_columns(df, MODEL_NUMERIC, "model candidates")


def model_features(df: DataFrame) -> list[str]:
    """Numeric model columns in frame order; constant ones stay in."""
    check_candidates(df)
    wanted = set(MODEL_NUMERIC)
    return [c for c in df.columns if c in wanted]


def drop_leakage(df: DataFrame) -> DataFrame:
    """Remove the columns a model must never see, where present."""
    return df.drop(*LEAKAGE)
