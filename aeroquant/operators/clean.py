"""Filters, tags and de-duplication of flight and weather rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroquant.functions import text, times
from aeroquant.schemas import MERGE_KEY, WEATHER_KEY, add_missing

# minutes (fixed values): sane trips lie in (5, 300], training drops above 240
MIN_MINUTES = 5
MAX_MINUTES = 300
OUTLIER_MINUTES = 240

# a known logging fault: trips above 300 minutes in this period (fixed values)
FAULT_FROM, FAULT_TO, FAULT_MINUTES = "2025-04-01", "2025-07-01", 300


def on_routes(flights: DataFrame, routes: DataFrame) -> DataFrame:
    """Keep flights of the listed routes and tag them; all routes in one pass.

    ``routes`` has ``origin`` and ``destination``. Spark's size check decides
    whether it is broadcast.
    """
    listed = routes.select(
        F.col("origin").alias("estDepartureAirport"), F.col("destination").alias("estArrivalAirport")
    ).distinct()
    return tag_route(flights.join(listed, ["estDepartureAirport", "estArrivalAirport"], "left_semi"))


def tag_route(flights: DataFrame) -> DataFrame:
    origin, destination = F.col("estDepartureAirport"), F.col("estArrivalAirport")
    return flights.withColumns(
        {"destination_airport": destination, "route": text.route_name(origin, destination)}
    )


def ensure_route(flights: DataFrame) -> DataFrame:
    """Derive ``route`` as ORIGIN_DESTINATION where the frame has none."""
    if "route" in flights.columns:
        return flights
    return flights.withColumn("route", text.route_key(F.col("estDepartureAirport"), F.col("estArrivalAirport")))


def sanity_filter(flights: DataFrame) -> DataFrame:
    """Drop rows lacking times or origin, and trips outside (5, 300] minutes."""
    minutes = times.duration_minutes(F.col("firstSeen"), F.col("lastSeen"))
    return flights.dropna(subset=["firstSeen", "lastSeen", "estDepartureAirport"]).where(
        (minutes > MIN_MINUTES) & (minutes <= MAX_MINUTES)
    )


def drop_outliers(flights: DataFrame, column: str = "flight_duration", limit: float = OUTLIER_MINUTES) -> DataFrame:
    """Drop rows above the limit. A missing length stays, for a gate to reject."""
    value = F.col(column)
    above = value.isNotNull() & ~F.isnan(value) & (value > limit)
    return flights.where(~above)


def drop_outliers_between(
    flights: DataFrame, start: str = FAULT_FROM, end: str = FAULT_TO, limit: float = FAULT_MINUTES,
    time: str = "firstSeen", column: str = "flight_duration",
) -> DataFrame:
    """Drop rows above the limit inside a period; both ends belong to it."""
    t, value = F.col(time), F.col(column)
    bad = t.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & (value > limit)
    return flights.where(~F.coalesce(bad, F.lit(False)))


def prefix_columns(df: DataFrame, columns: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in columns]


def constant_columns(df: DataFrame, columns: Sequence[str], exempt: Sequence[str] = ("hour_of_day", "month")) -> DataFrame:
    """One row per column: does it hold at most one distinct value?

    Nulls do not count. The least and greatest value settle it in a single
    pass, without counting distinct values.
    """
    same = [
        (F.coalesce(F.min(c) == F.max(c), F.lit(True)) & F.lit(c not in exempt)).alias(c) for c in columns
    ]
    return df.agg(*same).unpivot([], list(columns), "column", "is_constant")


def drop_constant_columns(df: DataFrame, columns: Sequence[str], exempt: Sequence[str] = ("hour_of_day", "month")) -> DataFrame:
    found = constant_columns(df, columns, exempt).where("is_constant").collect()  # one row per column
    return df.drop(*[r["column"] for r in found])


def at_airports(weather: DataFrame, routes: DataFrame) -> DataFrame:
    """Weather of the airports that a route starts or ends at."""
    ends = routes.select(F.explode(F.array("origin", "destination")).alias("airport")).distinct()
    return weather.join(ends, "airport", "left_semi")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Concatenate by column name; absent columns become null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the least by ``order``.

    A group of copies may be huge: the least row is taken on the map side, so at
    most one row per key and task is shuffled. Null keys form a group of their own.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    if not rest:
        return df.dropDuplicates(list(keys))
    best = F.min_by(F.struct(*rest), rank)
    picked = df.groupBy(*keys).agg(best.alias("r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def merge_keep_first(
    stored: DataFrame, new: DataFrame, keys: Sequence[str], tiebreak: Sequence[str]
) -> DataFrame:
    """Stored and new rows together, one per key; a stored row wins.

    Keys absent from the frames are ignored. With none left, whole rows are
    compared.
    """
    both = union_by_name(stored.withColumn("_src", F.lit(0)), new.withColumn("_src", F.lit(1)))
    present = [k for k in keys if k in both.columns]
    if not present:
        return both.drop("_src").dropDuplicates()
    return keep_first(both, present, ["_src", *tiebreak]).drop("_src")


def append_new(stored: DataFrame, new: DataFrame, keys: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """Rows of ``new`` to add to a table that already has one row per key.

    Only the new rows are regrouped; the stored table is probed, not rewritten.
    Null keys match each other, as in the full merge.
    """
    have = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return keep_first(new, keys, tiebreak).join(have, same, "left_anti")


def merge_flights(stored: DataFrame, new: DataFrame, tiebreak: Sequence[str] = ("callsign",)) -> DataFrame:
    return merge_keep_first(stored, new, MERGE_KEY, tiebreak)


def merge_weather(stored: DataFrame, new: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    columns = tiebreak or [c for c in new.columns if c not in WEATHER_KEY]
    return merge_keep_first(stored, new, WEATHER_KEY, columns)


def with_weather_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return add_missing(df, columns)
