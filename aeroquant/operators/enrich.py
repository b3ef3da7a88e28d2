"""Joins of flights with weather, and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeroquant.functions import times
from aeroquant.operators.clean import keep_first
from aeroquant.schemas import WEATHER
from aeroquant.session import settle


def weather_lookup(weather: DataFrame, columns: Sequence[str] = WEATHER) -> DataFrame:
    """Weather keyed by airport and nearest hour, with the wanted columns."""
    return weather.select("airport", times.round_hour(F.col("time")).alias("hour"), *columns)


def join_weather(
    flights: DataFrame, lookup: DataFrame, airport: str, hour: str, prefix: str,
    columns: Sequence[str] = WEATHER,
) -> DataFrame:
    """Left equi-join on airport and hour; every flight stays.

    No broadcast hint: the lookup grows with airports and hours, so Spark's size
    check decides. The pair of keys spreads a busy airport over its hours, and
    adaptive execution splits an hour that is still too large.
    """
    side = lookup.select(
        F.col("airport").alias(airport), F.col("hour").alias(hour),
        *[F.col(c).alias(prefix + c) for c in columns],
    )
    return flights.join(side, [airport, hour], "left")


def join_both_ends(flights: DataFrame, weather: DataFrame, columns: Sequence[str] = WEATHER) -> DataFrame:
    """Weather at departure and at arrival, by rounded hour."""
    lookup = weather_lookup(weather, columns)
    at_departure = join_weather(flights, lookup, "estDepartureAirport", "dep_merge_key", "dep_", columns)
    return join_weather(at_departure, lookup, "estArrivalAirport", "arr_merge_key", "arr_", columns)


def join_by_text_hour(
    flights: DataFrame, weather: DataFrame, columns: Sequence[str], tiebreak: Sequence[str]
) -> DataFrame:
    """The same two joins on text hours; repeated weather keys keep the first."""
    keyed = weather.withColumn("hour", times.hour_key(F.col("time")))
    lookup = keep_first(keyed.select("airport", "hour", "time", *columns), ["airport", "hour"], ["time", *tiebreak])
    f = flights.withColumns({
        "dep_merge_key": times.hour_key(times.round_hour(F.col("firstSeen"))),
        "arr_merge_key": times.hour_key(times.round_hour(F.col("lastSeen"))),
    })
    at_departure = join_weather(f, lookup, "estDepartureAirport", "dep_merge_key", "dep_", columns)
    return join_weather(at_departure, lookup, "estArrivalAirport", "arr_merge_key", "arr_", columns)


def nearest_in_time(
    probes: DataFrame, series: DataFrame, by: Sequence[str], probe_time: str, series_time: str,
    columns: Sequence[str], prefix: str = "near_", bucket_seconds: int = 3600,
) -> DataFrame:
    """Closest row of an hourly series for each probe, at any distance.

    Ties take the earlier row. For every bucket of time that holds probes a short
    list of candidates is prepared: the series rows of that bucket, the last one
    before it and the first one after it. No row further away can be closer. A
    probe then needs one equi-join, whose busy buckets adaptive execution may
    split, since probes are never gathered. The list is short because the series
    has one row per key and hour; for a denser series pass a smaller bucket.
    A probe whose key has no series gets nulls.
    """
    by = list(by)
    bucket = lambda t: F.floor(F.unix_micros(F.col(t)) / (bucket_seconds * 1_000_000))
    point = F.struct(F.unix_micros(F.col(series_time)).alias("us"), F.col(series_time), *columns)
    s = series.where(F.col(series_time).isNotNull()).select(*by, bucket(series_time).alias("b"), point.alias("p"))
    held = s.groupBy(*by, "b").agg(F.array_sort(F.collect_set("p")).alias("own"))
    wanted = probes.select(*by, bucket(probe_time).alias("b")).distinct()
    buckets = held.join(wanted.withColumn("wanted", F.lit(True)), [*by, "b"], "full")
    before = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # following rows are read by running the other way, so both frames stream
    back = Window.partitionBy(*by).orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    candidates = settle(
        buckets
        .withColumn("prev", F.last(F.element_at("own", -1), ignorenulls=True).over(before))
        .withColumn("next", F.last(F.element_at("own", 1), ignorenulls=True).over(back))
        .where("wanted")
        .select(*by, "b", F.array_compact(
            F.concat(F.array("prev"), F.coalesce("own", F.array().cast(held.schema["own"].dataType)), F.array("next"))
        ).alias("near"))
    )
    at = F.unix_micros(F.col(probe_time))
    ranked = F.transform("near", lambda p: F.struct(F.abs(p["us"] - at).alias("gap"), p["us"].alias("us"), p.alias("p")))
    best = F.array_min(ranked)["p"]
    return (
        probes.withColumn("b", bucket(probe_time))
        .join(candidates, [*by, "b"], "left")
        .withColumn("_best", best)
        .select(*probes.columns, *[F.col("_best")[c].alias(prefix + c) for c in (series_time, *columns)])
    )


def encode(df: DataFrame, mapping: DataFrame, fallback: DataFrame, keys: Sequence[str], column: str,
           value: str, name: str) -> DataFrame:
    """Replace a category by its fitted value; unseen or null takes the fallback.

    ``mapping`` has keys, the category column and ``value``; ``fallback`` has keys
    and ``value``. Both were fitted on training rows.
    """
    m = mapping.select(*keys, column, F.col(value).alias("_mapped"))
    f = fallback.select(*keys, F.col(value).alias("_fallback"))
    joined = df.join(m, [*keys, column], "left")
    if keys:
        joined = joined.join(f, list(keys), "left")
    else:
        joined = joined.withColumn("_fallback", f.scalar())
    return joined.withColumn(name, F.coalesce("_mapped", "_fallback")).drop("_mapped", "_fallback")


def with_anomaly(df: DataFrame, medians: DataFrame, keys: Sequence[str], median: str = "route_median",
                 duration: str = "flight_duration") -> DataFrame:
    """Distance of each trip from its fitted median."""
    joined = df.join(medians.select(*keys, median), list(keys), "left")
    return joined.withColumn("anomaly", F.col(duration) - F.col(median))


def airport_info(airports: DataFrame, origins: DataFrame, destinations: DataFrame, strict: bool = True) -> DataFrame:
    """Facts per airport code; an entry among origins wins over destinations.

    With ``strict`` an unknown airport fails the job, else its facts are null.
    """
    facts = [c for c in origins.columns if c != "airport"]
    o = origins.select("airport", F.struct(*facts).alias("o"))
    d = destinations.select("airport", F.struct(*facts).alias("d"))
    found = airports.join(o, "airport", "left").join(d, "airport", "left")
    info = F.coalesce("o", "d")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown airport "), F.col("airport")))
        info = F.when(info.isNotNull(), info).otherwise(unknown)
    return found.withColumn("_info", info).drop("o", "d").select(
        *airports.columns, *[F.col(f"_info.{c}").alias(c) for c in facts]
    )


def select_tier(requests: DataFrame, trained: DataFrame, pooled: str = "all_carriers") -> DataFrame:
    """The carrier's own tier where trained, otherwise the pooled one.

    ``trained`` has route and tier of every trained model; a route without a
    pooled model leaves the tier null.
    """
    own = trained.where(F.col("tier") != pooled).select("route", F.col("tier").alias("airline"), F.col("tier").alias("_own"))
    any_pooled = trained.where(F.col("tier") == pooled).select("route", F.col("tier").alias("_pooled"))
    return (
        requests.join(own.distinct(), ["route", "airline"], "left")
        .join(any_pooled.distinct(), "route", "left")
        .withColumn("tier", F.coalesce("_own", "_pooled"))
        .withColumn("is_fallback", F.col("_own").isNull())
        .drop("_own", "_pooled")
    )
