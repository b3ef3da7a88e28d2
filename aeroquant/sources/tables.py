"""The given parquet tables, and the flight-shaped views over them.

Schemas are explicit, so no scan infers one, and times are read straight as UTC
instants so that time filters reach the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroquant.functions import numbers, text, times
from aeroquant.schemas import WEATHER
from aeroquant.session import cut_lineage

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    ),
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
}

# airports of the stand-in flights (fixed values)
AIRPORTS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str, where: Column | None = None) -> DataFrame:
    """A given table; NaN is null. ``where`` is a comparison that the reader is handed too."""
    return numbers.clean_where(spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet"), where)


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights over ``events``: value is the trip length in minutes."""
    airports = F.array(*[F.lit(a) for a in AIRPORTS])
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("icao24"),
        F.col("ts").alias("firstSeen"),
        times.plus_minutes(F.col("ts"), F.col("value")).alias("lastSeen"),
        F.col("event_type").alias("estDepartureAirport"),
        F.element_at(airports, (F.col("event_id") % 5).cast("int") + 1).alias("estArrivalAirport"),
        F.concat(F.upper(F.substring("event_type", 1, 3)), F.col("event_id").cast("string")).alias("callsign"),
        "event_id",
        F.col("value"),
    )


def raw_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in flights with every landed column, tagged with their route."""
    f = flights(spark, sf_dir)
    return f.select(
        "icao24", "firstSeen", "estDepartureAirport", "lastSeen", "estArrivalAirport", "callsign",
        (F.col("value") * 10).alias("estDepartureAirportHorizDistance"),
        (F.col("value") + 1).alias("estDepartureAirportVertDistance"),
        (F.col("value") * 15).alias("estArrivalAirportHorizDistance"),
        (F.col("value") + 2).alias("estArrivalAirportVertDistance"),
        (F.col("event_id") % 3).cast("int").alias("departureAirportCandidatesCount"),
        (F.col("event_id") % 4).cast("int").alias("arrivalAirportCandidatesCount"),
        F.col("estArrivalAirport").alias("destination_airport"),
        text.route_name(F.col("estDepartureAirport"), F.col("estArrivalAirport")).alias("route"),
        "event_id",
    )


def weather_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series per airport over ``events``."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("airport"), F.date_trunc("hour", "ts").alias("time"))
        .agg(
            F.avg("value").alias("v_avg"),
            F.min("value").alias("v_min"),
            F.max("value").alias("v_max"),
            F.count("*").alias("v_n"),
        )
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series with all weather variables; visibility has gaps."""
    low, high, mean = F.col("v_min"), F.col("v_max"), F.col("v_avg")
    n = F.col("v_n").cast("double")
    values = [
        mean, low, high, high - low, n, mean + 1000, low * 2, high * 2,
        F.when(F.col("v_n") > 1, mean * 100), mean / 10, mean / 5, low + 90, high + 90, n * 7, high * 3,
    ]
    return weather_hours(spark, sf_dir).select(
        "airport", "time", *[v.alias(name) for name, v in zip(WEATHER, values)]
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several years of trips over ``lineitem`` and ``orders``, lengths in days."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .where(F.col("l_shipdate") > F.col("o_orderdate"))
        .select(
            F.col("l_suppkey").cast("string").alias("icao24"),
            F.col("o_orderdate").alias("firstSeen"),
            F.col("l_shipdate").alias("lastSeen"),
            F.datediff("l_shipdate", "o_orderdate").cast("double").alias("flight_duration"),
            F.col("o_orderpriority").alias("airline"),
            F.lit("ALL").alias("route"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount",
        )
    )


def stored_history(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of ``history``, or all, joined once and stored, for what reads them several times."""
    return cut_lineage(history(spark, sf_dir).select(*dict.fromkeys(columns or ["*"])))


HISTORY_ORDER = ["firstSeen", "icao24", "lastSeen", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
FLIGHT_ORDER = ["firstSeen", "icao24", "lastSeen", "callsign", "estDepartureAirport", "estArrivalAirport"]
