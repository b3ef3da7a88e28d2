"""Registry of driver queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def r96(c: str) -> Column:
    """Six digits of a mean; rounding to nine first, as the SQL does too, removes
    the noise of summation order at ties."""
    return F.round(F.round(F.col(c), 9), 6).alias(c)


def us(c: str, name: str | None = None) -> Column:
    return F.unix_micros(F.col(c)).alias(name or c)


def day(c: str, name: str | None = None) -> Column:
    return F.col(c).cast("string").alias(name or c)


# --- the stand-in views, in the checker's dialect -----------------------------

FLIGHTS = """
flights_v as (
  select cast(user_id as varchar) icao24, ts firstSeen,
    make_timestamp(epoch_us(ts) + cast(round(value*60000000) as bigint)) lastSeen,
    event_type dep,
    (['click','error','purchase','signup','view'])[cast(event_id % 5 as int) + 1] arr,
    concat(upper(event_type[1:3]), cast(event_id as varchar)) callsign, event_id, value
  from events),
trips as (
  select *, concat(dep, '->', arr) route,
    regexp_extract(upper(trim(callsign)), '^([A-Z]{2,4})', 1) airline,
    (epoch_us(lastSeen) - epoch_us(firstSeen)) / 60000000.0 flight_duration,
    make_timestamp(cast(round_even(epoch_us(firstSeen)/3.6e9, 0) as bigint) * 3600000000) dep_hour,
    make_timestamp(cast(round_even(epoch_us(lastSeen)/3.6e9, 0) as bigint) * 3600000000) arr_hour
  from flights_v),
sane as (select * from trips where flight_duration > 5 and flight_duration <= 300)
"""

WEATHER_V = """
weather_v as (
  select event_type airport, date_trunc('hour', ts) "time",
    avg(value) v_avg, min(value) v_min, max(value) v_max, count(*) v_n
  from events group by 1, 2)
"""

HISTORY = """
history_v as (
  select cast(l_suppkey as varchar) icao24, o_orderdate firstSeen, l_shipdate lastSeen,
    cast(date_diff('day', o_orderdate, l_shipdate) as double) flight_duration,
    o_orderpriority airline, 'ALL' route,
    l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount
  from lineitem join orders on l_orderkey = o_orderkey
  where l_shipdate > o_orderdate)
"""

HISTORY_ORDER_SQL = "firstSeen, icao24, lastSeen, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
