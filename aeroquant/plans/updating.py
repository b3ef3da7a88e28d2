"""Driver queries: files, incremental load, control state, streams."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from aeroquant.functions import times
from aeroquant.operators import clean, incremental
from aeroquant.plans import scoring, update
from aeroquant.plans.basics import routes_frame, sane
from aeroquant.plans.registry import FLIGHTS, WEATHER_V, day, query, r6, us
from aeroquant.schemas import add_missing
from aeroquant.session import checkpoint_dir
from aeroquant.sources import landed, sinks, tables
from aeroquant.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FILES = " union all ".join(f"select '{t}.parquet' as name, count(*) as n_rows, {str(t == 'events').lower()} as has_schema from {t}" for t in TABLES)
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


# --- files ----------------------------------------------------------------------

def inventory(spark, sf_dir):
    """The given files as chunks; only one of them has event rows."""
    return landed.chunk_inventory(spark, sf_dir, "*.parquet", ["event_id", "event_type"])


def file_name():
    return F.element_at(F.split("path", "/"), -1).alias("name")


@query("chunk_file_counts", FILES)
def chunk_file_counts(spark, sf_dir):
    return inventory(spark, sf_dir).select(file_name(), "n_rows", "has_schema")


@query("chunk_summary", f"""
with f as ({FILES})
select count(*) as n_matched, count(*) filter (where n_rows = 0) as n_empty, 0::bigint as n_unreadable, count(*) filter (where n_rows > 0) as n_with_data,
  cast(sum(n_rows) as bigint) as n_rows from f""")
def chunk_summary(spark, sf_dir):
    return landed.inspect_chunks(inventory(spark, sf_dir))


@query("valid_chunks", f"""
with f as ({FILES}) select 'arrivals' as kind, name from f union all select 'weather', name from f where n_rows > 0 and has_schema""")
def valid_chunks(spark, sf_dir):
    chunks = inventory(spark, sf_dir)
    kinds = [landed.valid_chunks(chunks, k).select(F.lit(k).alias("kind"), file_name()) for k in ("arrivals", "weather")]
    return kinds[0].unionByName(kinds[1])


@query("file_manifest")
def file_manifest(spark, sf_dir):
    return sinks.file_manifest(spark, sf_dir).select(file_name(), "sha256", "size_bytes")


@query("file_manifest_of_chunks", """
select cast(cast(ts as date) as varchar) as chunk, sha256(string_agg(line, chr(10) order by event_id) || chr(10)) as sha256,
  cast(sum(strlen(line) + 1) as bigint) as size_bytes
from (select ts, event_id, concat(event_id, '|', event_type) as line from events) group by 1""")
def file_manifest_of_chunks(spark, sf_dir):
    """Digests of one text file per day, as Spark wrote them."""
    home = f"{checkpoint_dir(spark)}/aeroquant/texts-{uuid.uuid4().hex}"
    lines = tables.table(spark, sf_dir, "events").select(
        F.to_date("ts").cast("string").alias("d"), "event_id", F.concat_ws("|", "event_id", "event_type").alias("value"))
    lines.repartition("d").sortWithinPartitions("d", "event_id").select("d", "value").write.partitionBy("d").text(home)
    chunk = F.regexp_extract("path", r"d=(\d{4}-\d{2}-\d{2})", 1).alias("chunk")
    return sinks.file_manifest(spark, home).select(chunk, "sha256", "size_bytes")


@query("files_with_date", """
select cast(cast(ts as date) as varchar) as flight_date, count(*) as n, cast(min(event_id) as bigint) as first_event
from events group by 1""")
def files_with_date(spark, sf_dir):
    home = f"{checkpoint_dir(spark)}/aeroquant/chunks-{uuid.uuid4().hex}"
    e = tables.table(spark, sf_dir, "events")
    chunk = F.concat(F.lit("arrivals_LGTS_"), F.to_date("ts").cast("string"))
    e.select("event_id", chunk.alias("chunk")).write.partitionBy("chunk").parquet(home)
    rows = landed.with_file_date(landed.read_landed(spark, home, "event_id bigint"))
    return rows.groupBy("flight_date").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("stage_stats_upsert", """
with n as (select event_id, case when event_id % 3 = 0 then null else value end v, event_type from events)
select '1_flights' as stage, count(*) as n_rows, 3 as n_cols, round(100 * avg((v is null)::int), 1) as v_null_pct,
  '1' as second_event from n
union all select '2_weather', count(*), 3, null, '2' from n where v is not null""")
def stage_stats_upsert(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), "event_type")
    at = lambda df, name, hours: sinks.stage_stats(df, name, ["event_id"]).withColumn(
        "timestamp_utc", F.timestamp_seconds(F.lit(hours * 3600))
    )
    filled = rows.where(F.col("v").isNotNull())
    log = at(filled, "1_flights", 1).unionByName(at(filled, "2_weather", 2))
    merged = sinks.upsert_stage_stats(log, at(rows, "1_flights", 3))
    return merged.select("stage", "n_rows", "n_cols", F.try_element_at("null_rates_pct", F.lit("v")).alias("v_null_pct"),
                         F.col("sample_rows")[1]["event_id"].alias("second_event"))


# --- inventories and dates -------------------------------------------------------

def chunk_paths(spark, sf_dir):
    """Paths of landed chunks: one per route and day, one per airport and week."""
    f = tables.flights(spark, sf_dir)
    d = F.to_date("firstSeen")
    origin, dest = F.upper("estDepartureAirport"), F.upper("estArrivalAirport")
    span = F.concat(d.cast("string"), F.lit("_"), d.cast("string"), F.lit(".parquet"))
    arrivals = f.select(F.concat(
        F.lit("data\\raw/"), origin, F.lit("_"), dest, F.lit("/arrivals/arrivals_"), dest, F.lit("_"), span).alias("path"))
    week = F.to_date(F.date_trunc("week", "firstSeen"))
    weeks = F.concat(week.cast("string"), F.lit("_"), F.date_add(week, 6).cast("string"), F.lit(".parquet"))
    weather = f.where(origin != "VIEW").select(F.concat(
        F.lit("data/raw/weather_hist_chunks/"), origin, F.lit("/"), origin, F.lit("_"), weeks).alias("path"))
    noise = f.select(F.concat(F.lit("data/raw/notes/"), F.lower(origin), F.lit(".txt")).alias("path"))
    return arrivals.unionByName(weather).unionByName(noise).distinct()


def route_list(spark, sf_dir):
    airports = [F.lit(a.upper()) for a in tables.AIRPORTS]
    f = tables.flights(spark, sf_dir).select(F.upper("estDepartureAirport").alias("origin")).distinct()
    return f.withColumn("destination", F.explode(F.array(*airports)))


REMOTE = f"""{FLIGHTS},
a as (select concat(upper(dep), '_', upper(arr)) route_key, max(cast(firstSeen as date)) d from flights_v group by 1),
w as (select upper(dep) airport, max(cast(date_trunc('week', firstSeen) as date)) + 6 d from flights_v where dep <> 'view' group by 1),
o as (select distinct upper(dep) airport from flights_v),
routes as (select x.airport origin, y.airport destination from o x, o y),
remote as (select concat(origin, '_', destination) route_key, a.d last_flight_date, greatest(w1.d, w2.d) last_weather_date
  from routes left join a on a.route_key = concat(origin, '_', destination)
  left join w w1 on w1.airport = origin left join w w2 on w2.airport = destination)
"""


@query("path_inventory_max_date", f"""
with {REMOTE} select route_key, cast(last_flight_date as varchar) as last_flight_date, cast(last_weather_date as varchar) as last_weather_date from remote""")
def path_inventory_max_date(spark, sf_dir):
    dates = incremental.remote_dates(route_list(spark, sf_dir), chunk_paths(spark, sf_dir))
    return dates.select("route_key", day("last_flight_date"), day("last_weather_date"))


@query("needs_update", f"""
with {REMOTE} select d as as_of, bool_or(last_flight_date is null or last_weather_date is null or last_flight_date < cast(d as date) - 1
  or last_weather_date < cast(d as date) - 1) as needs_update
from remote, (values ('2024-01-30'), ('2024-02-05')) t(d) group by d""")
def needs_update(spark, sf_dir):
    dates = incremental.remote_dates(route_list(spark, sf_dir), chunk_paths(spark, sf_dir))
    at = lambda d: incremental.needs_update(dates, incremental.as_of(d)).select(F.lit(d).alias("as_of"), "needs_update")
    return at("2024-01-30").unionByName(at("2024-02-05"))


@query("last_chunk_dates", f"""
with {FLIGHTS} select upper(arr) as airport, cast(max(cast(firstSeen as date)) as varchar) as last_date from flights_v where event_id % 3 <> 0 group by 1""")
def last_chunk_dates(spark, sf_dir):
    f = tables.flights(spark, sf_dir)
    d = F.to_date("firstSeen").cast("string")
    tail = F.when(F.col("event_id") % 3 == 0, F.lit("9999-99-99")).otherwise(d)  # malformed dates are skipped
    names = f.select(F.concat(F.lit("arrivals_"), F.upper("estArrivalAirport"), F.lit("_"), d, F.lit("_"), tail, F.lit(".parquet")).alias("name"))
    return incremental.last_chunk_dates(names).select("airport", day("last_date"))


LAST = f"""{FLIGHTS}, {WEATHER_V},
ends as (select distinct route, dep origin, arr destination from sane),
lf as (select route, max(cast(firstSeen as date)) d from sane where event_id % 5 <> 1 or firstSeen < timestamp '2024-01-12' group by route),
ch as (select route, max(cast(firstSeen as date)) - 8 d from sane where airline <> 'CLI' group by route),
lw as (select route, max(cast("time" as date)) d from ends left join weather_v on airport in (origin, destination) and "time" < timestamp '2024-01-25' group by route),
dates as (select e.route, greatest(lf.d, ch.d) last_flight_date, lw.d last_weather_date
  from ends e left join lf using (route) left join ch using (route) left join lw using (route))
"""


def last_dates_frame(spark, sf_dir):
    rows = sane(spark, sf_dir)
    stored = rows.where((F.col("event_id") % 5 != 1) | (F.col("firstSeen") < F.lit("2024-01-12").cast("timestamp")))
    chunks = rows.where(F.col("airline") != "CLI").groupBy("route").agg(F.date_sub(F.to_date(F.max("firstSeen")), 8).alias("last_date"))
    routes = rows.select("route", F.col("estDepartureAirport").alias("origin"), F.col("estArrivalAirport").alias("destination")).distinct()
    weather = tables.weather_hours(spark, sf_dir).where(F.col("time") < F.lit("2024-01-25").cast("timestamp"))
    flights = incremental.last_flight_dates(stored, chunks)
    return flights.join(incremental.last_weather_dates(weather, routes), "route", "full")


@query("last_dates", f"with {LAST} select route, cast(last_flight_date as varchar) as last_flight_date, cast(last_weather_date as varchar) as last_weather_date from dates")
def last_dates(spark, sf_dir):
    return last_dates_frame(spark, sf_dir).select("route", day("last_flight_date"), day("last_weather_date"))


@query("resume_range", f"""
with {LAST} select route, cast(least(last_flight_date, last_weather_date) + 1 as varchar) as resume_from, '2024-01-24' as resume_to,
  case when least(last_flight_date, last_weather_date) is null then 'full_backfill'
    when least(last_flight_date, last_weather_date) + 1 > date '2024-01-24' then 'already_up_to_date' else 'update' end as status,
  cast(least(last_flight_date, last_weather_date) as varchar) as fetched_through
from dates""")
def resume_range(spark, sf_dir):
    dates = last_dates_frame(spark, sf_dir)
    out = incremental.fetched_through(incremental.resume_ranges(dates, incremental.as_of("2024-01-24")))
    return out.select("route", day("resume_from"), day("resume_to"), "status", day("fetched_through"))


@query("missing_chunks", f"""
with {FLIGHTS}, s as (select upper(arr) airport, min(cast(firstSeen as date)) d0, max(cast(firstSeen as date)) d1 from flights_v group by 1),
e as (select airport, cast(unnest(generate_series(cast(d0 as timestamp), cast(d1 as timestamp), interval 1 day)) as date) d from s),
have as (select distinct upper(arr) airport, cast(firstSeen as date) d from flights_v where event_id % 90 = 0)
select airport, cast(d as varchar) as chunk_start, cast(d as varchar) as chunk_end from e
where not exists (select 1 from have h where h.airport = e.airport and h.d = e.d)""")
def missing_chunks(spark, sf_dir):
    f = tables.flights(spark, sf_dir).select(F.upper("estArrivalAirport").alias("airport"), F.to_date("firstSeen").alias("d"), "event_id")
    spans = f.groupBy("airport").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    expected = incremental.expected_chunks(spans, "first", "last", 1)
    have = f.where(F.col("event_id") % 90 == 0).select("airport", F.col("d").alias("chunk_start"), F.col("d").alias("chunk_end")).distinct()
    missing = incremental.missing_chunks(expected, have, "airport")
    return missing.select("airport", day("chunk_start"), day("chunk_end"))


# --- control state ---------------------------------------------------------------

@query("backoff_filter", """
with t as (select max(o_orderdate) now from orders)
select o_orderkey, o_orderstatus = 'F' and o_orderdate > now - interval 2 day as in_backoff,
  case when o_orderstatus = 'F' and o_orderdate > now - interval 2 day then epoch_us(o_orderdate + interval 2 day) end as retry_at
from orders, t""")
def backoff_filter(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    now = o.agg(F.max("o_orderdate")).scalar()  # as of the newest order
    control = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("last_failure_utc"))
    return incremental.runnable(control, now).select("o_orderkey", "in_backoff", us("retry_at"))


@query("control_upsert", """
with s as (select cast(o_custkey as varchar) route, o_orderpriority stage, o_orderstatus status, o_orderdate updated,
  row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderstatus desc) rn from orders)
select route, stage, status, epoch_us(updated) as updated_utc from s where rn = 1""")
def control_upsert(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    states = o.select(F.col("o_custkey").cast("string").alias("route"), F.col("o_orderpriority").alias("stage"),
                      F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_utc"))
    old = F.col("updated_utc") < F.lit("1998-01-01").cast("timestamp")
    merged = incremental.upsert_control(states.where(old), states.where(~old))
    return merged.select("route", "stage", "status", us("updated_utc"))


@query("stage_outcome", """
select o_orderkey, case when o_orderstatus = 'F' then 'failed' else 'success' end as flights_status,
  case when o_orderstatus = 'F' then 'not_attempted' when o_orderpriority = '5-LOW' then 'failed' else 'success' end as weather_status,
  case when o_orderstatus = 'F' or o_orderpriority = '5-LOW' then 'failed' else 'success' end as status from orders""")
def stage_outcome(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("flights_status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("success").alias("weather_status"),
    )
    return incremental.stage_plan(o)


@query("run_summary", """
with r as (select case o_orderstatus when 'F' then 'failed' when 'P' then 'skipped_backoff' else
  case when o_orderpriority = '5-LOW' then 'already_up_to_date' else 'success' end end status from orders)
select count(*) filter (where status in ('success', 'already_up_to_date')) as ok, count(*) filter (where status = 'failed') as failed,
  count(*) filter (where status = 'skipped_backoff') as skipped_backoff, count(*) as total from r""")
def run_summary(spark, sf_dir):
    s = F.col("o_orderstatus")
    done = F.when(F.col("o_orderpriority") == "5-LOW", "already_up_to_date").otherwise("success")
    status = F.when(s == "F", "failed").when(s == "P", "skipped_backoff").otherwise(done)
    return incremental.run_summary(tables.table(spark, sf_dir, "orders").select(status.alias("status")))


# --- streams -----------------------------------------------------------------------

def flight_stream(spark, sf_dir):
    e = ingest.read_files(spark, sf_dir, EVENTS, "events.parquet")
    return e.select(
        F.col("user_id").cast("string").alias("icao24"), F.col("ts").alias("firstSeen"),
        times.plus_minutes(F.col("ts"), F.col("value")).alias("lastSeen"),
        F.col("event_type").alias("estDepartureAirport"),
        F.element_at(F.array(*[F.lit(a) for a in tables.AIRPORTS]), (F.col("event_id") % 5).cast("int") + 1).alias("estArrivalAirport"),
        F.concat(F.upper(F.substring("event_type", 1, 3)), F.col("event_id").cast("string")).alias("callsign"), "event_id",
    )


@query("stream_dedup", f"with {FLIGHTS} select icao24, epoch_us(firstSeen) as firstSeen, epoch_us(lastSeen) as lastSeen, event_id from flights_v")
def stream_dedup(spark, sf_dir):
    first = flight_stream(spark, sf_dir)
    again = flight_stream(spark, sf_dir).where(F.col("event_id") % 2 == 0)
    out = ingest.run_available(ingest.dedup(first.unionByName(again), "60 days"), "dedup")
    return out.select("icao24", us("firstSeen"), us("lastSeen"), "event_id")


@query("stream_enrich", f"""
with {FLIGHTS}, {WEATHER_V}
select t.event_id, airline, round(d.v_avg, 6) as dep_v_avg, round(a.v_avg, 6) as arr_v_avg
from trips t left join weather_v d on d.airport = t.dep and d."time" = t.dep_hour
left join weather_v a on a.airport = t.arr and a."time" = t.arr_hour""")
def stream_enrich(spark, sf_dir):
    stream = ingest.enrich(flight_stream(spark, sf_dir), tables.weather_hours(spark, sf_dir), ["v_avg"])
    out = ingest.run_available(stream, "enrich")
    return out.select("event_id", "airline", r6("dep_v_avg", "dep_v_avg"), r6("arr_v_avg", "arr_v_avg"))


@query("add_missing_columns", "select event_id, cast(null as double) as cape, cast(null as double) as visibility from events")
def add_missing_columns(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id")
    return add_missing(clean.with_weather_columns(e, ["cape"]), ["cape", "visibility"]).select("event_id", "cape", "visibility")


@query("request_features", f"""
with {FLIGHTS}, {WEATHER_V}, s as (select * from weather_v),
d as (select event_id, v_avg, row_number() over (partition by event_id order by abs(epoch_us(s."time") - epoch_us(f.firstSeen)), s."time") rn
      from flights_v f join s on s.airport = f.dep),
a as (select event_id, v_avg, row_number() over (partition by event_id order by abs(epoch_us(s."time") - epoch_us(f.lastSeen)), s."time") rn
      from flights_v f join s on s.airport = f.arr)
select f.event_id, concat(dep, '->', arr) as route, round(d.v_avg, 6) as dep_v_avg, round(a.v_avg, 6) as arr_v_avg,
  cast(hour(firstSeen) as int) as hour_of_day from flights_v f
left join d on d.event_id = f.event_id and d.rn = 1 left join a on a.event_id = f.event_id and a.rn = 1""")
def request_features(spark, sf_dir):
    forecast = tables.weather_hours(spark, sf_dir)
    requests = tables.flights(spark, sf_dir).select(
        "event_id", F.col("estDepartureAirport").alias("origin"), F.col("estArrivalAirport").alias("destination"),
        F.col("firstSeen").alias("departure"), F.col("lastSeen").alias("arrival"),
    )
    out = scoring.request_features(requests, forecast, ["v_avg"])
    return out.select("event_id", "route", r6("dep_v_avg", "dep_v_avg"), r6("arr_v_avg", "arr_v_avg"), "hour_of_day")


@query("incremental_update", f"""
with {FLIGHTS} select icao24, epoch_us(firstSeen) as firstSeen, epoch_us(lastSeen) as lastSeen, callsign, route,
  cast(cast(firstSeen as date) as varchar) as flight_date from sane where dep < arr""")
def incremental_update(spark, sf_dir):
    """Two overlapping batches merged into one table."""
    path = f"{checkpoint_dir(spark)}/aeroquant/flights-{uuid.uuid4().hex}"
    f = tables.flights(spark, sf_dir).drop("value", "event_id")
    cut = F.lit("2024-01-16").cast("timestamp")
    routes = routes_frame(spark, sf_dir)
    first = f.where(F.col("firstSeen") < cut)
    update.update_flights(spark, first, routes, path)
    update.update_flights(spark, f.where(F.col("firstSeen") >= cut).unionByName(first.where(F.col("icao24") < "2")), routes, path)
    stored = spark.read.schema("icao24 string, firstSeen timestamp, lastSeen timestamp, callsign string, route string, flight_date date").parquet(path)
    return stored.select("icao24", us("firstSeen"), us("lastSeen"), "callsign", "route", day("flight_date"))


@query("weather_update", f"""
with {WEATHER_V}, b as (select airport, "time" t, v_avg, 1 batch from weather_v where "time" < timestamp '2024-01-16'
  union all select airport, "time", v_avg + 1, 2 from weather_v where "time" >= timestamp '2024-01-12'),
k as (select *, row_number() over (partition by airport, t order by batch) rn from b)
select airport, epoch_us(t) as "time", round(v_avg, 6) as v_avg, cast(cast(t as date) as varchar) as weather_date from k where rn = 1""")
def weather_update(spark, sf_dir):
    """Two overlapping batches of hours; the stored hour wins."""
    path = f"{checkpoint_dir(spark)}/aeroquant/hours-{uuid.uuid4().hex}"
    hours = tables.weather_hours(spark, sf_dir).select("airport", "time", "v_avg")
    at = lambda d: F.lit(d).cast("timestamp")
    update.update_weather(spark, hours.where(F.col("time") < at("2024-01-16")), path)
    update.update_weather(spark, hours.where(F.col("time") >= at("2024-01-12")).withColumn("v_avg", F.col("v_avg") + 1), path)
    stored = spark.read.schema("airport string, time timestamp, v_avg double, weather_date date").parquet(path)
    return stored.select("airport", us("time"), r6("v_avg", "v_avg"), day("weather_date"))


@query("update_run", f"""
with {FLIGHTS}, ends as (select distinct route, dep, arr from sane),
f as (select route, cast(max(cast(firstSeen as date)) as varchar) d from sane where firstSeen < timestamp '2024-01-16' group by route),
w as (select event_type airport, max(cast(date_trunc('hour', ts) as date)) d from events where ts < timestamp '2024-01-16' group by 1)
select e.route, case when f.d is null and w.d is null then 'failed' else 'success' end as status, f.d as flights_through,
  cast(greatest(w.d, v.d) as varchar) as weather_through
from ends e left join f on e.route = f.route left join w on w.airport = e.dep left join w v on v.airport = e.arr""")
def update_run(spark, sf_dir):
    """The update job over landed files of all routes, up to a given day."""
    home = f"{checkpoint_dir(spark)}/aeroquant/update-{uuid.uuid4().hex}"
    f = tables.flights(spark, sf_dir)
    epoch = {c: F.unix_seconds(c).alias(c) for c in ("firstSeen", "lastSeen")}
    arrivals = f.select(*[
        epoch[n] if n in epoch else F.col(n) if n in f.columns else F.lit(None).cast(t.dataType).alias(n)
        for n, t in ((t.name, t) for t in landed.ARRIVAL_SCHEMA.fields)
    ])
    arrivals.write.parquet(f"{home}/arrivals")
    tables.weather(spark, sf_dir).write.parquet(f"{home}/hours")
    routes = sane(spark, sf_dir).select(F.col("estDepartureAirport").alias("origin"), F.col("estArrivalAirport").alias("destination")).distinct()
    run = update.update_all(spark, routes, f"{home}/out", f"{home}/arrivals", f"{home}/hours", datetime(2024, 1, 15, 23, tzinfo=timezone.utc))
    return run.results.select("route", "status", day("flights_through"), day("weather_through"))
