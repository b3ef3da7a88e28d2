"""Driver queries: scans, filters, gates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroquant.functions import numbers, text, times
from aeroquant.operators import clean, gates, profile, quantiles
from aeroquant.plans import features as plan
from aeroquant.plans.registry import FLIGHTS, HISTORY, WEATHER_V, day, query, r6, us
from aeroquant.schemas import model_features
from aeroquant.session import settle
from aeroquant.sources import landed, tables

AIRPORT_LIST = "(['click','error','purchase','signup','view'])"


def routes_frame(spark, sf_dir):
    """Listed routes: half of the airport pairs that the flights use."""
    f = tables.flights(spark, sf_dir)
    pairs = f.select(F.col("estDepartureAirport").alias("origin"), F.col("estArrivalAirport").alias("destination"))
    return pairs.where(F.col("origin") < F.col("destination")).distinct()


def trips(spark, sf_dir):
    return plan.prepare_flights(tables.raw_flights(spark, sf_dir))


def sane(spark, sf_dir):
    return clean.sanity_filter(trips(spark, sf_dir))


# --- scans --------------------------------------------------------------------

@query("scan_events", "select event_id, epoch_us(ts) ts, event_type, round(value, 6) as value from events where ts < timestamp '2024-01-15'")
def scan_events(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    return e.select("event_id", us("ts"), "event_type", r6("value", "value"))


@query("scan_large_values", "select event_id, round(value, 6) as value from events where value > 100 and not isnan(value)")
def scan_large_values(spark, sf_dir):
    """A comparison of a double, made by the reader although NaN counts as missing."""
    e = tables.table(spark, sf_dir, "events", F.col("value") > 100)
    return e.select("event_id", r6("value", "value"))


@query("inline_parallel_arrays", f"""
with {WEATHER_V}
select airport, epoch_us("time") as "time", round(v_avg, 6) as temperature_2m, round(v_min, 6) as relative_humidity_2m
from weather_v""")
def inline_parallel_arrays(spark, sf_dir):
    hours = tables.weather_hours(spark, sf_dir)
    # one payload per airport and day, as the fetcher lands it: at most 24 hours
    point = F.struct(F.date_format("time", "yyyy-MM-dd'T'HH:mm").alias("t"), F.col("v_avg"), F.col("v_min"))
    payload = (
        hours.groupBy("airport", F.to_date("time").alias("d"))
        .agg(F.array_sort(F.collect_list(point)).alias("p"))
        .select("airport", F.to_json(F.struct(F.struct(
            F.col("p.t").alias("time"), F.col("p.v_avg").alias("temperature_2m"),
            F.col("p.v_min").alias("relative_humidity_2m"),
        ).alias("hourly"))).alias("payload"))
    )
    rows = landed.inline_hourly(
        landed.parse_weather_payload(payload, "payload"), ["temperature_2m", "relative_humidity_2m"], "airport"
    )
    return rows.select("airport", us("time"), r6("temperature_2m", "temperature_2m"),
                       r6("relative_humidity_2m", "relative_humidity_2m"))


@query("flight_json_records", f"""
with {FLIGHTS}
select icao24, epoch_us(firstSeen) // 1000000 as firstSeen, dep as estDepartureAirport, callsign from flights_v""")
def flight_json_records(spark, sf_dir):
    f = tables.flights(spark, sf_dir)
    record = F.struct("icao24", F.unix_seconds("firstSeen").alias("firstSeen"), "estDepartureAirport", "callsign")
    # one payload per flight; a day of one airport may be large
    payload = f.select(F.to_json(F.array(record)).alias("payload"))
    rows = landed.flight_records(payload, "payload")
    return rows.select("icao24", "firstSeen", "estDepartureAirport", "callsign")


# --- filters --------------------------------------------------------------------

@query("route_filter", f"""
with {FLIGHTS}
select event_id, arr as destination_airport, route, concat(dep, '_', arr) as dep_arr from trips where dep < arr""")
def route_filter(spark, sf_dir):
    f = clean.on_routes(tables.flights(spark, sf_dir), routes_frame(spark, sf_dir))
    fallback = clean.ensure_route(f.withColumnRenamed("route", "listed"))
    return fallback.select("event_id", "destination_airport", F.col("listed").alias("route"), F.col("route").alias("dep_arr"))


@query("sanity_filter", f"with {FLIGHTS} select event_id, round(flight_duration, 6) as minutes from sane")
def sanity_filter(spark, sf_dir):
    return sane(spark, sf_dir).select("event_id", r6("flight_duration", "minutes"))


@query("outlier_filter", f"with {FLIGHTS} select event_id, round(flight_duration, 6) as minutes from trips where flight_duration <= 240")
def outlier_filter(spark, sf_dir):
    kept = clean.drop_outliers(trips(spark, sf_dir))
    return kept.select("event_id", r6("flight_duration", "minutes"))


@query("windowed_outlier_filter", f"""
with {HISTORY}
select l_orderkey, l_linenumber, flight_duration from history_v
where not (firstSeen between timestamp '1996-04-01' and timestamp '1996-07-01' and flight_duration > 300)""")
def windowed_outlier_filter(spark, sf_dir):
    kept = clean.drop_outliers_between(tables.history(spark, sf_dir), "1996-04-01", "1996-07-01", 300)
    return kept.select("l_orderkey", "l_linenumber", "flight_duration")


@query("model_features", f"""
with {FLIGHTS}, {WEATHER_V}
select t.event_id, round(wd.v_avg, 6) as dep_temperature_2m, round(wa.v_max, 6) as arr_dew_point_2m,
  cast(hour(t.firstSeen) as int) as hour_of_day, cast(month(t.firstSeen) as int) as "month", 32 as n_features
from sane t
left join weather_v wd on wd.airport = t.dep and wd."time" = t.dep_hour
left join weather_v wa on wa.airport = t.arr and wa."time" = t.arr_hour""")
def model_features_query(spark, sf_dir):
    flights = clean.sanity_filter(tables.raw_flights(spark, sf_dir))
    table = plan.feature_matrix(flights, tables.weather(spark, sf_dir))
    chosen = model_features(table)
    return table.select("callsign", *chosen).select(
        F.regexp_extract("callsign", r"(\d+)$", 1).cast("bigint").alias("event_id"),
        r6("dep_temperature_2m", "dep_temperature_2m"), r6("arr_dew_point_2m", "arr_dew_point_2m"),
        "hour_of_day", "month", F.lit(len(chosen)).alias("n_features"),
    )


@query("constant_columns", f"""
with {HISTORY}, c as (
  select count(distinct icao24) a, count(distinct flight_duration) b, count(distinct route) c, count(distinct l_discount) d
  from history_v)
select 'icao24' as "column", a <= 1 as is_constant from c union all
select 'flight_duration', b <= 1 from c union all
select 'route', c <= 1 from c union all
select 'l_discount', d <= 1 from c""")
def constant_columns(spark, sf_dir):
    return clean.constant_columns(tables.history(spark, sf_dir), ["icao24", "flight_duration", "route", "l_discount"])


@query("weather_semi", f"""
with {FLIGHTS}, {WEATHER_V},
ends as (select dep airport from flights_v where dep < arr and dep <> 'click'
         union select arr from flights_v where dep < arr and dep <> 'click')
select airport, epoch_us("time") as "time", cast(v_n as bigint) as v_n from weather_v where airport in (select airport from ends)""")
def weather_semi(spark, sf_dir):
    routes = routes_frame(spark, sf_dir).where(F.col("origin") != "click")
    return clean.at_airports(tables.weather_hours(spark, sf_dir), routes).select("airport", us("time"), "v_n")


@query("distinct_airlines", f"with {FLIGHTS} select distinct route, airline from sane where airline is not null")
def distinct_airlines(spark, sf_dir):
    return profile.distinct_airlines(sane(spark, sf_dir)).orderBy("route", "airline")


@query("union_by_name", f"""
with {FLIGHTS}
select event_id, callsign, cast(null as double) as value, 0 as src from flights_v
union all select event_id, null, round(value, 6), 1 from flights_v where value > 100""")
def union_by_name(spark, sf_dir):
    f = tables.flights(spark, sf_dir)
    stored = f.select("event_id", "callsign", F.lit(0).alias("src"))
    new = f.where(F.col("value") > 100).select(r6("value", "value"), F.lit(1).alias("src"), "event_id")
    return clean.union_by_name(stored, new).select("event_id", "callsign", "value", "src")


@query("chrono_order", f"""
with {FLIGHTS}
select event_id, epoch_us(firstSeen) as firstSeen, icao24 from sane order by firstSeen, icao24, lastSeen, callsign""")
def chrono_order(spark, sf_dir):
    ordered = sane(spark, sf_dir).orderBy(*tables.FLIGHT_ORDER)
    return ordered.select("event_id", us("firstSeen"), "icao24")


# --- gates ----------------------------------------------------------------------

@query("gate_time_order", """
select 'time_order' as gate, count(*) filter (where l_shipdate <= o_orderdate) as n_bad
from lineitem join orders on l_orderkey = o_orderkey""")
def gate_time_order(spark, sf_dir):
    li, o = tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "orders")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").alias("firstSeen"), F.col("l_shipdate").alias("lastSeen")
    )
    return gates.row_report(rows, {"time_order": gates.bad_time_order()})


@query("gate_duplicates", """
select 'duplicates' as gate, cast(coalesce(sum(n), 0) as bigint) as n_bad
from (select count(*) n from lineitem group by l_suppkey, l_orderkey, l_linenumber having count(*) > 1)""")
def gate_duplicates(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    return gates.duplicate_report(li, ["l_suppkey", "l_orderkey", "l_linenumber"])


@query("gate_weather_key", """
select 'weather_key' as gate, cast(coalesce(sum(n), 0) as bigint) as n_bad
from (select count(*) n from events
      group by event_type, cast(round_even(epoch_us(ts)/3.6e9, 0) as bigint) having count(*) > 1)""")
def gate_weather_key(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("airport"), times.round_hour(F.col("ts")).alias("hour")
    )
    return gates.duplicate_report(e, ["airport", "hour"], "weather_key")


@query("gate_join_fanout", """
select 'join_fanout' as gate, cast(coalesce(sum(n - 1), 0) as bigint) as n_bad
from (select count(*) n from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""")
def gate_join_fanout(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    return gates.duplicate_report(li, ["l_orderkey", "l_linenumber"], "join_fanout", extra_only=True)


def joined(spark, sf_dir):
    """Feature rows over the sane flights; some lack weather."""
    flights = clean.sanity_filter(tables.raw_flights(spark, sf_dir))
    return plan.feature_matrix(flights, tables.weather(spark, sf_dir))


JOINED = f"""{FLIGHTS}, {WEATHER_V},
joined as (
  select t.*, wd.v_avg dep_avg, wd.v_n dep_n, wa.v_avg arr_avg, wa.v_n arr_n,
    coalesce(wd.v_n, 0) > 1 dep_ok, coalesce(wa.v_n, 0) > 1 arr_ok
  from sane t
  left join weather_v wd on wd.airport = t.dep and wd."time" = t.dep_hour
  left join weather_v wa on wa.airport = t.arr and wa."time" = t.arr_hour)
"""


@query("gate_not_null", f"with {JOINED} select 'not_null' as gate, count(*) filter (where airline is null or callsign is null or dep is null) as n_bad from joined")
def gate_not_null(spark, sf_dir):
    return gates.row_report(joined(spark, sf_dir), {"not_null": gates.bad_null()})


@query("gate_weather_complete", f"with {JOINED} select 'weather_complete' as gate, count(*) filter (where not (dep_ok and arr_ok)) as n_bad from joined")
def gate_weather_complete(spark, sf_dir):
    return gates.row_report(joined(spark, sf_dir), {"weather_complete": gates.bad_weather()})


@query("gate_duration", """
with d as (select ln(value - 30) x, value from events where value > 30 union all
           select case when value > 10 then 'nan'::double else null end, value from events where value <= 30)
select 'duration_finite' as gate, count(*) filter (where x is null or isnan(x) or isinf(x)) as n_bad from d
union all select 'duration_positive', count(*) filter (where not isnan(x) and not isinf(x) and x <= 0) from d""")
def gate_duration(spark, sf_dir):
    v = F.col("value")
    d = tables.table(spark, sf_dir, "events").select(
        F.when(v > 30, F.ln(v - 30)).when(v > 10, F.lit(float("nan"))).alias("flight_duration")
    )
    return gates.row_report(d, {"duration_finite": gates.bad_finite(), "duration_positive": gates.bad_positive()})


@query("feasible_routes", f"with {FLIGHTS} select route, count(*) as n from sane where flight_duration <= 240 group by route having count(*) >= 50")
def feasible_routes(spark, sf_dir):
    return plan.feasible_routes(clean.drop_outliers(sane(spark, sf_dir)), 50)


# --- scalar functions -------------------------------------------------------------

MESSY = "case when event_id % 7 = 0 then null when event_id % 7 = 1 then '  ' || lower({c}) || ' ' when event_id % 7 = 2 then ' nan ' when event_id % 7 = 3 then cast(event_id as varchar) when event_id % 7 = 4 then '' else {c} end"


@query("airline_code", f"""
with {FLIGHTS}, m as (select event_id, {MESSY.format(c='callsign')} c from flights_v)
select event_id, case when upper(trim(c)) = 'NAN' then null else nullif(regexp_extract(upper(trim(c)), '^([A-Z]{{2,4}})', 1), '') end as airline from m""")
def airline_code(spark, sf_dir):
    k, c = F.col("event_id") % 7, F.col("callsign")
    messy = (
        F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.lit("  "), F.lower(c), F.lit(" ")))
        .when(k == 2, " nan ").when(k == 3, F.col("event_id").cast("string")).when(k == 4, "").otherwise(c)
    )
    return tables.flights(spark, sf_dir).select("event_id", text.airline_code(messy).alias("airline"))


@query("airline_prefix3", f"with {FLIGHTS} select event_id, callsign[1:3] as airline from flights_v")
def airline_prefix3(spark, sf_dir):
    return tables.flights(spark, sf_dir).select("event_id", text.airline_prefix3(F.col("callsign")).alias("airline"))


@query("airline_label", """
select event_id, case when event_id % 4 = 0 then 'Unknown carrier' when event_id % 4 = 1 then 'Aegean Airlines'
  when event_id % 4 = 2 then 'KLM' else 'Unmapped carrier (' || upper(event_type[1:3]) || ')' end as label from events""")
def airline_label(spark, sf_dir):
    k = F.col("event_id") % 4
    code = F.when(k == 0, F.lit(None)).when(k == 1, "AEE").when(k == 2, "KLM").otherwise(F.upper(F.substring("event_type", 1, 3)))
    return tables.table(spark, sf_dir, "events").select("event_id", text.airline_label(code).alias("label"))


@query("parse_timestamp", """
select event_id, epoch_us(date_trunc('second', ts)) as from_seconds, epoch_us(ts) as from_time,
  epoch_us(date_trunc('second', ts)) as from_text, cast(null as bigint) as from_bad from events""")
def parse_timestamp(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(
        "event_id", F.unix_seconds("ts").alias("from_seconds"), F.col("ts").alias("from_time"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("from_text"), F.concat(F.lit("bad "), "event_type").alias("from_bad"),
    )
    columns = ["from_seconds", "from_time", "from_text", "from_bad"]
    return times.normalise_timestamps(e, columns).select("event_id", *[us(c) for c in columns])


@query("epoch_units", """
select event_id, epoch_us(date_trunc('second', ts)) as from_s, (epoch_us(ts) // 1000) * 1000 as from_ms,
  epoch_us(ts) as from_us, epoch_us(ts) as from_ns from events""")
def epoch_units(spark, sf_dir):
    micros = F.unix_micros("ts")
    numbers_ = {"from_s": F.unix_seconds("ts"), "from_ms": F.unix_millis("ts"), "from_us": micros, "from_ns": micros * 1000 + 7}
    e = tables.table(spark, sf_dir, "events")
    return e.select("event_id", *[F.unix_micros(times.epoch_to_timestamp(c)).alias(n) for n, c in numbers_.items()])


@query("round_hour", f"""
with {FLIGHTS}, s as (
  select event_id, firstSeen t from flights_v union all
  select event_id, make_timestamp((epoch_us(firstSeen) // 1800000000) * 1800000000) from flights_v)
select event_id, epoch_us(t) as t, cast(round_even(epoch_us(t)/3.6e9, 0) as bigint) * 3600000000 as hour from s""")
def round_hour(spark, sf_dir):
    f = tables.flights(spark, sf_dir)
    half = 1_800_000_000
    exact = F.timestamp_micros(F.floor(F.unix_micros("firstSeen") / half) * half)
    both = f.select("event_id", F.col("firstSeen").alias("t")).unionByName(f.select("event_id", exact.alias("t")))
    return both.select("event_id", us("t"), F.unix_micros(times.round_hour(F.col("t"))).alias("hour"))


@query("calendar_parts", f"""
with {FLIGHTS}
select event_id, cast(hour(firstSeen) as int) as hour_of_day, cast(month(firstSeen) as int) as "month",
  cast(cast(firstSeen as date) as varchar) as flight_date_parsed from flights_v""")
def calendar_parts(spark, sf_dir):
    parts = times.calendar_parts(F.col("firstSeen"))
    return tables.flights(spark, sf_dir).withColumns(parts).select(
        "event_id", "hour_of_day", "month", day("flight_date_parsed")
    )


@query("duration_minutes", f"with {FLIGHTS} select event_id, round(flight_duration, 6) as minutes from trips")
def duration_minutes(spark, sf_dir):
    minutes = times.duration_minutes(F.col("firstSeen"), F.col("lastSeen"))
    return tables.flights(spark, sf_dir).select("event_id", r6(minutes, "minutes"))


@query("chunk_windows", """
with s as (select event_type airport, cast(min(ts) as date) d0, cast(max(ts) as date) d1 from events group by 1),
c as (select airport, d1, unnest(generate_series(cast(d0 as timestamp), cast(d1 as timestamp), interval 14 day)) cs from s)
select airport, cast(cast(cs as date) as varchar) as chunk_start,
  cast(cast(least(cs + interval 13 day, cast(d1 as timestamp)) as date) as varchar) as chunk_end,
  epoch(cs)::bigint as begin_unix, (epoch(least(cs + interval 13 day, cast(d1 as timestamp))) + 86340)::bigint as end_unix from c""")
def chunk_windows(spark, sf_dir):
    spans = tables.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("airport")).agg(
        F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last")
    )
    return times.chunk_windows(spans, "first", "last", 14).select(
        "airport", day("chunk_start"), day("chunk_end"), "begin_unix", "end_unix"
    )


@query("key_format", f"""
with {FLIGHTS}
select event_id, strftime(firstSeen, '%Y-%m-%d %H:00') as hour_key,
  replace(replace(dep || '/' || strftime(firstSeen, '%H:%M'), '/', '-'), ':', '-') as safe_key,
  replace(route, '->', '_') as route_dir from trips""")
def key_format(spark, sf_dir):
    raw = F.concat(F.col("estDepartureAirport"), F.lit("/"), F.date_format("firstSeen", "HH:mm"))
    return trips(spark, sf_dir).select(
        "event_id", times.hour_key(F.col("firstSeen")).alias("hour_key"), text.safe_key(raw).alias("safe_key"),
        text.route_to_key(F.col("route")).alias("route_dir"),
    )


@query("signed_log", """
with c as (select event_id, greatest(-60.0, least(60.0, value - 40)) x from events)
select event_id, round(x, 6) as clipped, round(sign(x) * ln(1 + abs(x)), 6) as signed_log from c""")
def signed_log(spark, sf_dir):
    x = numbers.clip(F.col("value") - 40, -60, 60)
    return tables.table(spark, sf_dir, "events").select(
        "event_id", r6(x, "clipped"), r6(numbers.signed_log(x), "signed_log")
    )


@query("impute_apply", """
with m as (select median(value) med from events where event_id % 5 <> 0)
select event_id, round(case when event_id % 5 = 0 then (select med from m) else value end, 6) as value, 0.0::double as never from events""")
def impute_apply(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.lit(float("nan")).alias("never")
    )
    fitted = quantiles.medians(e, [], "value", "med").select("med").scalar()
    return e.select(
        "event_id", r6(numbers.impute(F.col("value"), fitted), "value"),
        numbers.impute(F.col("never"), F.lit(None).cast("double")).alias("never"),
    )


@query("buffer_minutes", f"""
with {FLIGHTS}, m as (select route, median(flight_duration) med from sane group by route)
select event_id, cast(round_even(med + (flight_duration - med), 0) as bigint) as total_min,
  (case when flight_duration - med < 0 then '-' else '+' end) || cast(abs(cast(round_even(flight_duration - med, 0) as bigint)) as varchar) || ' min vs. median' as delta_label
from sane join m using (route)""")
def buffer_minutes(spark, sf_dir):
    s = sane(spark, sf_dir)
    with_median = s.join(settle(quantiles.medians(s, ["route"], "flight_duration", "med")), "route")
    card = numbers.buffer_card(F.col("med"), F.col("flight_duration") - F.col("med"))
    return with_median.select("event_id", *[c.alias(n) for n, c in card.items()])


@query("labels_fmt", """
select l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%b') as month_label,
  printf('%02d:00', cast(l_linenumber as int)) as hour_label from lineitem""")
def labels_fmt(spark, sf_dir):
    return tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", times.month_label(F.col("l_shipdate")).alias("month_label"),
        times.hour_label(F.col("l_linenumber")).alias("hour_label"),
    )
