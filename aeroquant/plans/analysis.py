"""Driver queries: joins, aggregates, profiles, quantile bins."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from aeroquant.functions import numbers, times
from aeroquant.operators import clean, enrich, gates, metrics, profile, quantiles, split
from aeroquant.plans import features as plan
from aeroquant.plans.basics import JOINED, joined, sane
from aeroquant.plans.registry import FLIGHTS, HISTORY, WEATHER_V, day, query, r6, r96, us
from aeroquant.schemas import ARR_WEATHER, DEP_WEATHER
from aeroquant.session import settle
from aeroquant.sources import tables

MIN_CARRIER_ROWS = 500  # fixed value


def event_id():
    return F.regexp_extract("callsign", r"(\d+)$", 1).cast("bigint").alias("event_id")


def hourly(spark, sf_dir):
    return tables.weather_hours(spark, sf_dir)


# --- joins --------------------------------------------------------------------

@query("dep_weather_join", f"""
with {FLIGHTS}, {WEATHER_V}
select t.event_id, epoch_us(dep_hour) as dep_merge_key, round(v_avg, 6) as dep_v_avg, cast(v_n as bigint) as dep_v_n
from trips t left join weather_v w on w.airport = t.dep and w."time" = t.dep_hour""")
def dep_weather_join(spark, sf_dir):
    f = plan.prepare_flights(tables.raw_flights(spark, sf_dir))
    lookup = enrich.weather_lookup(hourly(spark, sf_dir), ["v_avg", "v_n"])
    out = enrich.join_weather(f, lookup, "estDepartureAirport", "dep_merge_key", "dep_", ["v_avg", "v_n"])
    return out.select("event_id", us("dep_merge_key"), r6("dep_v_avg", "dep_v_avg"), "dep_v_n")


@query("dep_arr_weather_join", f"""
with {FLIGHTS}, {WEATHER_V}
select t.event_id, round(d.v_avg, 6) as dep_v_avg, round(a.v_avg, 6) as arr_v_avg, round(a.v_max, 6) as arr_v_max
from trips t left join weather_v d on d.airport = t.dep and d."time" = t.dep_hour
left join weather_v a on a.airport = t.arr and a."time" = t.arr_hour""")
def dep_arr_weather_join(spark, sf_dir):
    f = plan.prepare_flights(tables.raw_flights(spark, sf_dir))
    out = enrich.join_both_ends(f, hourly(spark, sf_dir), ["v_avg", "v_max"])
    return out.select("event_id", *[r6(c, c) for c in ("dep_v_avg", "arr_v_avg", "arr_v_max")])


@query("string_key_join", f"""
with {FLIGHTS}, w as (
  select event_type airport, strftime(ts, '%Y-%m-%d %H:00') hk, value v,
    row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) rn from events)
select t.event_id, strftime(dep_hour, '%Y-%m-%d %H:00') as dep_merge_key,
  round(d.v, 6) as dep_v, round(a.v, 6) as arr_v
from trips t
left join w d on d.rn = 1 and d.airport = t.dep and d.hk = strftime(dep_hour, '%Y-%m-%d %H:00')
left join w a on a.rn = 1 and a.airport = t.arr and a.hk = strftime(arr_hour, '%Y-%m-%d %H:00')""")
def string_key_join(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    w = e.select(F.col("event_type").alias("airport"), F.col("ts").alias("time"), F.col("value").alias("v"), "event_id")
    out = enrich.join_by_text_hour(tables.flights(spark, sf_dir), w, ["v", "event_id"], ["event_id"])
    return out.select("event_id", "dep_merge_key", r6("dep_v", "dep_v"), r6("arr_v", "arr_v"))


@query("nearest_weather", f"""
with {FLIGHTS}, {WEATHER_V},
c as (select event_id, w."time" t, v_avg, row_number() over (partition by event_id
        order by abs(epoch_us(w."time") - epoch_us(f.firstSeen)), w."time") rn
      from flights_v f join weather_v w on w.airport = f.arr)
select f.event_id, epoch_us(c.t) as near_time, round(c.v_avg, 6) as near_v_avg
from flights_v f left join c on c.event_id = f.event_id and c.rn = 1""")
def nearest_weather(spark, sf_dir):
    series = hourly(spark, sf_dir)
    probes = tables.flights(spark, sf_dir).select("event_id", F.col("estArrivalAirport").alias("airport"), "firstSeen")
    out = enrich.nearest_in_time(probes, series, ["airport"], "firstSeen", "time", ["v_avg"])
    return out.select("event_id", us("near_time"), r6("near_v_avg", "near_v_avg"))


@query("target_encode", f"""
with {FLIGHTS}, m as (
  select airline, quantile_cont(flight_duration, 0.9) v from sane where airline <> 'CLI' group by airline),
g as (select quantile_cont(flight_duration, 0.9) v from sane where airline <> 'CLI')
select event_id, round(coalesce(m.v, (select v from g)), 6) as encoded from sane left join m using (airline)""")
def target_encode(spark, sf_dir):
    rows = sane(spark, sf_dir)
    train = rows.where(F.col("airline") != "CLI")
    per, total = quantiles.quantiles_with_total(train, [], "airline", "flight_duration", [0.9])
    mapping = settle(per.select("airline", F.col("q")[0].alias("v")))
    fallback = total.select(F.col("q")[0].alias("v"))
    return enrich.encode(rows, mapping, fallback, [], "airline", "v", "encoded").select("event_id", r6("encoded", "encoded"))


@query("route_anomaly", f"""
with {FLIGHTS}, m as (select route, median(flight_duration) med from sane where firstSeen < timestamp '2024-01-20' group by route)
select event_id, round(flight_duration - med, 6) as anomaly from sane left join m using (route)""")
def route_anomaly(spark, sf_dir):
    rows = sane(spark, sf_dir)
    medians = plan.route_medians(rows.where(F.col("firstSeen") < F.lit("2024-01-20").cast("timestamp")), ["route"])
    return enrich.with_anomaly(rows, medians, ["route"]).select("event_id", r6("anomaly", "anomaly"))


@query("airport_lookup", """
with o as (select n_name airport, n_nationkey k, r_name region from nation join region on n_regionkey = r_regionkey where n_nationkey < 15),
d as (select n_name airport, n_nationkey + 100 k, r_name region from nation join region on n_regionkey = r_regionkey where n_nationkey >= 10)
select c_custkey, n_name as airport, cast(coalesce(o.k, d.k) as int) as k, coalesce(o.region, d.region) as region
from customer join nation on c_nationkey = n_nationkey
left join o on o.airport = n_name left join d on d.airport = n_name""")
def airport_lookup(spark, sf_dir):
    t = lambda name: tables.table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    facts = lambda shift: [F.col("n_name").alias("airport"), (F.col("n_nationkey") + shift).alias("k"), F.col("r_name").alias("region")]
    origins = places.where(F.col("n_nationkey") < 15).select(*facts(0))
    destinations = places.where(F.col("n_nationkey") >= 10).select(*facts(100))
    asked = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("airport"))
    return enrich.airport_info(asked, origins, destinations)


# --- aggregates -----------------------------------------------------------------

@query("baseline_quantiles", f"""
with {FLIGHTS}, m as (select route, median(flight_duration) med from sane group by route)
select route, airline, count(*) as n, round(any_value(med), 6) as route_median,
  round(quantile_cont(flight_duration - med, 0.5), 6) as p50,
  round(quantile_cont(flight_duration - med, 0.9), 6) as p90,
  round(quantile_cont(flight_duration - med, 0.95), 6) as p95
from sane join m using (route) group by route, airline""")
def baseline_quantiles(spark, sf_dir):
    out = plan.baseline_quantiles(sane(spark, sf_dir), ["route"])
    return out.select("route", "airline", "n", *[r6(c, c) for c in ("route_median", "p50", "p90", "p95")])


@query("carrier_baseline", f"""
with {FLIGHTS}, m as (select median(flight_duration) med from sane)
select airline, count(*) as n, round(quantile_cont(flight_duration - med, 0.5), 6) as p50,
  round(quantile_cont(flight_duration - med, 0.9), 6) as p90, round(quantile_cont(flight_duration - med, 0.95), 6) as p95
from sane, m group by airline""")
def carrier_baseline(spark, sf_dir):
    out = plan.baseline_quantiles(sane(spark, sf_dir), [])
    return out.select("airline", "n", *[r6(c, c) for c in ("p50", "p90", "p95")])


@query("route_median", f"with {FLIGHTS} select route, count(*) as n, round(median(flight_duration), 6) as route_median from sane group by route")
def route_median(spark, sf_dir):
    out = quantiles.medians(sane(spark, sf_dir), ["route"], "flight_duration", "route_median")
    return out.select("route", "n", r6("route_median", "route_median"))


@query("airline_quantiles", f"""
with {HISTORY}
select airline, round(quantile_cont(flight_duration, 0.5), 6) as p50, round(quantile_cont(flight_duration, 0.9), 6) as p90,
  round(quantile_cont(l_extendedprice, 0.95), 6) as price95 from history_v group by airline
union all select 'fallback', round(quantile_cont(flight_duration, 0.5), 6), round(quantile_cont(flight_duration, 0.9), 6),
  round(quantile_cont(l_extendedprice, 0.95), 6) from history_v""")
def airline_quantiles(spark, sf_dir):
    h = tables.stored_history(spark, sf_dir, "airline", "flight_duration", "l_extendedprice")
    days, all_days = quantiles.quantiles_with_total(h, [], "airline", "flight_duration", [0.5, 0.9])
    prices, all_prices = quantiles.quantiles_with_total(h, [], "airline", "l_extendedprice", [0.95])
    per = days.select("airline", "q").join(prices.select("airline", F.col("q").alias("price")), "airline")
    overall = all_days.select(F.lit("fallback").alias("airline"), "q", all_prices.select("q").scalar().alias("price"))
    return per.unionByName(overall).select(
        "airline", r6(F.col("q")[0], "p50"), r6(F.col("q")[1], "p90"), r6(F.col("price")[0], "price95")
    )


@query("flights_per_airline", """
select case when event_id % 11 = 0 then null else event_type end as airline, count(*) as n from events group by 1""")
def flights_per_airline(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return profile.value_counts(e.select(F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("airline")), "airline")


@query("eligible_carriers", f"with {FLIGHTS} select route, airline, count(*) as n from sane group by all having count(*) >= 50")
def eligible_carriers(spark, sf_dir):
    return profile.eligible_carriers(sane(spark, sf_dir), ["route"], 50)


@query("complete_years", f"""
with {HISTORY}, y as (
  select airline, year(firstSeen) y, min(month(firstSeen)) a, max(month(firstSeen)) b from history_v group by 1, 2)
select airline, cast(y as int) as "year" from y where a = 1 and b = 12""")
def complete_years(spark, sf_dir):
    return split.complete_years(tables.history(spark, sf_dir), ["airline"])


@query("impute_medians", f"""
with {HISTORY}
select 'flight_duration' as "column", round(median(flight_duration), 6) as median from history_v union all
select 'l_extendedprice', round(median(l_extendedprice), 6) from history_v union all
select 'l_discount', round(median(case when l_discount > 0.02 then l_discount end), 6) from history_v""")
def impute_medians(spark, sf_dir):
    h = tables.stored_history(spark, sf_dir, "flight_duration", "l_extendedprice", "l_discount").select(
        "flight_duration", "l_extendedprice", F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("l_discount"),
        F.lit(None).cast("double").alias("never_filled"),
    )
    return quantiles.column_medians(h, [], h.columns).select("column", r6("median", "median"))


NULLY = """n as (select case when event_id % 3 = 0 then null else value end a, case when event_id % 8 = 0 then null else event_type end b, ts c from events)"""


def nully(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(F.when(k % 3 != 0, F.col("value")).alias("a"), F.when(k % 8 != 0, F.col("event_type")).alias("b"), F.col("ts").alias("c"))


@query("null_rates", f"""
with {NULLY}
select 'a' as "column", round(100 * avg(case when a is null then 1 else 0 end), 1) as null_pct from n
union all select 'b', round(100 * avg(case when b is null then 1 else 0 end), 1) from n""")
def null_rates(spark, sf_dir):
    return profile.null_rates_sorted(nully(spark, sf_dir))


@query("pct_complete", f"""
with {JOINED}
select round(100 * avg(case when dep_ok then 1 else 0 end), 1) as pct_departure,
  round(100 * avg(case when arr_ok then 1 else 0 end), 1) as pct_arrival from joined""")
def pct_complete(spark, sf_dir):
    return joined(spark, sf_dir).agg(
        profile.pct_complete(DEP_WEATHER).alias("pct_departure"), profile.pct_complete(ARR_WEATHER).alias("pct_arrival")
    )


def _describe(c: str) -> str:
    return (
        f"""select '{c}' as "column", count({c}) as "count", round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
        round(min({c}), 6) as "min", round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50,
        round(quantile_cont({c}, 0.75), 6) as p75, round(max({c}), 6) as "max" from lineitem"""
    )


@query("describe_numeric", " union all ".join(_describe(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_numeric(spark, sf_dir):
    out = profile.describe_numeric(tables.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("column", "count", *[r6(c, c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query("typical_row", f"""
with {JOINED}, h as (
  select route, hour(firstSeen) h, row_number() over (partition by route order by count(*) desc, hour(firstSeen)) rn
  from joined group by route, hour(firstSeen))
select j.route, round(avg(dep_avg), 6) as dep_temperature_2m, round(avg(arr_avg), 6) as arr_temperature_2m,
  cast(any_value(h.h) as int) as hour_of_day
from joined j join h on h.route = j.route and h.rn = 1 group by j.route""")
def typical_row(spark, sf_dir):
    columns = ["dep_temperature_2m", "arr_temperature_2m"]
    return profile.typical_row(joined(spark, sf_dir), columns).select("route", *[r6(c, c) for c in columns], "hour_of_day")


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_linenumber"]


def _pairs(columns):
    return " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from lineitem" for a, b in combinations(columns, 2))


@query("corr_matrix", f"""
with p as ({_pairs(CORR)})
select a, b, round(r, 6) as r from p union all select b, a, round(r, 6) from p
union all select c, c, 1.0 from (values {', '.join(f"('{c}')" for c in CORR)}) t(c)""")
def corr_matrix(spark, sf_dir):
    out = profile.correlation_matrix(tables.table(spark, sf_dir, "lineitem"), CORR)
    return out.select("a", "b", r6("r", "r"))


@query("top_correlations", f"""
with p as ({_pairs(CORR)})
(select 'positive' as kind, round(r, 6) as r from p where r > 0 order by p.r desc limit 10)
union all (select 'negative', round(r, 6) from p where r < 0 order by p.r limit 10)""")
def top_correlations(spark, sf_dir):
    pairs = profile.correlations(tables.table(spark, sf_dir, "lineitem"), CORR)
    return profile.top_correlations(pairs, 10).select("kind", r6("r", "r"))


def _histogram_sql(group: str, bins: int) -> str:
    return f"""
with {HISTORY}, m as (select median(flight_duration) med from history_v),
v as (select cast({group}(firstSeen) as int) g, sign(x) * ln(1 + abs(x)) v
      from (select firstSeen, greatest(-60.0, least(60.0, flight_duration - med)) x from history_v, m)),
e as (select g, min(v) lo, max(v) hi from v group by g)
select v.g as grp, cast(case when lo = hi then 1 else least(floor({bins} * (v.v - lo) / (hi - lo)) + 1, {bins}) end as int) as bin,
  count(*) as n, round(any_value(lo), 6) as low, round(any_value(hi), 6) as high
from v join e using (g) group by 1, 2"""


def transformed(spark, sf_dir):
    h = tables.stored_history(spark, sf_dir, "firstSeen", "flight_duration")
    middle = quantiles.medians(h, [], "flight_duration", "med").select("med").scalar()
    anomaly = F.col("flight_duration") - middle
    return h.withColumn("anomaly", anomaly).withColumn("v", numbers.signed_log(numbers.clip(F.col("anomaly"), -60, 60)))


@query("histogram_by_month", _histogram_sql("month", 50))
def histogram_by_month(spark, sf_dir):
    rows = transformed(spark, sf_dir).withColumn("grp", F.month("firstSeen"))
    return profile.histogram(rows, ["grp"], "v", 50).select("grp", "bin", "n", r6("low", "low"), r6("high", "high"))


@query("histogram_by_hour", f"""
with {FLIGHTS}, m as (select median(flight_duration) med from sane),
v as (select printf('%02d:00', cast(hour(firstSeen) as int)) g, sign(x) * ln(1 + abs(x)) v
      from (select firstSeen, greatest(-60.0, least(60.0, flight_duration - med)) x from sane, m)),
e as (select g, min(v) lo, max(v) hi from v group by g)
select v.g as hour, cast(case when lo = hi then 1 else least(floor(50 * (v.v - lo) / (hi - lo)) + 1, 50) end as int) as bin, count(*) as n
from v join e using (g) group by 1, 2""")
def histogram_by_hour(spark, sf_dir):
    rows = sane(spark, sf_dir)
    middle = quantiles.medians(rows, [], "flight_duration", "med").select("med").scalar()
    anomaly = rows.select(times.hour_label(F.col("hour_of_day")).alias("hour"), (F.col("flight_duration") - middle).alias("a"))
    values = anomaly.select("hour", numbers.signed_log(numbers.clip(F.col("a"), -60, 60)).alias("v"))
    return profile.histogram(values, ["hour"], "v", 50).select("hour", "bin", "n")


@query("histogram_all", """
with e as (select min(value) lo, max(value) hi from events)
select cast(least(floor((value - lo) / ((hi - lo) / 100.0)) + 1, 100) as int) as bin, count(*) as n,
  round(any_value(lo), 6) as low, round(any_value(hi), 6) as high from events, e group by 1""")
def histogram_all(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return profile.histogram(e, [], "value", 100).select("bin", "n", r6("low", "low"), r6("high", "high"))


@query("qcut_bins", """
with q as (select quantile_cont(value, [1/6.0, 2/6.0, 3/6.0, 4/6.0, 5/6.0]) e from events)
select event_id, cast((value > e[1])::int + (value > e[2])::int + (value > e[3])::int + (value > e[4])::int + (value > e[5])::int as int) as bin,
  cast(null as double) as raw from events, q""")
def qcut_bins(spark, sf_dir):
    return quantiles.qcut(tables.table(spark, sf_dir, "events"), "value").select("event_id", "bin", "raw")


@query("qcut_few_values", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(null as int) as bin, round(l_tax, 6) as raw from lineitem")
def qcut_few_values(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    return quantiles.qcut(li, "l_tax").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "bin", r6("raw", "raw"))


# --- de-duplication ---------------------------------------------------------------

@query("dedup_keep_first", """
with u as (select 0 src, * from lineitem where l_returnflag = 'A' union all select 1, * from lineitem),
r as (select *, row_number() over (partition by l_orderkey, l_linenumber
  order by src, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) rn from u)
select l_orderkey, l_linenumber, src, l_partkey, l_suppkey, round(l_extendedprice, 6) as l_extendedprice from r where rn = 1""")
def dedup_keep_first(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    stored = li.where(F.col("l_returnflag") == "A").withColumn("src", F.lit(0))
    tiebreak = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    merged = clean.merge_keep_first(stored, li.withColumn("src", F.lit(1)), ["l_orderkey", "l_linenumber"], tiebreak)
    return merged.select("l_orderkey", "l_linenumber", "src", "l_partkey", "l_suppkey", r6("l_extendedprice", "l_extendedprice"))


@query("dedup_append_new", """
with s as (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag = 'A'),
r as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_extendedprice) rn from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey from r
where rn = 1 and not exists (select 1 from s where s.l_orderkey = r.l_orderkey and s.l_linenumber = r.l_linenumber)""")
def dedup_append_new(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    stored = li.where(F.col("l_returnflag") == "A")
    new = clean.append_new(stored, li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"])
    return new.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("weather_dedup", """
with r as (select event_type airport, date_trunc('hour', ts) t, value, event_id,
  row_number() over (partition by event_type, date_trunc('hour', ts) order by case when event_id % 2 = 0 then 0 else 1 end, event_id) rn from events)
select airport, epoch_us(t) as "time", round(value, 6) as v, event_id from r where rn = 1""")
def weather_dedup(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("airport"), F.date_trunc("hour", "ts").alias("time"), F.col("value").alias("v"), "event_id"
    )
    even = F.col("event_id") % 2 == 0
    merged = clean.merge_weather(e.where(even), e.where(~even), ["event_id"])
    return merged.orderBy("time", "airport").select("airport", us("time"), r6("v", "v"), "event_id")


# --- feature table ------------------------------------------------------------------

@query("feature_matrix", f"""
with {JOINED}
select event_id, icao24, epoch_us(firstSeen) as firstSeen, route, airline, round(flight_duration, 6) as flight_duration,
  epoch_us(dep_hour) as dep_merge_key, round(dep_avg, 6) as dep_temperature_2m, round(arr_avg, 6) as arr_temperature_2m,
  round(dep_avg * 100, 6) as dep_visibility, cast(hour(firstSeen) as int) as hour_of_day,
  cast(cast(firstSeen as date) as varchar) as flight_date_parsed, 53 as n_columns
from joined where dep_ok and arr_ok""")
def feature_matrix(spark, sf_dir):
    table = gates.passing(joined(spark, sf_dir), gates.final_row_gates())
    return table.select(
        event_id(), "icao24", us("firstSeen"), "route", "airline", r6("flight_duration", "flight_duration"),
        us("dep_merge_key"), r6("dep_temperature_2m", "dep_temperature_2m"), r6("arr_temperature_2m", "arr_temperature_2m"),
        r6("dep_visibility", "dep_visibility"), "hour_of_day", day("flight_date_parsed"),
        F.lit(len(table.columns)).alias("n_columns"),
    )


@query("feature_gate_report", f"""
with {FLIGHTS}, {WEATHER_V},
j as (
  select t.*, coalesce(wd.v_n, 0) > 1 and coalesce(wa.v_n, 0) > 1 as complete
  from trips t left join weather_v wd on wd.airport = t.dep and wd."time" = t.dep_hour
  left join weather_v wa on wa.airport = t.arr and wa."time" = t.arr_hour),
c as (select count(*) n from j group by icao24, firstSeen, lastSeen, dep, arr having count(*) > 1)
select 'firstSeen_parsed' as gate, count(*) filter (where firstSeen is null) as n_bad from j
union all select 'lastSeen_parsed', count(*) filter (where lastSeen is null) from j
union all select 'time_order', count(*) filter (where lastSeen <= firstSeen) from j
union all select 'duplicates', cast(coalesce(sum(n), 0) as bigint) from c
union all select 'weather_key', 0
union all select 'not_null', count(*) filter (where airline is null or callsign is null or dep is null) from j
union all select 'weather_complete', count(*) filter (where not complete) from j
union all select 'duration_finite', count(*) filter (where flight_duration is null) from j
union all select 'duration_positive', count(*) filter (where flight_duration <= 0) from j
union all select 'join_fanout', 0""")
def feature_gate_report(spark, sf_dir):
    """The gated build of all flights, sane or not: what each gate would stop it for."""
    return plan.stage_feature_matrix(tables.raw_flights(spark, sf_dir), tables.weather(spark, sf_dir)).gate_report()


# --- metrics ------------------------------------------------------------------------

SCORED = f"""{FLIGHTS},
b as (select airline, unnest([0.5, 0.9, 0.95]::double[]) q, unnest(quantile_cont(flight_duration, [0.5, 0.9, 0.95])) p
      from sane where firstSeen < timestamp '2024-01-20' group by airline),
scored as (select s.airline, b.q as quantile, s.flight_duration y, b.p as prediction, s.event_id
           from sane s join b using (airline) where firstSeen >= timestamp '2024-01-20')
"""


def scored(spark, sf_dir):
    """Later flights scored with the carrier quantiles of earlier ones."""
    rows = sane(spark, sf_dir)
    cut = F.lit("2024-01-20").cast("timestamp")
    fitted = quantiles.exact_quantiles(rows.where(F.col("firstSeen") < cut), ["airline"], "flight_duration", plan.QUANTILES)
    qs = F.array(*[F.lit(q) for q in plan.QUANTILES])
    per_q = settle(fitted.select("airline", F.inline(F.arrays_zip(qs.alias("quantile"), F.col("q").alias("prediction")))))
    later = rows.where(F.col("firstSeen") >= cut).select("event_id", "airline", F.col("flight_duration").alias("y"))
    return later.join(per_q, "airline")


@query("pinball", f"""
with {SCORED}
select airline, quantile,
  round(round(avg(greatest(quantile * (y - prediction), (quantile - 1) * (y - prediction))), 9), 6) as pinball_loss
from scored group by airline, quantile""")
def pinball(spark, sf_dir):
    loss = metrics.pinball_loss(F.col("y"), F.col("prediction"), F.col("quantile"))
    return scored(spark, sf_dir).groupBy("airline", "quantile").agg(loss.alias("pinball_loss")).select(
        "airline", "quantile", r96("pinball_loss")
    )


@query("coverage", f"""
with {SCORED}
select airline, quantile, round(abs(avg(case when y <= prediction then 1.0 else 0.0 end) - quantile), 6) as coverage_error
from scored group by airline, quantile""")
def coverage(spark, sf_dir):
    error = metrics.coverage_error(F.col("y"), F.col("prediction"), F.col("quantile"))
    return scored(spark, sf_dir).groupBy("airline", "quantile").agg(r6(error, "coverage_error"))


METRICS_SQL = """
select {keys}, count(*) as n_eval,
  round(round(avg(greatest(quantile * (y - prediction), (quantile - 1) * (y - prediction))), 9), 6) as pinball_loss,
  round(round(abs(avg((y <= prediction)::int) - quantile), 9), 6) as coverage_error,
  round(round(abs(avg((y <= prediction)::int) - quantile), 9), 6) as coverage_penalty,
  round(round(avg(greatest(quantile * (y - prediction), (quantile - 1) * (y - prediction)))
    + 10 * abs(avg((y <= prediction)::int) - quantile), 9), 6) as tuning_score,
  round(round(avg(abs(prediction - y)), 9), 6) as mae, round(round(median(abs(prediction - y)), 9), 6) as medae,
  round(round(sqrt(avg((prediction - y) ** 2)), 9), 6) as rmse, round(round(avg(prediction - y), 9), 6) as mean_error,
  round(round(100 * avg((y <= prediction)::int), 9), 6) as empirical_coverage_pct, round(round(100 * quantile, 9), 6) as target_coverage_pct,
  round(round(100 * (avg((y <= prediction)::int) - quantile), 9), 6) as coverage_gap_pct
from {source} group by {keys}"""


@query("metric_bundle", f"with {SCORED} {METRICS_SQL.format(keys='airline, quantile', source='scored')}")
def metric_bundle(spark, sf_dir):
    out = metrics.metric_bundle(scored(spark, sf_dir), ["airline", "quantile"])
    return out.select("airline", "quantile", "n_eval", *[r96(c) for c in metrics.BUNDLE])


@query("fold_score", f"""
with {SCORED}, f as (
  select quantile, airline, avg(greatest(quantile * (y - prediction), (quantile - 1) * (y - prediction))) l,
    abs(avg((y <= prediction)::int) - quantile) c from scored group by quantile, airline)
select quantile, count(*) as n_folds, round(avg(l), 6) as mean_pinball_loss, round(avg(c), 6) as mean_coverage_error,
  round(stddev_pop(c), 6) as fold_coverage_error_std, round(avg(l) + 10 * avg(c) + 10 * stddev_pop(c), 6) as score
from f group by quantile""")
def fold_score(spark, sf_dir):
    # carriers stand in for folds
    folds = metrics.metric_bundle(scored(spark, sf_dir), ["airline", "quantile"])
    out = metrics.fold_balanced_score(folds, ["quantile"])
    return out.select("quantile", "n_folds", *[r6(c, c) for c in ("mean_pinball_loss", "mean_coverage_error", "fold_coverage_error_std", "score")])


@query("best_candidate", f"""
with {SCORED}, s as (select quantile, airline candidate,
  avg(greatest(quantile * (y - prediction), (quantile - 1) * (y - prediction))) + 10 * abs(avg((y <= prediction)::int) - quantile) score
  from scored group by quantile, airline),
r as (select *, row_number() over (partition by quantile order by score, candidate) rn from s)
select quantile, candidate, round(score, 6) as score from r where rn = 1""")
def best_candidate(spark, sf_dir):
    m = metrics.metric_bundle(scored(spark, sf_dir), ["airline", "quantile"])
    scores = m.select("quantile", F.col("airline").alias("candidate"), F.col("tuning_score").alias("score"))
    return metrics.best_candidate(scores, ["quantile"]).select("quantile", "candidate", r6("score", "score"))
