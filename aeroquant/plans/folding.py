"""Driver queries: splits, folds, leakage-free targets, tier planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroquant.operators import enrich, folds, metrics, preprocess, split
from aeroquant.plans import features as plan
from aeroquant.plans import training
from aeroquant.plans.analysis import METRICS_SQL
from aeroquant.plans.basics import sane
from aeroquant.plans.registry import FLIGHTS, HISTORY, HISTORY_ORDER_SQL, query, r6, r96, us
from aeroquant.session import cut_lineage, settle
from aeroquant.sources import tables

K = 3  # folds of the fixed-fold queries
ROW = ["l_orderkey", "l_linenumber", "l_partkey"]

SEGMENTS = f"""{HISTORY},
numbered as (
  select *, row_number() over (partition by airline order by {HISTORY_ORDER_SQL}) - 1 rn, count(*) over (partition by airline) n
  from history_v),
seg as (select *, cast(greatest(0, (rn - (n - {K} * (n // {K + 1}))) // (n // {K + 1}) + 1) as int) segment from numbered
        where rn >= n - {K} * (n // {K + 1}) union all
        select *, 0 from numbered where rn < n - {K} * (n // {K + 1})),
foldrows as (select seg.*, f.fold, case when segment = f.fold then 'test' else 'train' end role
  from seg, (select unnest(range(1, {K + 1})) fold) f where segment <= f.fold)
"""


def segmented(spark, sf_dir, *columns, key="airline"):
    """Columns of the history with the segment of each row in its population."""
    h = tables.stored_history(spark, sf_dir)  # ties are ranked by all columns
    k = settle(h.select(key).distinct().withColumn("n_folds", F.lit(K)))
    return split.fold_segments(h, [key], tables.HISTORY_ORDER, k).select(key, *columns, "segment", "n_folds")


@query("chrono_split", f"""
with {FLIGHTS}, r as (select *, row_number() over (partition by route order by firstSeen, icao24, lastSeen, callsign, dep, arr) rn,
  count(*) over (partition by route) n from sane)
select event_id, route, case when rn <= (n * 4) // 5 then 'train' else 'test' end as role from r""")
def chrono_split(spark, sf_dir):
    rows = sane(spark, sf_dir)
    return split.chronological_split(rows, ["route"], tables.FLIGHT_ORDER).select("event_id", "route", "role")


@query("walkforward_folds", f"""
with {SEGMENTS}
select airline, cast(fold as int) as fold, count(*) filter (role = 'train') as n_train, count(*) filter (role = 'test') as n_test,
  epoch_us(min(firstSeen) filter (role = 'train')) as train_start, epoch_us(max(firstSeen) filter (role = 'train')) as train_end,
  epoch_us(min(firstSeen) filter (role = 'test')) as test_start, epoch_us(max(firstSeen) filter (role = 'test')) as test_end,
  date_diff('day', min(firstSeen) filter (role = 'train'), max(firstSeen) filter (role = 'train')) as days_trained
from foldrows group by airline, fold""")
def walkforward_folds(spark, sf_dir):
    spans = folds.fold_spans(segmented(spark, sf_dir, "firstSeen"), ["airline"])
    return spans.select("airline", "fold", "n_train", "n_test", *[us(c) for c in ("train_start", "train_end", "test_start", "test_end")],
                        F.col("days_trained").cast("bigint").alias("days_trained"))


@query("fold_roles", f"""
with {SEGMENTS} select l_orderkey, l_linenumber, l_partkey, airline, cast(fold as int) as fold, role from foldrows""")
def fold_roles(spark, sf_dir):
    return split.expand_folds(segmented(spark, sf_dir, *ROW)).select(*ROW, "airline", "fold", "role")


@query("fold_anomaly", f"""
with {SEGMENTS}, m as (select airline, fold, median(flight_duration) med from foldrows where role = 'train' group by airline, fold)
select l_orderkey, l_linenumber, l_partkey, airline, cast(fold as int) as fold, role, round(flight_duration - med, 6) as y
from foldrows join m using (airline, fold)""")
def fold_anomaly(spark, sf_dir):
    s = cut_lineage(segmented(spark, sf_dir, *ROW, "flight_duration"))  # read by several branches, so cut once
    medians = folds.train_medians(s, ["airline"], "flight_duration")
    out = enrich.with_anomaly(split.expand_folds(s), medians, ["airline", "fold"], "train_median")
    return out.select(*ROW, "airline", "fold", "role", r6("anomaly", "y"))


@query("fold_target_encode", f"""
with {HISTORY},
numbered as (select *, row_number() over (order by {HISTORY_ORDER_SQL}) - 1 rn, count(*) over () n from history_v),
f as (select unnest(range(1, {K + 1})) fold),
r as (select numbered.*, f.fold, case when rn < n - ({K} - f.fold + 1) * (n // {K + 1}) then 'train' else 'test' end role
  from numbered, f where rn < n - ({K} - f.fold) * (n // {K + 1})),
med as (select fold, median(flight_duration) med from r where role = 'train' group by fold),
y as (select r.*, flight_duration - med y from r join med using (fold)),
m as (select fold, airline, quantile_cont(y, 0.9) v from y where role = 'train' and airline <> '5-LOW' group by fold, airline),
g as (select fold, quantile_cont(y, 0.9) v from y where role = 'train' and airline <> '5-LOW' group by fold)
select cast(y.fold as int) as fold, airline, role, count(*) as n, round(sum(coalesce(m.v, g.v)), 4) as sum_encoded, round(max(coalesce(m.v, g.v)), 6) as encoded
from y left join m using (fold, airline) join g on g.fold = y.fold group by y.fold, airline, role""")
def fold_target_encode(spark, sf_dir):
    s = cut_lineage(segmented(spark, sf_dir, "airline", "flight_duration", key="route"))
    medians = folds.train_medians(s, ["route"], "flight_duration")
    rows = enrich.with_anomaly(split.expand_folds(s), medians, ["route", "fold"], "train_median")
    train = rows.where((F.col("role") == "train") & (F.col("airline") != "5-LOW"))
    mapping, fallback = preprocess.fit_encoding(train, ["route", "fold"], "anomaly", [0.9])
    coded = enrich.encode(rows, mapping, fallback, ["route", "fold"], "airline", "value", "encoded")
    return coded.groupBy("fold", "airline", "role").agg(
        F.count("*").alias("n"), F.round(F.sum("encoded"), 4).alias("sum_encoded"), r6(F.max("encoded"), "encoded")
    )


@query("walkforward_baseline", f"""
with {SEGMENTS}, m as (select airline, fold, median(flight_duration) med from foldrows where role = 'train' group by airline, fold),
y as (select foldrows.*, flight_duration - med y from foldrows join m using (airline, fold)),
p as (select airline, fold, unnest([0.5, 0.9, 0.95]::double[]) quantile, unnest(quantile_cont(y, [0.5, 0.9, 0.95])) prediction
      from y where role = 'train' group by airline, fold),
t as (select y.airline, cast(y.fold as int) fold, p.quantile, y.y, p.prediction from y join p on p.airline = y.airline and p.fold = y.fold where role = 'test')
{METRICS_SQL.format(keys='airline, fold, quantile', source='t')}""")
def walkforward_baseline(spark, sf_dir):
    s = cut_lineage(segmented(spark, sf_dir, "flight_duration"))
    out = training.walkforward_baseline(s, ["airline"], plan.QUANTILES)
    return out.select("airline", "fold", "quantile", "n_eval", *[r96(c) for c in metrics.BUNDLE])


@query("preprocess_apply", f"""
with {HISTORY},
v as (select *, case when l_orderkey % 7 = 0 then null else l_extendedprice end price, row_number() over (order by {HISTORY_ORDER_SQL}) rn, count(*) over () n from history_v),
t as (select *, case when rn <= (n * 4) // 5 then 'train' else 'test' end role from v),
med as (select median(flight_duration) med, median(price) price_med from t where role = 'train'),
m as (select airline, quantile_cont(flight_duration - med, 0.9) v from t, med where role = 'train' group by airline)
select l_orderkey, l_linenumber, l_partkey, l_quantity, role, round(flight_duration - med, 6) as y,
  round(coalesce(price, price_med), 6) as price, round(m.v, 6) as airline_encoded
from t join m using (airline), med""")
def preprocess_apply(spark, sf_dir):
    kept = [*ROW, "l_quantity", "price", "route", "airline", "flight_duration"]
    h = tables.stored_history(spark, sf_dir).withColumn("price", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")))
    rows = cut_lineage(split.chronological_split(h, ["route"], tables.HISTORY_ORDER).select(*kept, "role"))
    is_train = F.col("role") == "train"
    rows = enrich.with_anomaly(rows, plan.route_medians(rows.where(is_train), ["route"]), ["route"])
    fitted = preprocess.fit_preprocessor(rows.where(is_train), ["route"], ["price"], "anomaly", [0.9])
    out = fitted.apply(rows.withColumn("quantile", F.lit(0.9)))
    return out.select(*ROW, "l_quantity", "role", r6("anomaly", "y"), r6("price", "price"), r6("airline_encoded", "airline_encoded"))


@query("tier_report", f"""
with {HISTORY}, c as (select route, airline, count(*) n from history_v group by 1, 2),
r as (select *, row_number() over (partition by route, airline order by {HISTORY_ORDER_SQL}) rn, count(*) over (partition by route, airline) n from history_v),
y as (select route, airline, year(firstSeen) y from r where rn <= (n * 4) // 5 group by 1, 2, 3 having min(month(firstSeen)) = 1 and max(month(firstSeen)) = 12),
k as (select c.*, (select count(*) from y where y.route = c.route and y.airline = c.airline) n_folds from c)
select route, airline as tier, n as n_rows, case when n >= 6300 then n_folds else 0 end as n_folds, n >= 6300 and n_folds >= 2 as trained,
  case when n < 6300 then 'Only ' || n || ' flights; a dedicated model requires 6300.'
       when n_folds < 2 then 'Only ' || n_folds || ' complete calendar year(s); at least 2 are required.' end as reason
from k""")
def tier_report(spark, sf_dir):
    h = tables.stored_history(spark, sf_dir, "route", "airline", *tables.HISTORY_ORDER)
    report = training.tier_report(h, tables.HISTORY_ORDER, 6300)
    return report.where(F.col("tier") != training.POOLED).select("route", "tier", "n_rows", "n_folds", "trained", "reason")


@query("tier_select", f"""
with {FLIGHTS}, t as (select route, airline from sane group by all having count(*) >= 330)
select event_id, coalesce(t.airline, 'all_carriers') as tier, t.airline is null as is_fallback
from sane s left join t on t.route = s.route and t.airline = s.airline""")
def tier_select(spark, sf_dir):
    rows = sane(spark, sf_dir)
    own = rows.groupBy("route", "airline").agg(F.count("*").alias("n")).where(F.col("n") >= 330).select("route", F.col("airline").alias("tier"))
    trained = own.unionByName(rows.select("route").distinct().withColumn("tier", F.lit(training.POOLED)))
    return enrich.select_tier(rows, trained).select("event_id", "tier", "is_fallback")
