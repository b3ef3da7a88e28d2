"""Driver queries: distributed quantile models. Checked by rows and by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroquant.operators import clean
from aeroquant.operators.boost import Params, sample_candidates
from aeroquant.plans import training
from aeroquant.plans.registry import HISTORY, query
from aeroquant.schemas import ARR_WEATHER, DEP_WEATHER
from aeroquant.sources import sinks, tables


def training_rows(spark, sf_dir):
    """Trips of several years with stand-in weather columns from the line items."""
    measures = ["l_quantity", "l_discount", "l_extendedprice"]
    h = tables.stored_history(spark, sf_dir, *tables.HISTORY_ORDER, "flight_duration", "airline", "route", *measures)
    facts = [F.col(c) for c in measures]
    filled = {}
    for i, c in enumerate(DEP_WEATHER + ARR_WEATHER):
        value = facts[i % 3].cast("double") * (i + 1)
        filled[c] = F.when(F.col("l_orderkey") % (i + 5) != 0, value)
    rows = h.withColumns({**filled, "hour_of_day": F.col("l_linenumber") * 3, "month": F.month("firstSeen")})
    return clean.drop_outliers(rows)


def train(spark, sf_dir, fits, qs=training.QUANTILES, params=Params()):
    return training.train_tiers(training_rows(spark, sf_dir), tables.HISTORY_ORDER, qs, params, fits, min_rows=500)


@query("quantile_model")
def quantile_model(spark, sf_dir):
    run = train(spark, sf_dir, ["production"])
    return run.model.feature_importance().drop("fit")


@query("holdout_eval")
def holdout_eval(spark, sf_dir):
    return train(spark, sf_dir, ["holdout"]).holdout()


@query("walkforward_eval")
def walkforward_eval(spark, sf_dir):
    return train(spark, sf_dir, ["folds"]).backtest_score()


@query("score_batch")
def score_batch(spark, sf_dir):
    run = train(spark, sf_dir, ["production"])
    requests = training_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "route", "airline",
                                                   *DEP_WEATHER, *ARR_WEATHER, "hour_of_day", "month")
    return run.score(requests).select("l_orderkey", "l_linenumber", "l_partkey", "tier", "quantile", "anomaly", "total")


@query("tune_candidates")
def tune_candidates(spark, sf_dir):
    return training.tune_tiers(training_rows(spark, sf_dir), tables.HISTORY_ORDER, sample_candidates(2), min_rows=500)


@query("manifest_flatten", f"""
with {HISTORY}, t as (
  select airline as tier, count(*) n from history_v group by 1 union all select 'all_carriers', count(*) from history_v)
select 'ALL' as route, tier, q as quantile, 'models/ALL/' || tier || '/models' as model_path,
  'models/ALL/' || tier || '/preprocessing' as preprocessing_path
from t, (select unnest([0.5, 0.9, 0.95]::double[]) q) where n >= 6300""")
def manifest_flatten(spark, sf_dir):
    rows = training.tiered(tables.history(spark, sf_dir))
    levels = F.array(*[F.lit(q) for q in training.QUANTILES])
    long = rows.groupBy("route", "tier").agg(F.count("*").alias("n_rows")).withColumns({
        "trained": F.col("n_rows") >= 6300, "reason": F.lit(None).cast("string"),
    }).withColumn("quantile", F.explode(levels))
    return sinks.flatten_manifest(training.nested_manifest(long, "models"))
