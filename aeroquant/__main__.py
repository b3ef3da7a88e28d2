"""Jobs for spark-submit: features, baseline, train, score, update."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import functions as F

from aeroquant.operators.boost import Params, sample_candidates
from aeroquant.plans import features, scoring, training, update
from aeroquant.schemas import FEATURE_SCHEMA, FLIGHT_KEY, FLIGHT_SCHEMA, WEATHER_SCHEMA
from aeroquant.session import build_session, cut_lineage, run_scope
from aeroquant.sources import landed, sinks

TRIALS = 40  # fixed value
ORDER = [*FLIGHT_KEY[:1], *FLIGHT_KEY[2:]]


def feature_rows(spark, path):
    rows = features.training_rows(landed.read_table(spark, path, FEATURE_SCHEMA))
    return features.check_training_rows(rows)


def run_features(spark, a):
    flights = landed.read_table(spark, a.flights, FLIGHT_SCHEMA)
    table = features.checked_feature_matrix(flights, landed.read_table(spark, a.weather, WEATHER_SCHEMA))
    features.write_features(table, a.out)
    if a.stats:
        sinks.record_stage_stats(landed.read_table(spark, a.out, FEATURE_SCHEMA), "3_build_features", a.stats, ["firstSeen", "icao24"])


def run_baseline(spark, a):
    sinks.replace_table(features.baseline_quantiles(feature_rows(spark, a.features), ["route"]), a.out)


def run_train(spark, a):
    rows, order = feature_rows(spark, a.features), ["firstSeen", *ORDER]
    candidates = chosen = None
    if a.tune:
        candidates = sample_candidates(a.trials)
        chosen = training.tune_tiers(rows, order, candidates)
        training.append_tuning_history(chosen, f"{a.out}/tuning_history", candidates)
        chosen = chosen.select("route", "tier", "quantile", "candidate")
    run = training.train_tiers(rows, order, params=Params(), candidates=candidates, chosen=chosen)
    run.save(a.out)
    manifest = cut_lineage(run.manifest())
    sinks.replace_table(manifest, f"{a.out}/manifest")
    sinks.replace_table(run.fold_report(), f"{a.out}/backtest")
    # one document per route, as the dashboard reads it
    training.nested_manifest(manifest, a.out).write.mode("overwrite").json(f"{a.out}/manifest_json")


def run_score(spark, a):
    run = training.TrainedTiers.load(spark, a.models)
    requests = spark.read.parquet(a.requests)
    forecast = landed.read_table(spark, a.weather, WEATHER_SCHEMA)
    sinks.replace_table(scoring.score_requests(run, requests, forecast), a.out)


def run_update(spark, a):
    routes = spark.read.schema("origin string, destination string").parquet(a.routes)
    now = datetime.fromisoformat(a.now).replace(tzinfo=timezone.utc) if a.now else None
    run = update.update_all(spark, routes, a.out, a.arrivals, a.weather, now, a.force)
    print("update: " + ", ".join(f"{v} {k}" for k, v in run.summary().first().asDict().items()))


JOBS = {
    "features": (run_features, ["flights", "weather", "out"], ["stats"]),
    "baseline": (run_baseline, ["features", "out"], []),
    "train": (run_train, ["features", "out"], []),
    "score": (run_score, ["models", "requests", "weather", "out"], []),
    "update": (run_update, ["routes", "out"], ["arrivals", "weather", "now"]),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="aeroquant")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, (_, needed, optional) in JOBS.items():
        job = jobs.add_parser(name)
        for option in needed:
            job.add_argument(f"--{option}", required=True)
        for option in optional:
            job.add_argument(f"--{option}")
        if name == "train":
            job.add_argument("--tune", action="store_true")
            job.add_argument("--trials", type=int, default=TRIALS)
        if name == "update":
            job.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    spark = build_session(f"aeroquant-{args.job}")
    with run_scope(spark):
        JOBS[args.job][0](spark, args)


if __name__ == "__main__":
    main()
