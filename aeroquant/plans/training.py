"""Training of every route and carrier tier in the same Spark jobs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroquant.functions import text
from aeroquant.operators import enrich, folds, metrics, split
from aeroquant.operators.boost import MOST_BINS, BoostedModel, Params, Trainer
from aeroquant.operators.preprocess import Preprocessor
from aeroquant.plans.features import QUANTILES
from aeroquant.schemas import MODEL_NUMERIC, SchemaError
from aeroquant.session import cut_lineage, settle

POOLED = "all_carriers"
HOLDOUT = "holdout"
PRODUCTION = "production"
CODED = "airline_encoded"
MIN_ROWS = 500  # fixed value


def walkforward_baseline(segmented: DataFrame, keys: Sequence[str], qs: Sequence[float] = QUANTILES) -> DataFrame:
    """Backtest of the constant forecast: the training quantile of the anomaly.

    Length minus median is a shift, so both come from one set of counts.
    """
    keys = list(keys)
    found = folds.train_quantiles(segmented, keys, "flight_duration", [0.5, *qs])
    names = F.array(*[F.lit(float(q)) for q in qs])
    shifted = F.transform(F.slice("q", 2, len(qs)), lambda v: v - F.col("q")[0])
    per_q = found.select(
        *keys, "fold", F.col("q")[0].alias("train_median"),
        F.inline(F.arrays_zip(names.alias("quantile"), shifted.alias("prediction"))),
    )
    tested = folds.test_rows(segmented).select(*keys, "fold", "flight_duration")
    scored = tested.join(settle(per_q), [*keys, "fold"]).withColumn("y", F.col("flight_duration") - F.col("train_median"))
    return metrics.metric_bundle(scored, [*keys, "fold", "quantile"])


def tiered(rows: DataFrame) -> DataFrame:
    """Each row in the pooled tier of its route and in its carrier's tier."""
    tiers = F.array_compact(F.array(F.lit(POOLED), F.col("airline")))
    return rows.withColumn("tier", F.explode(tiers))


def split_report(
    rows: DataFrame, order: Sequence[str], min_rows: int, kept: Sequence[str] = ("*",)
) -> tuple[DataFrame, DataFrame]:
    """(``tier_report``, the rows of all tiers with enough of them and their holdout role).

    Of the rows the ``kept`` columns are stored, among them those the report counts.
    """
    keys = ["route", "tier"]
    all_rows = tiered(rows)
    sizes = settle(split.population_sizes(all_rows, keys).withColumnRenamed("n", "n_rows"))
    enough = sizes.where(F.col("n_rows") >= min_rows).select(*keys)
    # only tiers with enough rows are split, so small ones cannot fail the job
    held = cut_lineage(split.chronological_split(all_rows.join(enough, keys, "left_semi"), keys, order).select(*kept))
    counted = split.fold_counts(held.where(F.col("role") == "train"), keys)
    n_folds = F.coalesce("n_folds", F.lit(0))
    has_rows = F.col("n_rows") >= min_rows
    few = F.concat(F.lit("Only "), F.col("n_rows").cast("string"),
                   F.lit(f" flights; a dedicated model requires {min_rows}."))
    report = sizes.join(counted, keys, "left").select(
        *keys, "n_rows", n_folds.alias("n_folds"),
        F.coalesce("complete_years", F.array().cast("array<int>")).alias("complete_years"),
        (has_rows & split.feasible(n_folds)).alias("trained"),
        F.when(~has_rows, few).otherwise(split.infeasible_reason(n_folds)).alias("reason"),
    )
    return report, held


def tier_report(rows: DataFrame, order: Sequence[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """Per route and tier: rows, folds, whether it is trained, and why not.

    Folds count the complete years of the training part of each tier.
    """
    return split_report(rows.select("route", "airline", *order), order, min_rows, ["route", "tier", "role", "firstSeen"])[0]


@dataclass(frozen=True)
class TrainedTiers:
    """Everything one training run yields; models of all tiers in one table."""

    model: BoostedModel
    preprocessor: Preprocessor
    medians: DataFrame  # route, tier, fit, route_median, n_train
    report: DataFrame
    chosen: DataFrame | None = None  # route, tier, quantile, candidate
    spans: DataFrame | None = None  # route, tier, fit: rows and first and last time of training and test
    params: DataFrame | None = None  # candidate, params

    KEYS = ("route", "tier", "fit")

    def save(self, path: str) -> None:
        """Everything scoring needs, and a description of the run; scored rows are not kept."""
        self.model.save(f"{path}/model")
        parts = {
            "medians": self.medians, "report": self.report, "imputer": self.preprocessor.medians,
            "encoding": self.preprocessor.encoding, "fallback": self.preprocessor.fallback,
        }
        parts |= {name: table for name, table in (("chosen", self.chosen), ("spans", self.spans), ("params", self.params)) if table is not None}
        for name, table in parts.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        about = {"tuned": self.chosen is not None, "parts": sorted(parts), "features": list(MODEL_NUMERIC), "keys": list(self.KEYS)}
        spark = self.report.sparkSession
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedTiers:
        """A saved run; it says itself whether it was tuned."""
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        if about["features"] != list(MODEL_NUMERIC) or about["keys"] != list(cls.KEYS):
            raise SchemaError(f"the models at {path} were trained with other columns: {about['features']}")
        part = lambda name: spark.read.parquet(f"{path}/{name}") if name in about["parts"] else None
        fitted = Preprocessor(cls.KEYS, tuple(MODEL_NUMERIC), part("imputer"), part("encoding"), part("fallback"))
        return cls(BoostedModel.load(spark, f"{path}/model"), fitted, part("medians"), part("report"),
                   part("chosen"), part("spans"), part("params"))

    def test_scores(self, fits: str) -> DataFrame:
        return self.model.scored.where(F.col("fit").rlike(fits) & (F.col("role") == "test"))

    def holdout(self) -> DataFrame:
        """Metrics of the newest fifth, fitted on the rest."""
        return metrics.metric_bundle(self.test_scores("^holdout$"), ["route", "tier", "quantile"])

    def backtest(self) -> DataFrame:
        """Metrics per walk-forward fold."""
        found = metrics.metric_bundle(self.test_scores("^fold_"), [*self.KEYS, "quantile"])
        return found.join(self.medians, list(self.KEYS))

    def backtest_score(self) -> DataFrame:
        return metrics.fold_balanced_score(self.backtest(), ["route", "tier", "quantile"])

    def fold_report(self) -> DataFrame:
        """Metrics per walk-forward fold with its rows and time spans."""
        return self.backtest().drop("n_train").join(self.spans, list(self.KEYS))

    def manifest(self) -> DataFrame:
        """One row per route, tier and quantile; untrained tiers with the reason."""
        keys = ["route", "tier", "quantile"]
        held = self.holdout()
        held = held.select(*keys, F.struct(*[c for c in held.columns if c not in keys]).alias("holdout"))
        walked = self.backtest_score()
        walked = walked.select(*keys, F.struct(*[c for c in walked.columns if c not in keys]).alias("backtest"))
        # a run has few folds
        fold = F.struct("fit", "n_train", "n_test", "train_start", "train_end", "test_start", "test_end", "pinball_loss", "coverage_error")
        folds_ = self.fold_report().groupBy(*keys).agg(F.array_sort(F.collect_list(fold)).alias("folds"))
        levels = F.array(*[F.lit(float(q)) for q in QUANTILES])
        base = self.report.withColumn("quantile", F.explode(levels))
        made = self.medians.where(F.col("fit") == PRODUCTION).select("route", "tier", "route_median", F.col("n_train").alias("production_rows"))
        span = lambda fit, *names: self.spans.where(F.col("fit") == fit).select("route", "tier", *[F.col(a).alias(b) for a, b in names])
        held_span = span(HOLDOUT, ("n_train", "n_train"), ("n_test", "n_test"), ("train_start", "train_start"),
                         ("train_end", "train_end"), ("test_start", "holdout_start"), ("test_end", "holdout_end"))
        whole_span = span(PRODUCTION, ("train_start", "production_start"), ("train_end", "production_end"))
        features = F.array(*[F.lit(c) for c in MODEL_NUMERIC])
        out = (
            base.join(held, keys, "left").join(walked, keys, "left").join(folds_, keys, "left")
            .join(made, ["route", "tier"], "left").join(held_span, ["route", "tier"], "left").join(whole_span, ["route", "tier"], "left")
            .withColumn("model_features", F.when(
                F.col("tier") == POOLED, F.concat(features, F.array(F.lit("airline")))).otherwise(features))
        )
        if self.params is None:
            return out
        if self.chosen is None:
            return out.withColumn("params", self.params.select("params").scalar())  # one row of defaults
        return out.join(self.chosen.join(self.params, "candidate"), keys, "left")

    def score(self, requests: DataFrame, qs: Sequence[float] = QUANTILES) -> DataFrame:
        """Anomaly and total per request and quantile, falling back to the pool.

        Every request comes back. Without a model for it, the anomaly and the total
        are null and ``reason`` says why; else ``reason`` is null.
        """
        trained = self.report.where("trained").select("route", "tier")
        chosen = enrich.select_tier(requests, trained)
        levels = F.array(*[F.lit(float(q)) for q in qs])
        asked = chosen.withColumn("fit", F.lit(PRODUCTION)).withColumn("quantile", F.explode(levels))
        known = F.col("tier").isNotNull()
        reason = F.when(~known, "no trained model for the route")
        if self.chosen is not None:
            asked = asked.join(self.chosen.withColumn("_chosen", F.lit(True)), ["route", "tier", "quantile"], "left")
            reason = F.coalesce(reason, F.when(F.col("_chosen").isNull(), "no parameters chosen for the quantile"))
            known = known & F.col("_chosen").isNotNull()
        ready = model_inputs(asked.where(known).drop("_chosen"), self.preprocessor)
        scored = self.model.predict(ready, "anomaly").join(self.medians.drop("n_train"), list(self.KEYS), "left")
        total = F.coalesce("route_median", F.lit(0.0)) + F.col("anomaly")
        named = [*requests.columns, "tier", "is_fallback", "quantile"]
        without = asked.where(~known).select(
            *named, *[F.lit(None).cast("double").alias(c) for c in ("anomaly", "route_median", "total")], reason.alias("reason")
        )
        return scored.select(
            *named, "anomaly", "route_median", total.alias("total"), F.lit(None).cast("string").alias("reason")
        ).unionByName(without)


def model_inputs(rows: DataFrame, fitted: Preprocessor) -> DataFrame:
    """Imputed features, and the carrier code for pooled tiers only."""
    out = fitted.apply(rows)
    coded = F.when(F.col("tier") == POOLED, F.col(CODED)).otherwise(F.lit(0.0))
    return out.withColumn(CODED, coded)


def fits_of(segment: Column, n_folds: Column, role: Column, fits: Sequence[str]) -> Column:
    """Name and role of every fit a row takes part in."""
    i = F.sequence(F.greatest(segment, F.lit(1)), n_folds.cast("int"))
    walk = F.transform(i, lambda f: F.struct(
        F.concat(F.lit("fold_"), f.cast("string")).alias("fit"),
        F.when(segment == f, "test").otherwise("train").alias("role"),
    ))
    parts = []
    if "folds" in fits:
        # a row after the last fold's test part is in no fold
        parts.append(F.when(segment <= n_folds, walk).otherwise(F.slice(walk, 1, 0)))
    if HOLDOUT in fits:
        parts.append(F.array(F.struct(F.lit(HOLDOUT).alias("fit"), role.alias("role"))))
    if PRODUCTION in fits:
        parts.append(F.array(F.struct(F.lit(PRODUCTION).alias("fit"), F.lit("train").alias("role"))))
    return F.concat(*parts)


def fit_spans(data: DataFrame) -> DataFrame:
    """Rows and first and last time of the training and the test part of every fit."""
    rows = data.select("route", "tier", "at", F.inline("fits"))
    side = lambda role: F.when(F.col("role") == role, F.col("at"))
    return settle(rows.groupBy(*TrainedTiers.KEYS).agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"),
        F.min(side("train")).alias("train_start"), F.max(side("train")).alias("train_end"),
        F.min(side("test")).alias("test_start"), F.max(side("test")).alias("test_end"),
    ))


def candidate_table(spark: SparkSession, candidates: Sequence[Params]) -> DataFrame:
    """The parameters of each candidate."""
    rows = [(i, {k: float(v) for k, v in asdict(p).items()}) for i, p in enumerate(candidates)]
    return spark.createDataFrame(rows, "candidate int, params map<string,double>")


def fit_populations(rows: DataFrame, order: Sequence[str], fits: Sequence[str], qs: Sequence[float],
                    candidates: list[Params], tuned: bool, chosen: DataFrame | None, report: DataFrame) -> TrainedTiers:
    """Targets, preprocessing and boosting of all tiers; one stored copy of each row per tier."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in MODEL_NUMERIC])
    data = cut_lineage(rows.select(
        "route", "tier", F.monotonically_increasing_id().alias("row"), F.xxhash64(*order).alias("rid"),
        F.col("flight_duration").cast("double").alias("y"), x.alias("x"), F.col("airline").alias("category"),
        F.when(F.col("tier") == POOLED, "codes").otherwise("zero").alias("encode"),
        fits_of(F.col("segment"), F.col("n_folds"), F.col("role"), fits).alias("fits"), F.col(order[0]).alias("at"),
    ).where("size(fits) > 0 and y is not null and not isnan(y)"))
    trainer = Trainer(["route", "tier"], candidates, qs, tuned, center=True, impute=True, roles=("test",))
    done = trainer.train(data, chosen)
    keys = list(TrainedTiers.KEYS)
    made = done.where(F.col("trees").isNotNull())
    medians = settle(made.groupBy(*keys).agg(F.max("shift").alias("route_median"), F.max("n_train").alias("n_train")))
    group = [*keys, "quantile"]
    # fills and codes are the same for all quantiles, or all candidates, of a fit
    fills = made.groupBy(*keys).agg(F.max("fills").alias("fills"))
    codes = made.where(F.col("tier") == POOLED).select(*group, "fallback", F.map_entries("codes").alias("codes")).distinct()
    fitted = Preprocessor(
        tuple(keys), tuple(MODEL_NUMERIC),
        settle(fills.select(*keys, *[F.col("fills")[i].alias(c) for i, c in enumerate(MODEL_NUMERIC)])),
        settle(codes.select(*group, F.inline("codes").alias("airline", "value"))),
        settle(codes.select(*group, F.col("fallback").alias("value"))),
    )
    depth = max(p.max_depth for p in candidates)
    model = BoostedModel.of(done, [*group, *(["candidate"] if tuned else [])], [*MODEL_NUMERIC, CODED], MOST_BINS, depth)
    scored = done.where(F.col("row").isNotNull()).select(*group, "role", "y", F.posexplode("prediction").alias("candidate", "prediction")) \
        .where("prediction is not null")  # the candidates of a row may come apart
    model.scored = scored if tuned and chosen is None else scored.drop("candidate")
    return TrainedTiers(model, fitted, medians, report, chosen, fit_spans(data), candidate_table(data.sparkSession, candidates))


def train_tiers(rows: DataFrame, order: Sequence[str], qs: Sequence[float] = QUANTILES, params: Params = Params(),
                fits: Sequence[str] = ("folds", "holdout", "production"), min_rows: int = MIN_ROWS,
                candidates: Sequence[Params] | None = None, chosen: DataFrame | None = None) -> TrainedTiers:
    """Train pooled and carrier tiers of every route.

    ``rows`` are clean training rows with the model columns; ``order`` identifies
    a row within a route and starts with the time.
    """
    keys = ["route", "tier"]
    used = list(dict.fromkeys(["route", "airline", "flight_duration", *order, *MODEL_NUMERIC]))
    report, held = split_report(rows.select(*used), order, min_rows)
    report = settle(report)
    trained = report.where("trained").select(*keys, "n_folds")
    segments = split.fold_segments(held.join(trained.select(*keys), keys, "left_semi"), keys, order, trained)
    return fit_populations(segments, order, fits, qs, list(candidates or [params]), bool(candidates), chosen, report)


def tune_tiers(rows: DataFrame, order: Sequence[str], candidates: Sequence[Params], qs: Sequence[float] = QUANTILES,
               min_rows: int = MIN_ROWS) -> DataFrame:
    """Best candidate per route, tier and quantile.

    Candidates are scored over walk-forward folds of the training part only; the
    holdout is never seen.
    """
    keys = ["route", "tier"]
    used = list(dict.fromkeys(["route", "airline", "flight_duration", *order, *MODEL_NUMERIC]))
    report, held = split_report(rows.select(*used), order, min_rows)
    report = settle(report)
    trained = report.where("trained").select(*keys, "n_folds")
    train = held.where(F.col("role") == "train").join(trained.select(*keys), keys, "left_semi")
    segments = split.fold_segments(train, keys, order, trained)
    run = fit_populations(segments, order, ["folds"], qs, list(candidates), True, None, report)
    found = metrics.loss_bundle(run.test_scores("^fold_"), [*TrainedTiers.KEYS, "quantile", "candidate"])
    scores = metrics.fold_balanced_score(found, [*keys, "quantile", "candidate"])
    return metrics.best_candidate(scores, [*keys, "quantile"])


def append_tuning_history(best: DataFrame, path: str, candidates: Sequence[Params]) -> None:
    """Append one tuning run with its parameters; earlier runs stay."""
    table = candidate_table(best.sparkSession, candidates)
    rows = best.join(F.broadcast(table), "candidate", "left").withColumn("completed_at_utc", F.current_timestamp())  # one row per candidate
    rows.write.mode("append").parquet(path)


def nested_manifest(manifest: DataFrame, model_root: str) -> DataFrame:
    """The long table as one document per route, as the dashboard reads it.

    Everything the long table tells of a quantile (metrics, folds, time spans) goes along.
    """
    where = F.concat(F.lit(model_root + "/"), text.route_to_key(F.col("route")), F.lit("/"), F.col("tier"))
    production = F.struct(
        F.concat(where, F.lit("/models")).alias("model_path"),
        F.concat(where, F.lit("/preprocessing")).alias("preprocessing_path"),
    )
    told = [c for c in manifest.columns if c not in ("route", "tier", "quantile", "trained", "reason", "n_rows", "candidate")]
    # quantiles per tier are three, tiers per route are its carriers
    tiers = manifest.groupBy("route", "tier").agg(
        F.max("trained").alias("trained"), F.max("n_rows").alias("n_rows"), F.max("reason").alias("reason"),
        F.map_from_entries(F.collect_list(F.struct(
            F.col("quantile").cast("string"), F.struct(production.alias("production"), F.col("n_rows"), *told)))).alias("quantiles"),
    )
    entry = F.struct("trained", "n_rows", "reason", "quantiles")
    is_pooled = F.col("tier") == POOLED
    carriers = F.map_from_entries(F.collect_list(F.when(~is_pooled, F.struct("tier", entry))))
    return tiers.groupBy("route").agg(
        F.max_by(F.when(is_pooled, entry), is_pooled.cast("int")).alias("all_carriers"),
        F.struct(carriers.alias("carriers")).alias("by_carrier"),
    )
