"""Properties of the distributed quantile model and of tier training."""

from dataclasses import asdict, replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeroquant.operators import boost, trees
from aeroquant.operators.boost import SEARCH, BoostedModel, Params, QuantileBoostedTrees, add_bins, bin_edges, sample_candidates
from aeroquant.operators.preprocess import fit_preprocessor
from aeroquant.plans import training
from aeroquant.schemas import MODEL_NUMERIC

QUICK = Params(n_estimators=3, learning_rate=0.5, subsample=0.9, colsample_bytree=1.0, reg_alpha=0.1, reg_lambda=1.0)


def rows(spark, partitions=8, n=1500):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["y"] = 2 * x[:, 0] + np.where(x[:, 1] > 0, 3, 0) + rng.normal(size=n)
    pdf["id"] = range(n)
    pdf["pop"] = np.where(pdf.id % 3 == 0, "p", "q")
    pdf["role"] = np.where(pdf.id % 5 == 0, "test", "train")
    levels = F.explode(F.array(F.lit(0.5), F.lit(0.9)))
    return spark.createDataFrame(pdf).repartition(partitions, "id").withColumn("quantile", levels)


def pinball(pdf):
    e = pdf.y - pdf.prediction
    return np.maximum(pdf["quantile"] * e, (pdf["quantile"] - 1) * e)


@pytest.fixture(scope="module")
def model(spark):
    return QuantileBoostedTrees(list("abc"), ["pop", "quantile"], ["id"], QUICK).fit(rows(spark))


def test_beats_the_constant_quantile(model):
    out = model.scored.toPandas()
    out["loss"] = pinball(out)
    for (pop, q), part in out.groupby(["pop", "quantile"]):
        train, test = part[part.role == "train"], part[part.role == "test"]
        base = test.assign(prediction=np.quantile(train.y, q))
        assert test.loss.mean() < 0.9 * pinball(base).mean()
        assert abs((train.y <= train.prediction).mean() - q) < 0.08


def test_scoring_equals_training_margin(spark, model, tmp_path):
    model.save(str(tmp_path / "m"))
    again = BoostedModel.load(spark, str(tmp_path / "m"))
    new = again.predict(rows(spark).drop("role", "y")).toPandas().set_index(["id", "quantile"]).prediction
    old = model.scored.toPandas().set_index(["id", "quantile"]).prediction
    np.testing.assert_allclose(new.sort_index(), old.sort_index(), rtol=1e-9)


def test_importance_finds_the_used_features(model):
    found = model.feature_importance().toPandas()
    np.testing.assert_allclose(found.groupby(["pop", "quantile"]).importance.sum(), 1)
    assert set(found.feature) <= {"a", "b", "c"} and {"a", "b"} <= set(found.feature)


def test_partitioning_and_test_rows_change_nothing(spark, model):
    """Other partitions, and other values in test rows, give the same trees."""
    moved = rows(spark, 3).withColumn("y", F.when(F.col("role") == "test", F.col("y") + 1e6).otherwise(F.col("y")))
    other = QuantileBoostedTrees(list("abc"), ["pop", "quantile"], ["id"], QUICK).fit(moved)
    key = ["id", "quantile"]
    a = model.predict(rows(spark)).toPandas().set_index(key).prediction.sort_index()
    b = other.predict(rows(spark)).toPandas().set_index(key).prediction.sort_index()
    np.testing.assert_allclose(a, b, rtol=1e-6)


def test_large_populations_grow_the_same_trees(spark, model, monkeypatch):
    """Histograms of parts, added up by Spark, choose the splits that one task chooses."""
    monkeypatch.setattr(boost, "LOCAL_ROWS", 10)
    monkeypatch.setattr(boost, "CUT_EVERY", 2)
    other = QuantileBoostedTrees(list("abc"), ["pop", "quantile"], ["id"], QUICK).fit(rows(spark, 3))
    key = ["id", "quantile"]
    for found in (lambda m: m.scored, lambda m: m.predict(rows(spark))):
        a, b = (found(m).toPandas().set_index(key).prediction.sort_index() for m in (model, other))
        np.testing.assert_allclose(a, b, rtol=1e-9)
    trees_of = lambda m: {(r["pop"], r["quantile"]): [sorted((k, v.f, v.b) for k, v in t.splits.items()) for t in r.trees] for r in m.models.collect()}
    assert trees_of(model) == trees_of(other) and any(any(t) for t in trees_of(model).values())


def test_large_populations_keep_roles_and_gaps(spark, monkeypatch):
    """A row of another role is scored only if it is asked for; gaps and null categories bin alike."""
    def data():
        x = F.array(F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("id") % 50), (F.col("id") * 37 % 101).cast("double"))
        role = F.when(F.col("id") % 11 == 0, "late").when(F.col("id") % 13 == 0, F.lit(None)).when(F.col("id") % 5 == 0, "test").otherwise("train")
        other = F.struct(F.lit("b").alias("fit"), F.when(F.col("id") < 300, "train").otherwise("test").alias("role"))
        return spark.range(600).repartition(3).select(
            F.lit("p").alias("pop"), F.col("id").alias("row"), F.xxhash64("id").alias("rid"), (F.col("id") * 31 % 97).cast("double").alias("y"),
            x.alias("x"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("category"), F.lit("codes").alias("encode"),
            F.array(F.struct(F.lit("a").alias("fit"), role.alias("role")), other).alias("fits"))

    def outcome():
        done = boost.Trainer(["pop"], [QUICK], (0.5, 0.9), center=True, impute=True, roles=("late", "test")).train(data())
        told = done.where("row is not null").orderBy("fit", "quantile", "row").select("fit", "quantile", "row", "role", "y", "prediction").collect()
        kept = done.where("trees is not null").orderBy("fit", "quantile").select("fit", "shift", "n_train", "fills", "codes", "base", "edges").collect()
        return told, kept

    near = outcome()
    monkeypatch.setattr(boost, "LOCAL_ROWS", 10)
    far = outcome()
    assert near == far and {r.role for r in far[0] if r.fit == "a"} == {"late", "test"}


def test_leaves_no_task_was_near_are_looked_for_again():
    """Tasks whose rows differ tell other buckets; a second pass finds the value of all rows."""
    rng = np.random.default_rng(1)
    parts = [rng.uniform(0, 100, 40_000), rng.uniform(5000, 9000, 30_000), rng.uniform(-3000, -10, 9_000)]
    turn = boost._Turn(0, 0, QUICK, 0.9, 0, {}, [])

    def batch(y):
        n, zeros = len(y), np.zeros(len(y), np.uint8)
        row = (0, "", n, np.arange(n), y, zeros, zeros, np.zeros(n), np.arange(n))
        return boost.pa.RecordBatch.from_pylist([{c: v.tobytes() if isinstance(v, np.ndarray) else v for c, v in zip(
            [f.split()[0] for f in boost._BLOCK.split(", ")], row)}])

    turns, wanted, passes = {(0, ""): [turn]}, None, 0
    while wanted is None or wanted:
        told = [b for y in parts for b in boost._add_leaves(turns, 0, 64, 1, wanted)(iter([batch(y)]))]
        (found,) = boost._choose_leaves(turns)(boost.pa.Table.from_batches(told)).to_pylist()
        wanted, passes = {} if found["value"] is not None else {(0, 0): {found["node"]: (found["low"], found["high"])}}, passes + 1
    whole = np.concatenate(parts)
    assert passes == 2 and found["value"] == trees.leaf_values(*trees.leaf_totals(whole, np.ones(len(whole), int)), 0.9)[1]


def test_jobs_of_large_populations_follow_the_rounds(spark, monkeypatch):
    """Neither more populations nor more rows mean more jobs, and no plan explodes rows by feature."""
    monkeypatch.setattr(boost, "LOCAL_ROWS", 10)
    seen = []
    real = boost.cut_lineage
    monkeypatch.setattr(boost, "cut_lineage", lambda df, *a: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a))

    def jobs(df, rounds):
        spark.sparkContext.setJobGroup(f"fit-{rounds}-{id(df)}", "fit")
        QuantileBoostedTrees(list("abc"), ["pop", "quantile"], ["id"], replace(QUICK, n_estimators=rounds, max_depth=1)).fit(df)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{rounds}-{id(df)}"))

    few = rows(spark, 2, 300).where("quantile = 0.5")
    more = few.withColumn("pop", F.concat("pop", F.col("id") % 3))
    # a stage of the adaptive planner counts as a job: two for a level, two for the leaves, one for a cut
    assert jobs(more, 3) - jobs(few, 1) <= 2 * (2 + 2) + 4
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rounds = [p for p in seen if "MapInArrow" in p]
    assert rounds and not any("Generate explode" in p for p in rounds)


def test_bins(spark):
    df = spark.createDataFrame([(0.0, 5.0), (1.0, 6.0), (1.5, 99.0), (None, 5.5)], "a double, b double")
    edges = F.array(F.array(F.lit(0.5), F.lit(1.0)), F.array(F.lit(5.5)))
    out = add_bins(df.withColumn("edges", edges), ["a", "b"]).collect()
    assert [r.bins for r in out] == [[0, 0], [1, 1], [2, 1], [2, 0]]


@pytest.mark.parametrize("bins", [2, 5, 64, 100])
def test_bins_equal_a_plain_search(spark, bins):
    rng = np.random.default_rng(bins)
    cuts = np.unique(rng.integers(0, 300, bins - 1)).astype(float)
    values = np.concatenate([rng.integers(-5, 305, 200).astype(float), cuts])
    df = spark.createDataFrame(pd.DataFrame({"a": values})).withColumn("edges", F.array(F.array(*map(F.lit, cuts.tolist()))))
    got = add_bins(df, ["a"], bins).toPandas()
    assert [b[0] for b in got.bins] == np.searchsorted(cuts, got.a, side="left").tolist()


def test_edges_are_those_of_the_population(spark):
    df = spark.createDataFrame([("p", float(i), None) for i in range(5)] + [("q", 100.0, None)], "pop string, a double, b double")
    got = {r["pop"]: r.edges for r in bin_edges(df, ["pop"], ["a", "b"], 4).collect()}
    assert got == {"p": [[1.0, 2.0, 3.0], []], "q": [[100.0], []]}


def test_candidates_lie_in_the_search_space():
    found = sample_candidates(40)
    assert found == sample_candidates(40) and len(set(found)) == 40
    for p in found:
        for name, (kind, low, high) in SEARCH.items():
            value = asdict(p)[name]
            assert low <= value <= high and (kind != "int" or isinstance(value, int))


def test_preprocessor_is_fitted_on_training_rows(spark):
    data = [("train", "A", 1.0, 10.0), ("train", "A", 3.0, 30.0), ("train", "B", None, 50.0), ("test", "Z", None, 0.0)]
    df = spark.createDataFrame(data, "role string, airline string, x double, y double").withColumn("quantile", F.lit(0.5))
    df = df.withColumn("none", F.lit(None).cast("double"))
    fitted = fit_preprocessor(df.where("role = 'train'"), [], ["x", "none"], "y", [0.5])
    # with no population keys the encoding is keyed by quantile alone
    out = fitted.apply(df).where("role = 'test'").first()
    assert (out.x, out.none, out.airline_encoded) == (2.0, 0.0, 30.0)


@pytest.fixture(scope="module")
def history(spark):
    n = 700
    df = spark.range(n).select(
        F.lit("A->B").alias("route"),
        F.when(F.col("id") % 10 < 7, "AEE").when(F.col("id") % 10 < 9, "DLH").otherwise(F.lit(None)).alias("airline"),
        F.timestamp_seconds(F.lit(1609459200) + F.col("id") * 2 * 86400).alias("firstSeen"),
        F.col("id").cast("string").alias("icao24"),
    )
    wave = F.pmod(F.xxhash64("icao24"), F.lit(1000)) / 50.0
    columns = {c: (wave * (i % 3 + 1)) for i, c in enumerate(MODEL_NUMERIC)}
    return df.withColumns(columns).withColumn("flight_duration", 100 + wave + F.pmod(F.xxhash64("icao24", F.lit(1)), F.lit(10)))


def test_tier_report(spark, history):
    got = {r.tier: r for r in training.tier_report(history, ["firstSeen", "icao24"], 200).collect()}
    assert got["all_carriers"].trained and got["AEE"].trained and got["AEE"].n_folds == 3
    assert not got["DLH"].trained and got["DLH"].reason == "Only 140 flights; a dedicated model requires 200."


def test_short_history_is_not_trained(spark, history):
    short = history.where("firstSeen < timestamp '2022-06-01'")
    got = {r.tier: r for r in training.tier_report(short, ["firstSeen", "icao24"], 100).collect()}
    assert not got["AEE"].trained and "complete calendar year" in got["AEE"].reason


def test_tiers_end_to_end(spark, history, tmp_path):
    order = ["firstSeen", "icao24"]
    run = training.train_tiers(history, order, (0.5, 0.9), QUICK, min_rows=200)
    holdout = {(r.tier, r.quantile): r for r in run.holdout().collect()}
    assert set(holdout) == {(t, q) for t in ("all_carriers", "AEE") for q in (0.5, 0.9)}
    assert holdout["all_carriers", 0.5].n_eval == 140 and holdout["AEE", 0.5].n_eval == 98
    folds = run.backtest_score().collect()
    assert {r.n_folds for r in folds} == {3}
    manifest = run.manifest().toPandas()
    assert set(manifest.tier) == {"all_carriers", "AEE", "DLH"}
    assert manifest[manifest.tier == "all_carriers"].model_features.iloc[0][-1] == "airline"
    run.save(str(tmp_path / "run"))
    again = training.TrainedTiers.load(spark, str(tmp_path / "run"))
    spans = {(r.tier, r.fit): r for r in again.spans.collect()}
    assert spans["AEE", "holdout"].n_test == 98 and spans["AEE", "fold_2"].train_end < spans["AEE", "fold_2"].test_start
    row = manifest[(manifest.tier == "AEE") & (manifest["quantile"] == 0.5)].iloc[0]
    assert len(row.folds) == 3 and row.holdout_start > row.train_end and row.params["max_depth"] == 2
    scored = again.score(history.where("flight_duration > 0"), (0.5, 0.9)).toPandas()
    assert len(scored) == 1400 and set(scored.tier) == {"AEE", "all_carriers"}
    assert scored[scored.airline == "DLH"].is_fallback.all()
    np.testing.assert_allclose(scored.total, scored.route_median + scored.anomaly)
    strange = history.limit(5).withColumn("route", F.lit("elsewhere"))
    kept = again.score(strange, (0.5, 0.9)).collect()
    assert len(kept) == 10 and all(r.tier is None and r.anomaly is None and r.reason for r in kept)
    mid = scored[scored["quantile"] == 0.5].merge(history.select("icao24", F.col("flight_duration").alias("d")).toPandas(), on="icao24")
    assert 0.35 < (mid.d <= mid.total).mean() < 0.65


def test_newest_rows_and_other_fits_do_not_move_the_holdout_model(spark, history):
    """Neither features of the newest fifth nor a production fit change the holdout's trees."""
    order = ["firstSeen", "icao24"]
    newest = F.col("id") >= 560  # the newest fifth of all rows
    numbered = history.withColumn("id", F.col("icao24").cast("long"))
    moved = numbered.withColumns({c: F.when(newest, F.col(c) * 50 + 1000).otherwise(F.col(c)) for c in MODEL_NUMERIC})

    def trees(rows, fits):
        run = training.train_tiers(rows, order, (0.9,), QUICK, fits, min_rows=200)
        found = run.model.models.where("fit = 'holdout' and tier = 'all_carriers'")
        return found.select("base", F.to_json("edges"), F.to_json("trees")).collect()

    alone = trees(history, ["holdout"])
    assert len(alone) == 1 and alone == trees(moved, ["holdout", "production"])


def test_large_tiers_train_like_small_ones(spark, history, monkeypatch):
    """Medians, codes, edges and trees of all fits agree, whichever way a tier is trained."""
    order = ["firstSeen", "icao24"]
    quick = replace(QUICK, n_estimators=2)
    run = lambda: training.train_tiers(history, order, (0.5, 0.9), quick, ["holdout", "production"], min_rows=200)
    near, counted = run(), []
    real = training.cut_lineage
    monkeypatch.setattr(boost, "LOCAL_ROWS", 10)
    monkeypatch.setattr(training, "cut_lineage", lambda df, *a: counted.append(real(df, *a)) or counted[-1])
    far = run()
    assert counted[0].count() == 700 + 490  # one copy per tier, whatever the fits and quantiles
    for table in (lambda r: r.medians, lambda r: r.preprocessor.medians, lambda r: r.preprocessor.encoding, lambda r: r.preprocessor.fallback,
                  lambda r: r.holdout()):
        a, b = (table(r).toPandas() for r in (near, far))
        keys = [c for c in ("route", "tier", "fit", "quantile", "airline") if c in a]
        a, b = (d.sort_values(keys).reset_index(drop=True)[a.columns] for d in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_tuning_stores_one_copy_of_a_row_per_tier(spark, history, monkeypatch):
    stored = []
    real = training.cut_lineage
    monkeypatch.setattr(training, "cut_lineage", lambda df, *a: stored.append(real(df, *a)) or stored[-1])
    candidates = [replace(QUICK, n_estimators=1, learning_rate=0.1 * (i + 1)) for i in range(4)]
    best = training.tune_tiers(history, ["firstSeen", "icao24"], candidates, (0.5,), 200)
    # the holdout split of all rows, then the training part with its fits
    assert best.count() == 2 and [t.count() for t in stored] == [700 + 490, 560 + 392]


def test_tuning_scores_every_candidate(spark, history, tmp_path):
    candidates = [QUICK, Params(n_estimators=1, learning_rate=0.005)]
    best = training.tune_tiers(history, ["firstSeen", "icao24"], candidates, (0.5,), 200)
    found = {r.tier: r.candidate for r in best.collect()}
    assert found == {"all_carriers": 0, "AEE": 0}
    for _ in range(2):
        training.append_tuning_history(best, str(tmp_path / "log"), candidates)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and log.first().params["learning_rate"] == 0.5


@pytest.mark.parametrize("name", ["quantile_model", "holdout_eval", "walkforward_eval", "score_batch", "tune_candidates"])
def test_model_queries_ask_for_the_whole_training(spark, monkeypatch, name):
    """Default parameters, all three quantiles, and the candidates as they were drawn."""
    from aeroquant.plans import modeling

    class Asked(Exception):
        pass

    def train_tiers(rows, order, qs=training.QUANTILES, params=Params(), *_, **__):
        raise Asked(list(qs), [params])

    def tune_tiers(rows, order, candidates, qs=training.QUANTILES, *_, **__):
        raise Asked(list(qs), list(candidates))

    monkeypatch.setattr(training, "train_tiers", train_tiers)
    monkeypatch.setattr(training, "tune_tiers", tune_tiers)
    with pytest.raises(Asked) as asked:
        getattr(modeling, name)(spark, "/root/testdata/sf0.001")
    qs, params = asked.value.args
    assert qs == [0.5, 0.9, 0.95]
    assert params == (sample_candidates(len(params)) if name == "tune_candidates" else [Params()])
