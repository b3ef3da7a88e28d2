import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeroquant.operators import metrics, profile


def scored(spark, seed=4, n=200):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"y": rng.normal(size=n), "prediction": rng.normal(size=n), "quantile": np.repeat([0.5, 0.9], n // 2)})
    return df, spark.createDataFrame(df)


def test_bundle_equals_numpy(spark):
    pdf, df = scored(spark)
    got = metrics.metric_bundle(df, ["quantile"]).toPandas().set_index("quantile")
    for q, part in pdf.groupby("quantile"):
        e = part.y - part.prediction
        covered = (part.y <= part.prediction).mean()
        loss = np.maximum(q * e, (q - 1) * e).mean()
        want = dict(pinball_loss=loss, coverage_error=abs(covered - q), coverage_penalty=abs(covered - q),
                    tuning_score=loss + 10 * abs(covered - q), mae=e.abs().mean(), medae=e.abs().median(),
                    rmse=np.sqrt((e**2).mean()), mean_error=(-e).mean(), empirical_coverage_pct=100 * covered,
                    target_coverage_pct=100 * q, coverage_gap_pct=100 * (covered - q))
        assert list(want) == metrics.BUNDLE
        for name, value in want.items():
            assert got.loc[q, name] == pytest.approx(value)


def test_coverage_is_inclusive(spark):
    df = spark.createDataFrame([(float(i), float(i), 1.0) for i in range(1, 5)], "y double, prediction double, quantile double")
    assert df.agg(metrics.coverage_error(F.col("y"), F.col("prediction"), F.col("quantile"))).first()[0] == 0


def test_fold_score(spark):
    df = spark.createDataFrame([("a", 1.0, 0.1), ("a", 2.0, 0.3)], "k string, pinball_loss double, coverage_error double")
    row = metrics.fold_balanced_score(df, ["k"]).first()
    assert row.score == pytest.approx(1.5 + 10 * 0.2 + 10 * 0.1) and row.fold_coverage_error_std == pytest.approx(0.1)


def test_best_candidate(spark):
    df = spark.createDataFrame([("a", 2, 0.5), ("a", 1, 0.5), ("a", 0, 0.9)], "k string, candidate int, score double")
    assert metrics.best_candidate(df, ["k"]).first().candidate == 1


def test_null_rates(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "clean int, dirty string")
    assert [tuple(r) for r in profile.null_rates(df).collect()] == [("dirty", 33.3)]


def test_describe_like_pandas(spark):
    pdf = pd.DataFrame({"a": np.random.default_rng(5).normal(size=101), "b": np.arange(101.0)})
    got = profile.describe_numeric(spark.createDataFrame(pdf), ["a", "b"]).toPandas().set_index("column")
    want = pdf.describe().T
    for ours, theirs in {"count": "count", "mean": "mean", "std": "std", "min": "min", "p25": "25%", "p50": "50%", "p75": "75%", "max": "max"}.items():
        np.testing.assert_allclose(got.loc[["a", "b"], ours].astype(float), want[theirs])


def test_correlations_like_pandas(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(rng.normal(size=(80, 3)), columns=list("abc"))
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in "abc"])
    got = {(r.a, r.b): r.r for r in profile.correlation_matrix(df, list("abc")).collect()}
    want = pdf.corr()
    assert len(got) == 9
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b])


def test_constant_column_has_no_correlation(spark):
    df = spark.range(100).select((F.col("id") * 0 + 0.1).alias("c"), F.col("id").cast("double").alias("x"))
    got = {(r.a, r.b): r.r for r in profile.correlation_matrix(df.repartition(5), ["c", "x"]).collect()}
    assert got["c", "x"] is None and got["c", "c"] is None and got["x", "x"] == pytest.approx(1)


def test_histogram_like_numpy(spark):
    pdf = pd.DataFrame({"g": ["a"] * 100 + ["b"] * 3, "v": [*np.random.default_rng(7).random(100), 5, 5, 5]})
    got = profile.histogram(spark.createDataFrame(pdf), ["g"], "v", 10).toPandas()
    counts, _ = np.histogram(pdf[pdf.g == "a"].v, 10)
    mine = got[got.g == "a"].set_index("bin").n.reindex(range(1, 11), fill_value=0)
    assert list(mine) == list(counts)
    assert list(got[got.g == "b"][["bin", "n"]].itertuples(index=False, name=None)) == [(1, 3)]


def test_mode_takes_the_lowest_of_ties(spark):
    df = spark.createDataFrame([("r", 1.0, 9), ("r", 3.0, 9), ("r", 2.0, 7), ("r", 2.0, 7)], "route string, dep_x double, hour_of_day int")
    row = profile.typical_row(df, ["dep_x"]).first()
    assert (row.dep_x, row.hour_of_day) == (2.0, 7)


def test_eligible_carriers(spark):
    rows = [("r", "AAA")] * 10 + [("r", "BBB")] * 6 + [("r", "CCC")] * 4 + [("r", None)] * 9
    df = spark.createDataFrame(rows, "route string, airline string")
    assert sorted(r.airline for r in profile.eligible_carriers(df, ["route"], 6).collect()) == ["AAA", "BBB"]


def test_value_counts_include_missing(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "airline string")
    assert {r.airline: r.n for r in profile.value_counts(df, "airline").collect()} == {"a": 1, None: 2}
