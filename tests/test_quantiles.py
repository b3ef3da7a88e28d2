import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aeroquant.operators import quantiles

QS = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]


def frame(spark, values):
    return spark.createDataFrame(pd.DataFrame({"g": [g for g, _ in values], "x": [x for _, x in values]}), "g string, x double")


@pytest.mark.parametrize("small", [1, 50, 100_000])
@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_numpy(spark, small, partitions, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = np.random.default_rng(1)
    values = [("hot", float(v)) for v in rng.normal(0, 50, 900)]
    values += [("crowd", float(v)) for v in 1000 + rng.random(400) * 1e-4]
    values += [("ties", float(v)) for v in rng.integers(0, 4, 300)] + [("one", 5.5)]
    out = quantiles.exact_quantiles(frame(spark, values).repartition(partitions), ["g"], "x", QS)
    got = {r.g: r for r in out.collect()}
    for group in ("hot", "crowd", "ties", "one"):
        x = np.array([v for g, v in values if g == group])
        assert got[group].n == len(x)
        np.testing.assert_allclose(got[group].q, np.quantile(x, QS), rtol=1e-12, atol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40), st.floats(0, 1))
def test_any_values(spark, xs, q):
    out = quantiles.exact_quantiles(frame(spark, [("g", float(x)) for x in xs]), [], "x", [q]).first()
    np.testing.assert_allclose(out.q[0], np.quantile(xs, q), rtol=1e-9, atol=1e-9)


def test_missing_values_and_groups_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 2.0), (None, 9.0)], "g string, x double")
    rows = quantiles.exact_quantiles(df, ["g"], "x", [0.5]).collect()
    assert [(r.g, r.n, r.q) for r in rows] == [("a", 2, [1.5])]


def test_known_interpolation(spark):
    out = quantiles.named_quantiles(frame(spark, [("a", float(v)) for v in (1, 2, 3, 10)]), ["g"], "x", {"p90": 0.9})
    assert out.first().p90 == pytest.approx(7.9)
    assert quantiles.medians(frame(spark, [("a", float(v)) for v in (1, 3, 8, 10)]), ["g"], "x").first()["median"] == 5.5


def test_hot_group_is_not_gathered(spark):
    """A third of all rows is one group; it is counted by prefix before anything is shuffled."""
    df = spark.range(0, 300_000, numPartitions=16).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"),
        ((F.col("id") * 7919) % 1000).cast("double").alias("x"),
    )
    row = quantiles.exact_quantiles(df, ["g"], "x", [0.5]).where("g = 'hot'").first()
    x = (np.arange(0, 300_000, 3) * 7919) % 1000
    assert row.n == 100_000 and row.q[0] == np.quantile(x, 0.5)


def test_only_values_of_hit_buckets_are_shuffled(spark):
    """The exchange of values lies above the join with the hit buckets."""
    df = spark.range(0, 50_000, numPartitions=4).select((F.rand(1) * 1000).alias("x"))
    found = quantiles.exact_quantiles(df, [], "x", [0.5])
    text = found._jdf.queryExecution().executedPlan().toString()
    above, below = text.split("LeftSemi", 1)
    assert "Exchange hashpartitioning" in above and "Exchange hashpartitioning" not in below


def test_continuous_values_are_refined(spark, monkeypatch):
    """Values crowded into one bucket are split until none is larger than the bound."""
    monkeypatch.setattr(quantiles, "SMALL", 2_000)
    stored, real = [], quantiles.settle

    def spy(table):
        out = real(table)
        if "size" in out.columns:
            stored.append(max(r["size"] for r in out.select("size").collect()))
        return out

    monkeypatch.setattr(quantiles, "settle", spy)
    df = spark.range(0, 400_000, numPartitions=8).select((F.lit(1.0) + F.rand(3) * 1e-6).alias("x"))
    values = np.sort(np.array([r.x for r in df.collect()]))
    out = quantiles.exact_quantiles(df, [], "x", [0.25, 0.5]).first()
    np.testing.assert_allclose(out.q, np.quantile(values, [0.25, 0.5]), rtol=1e-15)
    assert stored[0] == 400_000 and stored[-1] <= 2_000


def test_column_medians_skip_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, None), (3.0, 5.0, None)], "a double, b double, c double")
    found = {r["column"]: r["median"] for r in quantiles.column_medians(df, [], df.columns).collect()}
    assert found == {"a": 2.0, "b": 5.0}


def test_qcut_like_pandas(spark):
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=200), np.round(rng.exponential(1, 300), 1), np.r_[np.zeros(150), rng.random(60)]):
        out = quantiles.qcut(spark.createDataFrame(pd.DataFrame({"x": x})), "x").toPandas()
        want = pd.qcut(pd.Series(out.x), 6, labels=False, duplicates="drop")
        assert list(out["bin"]) == list(want)


def test_few_values_group_themselves(spark):
    out = quantiles.qcut(spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "x double"), "x").collect()
    assert [(r["bin"], r["raw"]) for r in out] == [(None, 1.0), (None, 2.0), (None, 2.0)]


def test_bucket_quantiles_are_close(spark):
    rng = np.random.default_rng(8)
    values = [("a", float(v)) for v in rng.normal(50, 20, 1000)] + [("b", float(v)) for v in rng.integers(0, 5, 200)]
    df = frame(spark, values).withColumn("q", F.when(F.col("g") == "a", 0.9).otherwise(0.5))
    got = {r.g: r.v for r in quantiles.bucket_quantiles(df, ["g", "q"], F.col("x"), "q", "v").collect()}
    x = {g: [v for k, v in values if k == g] for g in "ab"}
    assert got["a"] == pytest.approx(np.quantile(x["a"], 0.9), rel=2e-3)
    assert got["b"] == np.quantile(x["b"], 0.5)


def test_approximate_is_opt_in(spark):
    df = frame(spark, [("a", float(v)) for v in range(1000)])
    row = quantiles.approximate_quantiles(df, ["g"], "x", [0.5], 1000).first()
    assert abs(row.q[0] - 499.5) <= 2
