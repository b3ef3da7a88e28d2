"""Populations above the size that one task may hold: in units of bins, or held by all tasks."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroquant.operators import boost, trees
from aeroquant.operators.boost import Params, Trainer
from aeroquant.session import cut_lineage

QUICK = Params(n_estimators=5, learning_rate=0.5, max_depth=3, subsample=0.9, colsample_bytree=1.0, reg_alpha=0.1, reg_lambda=1.0)
OTHER = replace(QUICK, n_estimators=3, max_depth=1, subsample=0.6)


def data(spark, n=600):
    x = F.array(F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("id") % 50), (F.col("id") * 37 % 101).cast("double"))
    role = F.when(F.col("id") % 5 == 0, "test").otherwise("train")
    other = F.struct(F.lit("b").alias("fit"), F.when(F.col("id") < 300, "train").otherwise("test").alias("role"))
    return cut_lineage(spark.range(n).repartition(3).select(
        F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("pop"), F.col("id").alias("row"), F.xxhash64("id").alias("rid"),
        (F.col("id") * 31 % 97).cast("double").alias("y"), x.alias("x"),
        F.when(F.col("id") % 9 != 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("category"), F.lit("codes").alias("encode"),
        F.array(F.struct(F.lit("a").alias("fit"), role.alias("role")), other).alias("fits")))


def outcome(rows, candidates=(QUICK, OTHER)):
    done = Trainer(["pop"], list(candidates), (0.5, 0.9), True, center=True, impute=True, roles=("test",)).train(rows)
    told = done.where("row is not null").select("pop", "fit", "quantile", "row", "role", "y", F.posexplode("prediction")) \
        .where("col is not null").orderBy("pop", "fit", "quantile", "row", "pos").collect()
    made = done.where("trees is not null").orderBy("pop", "fit", "quantile", "candidate").collect()
    return told, [(r.pop, r.fit, r.quantile, r.candidate, r.shift, r.n_train, r.fills, r.codes, r.base, r.edges,
                   [(sorted(t.splits.items()), sorted(t.leaves.items())) for t in r.trees], r.gains) for r in made]


@pytest.fixture(scope="module")
def near(spark):
    rows = data(spark)
    return rows, outcome(rows)


@pytest.mark.parametrize("limits", [
    {"LOCAL_ROWS": 10},
    {"LOCAL_ROWS": 10, "TASK_ROWS": 10, "CUT_EVERY": 2},
    {"LOCAL_ROWS": 10, "TASK_ROWS": 10, "COLUMN_ROWS": 10, "SENT_BYTES": 0},
])
def test_all_ways_give_the_same_outcome(near, monkeypatch, limits):
    """Fits, candidates, codes and gaps, bit by bit, and every row asked for once per candidate."""
    rows, expected = near
    for name, value in limits.items():
        monkeypatch.setattr(boost, name, value)
    found = outcome(rows)
    assert found[1] == expected[1]
    assert found[0] == expected[0] and len(found[0]) == (120 + 300) * 2 * 2


def test_rows_of_a_lost_executor_are_laid_down_again(near, monkeypatch):
    rows, _ = near
    monkeypatch.setattr(boost, "LOCAL_ROWS", 10)
    monkeypatch.setattr(boost, "TASK_ROWS", 10)
    monkeypatch.setattr(boost, "CUT_EVERY", 2)
    expected = outcome(rows, [QUICK])
    real, calls = boost._HeldRows.sums, []

    def sums(self, *args):
        calls.append(1)
        if len(calls) == 14:
            self.places.foreach(lambda place: boost.shutil.rmtree(place))
        return real(self, *args)

    monkeypatch.setattr(boost._HeldRows, "sums", sums)
    assert outcome(rows, [QUICK]) == expected and len(calls) > 14


def test_jobs_do_not_follow_the_rounds_of_populations_a_task_holds(spark, near, monkeypatch):
    """And one that all tasks hold takes a job per level and one for the leaves."""
    rows, _ = near
    monkeypatch.setattr(boost, "LOCAL_ROWS", 10)

    def jobs(rounds):
        group = f"rounds-{rounds}-{boost.TASK_ROWS}"
        spark.sparkContext.setJobGroup(group, group)
        Trainer(["pop"], [replace(QUICK, n_estimators=rounds, max_depth=2)], (0.5,)).train(rows)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(12)
    monkeypatch.setattr(boost, "TASK_ROWS", 10)
    assert jobs(12) - jobs(2) <= 10 * 3 + 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_models_counted_together_count_as_alone():
    """Rows of several models are counted once by the combination of their nodes and sides."""
    rng = np.random.default_rng(3)
    n, width, bins = 70_000, 4, 65
    lines = rng.integers(0, bins, (width + 3, n)).astype(np.uint8)
    rows = trees.Rows(lines, width, rng.normal(size=n), rng.integers(-(1 << 62), 1 << 62, n), 60_000)
    margins = [rng.normal(size=n) for _ in range(3)]
    models = [({1: (0, 30), 2: (1, 9)}, 0), ({1: (4, 20)}, 1), ({1: (3, 50), 3: (4, 11)}, 2)]
    features = np.array([0, 2, 4])
    found = trees.level_counts(rows, margins, models, 2, features, bins, 42, 7, 0.5)
    here = np.flatnonzero(trees.drawn(rows.rid[:60_000], 42, 7, 0.5))
    for (splits, code), margin, counts in zip(models, margins, found):
        plain = lines[[*range(width), width + code]].T[here].astype(np.int64)
        below, total = trees.histogram(plain, rows.y[here] < margin[here], trees.walk(splits, plain), 2, features, bins)
        np.testing.assert_array_equal(counts[:, :, 1].transpose(1, 0, 2), below)
        np.testing.assert_array_equal(counts.sum(axis=2).transpose(1, 0, 2), total)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("ties", [False, True])
def test_leaf_windows_lose_no_rank(q, ties):
    rng = np.random.default_rng(5)
    n = 100_000
    y = rng.normal(size=n) * 50
    y = np.round(y / 20) * 20 if ties else y
    rows = trees.Rows(rng.integers(0, 9, (1, n)).astype(np.uint8), 1, y, np.zeros(n, np.int64), n)
    splits, margin = {1: (0, 3), 3: (0, 6)}, np.zeros(n)
    told = trees.tell_leaves(rows, margin, splits, 0, q)
    node = rows.node(splits, 0, slice(0, n)).astype(int)
    plain = trees.leaf_values(*trees.leaf_totals(y, node), q)
    assert {leaf: trees.choose_leaf([rest], q) for leaf, *rest in told} == plain
    halves = [trees.tell_leaves(trees.Rows(rows.bins[:, p], 1, y[p], rows.rid[p], len(y[p])), margin[p], splits, 0, q)
              for p in (slice(0, n // 3), slice(n // 3, n))]
    assert {a[0]: trees.choose_leaf([a[1:], b[1:]], q) for a, b in zip(*halves)} == plain
