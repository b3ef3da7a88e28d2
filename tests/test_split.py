import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeroquant.operators import enrich, folds, split
from aeroquant.plans.features import route_medians
from helpers import column


def trips(spark, n, days=90, population="AAA->BBB", shift=0):
    return spark.range(n).select(
        F.lit(population).alias("route"),
        F.timestamp_seconds(F.lit(1640995200) + F.col("id") * 86400 * days).alias("firstSeen"),
        (F.col("id") + shift).cast("string").alias("icao24"),
        (F.lit(90.0) + F.col("id")).alias("flight_duration"),
    )


def test_split_sizes_and_order(spark):
    out = split.chronological_split(trips(spark, 20).repartition(5), ["route"], ["firstSeen", "icao24"]).toPandas()
    assert (out.role == "train").sum() == 16 and (out.role == "test").sum() == 4
    assert out[out.role == "train"].firstSeen.max() < out[out.role == "test"].firstSeen.min()


@pytest.mark.parametrize("n", [2, 3, 9, 10, 101])
def test_split_rank_is_whole_part(spark, n):
    out = split.chronological_split(trips(spark, n), ["route"], ["firstSeen", "icao24"])
    assert out.where("role = 'train'").count() == int(n * 0.8)


def test_split_refuses_one_row(spark):
    with pytest.raises(Exception, match="too small"):
        split.chronological_split(trips(spark, 1), ["route"], ["firstSeen", "icao24"]).count()


def test_split_breaks_ties_by_later_columns(spark):
    df = spark.range(10).select(F.lit("r").alias("route"), F.timestamp_seconds(F.lit(0)).alias("t"), F.col("id"))
    out = split.chronological_split(df.repartition(4), ["route"], ["t", "id"])
    assert sorted(column(out.where("role = 'test'"), "id")) == [8, 9]


@pytest.mark.parametrize("partitions", [1, 4])
def test_copies_straddle_a_boundary(spark, partitions):
    df = spark.range(10).select(F.lit("r").alias("route"), F.timestamp_seconds(F.lit(0)).alias("t"), F.lit(1).alias("k"))
    out = split.chronological_split(df.repartition(partitions), ["route"], ["t", "k"])
    assert out.groupBy("role").count().collect() and sorted((r["role"], r["count"]) for r in out.groupBy("role").count().collect()) == [
        ("test", 2), ("train", 8)]
    assert out.columns == ["route", "t", "k", "role"]


def test_ties_straddle_by_the_whole_row_and_reruns_agree(spark, monkeypatch):
    """Rows before the tie, a tie of different rows and many copies, rows after it; a null population too."""
    monkeypatch.setattr(split, "BLOCK", 3)
    rows = [("r", 0, i, None) for i in range(3)] + [("r", 5, i % 4, "x") for i in range(40)] + [("r", 9, i, "y") for i in range(4)]
    rows += [(None, 5, 1, "z")] * 7 + [(None, 5, 2, None)] * 3
    df = spark.createDataFrame(rows, "route string, s long, v int, w string").withColumn("t", F.timestamp_seconds("s"))
    plan = df.select("route").distinct().withColumn("n_folds", F.lit(3))

    def placed(parts):
        held = split.chronological_split(df.repartition(parts), ["route"], ["t"])
        out = split.fold_segments(held.drop("role"), ["route"], ["t"], plan)
        return sorted(map(repr, held.collect())), sorted(map(repr, out.collect())), held, out

    one, folds_one, held, out = placed(1)
    many, folds_many, _, _ = placed(5)
    assert one == many and folds_one == folds_many and len(one) == len(folds_one) == len(rows)
    counts = {(r["route"], r["role"]): r["count"] for r in held.groupBy("route", "role").count().collect()}
    assert counts == {("r", "train"): 37, ("r", "test"): 10, (None, "train"): 8, (None, "test"): 2}
    sizes = {(r["route"], r["segment"]): r["count"] for r in out.groupBy("route", "segment").count().collect()}
    assert sizes == {("r", 0): 14, ("r", 1): 11, ("r", 2): 11, ("r", 3): 11, (None, 0): 4, (None, 1): 2, (None, 2): 2, (None, 3): 2}
    assert held.where("route = 'r' and s = 9 and role = 'train'").count() == 0


@pytest.mark.parametrize("n, k", [(20, 2), (23, 3), (7, 6)])
def test_folds_follow_the_rule(spark, n, k):
    df = trips(spark, n)
    plan = df.select("route").distinct().withColumn("n_folds", F.lit(k))
    out = split.expand_folds(split.fold_segments(df, ["route"], ["firstSeen", "icao24"], plan)).toPandas()
    pos = {a: i for i, a in enumerate(sorted(out.icao24.unique(), key=int))}
    size = n // (k + 1)
    for i in range(k):
        start = n - (k - i) * size
        fold = out[out.fold == i + 1]
        assert sorted(pos[a] for a in fold[fold.role == "test"].icao24) == list(range(start, start + size))
        assert sorted(pos[a] for a in fold[fold.role == "train"].icao24) == list(range(start))


def test_fold_statistics_come_from_training_rows(spark):
    df = trips(spark, 24)
    plan = df.select("route").distinct().withColumn("n_folds", F.lit(3))
    s = split.fold_segments(df, ["route"], ["firstSeen", "icao24"], plan)
    fast = folds.train_medians(s, ["route"], "flight_duration").orderBy("fold").toPandas()
    slow = split.expand_folds(s).where("role = 'train'").toPandas().groupby("fold").flight_duration
    assert list(fast.train_median) == list(slow.median()) and list(fast.n_train) == list(slow.size())
    # test rows moved far away change nothing that was fitted on earlier rows
    moved = s.withColumn("flight_duration", F.when(F.col("segment") == 3, 1e6).otherwise(F.col("flight_duration")))
    again = folds.train_medians(moved, ["route"], "flight_duration").orderBy("fold").toPandas()
    assert list(again.train_median) == list(fast.train_median)


def test_target_uses_training_median(spark):
    rows = [("r", "train", d) for d in (100.0, 110.0, 120.0)] + [("r", "valid", d) for d in (1000.0, 2000.0, 3000.0)]
    df = spark.createDataFrame(rows, "route string, role string, flight_duration double")
    medians = route_medians(df.where("role = 'train'"), ["route"])
    out = enrich.with_anomaly(df, medians, ["route"]).orderBy("flight_duration")
    assert column(out, "anomaly") == [-10.0, 0.0, 10.0, 890.0, 1890.0, 2890.0]


def test_complete_years(spark):
    days = pd.date_range("2021-01-05", "2022-12-20", freq="20D")
    df = spark.createDataFrame(pd.DataFrame({"route": "r", "firstSeen": days}))
    row = split.fold_counts(df, ["route"]).first()
    assert row.n_folds == 2 and row.complete_years == [2021, 2022]
    part = split.fold_counts(df.where("firstSeen < timestamp '2021-11-01'"), ["route"])
    row = part.select("n_folds", split.infeasible_reason(F.col("n_folds")).alias("why")).first()
    assert row.n_folds == 0 and row.why.startswith("Only 0 complete")


def test_many_populations_in_one_job(spark):
    both = trips(spark, 20).unionByName(trips(spark, 55, 3, "X->Y", 100))
    out = split.chronological_split(both, ["route"], ["firstSeen", "icao24"])
    counts = {(r.route, r.role): r["count"] for r in out.groupBy("route", "role").count().collect()}
    assert counts == {("AAA->BBB", "train"): 16, ("AAA->BBB", "test"): 4, ("X->Y", "train"): 44, ("X->Y", "test"): 11}


def test_null_population_keeps_its_rows(spark):
    both = trips(spark, 20).unionByName(trips(spark, 10, shift=100).withColumn("route", F.lit(None).cast("string")))
    out = split.chronological_split(both, ["route"], ["firstSeen", "icao24"])
    counts = {(r.route, r.role): r["count"] for r in out.groupBy("route", "role").count().collect()}
    assert counts == {("AAA->BBB", "train"): 16, ("AAA->BBB", "test"): 4, (None, "train"): 8, (None, "test"): 2}
    plan = both.select("route").distinct().withColumn("n_folds", F.lit(2))
    assert split.fold_segments(both, ["route"], ["firstSeen", "icao24"], plan).count() == 30
