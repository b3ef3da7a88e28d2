"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from aeroquant.operators import clean, quantiles
from aeroquant.plans import basics
from aeroquant.sources import tables

SF = "/root/testdata/sf0.001"
JOINING = [
    "baseline_quantiles", "carrier_baseline", "feature_matrix", "dep_arr_weather_join", "string_key_join", "nearest_weather",
    "target_encode", "impute_apply", "qcut_bins", "histogram_all", "metric_bundle", "missing_chunks", "path_inventory_max_date",
    "stage_stats_upsert", "tier_select", "route_filter",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINING)
def test_no_cross_product_and_no_row_udf(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_time_filter_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["scan_events"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(ts", text)
    assert "user_id" not in re.search(r"ReadSchema: \S+", text).group(0)


def test_comparison_of_a_double_reaches_the_scan(spark):
    text = plan(entry.queries()["scan_large_values"](spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(value,100", text)


def test_copies_shrink_before_the_shuffle(spark):
    df = tables.table(spark, SF, "lineitem")
    text = plan(clean.keep_first(df, ["l_orderkey", "l_linenumber"], ["l_shipdate"]))
    assert text.count("min_by") >= 2 and "partial_min_by" in text and "Window" not in text


def test_split_does_not_shuffle_the_rows(spark):
    """Rows only meet a small stored table; no exchange of the wide side."""
    rows = basics.sane(spark, SF)
    from aeroquant.operators import split

    text = plan(split.chronological_split(rows, ["route"], tables.FLIGHT_ORDER))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_counts_of_equal_values_are_partial(spark):
    rows = basics.sane(spark, SF)
    text = plan(quantiles.exact_quantiles(rows, ["route"], "flight_duration", [0.5]))
    assert "partial_count(1)" in text


def test_large_lookup_is_not_broadcast(spark):
    """Without a broadcast hint the size threshold decides."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(entry.queries()["feature_matrix"](spark, SF))
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_few_partitions_and_many_agree(spark):
    q = entry.queries()["baseline_quantiles"]
    rows = lambda: sorted(map(tuple, q(spark, SF).collect()))
    first = rows()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_queries_read_the_given_tables(spark):
    """Ten times the scale gives more, or other, rows: nothing runs on fixed input."""
    for name in ("baseline_quantiles", "chrono_split", "feature_gate_report"):
        q = entry.queries()[name]
        small, large = (sorted(map(str, q(spark, d).collect())) for d in (SF, "/root/testdata/sf0.01"))
        assert small and small != large


@pytest.mark.parametrize("name", [
    "walkforward_folds", "fold_target_encode", "walkforward_baseline", "fold_roles", "tier_report", "fold_anomaly", "preprocess_apply",
    "airline_quantiles", "impute_medians", "histogram_by_month",
])
def test_the_history_is_joined_once(spark, monkeypatch, name):
    """What reads the history several times reads it stored; its wide rows are shuffled once."""
    from aeroquant.plans import catalog

    made, real = [], tables.history
    monkeypatch.setattr(tables, "history", lambda *a: made.append(real(*a)) or made[-1])
    seen = []
    store = tables.cut_lineage
    monkeypatch.setattr(tables, "cut_lineage", lambda df, *a: seen.append(df) or store(df, *a))
    out = catalog.QUERIES[name](spark, SF)
    assert len(made) == len(seen) == 1
    assert "lineitem" not in out._jdf.queryExecution().optimizedPlan().toString() and "orders.parquet" not in plan(out)
