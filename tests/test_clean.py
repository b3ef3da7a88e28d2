import pytest
from pyspark.sql import functions as F

from aeroquant.operators import clean, gates
from aeroquant.schemas import FLIGHT_KEY
from helpers import column, seconds

SCHEMA = "icao24 string, firstSeen timestamp, lastSeen timestamp, estDepartureAirport string, estArrivalAirport string, callsign string"


def flights(spark, rows):
    return spark.createDataFrame(
        [(i, None if a is None else seconds(a), None if b is None else seconds(b), d, "LGTS", c) for i, a, b, d, c in rows], SCHEMA
    )


def test_sanity_filter(spark):
    rows = [("ok", 0, 600, "A", "x"), ("long", 0, 301 * 60, "A", "x"), ("edge", 0, 300 * 60, "A", "x"), ("none", None, 600, "A", "x"),
            ("dep", 0, 600, None, "x"), ("five", 0, 300, "A", "x"), ("four", 0, 240, "A", "x"), ("six", 0, 301, "A", "x")]
    assert sorted(column(clean.sanity_filter(flights(spark, rows)), "icao24")) == ["edge", "ok", "six"]


def test_outliers_keep_missing_for_the_gate(spark):
    df = spark.createDataFrame([(241.0,), (240.0,), (0.0,), (float("nan"),), (None,)], "flight_duration double")
    kept = clean.drop_outliers(df)
    assert kept.count() == 4
    report = {r.gate: r.n_bad for r in gates.row_report(kept, {"finite": gates.bad_finite(), "positive": gates.bad_positive()}).collect()}
    assert report == {"finite": 2, "positive": 1}


def test_infinite_length_is_an_outlier(spark):
    df = spark.createDataFrame([(float("inf"),), (10.0,)], "flight_duration double")
    assert clean.drop_outliers(df).count() == 1


def test_stored_row_wins(spark):
    stored = flights(spark, [("a", 0, 600, "A", "old")])
    new = flights(spark, [("a", 0, 600, "A", "aaa"), ("b", 0, 600, "A", "new"), ("b", 0, 600, "A", "abc")])
    merged = clean.merge_flights(stored, new)
    assert {r.icao24: r.callsign for r in merged.collect()} == {"a": "old", "b": "abc"}


def test_merge_same_rows_twice(spark):
    one = flights(spark, [("a", 0, 600, "A", "x")])
    assert clean.merge_flights(one, one).count() == 1


def test_merge_without_keys_compares_rows(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "x int, y int")
    assert clean.merge_keep_first(a, a, ["icao24"], []).count() == 2


def test_append_new_leaves_stored_alone(spark):
    stored = flights(spark, [("a", 0, 600, "A", "old")])
    new = flights(spark, [("a", 0, 600, "A", "n"), ("b", 0, 600, "A", "n"), ("b", 0, 600, "A", "m")])
    out = clean.append_new(stored, new, ["icao24", "firstSeen", "lastSeen"], ["callsign"])
    assert [(r.icao24, r.callsign) for r in out.collect()] == [("b", "m")]
    unnamed = flights(spark, [(None, 0, 600, "A", "x")])
    assert clean.append_new(unnamed, unnamed, ["icao24", "firstSeen", "lastSeen"], ["callsign"]).count() == 0


def test_hot_group_of_copies(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"), F.lit("p").alias("p")
    ).repartition(16)
    out = clean.keep_first(df, ["k"], ["o"])
    assert out.count() == 20_001 and out.where("k = 0").first().o == 0


def test_weather_merge_keeps_three(spark):
    rows = lambda hours: spark.createDataFrame([(seconds(3600 * h), "A", float(h)) for h in hours], "time timestamp, airport string, v double")
    out = clean.merge_weather(rows([1, 0]), rows([0, 24])).orderBy("time", "airport")
    assert column(out, "v") == [0.0, 1.0, 24.0]


def test_union_aligns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2.0)], "b string, c double")
    out = clean.union_by_name(a, b)
    assert out.columns == ["a", "b", "c"] and out.where("a is null").first().c == 2.0


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None, 1, None), (1.0, 2.0, 1, None), (None, 3.0, 1, None)], "a double, b double, month int, d double")
    found = {r["column"]: r["is_constant"] for r in clean.constant_columns(df, df.columns).collect()}
    assert found == {"a": True, "b": False, "month": False, "d": True}
    assert clean.drop_constant_columns(df, df.columns).columns == ["b", "month"]


def test_gate_time_order(spark):
    df = flights(spark, [("z", 5, 5, "A", "x"), ("n", 9, 5, "A", "x"), ("v", 0, 9, "A", "x")])
    with pytest.raises(gates.GateError, match="found 2 rows"):
        gates.enforce_rows(df, {"time_order": gates.bad_time_order()}, ["icao24"])


def test_gate_duplicates(spark):
    same = flights(spark, [("a", 0, 600, "A", "x"), ("a", 0, 600, "A", "y")])
    with pytest.raises(gates.GateError, match="found 2 duplicated"):
        gates.enforce_unique(same, FLIGHT_KEY, "duplicates")
    with pytest.raises(gates.GateError, match="found 1 duplicated"):
        gates.enforce_unique(same, FLIGHT_KEY, "join_fanout", extra_only=True)
    gates.enforce_unique(flights(spark, [("a", 0, 600, "A", "x"), ("a", 700, 900, "A", "y")]), FLIGHT_KEY, "duplicates")


def test_gate_unparsed_times(spark):
    df = flights(spark, [("a", None, 600, "A", "x"), ("b", 0, 600, "A", "x")])
    with pytest.raises(gates.GateError, match="contains 1 values"):
        gates.enforce_parsed(df, ["firstSeen"])


def test_observed_gates_ride_on_the_write(spark, tmp_path):
    df = flights(spark, [("z", 5, 5, "A", "x"), ("v", 0, 9, "A", "x")])
    watched, seen = gates.observe_gates(df, {"time_order": gates.bad_time_order()}, "watch")
    watched.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"time_order": 1}


def test_period_outliers(spark):
    df = spark.sql("""select timestamp '2025-05-01' firstSeen, 400d flight_duration union all
                      select timestamp '2025-07-01', 301d union all select timestamp '2025-07-02', 400d union all
                      select timestamp '2025-05-01', 300d""")
    assert sorted(column(clean.drop_outliers_between(df), "flight_duration")) == [300.0, 400.0]


def test_route_tag_and_fallback(spark):
    df = flights(spark, [("a", 0, 600, "EDDF", "x"), ("b", 0, 600, "EGLL", "x")])
    routes = spark.createDataFrame([("EDDF", "LGTS")], "origin string, destination string")
    out = clean.on_routes(df, routes).first()
    assert (out.route, out.destination_airport) == ("EDDF->LGTS", "LGTS")
    assert column(clean.ensure_route(df), "route") == ["EDDF_LGTS", "EGLL_LGTS"]
