import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeroquant.operators import enrich, gates
from aeroquant.plans import features
from aeroquant.schemas import FEATURES, FLIGHT_SCHEMA, WEATHER, SchemaError
from helpers import column, seconds

T0 = 1704877200  # 2024-01-10 09:00 UTC


def raw(spark, rows):
    full = [(i, seconds(a), "EDDF", seconds(b), "LGTS", c, 100.0, 10.0, 150.0, 15.0, 1, 1, "LGTS", "EDDF->LGTS") for i, a, b, c in rows]
    return spark.createDataFrame(full, FLIGHT_SCHEMA)


def weather(spark, hours, columns=WEATHER, airports=("EDDF", "LGTS")):
    rows = [(a, seconds(T0 + 3600 * h), *[float(h + i) for i in range(len(columns))]) for a in airports for h in hours]
    return spark.createDataFrame(rows, "airport string, time timestamp, " + ", ".join(f"{c} double" for c in columns))


def test_feature_table_has_the_fixed_columns(spark):
    out = features.checked_feature_matrix(raw(spark, [("a", T0, T0 + 7200, "AEE1421")]), weather(spark, range(-1, 5)))
    row = out.first()
    assert out.columns == FEATURES and len(FEATURES) == 53
    assert (row.airline, row.flight_duration, row.hour_of_day, row.month) == ("AEE", 120.0, 9, 1)
    assert (row.dep_temperature_2m, row.arr_temperature_2m) == (0.0, 2.0)
    assert str(row.flight_date_parsed) == "2024-01-10"


def test_join_keeps_every_flight(spark):
    flights = raw(spark, [(str(i), T0 + 60 * i, T0 + 60 * i + 6000, "AEE1") for i in range(50)])
    out = features.feature_matrix(flights, weather(spark, [0]))
    assert out.count() == 50 and out.where("dep_cape is null").count() > 0


@pytest.mark.parametrize("change, message", [
    (dict(callsign="123"), "not_null"), (dict(hours=[0]), "weather_complete"), (dict(columns=WEATHER[:-1]), "weather_complete"),
    (dict(last=-60), "time_order"), (dict(twice=True), "duplicates"), (dict(hours=[0, 0, 1, 2]), "weather_key"),
])
def test_gates_stop_bad_tables(spark, change, message):
    rows = [("a", T0, T0 + change.get("last", 7200), change.get("callsign", "AEE1"))] * (2 if change.get("twice") else 1)
    w = weather(spark, change.get("hours", range(4)), change.get("columns", WEATHER))
    with pytest.raises(gates.GateError, match=message):
        features.checked_feature_matrix(raw(spark, rows), w)


def test_missing_input_columns_are_all_named(spark):
    with pytest.raises(SchemaError, match="callsign.*route"):
        features.prepare_flights(raw(spark, []).drop("callsign", "route"))


def test_nearest_hour(spark):
    w = spark.createDataFrame([("A", seconds(3600 * h), 2.0 * h) for h in (10, 11, 12)], "airport string, time timestamp, v double")
    p = spark.createDataFrame([("A", seconds(3600 * 10 + 2400)), ("A", seconds(3600 * 10 + 1800)), ("A", seconds(10**6)), ("B", seconds(0))],
                              "airport string, t timestamp")
    out = enrich.nearest_in_time(p, w, ["airport"], "t", "time", ["v"]).orderBy("airport", "t")
    assert column(out, "near_v") == [20.0, 22.0, 24.0, None]


@pytest.mark.parametrize("bucket", [60, 3600, 86400])
def test_nearest_equals_brute_force(spark, bucket):
    rng = np.random.default_rng(3)
    w = pd.DataFrame({"k": rng.choice(list("ab"), 60), "s": np.sort(rng.choice(400_000, 60, replace=False))})
    p = pd.DataFrame({"k": rng.choice(list("abc"), 300), "s": rng.integers(-50_000, 450_000, 300), "id": range(300)})
    wide = lambda d: spark.createDataFrame(d).withColumn("t", F.timestamp_seconds("s")).drop("s")
    series = wide(w).withColumn("v", F.unix_seconds("t"))
    out = enrich.nearest_in_time(wide(p), series, ["k"], "t", "t", ["v"], bucket_seconds=bucket).toPandas().set_index("id").near_v
    for r in p.itertuples():
        own = w[w.k == r.k].s.to_numpy()
        if not len(own):
            assert pd.isna(out[r.id])
            continue
        gaps = np.abs(own - r.s)
        assert out[r.id] == own[gaps == gaps.min()].min()


def test_unseen_carrier_takes_the_fallback(spark):
    mapping = spark.createDataFrame([("A", 1.0)], "airline string, v double")
    fallback = spark.createDataFrame([(9.0,)], "v double")
    rows = spark.createDataFrame([("A",), ("Z",), (None,)], "airline string")
    assert sorted(column(enrich.encode(rows, mapping, fallback, [], "airline", "v", "e"), "e")) == [1.0, 9.0, 9.0]


def test_airport_info(spark):
    table = lambda rows: spark.createDataFrame(rows, "airport string, name string, tz string")
    origins, destinations = table([("LGAV", "from", "x")]), table([("LGAV", "to", "y"), ("LGTS", "to", None)])
    ask = lambda *codes: spark.createDataFrame([(c,) for c in codes], "airport string")
    out = enrich.airport_info(ask("LGAV", "LGTS"), origins, destinations)
    assert {r.airport: r.name for r in out.collect()} == {"LGAV": "from", "LGTS": "to"}
    with pytest.raises(Exception, match="unknown airport XXXX"):
        enrich.airport_info(ask("XXXX"), origins, destinations).collect()


def test_tier_fallback(spark):
    trained = spark.createDataFrame([("r", "all_carriers"), ("r", "AEE")], "route string, tier string")
    asked = spark.createDataFrame([("r", "AEE"), ("r", "DLH"), ("r", None), ("s", "AEE")], "route string, airline string")
    out = enrich.select_tier(asked, trained)
    assert {(r.route, r.airline): r.tier for r in out.collect()} == {
        ("r", "AEE"): "AEE", ("r", "DLH"): "all_carriers", ("r", None): "all_carriers", ("s", "AEE"): None
    }


def test_text_hours_keep_the_first_reading(spark):
    w = spark.createDataFrame([("EDDF", seconds(T0 + 60), 2.0), ("EDDF", seconds(T0), 1.0), ("LGTS", seconds(T0 + 7200), 5.0)],
                              "airport string, time timestamp, v double")
    out = enrich.join_by_text_hour(raw(spark, [("a", T0, T0 + 7200, "AEE1")]), w, ["v"], ["v"]).first()
    assert (out.dep_v, out.arr_v, out.dep_merge_key) == (1.0, 5.0, "2024-01-10 09:00")
