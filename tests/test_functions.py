import math

import pytest
from pyspark.sql import functions as F

from aeroquant.functions import numbers, text, times
from helpers import column, utc


@pytest.mark.parametrize("callsign, expected", [
    ("AEE1421", "AEE"), ("AEE1421 ", "AEE"), ("thy1zc", "THY"), ("\t dlh9\n", "DLH"), ("ABCDE1", "ABCD"),
    (None, None), ("", None), ("   ", None), ("nan", None), (" NaN ", None), ("12345", None), ("A1", None),
])
def test_airline_code(spark, callsign, expected):
    df = spark.createDataFrame([(callsign,)], "c string")
    assert df.select(text.airline_code(F.col("c"))).first()[0] == expected


def test_airline_label(spark):
    df = spark.createDataFrame([("AEE",), ("ZZZ",), (None,)], "c string")
    assert column(df.select(text.airline_label(F.col("c")).alias("l")), "l") == [
        "Aegean Airlines", "Unmapped carrier (ZZZ)", "Unknown carrier"
    ]


@pytest.mark.parametrize("at, hour", [
    ("2024-01-10 08:30", 8), ("2024-01-10 09:30", 10), ("2024-01-10 10:30", 10), ("2024-01-10 10:31", 11),
    ("2024-01-10 10:29:59.999999", 10), ("1969-12-31 20:30", 20), ("1969-12-31 21:30", 22),
])
def test_round_hour_halves_to_even(spark, at, hour):
    df = spark.sql(f"select timestamp '{at}' t")
    assert df.select(F.hour(times.round_hour(F.col("t")))).first()[0] == hour


def test_round_hour_reaches_next_day(spark):
    df = spark.sql("select timestamp '2024-01-10 23:45' t").select(times.round_hour(F.col("t")).cast("string"))
    assert df.first()[0] == "2024-01-11 00:00:00"


def test_parse_epoch_seconds(spark):
    df = times.normalise_timestamps(spark.createDataFrame([(1704870000,)], "t bigint"), ["t"])
    assert df.select(F.col("t").cast("string")).first()[0] == "2024-01-10 07:00:00"


def test_parse_marks_bad_values(spark):
    df = spark.createDataFrame([("2024-01-10 09:00:00", 1.5), ("not a time", float("nan"))], "a string, b double")
    out = times.normalise_timestamps(df, ["a", "b"]).collect()
    assert out[0]["a"] is not None and out[1]["a"] is None
    assert out[0]["b"] is not None and out[1]["b"] is None


def test_epoch_units_by_magnitude(spark):
    at = 1704870000
    df = spark.createDataFrame([(at,), (at * 10**3,), (at * 10**6,), (at * 10**9,), (None,)], "n bigint")
    out = column(df.select(F.unix_seconds(times.epoch_to_timestamp(F.col("n"))).alias("s")), "s")
    assert out == [at, at, at, at, None]


def test_duration_is_exact_to_microseconds(spark):
    df = spark.sql("select timestamp '2024-01-01 00:00:00' a, timestamp '2024-01-01 00:00:30.000006' b")
    assert df.select(times.duration_minutes(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5000001)


def test_chunk_windows(spark):
    df = spark.sql("select date '2024-01-01' a, date '2024-01-05' b union all select date '2024-01-03', date '2024-01-01'")
    rows = times.chunk_windows(df, "a", "b", 2).orderBy("chunk_start").collect()
    assert [(str(r.chunk_start), str(r.chunk_end)) for r in rows] == [
        ("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-04"), ("2024-01-05", "2024-01-05")
    ]
    assert rows[0].begin_unix == 1704067200 and rows[0].end_unix == 1704067200 + 86400 + 23 * 3600 + 59 * 60


def test_keys(spark):
    df = spark.createDataFrame([("a/b:c", "EDDF->LGTS")], "k string, r string")
    assert tuple(df.select(text.safe_key(F.col("k")), text.route_to_key(F.col("r"))).first()) == ("a-b-c", "EDDF_LGTS")


def test_labels(spark):
    df = spark.sql("select timestamp '2026-08-01' t, 9 h")
    assert tuple(df.select(times.month_label(F.col("t")), times.hour_label(F.col("h"))).first()) == ("Aug", "09:00")


def test_numbers(spark):
    rows = [(-100.0,), (0.0,), (1.0,), (float("nan"),), (float("inf"),), (None,)]
    df = spark.createDataFrame(rows, "x double")
    assert column(df.select(numbers.is_finite(F.col("x")).alias("y")), "y") == [True, True, True, False, False, False]
    assert column(df.select(numbers.clip(F.col("x"), -60, 60).alias("y")), "y")[:3] == [-60, 0, 1]
    assert column(df.select(numbers.signed_log(F.col("x")).alias("y")), "y")[0] == pytest.approx(-math.log1p(100))
    assert column(df.select(numbers.impute(F.col("x"), F.lit(7.0)).alias("y")), "y")[3:] == [7.0, float("inf"), 7.0]
    assert column(df.select(numbers.impute(F.col("x"), F.lit(None).cast("double")).alias("y")), "y")[5] == 0.0
    assert column(numbers.clean_nan(df), "x")[3] is None


def test_buffer_card(spark):
    df = spark.createDataFrame([(120.0, -3.2), (None, 12.5), (100.0, 0.5)], "m double, a double")
    card = numbers.buffer_card(F.col("m"), F.col("a"))
    rows = df.select(card["total_min"].alias("t"), card["delta_label"].alias("d")).collect()
    assert [tuple(r) for r in rows] == [
        (117, "-3 min vs. median"), (12, "+12 min vs. median"), (100, "+0 min vs. median")
    ]


def test_quantile_label(spark):
    df = spark.createDataFrame([(0.5,), (0.9,), (0.95,), (0.75,)], "q double")
    assert column(df.select(numbers.quantile_label(F.col("q")).alias("l")), "l") == [
        "Typical (P50)", "Cautious (P90)", "Safe (P95)", "P75"
    ]


def test_to_unix(spark):
    df = spark.sql("select date '2024-01-10' d")
    assert df.select(times.to_unix(F.col("d"), 23, 59)).first()[0] == int(utc("2024-01-10 23:59").timestamp())
