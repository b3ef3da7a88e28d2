import pytest
from pyspark.sql import functions as F

from aeroquant.operators import incremental
from helpers import column, utc

ARRIVAL = "data/raw/EDDF_LGTS/arrivals/arrivals_LGTS_2026-09-0{}_2026-09-0{}.parquet"
WEATHER = "data/raw/weather_hist_chunks/{0}/{0}_2026-09-01_2026-09-0{1}.parquet"


def paths(spark, *items):
    return spark.createDataFrame([(p,) for p in items], "path string")


@pytest.fixture(scope="module")
def route(spark):
    return spark.createDataFrame([("EDDF", "LGTS")], "origin string, destination string")


def test_remote_dates(spark, route):
    p = paths(spark, ARRIVAL.format(1, 5), ARRIVAL.format(6, 7).replace("/", "\\"), WEATHER.format("EDDF", 6),
              WEATHER.format("LGTS", 4), "data/raw/other.txt", "x/" + ARRIVAL.format(8, 9))
    row = incremental.remote_dates(route, p).first()
    assert (str(row.last_flight_date), str(row.last_weather_date)) == ("2026-09-07", "2026-09-06")


def test_remote_dates_with_nothing_stored(spark, route):
    row = incremental.remote_dates(route, paths(spark, "data/raw/other.txt")).first()
    assert row.last_flight_date is None and row.last_weather_date is None


@pytest.mark.parametrize("flight, weather, stale", [
    ("2026-09-09", "2026-09-09", False), ("2026-09-08", "2026-09-09", True), (None, "2026-09-09", True), ("2026-09-09", None, True),
])
def test_freshness(spark, flight, weather, stale):
    df = spark.createDataFrame([("r", flight, weather)], "route string, f string, w string").select(
        "route", F.col("f").cast("date").alias("last_flight_date"), F.col("w").cast("date").alias("last_weather_date"))
    assert incremental.needs_update(df, incremental.as_of("2026-09-10")).first().needs_update is stale


def test_last_chunk_date_skips_malformed_names(spark):
    names = ["arrivals_LGTS_2026-08-14_2026-08-15.parquet", "arrivals_LGTS_2026-08-16_bad.parquet", "arrivals_LGTS.parquet",
             "arrivals_LGTS_2026-08-20_2026-08-20.csv", "other_LGTS_2026-08-20_2026-08-20.parquet", "arrivals_LGTS_2026-08-14_2026-13-45.parquet"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [(r.airport, str(r.last_date)) for r in incremental.last_chunk_dates(df).collect()] == [("LGTS", "2026-08-15")]


def test_last_flight_date_takes_the_later(spark):
    f = spark.createDataFrame([("r", 1_700_000_000), ("r", 1_700_100_000)], "route string, s bigint").select(
        "route", F.timestamp_seconds("s").alias("firstSeen"))
    assert str(incremental.last_flight_dates(f).first().last_flight_date) == "2023-11-16"
    chunks = spark.sql("select 'r' route, date '2026-08-15' last_date")
    assert str(incremental.last_flight_dates(f, chunks).first().last_flight_date) == "2026-08-15"


def dates(spark, flight, weather):
    return spark.createDataFrame([("r", flight, weather)], "route string, f string, w string").select(
        "route", F.col("f").cast("date").alias("last_flight_date"), F.col("w").cast("date").alias("last_weather_date"))


@pytest.mark.parametrize("flight, weather, start, status", [
    ("2026-08-18", "2026-08-20", "2026-08-19", "update"), (None, "2026-08-20", "2026-08-21", "update"),
    (None, None, "None", "full_backfill"), ("2026-08-21", "2026-08-22", "2026-08-22", "already_up_to_date"),
])
def test_resume_range(spark, flight, weather, start, status):
    row = incremental.resume_ranges(dates(spark, flight, weather), incremental.as_of("2026-08-21")).first()
    assert (str(row.resume_from), str(row.resume_to), row.status) == (start, "2026-08-21", status)


def test_fetched_through_is_the_earlier(spark):
    assert str(incremental.fetched_through(dates(spark, "2026-08-21", "2026-08-20")).first().fetched_through) == "2026-08-20"


@pytest.mark.parametrize("failed, force, waits", [
    ("2026-08-20 00:00:01", False, True), ("2026-08-19 00:00:00", False, False), ("2026-08-20 12:00:00", True, False), (None, False, False),
])
def test_backoff(spark, failed, force, waits):
    df = spark.createDataFrame([("r", failed)], "route string, t string").select("route", F.col("t").cast("timestamp").alias("last_failure_utc"))
    row = incremental.runnable(df, F.lit("2026-08-21").cast("timestamp"), force).first()
    assert row.in_backoff is waits and (row.retry_at is not None) == waits


def test_control_upsert_and_stage_plan(spark):
    schema = "route string, stage string, status string, updated_utc timestamp, error string"
    old = spark.createDataFrame([("r", "flights", "failed", utc("2026-01-01"), "x"), ("r", "weather", "success", utc("2026-01-01"), None)], schema)
    new = spark.createDataFrame([("r", "flights", "success", utc("2026-01-02"), None)], schema)
    out = {r.stage: (r.status, r.error) for r in incremental.upsert_control(old, new).collect()}
    assert out == {"flights": ("success", None), "weather": ("success", None)}
    plan = spark.createDataFrame([("a", "success", "failed"), ("b", "failed", "success"), ("c", "success", "success")],
                                 "route string, flights_status string, weather_status string")
    got = {r.route: (r.weather_status, r.status) for r in incremental.stage_plan(plan).collect()}
    assert got == {"a": ("failed", "failed"), "b": ("not_attempted", "failed"), "c": ("success", "success")}


def test_run_summary(spark):
    df = spark.createDataFrame([(s,) for s in ("success", "failed", "skipped_backoff", "already_up_to_date")], "status string")
    assert tuple(incremental.run_summary(df).first()) == (2, 1, 1, 4)


def test_missing_chunks(spark):
    owners = spark.sql("select 'A' airport, date '2024-01-01' a, date '2024-01-05' b")
    expected = incremental.expected_chunks(owners, "a", "b", 2)
    have = spark.sql("select 'A' airport, date '2024-01-03' chunk_start, date '2024-01-04' chunk_end")
    out = incremental.missing_chunks(expected, have, "airport")
    assert sorted(str(d) for d in column(out, "chunk_start")) == ["2024-01-01", "2024-01-05"]
