import pytest
from pyspark.sql import functions as F

from aeroquant.plans import scoring, training, update
from aeroquant.schemas import WEATHER
from aeroquant.sources.landed import ARRIVAL_SCHEMA
from helpers import column, seconds


def arrivals(spark, rows):
    full = [(i, a, d, b, "LGTS", c, 1.0, 1.0, 1.0, 1.0, 1, 1) for i, a, b, d, c in rows]
    return spark.createDataFrame(full, ARRIVAL_SCHEMA)


def test_flight_table_grows_and_keeps_stored_rows(spark, tmp_path):
    path = str(tmp_path / "flights")
    routes = spark.createDataFrame([("EDDF", "LGTS")], "origin string, destination string")
    run = lambda rows: update.update_flights(spark, arrivals(spark, rows), routes, path)
    run([("a", 0, 6000, "EDDF", "old"), ("x", 0, 6000, "EGLL", "other"), ("s", 0, 60, "EDDF", "short")])
    before = spark.read.parquet(path).count()
    files = sorted(p.name for p in (tmp_path / "flights" / "flight_date=1970-01-01").iterdir() if p.suffix == ".parquet")
    run([("b", 90_000, 96_000, "EDDF", "new")])
    assert files == sorted(p.name for p in (tmp_path / "flights" / "flight_date=1970-01-01").iterdir() if p.suffix == ".parquet")
    run([("a", 0, 6000, "EDDF", "again"), ("c", 60, 6000, "EDDF", "c")])
    assert run([("s", 0, 60, "EDDF", "short")]) is None
    out = spark.read.parquet(path)
    assert before == 1 and {r.icao24: r.callsign for r in out.collect()} == {"a": "old", "b": "new", "c": "c"}
    assert set(column(out, "route")) == {"EDDF->LGTS"}


def test_a_flight_on_two_routes_stays_in_both(spark, tmp_path):
    path = str(tmp_path / "flights")
    routes = spark.createDataFrame([("EDDF", "LGTS"), ("EDDM", "LGTS")], "origin string, destination string")
    update.update_flights(spark, arrivals(spark, [("a", 0, 6000, "EDDF", "x"), ("a", 0, 6000, "EDDM", "x")]), routes, path)
    assert sorted(column(spark.read.parquet(path), "route")) == ["EDDF->LGTS", "EDDM->LGTS"]


def test_a_damaged_stored_file_stops_the_update(spark, tmp_path):
    path = tmp_path / "flights"
    routes = spark.createDataFrame([("EDDF", "LGTS")], "origin string, destination string")
    update.update_flights(spark, arrivals(spark, [("a", 0, 6000, "EDDF", "x"), ("b", 60, 6000, "EDDF", "y")]), routes, str(path))
    for part in path.rglob("*.parquet"):
        part.write_bytes(b"damaged")
        part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        update.update_flights(spark, arrivals(spark, [("c", 90, 6000, "EDDF", "z")]), routes, str(path))
    assert [p.read_bytes() for p in path.rglob("*.parquet")] == [b"damaged"] * len(list(path.rglob("*.parquet")))


def land(spark, root, origin, day, rows, broken=False):
    """One arrival chunk of a route, as a fetcher leaves it."""
    path = root / "data" / "raw" / f"{origin}_LGTS" / "arrivals" / f"arrivals_LGTS_{day}_{day}.parquet"
    arrivals(spark, rows).coalesce(1).write.parquet(str(path))
    if broken:
        part = next(path.glob("*.parquet"))
        part.write_bytes(b"damaged")
        part.with_name(f".{part.name}.crc").unlink()


def land_weather(spark, root, airport, day, hours, columns=WEATHER):
    path = root / "data" / "raw" / "weather_hist_chunks" / airport / f"{airport}_{day}_{day}.parquet"
    rows = [(airport, seconds(h), *[1.0] * len(columns)) for h in hours]
    fields = "airport string, time timestamp, " + ", ".join(f"{c} double" for c in columns)
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(str(path))


def test_update_runs_all_routes_with_state(spark, tmp_path):
    """A sound route, a fresh one with a damaged file, one without its weather: outcomes, back-off, resume, log."""
    start, out = 1704844800, str(tmp_path / "out")  # 2024-01-10
    routes = spark.createDataFrame([("EDDF", "LGTS"), ("EDDM", "LGTS"), ("EGLL", "LGTS")], "origin string, destination string")
    landing = tmp_path / "landed"
    trip = lambda name, origin, at=start: (name, at + 3600, at + 9000, origin, "AEE1")
    land(spark, landing, "EDDF", "2024-01-10", [trip("a", "EDDF")])
    land(spark, landing, "EDDM", "2024-01-10", [trip("b", "EDDM")], broken=True)
    land(spark, landing, "EGLL", "2024-01-10", [trip("c", "EGLL")])
    for airport in ("EDDF", "EDDM", "LGTS"):
        land_weather(spark, landing, airport, "2024-01-10", range(start, start + 6 * 3600, 3600))
    land_weather(spark, landing, "EGLL", "2024-01-10", [start], WEATHER[:-1])

    def run(day, hour=12, force=False):
        got = update.update_all(spark, routes, out, str(landing / "data" / "raw"), str(landing / "data" / "raw" / "weather_hist_chunks"),
                                seconds(start + day * 86400 + hour * 3600), force)
        return {r.route[:4]: r for r in got.results.collect()}, tuple(got.summary().first()), got

    # the folder of all chunks holds both kinds; arrivals are told apart by their place
    rows, summary, got = run(0)
    assert {k: (r.status, r.flights_status, r.weather_status) for k, r in rows.items()} == {
        "EDDF": ("success", "success", "success"), "EDDM": ("failed", "failed", "not_attempted"), "EGLL": ("failed", "success", "failed")}
    assert summary == (1, 2, 0, 3) and "unreadable file data/raw/EDDM_LGTS" in rows["EDDM"].error and "incomplete" in rows["EGLL"].error
    assert str(rows["EDDF"].fetched_through) == "2024-01-10" and rows["EDDF"].requested_start is None
    # flights stay stored where only the weather failed
    assert sorted(column(spark.read.parquet(f"{out}/flights"), "icao24")) == ["a", "c"]
    states = {(r.route[:4], r.stage): r.status for r in got.control.collect()}
    assert states["EGLL", "flights"] == "success" and states["EGLL", "run"] == "failed" and ("EDDM", "weather") in states

    # next morning: failed routes wait, the sound one resumes after its last date
    land(spark, landing, "EDDF", "2024-01-11", [trip("d", "EDDF", start + 86400)])
    land_weather(spark, landing, "EDDF", "2024-01-11", [start + 86400])
    rows, summary, _ = run(1, 6)
    assert summary == (1, 0, 2, 3) and str(rows["EDDF"].requested_start) == "2024-01-11"
    assert str(rows["EDDM"].retry_at) == "2024-01-12 12:00:00" and rows["EDDM"].status == "skipped_backoff"
    assert {r.icao24 for r in spark.read.parquet(f"{out}/flights").collect()} == {"a", "c", "d"}
    rows, _, _ = run(1, 7)
    assert rows["EDDF"].status == "already_up_to_date"

    # forced, with mended files, all succeed; nothing is stored twice
    import shutil

    shutil.rmtree(landing / "data" / "raw" / "EDDM_LGTS")
    shutil.rmtree(landing / "data" / "raw" / "weather_hist_chunks" / "EGLL")
    land(spark, landing, "EDDM", "2024-01-10", [trip("b", "EDDM")])
    land_weather(spark, landing, "EGLL", "2024-01-10", [start])
    rows, summary, got = run(1, 8, force=True)
    assert summary == (3, 0, 0, 3) and {r.status for r in rows.values()} == {"success", "already_up_to_date"}
    assert sorted(column(spark.read.parquet(f"{out}/flights"), "icao24")) == ["a", "b", "c", "d"]
    assert got.control.where("status = 'failed'").count() == 0
    assert spark.read.parquet(f"{out}/runs").count() == 12


def test_weather_table_merges_by_hour(spark, tmp_path):
    path = str(tmp_path / "weather")
    hours = lambda pairs: spark.createDataFrame([("A", seconds(3600 * h), v) for h, v in pairs], "airport string, time timestamp, cape double")
    update.update_weather(spark, hours([(1, 1.0), (0, 0.0)]), path)
    update.update_weather(spark, hours([(0, 9.0), (24, 24.0)]), path)
    assert column(spark.read.parquet(path).orderBy("time"), "cape") == [0.0, 1.0, 24.0]


def test_request_takes_each_end_at_its_own_time(spark):
    rows = [(a, seconds(3600 * h), *[float(h + (100 if a == "B" else 0))] * len(WEATHER)) for a in "AB" for h in range(6)]
    forecast = spark.createDataFrame(rows, "airport string, time timestamp, " + ", ".join(f"{c} double" for c in WEATHER))
    asked = spark.createDataFrame([("A", "B", seconds(3700), seconds(3600 * 4 - 60), "AEE")],
                                  "origin string, destination string, departure timestamp, arrival timestamp, airline string")
    row = scoring.request_features(asked, forecast).first()
    assert (row.route, row.hour_of_day, row.dep_cape, row.arr_cape) == ("A->B", 1, 1.0, 104.0)


def test_tiers_of_rows(spark):
    df = spark.createDataFrame([("r", "AEE"), ("r", None)], "route string, airline string")
    assert sorted(column(training.tiered(df), "tier")) == ["AEE", training.POOLED, training.POOLED]
    assert training.tiered(df).where(F.col("airline").isNull()).count() == 1
