from pyspark.sql import functions as F

from aeroquant.streaming import ingest
from helpers import column

SCHEMA = "icao24 string, firstSeen timestamp, lastSeen timestamp, callsign string"


def land(spark, path, ids, name):
    df = spark.createDataFrame([(i,) for i in ids], "id int").select(
        F.col("id").cast("string").alias("icao24"), F.timestamp_seconds(F.col("id") * 60).alias("firstSeen"),
        F.timestamp_seconds(F.col("id") * 60 + 3600).alias("lastSeen"), F.lit(name).alias("callsign"))
    df.coalesce(1).write.mode("append").parquet(path)


def test_later_run_continues_and_drops_copies(spark, tmp_path):
    src, home = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, [1, 2, 2], "first")
    run = lambda: ingest.run_available(ingest.dedup(ingest.read_files(spark, src, SCHEMA)), "t", home)
    assert sorted(column(run(), "icao24")) == ["1", "2"]
    land(spark, src, [2, 3], "second")
    out = run()
    assert sorted(column(out, "icao24")) == ["1", "2", "3"]
    assert out.where("icao24 = '2'").first().callsign == "first"
    assert run().count() == 3


def test_row_older_than_the_watermark_is_dropped(spark, tmp_path):
    src, home = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: ingest.run_available(ingest.dedup(ingest.read_files(spark, src, SCHEMA), "1 hour"), "t", home)
    land(spark, src, [100_000], "new")
    run()
    land(spark, src, [1, 100_001], "old")
    assert sorted(column(run(), "icao24")) == ["100000", "100001"]
