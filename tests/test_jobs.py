"""The jobs as a user starts them, from landed files to stored tables."""

from pyspark.sql import functions as F

from aeroquant.__main__ import main
from aeroquant.schemas import FEATURES, WEATHER
from aeroquant.sources.landed import ARRIVAL_SCHEMA


def test_update_then_features_then_baseline(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    start = 1704877200
    ids = spark.range(40)
    arrivals = ids.select(
        F.concat(F.lit("a"), F.col("id")).alias("icao24"), (F.lit(start) + F.col("id") * 600).alias("firstSeen"),
        F.lit("EDDF").alias("estDepartureAirport"), (F.lit(start) + F.col("id") * 660 + 6000).alias("lastSeen"),
        F.lit("LGTS").alias("estArrivalAirport"), F.lit("AEE12").alias("callsign"),
        *[F.lit(1.0).alias(f.name) for f in ARRIVAL_SCHEMA.fields if f.name.endswith("Distance")],
        *[F.lit(1).alias(f.name) for f in ARRIVAL_SCHEMA.fields if f.name.endswith("Count")],
    )
    arrivals.write.parquet(p("landed"))
    spark.createDataFrame([("EDDF", "LGTS")], "origin string, destination string").write.parquet(p("routes"))
    hours = spark.range(-1, 15).select(F.timestamp_seconds(F.lit(start) + F.col("id") * 3600).alias("time"))
    weather = hours.crossJoin(spark.createDataFrame([("EDDF",), ("LGTS",)], "airport string"))
    weather.select("airport", "time", *[F.lit(1.0).alias(c) for c in WEATHER]).write.parquet(p("hours"))

    for _ in range(2):  # the same batch twice changes nothing
        main(["update", "--arrivals", p("landed"), "--routes", p("routes"), "--weather", p("hours"), "--out", p("t")])
    main(["features", "--flights", p("t/flights"), "--weather", p("t/weather"), "--out", p("features"), "--stats", p("log")])
    main(["baseline", "--features", p("features"), "--out", p("base")])

    features = spark.read.parquet(p("features"))
    assert features.count() == 40 and set(features.columns) == set(FEATURES)
    row = spark.read.parquet(p("base")).first()
    assert (row.route, row.airline, row.n, row.p50) == ("EDDF->LGTS", "AEE", 40, 0.0)
    assert spark.read.json(p("log")).first().n_rows == 40
