"""File arrival as a stream: de-duplication and weather enrichment.

Unlike the batch merge, which accepts rows of any age, the stream drops rows
older than its watermark, so its state stays bounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroquant.functions import text, times
from aeroquant.operators.enrich import join_weather, weather_lookup
from aeroquant.schemas import MERGE_KEY
from aeroquant.session import checkpoint_dir, settle

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str = "*.parquet",
               files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def dedup(flights: DataFrame, delay: str = "2 days", time: str = "firstSeen", keys: Sequence[str] = MERGE_KEY) -> DataFrame:
    """One row per flight among rows at most ``delay`` apart in arrival."""
    return flights.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def enrich(flights: DataFrame, weather: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Departure and arrival weather from a static table; every flight stays.

    The lookup is stored once, not computed again in every micro-batch.
    """
    lookup = settle(weather_lookup(weather, columns))
    prepared = flights.withColumns({
        "dep_merge_key": times.round_hour(F.col("firstSeen")),
        "arr_merge_key": times.round_hour(F.col("lastSeen")),
        "airline": text.airline_code(F.col("callsign")),
    })
    at_departure = join_weather(prepared, lookup, "estDepartureAirport", "dep_merge_key", "dep_", columns)
    return join_weather(at_departure, lookup, "estArrivalAirport", "arr_merge_key", "arr_", columns)


def run_available(stream: DataFrame, name: str, path: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Process all files that have arrived, then return the stored result.

    Offsets, state and output lie in the shared folder. A named ``path`` makes
    later runs continue where this one stopped.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    home = path or f"{checkpoint_dir(spark)}/aeroquant/stream-{name}-{uuid.uuid4().hex}"
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{home}/state")
        .trigger(availableNow=True)
    )
    if by:
        writer = writer.partitionBy(*by)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        writer.start(f"{home}/data").awaitTermination()
    finally:  # the caller's other streams keep their own store
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{home}/data")
