"""Incremental load: file inventories, resume ranges, control state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroquant.functions import text
from aeroquant.functions.times import chunk_windows
from aeroquant.sources.sinks import newest_by

# layout of chunk paths (fixed patterns)
ARRIVAL_PATH = (
    r"^data/raw/([A-Z0-9_]+)/arrivals/arrivals_[A-Z0-9]+_"
    r"(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})\.parquet$"
)
WEATHER_PATH = (
    r"^data/raw/weather_hist_chunks/([A-Z0-9]+)/[A-Z0-9]+_"
    r"(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})\.parquet$"
)
BACKOFF_DAYS = 2
OK_STATUSES = ("success", "already_up_to_date")
FAILED, SKIPPED = "failed", "skipped_backoff"


# both layouts at once; the folders before ``data`` of a landed file play no part
_EITHER = f"^(?:{ARRIVAL_PATH[1:-1]}|{WEATHER_PATH[1:-1]})$"
_GROUPS = "A|$1|$2|$3|$4|$5|$6"


def parse_paths(paths: DataFrame, path: str = "path", *keep: str) -> DataFrame:
    """Chunk paths to (kind, owner, chunk_start, chunk_end); others dropped.

    ``owner`` is the route key of an arrival chunk, the airport of a weather one. Each
    path is matched once, against both layouts.
    """
    p = F.translate(path, "\\", "/")
    parts = F.split(F.when(p.contains("data/raw/"), F.regexp_replace(p, _EITHER, _GROUPS)), r"\|")
    matched = paths.select(*keep, parts.alias("_parts")).where((F.size("_parts") == 7) & (F.get("_parts", F.lit(0)) == "A"))
    part = lambda i: F.nullif(F.get("_parts", F.lit(i)), F.lit(""))
    pick = lambda i: F.coalesce(part(i), part(i + 3))
    return matched.select(
        *keep, F.when(part(1).isNotNull(), "arrivals").otherwise("weather").alias("kind"), pick(1).alias("owner"),
        F.try_to_date(pick(2), "yyyy-MM-dd").alias("chunk_start"),
        F.try_to_date(pick(3), "yyyy-MM-dd").alias("chunk_end"),
    )


def landed_path(path: Column) -> Column:
    """The chunk's own path: from ``data/raw`` on, without what lies inside the chunk."""
    return F.regexp_extract(F.translate(path, "\\", "/"), r"(data/raw/.*?\.parquet)", 1)


def newest_chunks(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("kind", "owner").agg(F.max("chunk_end").alias("last_date"))


def remote_dates(routes: DataFrame, paths: DataFrame) -> DataFrame:
    """Last stored dates per route; weather takes the later of both airports."""
    newest = newest_chunks(parse_paths(paths))
    arrivals = newest.where(F.col("kind") == "arrivals").select(
        F.col("owner").alias("route_key"), F.col("last_date").alias("last_flight_date")
    )
    at = newest.where(F.col("kind") == "weather")
    origin = at.select(F.col("owner").alias("origin"), F.col("last_date").alias("_wo"))
    destination = at.select(F.col("owner").alias("destination"), F.col("last_date").alias("_wd"))
    return (
        routes.select("origin", "destination", text.route_key(F.col("origin"), F.col("destination")).alias("route_key"))
        .join(arrivals, "route_key", "left")
        .join(origin, "origin", "left")
        .join(destination, "destination", "left")
        .select("route_key", "last_flight_date", F.greatest("_wo", "_wd").alias("last_weather_date"))
    )


def stale(dates: DataFrame, today: Column) -> DataFrame:
    """Add ``is_stale``: a date is missing or older than yesterday."""
    yesterday = F.date_sub(today, 1)
    old = lambda c: F.col(c).isNull() | (F.col(c) < yesterday)
    return dates.withColumn("is_stale", old("last_flight_date") | old("last_weather_date"))


def needs_update(dates: DataFrame, today: Column) -> DataFrame:
    return stale(dates, today).agg(F.coalesce(F.bool_or("is_stale"), F.lit(False)).alias("needs_update"))


def last_chunk_dates(names: DataFrame, name: str = "name", prefix: str = "arrivals_") -> DataFrame:
    """Newest date per airport from chunk file names; malformed names skipped."""
    n = F.col(name)
    parts = F.split(F.regexp_replace(n, r"\.parquet$", ""), "_")
    day = F.element_at(parts, -1)
    iso = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
    return (
        names.where(n.startswith(prefix) & n.endswith(".parquet") & (F.size(parts) >= 4))
        .select(parts[1].alias("airport"), iso.alias("d"))
        .where(F.col("d").isNotNull())
        .groupBy("airport").agg(F.max("d").alias("last_date"))
    )


def last_flight_dates(flights: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Later of the stored flights and the checked chunks, per route.

    ``chunks`` has route and last_date; a chunk without flights still counts.
    """
    stored = flights.groupBy("route").agg(F.to_date(F.max("firstSeen")).alias("_stored"))
    if chunks is None:
        return stored.withColumnRenamed("_stored", "last_flight_date")
    return stored.join(chunks.withColumnRenamed("last_date", "_chunk"), "route", "full").select(
        "route", F.greatest("_stored", "_chunk").alias("last_flight_date")
    )


def last_weather_dates(weather: DataFrame, routes: DataFrame) -> DataFrame:
    """Newest weather date among the two airports of each route."""
    newest = weather.groupBy("airport").agg(F.to_date(F.max("time")).alias("d"))
    ends = routes.select("route", F.explode(F.array("origin", "destination")).alias("airport"))
    return ends.join(newest, "airport", "left").groupBy("route").agg(F.max("d").alias("last_weather_date"))


def resume_ranges(dates: DataFrame, today: Column) -> DataFrame:
    """Start after the earlier of both sources; null start is a full backfill."""
    earlier = F.least("last_flight_date", "last_weather_date")
    return (
        dates.withColumn("resume_from", F.date_add(earlier, 1))
        .withColumn("resume_to", today)
        .withColumn(
            "status",
            F.when(F.col("resume_from").isNull(), "full_backfill")
            .when(F.col("resume_from") > F.col("resume_to"), "already_up_to_date")
            .otherwise("update"),
        )
    )


def missing_chunks(expected: DataFrame, valid: DataFrame, owner: str) -> DataFrame:
    """Windows still to be fetched: expected ones without a valid chunk."""
    return expected.join(valid, [owner, "chunk_start", "chunk_end"], "left_anti")


def expected_chunks(owners: DataFrame, start: str, end: str, days: int) -> DataFrame:
    return chunk_windows(owners, start, end, days)


def runnable(control: DataFrame, now: Column, force: bool = False, days: int = BACKOFF_DAYS) -> DataFrame:
    """Add ``in_backoff`` and ``retry_at``: routes that failed too recently wait."""
    retry = F.col("last_failure_utc") + F.make_dt_interval(days=F.lit(days))
    waiting = F.coalesce(now < retry, F.lit(False)) & F.lit(not force)
    return control.withColumn("in_backoff", waiting).withColumn("retry_at", F.when(waiting, retry))


def upsert_control(control: DataFrame, updates: DataFrame) -> DataFrame:
    """Newest state per route and stage."""
    return newest_by(control.unionByName(updates), ["route", "stage"], ["updated_utc", "status"])


def fetched_through(dates: DataFrame) -> DataFrame:
    """After a run, data is complete up to the earlier of both sources."""
    return dates.withColumn("fetched_through", F.least("last_flight_date", "last_weather_date"))


def stage_plan(stages: DataFrame) -> DataFrame:
    """Outcome per route: weather is tried only once flights succeeded.

    Flights stay stored when weather fails.
    """
    flights_ok = F.col("flights_status") == "success"
    weather_ok = flights_ok & (F.col("weather_status") == "success")
    return stages.withColumn(
        "weather_status", F.when(flights_ok, F.col("weather_status")).otherwise(F.lit("not_attempted"))
    ).withColumn("status", F.when(weather_ok, "success").otherwise(FAILED))


def run_summary(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.agg(
        F.count_if(s.isin(*OK_STATUSES)).alias("ok"),
        F.count_if(s == FAILED).alias("failed"),
        F.count_if(s == SKIPPED).alias("skipped_backoff"),
        F.count("*").alias("total"),
    )


def as_of(day: str | None) -> Column:
    return F.lit(day).cast("date") if day else F.current_date()
