"""Incremental update of the stored flight and weather tables.

Tables are partitioned by date. A batch touches few dates, so only those are
read, merged and replaced; the rest of the history is never moved.

``update_all`` runs all routes together. Its state is the control table: the newest
outcome per route and stage. Routes in back-off wait, routes that are up to date are
left alone, the others resume after their last stored date. A route fails by its own
files; the others go on, and flights stay stored where only the weather fails.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroquant.functions import text, times
from aeroquant.operators import clean, incremental
from aeroquant.schemas import CONTROL_SCHEMA, FLIGHT_SCHEMA, MERGE_KEY, WEATHER, WEATHER_KEY, WEATHER_SCHEMA
from aeroquant.session import cut_lineage, settle
from aeroquant.sources import landed, sinks


def merge_into(
    spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], tiebreak: Sequence[str], date: str
) -> DataFrame | None:
    """Merge a batch into the table at ``path``; a stored row wins.

    ``date`` is a date column that follows from the keys, so copies of a row meet
    in one partition. Returns the replaced partitions, or None for an empty batch,
    which changes nothing.
    """
    batch = cut_lineage(new)
    dates = [r[date] for r in batch.select(date).distinct().collect()]  # the dates of one batch
    if not dates:
        return None
    stored = landed.read_or_none(spark, path, batch.schema)
    if stored is None:
        merged = clean.keep_first(batch, [k for k in keys if k in batch.columns], tiebreak)
    else:
        merged = clean.merge_keep_first(stored.where(F.col(date).isin(dates)), batch, keys, tiebreak)
    # staged first, since the table is read while its partitions are replaced
    merged = cut_lineage(merged)
    sinks.write_partitions(merged, path, [date])
    return merged


def new_flights(arrivals: DataFrame, routes: DataFrame) -> DataFrame:
    """Landed arrival records to clean rows of the listed routes."""
    parsed = times.normalise_timestamps(arrivals, ["firstSeen", "lastSeen"])
    kept = clean.sanity_filter(clean.on_routes(parsed, routes))
    return kept.withColumn("flight_date", F.to_date("firstSeen"))


def update_flights(spark: SparkSession, arrivals: DataFrame, routes: DataFrame, path: str) -> DataFrame | None:
    """One table for all routes; a flight listed for two of them stays in both."""
    keys = [*MERGE_KEY, "route"]
    rest = [c for c in arrivals.columns if c not in keys]
    return merge_into(spark, path, new_flights(arrivals, routes), keys, rest, "flight_date")


def update_weather(spark: SparkSession, hours: DataFrame, path: str) -> DataFrame | None:
    """Hourly rows per airport, shared by all routes that touch it."""
    dated = hours.where(F.col("time").isNotNull()).withColumn("weather_date", F.to_date("time"))
    rest = [c for c in hours.columns if c not in WEATHER_KEY]
    return merge_into(spark, path, dated, WEATHER_KEY, rest, "weather_date")


# --- all routes, with state -------------------------------------------------------

RUN, FLIGHTS, HOURS = "run", "flights", "weather"  # stages in the control table


@dataclass(frozen=True)
class UpdateRun:
    """Outcome per route, and the control table after the run."""

    results: DataFrame
    control: DataFrame

    def summary(self) -> DataFrame:
        return incremental.run_summary(self.results)


def last_failures(control: DataFrame) -> DataFrame:
    """When the newest run of a route failed; routes whose newest run did not are absent."""
    newest = incremental.upsert_control(control, control.limit(0)).where(F.col("stage") == RUN)
    return newest.where(F.col("status") == incremental.FAILED).select("route", F.col("updated_utc").alias("last_failure_utc"))


def route_plan(
    routes: DataFrame, control: DataFrame, flights: DataFrame | None, hours: DataFrame | None, now: Column, force: bool
) -> DataFrame:
    """What each route has to do: ``skipped_backoff``, ``already_up_to_date``, ``update`` or ``full_backfill``.

    Weather is shared between routes, so a route whose flights were never stored is
    filled from the start, however far the weather of its airports goes.
    """
    listed = routes.select(
        "origin", "destination", text.route_name(F.col("origin"), F.col("destination")).alias("route"),
        text.route_key(F.col("origin"), F.col("destination")).alias("route_key"),
    ).distinct()
    dates = stored_dates(listed, flights, hours)
    state = listed.join(dates, "route", "left").join(last_failures(control), "route", "left")
    ranged = incremental.resume_ranges(incremental.runnable(state, now, force), F.to_date(now))
    new = F.col("last_flight_date").isNull()
    ranged = ranged.withColumn("resume_from", F.when(~new, F.col("resume_from")))
    ranged = ranged.withColumn("status", F.when(new, "full_backfill").otherwise(F.col("status")))
    return ranged.withColumn("status", F.when(F.col("in_backoff"), incremental.SKIPPED).otherwise(F.col("status")))


def stored_dates(listed: DataFrame, flights: DataFrame | None, hours: DataFrame | None) -> DataFrame:
    """Last stored flight and weather date per route."""
    none = listed.select("route", F.lit(None).cast("date").alias("last_flight_date")).limit(0)
    flown = none if flights is None else incremental.last_flight_dates(flights)
    measured = (
        none.withColumnRenamed("last_flight_date", "last_weather_date") if hours is None
        else incremental.last_weather_dates(hours, listed)
    )
    return flown.join(measured, "route", "full")


def bad_chunks(spark: SparkSession, path: str | None, kind: str) -> DataFrame:
    """(owner, error) of routes or airports with a chunk file that cannot be used."""
    if path is None:
        return spark.createDataFrame([], "owner string, error string")
    required = WEATHER_KEY + WEATHER if kind == "weather" else []
    found = landed.chunk_inventory(spark, path, required=required)
    lacking = (F.col("n_rows") == 0) | ~F.col("has_schema") if kind == "weather" else F.lit(False)
    found = found.withColumn("chunk", incremental.landed_path(F.col("path"))).groupBy("chunk").agg(
        F.bool_or(F.col("status") == "unreadable").alias("broken"), F.bool_and(lacking).alias("lacking")
    ).where("broken or lacking")
    owned = incremental.parse_paths(found, "chunk", "chunk", "broken").where(F.col("kind") == kind)
    what = F.when(F.col("broken"), "unreadable").otherwise("incomplete")
    # the message names the first file only
    return owned.groupBy("owner").agg(F.min(F.concat(what, F.lit(" file "), F.col("chunk"))).alias("error"))


def update_all(
    spark: SparkSession, routes: DataFrame, out: str, arrivals: str | None = None, weather: str | None = None,
    now: datetime | None = None, force: bool = False,
) -> UpdateRun:
    """Bring the tables below ``out`` up to date from landed files, and keep the state there."""
    at = F.lit(now or datetime.now(timezone.utc)).cast("timestamp")
    flights_at, hours_at, control_at = f"{out}/flights", f"{out}/weather", f"{out}/control"
    stored = lambda path, schema: landed.read_or_none(spark, path, schema)
    control = stored(control_at, CONTROL_SCHEMA)
    control = spark.createDataFrame([], CONTROL_SCHEMA) if control is None else control
    plan = settle(route_plan(routes, control, stored(flights_at, FLIGHT_SCHEMA), stored(hours_at, WEATHER_SCHEMA), at, force))
    due = plan.where(F.col("status").isin("update", "full_backfill"))

    # flights of routes whose files are sound
    broken = settle(bad_chunks(spark, arrivals, "arrivals"))
    sound = due.join(broken, F.col("route_key") == F.col("owner"), "left_anti")
    if arrivals:
        rows, _ = landed.read_tolerant(spark, arrivals, landed.ARRIVAL_SCHEMA)
        since = sound.select("origin", "destination", "resume_from", "resume_to")
        fresh = new_flights(rows, since)
        windows = since.select(text.route_name(F.col("origin"), F.col("destination")).alias("route"), "resume_from", "resume_to")
        inside = F.col("resume_from").isNull() | (F.col("flight_date") >= F.col("resume_from"))
        fresh = fresh.join(windows, "route").where(inside & (F.col("flight_date") <= F.col("resume_to")))
        keys = [*MERGE_KEY, "route"]
        fresh = fresh.drop("resume_from", "resume_to")
        merge_into(spark, flights_at, fresh, keys, [c for c in fresh.columns if c not in (*keys, "flight_date")], "flight_date")

    # weather is tried only where the flights succeeded
    wrong = settle(bad_chunks(spark, weather, "weather"))
    ends = sound.select("route", F.explode(F.array("origin", "destination")).alias("owner"))
    spoilt = settle(ends.join(wrong, "owner").groupBy("route").agg(F.min("error").alias("error")))
    calm = sound.join(spoilt, "route", "left_anti")
    if weather:
        rows, _ = landed.read_tolerant(spark, weather, WEATHER_SCHEMA)
        airports = calm.select(F.explode(F.array("origin", "destination")).alias("airport"), "resume_from", "resume_to")
        span = airports.groupBy("airport").agg(
            F.when(F.count_if(F.col("resume_from").isNull()) == 0, F.min("resume_from")).alias("_from"), F.max("resume_to").alias("_to"))
        day = F.to_date("time")
        hours = rows.where(F.col("airport").isNotNull()).join(span, "airport")
        hours = hours.where((F.col("_from").isNull() | (day >= F.col("_from"))) & (day <= F.col("_to"))).drop("_from", "_to")
        update_weather(spark, hours, hours_at)

    results = cut_lineage(_outcomes(spark, plan, broken, spoilt, stored_dates(
        plan.select("route", "origin", "destination"), stored(flights_at, FLIGHT_SCHEMA), stored(hours_at, WEATHER_SCHEMA))))
    updates = _control_rows(results, at)
    merged = cut_lineage(incremental.upsert_control(control, updates).select(*CONTROL_SCHEMA.names))
    sinks.replace_table(merged, control_at)
    log = results.withColumns({"finished_utc": at, "force": F.lit(force), "run_date": F.to_date(at)})
    log.write.mode("append").partitionBy("run_date").parquet(f"{out}/runs")
    return UpdateRun(results, merged)


def _outcomes(spark: SparkSession, plan: DataFrame, broken: DataFrame, spoilt: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per route: what it had to do, how each stage went, and how far data is stored now."""
    tried = F.col("status").isin("update", "full_backfill")
    flights = broken.select(F.col("owner").alias("route_key"), F.col("error").alias("_f"))
    hours = spoilt.select("route", F.col("error").alias("_w"))
    now = dates.select("route", F.col("last_flight_date").alias("flights_through"), F.col("last_weather_date").alias("weather_through"))
    rows = plan.join(flights, "route_key", "left").join(hours, "route", "left").join(now, "route", "left")
    staged = incremental.stage_plan(rows.where(tried).withColumn(
        "flights_status", F.when(F.col("_f").isNull(), "success").otherwise(incremental.FAILED)
    ).withColumn("weather_status", F.when(F.col("_w").isNull(), "success").otherwise(incremental.FAILED)))
    through = F.least("flights_through", "weather_through")  # the earlier of those that are there
    empty = (F.col("status") == "success") & through.isNull()
    staged = staged.withColumn("error", F.coalesce(
        F.concat(F.lit("flights: "), F.col("_f")), F.concat(F.lit("weather: "), F.col("_w")), F.when(empty, "no stored data was found"),
    )).withColumn("status", F.when(empty, incremental.FAILED).otherwise(F.col("status")))
    idle = rows.where(~tried).withColumns({c: F.lit(None).cast("string") for c in ("flights_status", "weather_status", "error")})
    done = F.col("status").isin(*incremental.OK_STATUSES)
    return staged.unionByName(idle).select(
        "route", "status", F.col("resume_from").alias("requested_start"), F.col("resume_to").alias("requested_end"),
        "flights_status", "weather_status", "error", "retry_at", "flights_through", "weather_through",
        F.when(done, through).alias("fetched_through"),
    )


def _control_rows(results: DataFrame, at: Column) -> DataFrame:
    """State of every stage that ran; a route in back-off keeps its failure as it is."""
    stages = F.array(
        F.struct(F.lit(FLIGHTS).alias("stage"), F.col("flights_status").alias("s")),
        F.struct(F.lit(HOURS).alias("stage"), F.col("weather_status").alias("s")),
        F.struct(F.lit(RUN).alias("stage"), F.col("status").alias("s")),
    )
    ran = results.where(F.col("status") != incremental.SKIPPED).select("route", "error", F.inline(stages))
    failed = F.col("s") == incremental.FAILED
    return ran.where(F.col("s").isNotNull()).select(
        "route", "stage", F.col("s").alias("status"), at.alias("updated_utc"), F.when(failed, F.col("error")).alias("error")
    )
