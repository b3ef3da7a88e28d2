"""Feature table of every route in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroquant.functions import text, times
from aeroquant.operators import clean, enrich, gates
from aeroquant.schemas import (
    FEATURE_SCHEMA, FEATURES, FLIGHT_KEY, REQUIRED_FLIGHT, TRAINING_REQUIRED, WEATHER, conform, require_columns,
)
from aeroquant.operators.quantiles import named_quantiles, quantiles_with_total
from aeroquant.session import cut_lineage, settle
from aeroquant.sources import sinks


def prepare_flights(flights: DataFrame) -> DataFrame:
    """Normalise times and derive hours, calendar parts, length and carrier."""
    require_columns(flights, REQUIRED_FLIGHT, "Flights")
    f = times.normalise_timestamps(flights, ["firstSeen", "lastSeen"])
    first, last = F.col("firstSeen"), F.col("lastSeen")
    return f.withColumns({
        "firstSeen_hourly_utc": times.round_hour(first),
        "lastSeen_hourly_utc": times.round_hour(last),
        "dep_merge_key": times.round_hour(first),
        "arr_merge_key": times.round_hour(last),
        **times.calendar_parts(first),
        "flight_duration": times.duration_minutes(first, last),
        "airline": text.airline_code(F.col("callsign")),
    })


def feature_matrix(flights: DataFrame, weather: DataFrame) -> DataFrame:
    """Prepared flights with weather at both ends, in the fixed column order.

    Lazy and ungated: see ``checked_feature_matrix``.
    """
    prepared = prepare_flights(flights)
    require_columns(weather, ["airport", "time"], "Weather")
    wide = enrich.join_both_ends(prepared, clean.with_weather_columns(weather, WEATHER), WEATHER)
    return conform(require_columns(wide, FEATURES, "Feature table"), FEATURE_SCHEMA)


SHOW = ["icao24", "firstSeen", "lastSeen", "route"]


@dataclass(frozen=True)
class StagedFeatures:
    """A feature table that is written but not yet put in place."""

    table: DataFrame
    report: dict[str, int]  # bad rows by gate, in the order in which gates are reported

    def gate_report(self) -> DataFrame:
        """(gate, n_bad) of every gate."""
        rows = [F.struct(F.lit(g).alias("gate"), F.lit(n).cast("long").alias("n_bad")) for g, n in self.report.items()]
        return self.table.sparkSession.range(1).select(F.inline(F.array(*rows)))

    def enforce(self) -> DataFrame:
        """The table if no gate counts a row, else an error with the first gate and examples."""
        for gate, n_bad in self.report.items():
            if n_bad:
                bad = {**_prepared_gates(), **gates.final_row_gates()}.get(gate)
                found = self.table.where(bad).select(*SHOW) if bad is not None else gates.copies(self.table, FLIGHT_KEY).drop("n")
                what = "rows" if bad is not None else "duplicated rows"
                examples = [r.asDict() for r in found.limit(gates.EXAMPLES).collect()]
                raise gates.GateError(f"gate {gate}: found {n_bad} {what}. Examples: {examples}")
        return self.table


def _prepared_gates() -> dict[str, Column]:
    unread = {f"{c}_parsed": F.col(c).isNull() for c in ("firstSeen", "lastSeen")}
    return {**unread, "time_order": gates.bad_time_order()}


def stage_feature_matrix(flights: DataFrame, weather: DataFrame) -> StagedFeatures:
    """Write the feature table once and count all gates on the way.

    Row gates ride on the write, before and after the join. What the join adds is the
    difference of two counts of that write. Only keys are read again, to find copies.
    """
    known = clean.with_weather_columns(weather, WEATHER)
    prepared, before = gates.observe_gates(prepare_flights(flights), _prepared_gates(), "prepared", rows="n")
    wide = conform(
        require_columns(enrich.join_both_ends(prepared, known, WEATHER), FEATURES, "Feature table"), FEATURE_SCHEMA)
    watched, after = gates.observe_gates(wide, gates.final_row_gates(), "joined", rows="n")
    table = cut_lineage(watched)
    early, late = dict(before.get), dict(after.get)
    copies = lambda df, keys, name, extra=False: gates.duplicate_report(df, keys, name, extra).first()["n_bad"]
    fanout = late.pop("n") - early.pop("n")
    lookup = enrich.weather_lookup(known, [])
    report = early | {
        "duplicates": copies(table, FLIGHT_KEY, "duplicates") if not fanout else copies(prepare_flights(flights), FLIGHT_KEY, "duplicates"),
        "weather_key": copies(lookup, ["airport", "hour"], "weather_key"),
        **late, "join_fanout": fanout,
    }
    return StagedFeatures(table, report)


def checked_feature_matrix(flights: DataFrame, weather: DataFrame) -> DataFrame:
    """The feature table, or an error naming the first gate that fails."""
    return stage_feature_matrix(flights, weather).enforce()


def write_features(features: DataFrame, path: str) -> None:
    """Store by route, rows of a file in time order."""
    sinks.write_partitions(features, path, ["route"], order=["firstSeen", "icao24"])


def training_rows(features: DataFrame) -> DataFrame:
    """Features without outliers; lengths must then be finite and positive."""
    require_columns(features, TRAINING_REQUIRED, "Feature table")
    return clean.drop_outliers(features)


def check_training_rows(rows: DataFrame) -> DataFrame:
    bad = {"duration_positive": gates.bad_positive(), "duration_finite": gates.bad_finite()}
    return gates.enforce_rows(rows, bad, ["route", "icao24", "firstSeen", "flight_duration"])


def feasible_routes(rows: DataFrame, min_rows: int) -> DataFrame:
    return rows.groupBy("route").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)


QUANTILES = (0.5, 0.9, 0.95)  # fixed values


def baseline_quantiles(trips: DataFrame, route: list[str], carrier: str = "airline") -> DataFrame:
    """P50, P90 and P95 of the anomaly per route and carrier.

    The anomaly is the length minus the route's median. A constant shift moves
    quantiles by the same amount, so one table of value counts serves both.
    """
    per_carrier, total = quantiles_with_total(trips, route, carrier, "flight_duration", QUANTILES, [0.5])
    medians = total.select(*route, F.col("q")[0].alias("route_median"))
    if route:
        joined = per_carrier.join(medians, route)
    else:
        joined = per_carrier.withColumn("route_median", medians.scalar())
    return joined.select(
        *route, carrier, "n", "route_median",
        *[(F.col("q")[i] - F.col("route_median")).alias(f"p{round(q * 100)}") for i, q in enumerate(QUANTILES)],
    )


def route_medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    return settle(named_quantiles(rows, keys, "flight_duration", {"route_median": 0.5}).drop("n"))
