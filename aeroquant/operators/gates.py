"""Data-quality gates.

Every gate is a report of (gate, n_bad). ``enforce`` raises with the count and up
to five examples. Row gates share one pass; ``observe_gates`` adds them to a
write that happens anyway.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from aeroquant.functions.numbers import is_finite
from aeroquant.schemas import ARR_WEATHER, DEP_WEATHER, FLIGHT_KEY, NOT_NULL

EXAMPLES = 5


class GateError(ValueError):
    """Rows failed a quality gate."""


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


# row gates: a column that is true on a bad row
def bad_time_order() -> Column:
    return F.col("lastSeen") <= F.col("firstSeen")


def bad_null(columns: Sequence[str] = NOT_NULL) -> Column:
    return any_null(columns)


def bad_weather(columns: Sequence[str] = (*DEP_WEATHER, *ARR_WEATHER)) -> Column:
    return any_null(columns)


def bad_finite(column: str = "flight_duration") -> Column:
    return ~is_finite(F.col(column))


def bad_positive(column: str = "flight_duration") -> Column:
    return is_finite(F.col(column)) & (F.col(column) <= 0)


def final_row_gates() -> dict[str, Column]:
    """Gates of the feature table, in the order in which they are reported."""
    return {
        "not_null": bad_null(),
        "weather_complete": bad_weather(),
        "duration_finite": bad_finite(),
        "duration_positive": bad_positive(),
    }


def row_report(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """All row gates in one pass: (gate, n_bad)."""
    counts = df.agg(*[F.count_if(bad).alias(name) for name, bad in gates.items()])
    return counts.unpivot([], list(gates), "gate", "n_bad")


def copies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def duplicate_report(df: DataFrame, keys: Sequence[str], gate: str = "duplicates", extra_only: bool = False) -> DataFrame:
    """Rows of duplicated keys: all of them, or only those beyond the first."""
    bad = F.sum(F.col("n") - 1) if extra_only else F.sum("n")
    return copies(df, keys).agg(
        F.lit(gate).alias("gate"), F.coalesce(bad, F.lit(0)).cast("bigint").alias("n_bad")
    )


def enforce_rows(df: DataFrame, gates: dict[str, Column], show: Sequence[str]) -> DataFrame:
    """Raise for the first failing gate; one pass when all is well."""
    counts = {r["gate"]: r["n_bad"] for r in row_report(df, gates).collect()}  # one row per gate
    for name, bad in gates.items():
        if counts[name]:
            examples = [r.asDict() for r in df.where(bad).select(*show).limit(EXAMPLES).collect()]
            raise GateError(f"gate {name}: found {counts[name]} rows. Examples: {examples}")
    return df


def enforce_unique(df: DataFrame, keys: Sequence[str], name: str, extra_only: bool = False) -> DataFrame:
    n_bad = duplicate_report(df, keys, name, extra_only).first()["n_bad"]
    if n_bad:
        examples = [r.asDict() for r in copies(df, keys).drop("n").limit(EXAMPLES).collect()]
        raise GateError(f"gate {name}: found {n_bad} duplicated rows. Examples: {examples}")
    return df


def enforce_parsed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise where a time could not be read."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    for c in columns:
        if row[c]:
            raise GateError(f"{c} contains {row[c]} values that are not UTC timestamps")
    return df


def observe_gates(
    df: DataFrame, gates: dict[str, Column], name: str = "gates", rows: str | None = None
) -> tuple[DataFrame, Observation]:
    """Count bad rows, and all rows as ``rows``, while the frame is written; read ``observation.get`` after."""
    seen = Observation(name)
    counted = [F.count("*").alias(rows)] if rows else []
    return df.observe(seen, *counted, *[F.count_if(bad).alias(g) for g, bad in gates.items()]), seen


def passing(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Rows that no gate rejects."""
    return reduce(lambda rows, bad: rows.where(~F.coalesce(bad, F.lit(False))), gates.values(), df)


def enforce_final(df: DataFrame) -> DataFrame:
    show = ["icao24", "firstSeen", "lastSeen", "route"]
    enforce_rows(df, final_row_gates(), show)
    return enforce_unique(df, FLIGHT_KEY, "join_fanout", extra_only=True)
