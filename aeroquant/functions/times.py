"""Time expressions. Every timestamp is a UTC instant with microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_MICROS = 3_600_000_000
MINUTE_MICROS = 60_000_000

# magnitudes below which an epoch number is read as s, ms, us; beyond: ns
EPOCH_SECONDS_BELOW = 10**11
EPOCH_MILLIS_BELOW = 10**14
EPOCH_MICROS_BELOW = 10**17


def round_hour(t: Column) -> Column:
    """Nearest hour, halves to the even hour (09:30 and 10:30 give 10:00)."""
    us = F.unix_micros(t)
    rest = F.pmod(us, F.lit(HOUR_MICROS))
    floor = us - rest
    odd = F.pmod(floor, F.lit(2 * HOUR_MICROS)) != 0
    up = (rest > HOUR_MICROS // 2) | ((rest == HOUR_MICROS // 2) & odd)
    return F.timestamp_micros(floor + F.when(up, F.lit(HOUR_MICROS)).otherwise(F.lit(0)))


def duration_minutes(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MINUTE_MICROS))


def plus_minutes(t: Column, minutes: Column) -> Column:
    shift = F.round(minutes * F.lit(MINUTE_MICROS)).cast("bigint")
    return F.timestamp_micros(F.unix_micros(t) + shift)


def calendar_parts(t: Column) -> dict[str, Column]:
    return {
        "hour_of_day": F.hour(t),
        "month": F.month(t),
        "flight_date_parsed": F.to_date(t),
    }


def hour_key(t: Column) -> Column:
    """Text key of the hour a time falls in."""
    return F.date_format(t, "yyyy-MM-dd HH:00")


def month_label(t: Column) -> Column:
    return F.date_format(t, "MMM")


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour.cast("int"))


def parse_timestamp(value: Column, dtype: T.DataType) -> Column:
    """Datetime, epoch seconds or text to a UTC instant; unparseable is null."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    if isinstance(dtype, T.IntegralType):
        return F.timestamp_seconds(value)
    if isinstance(dtype, T.NumericType):
        number = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
        return F.timestamp_micros(F.round(number * 1_000_000).cast("bigint"))
    return F.try_to_timestamp(value)


def normalise_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parse each column by its stored type; null marks a bad value."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: parse_timestamp(F.col(c), types[c]) for c in columns})


def epoch_to_timestamp(number: Column) -> Column:
    """Read one epoch number by its own magnitude (s, ms, us or ns)."""
    size = F.abs(number)
    micros = (
        F.when(size < EPOCH_SECONDS_BELOW, number * 1_000_000)
        .when(size < EPOCH_MILLIS_BELOW, number * 1_000)
        .when(size < EPOCH_MICROS_BELOW, number)
        .otherwise(F.floor(number / 1_000).cast("bigint"))
    )
    return F.timestamp_micros(micros)


def to_unix(day: Column, hour: int = 0, minute: int = 0) -> Column:
    """Epoch seconds of a UTC wall-clock time on a date."""
    return F.unix_seconds(day.cast("timestamp")) + F.lit(hour * 3600 + minute * 60)


def chunk_windows(df: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """One row per inclusive date window of at most ``days`` days.

    ``start`` and ``end`` name date columns. The request window of a chunk runs
    from 00:00 of its first day to 23:59 of its last one.
    """
    step = F.make_interval(days=F.lit(days))
    first = F.explode(F.sequence(F.col(start), F.col(end), step))
    return (
        df.where(F.col(start) <= F.col(end))
        .withColumn("chunk_start", first)
        .withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), F.col(end)))
        .withColumn("begin_unix", to_unix(F.col("chunk_start")))
        .withColumn("end_unix", to_unix(F.col("chunk_end"), 23, 59))
    )
