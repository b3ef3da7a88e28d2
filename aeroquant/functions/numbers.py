"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN and null are one concept; unify them where data enters."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats})


def clean_where(df: DataFrame, where: Column | None = None) -> DataFrame:
    """``clean_nan``, with a comparison applied to the stored values first.

    Cleaning hides a floating column from the reader, so a filter after it is not pushed
    down. A comparison holds for a NaN as the greatest value; once cleaned it is null, so
    the comparison is made again. Not for tests of null, which a NaN would fail.
    """
    return clean_nan(df) if where is None else clean_nan(df.where(where)).where(where)


def is_finite(value: Column) -> Column:
    """True or false, never null."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < INF)


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp; a null stays null."""
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNotNull(), bounded)


def signed_log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def impute(value: Column, statistic: Column) -> Column:
    """Missing takes the fitted statistic, or 0 where none was fitted."""
    return F.coalesce(nan_to_null(value.cast("double")), statistic, F.lit(0.0))


def buffer_card(median: Column, anomaly: Column) -> dict[str, Column]:
    """Recommended total and signed distance from the typical trip.

    Halves go to the even minute, as text formatting of a float does.
    """
    total = F.coalesce(median, F.lit(0.0)) + anomaly
    delta = F.bround(anomaly).cast("bigint")
    sign = F.when(anomaly < 0, "-").otherwise("+")
    return {
        "total_min": F.bround(total).cast("bigint"),
        "delta_label": F.concat(sign, F.abs(delta).cast("string"), F.lit(" min vs. median")),
    }


def quantile_label(q: Column) -> Column:
    named = {0.5: "Typical (P50)", 0.9: "Cautious (P90)", 0.95: "Safe (P95)"}  # fixed values
    label = F.concat(F.lit("P"), F.floor(q * 100).cast("string"))
    for value, text in reversed(named.items()):
        label = F.when(q == value, F.lit(text)).otherwise(label)
    return label
