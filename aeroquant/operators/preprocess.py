"""Preprocessing fitted on training rows only, for many populations at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroquant.functions import numbers
from aeroquant.operators.enrich import encode
from aeroquant.operators.quantiles import column_medians, quantiles_with_total
from aeroquant.session import settle


@dataclass(frozen=True)
class Preprocessor:
    """Fitted state as small tables: one row per population and quantile."""

    keys: tuple[str, ...]
    columns: tuple[str, ...]
    medians: DataFrame  # keys, and one column per feature
    encoding: DataFrame | None = None  # keys, quantile, airline, value
    fallback: DataFrame | None = None  # keys, quantile, value

    def impute(self, df: DataFrame) -> DataFrame:
        """Missing values take the training median, or 0 where there is none."""
        stats = self.medians.select(*self.keys, F.struct(*self.columns).alias("_m"))
        if self.keys:
            joined = df.join(stats, list(self.keys), "left")
        else:
            joined = df.withColumn("_m", stats.scalar())
        filled = {c: numbers.impute(F.col(c), F.col("_m")[c]) for c in self.columns}
        return joined.withColumns(filled).drop("_m")

    def encode(self, df: DataFrame, name: str = "airline_encoded") -> DataFrame:
        """Carrier to its training quantile; needs the quantile column."""
        return encode(df, self.encoding, self.fallback, [*self.keys, "quantile"], "airline", "value", name)

    def apply(self, df: DataFrame) -> DataFrame:
        out = self.impute(df)
        return self.encode(out) if self.encoding is not None else out


def fit_medians(train: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per population, one column per feature."""
    tall = column_medians(train, keys, columns)
    wide = [F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns]
    return settle(tall.groupBy(*keys).agg(*wide) if keys else tall.agg(*wide))


def _by_quantile(found: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    names = F.array(*[F.lit(float(q)) for q in qs])
    return found.select(*keys, F.inline(F.arrays_zip(names.alias("quantile"), F.col("q").alias("value"))))


def fit_encoding(train: DataFrame, keys: Sequence[str], y: str, qs: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Target quantiles per carrier and overall, for every quantile at once."""
    keys = list(keys)
    per_carrier, overall = quantiles_with_total(train, keys, "airline", y, qs)
    return settle(_by_quantile(per_carrier, [*keys, "airline"], qs)), settle(_by_quantile(overall, keys, qs))


def fit_preprocessor(
    train: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str, qs: Sequence[float], pooled: bool = True
) -> Preprocessor:
    encoding, fallback = fit_encoding(train, keys, y, qs) if pooled else (None, None)
    return Preprocessor(tuple(keys), tuple(columns), fit_medians(train, keys, columns), encoding, fallback)
