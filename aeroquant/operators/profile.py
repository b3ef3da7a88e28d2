"""Data profiling: null rates, summaries, correlations, histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroquant.operators.quantiles import exact_quantiles, melt
from aeroquant.session import settle


def null_rates(df: DataFrame) -> DataFrame:
    """Percent missing per column, one decimal; only columns with any."""
    columns = df.columns
    rates = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 1).alias(c) for c in columns])
    return rates.unpivot([], columns, "column", "null_pct").where(F.col("null_pct") > 0)


def null_rates_sorted(df: DataFrame) -> DataFrame:
    return null_rates(df).orderBy(F.desc("null_pct"), "column")


def pct_complete(columns: Sequence[str]) -> Column:
    """Percent of rows in which every listed column is present."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return F.round(F.avg((~missing).cast("int")) * 100, 1)


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max per column."""
    tall = melt(df, [], columns)
    moments = tall.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(tall, ["column"], "value", [0.25, 0.5, 0.75])
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min",
        *[F.col("q")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))], "max",
    )


def typical_row(features: DataFrame, columns: Sequence[str], hour: str = "hour_of_day") -> DataFrame:
    """Column means and the commonest hour per route; ties take the lowest."""
    means = features.groupBy("route").agg(*[F.avg(c).alias(c) for c in columns])
    hours = features.where(F.col(hour).isNotNull()).groupBy("route", hour).agg(F.count("*").alias("n"))
    common = hours.groupBy("route").agg(F.min_by(hour, F.struct(-F.col("n"), F.col(hour))).alias(hour))
    return means.join(common, "route", "left")


def _cross_moments(columns: Sequence[str], shift: Sequence[float]):
    """Task side of the correlations: sums over one partition, for every pair."""
    k = len(columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([
                batch.column(i).to_numpy(zero_copy_only=False).astype("float64") for i in range(k)
            ]) - np.asarray(shift)
            held = ~np.isnan(x)
            x, m = np.where(held, x, 0.0), held.astype("float64")
            # n, sum of a, sum of b, squares of a, squares of b, products: rows holding both
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        a, b = np.triu_indices(k)
        cells = [pa.array(a.astype("int32")), pa.array(b.astype("int32")), *[pa.array(t[a, b]) for t in total]]
        yield pa.RecordBatch.from_arrays(cells, names=["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    return sums


def correlations(df: DataFrame, columns: Sequence[str], diagonal: bool = False) -> DataFrame:
    """Pearson correlation of every column pair, over rows holding both.

    Each task reduces its rows to one small matrix of sums by matrix products, and
    the pairs are then added up on all reducers. Values are shifted by the column
    means first, which keeps the sums accurate.
    """
    columns = list(columns)
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    means = tall.agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in columns]).first()  # one number per column
    shift = [means[c] or 0.0 for c in columns]
    parts = tall.mapInArrow(
        _cross_moments(columns, shift),
        "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double",
    )
    total = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n = F.col("n")
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / n
    # below this a spread is rounding noise of a constant column
    noise = F.array(*[F.lit((1e-13 * abs(m)) ** 2) for m in shift])
    varies = lambda at, s, ss: spread(s, ss) > n * F.element_at(noise, F.col(at) + 1)
    bottom = F.sqrt(spread("sa", "saa") * spread("sb", "sbb"))
    proper = (n > 1) & varies("a", "sa", "saa") & varies("b", "sb", "sbb")
    r = F.when(proper, (F.col("sab") - F.col("sa") * F.col("sb") / n) / bottom)
    names = F.array(*[F.lit(c) for c in columns])
    pairs = total if diagonal else total.where(F.col("a") < F.col("b"))
    return pairs.select(F.element_at(names, F.col("a") + 1).alias("a"), F.element_at(names, F.col("b") + 1).alias("b"),
                        r.alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All ordered pairs, with the diagonal."""
    half = correlations(df, columns, diagonal=True)
    mirrored = half.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    return half.unionByName(mirrored)


def top_correlations(pairs: DataFrame, n: int = 10) -> DataFrame:
    """Strongest n positive and n negative distinct correlations below 1."""
    proper = pairs.where(F.abs("r") < 1).groupBy("r").agg(F.min(F.struct("a", "b")).alias("ab"))
    flat = proper.select("ab.a", "ab.b", "r")
    high = flat.where(F.col("r") > 0).orderBy(F.desc("r")).limit(n).withColumn("kind", F.lit("positive"))
    low = flat.where(F.col("r") < 0).orderBy("r").limit(n).withColumn("kind", F.lit("negative"))
    return high.unionByName(low)


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Counts in equal bins between each group's own least and greatest value.

    The last bin is closed. A group with a single value counts in bin 1. Bins
    without rows are absent.
    """
    present = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("v"))
    span = F.struct(F.min("v").alias("low"), F.max("v").alias("high"))
    if keys:
        ends = settle(present.groupBy(*keys).agg(span.alias("e")))
        joined = present.join(ends, list(keys))
    else:
        joined = present.withColumn("e", present.agg(span).scalar())
    low, high = F.col("e")["low"], F.col("e")["high"]
    bucket = F.least(F.width_bucket("v", low, high, F.lit(bins)), F.lit(bins))
    return (
        joined.withColumn("bin", F.when(low == high, F.lit(1)).otherwise(bucket).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("n"), F.max(low).alias("low"), F.max(high).alias("high"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, missing values included."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def eligible_carriers(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Carriers with enough rows for a model of their own."""
    return (
        df.where(F.col("airline").isNotNull())
        .groupBy(*keys, "airline").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_rows)
    )


def distinct_airlines(df: DataFrame) -> DataFrame:
    return df.select("route", "airline").where(F.col("airline").isNotNull()).distinct()
