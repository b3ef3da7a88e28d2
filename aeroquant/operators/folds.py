"""Statistics of expanding folds, from one table of counts per segment.

Fold i trains on every segment before i. Counting values per segment first and
expanding the counts, not the rows, keeps the work independent of the fold number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroquant.operators.quantiles import present_values, ranked_values
from aeroquant.session import settle


def train_quantiles(segmented: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact quantiles of each fold's training rows: keys, fold, n, q."""
    keys = list(keys)
    rows = present_values(segmented.where(F.col("segment") < F.col("n_folds")), [*keys, "n_folds", "segment"], value)

    def later(table: DataFrame) -> DataFrame:
        folds = F.sequence(F.col("segment") + 1, F.col("n_folds").cast("int"))
        return table.withColumn("fold", F.explode(folds)).drop("segment", "n_folds")

    return ranked_values(rows, [*keys, "n_folds", "segment"], qs, [*keys, "fold"], later)


def train_medians(segmented: DataFrame, keys: Sequence[str], value: str, name: str = "train_median") -> DataFrame:
    found = train_quantiles(segmented, keys, value, [0.5])
    return settle(found.select(*keys, "fold", F.col("n").alias("n_train"), F.col("q")[0].alias(name)))


def test_rows(segmented: DataFrame) -> DataFrame:
    """Each row once, in the fold that tests it."""
    return segmented.where(F.col("segment") >= 1).withColumn("fold", F.col("segment")).drop("segment")


def fold_spans(segmented: DataFrame, keys: Sequence[str], time: str = "firstSeen") -> DataFrame:
    """Sizes and time spans of train and test rows per fold."""
    per_segment = segmented.groupBy(*keys, "n_folds", "segment").agg(
        F.count("*").alias("c"), F.min(time).alias("first"), F.max(time).alias("last")
    )
    start = F.greatest(F.col("segment"), F.lit(1))
    roles = per_segment.withColumn("fold", F.explode(F.sequence(start, F.col("n_folds").cast("int"))))
    is_test = F.col("segment") == F.col("fold")
    side = lambda c, test: F.when(is_test if test else ~is_test, F.col(c))
    return roles.groupBy(*keys, "fold").agg(
        F.sum(side("c", False)).alias("n_train"), F.sum(side("c", True)).alias("n_test"),
        F.min(side("first", False)).alias("train_start"), F.max(side("last", False)).alias("train_end"),
        F.min(side("first", True)).alias("test_start"), F.max(side("last", True)).alias("test_end"),
    ).withColumn("days_trained", F.datediff("train_end", "train_start"))
