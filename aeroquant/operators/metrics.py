"""Quantile-forecast metrics. Error means truth minus forecast in the loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroquant.operators.quantiles import medians
from aeroquant.session import cut_lineage

# weights of the scores (fixed values)
COVERAGE_WEIGHT = 10.0
BALANCE_WEIGHT = 10.0

BUNDLE = [
    "pinball_loss", "coverage_error", "coverage_penalty", "tuning_score", "mae", "medae", "rmse",
    "mean_error", "empirical_coverage_pct", "target_coverage_pct", "coverage_gap_pct",
]


def pinball(y: Column, p: Column, q: Column) -> Column:
    error = y - p
    return F.greatest(q * error, (q - 1) * error)


def pinball_loss(y: Column, p: Column, q: Column) -> Column:
    return F.avg(pinball(y, p, q))


def coverage(y: Column, p: Column) -> Column:
    return F.avg((y <= p).cast("double"))


def coverage_error(y: Column, p: Column, q: Column) -> Column:
    return F.abs(coverage(y, p) - F.max(q))


def loss_bundle(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "prediction", q: str = "quantile") -> DataFrame:
    """The two metrics a search compares candidates by, from one aggregation."""
    yc, pc, qc = F.col(y), F.col(p), F.col(q)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_eval"), pinball_loss(yc, pc, qc).alias("pinball_loss"),
        coverage_error(yc, pc, qc).alias("coverage_error"),
    )


def metric_bundle(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "prediction", q: str = "quantile") -> DataFrame:
    """All metrics per group: one aggregation, plus the exact median error.

    ``q`` is a column that is constant within a group, usually one of ``keys``.
    """
    yc, pc, qc = F.col(y), F.col(p), F.col(q)
    # the aggregation and the median both read the scored rows
    df = cut_lineage(df.select(*dict.fromkeys([*keys, y, p, q])))
    base = df.groupBy(*keys).agg(
        F.count("*").alias("n_eval"),
        F.max(qc).alias("_q"),
        pinball_loss(yc, pc, qc).alias("pinball_loss"),
        coverage(yc, pc).alias("_cov"),
        F.avg(F.abs(pc - yc)).alias("mae"),
        F.sqrt(F.avg((pc - yc) * (pc - yc))).alias("rmse"),
        F.avg(pc - yc).alias("mean_error"),
    )
    middle = medians(df.withColumn("_abs", F.abs(pc - yc)), keys, "_abs", "medae").drop("n")
    joined = base.join(middle, list(keys)) if keys else base.withColumn("medae", middle.scalar())
    gap = F.abs(F.col("_cov") - F.col("_q"))
    return joined.select(
        *keys, "n_eval", "pinball_loss",
        gap.alias("coverage_error"),
        gap.alias("coverage_penalty"),
        (F.col("pinball_loss") + COVERAGE_WEIGHT * gap).alias("tuning_score"),
        "mae", "medae", "rmse", "mean_error",
        (F.col("_cov") * 100).alias("empirical_coverage_pct"),
        (F.col("_q") * 100).alias("target_coverage_pct"),
        ((F.col("_cov") - F.col("_q")) * 100).alias("coverage_gap_pct"),
    )


def fold_balanced_score(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean loss, mean coverage error and its spread over folds, and their sum."""
    means = folds.groupBy(*keys).agg(
        F.count("*").alias("n_folds"),
        F.avg("pinball_loss").alias("mean_pinball_loss"),
        F.avg("coverage_error").alias("mean_coverage_error"),
        F.stddev_pop("coverage_error").alias("fold_coverage_error_std"),
    )
    score = (
        F.col("mean_pinball_loss")
        + COVERAGE_WEIGHT * F.col("mean_coverage_error")
        + BALANCE_WEIGHT * F.col("fold_coverage_error_std")
    )
    return means.withColumn("score", score)


def best_candidate(scores: DataFrame, keys: Sequence[str], candidate: str = "candidate", score: str = "score") -> DataFrame:
    """The candidate with the least score per group; ties take the lowest one."""
    rest = [c for c in scores.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(score, candidate))
    return scores.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
