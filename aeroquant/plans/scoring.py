"""Scoring of a request table: forecast weather, tier choice, buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroquant.functions import numbers, text
from aeroquant.operators.enrich import nearest_in_time
from aeroquant.plans.training import TrainedTiers
from aeroquant.schemas import WEATHER


def request_features(requests: DataFrame, forecast: DataFrame, columns: Sequence[str] = WEATHER) -> DataFrame:
    """Model columns of requests with origin, destination, departure and arrival.

    Each end takes the forecast hour closest to its own time; the hour of day is
    that of the departure, as in training.
    """
    def at(df: DataFrame, airport: str, time: str, prefix: str) -> DataFrame:
        series = forecast.withColumnsRenamed({"airport": airport})
        return nearest_in_time(df, series, [airport], time, "time", columns, prefix).drop(f"{prefix}time")

    both = at(at(requests, "origin", "departure", "dep_"), "destination", "arrival", "arr_")
    return both.withColumns({
        "route": text.route_name(F.col("origin"), F.col("destination")),
        "hour_of_day": F.hour("departure"),
        "month": F.month("departure"),
    })


def score_requests(run: TrainedTiers, requests: DataFrame, forecast: DataFrame) -> DataFrame:
    """Anomaly, total and labels per request and quantile."""
    scored = run.score(request_features(requests, forecast))
    card = numbers.buffer_card(F.col("route_median"), F.col("anomaly"))
    return scored.withColumns({**card, "label": numbers.quantile_label(F.col("quantile"))})
