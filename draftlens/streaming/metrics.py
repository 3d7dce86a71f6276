"""Request counters per route, the same for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_route(requests: DataFrame, route: str, value: str, order: list[str]) -> DataFrame:
    """Count, errors (negative values), largest and last value per route; combined map-side."""
    last = F.max_by(value, F.struct(*order)).alias("last_value")
    return requests.groupBy(route).agg(F.count("*").alias("n"), F.count_if(F.col(value) < 0).alias("n_errors"), F.max(value).alias("max_value"), last)


def by_status(requests: DataFrame, route: str, status: str) -> DataFrame:
    """Requests per route and status."""
    return requests.groupBy(route, status).agg(F.count("*").alias("n"))


def windowed(requests: DataFrame, time: str, route: str, value: str, width: str, late: str) -> DataFrame:
    """The same count and maximum per event-time window; rows later than `late` are left out once their window is closed."""
    rows = requests.withWatermark(time, late) if requests.isStreaming else requests
    return rows.groupBy(F.window(time, width).alias("span"), route).agg(F.count("*").alias("n"), F.max(value).alias("max_value"))
