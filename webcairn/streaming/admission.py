"""Request admission per client and tumbling window, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webcairn import limits as L


def admission_stream(
    requests: DataFrame,
    window_s: int = L.REQUEST_WINDOW_S,
    limit: int = L.REQUEST_LIMIT,
    lateness: str = "1 minute",
) -> DataFrame:
    """Requests and admitted requests of each closed window (``ts`` is the event time).

    Rows without a client are requests of nobody and only move time on; ``end_mark`` is one.
    """
    counts = (
        requests.withWatermark("ts", lateness)
        .groupBy("client", F.window("ts", f"{window_s} seconds"))
        .agg(F.count("client").alias("requests"))
    )
    return counts.where("requests > 0").select(
        "client",
        F.unix_timestamp("window.start").alias("window_start"),
        "requests",
        F.least("requests", F.lit(limit)).cast("bigint").alias("admitted"),
    )
