"""Run progress, foreign runs and stale runs on the crawl event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webcairn import limits as L
from webcairn.operators.reports import page_states, progress_counts


def progress_stream(events: DataFrame, lateness: str = "7 days", span: str = "1 day") -> DataFrame:
    """Page states that changed in a batch.

    State is kept per (run, URL, ``span`` of event time), never per run, so the largest run is
    spread over all tasks; minima and maxima make a redelivered event harmless and let the sink put
    the spans of a page together.  State of a span ends once the watermark has passed it, however
    long its run goes on; events later than ``lateness`` are dropped.  Events without a time
    (``ts``) have no end, their state is kept for good.
    """
    if "ts" not in events.columns:
        return page_states(events)
    timed = events.withWatermark("ts", lateness)
    return page_states(timed, F.window("ts", span)).drop("window")


def progress_from_sink(sink: DataFrame) -> DataFrame:
    """Progress per run from the states written so far, in any order."""
    return progress_counts(sink)


def split_foreign(events: DataFrame, current_runs: DataFrame) -> DataFrame:
    """Flag events of runs that are not current any more (a stream-static join)."""
    current = current_runs.select("run_id", F.lit(True).alias("__current"))
    return events.join(current, "run_id", "left").withColumn(
        "foreign", F.col("__current").isNull()
    ).drop("__current")


def stale_run_stream(events: DataFrame, gap_s: int = L.STALE_RUN_S, lateness: str = "1 hour") -> DataFrame:
    """Runs released because nothing happened for ``gap_s`` and they had not finished.

    A session window closes when the watermark passes the gap; Spark keeps one open
    window per run.  Rows without a run only move time on; ``end_mark`` is one.
    """
    quiet = events.withWatermark("ts", lateness).groupBy(
        "run_id", F.session_window("ts", f"{gap_s} seconds")
    )
    closed = quiet.agg(
        F.count("run_id").alias("events"), F.max((F.col("event") == "finish").cast("int")).alias("finished")
    )
    return closed.where((F.col("finished") == 0) & (F.col("events") > 0)).select(
        "run_id",
        F.unix_timestamp("session_window.start").alias("started_at"),
        F.unix_timestamp("session_window.end").alias("released_at"),
        "events",
    )
