"""Check cadence: site signals, first interval, streaks and the fold over histories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from webcairn import limits as L
from webcairn.functions import freshness
from webcairn.operators.ranking import positions
from webcairn.session import materialize

CHUNK = 4_096
#: Widest range of intervals whose step functions are written out.
MOST_POINTS = 10_000_000


def cadence_signals(pages: DataFrame, flags: DataFrame | None = None, sites: DataFrame | None = None) -> DataFrame:
    """Page count, dated share and, from discovery, the news and feed flags per site."""
    dated = F.col("url").rlike(L.DATED_PATH).cast("int")
    d = pages.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("pages"), (F.avg(dated) >= L.DATED_SHARE).alias("dated")
    )
    if sites is not None:
        d = sites.select("site_id").join(d, "site_id", "left").fillna({"pages": 0, "dated": False})
    if flags is not None:
        d = d.join(flags.select("site_id", "is_news", "is_feed"), "site_id", "left")
        return d.fillna({"is_news": False, "is_feed": False})
    return d.withColumns({"is_news": F.lit(False), "is_feed": F.lit(False)})


def first_intervals(signals: DataFrame) -> DataFrame:
    return signals.withColumn(
        "interval_s",
        freshness.first_interval(F.col("pages"), F.col("is_news"), F.col("is_feed"), F.col("dated")),
    )


def check_streaks(checks: DataFrame, key: str, order: list[str], chunk: int = CHUNK) -> DataFrame:
    """Number the checks of a key and give each its signed streak, itself included.

    Works on chunks of consecutive checks, so a key with most of the log is spread
    out.  Only one small row per chunk is looked at key by key.
    """
    d = positions(checks, [key], order, "n").withColumn("chunk", F.floor((F.col("n") - 1) / chunk))
    ends = d.groupBy(key, "chunk").agg(F.max_by("changed", "n").alias("end"))
    by_chunk = Window.partitionBy(key).orderBy("chunk")
    ends = ends.select(key, "chunk", F.lag("end").over(by_chunk).alias("end_before"))
    inside = Window.partitionBy(key, "chunk").orderBy("n")
    # the first check of a chunk follows the last one of the chunk before
    d = d.join(ends, [key, "chunk"])
    before = F.coalesce(F.lag("changed").over(inside), F.col("end_before"))
    d = d.withColumn("run", F.when(before.isNull() | (before != F.col("changed")), F.col("n")))
    d = d.withColumn(
        "run", F.max("run").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    last_run = d.groupBy(key, "chunk").agg(F.max("run").alias("last_run"))
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = last_run.select(key, "chunk", F.max("last_run").over(earlier).alias("carried"))
    d = d.join(carry, [key, "chunk"])
    length = F.col("n") - F.coalesce("run", "carried") + 1
    return d.withColumn(
        "streak", F.when(F.col("changed"), length).otherwise(-length).cast("bigint")
    ).drop("end_before", "run", "carried")


def break_points(rows: DataFrame, key: str, low: int, high: int, floor: int, ceiling: int) -> DataFrame:
    """The step function of each row's ``steps`` over [low, high]: where it changes and to what."""
    if high - low > MOST_POINTS:
        raise ValueError(f"a range of {high - low} intervals has too many break points")
    strong = L.STRONG_STREAK

    def points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            starts, outs = [], []
            for steps in frame["steps"]:
                start = out = np.arange(low, high + 1)
                for step in steps:
                    if step["changed"]:
                        out = np.maximum(out // (3 if step["before"] >= strong else 2), floor)
                    else:
                        out = np.minimum(out * 2 if step["before"] <= -strong else out * 3 // 2, ceiling)
                    new = np.append(True, out[1:] != out[:-1])
                    start, out = start[new], out[new]
                starts.append(start)
                outs.append(out)
            yield frame[[key, "at"]].assign(starts=starts, outs=outs)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col("at").cast("bigint").alias("at"), "steps").mapInPandas(
        points, f"{key} {kind}, at bigint, starts array<bigint>, outs array<bigint>"
    )


def composed(maps: DataFrame, key: str) -> DataFrame:
    """One step function per key from those at 0, 1, ...: neighbours are joined until one is left."""

    def pair(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        start, out = frame["starts"].iloc[0], frame["outs"].iloc[0]
        if len(frame) == 2:
            out = frame["outs"].iloc[1][np.searchsorted(frame["starts"].iloc[1], out, "right") - 1]
            new = np.append(True, out[1:] != out[:-1])
            start, out = start[new], out[new]
        return frame.head(1).assign(at=frame["at"] // 2, starts=[start], outs=[out])

    maps = materialize(maps)
    while maps.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0] > 0:
        pairs = maps.withColumn("half", F.shiftright("at", 1)).groupBy(key, "half")
        maps = materialize(pairs.applyInPandas(lambda f: pair(f.drop(columns="half")), maps.schema))
    return maps.drop("at")


def fold_cadence(
    checks: DataFrame,
    key: str,
    order: list[str],
    start: int = L.SITE_DEFAULT_INTERVAL_S,
    floor: int = L.SITE_FLOOR_S,
    ceiling: int = L.SITE_CEILING_S,
    chunk: int = CHUNK,
) -> DataFrame:
    """Interval and streak of every key after its whole check history.

    ``order[0]`` is the time of the check.  A step never reorders two intervals, so a
    chunk is a monotone step function of the interval before it.  One that maps the
    least and the greatest interval to one value is constant; long chunks are, and a key
    needs no more than what follows its last constant chunk.  The chunks between
    that one and the key's last are written as break points and composed in pairs, in as many
    rounds as their number has binary digits.
    """
    d = check_streaks(checks, key, order, chunk)
    before = F.when(F.abs("streak") > 1, F.col("streak") - F.signum("streak").cast("bigint"))
    # only the sign and strength of the streak before matter to a step
    before = F.coalesce(before, F.lit(0))
    steps = d.groupBy(key, "chunk").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("n", "changed", before.alias("before")))),
            lambda s: F.struct(s["changed"].alias("changed"), s["before"].alias("before")),
        ).alias("steps"),
        F.max("n").alias("checks"),
        F.max_by("streak", "n").alias("streak"),
        F.max(F.when(F.col("changed"), F.col(order[0]))).alias("changed_at"),
    )

    def run(interval: Column) -> Column:
        return F.aggregate(
            "steps",
            interval.cast("bigint"),
            lambda i, s: freshness.next_interval(i, s["changed"], s["before"], floor, ceiling),
        )

    low, high = min(floor, start), max(ceiling, start)
    first = F.col("chunk") == 0
    d = steps.withColumns({"lo": run(F.when(first, start).otherwise(low)), "hi": run(F.when(first, start).otherwise(high))})
    d = materialize(d)
    known = F.col("lo") == F.col("hi")
    ends = d.groupBy(key).agg(
        F.max("chunk").alias("end"),
        F.max(F.when(known, F.col("chunk"))).alias("from"),
        F.max_by("lo", F.when(known, F.col("chunk"))).alias("value"),
        F.max("changed_at").alias("last_changed_at"),
    )
    into = F.col("value")
    last = d.join(ends, key).where(F.col("chunk") == F.col("end"))
    if ends.agg(F.max(F.col("end") - F.col("from"))).first()[0] not in (None, 0, 1):
        between = d.join(ends, key).where((F.col("chunk") > F.col("from")) & (F.col("chunk") < F.col("end")))
        maps = break_points(between.withColumn("at", F.col("chunk") - F.col("from") - 1), key, low, high, floor, ceiling)
        last = last.join(composed(maps, key), key, "left")
        into = F.coalesce(F.get("outs", F.size(F.filter("starts", lambda x: x <= F.col("value"))) - 1), into)
    last = (
        last.withColumn("into", into)
        .withColumn("out", F.when(known, F.col("lo")).otherwise(run(F.col("into"))))
        .select(key, F.struct("out", "streak", "checks").alias("last"), "last_changed_at")
    )
    return last.select(
        key,
        F.col("last.checks").cast("bigint").alias("checks"),
        F.col("last.out").alias("interval_s"),
        F.col("last.streak").alias("streak"),
        "last_changed_at",
    )
