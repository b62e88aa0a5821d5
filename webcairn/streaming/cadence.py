"""Adaptive cadence as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webcairn import limits as L

#: Of a bucket: its keys, seven numbers and the number of kept checks of each, and those checks key by key.
STATE = (
    "site_id array<string>, numbers array<bigint>, kept array<bigint>, "
    "at array<bigint>, event_id array<bigint>, changed array<boolean>"
)
#: Buckets of keys.  A batch calls Python once a bucket at most, however many keys it holds.
BUCKETS = 1 << 12
#: How late a check may come and still be folded in its place.
KEEP_S = 7 * L.DAY
FIELDS = ["interval_s", "streak", "checks", "last_checked_at", "last_changed_at", "next_check_at", "late"]
OUTPUT = "site_id string, " + ", ".join(f"{name} bigint" for name in FIELDS)


def _step(interval: int, streak: int, changed: bool, floor: int, ceiling: int) -> tuple[int, int]:
    if changed:
        interval = max(interval // (3 if streak >= L.STRONG_STREAK else 2), floor)
        return interval, streak + 1 if streak > 0 else 1
    interval = min(interval * 2 if streak <= -L.STRONG_STREAK else interval * 3 // 2, ceiling)
    return interval, streak - 1 if streak < 0 else -1


def cadence_stream(
    checks: DataFrame,
    start: int = L.SITE_DEFAULT_INTERVAL_S,
    floor: int = L.SITE_FLOOR_S,
    ceiling: int = L.SITE_CEILING_S,
    keep_s: int = KEEP_S,
    buckets: int = BUCKETS,
) -> DataFrame:
    """State of each key after every batch that holds checks of it.

    ``checks``: site_id, checked_at, event_id, changed.  Checks of the last ``keep_s``
    seconds before a key's newest one stay in its state in time order and are folded anew when
    a late one comes between them, so the result is that of a batch over all of them.
    Older checks are sealed into seven numbers; a check that belongs among them is counted as late.

    Keys share a state by the hash of their name, since a call of Python costs more than
    the checks that most keys have in a batch.  A batch rewrites the ``buckets`` it touches.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sites, numbers, kept, *held = state.get if state.exists else ([], [], [], [], [], [])
        place = {site: k for k, site in enumerate(sites)}
        parts = list(batches)
        codes = [np.array([place.setdefault(site, len(place)) for site in b["site_id"]], dtype=int) for b in parts]
        known, keys = len(sites), len(place)
        numbers = np.array(numbers + [start, 0, 0, -1, -1, 0, -1] * (keys - known), dtype=int).reshape(keys, 7)
        late, until = numbers[:, 5], numbers[:, 6]
        touched = np.zeros(keys, dtype=bool)
        touched[np.concatenate(codes)] = True

        def column(k: int, name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.array(held[k], dtype=kind), *[b[name].to_numpy() for b in parts]]).astype(kind)

        code = np.concatenate([np.repeat(np.arange(known), kept), *codes])
        when, name, flag = column(0, "checked_at", int), column(1, "event_id", int), column(2, "changed", bool)
        fresh = when > until[code]
        late += np.bincount(code[~fresh], minlength=keys)
        code, when, name, flag = code[fresh], when[fresh], name[fresh], flag[fresh]
        order = np.lexsort((name, when, code))
        code, when, name, flag = code[order], when[order], name[order], flag[order]
        np.maximum.at(until, code, when - keep_s)
        open_ = when > until[code]
        begin, end = (np.searchsorted(code, np.arange(keys), side) for side in ("left", "right"))
        cut = end - np.bincount(code[open_], minlength=keys)

        def folded(numbers: list[int], times: list[int], moves: list[bool]) -> list[int]:
            interval, streak, seen, last, moved = numbers
            for now, changed in zip(times, moves):
                interval, streak = _step(interval, streak, changed, floor, ceiling)
                last, moved = now, now if changed else moved
            return [interval, streak, seen + len(times), last, moved]

        times, moves, out = when.tolist(), flag.tolist(), []
        for k in np.flatnonzero(touched).tolist():
            i, j, n = int(begin[k]), int(cut[k]), int(end[k])
            sealed = folded(numbers[k, :5].tolist(), times[i:j], moves[i:j])
            numbers[k, :5] = sealed
            interval, streak, seen, last, moved = folded(sealed, times[j:n], moves[j:n])
            out.append((interval, streak, seen, last, moved, last + interval, int(late[k])))
        state.update(
            (list(place), numbers.ravel().tolist(), (end - cut).tolist(), when[open_].tolist(), name[open_].tolist(), flag[open_].tolist())
        )
        named = pd.DataFrame(out, columns=FIELDS)
        named.insert(0, "site_id", [site for site, had in zip(place, touched.tolist()) if had])
        yield named

    bucket = F.pmod(F.xxhash64("site_id"), F.lit(buckets)).alias("bucket")
    return checks.select(bucket, "site_id", "checked_at", "event_id", "changed").groupBy("bucket").applyInPandasWithState(
        fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout
    )


def latest_cadence(sink: DataFrame) -> DataFrame:
    """Newest state of each key from the written batches; -1 stands for a change never seen."""
    last = sink.groupBy("site_id").agg(F.max_by(F.struct(*FIELDS), "batch").alias("s"))
    rows = last.select("site_id", "s.*")
    return rows.withColumn(
        "last_changed_at", F.when(F.col("last_changed_at") >= 0, F.col("last_changed_at"))
    )
