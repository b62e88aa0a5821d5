"""Change detection and cadence arithmetic, one step at a time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webcairn import limits as L


def conditional_outcome(
    status: Column,
    etag: Column,
    last_modified: Column,
    stored_etag: Column,
    stored_last_modified: Column,
) -> Column:
    """Outcome of a conditional fetch: unchanged, modified, removed or error."""
    known_etag = F.nullif(stored_etag, F.lit(""))
    known_date = F.nullif(stored_last_modified, F.lit(""))
    same = F.coalesce(known_etag == etag, F.lit(False)) | (
        known_etag.isNull() & F.coalesce(known_date == last_modified, F.lit(False))
    )
    return (
        F.when(status == 304, "unchanged")
        .when(status.isin(404, 410), "removed")
        .when(status != 200, "error")
        .when(same, "unchanged")
        .otherwise("modified")
    )


def hash_changed(stored: Column, current: Column) -> Column:
    return F.coalesce(stored != current, F.lit(False))


def resolved_outcome(outcome: Column, current_hash: Column) -> Column:
    """With a body hash at hand, "modified" is left to the hash."""
    return F.when(current_hash.isNotNull() & (outcome == "modified"), "unchanged").otherwise(outcome)


def check_changed(outcome: Column, stored_hash: Column, current_hash: Column) -> Column:
    return F.when(current_hash.isNotNull(), hash_changed(stored_hash, current_hash)).otherwise(
        outcome == "modified"
    )


def next_interval(
    interval: Column, changed: Column, streak: Column, floor: int, ceiling: int
) -> Column:
    """Interval after a check; ``streak`` is the one before it."""
    divisor = F.when(streak >= L.STRONG_STREAK, 3).otherwise(2)
    shorter = F.greatest(F.floor(interval / divisor), F.lit(floor))
    longer = F.least(
        F.when(streak <= -L.STRONG_STREAK, interval * 2).otherwise(F.floor(interval * 3 / 2)),
        F.lit(ceiling),
    )
    return F.when(changed, shorter).otherwise(longer).cast("bigint")


def next_site_interval(interval: Column, changed: Column, streak: Column) -> Column:
    return next_interval(interval, changed, streak, L.SITE_FLOOR_S, L.SITE_CEILING_S)


def next_page_interval(interval: Column, changed: Column, streak: Column) -> Column:
    return next_interval(interval, changed, streak, L.PAGE_FLOOR_S, L.PAGE_CEILING_S)


def next_streak(streak: Column, changed: Column) -> Column:
    up = F.when(streak > 0, streak + 1).otherwise(1)
    down = F.when(streak < 0, streak - 1).otherwise(-1)
    return F.when(changed, up).otherwise(down).cast("bigint")


def first_interval(pages: Column, news: Column, feed: Column, dated: Column) -> Column:
    """Prior of a site's first check interval."""
    return (
        F.when(news | feed, 6 * L.HOUR)
        .when(dated, 12 * L.HOUR)
        .when(pages <= L.SMALL_SITE_PAGES, 72 * L.HOUR)
        .otherwise(24 * L.HOUR)
        .cast("bigint")
    )
