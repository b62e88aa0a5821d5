"""Change detection between stored pages and what a site shows now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from webcairn import limits as L
from webcairn.functions import freshness
from webcairn.functions.text import change_summary
from webcairn.functions.urls import canonical_urls, path_depth
from webcairn.operators.ranking import first_by, ranked

KEYS = ["site_id", "url"]
BUCKETS = ("added", "removed", "modified")


def current_entries(
    entries: DataFrame, canonical: bool = True, order: Sequence[str] = ("fetch_no", "pos")
) -> DataFrame:
    """Sitemap entries as URL and date, one row per URL: the date listed first by ``order``.

    Entries without those columns have no order; the least date stands there.  Stored URLs are canonical, so entries are made canonical too; ``False`` compares
    them as written.
    """
    rows = canonical_urls(entries, "url").where(F.col("url").isNotNull()) if canonical else entries
    listed = [c for c in order if c in rows.columns]
    return first_by(rows.select(*KEYS, *listed, "lastmod"), KEYS, [*listed, "lastmod"]).select(*KEYS, "lastmod")


def diff_sitemap(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Every URL of either side as added, removed, lastmod_changed or kept."""
    s = stored.select(*KEYS, "sitemap_lastmod", F.lit(True).alias("was"))
    c = current.select(*KEYS, "lastmod", F.lit(True).alias("now"))
    moved = (
        (F.coalesce("lastmod", F.lit("")) != "")
        & (F.coalesce("sitemap_lastmod", F.lit("")) != "")
        & (F.col("lastmod") != F.col("sitemap_lastmod"))
    )
    return s.join(c, KEYS, "full_outer").select(
        *KEYS,
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(moved, "lastmod_changed")
        .otherwise("kept")
        .alias("change"),
    )


def resolve_checks(stored: DataFrame, responses: DataFrame) -> DataFrame:
    """Conditional fetches against stored validators and hashes.

    ``outcome`` is what HTTP says, ``resolved`` what remains once a body hash
    decides, ``changed`` whether the page changed.
    """
    r = responses.select(
        *KEYS, "status", F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_modified"), "current_hash"
    )
    d = stored.select(*KEYS, "etag", "last_modified", "content_hash").join(r, KEYS)
    return judged(d).select(*KEYS, "outcome", "resolved", "changed", "hash_changed")


def judged(d: DataFrame) -> DataFrame:
    """Rows of a response (status, new_etag, new_modified, current_hash) beside the stored page, with what it says."""
    d = d.withColumn(
        "outcome",
        freshness.conditional_outcome(
            F.col("status"), F.col("new_etag"), F.col("new_modified"), F.col("etag"), F.col("last_modified")
        ),
    )
    return d.withColumns(
        {
            "resolved": freshness.resolved_outcome(F.col("outcome"), F.col("current_hash")),
            "changed": freshness.check_changed(F.col("outcome"), F.col("content_hash"), F.col("current_hash")),
            "hash_changed": freshness.hash_changed(F.col("content_hash"), F.col("current_hash")),
        }
    )


def build_changes(diff: DataFrame, checks: DataFrame) -> DataFrame:
    """One bucket per changed URL: added before removed before modified; errors say nothing."""
    listed = diff.where(F.col("change").isin("added", "removed")).select(
        *KEYS, F.when(F.col("change") == "added", 0).otherwise(1).alias("rank")
    )
    checked = checks.select(
        *KEYS,
        F.when(F.col("resolved") == "removed", 1)
        .when((F.col("resolved") == "modified") | F.col("hash_changed"), 2)
        .alias("rank"),
    ).where(F.col("rank").isNotNull())
    merged = listed.unionByName(checked).groupBy(*KEYS).agg(F.min("rank").alias("rank"))
    names = F.array(*[F.lit(b) for b in BUCKETS])
    return merged.select(*KEYS, F.get(names, F.col("rank")).alias("bucket"))


def summarize_changes(changes: DataFrame, sites: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Counts per site, the summary text and whether a new document is worth building."""
    counts = changes.groupBy("site_id").agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    )
    d = sites.select("site_id").join(counts, "site_id", "left").fillna(0, list(BUCKETS))
    if checks is not None:
        errors = checks.groupBy("site_id").agg(F.count_if(F.col("outcome") == "error").alias("errors"))
        d = d.join(errors, "site_id", "left").fillna(0, ["errors"])
    total = F.col("added") + F.col("removed") + F.col("modified")
    return d.withColumns(
        {
            "pages_changed": total,
            "regenerate": total > 0,
            "change_summary": change_summary(F.col("added"), F.col("removed"), F.col("modified")),
        }
    )


def check_freshness(stored: DataFrame, checks: DataFrame, now: int) -> DataFrame:
    """Freshness columns after a check; an error only moves the time of the last check."""
    d = stored.join(checks.select(*KEYS, "outcome", "changed"), KEYS)
    ok = F.col("outcome") != "error"
    interval, streak = F.col("page_check_interval_s"), F.col("page_change_streak")
    changed = F.col("changed")
    return d.select(
        *KEYS,
        F.lit(now).cast("bigint").alias("last_checked_at"),
        F.when(ok & changed, F.lit(now)).otherwise(F.col("last_changed_at")).cast("bigint").alias("last_changed_at"),
        F.when(ok, freshness.next_page_interval(interval, changed, streak)).otherwise(interval).alias("page_check_interval_s"),
        F.when(ok, freshness.next_streak(streak, changed)).otherwise(streak).alias("page_change_streak"),
    )


def due_pages(pages: DataFrame, now: int) -> DataFrame:
    """Pages whose check interval has run out; a page never checked is due."""
    due_at = F.coalesce(F.col("last_checked_at") + F.col("page_check_interval_s"), F.lit(0))
    return pages.where(due_at <= now)


def monitor_candidates(
    pages: DataFrame, diff: DataFrame, now: int, limit: int | None = None
) -> DataFrame:
    """Pages to check per site, all or ``limit``: dated by the sitemap first, then the stalest due ones."""
    depth = path_depth(F.col("url"))
    zero = F.lit(0).cast("bigint")
    moved = diff.where(F.col("change") == "lastmod_changed").select(
        *KEYS, F.lit(0).alias("tier"), zero.alias("stale"), depth.alias("depth")
    )
    skip = diff.where(F.col("change").isin("lastmod_changed", "removed")).select(*KEYS)
    stale = (
        due_pages(pages, now)
        .join(skip, KEYS, "left_anti")
        .select(*KEYS, F.lit(1).alias("tier"), F.coalesce("last_checked_at", zero).alias("stale"), depth.alias("depth"))
    )
    return ranked(moved.unionByName(stale), ["site_id"], ["tier", "stale", "depth", "url"], limit)


def due_sites(sites: DataFrame, now: int, limit: int | None = None) -> DataFrame:
    """Monitored sites whose next check has come, the longest waiting first; all of them, or ``limit``."""
    due = sites.where(F.col("monitoring") & (F.col("next_check_at") <= now))
    due = due.orderBy("next_check_at", "site_id")
    return due if limit is None else due.limit(limit)
