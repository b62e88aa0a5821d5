"""Keyed merges: each returns the next version of a table, ready to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webcairn import limits as L
from webcairn.functions.freshness import next_page_interval, next_streak
from webcairn.functions.sections import section_of
from webcairn.functions.urls import path_of
from webcairn.operators.ranking import positions, spread_join

KEYS = ["site_id", "url"]
BODY_COLUMNS = (
    "title", "description", "h1", "snippet", "content_hash", "etag", "last_modified", "out_links",
)


def upsert_pages(stored: DataFrame, fetched: DataFrame, now: int) -> DataFrame:
    """Merge fetch results into the page table on (site, URL).

    ``fetched`` carries ``ingest``: *html* rows replace the extracted columns, a
    304 (*unchanged*) only renews a row that exists, *error* rows keep what is
    known.  Columns a case does not name stay as stored.
    """
    f = fetched.select(*KEYS, "ingest", *[F.col(c).alias(f"__{c}") for c in BODY_COLUMNS])
    d = stored.join(f, KEYS, "full_outer")
    html, same, bad = (F.col("ingest") == kind for kind in ("html", "unchanged", "error"))
    html, same, bad = (F.coalesce(x, F.lit(False)) for x in (html, same, bad))
    known = F.col("status").isNotNull()
    changed = ~F.coalesce(F.col("content_hash") == F.col("__content_hash"), F.lit(False))
    interval = F.coalesce("page_check_interval_s", F.lit(L.PAGE_DEFAULT_INTERVAL_S))
    streak = F.coalesce("page_change_streak", F.lit(0))
    verdict = html & changed

    def when_checked(value: Column, otherwise: Column) -> Column:
        return F.when(html | same, value).otherwise(otherwise)

    merged = {c: F.when(html, F.col(f"__{c}")).otherwise(F.col(c)) for c in BODY_COLUMNS}
    merged |= {
        "section_hint": F.when(html, section_of(path_of(F.col("url")))).otherwise(F.col("section_hint")),
        "status": F.when(html | same, "active").when(bad, "error").otherwise(F.col("status")),
        "last_seen_at": F.when(html | same | bad, F.lit(now)).otherwise(F.col("last_seen_at")),
        "last_checked_at": F.when(html | same | bad, F.lit(now)).otherwise(F.col("last_checked_at")),
        "last_changed_at": F.when(
            html, F.when(changed, F.lit(now)).otherwise(F.coalesce("last_changed_at", F.lit(now)))
        ).otherwise(F.col("last_changed_at")),
        "page_check_interval_s": when_checked(next_page_interval(interval, verdict, streak), interval),
        "page_change_streak": when_checked(next_streak(streak, verdict), streak),
    }
    keep = known | html | bad
    return d.where(keep).select(*[merged.get(c, F.col(c)).alias(c) for c in stored.columns])


def upsert_lastmods(stored: DataFrame, accepted: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """Merge sitemap dates of accepted URLs: new pages are seen now, known ones become active."""
    listed = accepted.select(*KEYS).join(
        entries.select(*KEYS, F.col("lastmod").alias("__lastmod")), KEYS
    ).withColumn("__listed", F.lit(True))
    d = stored.join(listed, KEYS, "full_outer")
    hit, known = F.col("__listed").isNotNull(), F.col("status").isNotNull()
    merged = {
        "sitemap_lastmod": F.when(hit, F.col("__lastmod")).otherwise(F.col("sitemap_lastmod")),
        "status": F.when(hit, "active").otherwise(F.col("status")),
        "last_seen_at": F.when(known, F.col("last_seen_at")).otherwise(F.lit(now)),
        "page_check_interval_s": F.coalesce("page_check_interval_s", F.lit(L.PAGE_DEFAULT_INTERVAL_S)),
        "page_change_streak": F.coalesce("page_change_streak", F.lit(0)),
    }
    return d.select(*[merged.get(c, F.col(c)).alias(c) for c in stored.columns])


def append_versions(new: DataFrame, versions: DataFrame) -> DataFrame:
    """New version rows whose run has published nothing yet, numbered after their site's last.

    Several new runs of one site are numbered in the order of their run ids.
    """
    fresh = new.join(versions.select("run_id"), "run_id", "left_anti")
    latest = versions.groupBy("site_id").agg(F.max("version").alias("last"))
    numbered = positions(fresh, ["site_id"], ["run_id"], "__n")
    return numbered.join(latest, "site_id", "left").withColumn(
        "version", (F.coalesce("last", F.lit(0)) + F.col("__n")).cast("bigint")
    ).drop("last", "__n")


def mark_removed(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """Pages the change set calls removed get that status."""
    gone = removed.select(*KEYS).withColumn("__gone", F.lit(True))
    return pages.join(gone, KEYS, "left").withColumn(
        "status", F.when(F.col("__gone"), "removed").otherwise(F.col("status"))
    ).drop("__gone")


def retire_missed(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Active pages last seen before their site's run began are removed; never seen is not missed."""
    starts = runs.select("site_id", "started_at")
    missed = (F.col("status") == "active") & (F.col("last_seen_at") < F.col("started_at"))
    return spread_join(pages, starts, ["site_id"], "left").withColumn(
        "status", F.when(missed, "removed").otherwise(F.col("status"))
    ).drop("started_at")
