"""One monitor tick over every due site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webcairn import limits as L
from webcairn.functions import freshness
from webcairn.operators import monitor, upsert
from webcairn.operators.ranking import spread_join
from webcairn.session import materialize


def monitor_tick(
    sites: DataFrame,
    pages: DataFrame,
    entries: DataFrame,
    responses: DataFrame,
    now: int,
    limit: int | None = None,
) -> dict[str, DataFrame]:
    """Changes, summaries, page table, site cadence and queued runs after checking the due sites.

    ``responses`` are landed conditional fetches; only those of this tick's
    candidates count.  A site with changes gets one run, whose id depends on site and ``now``
    alone, so a repeated tick queues the same run.
    """
    due = materialize(monitor.due_sites(sites, now, limit))
    ids = due.select("site_id")
    active = spread_join(pages.where(F.col("status") == "active"), ids, ["site_id"])
    current = monitor.current_entries(spread_join(entries, ids, ["site_id"]))
    # a site without entries has no sitemap to differ from: its pages are sampled, none is removed
    listed = materialize(current.select("site_id").distinct())
    diff = materialize(monitor.diff_sitemap(active.join(listed, "site_id", "left_semi"), current))
    chosen = monitor.monitor_candidates(active, diff, now).select("site_id", "url")
    checks = materialize(monitor.resolve_checks(active, responses.join(chosen, ["site_id", "url"])))
    changes = materialize(monitor.build_changes(diff, checks))
    summary = materialize(monitor.summarize_changes(changes, due, checks))
    fresh = monitor.check_freshness(active, checks, now)
    columns = ["last_checked_at", "last_changed_at", "page_check_interval_s", "page_change_streak"]
    news = fresh.select("site_id", "url", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    merged = pages.join(news, ["site_id", "url"], "left")
    merged = merged.withColumns(
        {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    ).select(*pages.columns)
    changed = F.col("regenerate")
    cadence = due.join(summary.select("site_id", "regenerate"), "site_id").withColumns(
        {
            "check_interval_s": freshness.next_site_interval(F.col("check_interval_s"), changed, F.col("change_streak")),
            "change_streak": freshness.next_streak(F.col("change_streak"), changed),
        }
    )
    run_id = F.substring(F.sha2(F.concat_ws(":", "site_id", F.lit(now).cast("string")), 256), 1, 12)
    runs = summary.where("regenerate").select(
        run_id.alias("run_id"),
        "site_id",
        F.lit("monitor").alias("trigger"),
        F.lit(L.RUN_STATUSES[0]).alias("status"),
        "pages_changed",
        "change_summary",
        F.lit(now).cast("bigint").alias("started_at"),
    )
    return {
        "changes": changes,
        "runs": runs,
        "summary": summary,
        "pages": upsert.mark_removed(merged, changes.where("bucket = 'removed'")),
        "cadence": cadence.withColumn("next_check_at", F.lit(now) + F.col("check_interval_s")).drop("regenerate"),
    }
