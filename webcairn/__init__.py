"""Site indexes and change monitoring as Spark jobs.

One function per job, DataFrames in and out.
"""

from webcairn.operators.cadence import cadence_signals, check_streaks, first_intervals, fold_cadence
from webcairn.operators.document import (
    assemble,
    choose_documents,
    document_lines,
    parse_lines,
    split_documents,
    validate_lines,
)
from webcairn.operators.extract import (
    cap_body,
    extract_links,
    extract_meta_tags,
    extract_pages,
    ingest_pages,
    poison_rows,
)
from webcairn.operators.frontier import admit, eligible_links, fetch_list, replay_links, walk_links
from webcairn.operators.inventory import build_inventory, nested_inventory, site_heads
from webcairn.operators.monitor import (
    build_changes,
    check_freshness,
    diff_sitemap,
    due_pages,
    due_sites,
    monitor_candidates,
    resolve_checks,
    summarize_changes,
)
from webcairn.operators.plan import apply_plan, prompt_payloads, prompt_rows
from webcairn.operators.quality import assess_quality, choose_render, render_budget
from webcairn.operators.reports import (
    admitted_requests,
    lookup_sites,
    progress_rows,
    redact_logs,
    request_windows,
    run_progress,
    search_sites,
    site_dashboard,
    site_list,
    stale_runs,
)
from webcairn.operators.robots import exclude_disallowed, parse_robots
from webcairn.operators.sitemap import alias_entries, expand_sitemaps, parse_sitemaps, prioritize
from webcairn.operators.upsert import (
    append_versions,
    mark_removed,
    retire_missed,
    upsert_lastmods,
    upsert_pages,
)
from webcairn.operators.versions import (
    diff_hunks,
    diff_versions,
    latest_versions,
    line_delta,
    rebuild_old,
    version_pairs,
)
from webcairn.plans.discover import discover
from webcairn.plans.generate import generate_documents, pages_from_snapshots
from webcairn.plans.monitor import monitor_tick
from webcairn.plans.publish import publish_generation, start_generation

__all__ = [name for name in dir() if not name.startswith("_") and name not in {"operators", "plans", "functions", "limits", "session"}]
