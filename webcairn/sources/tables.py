"""Table schemas and readers.

Landed tables are the inputs of every job: fetching is left to other tools.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webcairn.operators.ranking import spread_join


SITES = (
    "site_id string, origin string, display_name string, monitoring boolean, "
    "check_interval_s bigint, next_check_at bigint, change_streak bigint, created_at bigint"
)
PAGES = (
    "site_id string, url string, title string, description string, h1 string, snippet string, "
    "section_hint string, content_hash string, etag string, last_modified string, "
    "sitemap_lastmod string, out_links array<string>, status string, last_seen_at bigint, "
    "last_checked_at bigint, last_changed_at bigint, page_check_interval_s bigint, "
    "page_change_streak bigint"
)
CRAWL_RUNS = (
    "run_id string, site_id string, trigger string, status string, pages_found bigint, "
    "pages_crawled bigint, pages_changed bigint, change_summary string, discovery_method string, "
    "cap_reason string, error string, started_at bigint, finished_at bigint"
)
FILE_VERSIONS = (
    "site_id string, run_id string, version bigint, path string, change_summary string, "
    "generated_by string, created_at bigint"
)
PAGE_SNAPSHOTS = (
    "site_id string, run_id string, url string, depth bigint, fetched_at bigint, status int, "
    "content_type string, content_length bigint, etag string, last_modified string, html string, "
    "rendered_html string"
)
SITE_DOCS = (
    "site_id string, run_id string, doc_url string, kind string, status int, body string, "
    "declared_pos bigint, fetched_at bigint"
)
CHECK_LOG = (
    "site_id string, url string, checked_at bigint, status int, etag string, "
    "last_modified string, html_hash string"
)
CRAWL_EVENTS = (
    "site_id string, run_id string, ts timestamp, url string, event string, depth bigint"
)

SCHEMAS = {
    "sites": SITES,
    "pages": PAGES,
    "crawl_runs": CRAWL_RUNS,
    "file_versions": FILE_VERSIONS,
    "page_snapshots": PAGE_SNAPSHOTS,
    "site_docs": SITE_DOCS,
    "check_log": CHECK_LOG,
    "crawl_events": CRAWL_EVENTS,
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored table with its declared schema; no inference pass over the files."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_documents(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Robots or sitemap files, one row per file, whole unless ``cap`` cuts them; ``.gz`` bodies are unpacked by the reader."""
    raw = spark.read.text(path, wholetext=True)
    body = F.col("value") if cap is None else F.substring("value", 1, cap)
    return raw.select(F.col("_metadata.file_path").alias("doc_url"), body.alias("body"))


def load_active_pages(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Active pages seen since the start of their site's run (no start, no bound)."""
    bound = runs.select("site_id", "started_at")
    seen = F.col("started_at").isNull() | (F.col("last_seen_at") >= F.col("started_at"))
    active = pages.where(F.col("status") == "active")
    return spread_join(active, bound, ["site_id"]).where(seen).drop("started_at")


def page_inventory(pages: DataFrame) -> DataFrame:
    """Active pages as the inventory read lists them."""
    return (
        pages.where(F.col("status") == "active")
        .select("site_id", "url", "title", "description", "section_hint", "status")
        .orderBy("site_id", "url")
    )
