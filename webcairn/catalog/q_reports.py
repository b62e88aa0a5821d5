"""Queries over runs, requests, site lists, logs and table contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webcairn import limits as L
from webcairn.catalog import views
from webcairn.catalog.ctes import define, oracle
from webcairn.catalog.q_monitor import sites_table, snap
from webcairn.operators import contracts, reports
from webcairn.operators.ranking import positions
from webcairn.sources.tables import page_inventory

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

NOW = 1_704_067_200 + 10 * 86_400

# Crawl runs: one per run id of the crawl events.
RUN_ROWS = """
SELECT run_id, CASE n % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'crawling' WHEN 2 THEN 'generating' WHEN 3 THEN 'done' ELSE 'error' END AS status,
  n AS pages_found, n - 1 AS pages_crawled, CAST(first_s AS bigint) AS started_at,
  CASE first_s % 5 WHEN 0 THEN 'fetch_failed: 1' WHEN 1 THEN 'robots' WHEN 2 THEN 'timeout after 10' WHEN 3 THEN NULL ELSE 'boom' END AS error
FROM (SELECT run_id, CAST(count(*) AS bigint) AS n, min(ts) AS first_s FROM {crawl_events} GROUP BY run_id) AS r
"""
REQUESTS = """
SELECT event_id AS request_id, 'c' || CAST(user_id AS varchar(20)) AS client, CAST(epoch_s AS bigint) AS ts_s FROM {timed}
"""
# Purchases as published versions of the user's site.
PUBLISHED = """
SELECT 'u' || CAST(user_id AS varchar(20)) AS site_id, event_id, CAST(epoch_s AS bigint) AS created_at
FROM {timed} WHERE event_type = 'purchase'
"""
LOGS = """
SELECT event_id, '{{"k":' || k || ',"Authorization":"Bearer ' || k || '","msg":"token ' || q || event_type || q || '","ok":true,"ctx":{{"apiKey":' || k
  || ',"n":null,"deep":[{{"secret_id":1,"v":' || k || '}},"x"]}},"userToken":[1,2]}}' AS record
FROM (SELECT event_id, event_type, chr(92) || '"' AS q, regexp_extract(props, '([0-9]+)', 1) AS k FROM {events}) AS e
"""
PARAMS = """
SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'https%3A%2F%2Fdocs' || u || '.example.com' WHEN 1 THEN 'docs' || u || '.example.com'
  WHEN 2 THEN 'HTTPS://Docs' || u || '.example.com:443/a?b' WHEN 3 THEN 'Shop' || u || '.example.com' ELSE 'none+' || u || '%' END AS param
FROM (SELECT DISTINCT user_id, CAST(user_id AS varchar(20)) AS u FROM {events}) AS e
"""

define("run_rows", ("crawl_events",), RUN_ROWS.format(crawl_events="crawl_events"))
define("requests", ("timed",), REQUESTS.format(timed="timed"))
define("published_events", ("timed",), PUBLISHED.format(timed="timed"))
define(
    "published",
    ("published_events",),
    "SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY event_id) AS version FROM published_events",
)
define("params", (), PARAMS.format(events="events"))


def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    return reports.run_progress(views.crawl_events(spark, sf))


QUERIES["run_progress"] = run_progress
define(
    "progress",
    ("crawl_events",),
    f"""
SELECT *, found - crawled AS in_flight, found >= {L.MAX_PAGES} AS capped, found > 0 AND found = crawled AS drained FROM (
  SELECT run_id, count(a) AS found, count(*) FILTER (c > a) AS crawled FROM (
    SELECT run_id, url, min(event_id) FILTER (event IN ('seed', 'link')) AS a, max(event_id) FILTER (event = 'complete') AS c
    FROM crawl_events GROUP BY ALL) GROUP BY ALL)""",
)
ORACLE["run_progress"] = oracle("SELECT * FROM progress", "progress")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(RUN_ROWS, crawl_events=views.crawl_events(spark, sf))


def progress_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reports.progress_rows(runs(spark, sf), run_progress(spark, sf))


QUERIES["progress_rows"] = progress_rows
ORACLE["progress_rows"] = oracle(
    """
SELECT run_id, status, phase, found, crawled, CASE WHEN status = 'done' THEN 1.0 WHEN phase = 0 THEN 0.0
  WHEN phase = 1 THEN 1.0::DOUBLE / 3 + CASE WHEN found > 0 THEN least(crawled / found, 1.0::DOUBLE) ELSE 0 END * (1.0::DOUBLE / 3)
  WHEN phase = 2 THEN 2 * (1.0::DOUBLE / 3) ELSE 1.0::DOUBLE / 3 END AS fraction,
  CASE WHEN status = 'error' THEN CASE WHEN coalesce(error, '') = '' THEN 'unknown' WHEN starts_with(error, 'fetch_failed') THEN 'unreachable'
    WHEN starts_with(error, 'robots') THEN 'robots' WHEN starts_with(error, 'timeout') THEN 'timeout' ELSE error END END AS error_class
FROM (
  SELECT r.*, CAST(CASE status WHEN 'queued' THEN 0 WHEN 'crawling' THEN 1 WHEN 'generating' THEN 2 ELSE 3 END AS BIGINT) AS phase,
    CASE WHEN status = 'done' THEN pages_found ELSE coalesce(p.found, pages_found) END AS found,
    CASE WHEN status = 'done' THEN pages_crawled ELSE coalesce(p.crawled, pages_crawled) END AS crawled
  FROM run_rows r LEFT JOIN progress p USING (run_id))""",
    "run_rows",
    "progress",
)


def stale_runs(spark: SparkSession, sf: str) -> DataFrame:
    return reports.stale_runs(runs(spark, sf), NOW).select("run_id", "status", "started_at")


QUERIES["stale_runs"] = stale_runs
ORACLE["stale_runs"] = oracle(
    f"SELECT run_id, status, started_at FROM run_rows WHERE status NOT IN ('done', 'error') AND started_at < {NOW - L.STALE_RUN_S}",
    "run_rows",
)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(REQUESTS, timed=views.timed(spark, sf))


def request_windows(spark: SparkSession, sf: str) -> DataFrame:
    return reports.request_windows(requests(spark, sf), 86_400, 3)


QUERIES["request_windows"] = request_windows
define(
    "windows",
    ("requests",),
    "SELECT client, ts_s // 86400 * 86400 AS window_start, count(*) AS requests, least(count(*), 3) AS admitted FROM requests GROUP BY ALL",
)
ORACLE["request_windows"] = oracle("SELECT * FROM windows", "windows")


def request_admission(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.admitted_requests(requests(spark, sf), 86_400, 3)
    return rows.select("request_id", "client", "window_start", F.col("rank").cast("bigint").alias("rank"))


QUERIES["request_admission"] = request_admission
ORACLE["request_admission"] = oracle(
    """SELECT request_id, client, ts_s // 86400 * 86400 AS window_start, row_number() OVER (PARTITION BY client, ts_s // 86400 ORDER BY ts_s, request_id) AS rank
FROM requests QUALIFY rank <= 3""",
    "requests",
)


def published(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(PUBLISHED, timed=views.timed(spark, sf))
    return positions(rows, ["site_id"], ["event_id"], "version")


def site_search(spark: SparkSession, sf: str) -> DataFrame:
    sites = sites_table(spark, sf)
    by_url = reports.search_sites(sites, " HTTPS://Docs1.EXAMPLE.com/x ")
    by_text = reports.search_sites(sites, "SHOP1")
    return by_url.unionByName(by_text).select("site_id", "origin")


QUERIES["site_search"] = site_search
ORACLE["site_search"] = oracle(
    """
SELECT site_id, origin FROM sites WHERE contains(lower(origin), 'docs1.example.com')
UNION ALL
SELECT site_id, origin FROM sites WHERE contains(lower(origin), 'shop1')""",
    "sites",
)


def site_lookup(spark: SparkSession, sf: str) -> DataFrame:
    params = spark.sql(PARAMS, events=views.table(spark, sf, "events"))
    return reports.lookup_sites(params, "param", sites_table(spark, sf))


QUERIES["site_lookup"] = site_lookup
ORACLE["site_lookup"] = oracle(
    """
SELECT user_id, param, 'u' || user_id AS site_id FROM params JOIN sites s ON s.site_id = 'u' || user_id
WHERE CASE user_id % 5
  WHEN 0 THEN origin = 'https://docs' || user_id || '.example.com'
  WHEN 1 THEN origin IN ('https://docs' || user_id || '.example.com', 'http://docs' || user_id || '.example.com')
  WHEN 2 THEN origin = 'https://docs' || user_id || '.example.com'
  WHEN 3 THEN origin IN ('https://Shop' || user_id || '.example.com', 'http://Shop' || user_id || '.example.com') ELSE false END""",
    "params",
    "sites",
)


def site_list(spark: SparkSession, sf: str) -> DataFrame:
    return reports.site_list(sites_table(spark, sf), published(spark, sf)).select("site_id", "origin", "version", "version_at")


QUERIES["site_list"] = site_list
ORACLE["site_list"] = oracle(
    """
SELECT s.site_id, origin, version, p.created_at AS version_at FROM sites s
JOIN (SELECT * FROM published QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY version DESC) = 1) p USING (site_id)""",
    "sites",
    "published",
)


def site_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return reports.site_dashboard(sites_table(spark, sf), published(spark, sf), NOW + 20 * 86_400)


QUERIES["site_dashboard"] = site_dashboard
ORACLE["site_dashboard"] = oracle(
    f"""
SELECT site_id, origin, CASE WHEN h < 1 THEN 'every ' || CAST(floor(check_interval_s / 60 + 0.5) AS BIGINT) || ' minutes' WHEN h = 1 THEN 'hourly'
    WHEN h < 24 THEN 'every ' || CAST(floor(h + 0.5) AS BIGINT) || ' hours' WHEN h = 24 THEN 'daily' WHEN h = 168 THEN 'weekly'
    ELSE 'every ' || CAST(floor(h / 24 + 0.5) AS BIGINT) || ' days' END AS cadence,
  coalesce(version, 0) AS versions,
  CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN CAST(floor(age / 60 + 0.5) AS BIGINT) || 'm ago'
    WHEN age < 86400 THEN CAST(floor(age / 3600 + 0.5) AS BIGINT) || 'h ago' WHEN floor(age / 86400 + 0.5) = 1 THEN 'yesterday'
    ELSE CAST(floor(age / 86400 + 0.5) AS BIGINT) || 'd ago' END AS updated
FROM (SELECT s.*, check_interval_s / 3600 AS h, version, {NOW + 20 * 86_400} - p.created_at AS age FROM sites s
  LEFT JOIN (SELECT * FROM published QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY version DESC) = 1) p USING (site_id))""",
    "sites",
    "published",
)


def inventory_read(spark: SparkSession, sf: str) -> DataFrame:
    return page_inventory(snap(spark, sf)["stored"])


QUERIES["page_inventory"] = inventory_read
ORACLE["page_inventory"] = oracle(
    "SELECT site_id, url, title, description, section_hint, status FROM stored WHERE status = 'active'", "stored"
)


def log_redaction(spark: SparkSession, sf: str) -> DataFrame:
    logs = spark.sql(LOGS, events=views.table(spark, sf, "events"))
    return reports.redact_logs(logs)


QUERIES["log_redaction"] = log_redaction
ORACLE["log_redaction"] = oracle(
    """
SELECT event_id, '{"k":' || k || ',"Authorization":"[redacted]","msg":"token \\"' || event_type || '\\"","ok":true,"ctx":{"apiKey":"[redacted]","n":null,"deep":[{"secret_id":"[redacted]","v":'
  || k || '},"x"]},"userToken":"[redacted]"}' AS record
FROM (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)"""
)


def log_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.table(spark, sf, "pages").select(
        "page_id", F.when(F.col("page_id") % 9 == 4, F.concat(F.lit("not a url "), "url")).otherwise(F.col("url")).alias("url")
    )
    return reports.url_fields(pages, "url")


QUERIES["log_urls"] = log_urls
ORACLE["log_urls"] = oracle(
    """
SELECT page_id, CASE WHEN page_id % 9 <> 4 THEN regexp_extract(url, '^https?://[^/]+') END AS domain,
  CASE WHEN page_id % 9 <> 4 THEN regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) END AS path, page_id % 9 = 4 AS url_parse_error
FROM pages"""
)


def contract_checks(spark: SparkSession, sf: str) -> DataFrame:
    stored = snap(spark, sf)["stored"]
    web = views.web(spark, sf)
    sites = sites_table(spark, sf)
    run_rows = runs(spark, sf)
    return contracts.report(
        contracts.check_rows(
            stored,
            "pages",
            {
                "status known": contracts.allowed("status", L.PAGE_STATUSES),
                "hash present": F.col("content_hash").isNotNull(),
                "interval in range": F.col("page_check_interval_s").between(L.PAGE_FLOOR_S, L.PAGE_CEILING_S),
            },
        ),
        contracts.check_unique(stored, "pages", ["site_id", "url"]),
        contracts.check_unique(web, "landed", ["site_id", "url"]),
        contracts.check_rows(sites, "sites", {"next check set": F.col("next_check_at").isNotNull()}),
        contracts.check_unique(sites, "sites", ["origin"]),
        contracts.check_rows(run_rows, "runs", {"status known": contracts.allowed("status", L.RUN_STATUSES), "error present": F.col("error").isNotNull()}),
        contracts.check_unique(published(spark, sf), "versions", ["site_id", "version"]),
    )


QUERIES["contract_checks"] = contract_checks
ORACLE["contract_checks"] = oracle(
    """
SELECT 'pages' AS table_name, 'status known' AS rule, count(*) FILTER (status NOT IN ('active', 'removed', 'error')) AS violations FROM stored
UNION ALL SELECT 'pages', 'hash present', count(*) FILTER (content_hash IS NULL) FROM stored
UNION ALL SELECT 'pages', 'interval in range', count(*) FILTER (page_check_interval_s NOT BETWEEN 21600 AND 2592000) FROM stored
UNION ALL SELECT 'pages', 'unique site_id, url', count(*) - count(DISTINCT (site_id, url)) FROM stored
UNION ALL SELECT 'landed', 'unique site_id, url', count(*) - count(DISTINCT (site_id, url)) FROM web
UNION ALL SELECT 'sites', 'next check set', count(*) FILTER (next_check_at IS NULL) FROM sites
UNION ALL SELECT 'sites', 'unique origin', count(*) - count(DISTINCT origin) FROM sites
UNION ALL SELECT 'runs', 'status known', 0
UNION ALL SELECT 'runs', 'error present', count(*) FILTER (error IS NULL) FROM run_rows
UNION ALL SELECT 'versions', 'unique site_id, version', 0""",
    "stored",
    "web",
    "sites",
    "run_rows",
)
