"""Queries over versions, change detection, upserts and cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webcairn import limits as L
from webcairn.catalog import views
from webcairn.catalog.ctes import define, oracle, section, segments
from webcairn.functions import freshness
from webcairn.operators import cadence, monitor, upsert, versions
from webcairn.operators.ranking import positions
from webcairn.session import materialize
from webcairn.sources.tables import load_active_pages

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

NOW = 1_700_000_000

# The stored page table: the first snapshot, without every tenth page.
STORED = """
SELECT site_id, url, page_id, title, description, h1, snippet, CAST(NULL AS varchar(20)) AS section_hint,
  CASE WHEN page_id % 8 = 1 THEN NULL ELSE content_hash END AS content_hash,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'e' || CAST(page_id % 100 AS varchar(20)) END AS etag,
  CASE WHEN page_id % 2 = 0 THEN '2024-01-' || CAST(10 + page_id % 20 AS varchar(20)) END AS last_modified,
  CASE WHEN page_id % 6 = 5 THEN NULL ELSE '2024-02-' || CAST(10 + page_id % 18 AS varchar(20)) END AS sitemap_lastmod,
  CASE WHEN page_id % 14 = 6 THEN 'error' ELSE 'active' END AS status,
  CASE WHEN page_id % 9 = 4 THEN NULL ELSE CAST(1699000000 + page_id % 7 * 86400 AS bigint) END AS last_seen_at,
  CASE WHEN page_id % 6 = 0 THEN NULL ELSE CAST(1700000000 - page_id % 37 * 30000 AS bigint) END AS last_checked_at,
  CASE WHEN page_id % 5 = 2 THEN NULL ELSE CAST(1690000000 + page_id AS bigint) END AS last_changed_at,
  CAST(604800 / (1 + page_id % 4) AS bigint) AS page_check_interval_s,
  CAST(page_id % 9 - 4 AS bigint) AS page_change_streak
FROM {rows} WHERE page_id % 10 <> 3
"""
# What the sitemaps list now: without other pages, some dates moved, links as written, some listed again later.
CURRENT = """
SELECT site_id, url || CASE WHEN page_id % 4 = 0 THEN '#now' ELSE '' END AS url,
  CASE WHEN page_id % 5 = 0 THEN '2024-03-01' WHEN page_id % 6 = 5 THEN NULL
       ELSE '2024-02-' || CAST(10 + page_id % 18 AS varchar(20)) END AS lastmod, page_id
FROM {rows} WHERE page_id % 10 <> 7
UNION ALL
SELECT site_id, url, '2024-04-01', page_id + 1000000000 FROM {rows} WHERE page_id % 15 IN (5, 6) AND page_id % 10 <> 7
"""
# Answers to conditional fetches.
RESPONSES = """
SELECT site_id, url, page_id, status, CASE WHEN page_id % 5 = 0 THEN 'new' WHEN page_id % 4 = 0 THEN NULL
    ELSE 'e' || CAST(page_id % 100 AS varchar(20)) END AS etag,
  CASE WHEN page_id % 8 = 4 THEN 'later' ELSE '2024-01-' || CAST(10 + page_id % 20 AS varchar(20)) END AS last_modified,
  CASE WHEN status <> 200 OR page_id % 3 = 1 THEN NULL WHEN page_id % 5 = 0 THEN 'v2-' || content_hash ELSE content_hash END AS current_hash,
  title || CASE WHEN page_id % 5 = 0 THEN ' v2' ELSE '' END AS title, description, h1, snippet,
  CASE WHEN page_id % 5 = 0 THEN 'v2-' || content_hash ELSE content_hash END AS content_hash,
  CASE status WHEN 200 THEN 'html' WHEN 304 THEN 'unchanged' ELSE 'error' END AS ingest
FROM (SELECT *, CASE page_id % 11 WHEN 3 THEN 404 WHEN 5 THEN 304 WHEN 7 THEN 500 WHEN 8 THEN 410 ELSE 200 END AS status FROM {rows}) AS r
"""
RUNS = """
SELECT site_id, CASE WHEN site_id = 'example.net' THEN NULL ELSE CAST(1699200000 AS bigint) END AS started_at
FROM (SELECT DISTINCT site_id FROM {rows}) AS s
"""
# Sites under monitoring: one per user of the events.
SITES = """
SELECT 'u' || CAST(user_id AS varchar(20)) AS site_id,
  (CASE WHEN user_id % 4 = 3 THEN 'http://' ELSE 'https://' END) || CASE WHEN user_id % 3 = 0 THEN 'Shop' ELSE 'docs' END || CAST(user_id AS varchar(20)) || '.example.com' AS origin,
  user_id % 5 <> 2 AS monitoring, CAST(3600 * (1 + user_id % 200) AS bigint) AS check_interval_s,
  CASE WHEN user_id % 11 = 6 THEN NULL ELSE CAST(1700000000 + (user_id % 50 - 40) * 1000 AS bigint) END AS next_check_at,
  n AS change_streak, CAST(first_s AS bigint) AS created_at
FROM (SELECT user_id, min(epoch_s) AS first_s, CAST(count(*) AS bigint) AS n FROM {timed} GROUP BY user_id) AS u
"""

for _name, _text in (("stored", STORED), ("current_rows", CURRENT), ("responses", RESPONSES), ("runs", RUNS)):
    define(_name, ("page_rows",), _text.format(rows="page_rows"))
define("sites", ("timed",), SITES.format(timed="timed"))


def snap(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    rows = materialize(
        views.page_rows(spark, sf).select(
            "site_id", "url", "page_id", "title", "description", "h1", "snippet", "content_hash"
        )
    )
    texts = {"stored": STORED, "current": CURRENT, "responses": RESPONSES, "runs": RUNS}
    return {name: spark.sql(text, rows=rows) for name, text in texts.items()}


def sites_table(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(SITES, timed=views.timed(spark, sf))


def diffed(s: dict[str, DataFrame]) -> DataFrame:
    return monitor.diff_sitemap(s["stored"], monitor.current_entries(s["current"], order=["page_id"]))


def active_pages(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    return load_active_pages(s["stored"], s["runs"]).select("site_id", "url", "last_seen_at")


QUERIES["active_pages"] = active_pages
ORACLE["active_pages"] = oracle(
    """SELECT site_id, url, last_seen_at FROM stored JOIN runs USING (site_id)
WHERE status = 'active' AND (started_at IS NULL OR last_seen_at >= started_at)""",
    "stored",
    "runs",
)


def sitemap_diff(spark: SparkSession, sf: str) -> DataFrame:
    return diffed(snap(spark, sf))


QUERIES["sitemap_diff"] = sitemap_diff
define("current", ("current_rows",), """
SELECT * EXCLUDE (url), replace(url, '#now', '') AS url FROM current_rows
QUALIFY row_number() OVER (PARTITION BY site_id, replace(url, '#now', '') ORDER BY page_id) = 1""")
define(
    "site_diff",
    ("stored", "current"),
    """
SELECT coalesce(s.site_id, c.site_id) AS site_id, coalesce(s.url, c.url) AS url, CASE WHEN s.url IS NULL THEN 'added' WHEN c.url IS NULL THEN 'removed'
  WHEN lastmod <> '' AND sitemap_lastmod <> '' AND lastmod <> sitemap_lastmod THEN 'lastmod_changed' ELSE 'kept' END AS change
FROM stored s FULL JOIN current c ON s.site_id = c.site_id AND s.url = c.url""",
)
ORACLE["sitemap_diff"] = oracle("SELECT * FROM site_diff", "site_diff")


def sitemap_diff_raw(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    return monitor.diff_sitemap(s["stored"], monitor.current_entries(s["current"], False, ["page_id"]))


QUERIES["sitemap_diff_raw"] = sitemap_diff_raw
ORACLE["sitemap_diff_raw"] = oracle(
    """
SELECT coalesce(s.site_id, c.site_id) AS site_id, coalesce(s.url, c.url) AS url, CASE WHEN s.url IS NULL THEN 'added' WHEN c.url IS NULL THEN 'removed'
  WHEN lastmod <> '' AND sitemap_lastmod <> '' AND lastmod <> sitemap_lastmod THEN 'lastmod_changed' ELSE 'kept' END AS change
FROM stored s FULL JOIN (SELECT * FROM current_rows QUALIFY row_number() OVER (PARTITION BY site_id, url ORDER BY page_id) = 1) c ON s.site_id = c.site_id AND s.url = c.url""",
    "stored",
    "current_rows",
)


def url_sets(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    old, new = (d.select("site_id", F.regexp_replace("url", "#now$", "").alias("url")).distinct() for d in (s["stored"], s["current"]))
    sides = {"added": new.subtract(old), "removed": old.subtract(new), "kept": old.intersect(new)}
    parts = [d.withColumn("side", F.lit(name)) for name, d in sides.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES["url_sets"] = url_sets
ORACLE["url_sets"] = oracle(
    """
SELECT *, 'added' AS side FROM (SELECT site_id, url FROM current EXCEPT SELECT site_id, url FROM stored)
UNION ALL SELECT *, 'removed' FROM (SELECT site_id, url FROM stored EXCEPT SELECT site_id, url FROM current)
UNION ALL SELECT *, 'kept' FROM (SELECT site_id, url FROM stored INTERSECT SELECT site_id, url FROM current)""",
    "stored",
    "current",
)


def check_resolved(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    return monitor.resolve_checks(s["stored"], s["responses"])


QUERIES["check_resolved"] = check_resolved
define(
    "check_rows",
    ("stored", "responses"),
    """
SELECT *, CASE WHEN current_hash IS NOT NULL AND outcome = 'modified' THEN 'unchanged' ELSE outcome END AS resolved,
  CASE WHEN current_hash IS NOT NULL THEN hash_changed ELSE outcome = 'modified' END AS changed FROM (
  SELECT s.site_id, s.url, s.page_id, current_hash, coalesce(s.content_hash <> current_hash, false) AS hash_changed,
    CASE WHEN r.status = 304 THEN 'unchanged' WHEN r.status IN (404, 410) THEN 'removed' WHEN r.status <> 200 THEN 'error'
         WHEN s.etag IS NOT NULL AND r.etag IS NOT NULL AND s.etag = r.etag THEN 'unchanged'
         WHEN s.etag IS NULL AND s.last_modified IS NOT NULL AND s.last_modified = r.last_modified THEN 'unchanged'
         ELSE 'modified' END AS outcome
  FROM stored s JOIN responses r USING (site_id, url))""",
)
ORACLE["check_resolved"] = oracle(
    "SELECT site_id, url, outcome, resolved, changed, hash_changed FROM check_rows", "check_rows"
)


def check_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return check_resolved(spark, sf).groupBy("site_id", "outcome").agg(F.count(F.lit(1)).alias("checks"))


QUERIES["check_outcome"] = check_outcome
ORACLE["check_outcome"] = oracle(
    "SELECT site_id, outcome, count(*) AS checks FROM check_rows GROUP BY ALL", "check_rows"
)


def change_set(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    return monitor.build_changes(diffed(s), monitor.resolve_checks(s["stored"], s["responses"]))


QUERIES["change_set"] = change_set
define(
    "changes",
    ("site_diff", "check_rows"),
    """
SELECT coalesce(d.site_id, c.site_id) AS site_id, coalesce(d.url, c.url) AS url,
  CASE WHEN change = 'added' THEN 'added' WHEN change = 'removed' OR resolved = 'removed' THEN 'removed' ELSE 'modified' END AS bucket
FROM site_diff d FULL JOIN check_rows c ON d.site_id = c.site_id AND d.url = c.url
WHERE change IN ('added', 'removed') OR resolved IN ('removed', 'modified') OR hash_changed""",
)
ORACLE["change_set"] = oracle("SELECT * FROM changes", "changes")


def change_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    checks = monitor.resolve_checks(s["stored"], s["responses"])
    return monitor.summarize_changes(monitor.build_changes(diffed(s), checks), s["runs"], checks)


QUERIES["change_summary"] = change_summary
ORACLE["change_summary"] = oracle(
    """
SELECT *, added + removed + modified AS pages_changed, added + removed + modified > 0 AS regenerate,
  coalesce(nullif(concat_ws(', ', CASE WHEN added > 0 THEN added || CASE added WHEN 1 THEN ' page' ELSE ' pages' END || ' added' END,
    CASE WHEN removed > 0 THEN removed || CASE removed WHEN 1 THEN ' page' ELSE ' pages' END || ' removed' END,
    CASE WHEN modified > 0 THEN modified || CASE modified WHEN 1 THEN ' page' ELSE ' pages' END || ' modified' END), ''), 'no changes') AS change_summary
FROM (
  SELECT site_id, count(*) FILTER (bucket = 'added') AS added, count(*) FILTER (bucket = 'removed') AS removed,
    count(*) FILTER (bucket = 'modified') AS modified, (SELECT count(*) FROM check_rows c WHERE c.site_id = r.site_id AND outcome = 'error') AS errors
  FROM runs r LEFT JOIN changes USING (site_id) GROUP BY site_id)""",
    "runs",
    "changes",
    "check_rows",
)


def monitor_candidates(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    return monitor.monitor_candidates(s["stored"], diffed(s), NOW)


QUERIES["monitor_candidates"] = monitor_candidates
define("due", ("stored",), f"SELECT * FROM stored WHERE last_checked_at IS NULL OR last_checked_at + page_check_interval_s <= {NOW}")
URL_DEPTH = segments("regexp_extract(url, '^https://[^/?]+([^?]*)', 1)")
ORACLE["monitor_candidates"] = oracle(
    f"""
SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY tier, stale, depth, url) AS rank FROM (
    SELECT site_id, url, 0 AS tier, 0 AS stale, {URL_DEPTH} AS depth FROM site_diff WHERE change = 'lastmod_changed'
    UNION ALL
    SELECT site_id, url, 1, coalesce(last_checked_at, 0), {URL_DEPTH} FROM due
    WHERE (site_id, url) NOT IN (SELECT (site_id, url) FROM site_diff WHERE change IN ('lastmod_changed', 'removed')))""",
    "site_diff",
    "due",
)


def due_pages(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.due_pages(snap(spark, sf)["stored"], NOW).select("site_id", "url", "last_checked_at")


QUERIES["due_pages"] = due_pages
ORACLE["due_pages"] = oracle("SELECT site_id, url, last_checked_at FROM due", "due")


def due_sites(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.due_sites(sites_table(spark, sf), NOW).select("site_id", "next_check_at")


QUERIES["due_sites"] = due_sites
ORACLE["due_sites"] = oracle(
    f"SELECT site_id, next_check_at FROM sites WHERE monitoring AND next_check_at <= {NOW}",
    "sites",
)


def retire_pages(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    removed = change_set(spark, sf).where("bucket = 'removed'")
    marked = upsert.mark_removed(s["stored"], removed)
    return upsert.retire_missed(marked, s["runs"]).select("site_id", "url", "status")


QUERIES["retire_pages"] = retire_pages
ORACLE["retire_pages"] = oracle(
    """
SELECT site_id, url, CASE WHEN (site_id, url) IN (SELECT (site_id, url) FROM changes WHERE bucket = 'removed') THEN 'removed'
  WHEN status = 'active' AND last_seen_at < started_at THEN 'removed' ELSE status END AS status
FROM stored LEFT JOIN runs USING (site_id)""",
    "stored",
    "runs",
    "changes",
)


def page_upsert(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    links = F.array(F.lit("/a"))
    stored = s["stored"].drop("page_id").withColumn("out_links", F.lit(None).cast("array<string>"))
    fetched = s["responses"].withColumn("out_links", links)
    return upsert.upsert_pages(stored, fetched, NOW).drop("out_links")


QUERIES["page_upsert"] = page_upsert


def stepped(interval: str, changed: str, streak: str, floor: int, ceiling: int) -> str:
    return (
        f"CAST(CASE WHEN {changed} THEN greatest({interval} // CASE WHEN {streak} >= 3 THEN 3 ELSE 2 END, {floor}) "
        f"ELSE least(CASE WHEN {streak} <= -3 THEN {interval} * 2 ELSE {interval} * 3 // 2 END, {ceiling}) END AS BIGINT)"
    )


def streaked(streak: str, changed: str) -> str:
    return (
        f"CAST(CASE WHEN {changed} THEN CASE WHEN {streak} > 0 THEN {streak} + 1 ELSE 1 END "
        f"ELSE CASE WHEN {streak} < 0 THEN {streak} - 1 ELSE -1 END END AS BIGINT)"
    )


ORACLE["page_upsert"] = oracle(
    f"""
SELECT site_id, url, CASE WHEN html THEN f_title ELSE title END AS title, CASE WHEN html THEN f_description ELSE description END AS description,
  CASE WHEN html THEN f_h1 ELSE h1 END AS h1, CASE WHEN html THEN f_snippet ELSE snippet END AS snippet,
  CASE WHEN html THEN {section("regexp_extract(url, '^https://[^/?]+([^?]*)', 1)")} ELSE section_hint END AS section_hint,
  CASE WHEN html THEN f_hash ELSE content_hash END AS content_hash, CASE WHEN html THEN f_etag ELSE etag END AS etag,
  CASE WHEN html THEN f_modified ELSE last_modified END AS last_modified, sitemap_lastmod,
  CASE WHEN ingest = 'error' THEN 'error' WHEN ingest IS NOT NULL THEN 'active' ELSE status END AS status,
  CASE WHEN ingest IS NOT NULL THEN {NOW} ELSE last_seen_at END AS last_seen_at,
  CASE WHEN ingest IS NOT NULL THEN {NOW} ELSE last_checked_at END AS last_checked_at,
  CASE WHEN html THEN CASE WHEN moved THEN {NOW} ELSE coalesce(last_changed_at, {NOW}) END ELSE last_changed_at END AS last_changed_at,
  CASE WHEN ingest IN ('html', 'unchanged') THEN {stepped('i', 'html AND moved', 's', L.PAGE_FLOOR_S, L.PAGE_CEILING_S)} ELSE i END AS page_check_interval_s,
  CASE WHEN ingest IN ('html', 'unchanged') THEN {streaked('s', 'html AND moved')} ELSE s END AS page_change_streak
FROM (
  SELECT t.*, coalesce(t.page_check_interval_s, 604800) AS i, coalesce(t.page_change_streak, 0) AS s, r.* EXCLUDE (site_id, url, status, f_url, f_site),
    coalesce(t.site_id, f_site) AS site_id, coalesce(t.url, f_url) AS url, coalesce(ingest = 'html', false) AS html,
    t.content_hash IS NULL OR t.content_hash <> f_hash AS moved
  FROM (SELECT * EXCLUDE (page_id) FROM stored) t FULL JOIN (
    SELECT site_id, url, site_id AS f_site, url AS f_url, status, ingest, title AS f_title, description AS f_description, h1 AS f_h1, snippet AS f_snippet,
      content_hash AS f_hash, etag AS f_etag, last_modified AS f_modified FROM responses) r ON t.site_id = r.f_site AND t.url = r.f_url
) WHERE status IS NOT NULL OR ingest IN ('html', 'error')""".replace("SELECT t.*,", "SELECT t.* EXCLUDE (site_id, url),"),
    "stored",
    "responses",
)


def lastmod_upsert(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    entries = monitor.current_entries(s["current"], order=["page_id"])
    merged = upsert.upsert_lastmods(s["stored"].drop("page_id"), s["responses"], entries, NOW)
    return merged.select("site_id", "url", "title", "sitemap_lastmod", "status", "last_seen_at", "page_check_interval_s", "page_change_streak")


QUERIES["lastmod_upsert"] = lastmod_upsert
ORACLE["lastmod_upsert"] = oracle(
    f"""
SELECT coalesce(s.site_id, e.site_id) AS site_id, coalesce(s.url, e.url) AS url, title,
  CASE WHEN e.url IS NOT NULL THEN e.lastmod ELSE sitemap_lastmod END AS sitemap_lastmod,
  CASE WHEN e.url IS NOT NULL THEN 'active' ELSE status END AS status,
  CASE WHEN s.url IS NULL THEN {NOW} ELSE last_seen_at END AS last_seen_at,
  coalesce(page_check_interval_s, 604800) AS page_check_interval_s, coalesce(page_change_streak, 0) AS page_change_streak
FROM stored s FULL JOIN (SELECT c.* FROM current c JOIN responses r USING (site_id, url)) e
ON s.site_id = e.site_id AND s.url = e.url""",
    "stored",
    "current",
    "responses",
)


def page_freshness(spark: SparkSession, sf: str) -> DataFrame:
    s = snap(spark, sf)
    return monitor.check_freshness(s["stored"], monitor.resolve_checks(s["stored"], s["responses"]), NOW)


QUERIES["freshness"] = page_freshness
ORACLE["freshness"] = oracle(
    f"""
SELECT site_id, url, {NOW} AS last_checked_at, CASE WHEN outcome <> 'error' AND changed THEN {NOW} ELSE last_changed_at END AS last_changed_at,
  CASE WHEN outcome = 'error' THEN page_check_interval_s ELSE {stepped('page_check_interval_s', 'changed', 'page_change_streak', L.PAGE_FLOOR_S, L.PAGE_CEILING_S)} END AS page_check_interval_s,
  CASE WHEN outcome = 'error' THEN page_change_streak ELSE {streaked('page_change_streak', 'changed')} END AS page_change_streak
FROM stored JOIN (SELECT site_id, url, outcome, changed FROM check_rows) USING (site_id, url)""",
    "stored",
    "check_rows",
)


# --- cadence ----------------------------------------------------------------


def signals(spark: SparkSession, sf: str) -> DataFrame:
    hosts = views.web(spark, sf).select(
        F.concat("site_id", F.lit("/"), F.pmod("page_id", F.lit(40)).cast("string")).alias("site_id"), "url", "page_id"
    )
    flags = hosts.groupBy("site_id").agg(
        F.bool_or(F.col("page_id") % 50 == 3).alias("is_news"), F.bool_or(F.col("page_id") % 50 == 4).alias("is_feed")
    )
    return cadence.cadence_signals(hosts, flags)


QUERIES["cadence_signals"] = signals
define(
    "signals",
    ("web",),
    """
SELECT site_id || '/' || (page_id % 40) AS site_id, count(*) AS pages, avg(CASE WHEN regexp_matches(url, '/[0-9]{4}/[0-9]{2}/') THEN 1 ELSE 0 END) >= 0.2 AS dated,
  bool_or(page_id % 50 = 3) AS is_news, bool_or(page_id % 50 = 4) AS is_feed
FROM web GROUP BY 1""",
)
ORACLE["cadence_signals"] = oracle("SELECT * FROM signals", "signals")


def cadence_prior(spark: SparkSession, sf: str) -> DataFrame:
    return cadence.first_intervals(signals(spark, sf)).select("site_id", "interval_s")


QUERIES["cadence_prior"] = cadence_prior
ORACLE["cadence_prior"] = oracle(
    """SELECT site_id, CAST(CASE WHEN is_news OR is_feed THEN 21600 WHEN dated THEN 43200 WHEN pages <= 15 THEN 259200 ELSE 86400 END AS BIGINT) AS interval_s
FROM signals""",
    "signals",
)

# One step from every stored state the events give rise to.
STATES = """
SELECT event_id, CAST(3600 + (event_id * 7919) % 700000 AS bigint) AS interval_s, CAST(user_id % 11 - 5 AS bigint) AS streak,
  event_type IN ('purchase', 'error') AS changed
FROM {events}
"""
define("states", (), STATES.format(events="events"))


def cadence_step(spark: SparkSession, sf: str) -> DataFrame:
    states = spark.sql(STATES, events=views.table(spark, sf, "events"))
    args = (F.col("interval_s"), F.col("changed"), F.col("streak"))
    return states.select(
        "event_id",
        freshness.next_site_interval(*args).alias("site_interval"),
        freshness.next_page_interval(*args).alias("page_interval"),
        freshness.next_streak(F.col("streak"), F.col("changed")).alias("next_streak"),
    )


QUERIES["cadence_step"] = cadence_step
ORACLE["cadence_step"] = oracle(
    f"""SELECT event_id, {stepped('interval_s', 'changed', 'streak', L.SITE_FLOOR_S, L.SITE_CEILING_S)} AS site_interval,
  {stepped('interval_s', 'changed', 'streak', L.PAGE_FLOOR_S, L.PAGE_CEILING_S)} AS page_interval, {streaked('streak', 'changed')} AS next_streak
FROM states""",
    "states",
)


def change_streaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = cadence.check_streaks(views.checks(spark, sf), "site_id", ["checked_at", "event_id"])
    return rows.select("site_id", "event_id", F.col("n").cast("bigint").alias("n"), "streak")


QUERIES["change_streaks"] = change_streaks
define(
    "numbered_checks",
    ("checks",),
    "SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY checked_at, event_id) AS n FROM checks",
)
ORACLE["change_streaks"] = oracle(
    """
SELECT site_id, event_id, n, CASE WHEN changed THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY site_id, changed, island ORDER BY n) AS streak
FROM (SELECT *, n - row_number() OVER (PARTITION BY site_id, changed ORDER BY n) AS island FROM numbered_checks)""",
    "numbered_checks",
)


def cadence_fold(spark: SparkSession, sf: str) -> DataFrame:
    return cadence.fold_cadence(views.checks(spark, sf), "site_id", ["checked_at", "event_id"])


QUERIES["cadence_fold"] = cadence_fold
FOLD_ORACLE = oracle(
    f"""
SELECT site_id, n AS checks, interval_s, streak, last_changed_at FROM fold
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY n DESC) = 1""",
    "numbered_checks",
).replace(
    "SELECT site_id, n AS checks, interval_s",
    f""", fold AS (
  SELECT site_id, CAST(0 AS BIGINT) AS n, CAST({L.SITE_DEFAULT_INTERVAL_S} AS BIGINT) AS interval_s, CAST(0 AS BIGINT) AS streak, CAST(NULL AS BIGINT) AS last_changed_at
  FROM (SELECT DISTINCT site_id FROM numbered_checks)
  UNION ALL
  SELECT f.site_id, c.n, {stepped('f.interval_s', 'c.changed', 'f.streak', L.SITE_FLOOR_S, L.SITE_CEILING_S)}, {streaked('f.streak', 'c.changed')},
    CASE WHEN c.changed THEN c.checked_at ELSE f.last_changed_at END
  FROM fold f JOIN numbered_checks c ON c.site_id = f.site_id AND c.n = f.n + 1
)
SELECT site_id, n AS checks, interval_s""",
).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["cadence_fold"] = FOLD_ORACLE


# --- versions ---------------------------------------------------------------


def version_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.doc_lines(spark, sf)
    numbered = positions(docs.select("site_id", "doc_id"), ["site_id"], ["doc_id"], "version")
    return docs.join(numbered, ["site_id", "doc_id"]).withColumn("run_id", F.concat(F.lit("run"), F.col("doc_id").cast("string")))


define(
    "vers",
    ("doc_lines",),
    "SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY doc_id) AS version, 'run' || doc_id AS run_id FROM doc_lines",
)


def version_next(spark: SparkSession, sf: str) -> DataFrame:
    return versions.next_versions(sites_of_versions(spark, sf), version_rows(spark, sf))


def sites_of_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every source in every language, with documents or not."""
    docs = views.table(spark, sf, "documents")
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "it")])
    return docs.select("source").distinct().select(
        F.explode(F.transform(langs, lambda x: F.concat("source", F.lit("-"), x))).alias("site_id")
    )


QUERIES["version_next"] = version_next
ORACLE["version_next"] = oracle(
    """
SELECT site_id, coalesce(max(version), 0) + 1 AS version
FROM (SELECT DISTINCT source || '-' || unnest(['de', 'en', 'es', 'fr', 'it']) AS site_id FROM documents) LEFT JOIN vers USING (site_id) GROUP BY ALL""",
    "vers",
)


def version_latest(spark: SparkSession, sf: str) -> DataFrame:
    return versions.latest_versions(version_rows(spark, sf)).select("site_id", "version", "doc_id", F.sha2("content", 256).alias("digest"))


QUERIES["version_latest"] = version_latest
ORACLE["version_latest"] = oracle(
    """SELECT site_id, version, doc_id, sha256(content) AS digest FROM vers QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY version DESC) = 1""",
    "vers",
)


def version_list(spark: SparkSession, sf: str) -> DataFrame:
    return versions.version_list(version_rows(spark, sf))


QUERIES["version_list"] = version_list
ORACLE["version_list"] = oracle("SELECT site_id, doc_id, version, run_id FROM vers", "vers")


def version_specific(spark: SparkSession, sf: str) -> DataFrame:
    wanted = views.table(spark, sf, "documents").select(
        F.concat("source", F.lit("-"), "lang").alias("site_id"), (F.col("doc_id") % 5 - 1).alias("version")
    )
    return versions.specific_versions(version_rows(spark, sf), wanted).select("site_id", "version", "doc_id")


QUERIES["version_specific"] = version_specific
ORACLE["version_specific"] = oracle(
    """SELECT site_id, version, doc_id FROM vers WHERE (site_id, version) IN (
  SELECT (source || '-' || lang, doc_id % 5 - 1) FROM documents) AND version >= 1""",
    "vers",
)


def publish_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    rows = version_rows(spark, sf)
    published = rows.where("doc_id % 3 > 0").drop("content")
    last = rows.groupBy("site_id").agg(F.max("doc_id").alias("doc_id"))
    new = last.select("site_id", F.concat(F.lit("run"), F.col("doc_id").cast("string")).alias("run_id"))
    return upsert.append_versions(new, published)


QUERIES["publish_idempotent"] = publish_idempotent
ORACLE["publish_idempotent"] = oracle(
    """
SELECT site_id, 'run' || d AS run_id, coalesce(last, 0) + 1 AS version FROM (
  SELECT site_id, max(doc_id) AS d, max(version) FILTER (doc_id % 3 > 0) AS last FROM vers GROUP BY ALL) WHERE d % 3 = 0""",
    "vers",
)


def version_line_delta(spark: SparkSession, sf: str) -> DataFrame:
    return versions.line_delta(versions.version_pairs(version_rows(spark, sf)))


QUERIES["version_line_delta"] = version_line_delta
define(
    "version_lines",
    ("vers",),
    "SELECT site_id, version, unnest(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS line FROM vers WHERE content <> ''",
)
ORACLE["version_line_delta"] = oracle(
    """
SELECT site_id, to_version - 1 AS from_version, to_version, line, CAST(sum(sign) AS BIGINT) AS delta FROM (
  SELECT site_id, version AS to_version, line, 1 AS sign FROM version_lines WHERE version > 1
  UNION ALL
  SELECT site_id, version + 1, line, -1 FROM version_lines JOIN (SELECT site_id, max(version) AS top FROM vers GROUP BY ALL) USING (site_id) WHERE version < top)
GROUP BY ALL HAVING sum(sign) <> 0""",
    "version_lines",
)


def version_diff(spark: SparkSession, sf: str) -> DataFrame:
    return versions.diff_hunks(versions.diff_versions(versions.version_pairs(version_rows(spark, sf))))


QUERIES["version_diff"] = version_diff
#: Longest common lines by a table over both tails, a walk through it that prefers to drop, and the text of its hunks.
DIFF_SQL = """
WITH RECURSIVE {heads},
numbered AS (
  SELECT a.site_id, a.version AS v, row_number() OVER () AS pair,
    CASE WHEN a.content = '' THEN [] ELSE string_split(regexp_replace(a.content, '\\n$', ''), chr(10)) END AS old,
    CASE WHEN b.content = '' THEN [] ELSE string_split(regexp_replace(b.content, '\\n$', ''), chr(10)) END AS new
  FROM vers a JOIN vers b ON a.site_id = b.site_id AND b.version = a.version + 1 WHERE a.content <> b.content
), texts AS MATERIALIZED (SELECT * FROM numbered),
tails AS (
  SELECT pair, CAST(len(old) AS BIGINT) AS i, j, CAST(0 AS BIGINT) AS kept, old, new FROM texts, unnest(range(len(new) + 1)) AS u(j)
  UNION ALL
  SELECT pair, i - 1, j, max(best) OVER (PARTITION BY pair ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), old, new FROM (
    SELECT pair, i, j, old, new, CASE WHEN old[i] = new[j + 1] THEN 1 + lead(kept) OVER (PARTITION BY pair ORDER BY j) ELSE kept END AS best
    FROM tails WHERE i > 0)
), grid AS MATERIALIZED (SELECT pair, i, list(kept ORDER BY j) AS kept FROM tails GROUP BY ALL),
walk AS (
  SELECT pair, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(-1 AS BIGINT) AS k, '' AS tag, '' AS line, CAST(0 AS BIGINT) AS old_at, CAST(0 AS BIGINT) AS new_at FROM texts
  UNION ALL
  SELECT pair, CASE step WHEN '+' THEN i ELSE i + 1 END, CASE step WHEN '-' THEN j ELSE j + 1 END, k + 1, step,
    CASE step WHEN '+' THEN new[j + 1] ELSE old[i + 1] END, i, j
  FROM (
    SELECT w.pair, w.i, w.j, w.k, t.old, t.new,
      CASE WHEN w.i < len(t.old) AND w.j < len(t.new) AND t.old[w.i + 1] = t.new[w.j + 1] THEN ' '
        WHEN w.i < len(t.old) AND (w.j = len(t.new) OR below.kept[w.j + 1] >= here.kept[w.j + 2]) THEN '-' ELSE '+' END AS step
    FROM walk w JOIN texts t USING (pair) JOIN grid here ON here.pair = w.pair AND here.i = w.i
      LEFT JOIN grid below ON below.pair = w.pair AND below.i = w.i + 1
    WHERE w.i < len(t.old) OR w.j < len(t.new))
), ops AS MATERIALIZED (SELECT pair, k, tag, line, old_at, new_at, max(k) OVER (PARTITION BY pair) AS top FROM walk WHERE k >= 0),
changes AS (
  SELECT *, sum(CASE WHEN {apart} THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY k) AS hunk
  FROM (SELECT *, lag(k) OVER (PARTITION BY pair ORDER BY k) AS before FROM ops WHERE tag <> ' ')
), ranges AS (SELECT pair, hunk, {lo} AS lo, {hi} AS hi FROM changes GROUP BY pair, hunk),
hunks AS (
  SELECT pair, hunk, count(*) FILTER (tag <> '+') AS olds, count(*) FILTER (tag <> '-') AS news, min(old_at) AS old_at, min(new_at) AS new_at,
    string_agg(tag || line, chr(10) ORDER BY k) AS body
  FROM ranges JOIN ops USING (pair) WHERE k BETWEEN lo AND hi GROUP BY pair, hunk
)
SELECT site_id, any_value(v) AS from_version, any_value(v) + 1 AS to_version,
  '--- v' || any_value(v) || chr(10) || '+++ v' || (any_value(v) + 1) || chr(10) || string_agg(
    '@@ -' || (old_at + CAST(olds > 0 AS INT)) || ',' || olds || ' +' || (new_at + CAST(news > 0 AS INT)) || ',' || news || ' @@' || chr(10) || body,
    chr(10) ORDER BY hunk) || chr(10) AS diff
FROM hunks JOIN texts USING (pair) GROUP BY site_id, pair
"""


def diff_sql(apart: str, lo: str, hi: str) -> str:
    heads = oracle("", "vers").removeprefix("WITH ").rstrip()
    return DIFF_SQL.format(heads=heads, apart=apart, lo=lo, hi=hi)


ORACLE["version_diff"] = diff_sql("before IS NULL OR k - before > 6", "greatest(min(k) - 3, 0)", "least(max(k) + 3, max(top))")


def version_diff_whole(spark: SparkSession, sf: str) -> DataFrame:
    return versions.diff_hunks(versions.diff_versions(versions.version_pairs(version_rows(spark, sf))), None)


QUERIES["version_diff_whole"] = version_diff_whole
ORACLE["version_diff_whole"] = diff_sql("before IS NULL", "0", "max(top)")


def version_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    return versions.rebuild_old(versions.diff_versions(versions.version_pairs(version_rows(spark, sf))))


QUERIES["version_rebuild"] = version_rebuild
ORACLE["version_rebuild"] = oracle(
    """
SELECT a.site_id, a.version AS from_version, b.version AS to_version, regexp_replace(a.content, '\\n$', '') AS old_text
FROM vers a JOIN vers b ON a.site_id = b.site_id AND b.version = a.version + 1 WHERE a.content <> b.content""",
    "vers",
)


def version_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen version pairs, each with the number of lines that differ."""
    rows = version_rows(spark, sf)
    wanted = rows.select("site_id", (F.col("version") - 2).alias("from_version"), F.col("version").alias("to_version"))
    delta = versions.line_delta(versions.version_pairs(rows, wanted))
    return delta.groupBy("site_id", "from_version", "to_version").agg(F.sum(F.abs("delta")).cast("bigint").alias("lines"))


QUERIES["version_compare"] = version_compare
ORACLE["version_compare"] = oracle(
    """
SELECT site_id, t - 2 AS from_version, t AS to_version, CAST(sum(abs(delta)) AS BIGINT) AS lines FROM (
  SELECT site_id, t, line, sum(sign) AS delta FROM (
    SELECT site_id, version AS t, line, 1 AS sign FROM version_lines WHERE version > 2
    UNION ALL
    SELECT site_id, version + 2, line, -1 FROM version_lines JOIN (SELECT site_id, max(version) AS top FROM vers GROUP BY ALL) USING (site_id) WHERE version <= top - 2)
  GROUP BY ALL HAVING sum(sign) <> 0) GROUP BY ALL""",
    "version_lines",
)
