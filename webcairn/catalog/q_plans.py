"""Whole jobs over the given tables: generation runs to published versions, and the monitor's tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webcairn import limits as L
from webcairn.catalog.ctes import again, amend, define, oracle
from webcairn.catalog.q_documents import DOCUMENT_ERRORS, PLAN, PLAN_HEADS
from webcairn.catalog.q_monitor import NOW, snap, stepped, streaked
from webcairn.plans.monitor import monitor_tick
from webcairn.plans.publish import INVALID_DOCUMENT, UNKNOWN_SITE, publish_generation, start_generation

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# --- generation -------------------------------------------------------------

# One site has another origin than its pages, so its documents break a rule.
GEN_SITES = """
SELECT DISTINCT site_id, CASE WHEN site_id = 'example.org' THEN 'https://www.example.org' ELSE 'https://' || site_id END AS origin
FROM {stored}
"""
# Five runs a site: of all pages, of pages seen since two times, of none, and one that has published; two of no site.
GEN_RUNS = """
SELECT DISTINCT site_id || '-g' || CAST(page_id % 5 AS varchar(20)) AS run_id, site_id,
  CAST(CASE page_id % 5 WHEN 1 THEN 1699200000 WHEN 2 THEN 1699400000 WHEN 3 THEN 1699900000 END AS bigint) AS started_at,
  CASE WHEN page_id % 5 IN (1, 3) THEN CAST(page_id % 5 AS varchar(20)) || ' pages modified' END AS change_summary
FROM {stored}
UNION ALL
SELECT DISTINCT 'lost-g' || CAST(page_id % 2 AS varchar(20)), 'lost', CAST(NULL AS bigint), CAST(NULL AS varchar(20)) FROM {stored}
"""
GEN_VERSIONS = """
SELECT DISTINCT site_id, site_id || CASE WHEN page_id % 5 = 4 THEN '-g4' ELSE '-old' END AS run_id,
  CAST(CASE WHEN page_id % 5 = 4 THEN 2 WHEN site_id = 'example.com' THEN 7 ELSE 1 END AS bigint) AS version
FROM {stored} WHERE page_id % 5 >= 3
"""


def by_run(sql: str) -> str:
    """The plan's text where sites are named, for tables keyed by run."""
    return sql.replace("site_id = 'example", "substr(site_id, 1, 11) = 'example")


def generation(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    stored = snap(spark, sf)["stored"]
    sites, runs, versions = (spark.sql(text, stored=stored) for text in (GEN_SITES, GEN_RUNS, GEN_VERSIONS))
    started = start_generation(stored, sites, runs, versions)
    plan = spark.sql(by_run(PLAN), inventory=started["inventory"])
    heads = spark.sql(by_run(PLAN_HEADS), heads=started["heads"])
    return publish_generation(started, versions, NOW, plan, heads)


for _name, _text in (("gen_sites", GEN_SITES), ("gen_runs", GEN_RUNS), ("gen_versions", GEN_VERSIONS)):
    define(_name, ("stored",), _text.format(stored="stored"))
define(
    "opened",
    ("gen_sites", "gen_runs", "gen_versions"),
    "SELECT r.*, origin FROM gen_runs r LEFT JOIN gen_sites USING (site_id) WHERE run_id NOT IN (SELECT run_id FROM gen_versions)",
)
define(
    "run_pages",
    ("stored", "opened"),
    """SELECT s.* REPLACE (run_id AS site_id), origin FROM stored s JOIN opened o ON s.site_id = o.site_id
WHERE status = 'active' AND (started_at IS NULL OR last_seen_at >= started_at)""",
)
again(
    "run_",
    ("classified", "heads", "placed", "inventory", "lines", "plan_rows", "plan_heads", "accepted", "plan_placed",
     "plan_votes", "refined", "refined_heads", "refined_lines"),
    page_rows="run_pages",
)
amend("run_classified", ("path IN ('', '/') AS", "path IN ('', '/') AND starts_with(url, origin) AS"))
amend(
    "run_heads",
    ("SELECT DISTINCT site_id, origin FROM run_classified", "SELECT run_id AS site_id, origin FROM opened WHERE origin IS NOT NULL"),
    ("s.site_id) AS site_name", "replace(s.origin, 'https://', '')) AS site_name"),
)
for _name in ("run_plan_rows", "run_plan_heads"):
    amend(_name, ("site_id = 'example", "substr(site_id, 1, 11) = 'example"))
for _lines in ("run_lines", "run_refined_lines"):
    define(
        f"{_lines}_broken",
        (_lines,),
        "SELECT site_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM ("
        + DOCUMENT_ERRORS.replace("candidate_lines", _lines).replace("doc_id", "site_id")
        + ") GROUP BY ALL",
    )
define(
    "run_chosen",
    ("run_lines", "run_refined_lines", "run_lines_broken", "run_refined_lines_broken"),
    """
SELECT * FROM (
  SELECT *, 'llm-refined' AS generated_by FROM run_refined_lines WHERE site_id NOT IN (SELECT site_id FROM run_refined_lines_broken)
  UNION ALL
  SELECT *, 'heuristic' FROM run_lines WHERE site_id NOT IN (
    SELECT site_id FROM run_refined_lines EXCEPT SELECT site_id FROM run_refined_lines_broken)
) WHERE site_id NOT IN (SELECT site_id FROM run_lines_broken)""",
)
define(
    "run_versions",
    ("run_chosen", "opened", "gen_versions"),
    f"""
SELECT site_id, run_id, coalesce(last, 0) + row_number() OVER (PARTITION BY site_id ORDER BY run_id) AS version,
  coalesce(change_summary, 'initial generation') AS change_summary, generated_by, CAST({NOW} AS BIGINT) AS created_at
FROM opened JOIN (SELECT DISTINCT site_id AS run_id, generated_by FROM run_chosen) USING (run_id)
LEFT JOIN (SELECT site_id, max(version) AS last FROM gen_versions GROUP BY ALL) USING (site_id)""",
)


def published_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Version rows of every generation run that has not published yet."""
    return generation(spark, sf)["versions"]


QUERIES["published_versions"] = published_versions
ORACLE["published_versions"] = oracle("SELECT *, site_id || '/v' || version || '.txt' AS path FROM run_versions", "run_versions")


def published_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of those versions, in parts."""
    return generation(spark, sf)["parts"]


QUERIES["published_parts"] = published_parts
ORACLE["published_parts"] = oracle(
    f"""
SELECT run_id, v.site_id, version, (line_no - 1) // {L.LINES_PER_PART} AS part_no, count(*) AS lines, string_agg(line, chr(10) ORDER BY line_no) AS content
FROM run_chosen c JOIN run_versions v ON c.site_id = run_id GROUP BY ALL""",
    "run_versions",
)


def generation_runs(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every open run; a broken heuristic document is an error row."""
    return generation(spark, sf)["runs"]


QUERIES["generation_runs"] = generation_runs
ORACLE["generation_runs"] = oracle(
    f"""
SELECT *, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status FROM (
  SELECT o.run_id, o.site_id, version, CASE WHEN origin IS NULL THEN '{UNKNOWN_SITE}' WHEN rules IS NOT NULL THEN '{INVALID_DOCUMENT}: ' || rules END AS error
  FROM opened o LEFT JOIN run_lines_broken b ON b.site_id = run_id LEFT JOIN run_versions v USING (run_id))""",
    "run_versions",
)

# --- monitor ----------------------------------------------------------------

# Each site in 37, a few without a sitemap; entries listed again have ids from 1,000,000,000 on.
TICK_SITES = """
SELECT DISTINCT site_id || '-' || CAST(page_id % 1000000000 % 37 AS varchar(20)) AS site_id, 'https://' || site_id AS origin, page_id % 1000000000 % 37 % 7 <> 3 AS monitoring,
  CAST(3600 * (1 + page_id % 1000000000 % 37) AS bigint) AS check_interval_s, CAST(1700000000 + (page_id % 1000000000 % 37 % 9 - 6) * 1000 AS bigint) AS next_check_at,
  CAST(page_id % 1000000000 % 37 % 9 - 4 AS bigint) AS change_streak
FROM {rows}
"""
TICK_ROWS = "SELECT site_id || '-' || CAST(page_id % 1000000000 % 37 AS varchar(20)) AS tick_site, * FROM {rows}"
NO_SITEMAP = "page_id % 1000000000 % 37 % 10 = 4"


def ticked(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    s = snap(spark, sf)
    own = {
        name: spark.sql(TICK_ROWS, rows=s[name]).drop("site_id").withColumnRenamed("tick_site", "site_id")
        for name in ("stored", "current", "responses")
    }
    entries = own["current"].where(f"NOT ({NO_SITEMAP})").withColumn("fetch_no", F.lit(0)).withColumnRenamed("page_id", "pos")
    return monitor_tick(spark.sql(TICK_SITES, rows=s["stored"]), own["stored"].drop("page_id"), entries, own["responses"], NOW)


define("tick_sites", ("stored",), TICK_SITES.format(rows="stored"))
for _name in ("stored", "current_rows", "responses"):
    define(f"tick_{_name}", (_name,), f"SELECT * EXCLUDE (tick_site) REPLACE (tick_site AS site_id) FROM ({TICK_ROWS.format(rows=_name)})")
define("tick_due", ("tick_sites",), f"SELECT * FROM tick_sites WHERE monitoring AND next_check_at <= {NOW}")
define(
    "tick_active",
    ("tick_stored", "tick_due"),
    "SELECT * FROM tick_stored WHERE status = 'active' AND site_id IN (SELECT site_id FROM tick_due)",
)
define(
    "tick_listing",
    ("tick_current_rows", "tick_due"),
    f"SELECT * FROM tick_current_rows WHERE NOT ({NO_SITEMAP}) AND site_id IN (SELECT site_id FROM tick_due)",
)
again("tick_", ("current",), current_rows="tick_listing")
define(
    "tick_mapped", ("tick_active", "tick_current"), "SELECT * FROM tick_active WHERE site_id IN (SELECT site_id FROM tick_current)"
)
again("tick_", ("site_diff",), stored="tick_mapped", current="tick_current")
define("tick_due_pages", ("tick_active",), f"SELECT * FROM tick_active WHERE last_checked_at IS NULL OR last_checked_at + page_check_interval_s <= {NOW}")
define(
    "tick_asked",
    ("tick_responses", "tick_site_diff", "tick_due_pages"),
    """
SELECT * FROM tick_responses WHERE (site_id, url) IN (SELECT (site_id, url) FROM tick_site_diff WHERE change = 'lastmod_changed')
  OR (site_id, url) IN (SELECT (site_id, url) FROM tick_due_pages EXCEPT SELECT (site_id, url) FROM tick_site_diff WHERE change = 'removed')""",
)
again("tick_", ("check_rows",), stored="tick_active", responses="tick_asked")
again("tick_", ("changes",), site_diff="tick_site_diff", check_rows="tick_check_rows")
define(
    "tick_counts",
    ("tick_due", "tick_changes", "tick_check_rows"),
    """
SELECT d.*, (SELECT count(*) FROM tick_changes c WHERE c.site_id = d.site_id AND bucket = 'added') AS added,
  (SELECT count(*) FROM tick_changes c WHERE c.site_id = d.site_id AND bucket = 'removed') AS removed,
  (SELECT count(*) FROM tick_changes c WHERE c.site_id = d.site_id AND bucket = 'modified') AS modified,
  (SELECT count(*) FROM tick_check_rows c WHERE c.site_id = d.site_id AND outcome = 'error') AS errors
FROM tick_due d""",
)


def tick_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Every due site after the tick: its counts, its next check and the run it queued."""
    t = ticked(spark, sf)
    runs = t["runs"].select("site_id", "run_id", "pages_changed", "change_summary")
    rows = t["cadence"].select("site_id", "check_interval_s", "change_streak", "next_check_at").join(runs, "site_id", "left")
    return rows.join(t["summary"].select("site_id", "added", "removed", "modified", "errors"), "site_id")


QUERIES["monitor_tick"] = tick_sites
ORACLE["monitor_tick"] = oracle(
    f"""
SELECT site_id, added, removed, modified, errors, i AS check_interval_s, {NOW} + i AS next_check_at, {streaked('change_streak', 'n > 0')} AS change_streak,
  CASE WHEN n > 0 THEN left(sha256(site_id || ':{NOW}'), 12) END AS run_id, CASE WHEN n > 0 THEN n END AS pages_changed,
  CASE WHEN n > 0 THEN concat_ws(', ', CASE WHEN added > 0 THEN added || CASE added WHEN 1 THEN ' page' ELSE ' pages' END || ' added' END,
    CASE WHEN removed > 0 THEN removed || CASE removed WHEN 1 THEN ' page' ELSE ' pages' END || ' removed' END,
    CASE WHEN modified > 0 THEN modified || CASE modified WHEN 1 THEN ' page' ELSE ' pages' END || ' modified' END) END AS change_summary
FROM (SELECT *, added + removed + modified AS n, {stepped('check_interval_s', 'added + removed + modified > 0', 'change_streak', L.SITE_FLOOR_S, L.SITE_CEILING_S)} AS i
  FROM tick_counts)""",
    "tick_counts",
)


def tick_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The page table after the tick."""
    columns = ("site_id", "url", "status", "last_checked_at", "last_changed_at", "page_check_interval_s", "page_change_streak")
    return ticked(spark, sf)["pages"].select(*columns)


QUERIES["monitor_tick_pages"] = tick_pages
ORACLE["monitor_tick_pages"] = oracle(
    f"""
SELECT s.site_id, s.url, CASE WHEN bucket = 'removed' THEN 'removed' ELSE status END AS status,
  CASE WHEN outcome IS NOT NULL THEN {NOW} ELSE last_checked_at END AS last_checked_at,
  CASE WHEN outcome <> 'error' AND changed THEN {NOW} ELSE last_changed_at END AS last_changed_at,
  CASE WHEN outcome <> 'error' THEN {stepped('page_check_interval_s', 'changed', 'page_change_streak', L.PAGE_FLOOR_S, L.PAGE_CEILING_S)} ELSE page_check_interval_s END AS page_check_interval_s,
  CASE WHEN outcome <> 'error' THEN {streaked('page_change_streak', 'changed')} ELSE page_change_streak END AS page_change_streak
FROM tick_stored s LEFT JOIN (SELECT site_id, url, outcome, changed FROM tick_check_rows) c ON c.site_id = s.site_id AND c.url = s.url
LEFT JOIN tick_changes d ON d.site_id = s.site_id AND d.url = s.url""",
    "tick_counts",
    "tick_stored",
)
