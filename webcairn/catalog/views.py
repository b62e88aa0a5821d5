"""Base views: the given tables seen as landed pages, checks, versions and logs.

A view built from SQL text shares that text with the oracle; everything else is
computed by the library here and by independent SQL there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webcairn.functions.urls import canonical_urls
from webcairn.operators.extract import extract_pages, ingest_pages
from webcairn.operators.ranking import first_by

# The page table as fetch results: three sites, each with about a third of all rows.
LANDED = """
SELECT page_id, site_id, origin,
  'https://' || CASE WHEN page_id % 7 = 2 THEN upper(site_id) ELSE site_id END
    || CASE WHEN page_id % 11 = 4 THEN ':443' ELSE '' END
    || CASE WHEN page_id % 40 = 7 THEN '/'
            ELSE prefix || CASE WHEN page_id % 13 = 5 THEN '/v(2)' ELSE '' END || path END AS url,
  CASE WHEN page_id % 17 = 3 THEN 404 WHEN page_id % 17 = 9 THEN 304
       WHEN page_id % 29 = 11 THEN 500 ELSE 200 END AS status,
  CASE WHEN page_id % 19 = 6 THEN 'application/pdf'
       WHEN page_id % 5 = 1 THEN 'Text/HTML; charset=utf-8'
       WHEN page_id % 5 = 2 THEN 'application/xhtml+xml' ELSE 'text/html' END AS content_type,
  CASE WHEN page_id % 23 = 8 THEN CAST(3000000 AS bigint)
       WHEN page_id % 23 = 9 THEN NULL ELSE CAST(length(html) AS bigint) END AS content_length,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'e' || CAST(page_id % 100 AS varchar(20)) END AS etag,
  '2024-01-' || CAST(10 + page_id % 20 AS varchar(20)) AS last_modified,
  CASE WHEN page_id % 6 = 5 THEN NULL
       ELSE '2024-02-' || CAST(10 + page_id % 18 AS varchar(20)) END AS lastmod,
  replace(replace(html, '<title>' || t || '</title>',
      CASE WHEN page_id % 10 = 4 THEN '<meta property="og:title" content="' || t || ' (og)">'
           WHEN page_id % 6 = 1 THEN '<title>' || t || ' [v1] | ' || site_id || '</title>'
           ELSE '<title>' || t || '</title>' END),
    '<head>',
    CASE WHEN page_id % 3 = 0 THEN '<head><meta name="Description" content="About ' || t || '">'
         WHEN page_id % 8 = 5 THEN '<head><META content="Feed of ' || t || '" property="OG:description">'
         ELSE '<head>' END) AS html
FROM (
  SELECT page_id, html, site_id, 'https://' || site_id AS origin, path,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS t,
    CASE page_id % 9 WHEN 0 THEN '/docs' WHEN 1 THEN '/blog' WHEN 2 THEN '/2024/05'
         WHEN 3 THEN '/pricing' WHEN 4 THEN '/about' WHEN 5 THEN '/support'
         WHEN 6 THEN '/legal' WHEN 7 THEN '/x' ELSE '' END AS prefix
  FROM (
    SELECT page_id, html, regexp_extract(url, '(example[.][a-z]+)', 1) AS site_id,
      regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS path
    FROM {pages}
  ) AS raw
) AS shaped
"""

# Events as a check log of user keys.
CHECKS = """
SELECT 'u' || CAST(user_id AS varchar(20)) AS site_id, event_id,
  CAST(epoch_s AS bigint) AS checked_at,
  event_type IN ('purchase', 'error') AS changed
FROM {timed}
"""

# Events as crawl progress: 20 runs per 1,000 users, completions repeat.
CRAWL_EVENTS = """
SELECT 'r' || CAST(user_id % 997 AS varchar(20)) AS run_id, event_id, epoch_s AS ts,
  '/p' || CAST(event_id % 50 AS varchar(20)) AS url,
  CASE event_type WHEN 'view' THEN 'seed' WHEN 'click' THEN 'link'
       WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'complete' ELSE 'finish' END AS event
FROM {timed}
"""

# Documents as numbered versions of one site per source and language.
DOC_LINES = """
SELECT doc_id, source || '-' || lang AS site_id, replace(text, '. ', '.{nl}') AS content
FROM {documents}
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def timed(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the event time as whole epoch seconds."""
    events = table(spark, sf, "events")
    # the stored time has no zone; it is read as UTC whatever the session's zone is
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz"))
    return events.withColumn("epoch_s", F.unix_timestamp(local.cast("timestamp")))


def landed(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(LANDED, pages=table(spark, sf, "pages"))


def web(spark: SparkSession, sf: str) -> DataFrame:
    """Every landed page with its canonical URL; bodies left out."""
    return canonical_urls(landed(spark, sf).drop("html"), "url", parts=True)


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted pages, one row per (site, URL): the least page id wins."""
    usable = ingest_pages(landed(spark, sf)).where(F.col("ingest") == "html")
    pages = canonical_urls(extract_pages(usable).drop("ingest", "links"), "url")
    return first_by(pages.drop("status", "content_type", "content_length"), ["site_id", "url"], ["page_id"])


def checks(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(CHECKS, timed=timed(spark, sf))


def crawl_events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(CRAWL_EVENTS, timed=timed(spark, sf))


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(DOC_LINES.replace("{nl}", "\n"), documents=table(spark, sf, "documents"))
