"""Queries over URLs, page bodies and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webcairn import limits as L
from webcairn.catalog import views
from webcairn.catalog.ctes import HIDDEN, attr, canon, define, lit, oracle, segments
from webcairn.functions import urls
from webcairn.operators import extract

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Each page URL written the ways a link can write it.
FORMS = """
SELECT page_id, form, base,
  CASE form WHEN 0 THEN url WHEN 1 THEN '../x/' || tail WHEN 2 THEN './' || tail || '/?b=2&utm_medium=m&a=1 2'
    WHEN 3 THEN '//WWW.' || site_id || ':8080' || '/p q/é' WHEN 4 THEN '?ref=1&k=%C3%A9&_ga=2'
    WHEN 5 THEN '#part' WHEN 6 THEN 'mailto:a@' || site_id WHEN 7 THEN '/a/../../b/./' || tail
    ELSE 'http://u@' || site_id || ':80' END AS href
FROM (
  SELECT page_id, site_id, url, 'https://' || site_id || '/s/' || CAST(page_id AS varchar(20)) || '?z=1' AS base,
    'n' || CAST(page_id % 10 AS varchar(20)) AS tail, explode(sequence(0, 8)) AS form
  FROM {landed}
) AS l
"""
DUCK_FORMS = FORMS.replace("explode(sequence(0, 8)) AS form", "unnest(range(0, 9)) AS form")
define("forms", ("landed",), DUCK_FORMS.format(landed="landed"))

# Hosts as sites would type them: the page's host and private addresses derived from its id.
HOSTS = """
SELECT page_id, CASE page_id % 12
  WHEN 0 THEN host WHEN 1 THEN '10.0.' || n || '.1' WHEN 2 THEN '172.' || CAST(page_id % 40 AS varchar(20)) || '.0.1'
  WHEN 3 THEN '100.' || CAST(page_id % 140 AS varchar(20)) || '.2.3' WHEN 4 THEN CAST(2130706433 + page_id AS varchar(20))
  WHEN 5 THEN '0x' || CAST(70000000 + page_id AS varchar(20)) WHEN 6 THEN '01770000000' || CAST(page_id % 8 AS varchar(20))
  WHEN 7 THEN '[::ffff:192.168.0.' || n || ']' WHEN 8 THEN '[::ffff:a' || n || ':1]' WHEN 9 THEN n || '.localhost'
  WHEN 10 THEN 'fe8' || CAST(page_id % 10 AS varchar(20)) || '::1' ELSE upper(host) END AS host
FROM (
  SELECT page_id, CAST(page_id % 250 AS varchar(20)) AS n, regexp_extract(url, '^https?://([^/]+)', 1) AS host
  FROM {pages}
) AS h
"""
define("hosts", (), HOSTS.format(pages="pages"))


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    return views.landed(spark, sf)


def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    forms = spark.sql(FORMS, landed=_landed(spark, sf).drop("html"))
    return urls.canonical_urls(forms, "href", "base", parts=True).select(
        "page_id", "form", "url", "url_origin", "url_path"
    )


QUERIES["url_canonical"] = url_canonical
ORACLE["url_canonical"] = oracle(
    f"SELECT page_id, form, url, url_origin, url_path FROM ({canon('forms', 'href', 'base')})", "forms"
)


def url_origin(spark: SparkSession, sf: str) -> DataFrame:
    typed = views.table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.lit("  "), F.replace("url", F.lit(".example"), F.lit(".EXAMPLE")), F.lit(" ")).alias("typed"),
    )
    return urls.site_origins(typed, "typed").select("page_id", "origin")


QUERIES["url_origin"] = url_origin
ORACLE["url_origin"] = oracle(
    "SELECT page_id, lower(regexp_extract(url, '^(https?://[^/]+)', 1)) AS origin FROM pages"
)


def url_depth(spark: SparkSession, sf: str) -> DataFrame:
    return views.web(spark, sf).select(
        "page_id", "url", urls.path_depth(F.col("url")).alias("depth"),
        urls.path_depth(F.col("url_path")).alias("path_only"),
    )


QUERIES["url_depth"] = url_depth
ORACLE["url_depth"] = oracle(
    f"SELECT page_id, url, {segments('url_path')} AS depth, 9007199254740991 AS path_only FROM web", "web"
)


def url_blocked(spark: SparkSession, sf: str) -> DataFrame:
    hosts = spark.sql(HOSTS, pages=views.table(spark, sf, "pages"))
    return hosts.select("page_id", "host", urls.is_blocked_host(F.col("host")).alias("blocked"))


QUERIES["url_blocked"] = url_blocked
ORACLE["url_blocked"] = oracle(
    """
SELECT page_id, host,
  CASE WHEN page_id % 12 IN (0, 11) THEN false
       WHEN page_id % 12 IN (1, 7, 9, 10) THEN true
       WHEN page_id % 12 = 2 THEN page_id % 40 BETWEEN 16 AND 31
       WHEN page_id % 12 = 3 THEN page_id % 140 BETWEEN 64 AND 127
       WHEN page_id % 12 = 4 THEN (2130706433 + page_id) >> 24 = 127
       WHEN page_id % 12 = 5 THEN (CAST(host AS BIGINT) >> 24) IN (0, 10, 127)
       WHEN page_id % 12 = 6 THEN true
       ELSE CAST('0x' || 'a' || CAST(page_id % 250 AS VARCHAR) AS BIGINT) >> 8 IN (0, 10, 127) END AS blocked
FROM hosts""",
    "hosts",
)


def tracking_params(spark: SparkSession, sf: str) -> DataFrame:
    pages = views.table(spark, sf, "pages")
    pairs = pages.select(
        "page_id",
        F.explode(
            urls.query_pairs(
                F.concat_ws("&", F.regexp_extract("url", r"\?([^#]*)", 1), F.concat(F.lit("sessionid="), "page_id"), F.lit("q=1"))
            )
        ).alias("pair"),
    )
    named = pairs.select("page_id", urls.param_name(F.col("pair")).alias("name"))
    return named.select("page_id", "name", urls.is_tracking(F.col("name")).alias("tracking"))


QUERIES["tracking_params"] = tracking_params
ORACLE["tracking_params"] = oracle(
    """
SELECT page_id, name, name IN ('utm_source', 'ref', 'sessionid') AS tracking FROM (
  SELECT page_id, unnest(['sessionid', 'q']) AS name FROM pages
  UNION ALL SELECT page_id, 'utm_source' FROM pages WHERE contains(url, 'utm_source=')
  UNION ALL SELECT page_id, unnest(['page', 'ref']) FROM pages WHERE contains(url, 'page=2&ref=x'))"""
)


def html_ingest(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.ingest_pages(_landed(spark, sf))
    return rows.groupBy("site_id", "ingest").agg(F.count(F.lit(1)).alias("pages"))


QUERIES["html_ingest"] = html_ingest
ORACLE["html_ingest"] = oracle(
    """
SELECT site_id, CASE WHEN status = 200 AND html IS NOT NULL AND (content_type ILIKE '%text/html%'
    OR content_type ILIKE '%application/xhtml%') THEN 'html' WHEN status = 304 THEN 'unchanged'
    ELSE 'error' END AS ingest, count(*) AS pages
FROM landed GROUP BY ALL""",
    "landed",
)


# Landed pages, some under an address that is none.
ADDRESSES = """
SELECT page_id, site_id, status, content_type, html,
  CASE page_id % 31 WHEN 5 THEN 'mailto:a@' || site_id WHEN 6 THEN 'https://' || site_id || ':99999999999/x'
    WHEN 7 THEN 'https://' WHEN 8 THEN NULL ELSE url END AS url
FROM {landed}
"""
define("addresses", ("landed",), ADDRESSES.format(landed="landed"))


def poison_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(ADDRESSES, landed=_landed(spark, sf))
    return extract.poison_rows(rows).select("page_id", "reason")


QUERIES["poison_rows"] = poison_rows
ORACLE["poison_rows"] = oracle(
    """
SELECT page_id, CASE WHEN page_id % 31 BETWEEN 5 AND 8 THEN 'bad_url' WHEN status = 304 THEN NULL WHEN status <> 200 THEN 'bad_status'
  WHEN html IS NULL THEN 'no_body' WHEN NOT (content_type ILIKE '%text/html%' OR content_type ILIKE '%application/xhtml%') THEN 'not_html' END AS reason
FROM addresses""",
    "addresses",
)


def body_cap(spark: SparkSession, sf: str) -> DataFrame:
    docs = views.table(spark, sf, "documents").select("doc_id", "text", (F.col("n_chars") * (F.col("doc_id") % 3)).alias("declared"))
    kept = extract.cap_body(docs, "text", "declared", 4000)
    return kept.select("doc_id", F.length("text").cast("bigint").alias("kept"), F.sha2("text", 256).alias("digest"))


QUERIES["body_cap"] = body_cap
ORACLE["body_cap"] = oracle(
    """
SELECT doc_id, length(body) AS kept, sha256(body) AS digest FROM (
  SELECT doc_id, CASE WHEN n_chars * (doc_id % 3) <= 4000 THEN left(text, 4000) END AS body FROM documents)"""
)


def page_meta(spark: SparkSession, sf: str) -> DataFrame:
    pages = extract.extract_pages(_landed(spark, sf))
    return pages.select("page_id", "title", "description", "h1", "snippet")


QUERIES["page_meta"] = page_meta
ORACLE["page_meta"] = oracle("SELECT page_id, title, description, h1, snippet FROM meta", "meta")


def page_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_pages(_landed(spark, sf)).select("page_id", "content_hash")


QUERIES["page_fingerprint"] = page_fingerprint
ORACLE["page_fingerprint"] = oracle("SELECT page_id, content_hash FROM meta", "meta")


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_links(_landed(spark, sf), ["page_id"])


QUERIES["page_links"] = page_links
define(
    "raw_links",
    ("landed",),
    f"""
SELECT page_id, site_id, origin, page_url, pos, href FROM (
  SELECT page_id, site_id, origin, url AS page_url, unnest(hrefs) AS href,
    CAST(unnest(range(1, len(hrefs) + 1)) AS BIGINT) AS pos
  FROM (SELECT page_id, site_id, origin, url, list_filter(list_transform(regexp_extract_all(
      regexp_replace(html, {lit(HIDDEN)}, '', 'g'), {lit(r"(?is)<a(?:\s[^>]*)?>")}),
      lambda t: {attr('t', 'href')}), lambda h: h <> '')[:{L.MAX_LINKS_PER_PAGE}] AS hrefs FROM landed)
)""",
)
ORACLE["page_links"] = oracle("SELECT page_id, pos, href FROM raw_links", "raw_links")


def meta_tags(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_meta_tags(_landed(spark, sf), ["page_id"])


QUERIES["meta_tags"] = meta_tags
ORACLE["meta_tags"] = oracle(
    """
SELECT page_id, 'property' AS kind, 'og:title' AS key, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' (og)' AS content
FROM pages WHERE page_id % 10 = 4
UNION ALL
SELECT page_id, 'name', 'description', 'About ' || regexp_extract(html, '<title>([^<]*)</title>', 1)
FROM pages WHERE page_id % 3 = 0
UNION ALL
SELECT page_id, 'property', 'og:description', 'Feed of ' || regexp_extract(html, '<title>([^<]*)</title>', 1)
FROM pages WHERE page_id % 3 <> 0 AND page_id % 8 = 5"""
)


def crawl_eligible(spark: SparkSession, sf: str) -> DataFrame:
    shaped = views.web(spark, sf).select(
        "page_id",
        F.concat(
            F.element_at(
                F.array(*[F.lit(p) for p in ("", "/Search", "/login", "/tag/a", "/x", "/wp-admin", "/LOGIN")]),
                (F.col("page_id") % 7 + 1).cast("int"),
            ),
            F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/page/"), (F.col("page_id") % 31).cast("string"))).otherwise(""),
            "url_path",
            F.when(F.col("page_id") % 6 == 1, ".PDF").when(F.col("page_id") % 6 == 2, ".woff").otherwise(""),
        ).alias("path"),
    )
    return shaped.select("page_id", "path", urls.is_crawlable_path(F.col("path")).alias("eligible"))


QUERIES["crawl_eligible"] = crawl_eligible
ORACLE["crawl_eligible"] = oracle(
    """
SELECT page_id, path, NOT (starts_with(lower(path), '/search') OR starts_with(lower(path), '/login')
    OR starts_with(lower(path), '/cart') OR starts_with(lower(path), '/wp-admin')
    OR regexp_matches(lower(path), '/page/[3-9]') OR regexp_matches(lower(path), '/(tag|category)/.+/page/')
    OR regexp_matches(lower(path), '[.](png|jpg|jpeg|gif|svg|webp|ico|css|js|mjs|json|xml|pdf|zip|gz|mp3|mp4|webm|woff|woff2|ttf|eot|txt)$')) AS eligible
FROM (SELECT page_id, ['', '/Search', '/login', '/tag/a', '/x', '/wp-admin', '/LOGIN'][page_id % 7 + 1]
    || CASE WHEN page_id % 5 = 0 THEN '/page/' || (page_id % 31) ELSE '' END || url_path
    || CASE page_id % 6 WHEN 1 THEN '.PDF' WHEN 2 THEN '.woff' ELSE '' END AS path FROM web)""",
    "web",
)
