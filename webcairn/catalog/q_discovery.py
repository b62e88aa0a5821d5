"""Queries over robots rules, sitemaps, the link frontier and render quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webcairn import limits as L
from webcairn.catalog import views
from webcairn.catalog.ctes import attr, canon, collapse, define, oracle, segments
from webcairn.catalog import q_pages  # noqa: F401  (defines views used here)
from webcairn.operators import extract, frontier, quality, robots, sitemap
from webcairn.session import materialize

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Robots documents: the events of a user, in order, read as lines.
ROBOT_LINES = """
SELECT 'u' || CAST(user_id AS varchar(20)) || '-' || CAST(CAST(floor(event_id / 20000) AS bigint) AS varchar(20)) AS site_id,
  event_id, CASE event_type
    WHEN 'signup' THEN CASE k % 3 WHEN 0 THEN 'User-agent: WebCairn' WHEN 1 THEN ' user-agent : *' ELSE 'User-Agent: otherbot # x' END
    WHEN 'click' THEN 'Disallow: ' || CASE k % 5 WHEN 0 THEN '/docs' WHEN 1 THEN '/blog/e' WHEN 2 THEN '/2024/05/en/'
        WHEN 3 THEN '/x/' ELSE '/p' || CAST(k AS varchar(20)) END || ' # why'
    WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'Disallow:' WHEN 1 THEN 'Allow: /' WHEN 2 THEN '' ELSE '# note: x' END
    WHEN 'purchase' THEN 'Crawl-delay: ' || CASE k % 6 WHEN 0 THEN 'soon' WHEN 1 THEN '-2'
        ELSE CAST(k % 13 AS varchar(20)) || '.5 s' END
    ELSE 'Sitemap: https://example.com/s' || CAST(k AS varchar(20)) || '.xml' END AS line
FROM (SELECT user_id, event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM {events}) AS e
"""
# Pages handed to those sites, for the prefix exclusion.
ROBOT_PAGES = """
SELECT page_id, 'u' || CAST(page_id % 1500 AS varchar(20)) || '-0' AS site_id, url_path AS path FROM {web}
"""

# Sitemap documents: up to 50 pages each, in five formats, plus their indexes.
ENTRIES = """
SELECT site_id, origin, page_id, CAST(floor(page_id / 50) AS bigint) AS b,
  CASE WHEN site_id = 'example.com' THEN replace(url, '//example.com', '//www.example.com') ELSE url END AS loc,
  lastmod
FROM {web}
"""
BLOCKS = """
SELECT site_id, origin, b, page_id, CASE b % 5
  WHEN 1 THEN '<item><link> ' || esc || ' </link><guid>g</guid>' || CASE WHEN lastmod IS NULL THEN '' ELSE '<pubDate>' || lastmod || '</pubDate>' END || '</item>'
  WHEN 2 THEN '<entry><link rel="self" href="https://x.org/self"/>' || CASE page_id % 3
      WHEN 0 THEN '<link rel="alternate" href="' || esc || '"/><link href="https://x.org/late"/>'
      WHEN 1 THEN '<link href="https://x.org/early"/><link href="' || esc || '"/>'
      ELSE '' END || '<updated>' || coalesce(lastmod, '') || '</updated></entry>'
  WHEN 3 THEN '  ' || loc
  WHEN 4 THEN '<url><loc><![CDATA[' || loc || ']]></loc><news:news>n</news:news></url>'
  ELSE '<url><ns:loc>' || esc || '</ns:loc>' || CASE WHEN lastmod IS NULL THEN '' ELSE '<lastmod> ' || lastmod || '</lastmod>' END || '</url>' END AS block
FROM (SELECT *, replace(loc, '&', '&amp;') AS esc FROM {entries}) AS e
"""
SITEMAPS = """
SELECT site_id, origin || '/sitemap-' || CAST(b AS varchar(20)) || '.xml' AS doc_url,
  CASE WHEN b % 7 = 5 THEN 404 ELSE 200 END AS status,
  CASE b % 5 WHEN 1 THEN '<rss><channel>' || body || '</channel></rss>' WHEN 2 THEN '<feed>' || body || '</feed>'
    WHEN 3 THEN 'urls' || '{nl}' || body
    WHEN 4 THEN '<urlset xmlns:news="n">' || body || '</urlset>' ELSE ' <?xml version="1.0"?><urlset>' || body || '</urlset>' END AS body
FROM {bodies}
UNION ALL
SELECT site_id, origin || '/index-' || CAST(CAST(floor(b / 100) AS bigint) AS varchar(20)) || '.xml', 200,
  '<sitemapindex>' || children || '<sitemap><loc>' || origin || '/none.xml</loc></sitemap></sitemapindex>'
FROM {indexes}
UNION ALL
SELECT DISTINCT site_id, origin || '/sitemap.xml', 200,
  '<sitemapindex><sitemap><loc>' || origin || '/sitemap-0.xml</loc></sitemap><sitemap><loc>' || origin || '/index-0.xml</loc></sitemap></sitemapindex>'
FROM {indexes}
"""
DECLARED = """
SELECT DISTINCT site_id, CASE WHEN site_id = 'example.org' THEN origin || '/gone.xml'
    ELSE origin || '/index-' || CAST(CAST(floor(b / 100) AS bigint) AS varchar(20)) || '.xml' END AS doc_url,
  CASE WHEN site_id = 'example.org' THEN CAST(0 AS bigint) ELSE CAST(floor(b / 100) AS bigint) END AS pos
FROM {bodies}
"""

define("robot_lines", (), ROBOT_LINES.format(events="events"))
define("robot_pages", ("web",), ROBOT_PAGES.format(web="web"))
define("entries", ("web",), ENTRIES.format(web="web"))
define("blocks", ("entries",), BLOCKS.format(entries="entries"))
define(
    "bodies",
    ("blocks",),
    "SELECT site_id, origin, b, string_agg(block, chr(10) ORDER BY page_id) AS body FROM blocks GROUP BY ALL",
)
define(
    "indexes",
    ("bodies",),
    """SELECT site_id, origin, floor(b / 100) * 100 AS b, string_agg('<sitemap><loc>' || origin || '/sitemap-' || b || '.xml</loc></sitemap>', ''
  ORDER BY b) AS children FROM bodies GROUP BY site_id, origin, floor(b / 100)""",
)
define(
    "sitemap_docs",
    ("bodies", "indexes"),
    SITEMAPS.replace("{nl}", "\n").format(bodies="bodies", indexes="indexes"),
)
define("declared", ("bodies",), DECLARED.format(bodies="bodies"))


def robots_docs(spark: SparkSession, sf: str) -> DataFrame:
    lines = spark.sql(ROBOT_LINES, events=views.table(spark, sf, "events"))
    return lines.groupBy("site_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n"
        ).alias("body")
    )


def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = robots.parse_robots(robots_docs(spark, sf))
    return rules.select(
        "site_id",
        F.array_join("disallow", " ").alias("disallow"),
        "crawl_delay_ms",
        F.array_join("sitemaps", " ").alias("sitemaps"),
    )


QUERIES["robots_rules"] = robots_rules
define(
    "robot_groups",
    ("robot_lines",),
    r"""
SELECT *, sum(CASE WHEN name = 'user-agent' AND coalesce(prev, '') <> 'user-agent' THEN 1 ELSE 0 END)
    OVER (PARTITION BY site_id ORDER BY event_id) AS grp
FROM (
  SELECT *, lag(name) OVER (PARTITION BY site_id ORDER BY event_id) AS prev FROM (
    SELECT site_id, event_id, lower(trim(split_part(bare, ':', 1))) AS name,
      trim(substr(bare, instr(bare, ':') + 1)) AS value
    FROM (SELECT *, trim(regexp_replace(line, '#.*$', '')) AS bare FROM robot_lines)
    WHERE contains(bare, ':') AND NOT starts_with(bare, 'Sitemap'))
)""",
)
define(
    "robot_rules",
    ("robot_groups", "robot_lines"),
    r"""
SELECT s.site_id, coalesce(disallow, '') AS disallow,
  coalesce(least(greatest(delay * 1000, 500.0), 10000.0), 500.0) AS crawl_delay_ms, coalesce(sitemaps, '') AS sitemaps
FROM (SELECT DISTINCT site_id FROM robot_lines) s
LEFT JOIN (SELECT site_id, string_agg(trim(substr(line, 10)), ' ' ORDER BY event_id) AS sitemaps
  FROM robot_lines WHERE starts_with(line, 'Sitemap:') GROUP BY ALL) m USING (site_id)
LEFT JOIN (
  SELECT r.site_id, string_agg(rtrim(repeat(value || ' ', a.times)), ' ' ORDER BY event_id) FILTER (name = 'disallow' AND value <> '') AS disallow,
    arg_max(try_cast(regexp_extract(value, '^[0-9.]+') AS DOUBLE), event_id) FILTER (name = 'crawl-delay' AND regexp_matches(value, '^[0-9]')) AS delay
  FROM robot_groups r JOIN (
    SELECT site_id, grp, count(*) AS times FROM robot_groups g
    JOIN (SELECT site_id, CASE WHEN bool_or(lower(value) = 'webcairn') THEN 'webcairn' ELSE '*' END AS agent
          FROM robot_groups WHERE name = 'user-agent' GROUP BY ALL) c USING (site_id)
    WHERE name = 'user-agent' AND lower(value) = agent GROUP BY ALL) a USING (site_id, grp)
  GROUP BY ALL) d USING (site_id)""",
)
ORACLE["robots_rules"] = oracle("SELECT * FROM robot_rules", "robot_rules")


def robots_excluded(spark: SparkSession, sf: str) -> DataFrame:
    rules = robots.parse_robots(robots_docs(spark, sf))
    pages = spark.sql(ROBOT_PAGES, web=views.web(spark, sf))
    return robots.exclude_disallowed(pages, rules)


QUERIES["robots_excluded"] = robots_excluded
ORACLE["robots_excluded"] = oracle(
    """
SELECT * FROM robot_pages p WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT site_id, unnest(string_split(disallow, ' ')) AS prefix FROM robot_rules) r
  WHERE r.site_id = p.site_id AND prefix <> '' AND starts_with(p.path, prefix))""",
    "robot_pages",
    "robot_rules",
)


def sitemap_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Landed sitemap documents, declared sitemaps and site origins."""
    web = views.web(spark, sf)
    blocks = spark.sql(BLOCKS, entries=spark.sql(ENTRIES, web=web))
    bodies = materialize(
        blocks.groupBy("site_id", "origin", "b").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("page_id", "block"))), lambda x: x["block"]), "\n"
            ).alias("body")
        )
    )
    loc = F.concat(F.lit("<sitemap><loc>"), "origin", F.lit("/sitemap-"), F.col("b").cast("string"), F.lit(".xml</loc></sitemap>"))
    indexes = bodies.groupBy("site_id", "origin", (F.floor(F.col("b") / 100) * 100).alias("b0")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("b", loc.alias("loc")))), lambda x: x["loc"]), ""
        ).alias("children")
    ).withColumnRenamed("b0", "b")
    docs = spark.sql(SITEMAPS.replace("{nl}", "\n"), bodies=bodies, indexes=indexes)
    declared = spark.sql(DECLARED, bodies=bodies)
    return docs, declared, bodies.select("site_id", "origin").distinct()


def sitemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    docs, _, _ = sitemap_sources(spark, sf)
    parsed = sitemap.parse_sitemaps(docs)
    return sitemap.sitemap_entries(parsed, ["site_id", "doc_url", "kind", "is_news", "is_feed"])


QUERIES["sitemap_entries"] = sitemap_entries
define(
    "parsed_entries",
    ("entries",),
    """
SELECT site_id, origin || '/sitemap-' || b || '.xml' AS doc_url, CASE WHEN b % 5 = 3 THEN 'text' ELSE 'urlset' END AS kind,
  b % 5 = 4 AS is_news, b % 5 IN (1, 2) AS is_feed, b, CASE WHEN b % 7 = 5 THEN 404 ELSE 200 END AS status,
  CAST(row_number() OVER (PARTITION BY site_id, b ORDER BY page_id) AS BIGINT) AS pos,
  CASE WHEN b % 5 = 2 AND page_id % 3 = 2 THEN 'https://x.org/self' ELSE loc END AS url,
  CASE WHEN b % 5 IN (3, 4) THEN NULL ELSE lastmod END AS lastmod
FROM entries""",
)
ORACLE["sitemap_entries"] = oracle(
    "SELECT * EXCLUDE (b, status) FROM parsed_entries", "parsed_entries"
)


def sitemap_index(spark: SparkSession, sf: str) -> DataFrame:
    docs, _, _ = sitemap_sources(spark, sf)
    return sitemap.sitemap_children(sitemap.parse_sitemaps(docs), ["site_id", "doc_url"])


QUERIES["sitemap_index"] = sitemap_index
define(
    "children",
    ("bodies",),
    """
SELECT site_id, doc_url, CAST(row_number() OVER (PARTITION BY site_id, doc_url ORDER BY o) AS BIGINT) AS pos, child_url FROM (
  SELECT site_id, origin || '/index-' || CAST(floor(b / 100) AS BIGINT) || '.xml' AS doc_url, b AS o, origin || '/sitemap-' || b || '.xml' AS child_url FROM bodies
  UNION ALL
  SELECT DISTINCT site_id, origin || '/index-' || CAST(floor(b / 100) AS BIGINT) || '.xml', 9007199254740991, origin || '/none.xml' FROM bodies
  UNION ALL
  SELECT DISTINCT site_id, origin || '/sitemap.xml', unnest([1, 2]), origin || unnest(['/sitemap-0.xml', '/index-0.xml']) FROM bodies)""",
)
ORACLE["sitemap_index"] = oracle("SELECT * FROM children", "children")


def expanded(spark: SparkSession, sf: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    docs, declared, origins = sitemap_sources(spark, sf)
    return sitemap.expand_sitemaps(declared, docs, origins, **limits), origins


def sitemap_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Every document met, and whether the budget lets it be read."""
    visited, _ = expanded(spark, sf, budget=L.MAX_SITEMAP_DOCS)
    return visited.select("site_id", "fetch_no", "doc_url", "read", "kind")


QUERIES["sitemap_budget"] = sitemap_budget


def fetch_round(name: str, frontier_sql: str, known: str | None, needs: tuple[str, ...]) -> None:
    """One round of breadth-first reading."""
    anti = f"WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.site_id = f.site_id AND k.doc_url = f.doc_url)" if known else ""
    used = f"(SELECT count(*) FROM {known} k WHERE k.site_id = f.site_id)" if known else "0"
    define(
        name,
        needs,
        f"""
SELECT f.site_id, f.doc_url, {used} + row_number() OVER (PARTITION BY f.site_id ORDER BY o1, o2) AS fetch_no
FROM (SELECT * FROM ({frontier_sql}) QUALIFY row_number() OVER (PARTITION BY site_id, doc_url ORDER BY o1, o2) = 1) f {anti}""",
    )


def reading(tag: str, budget: str) -> None:
    """The rounds of a discovery: declared, children, conventional paths, their children twice; ``budget`` bounds fetch_no."""

    def child_frontier(level: str) -> str:
        return (
            f"SELECT l.site_id, c.child_url AS doc_url, l.fetch_no AS o1, c.pos AS o2 FROM {level} l "
            f"JOIN children c ON c.site_id = l.site_id AND c.doc_url = l.doc_url WHERE l.fetch_no <= {budget}"
        )

    read0, read1, known1, back0, known2, back1, known3, back2 = (
        tag + x for x in ("read0", "read1", "known1", "back0", "known2", "back1", "known3", "back2")
    )
    fetch_round(read0, "SELECT site_id, doc_url, 0 AS o1, pos AS o2 FROM declared", None, ("declared",))
    fetch_round(read1, child_frontier(read0), read0, (read0, "children"))
    define(known1, (read0, read1), f"SELECT * FROM {read0} UNION ALL SELECT * FROM {read1}")
    fetch_round(
        back0,
        f"""SELECT DISTINCT site_id, origin || unnest(['/sitemap.xml', '/sitemap_index.xml']) AS doc_url, 0 AS o1, unnest([0, 1]) AS o2
FROM bodies WHERE site_id NOT IN (SELECT k.site_id FROM {known1} k JOIN parsed_entries p USING (site_id, doc_url)
  WHERE p.status = 200 AND k.fetch_no <= {budget})""",
        known1,
        (known1, "parsed_entries", "bodies"),
    )
    define(known2, (known1, back0), f"SELECT * FROM {known1} UNION ALL SELECT * FROM {back0}")
    fetch_round(back1, child_frontier(back0), known2, (known2, "children"))
    define(known3, (known2, back1), f"SELECT * FROM {known2} UNION ALL SELECT * FROM {back1}")
    fetch_round(back2, child_frontier(back1), known3, (known3, "children"))
    define(
        tag + "reads",
        (known3, back2, "sitemap_docs"),
        f"""
SELECT r.*, fetch_no <= {budget} AS read, CASE WHEN fetch_no <= {budget} AND d.status = 200 THEN CASE WHEN contains(d.body, '<sitemapindex') THEN 'index'
  WHEN starts_with(trim(d.body), '<') THEN 'urlset' ELSE 'text' END END AS kind
FROM (SELECT * FROM {known3} UNION ALL SELECT * FROM {back2}) r LEFT JOIN sitemap_docs d USING (site_id, doc_url)""",
    )


reading("", "9007199254740991")
reading("few_", str(L.MAX_SITEMAP_DOCS))
ORACLE["sitemap_budget"] = oracle("SELECT site_id, fetch_no, doc_url, read, kind FROM few_reads", "few_reads")


def sitemap_found(spark: SparkSession, sf: str) -> DataFrame:
    found = sitemap.discovery_summary(expanded(spark, sf)[0])
    return found.withColumn("found", F.array_join("found", " "))


QUERIES["sitemap_found"] = sitemap_found
ORACLE["sitemap_found"] = oracle(
    """
SELECT site_id, coalesce(string_agg(doc_url, ' ' ORDER BY fetch_no) FILTER (kind IS NOT NULL), '') AS found,
  bool_or(coalesce(news, false)) AS is_news, bool_or(coalesce(feed, false)) AS is_feed
FROM reads LEFT JOIN (SELECT site_id, doc_url, bool_or(is_news) AS news, bool_or(is_feed) AS feed FROM parsed_entries WHERE status = 200 GROUP BY ALL) USING (site_id, doc_url)
GROUP BY site_id""",
    "reads",
    "parsed_entries",
)
define(
    "read_entries",
    ("reads", "parsed_entries"),
    """
SELECT site_id, fetch_no, pos, url, lastmod FROM reads JOIN parsed_entries USING (site_id, doc_url) WHERE status = 200
QUALIFY row_number() OVER (PARTITION BY site_id, url ORDER BY fetch_no, pos) = 1""",
)


def sitemap_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return sitemap.collected_entries(expanded(spark, sf)[0])


QUERIES["sitemap_fallback"] = sitemap_fallback


ORACLE["sitemap_fallback"] = oracle("SELECT site_id, fetch_no, pos, url, lastmod FROM read_entries", "read_entries")

# Entries a site wants in the queries below: several documents of 50 pages.
ENOUGH = 120
define(
    "stops",
    ("reads", "read_entries"),
    f"""
SELECT site_id, fetch_no, doc_url, kind, coalesce(sum(n) OVER (PARTITION BY site_id ORDER BY fetch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {ENOUGH} AS read
FROM reads LEFT JOIN (SELECT site_id, fetch_no, count(*) AS n FROM read_entries GROUP BY ALL) USING (site_id, fetch_no)""",
)


def sitemap_raw_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the documents read until a site has enough."""
    return sitemap.collected_entries(expanded(spark, sf, raw_limit=ENOUGH)[0])


QUERIES["sitemap_raw_stop"] = sitemap_raw_stop
ORACLE["sitemap_raw_stop"] = oracle(
    "SELECT site_id, fetch_no, pos, url, lastmod FROM read_entries JOIN stops USING (site_id, fetch_no) WHERE read",
    "read_entries",
    "stops",
)


def sitemap_stop_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document met, and whether it is read before its site has enough entries."""
    visited, _ = expanded(spark, sf, raw_limit=ENOUGH)
    return visited.select("site_id", "fetch_no", "doc_url", "read", "kind")


QUERIES["sitemap_stop_docs"] = sitemap_stop_docs
ORACLE["sitemap_stop_docs"] = oracle(
    "SELECT site_id, fetch_no, doc_url, read, CASE WHEN read THEN kind END AS kind FROM stops", "stops"
)


def all_entries(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(ENTRIES, web=views.web(spark, sf)).select("site_id", "origin", F.col("loc").alias("url"), "page_id", "lastmod")


def sitemap_prioritized(spark: SparkSession, sf: str) -> DataFrame:
    entries = all_entries(spark, sf).groupBy("site_id", "url").agg(F.min("page_id").alias("page_id"))
    return sitemap.prioritize(entries)


QUERIES["sitemap_prioritized"] = sitemap_prioritized
ORACLE["sitemap_prioritized"] = oracle(
    f"""
SELECT site_id, url, page_id, row_number() OVER (PARTITION BY site_id ORDER BY {segments("regexp_extract(url, '^https://[^/?]+([^?]*)', 1)")}, length(url), url) AS rank
  FROM (SELECT site_id, loc AS url, min(page_id) AS page_id FROM entries GROUP BY ALL)""",
    "entries",
)


def sitemap_alias(spark: SparkSession, sf: str) -> DataFrame:
    entries = all_entries(spark, sf)
    return sitemap.alias_entries(entries, entries.select("site_id", "origin").distinct())


QUERIES["sitemap_alias"] = sitemap_alias
ORACLE["sitemap_alias"] = oracle(
    "SELECT site_id, page_id, lastmod, replace(loc, '//www.example.com', '//example.com') AS url FROM entries", "entries"
)


def sitemap_method(spark: SparkSession, sf: str) -> DataFrame:
    # a site per host and folder: some have many entries, some few
    hosts = views.table(spark, sf, "pages").select(F.regexp_extract("url", "//([^?#]*)/", 1).alias("site_id"), "page_id")
    return sitemap.discovery_method(hosts, hosts.select("site_id").distinct())


QUERIES["discovery_method"] = sitemap_method
ORACLE["discovery_method"] = oracle(
    """
SELECT site_id, n AS entries, CASE WHEN n >= 3 THEN 'sitemap' ELSE 'links' END AS method FROM (
  SELECT regexp_extract(url, '//([^?#]*)/', 1) AS site_id, count(*) AS n FROM pages GROUP BY 1)"""
)


# --- frontier -------------------------------------------------------------

# Links of a page: those in its body and those to the pages numbered 2i+1 .. 2i+12.
GRAPH = """
SELECT l.page_id, l.site_id, l.url, 1000 + c.pos AS pos, t.url AS href
FROM {children} AS c JOIN {web} AS l ON l.page_id = c.page_id JOIN {web} AS t ON t.page_id = c.target
"""


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Canonical pages and raw link edges (site_id, url, pos, href)."""
    web = materialize(views.web(spark, sf).select("page_id", "site_id", "origin", "url", "url_path"))
    body = extract.extract_links(views.landed(spark, sf), ["page_id"])
    body = body.join(web, "page_id").select("page_id", "site_id", "url", "pos", "href")
    children = web.select(
        "page_id", F.posexplode(F.sequence(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 12)).alias("pos", "target")
    )
    more = spark.sql(GRAPH, children=children, web=web)
    return web, body.unionByName(more.withColumn("pos", F.col("pos").cast("bigint")))


define(
    "edges",
    ("raw_links", "web"),
    """
SELECT page_id, site_id, w.url, pos, href FROM (SELECT page_id, pos, href FROM raw_links) JOIN web w USING (page_id)
UNION ALL
SELECT l.page_id, l.site_id, l.url, 1000 + d - 1, t.url FROM web l CROSS JOIN (SELECT unnest(range(1, 13)) AS d)
JOIN web t ON t.page_id = 2 * l.page_id + d""",
)
define(
    "resolved",
    ("edges",),
    canon("(SELECT page_id, site_id, url AS base, pos, href FROM edges)", "href", "base", drop="href"),
)
ELIGIBLE = r"""url_origin = 'https://' || site_id AND NOT regexp_matches(lower(url_path), '^/(search|login|cart|wp-admin)|/page/[3-9]|/(tag|category)/.+/page/|[.](png|jpe?g|gif|svg|webp|ico|css|js|mjs|json|xml|pdf|zip|gz|mp[34]|webm|woff2?|ttf|eot|txt)$')"""


def frontier_admit(spark: SparkSession, sf: str) -> DataFrame:
    web, edges = graph(spark, sf)
    sites = web.select("site_id", "origin").distinct()
    found = web.where("page_id % 5 = 0").select("site_id", "url").distinct()
    links = edges.select("site_id", "href", F.col("url").alias("base"), F.col("page_id").alias("o1"), F.col("pos").alias("o2"))
    counts = found.groupBy("site_id").agg(F.count(F.lit(1)).alias("found"))
    return frontier.admit(frontier.eligible_links(links, sites), found, counts, ["o1", "o2"])


QUERIES["frontier_admit"] = frontier_admit
define("found", ("web",), "SELECT DISTINCT site_id, url FROM web WHERE page_id % 5 = 0")
define(
    "admitted",
    ("resolved", "found"),
    f"""
SELECT site_id, url, o1, o2, coalesce((SELECT count(*) FROM found f WHERE f.site_id = c.site_id), 0)
      + row_number() OVER (PARTITION BY site_id ORDER BY o1, o2) AS rank
  FROM (SELECT site_id, url, page_id AS o1, pos AS o2 FROM resolved WHERE {ELIGIBLE}
        QUALIFY row_number() OVER (PARTITION BY site_id, url ORDER BY page_id, pos) = 1) c
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.site_id = c.site_id AND f.url = c.url)""",
)
ORACLE["frontier_admit"] = oracle("SELECT * FROM admitted", "admitted")


def fetch_list(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.fetch_list(frontier_admit(spark, sf)).select("site_id", "url", "rank", "delay_s", "batch")


QUERIES["fetch_list"] = fetch_list
ORACLE["fetch_list"] = oracle(
    "SELECT site_id, url, rank, (rank - 1) // 4 AS delay_s, (rank - 1) // 100 AS batch FROM admitted", "admitted"
)


def frontier_capped(spark: SparkSession, sf: str) -> DataFrame:
    web, edges = graph(spark, sf)
    sites = web.select("site_id", "origin").distinct()
    links = edges.select("site_id", "href", F.col("url").alias("base"), F.col("page_id").alias("o1"), F.col("pos").alias("o2"))
    accepted = frontier.admit(frontier.eligible_links(links, sites), None, None, ["o1", "o2"], 150)
    none = sites.select("site_id", F.lit(0).cast("bigint").alias("found"))
    return frontier.capped_flags(links, accepted, none, 150)


QUERIES["frontier_capped"] = frontier_capped
ORACLE["frontier_capped"] = oracle(
    f"""
SELECT site_id, candidates, accepted, accepted = 150 AND candidates > accepted AS capped FROM (
  SELECT site_id, count(*) AS candidates, least(150, count(DISTINCT CASE WHEN {ELIGIBLE} THEN url END)) AS accepted
  FROM resolved GROUP BY ALL)""",
    "resolved",
)


def link_walk(spark: SparkSession, sf: str) -> DataFrame:
    web, edges = graph(spark, sf)
    sites = web.select("site_id", "origin").distinct()
    seeds = web.where("url_path = '/'").select("site_id", F.col("page_id").alias("pos"), F.col("url").alias("href"))
    return frontier.walk_links(seeds, first_edges(edges), sites)


def first_edges(edges: DataFrame) -> DataFrame:
    """Edges of a URL that several pages share, in page and link order."""
    return edges.select("site_id", "url", (F.col("page_id") * 10_000 + F.col("pos")).alias("pos"), "href")


QUERIES["link_walk"] = link_walk


def walk_round(depth: int) -> None:
    prev, known = f"walk{depth - 1}", f"walked{depth - 1}"
    define(
        f"walk{depth}",
        (prev, known, "resolved"),
        f"""
SELECT site_id, url, CAST({depth} AS BIGINT) AS depth, (SELECT count(*) FROM {known} k WHERE k.site_id = c.site_id) + row_number() OVER (PARTITION BY site_id ORDER BY o1, o2) AS rank
  FROM (SELECT r.site_id, r.url, p.rank AS o1, r.page_id * 10000 + r.pos AS o2
        FROM {prev} p JOIN resolved r ON r.site_id = p.site_id AND r.base = p.url WHERE {ELIGIBLE.replace('site_id', 'r.site_id')}
        QUALIFY row_number() OVER (PARTITION BY r.site_id, r.url ORDER BY o1, o2) = 1) c
  WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.site_id = c.site_id AND k.url = c.url)""",
    )
    define(f"walked{depth}", (known, f"walk{depth}"), f"SELECT * FROM {known} UNION ALL SELECT * FROM walk{depth}")


define(
    "walk0",
    ("web",),
    f"""
SELECT site_id, url, CAST(0 AS BIGINT) AS depth, row_number() OVER (PARTITION BY site_id ORDER BY page_id) AS rank FROM (
  SELECT * FROM web WHERE url_path = '/' AND {ELIGIBLE} QUALIFY row_number() OVER (PARTITION BY site_id, url ORDER BY page_id) = 1)""",
)
define("walked0", ("walk0",), "SELECT * FROM walk0")
for _depth in (1, 2, 3):
    walk_round(_depth)
ORACLE["link_walk"] = oracle("SELECT * FROM walked3", "walked3")


def link_replay(spark: SparkSession, sf: str) -> DataFrame:
    fetched = views.landed(spark, sf).select("page_id", "status", "html")
    links = extract.markup.hrefs(extract.markup.visible(F.col("html")))
    stored = (
        F.when(F.col("page_id") % 4 == 0, F.to_json(links))
        .when(F.col("page_id") % 4 == 1, '{"a": "/x"}')
        .when(F.col("page_id") % 4 == 2, '["/a", 7]')
        .otherwise('["/kept"]')
    )
    pages = fetched.select("page_id", "status", links.alias("links"), stored.alias("out_links_json"))
    replayed = frontier.replay_links(pages)
    return replayed.select("page_id", F.posexplode("links").alias("pos", "href")).withColumn(
        "pos", (F.col("pos") + 1).cast("bigint")
    )


QUERIES["link_replay"] = link_replay
ORACLE["link_replay"] = oracle(
    """
SELECT page_id, pos, href FROM raw_links JOIN (SELECT page_id, status FROM landed) USING (page_id) WHERE status <> 304 OR page_id % 4 = 0
UNION ALL SELECT page_id, 1, '/kept' FROM landed WHERE status = 304 AND page_id % 4 = 3""",
    "raw_links",
)


# --- quality --------------------------------------------------------------

# A third of the pages answer with a bare application shell; rendering fills some of them.
SHELLS = """
SELECT page_id, site_id, 'https://' || site_id || '/s/' || CAST(page_id AS varchar(20)) AS url,
  'run' || CAST(page_id % 3 AS varchar(20)) AS run_id,
  CASE WHEN page_id % 3 = 1 THEN '<html><title> App </title><h1>Loading</h1><a href="/x#y">x</a><a href="../x?utm_a=1">x</a><a href="/y.png">y</a></html>'
       ELSE html END AS html,
  CASE WHEN page_id % 3 = 1 AND page_id % 4 <> 2 THEN html WHEN page_id % 7 = 2 THEN replace(html, '</article>', '<a href="/more/' || CAST(page_id AS varchar(20)) || '">m</a></article>') END AS rendered_html
FROM {landed}
"""


def shells(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(SHELLS, landed=views.landed(spark, sf))


def assessed(rows: DataFrame, html: str) -> DataFrame:
    return quality.assess_quality(extract.extract_pages(rows.where(F.col(html).isNotNull()).select("page_id", "url", html), html))


def thin_pages(spark: SparkSession, sf: str) -> DataFrame:
    return assessed(shells(spark, sf), "html").select(
        "page_id", "useful_snippet", "link_count", F.array_join("reasons", ",").alias("reasons"), "needs_render"
    )


QUERIES["thin_pages"] = thin_pages
define("shells", ("landed",), SHELLS.format(landed="landed"))


def assessed_sql(html: str) -> str:
    """Assessment of one body column of the shells, from its text alone."""
    shown = r"regexp_replace(" + html + r", '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', '', 'g')"
    para = r"list_filter(list_transform(regexp_extract_all(shown, '(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>', 1), lambda b: " + collapse(
        "regexp_replace(regexp_replace(b, '(?is)^.*<p(?:[ ][^>]*)?>', ''), '(?s)<[^>]*>', '', 'g')"
    ) + ")," + f" lambda t: length(t) >= {L.MIN_SNIPPET_CHARS})[1]"
    inner = f"""
SELECT page_id, site_id, url AS base, left({para}, 400) AS snippet, shown,
  nullif(coalesce(nullif(regexp_extract(shown, '<meta name="Description" content="([^"]+)"', 1), ''),
    regexp_extract(shown, '<META content="([^"]+)" property="OG:description"', 1)), '') AS description,
  lower({collapse("regexp_extract(shown, '<title>([^<]*)', 1)")}) IN ('app', 'home', 'loading', 'untitled')
    AND lower({collapse("regexp_extract(shown, '<h1>([^<]*)', 1)")}) IN ('app', 'home', 'loading', 'untitled') AS generic
FROM (SELECT *, {shown} AS shown FROM shells WHERE {html} IS NOT NULL)"""
    link_rows = (
        f"SELECT page_id, site_id, url AS base, unnest(list_transform(regexp_extract_all({html}, '<a href=\"[^\"]*\">'), lambda t: {attr('t', 'href')})) AS href "
        f"FROM shells WHERE {html} IS NOT NULL"
    )
    return f"""
SELECT *, coalesce(length(snippet), 0) >= 80 AS useful_snippet, coalesce(n, 0) AS link_count FROM ({inner}) LEFT JOIN (
  SELECT page_id, count(DISTINCT url) AS n FROM ({canon(f'({link_rows})', 'href', 'base')}) WHERE {ELIGIBLE} GROUP BY ALL) USING (page_id)"""


define("static_quality", ("shells",), assessed_sql("html"))
define("rendered_quality", ("shells",), assessed_sql("rendered_html"))
ORACLE["thin_pages"] = oracle(
    """
SELECT page_id, useful_snippet, link_count, concat_ws(',', CASE WHEN thin THEN 'thin_content' END,
  CASE WHEN generic THEN 'generic_heading' END, CASE WHEN link_count < 3 THEN 'few_static_links' END) AS reasons, thin OR link_count < 3 AS needs_render
FROM (SELECT *, description IS NULL AND NOT useful_snippet AS thin FROM static_quality)""",
    "static_quality",
)


def crawlable_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = shells(spark, sf)
    links = rows.select("page_id", "url", extract.markup.hrefs(F.col("html")).alias("links"))
    return links.select("page_id", F.explode(quality.crawlable_links(F.col("links"), F.col("url"))).alias("link"))


QUERIES["crawlable_links"] = crawlable_links
ORACLE["crawlable_links"] = oracle(
    f"""
SELECT DISTINCT page_id, url AS link FROM ({canon(
      "(SELECT page_id, site_id, url AS base, unnest(list_transform(regexp_extract_all(html, '<a href=" + chr(34) + "[^" + chr(34) + "]*" + chr(34) + ">'), lambda t: "
      + attr('t', 'href') + ")) AS href FROM shells)", "href", "base")}) WHERE {ELIGIBLE}""",
    "shells",
)


def render_budget(spark: SparkSession, sf: str) -> DataFrame:
    return quality.render_budget(shells(spark, sf), ["page_id", "url"]).select(
        "run_id", "page_id", "rank"
    )


QUERIES["render_budget"] = render_budget
ORACLE["render_budget"] = oracle(
    """
SELECT run_id, page_id, row_number() OVER (PARTITION BY run_id ORDER BY page_id) AS rank FROM shells
  WHERE rendered_html IS NOT NULL""",
    "shells",
)


def render_choice(spark: SparkSession, sf: str) -> DataFrame:
    rows = shells(spark, sf)
    both = quality.choose_render(assessed(rows, "html"), assessed(rows, "rendered_html"), ["page_id"])
    return both.select("page_id", "link_count", "r_link_count", "chosen")


QUERIES["render_choice"] = render_choice
ORACLE["render_choice"] = oracle(
    """
SELECT s.page_id, s.link_count, r.link_count AS r_link_count,
  CASE WHEN r.page_id IS NOT NULL AND (NOT s.useful_snippet AND (coalesce(length(r.snippet), 0) > coalesce(length(s.snippet), 0)
      OR (r.description IS NOT NULL AND s.description IS NULL)) OR r.link_count > s.link_count) THEN 'rendered' ELSE 'static' END AS chosen
FROM static_quality s LEFT JOIN rendered_quality r USING (page_id)""",
    "static_quality",
    "rendered_quality",
)


def by_kind(spark: SparkSession, sf: str, wanted) -> DataFrame:
    parsed = sitemap.parse_sitemaps(sitemap_sources(spark, sf)[0])
    return sitemap.sitemap_entries(parsed.where(wanted), ["site_id", "doc_url"])


def sitemap_feed(spark: SparkSession, sf: str) -> DataFrame:
    return by_kind(spark, sf, F.col("is_feed"))


QUERIES["sitemap_feed"] = sitemap_feed
ORACLE["sitemap_feed"] = oracle("SELECT site_id, doc_url, pos, url, lastmod FROM parsed_entries WHERE is_feed", "parsed_entries")


def sitemap_text(spark: SparkSession, sf: str) -> DataFrame:
    return by_kind(spark, sf, F.col("kind") == "text")


QUERIES["sitemap_text"] = sitemap_text
ORACLE["sitemap_text"] = oracle("SELECT site_id, doc_url, pos, url, lastmod FROM parsed_entries WHERE kind = 'text'", "parsed_entries")


def full_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose validators are withheld: links are wanted and none are stored."""
    stored = views.landed(spark, sf).select(
        "page_id",
        (F.col("page_id") % 3 > 0).alias("follow"),
        (F.col("page_id") % 5).alias("depth"),
        F.when(F.col("page_id") % 4 == 0, '["/a"]').when(F.col("page_id") % 4 == 1, "{}").alias("out_links_json"),
    )
    needs = frontier.needs_full_fetch(F.col("follow"), F.col("depth"), F.col("out_links_json"))
    return stored.select("page_id", needs.alias("full_fetch"))


QUERIES["full_fetch"] = full_fetch
ORACLE["full_fetch"] = oracle(
    "SELECT page_id, page_id % 3 > 0 AND page_id % 5 < 3 AND page_id % 4 <> 0 AS full_fetch FROM pages"
)
