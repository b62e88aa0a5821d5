"""Landed robots and sitemap documents to crawl seeds, for every site in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webcairn import limits as L
from webcairn.operators import frontier, robots, sitemap
from webcairn.session import materialize


def newest_docs(site_docs: DataFrame) -> DataFrame:
    """Each (site, document) as landed last: by ``fetched_at``, then the greatest run id; a run lands a document once.

    Rows without a time or run id are older than all others.  Bodies are not compared, only these numbers.
    """
    by = [c for c in ("fetched_at", "run_id") if c in site_docs.columns]
    if not by:
        return site_docs
    keys = ["site_id", "doc_url"]
    stamp = F.struct(*by)
    newest = site_docs.groupBy(*keys).agg(F.max(stamp).alias("__newest"))
    stamped = site_docs.withColumn("__newest", stamp)
    same = [stamped[c] == newest[c] for c in keys] + [stamped["__newest"].eqNullSafe(newest["__newest"])]
    return stamped.join(newest, same, "left_semi").drop("__newest")


def discover(
    site_docs: DataFrame,
    sites: DataFrame,
    agent: str = L.ROBOTS_AGENT,
    raw_limit: int | None = None,
    max_urls: int | None = None,
    max_pages: int | None = None,
    max_docs: int | None = None,
) -> dict[str, DataFrame]:
    """Rules, discovery summary, method and admitted seeds per site.

    ``site_docs``: site_id, doc_url, kind, status, body and, optionally, run_id and fetched_at.
    ``sites``: site_id, origin.  Sites with too few sitemap entries start from their
    homepage.  Documents and entries read, URLs kept and pages admitted per site are unlimited by default.
    """
    site_docs = newest_docs(site_docs)
    texts = site_docs.where((F.col("kind") == "robots") & (F.col("status") == 200) & F.col("body").isNotNull())
    rules = materialize(robots.parse_robots(texts, agent))
    declared = rules.select("site_id", F.posexplode("sitemaps").alias("pos", "doc_url"))
    maps = site_docs.where(F.col("kind") == "sitemap").select("site_id", "doc_url", "status", "body")
    visited = sitemap.expand_sitemaps(
        declared, maps, sites.select("site_id", "origin"), max_docs, raw_limit=raw_limit
    )
    raw = sitemap.collected_entries(visited)
    entries = sitemap.alias_entries(sitemap.prioritize(raw, max_urls).drop("fetch_no", "pos"), sites)
    entries = materialize(entries)
    method = sitemap.discovery_method(entries, sites)
    ruled = sites.join(rules.select("site_id", "disallow"), "site_id", "left")
    listed = entries.join(method.where("method = 'sitemap'"), "site_id", "left_semi")
    home = method.where("method = 'links'").join(sites, "site_id")
    seeds = listed.select("site_id", F.col("url").alias("href"), F.col("rank").cast("bigint").alias("o")).unionByName(
        home.select("site_id", F.concat("origin", F.lit("/")).alias("href"), F.lit(0).cast("bigint").alias("o"))
    )
    seeds = seeds.join(sites.select("site_id", "origin"), "site_id").withColumnRenamed("origin", "base")
    admitted = frontier.admit(frontier.eligible_links(seeds, ruled), None, None, ["o"], max_pages)
    return {
        "rules": rules,
        "summary": sitemap.discovery_summary(visited),
        "method": method,
        "entries": entries,
        "seeds": admitted.select("site_id", "url", "rank"),
    }
