"""Admission of links into a crawl, and the bounded walk over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webcairn import limits as L
from webcairn.functions.urls import canonical_urls, is_crawlable_path, is_disallowed
from webcairn.operators.ranking import first_by, ranked, spread_join
from webcairn.session import materialize


def eligible_links(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """Candidates as canonical URLs of their own site that may be crawled.

    ``candidates``: site_id, href, base and order columns.  ``sites``: site_id,
    origin and, optionally, the disallow prefixes.
    """
    rules = sites.select(
        "site_id",
        "origin",
        F.col("disallow") if "disallow" in sites.columns else F.lit(None).cast("array<string>").alias("disallow"),
    )
    d = canonical_urls(candidates, "href", "base", parts=True)
    d = spread_join(d.where(F.col("url").isNotNull()), rules, ["site_id"])
    return d.where(
        (F.col("url_origin") == F.col("origin"))
        & is_crawlable_path(F.col("url_path"))
        & ~is_disallowed(F.col("url_path"), F.col("disallow"))
    ).drop("url_origin", "url_path", "origin", "disallow", "href", "base")


def admit(
    eligible: DataFrame,
    seen: DataFrame | None,
    found: DataFrame | None,
    order: list[str],
    max_pages: int | None = None,
) -> DataFrame:
    """Unseen URLs in order of first mention: all, or what is left of each site's ``max_pages``.

    Adds ``rank``, the admission number within the site.  ``order`` names one URL.
    """
    fresh = first_by(eligible, ["site_id", "url"], order)
    if seen is not None:
        fresh = fresh.join(seen.select("site_id", "url"), ["site_id", "url"], "left_anti")
    best = ranked(fresh, ["site_id"], order, max_pages, salts=32)
    if found is None:
        return best
    best = best.join(found, "site_id", "left").withColumn(
        "rank", (F.col("rank") + F.coalesce("found", F.lit(0))).cast("bigint")
    ).drop("found")
    return best if max_pages is None else best.where(F.col("rank") <= max_pages)


def capped_flags(
    candidates: DataFrame, accepted: DataFrame, found: DataFrame, max_pages: int = L.MAX_PAGES
) -> DataFrame:
    """Whether admission hit the page cap, per site with candidates."""
    raw = candidates.groupBy("site_id").agg(F.count(F.lit(1)).alias("candidates"))
    took = accepted.groupBy("site_id").agg(F.count(F.lit(1)).alias("accepted"))
    d = raw.join(took, "site_id", "left").join(found, "site_id", "left").fillna(0, ["accepted", "found"])
    budget = F.greatest(F.lit(max_pages) - F.col("found"), F.lit(0))
    capped = (budget == 0) | (
        (F.col("accepted") == budget) & (F.col("candidates") > F.col("accepted"))
    )
    return d.select("site_id", "candidates", "accepted", capped.alias("capped"))


def walk_links(
    seeds: DataFrame,
    edges: DataFrame,
    sites: DataFrame,
    max_depth: int = L.MAX_DEPTH,
    max_pages: int | None = None,
    follow_links: bool = True,
) -> DataFrame:
    """Pages reached from the seeds: site_id, url, depth, rank.

    ``seeds``: site_id, pos, href.  ``edges``: site_id, url (of the page), pos,
    href.  Targets of all edges are resolved and judged once.  One round per depth over
    all sites: a join with them on (site, page), an anti-join with what is known, and the
    page budget, if any.  A round's pages are written out.
    """
    first = seeds.join(sites.select("site_id", "origin"), "site_id").select(
        "site_id",
        "href",
        F.concat("origin", F.lit("/")).alias("base"),
        F.lit(0).cast("bigint").alias("o1"),
        F.col("pos").alias("o2"),
    )
    order = ["o1", "o2"]
    pages = materialize(
        admit(eligible_links(first, sites), None, None, order, max_pages)
        .select("site_id", "url", F.lit(0).cast("bigint").alias("depth"), "rank")
    )
    if not follow_links:
        return pages
    links = edges.select("site_id", F.col("url").alias("page"), F.col("url").alias("base"), F.col("pos").alias("o2"), "href")
    targets = materialize(eligible_links(links, sites))
    frontier = pages
    for depth in range(1, max_depth + 1):
        known = frontier.select("site_id", F.col("url").alias("page"), F.col("rank").alias("o1"))
        links = known.join(targets, ["site_id", "page"]).select("site_id", "url", "o1", "o2")
        found = pages.groupBy("site_id").agg(F.count(F.lit(1)).alias("found"))
        frontier = materialize(
            admit(links, pages, found, order, max_pages)
            .select("site_id", "url", F.lit(depth).cast("bigint").alias("depth"), "rank")
        )
        pages = pages.unionByName(frontier)
    return pages


def cached_links(json: Column) -> Column:
    """Stored links usable for a replay: a JSON array of strings, else null."""
    shape = F.schema_of_variant(F.try_parse_json(json))
    links = F.from_json(json, "array<string>")
    usable = shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(links, lambda x: x.isNull())
    return F.when(usable, links)


def replay_links(pages: DataFrame, links: str = "links", stored: str = "out_links_json") -> DataFrame:
    """Links of each page; an unchanged (304) page takes those stored with it."""
    usable = F.when(F.col("status") == 304, cached_links(F.col(stored))).otherwise(F.col(links))
    return pages.withColumn(links, usable).drop(stored)


def needs_full_fetch(follow_links: Column, depth: Column, stored_links: Column) -> Column:
    """Validators are withheld where a 304 would leave the crawl without links."""
    return follow_links & (depth < L.MAX_DEPTH) & cached_links(stored_links).isNull()


def fetch_list(admitted: DataFrame) -> DataFrame:
    """Send delay in seconds and batch number of each admitted page."""
    zero = F.col("rank") - 1
    return admitted.withColumns(
        {
            "delay_s": F.floor(zero / L.FETCHES_PER_SECOND).cast("bigint"),
            "batch": F.floor(zero / L.FETCH_BATCH).cast("bigint"),
        }
    )
