"""Sitemap documents to entries, and the bounded discovery over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from webcairn import limits as L
from webcairn.functions import markup
from webcairn.functions.text import WS, strip
from webcairn.functions.urls import canonical_urls, path_depth
from webcairn.operators.ranking import first_by, ranked, running_total, spread_join
from webcairn.session import materialize

#: What reading a document gives.
DOCUMENT = ("kind", "is_news", "is_feed", "entries", "children")


def _entries(body: Column, block: str, url, lastmod) -> Column:
    found = F.transform(
        markup.blocks(body, block),
        lambda b: F.struct(url(b).alias("url"), F.nullif(lastmod(b), F.lit("")).alias("lastmod")),
    )
    return F.filter(found, lambda e: e["url"] != "")


def _first(*names: str):
    return lambda b: F.coalesce(*[markup.element(b, n) for n in names])


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """Add kind (index, urlset or text), is_news, is_feed, entries and children.

    Feeds are only tried where a document has no urlset entries.
    """
    body = F.col("body")
    xml = F.regexp_replace(body, f"^{WS}+", "").startswith("<")
    d = docs.withColumn(
        "kind",
        F.when(~xml, "text").when(body.rlike(r"(?i)<sitemapindex\b"), "index").otherwise("urlset"),
    )
    urlset = F.col("kind") == "urlset"
    d = d.withColumns(
        {
            "is_news": urlset & body.rlike(r"(?i)xmlns:news=|<news:"),
            "children": F.when(
                F.col("kind") == "index",
                F.filter(
                    F.transform(markup.blocks(body, "sitemap"), lambda b: markup.element(b, "loc")),
                    lambda u: u != "",
                ),
            ),
            "__url": F.when(urlset, _entries(body, "url", _first("loc"), _first("lastmod"))),
        }
    )
    empty = urlset & (F.size("__url") == 0)
    d = d.withColumn(
        "__rss",
        F.when(
            empty & body.rlike(r"(?i)<rss\b|<rdf:RDF\b"),
            _entries(body, "item", _first("link", "guid"), _first("lastmod", "pubDate")),
        ),
    )
    d = d.withColumn(
        "__atom",
        F.when(
            empty & (F.coalesce(F.size("__rss"), F.lit(0)) <= 0) & body.rlike(r"(?i)<feed\b"),
            _entries(body, "entry", markup.atom_link, _first("updated", "modified")),
        ),
    )
    lines = F.filter(
        F.transform(F.split(body, r"\r?\n"), strip), lambda u: u.rlike(r"(?i)^https?://")
    )
    text = F.transform(
        lines, lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("lastmod"))
    )
    feed = F.coalesce(F.size("__rss") > 0, F.lit(False)) | F.coalesce(F.size("__atom") > 0, F.lit(False))
    return d.withColumns(
        {
            "is_feed": feed,
            "entries": F.when(F.col("kind") == "text", text)
            .when(F.size("__atom") > 0, F.col("__atom"))
            .when(F.size("__rss") > 0, F.col("__rss"))
            .otherwise(F.col("__url")),
        }
    ).drop("__url", "__rss", "__atom", "body")


def sitemap_entries(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per entry: keys, 1-based position, url, lastmod."""
    rows = parsed.select(*keys, F.posexplode("entries").alias("pos", "e"))
    return rows.select(
        *keys, (F.col("pos") + 1).cast("bigint").alias("pos"), "e.url", "e.lastmod"
    )


def sitemap_children(parsed: DataFrame, keys: list[str]) -> DataFrame:
    rows = parsed.select(*keys, F.posexplode("children").alias("pos", "child_url"))
    return rows.withColumn("pos", (F.col("pos") + 1).cast("bigint"))


def prioritize(entries: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct URLs ranked per site, all or the best ``cap``: shallow, then short, then in text order."""
    sized = entries.withColumns({"__depth": path_depth(F.col("url")), "__length": F.length("url")})
    return ranked(sized, ["site_id"], ["__depth", "__length", "url"], cap, salts=32).drop("__depth", "__length")


def _queued(fresh: DataFrame) -> DataFrame:
    """Add ``place``: 1, 2, ... per site by (o1, o2).  A window holds the children of one document, or one row for each."""
    per_parent = fresh.groupBy("site_id", "o1").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("site_id").orderBy("o1").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_parent.select("site_id", "o1", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("site_id", "o1").orderBy("o2", "doc_url"))
    placed = fresh.withColumn("inside", inside).join(starts, ["site_id", "o1"])
    return placed.select("site_id", "doc_url", (F.col("start") + F.col("inside")).cast("bigint").alias("place"))


def _stopped(answered: DataFrame, seen: DataFrame, raw_limit: int) -> tuple[DataFrame, DataFrame]:
    """Documents of a round with ``read``: whether their site still wanted entries, and the entries they add.

    ``answered`` is numbered per site across rounds; ``seen`` holds the entries of earlier rounds.
    """
    rows = sitemap_entries(answered.where(F.col("within") & F.col("entries").isNotNull()), ["site_id", "fetch_no"])
    fresh = first_by(rows.select("site_id", "url", "fetch_no"), ["site_id", "url"], ["fetch_no"])
    fresh = materialize(fresh.join(seen, ["site_id", "url"], "left_anti"))
    added = fresh.groupBy("site_id", "fetch_no").agg(F.count(F.lit(1)).alias("n"))
    had = seen.groupBy("site_id").agg(F.count(F.lit(1)).alias("had"))
    counted = answered.select("site_id", "fetch_no", "place").join(added, ["site_id", "fetch_no"], "left")
    before = running_total(counted.fillna(0, ["n"]), ["site_id"], "place", "n")
    wanted = before.join(had, "site_id", "left").select(
        "site_id", "fetch_no", (F.col("before") + F.coalesce("had", F.lit(0)) < raw_limit).alias("wanted")
    )
    judged = answered.join(wanted, ["site_id", "fetch_no"]).withColumn("read", F.col("within") & F.col("wanted"))
    judged = materialize(judged.drop("wanted"))
    kept = judged.where("read").select("site_id", "fetch_no")
    return judged, fresh.join(kept, ["site_id", "fetch_no"], "left_semi").select("site_id", "url")


def _expand(
    seed: DataFrame, visited: DataFrame, seen: DataFrame, docs: DataFrame, budget: int | None, raw_limit: int | None
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first over index children in queue order, until no site has a document left to read.

    Each round is one join per level of nesting; its few rows are written out, so
    the plan does not grow with the rounds.  A document is queued once, so cycles end.
    """
    frontier = seed
    while True:
        used = visited.groupBy("site_id").agg(F.count(F.lit(1)).alias("used"))
        fresh = first_by(
            frontier.join(visited.select("site_id", "doc_url"), ["site_id", "doc_url"], "left_anti"),
            ["site_id", "doc_url"],
            ["o1", "o2"],
        )
        numbered = _queued(fresh).join(used, "site_id", "left").select(
            "site_id", "doc_url", "place", (F.col("place") + F.coalesce("used", F.lit(0))).cast("bigint").alias("fetch_no")
        )
        within = F.lit(True) if budget is None else F.col("fetch_no") <= budget
        answered = materialize(numbered.withColumn("within", within).join(docs, ["site_id", "doc_url"], "left"))
        if answered.isEmpty():
            return visited, seen
        if raw_limit is None:
            answered = answered.withColumn("read", F.col("within"))
        else:
            answered, entries = _stopped(answered, seen, raw_limit)
            seen = materialize(seen.unionByName(entries))
        held = [F.when(F.col("read"), F.col(c)).alias(c) for c in DOCUMENT]
        answered = answered.select("site_id", "doc_url", "fetch_no", "read", *held)
        visited = visited.unionByName(answered)
        frontier = answered.select(
            "site_id",
            F.col("fetch_no").alias("o1"),
            F.posexplode("children").alias("o2", "doc_url"),
        ).select("site_id", "doc_url", "o1", F.col("o2").cast("bigint").alias("o2"))


def expand_sitemaps(
    declared: DataFrame,
    docs: DataFrame,
    origins: DataFrame,
    budget: int | None = None,
    fallback: bool = True,
    raw_limit: int | None = None,
) -> DataFrame:
    """Documents a discovery meets per site, numbered in queue order; ``read`` tells which it reads.

    ``declared``: site_id, pos, doc_url.  ``docs``: landed documents with status and
    body.  Sites whose declared sitemaps give no entry go on with the conventional paths.
    All documents are read by default.  With a ``budget`` a site reads that many, misses
    counted; with a ``raw_limit`` it stops after the document that brings its distinct
    entries to that number.  Documents left unread stay as rows, without what they hold.
    """
    readable = parse_sitemaps(docs.where((F.col("status") == 200) & F.col("body").isNotNull()))
    readable = materialize(readable.select("site_id", "doc_url", *DOCUMENT))
    seed = declared.select(
        "site_id", "doc_url", F.lit(0).cast("bigint").alias("o1"), F.col("pos").cast("bigint").alias("o2")
    )
    none = seed.select("site_id", "doc_url", F.col("o1").alias("fetch_no"), F.lit(True).alias("read")).join(
        readable, ["site_id", "doc_url"], "left"
    ).limit(0)
    nothing = seed.select("site_id", F.col("doc_url").alias("url")).limit(0)
    visited, seen = _expand(seed, none, nothing, readable, budget, raw_limit)
    if not fallback:
        return visited
    fed = visited.where(F.size("entries") > 0).select("site_id").distinct()
    paths = F.array(*[F.concat(F.col("origin"), F.lit(p)) for p in L.FALLBACK_SITEMAPS])
    conventional = (
        origins.join(fed, "site_id", "left_anti")
        .select("site_id", F.posexplode(paths).alias("o2", "doc_url"))
        .select("site_id", "doc_url", F.lit(0).cast("bigint").alias("o1"), F.col("o2").cast("bigint").alias("o2"))
    )
    return _expand(conventional, visited, seen, readable, budget, raw_limit)[0]


def collected_entries(visited: DataFrame) -> DataFrame:
    """Distinct entries of the documents read, in reading order."""
    rows = sitemap_entries(visited.where(F.col("entries").isNotNull()), ["site_id", "fetch_no"])
    return first_by(rows, ["site_id", "url"], ["fetch_no", "pos"])


def discovery_summary(visited: DataFrame) -> DataFrame:
    """Sitemaps found, in reading order, and the news and feed flags per site."""
    found = F.when(F.col("kind").isNotNull(), F.struct("fetch_no", "doc_url"))
    return visited.groupBy("site_id").agg(
        F.transform(F.array_sort(F.collect_list(found)), lambda x: x["doc_url"]).alias("found"),
        F.coalesce(F.bool_or("is_news"), F.lit(False)).alias("is_news"),
        F.coalesce(F.bool_or("is_feed"), F.lit(False)).alias("is_feed"),
    )


def alias_entries(entries: DataFrame, origins: DataFrame) -> DataFrame:
    """Rewrite entries onto the site's origin where all of them share one foreign origin.

    One origin means least equals greatest, so two plain aggregates decide it.
    """
    d = canonical_urls(entries.drop("origin"), "url", out="__c", parts=True)
    shares = d.groupBy("site_id").agg(F.min("__c_origin").alias("lo"), F.max("__c_origin").alias("hi"))
    foreign = (
        shares.where(F.col("lo") == F.col("hi"))
        .join(origins.select("site_id", "origin"), "site_id")
        .where(F.col("lo") != F.col("origin"))
        .select("site_id", "origin")
    )
    d = spread_join(d, foreign, ["site_id"], "left")
    tail = F.regexp_extract("url", r"(?i)^https?://[^/?#]*(.*)$", 1)
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    moved = F.col("origin").isNotNull() & F.col("__c_origin").isNotNull()
    return d.withColumn(
        "url", F.when(moved, F.concat("origin", tail)).otherwise(F.col("url"))
    ).select(*[c for c in entries.columns if c != "origin"])


def discovery_method(entries: DataFrame, origins: DataFrame) -> DataFrame:
    """``sitemap`` for sites with enough entries, ``links`` for the rest."""
    counts = entries.groupBy("site_id").agg(F.count(F.lit(1)).alias("entries"))
    n = F.coalesce(F.col("entries"), F.lit(0))
    return origins.join(counts, "site_id", "left").select(
        "site_id",
        n.alias("entries"),
        F.when(n >= L.MIN_SITEMAP_ENTRIES, "sitemap").otherwise("links").alias("method"),
    )
