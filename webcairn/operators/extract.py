"""Landed page bodies to page records and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webcairn import limits as L
from webcairn.functions import markup
from webcairn.functions.urls import canonical_urls


def cap_body(
    df: DataFrame, body: str = "html", declared: str = "content_length", cap: int | None = None
) -> DataFrame:
    """Drop a body whose declared length passes the cap, cut any other at the cap; all stay whole without one."""
    if cap is None:
        return df
    kept = F.when(F.coalesce(F.col(declared), F.lit(0)) <= cap, F.substring(F.col(body), 1, cap))
    return df.withColumn(body, kept)


def is_usable(status: Column, body: Column, content_type: Column) -> Column:
    return F.coalesce(
        (status == 200) & body.isNotNull() & content_type.rlike(L.HTML_CONTENT_TYPE), F.lit(False)
    )


def ingest_pages(snapshots: DataFrame) -> DataFrame:
    """Tag each fetched row: ``html``, ``unchanged`` (304) or ``error``.  No row is lost."""
    usable = is_usable(F.col("status"), F.col("html"), F.col("content_type"))
    return snapshots.withColumn(
        "ingest", F.when(usable, "html").when(F.col("status") == 304, "unchanged").otherwise("error")
    )


def poison_rows(snapshots: DataFrame, url: str = "url") -> DataFrame:
    """Add ``reason``: why a fetched row cannot become a page, null for those that can or are unchanged.

    Nothing here raises on any text, so one bad row never ends the job; the rows with a
    reason are the error output beside the pages.
    """
    known = canonical_urls(snapshots, url, out="__canonical")
    status, kind = F.col("status"), F.col("content_type")
    reason = (
        F.when(F.col("__canonical").isNull(), "bad_url")
        .when(status == 304, F.lit(None))
        .when(status.isNull() | (status != 200), "bad_status")
        .when(F.col("html").isNull(), "no_body")
        .when(~is_usable(status, F.col("html"), kind), "not_html")
    )
    return known.withColumn("reason", reason).drop("__canonical")


def extract_pages(snapshots: DataFrame, html: str = "html") -> DataFrame:
    """Replace the body by title, description, h1, snippet, hash and raw links.

    A narrow map: the body never reaches a shuffle.
    """
    rest = [c for c in snapshots.columns if c != html]
    seen = snapshots.select(*rest, markup.visible(F.col(html)).alias("__html"))
    seen = seen.select(
        *rest,
        markup.title_text(F.col("__html")).alias("__title"),
        markup.h1_text(F.col("__html")).alias("h1"),
        markup.snippet_text(F.col("__html")).alias("snippet"),
        markup.meta_tags(F.col("__html")).alias("__meta"),
        markup.hrefs(F.col("__html")).alias("links"),
    )
    meta = F.col("__meta")
    seen = seen.select(
        *rest,
        F.coalesce(
            F.nullif(F.col("__title"), F.lit("")), markup.meta_content(meta, "property", "og:title")
        ).alias("title"),
        F.coalesce(
            markup.meta_content(meta, "name", "description"),
            markup.meta_content(meta, "property", "og:description"),
        ).alias("description"),
        "h1",
        "snippet",
        "links",
    )
    return seen.withColumn(
        "content_hash", markup.fingerprint(*[F.col(c) for c in ("title", "description", "h1", "snippet")])
    )


def extract_links(snapshots: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per raw link: keys, 1-based position, href."""
    return snapshots.select(
        *keys, F.posexplode(markup.hrefs(markup.visible(F.col(html)))).alias("pos", "href")
    ).withColumn("pos", (F.col("pos") + 1).cast("bigint"))


def extract_meta_tags(snapshots: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """First content per meta name and per meta property."""
    tags = snapshots.select(
        *keys, F.posexplode(markup.meta_tags(markup.visible(F.col(html)))).alias("pos", "tag")
    )
    named = tags.select(
        *keys,
        "pos",
        F.explode(
            F.array(
                F.struct(F.lit("name").alias("kind"), F.col("tag.name").alias("key")),
                F.struct(F.lit("property").alias("kind"), F.col("tag.property").alias("key")),
            )
        ).alias("k"),
        F.col("tag.content").alias("content"),
    ).where(F.col("k.key") != "")
    first = named.groupBy(*keys, F.col("k.kind").alias("kind"), F.col("k.key").alias("key")).agg(
        F.min(F.struct("pos", "content")).alias("first")
    )
    return first.select(*keys, "kind", "key", F.col("first.content").alias("content"))
