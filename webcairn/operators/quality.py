"""Extraction quality, render choice and render budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webcairn import limits as L
from webcairn.functions.text import strip
from webcairn.functions.urls import canonical, is_crawlable_path, origin_of
from webcairn.operators.ranking import ranked


def crawlable_links(links: Column, url: Column) -> Column:
    """Distinct canonical same-origin links; a page has at most 300, so no shuffle is needed."""
    found = F.transform(links, lambda href: canonical(href, url))
    own = F.filter(
        found, lambda u: (u["origin"] == origin_of(url)) & is_crawlable_path(u["path"])
    )
    return F.array_distinct(F.transform(own, lambda u: u["url"]))


def _length(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)), F.lit(0))


def _generic(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)), F.lit("")).isin(*L.GENERIC_TITLES)


def assess_quality(pages: DataFrame, follow_links: bool = True) -> DataFrame:
    """Add useful_snippet, link_count, reasons and needs_render."""
    d = pages.withColumns(
        {
            "useful_snippet": _length(F.col("snippet")) >= L.USEFUL_SNIPPET_CHARS,
            "link_count": F.size(crawlable_links(F.col("links"), F.col("url"))).cast("bigint"),
        }
    )
    thin = (_length(F.col("description")) == 0) & ~F.col("useful_snippet")
    generic = _generic(F.col("title")) & _generic(F.col("h1"))
    few = F.lit(follow_links) & (F.col("link_count") < L.MIN_DISCOVERY_LINKS)
    d = d.withColumn(
        "reasons",
        F.array_compact(
            F.array(
                F.when(thin, "thin_content"),
                F.when(generic, "generic_heading"),
                F.when(few, "few_static_links"),
            )
        ),
    )
    return d.withColumn(
        "needs_render", F.arrays_overlap("reasons", F.array(F.lit("thin_content"), F.lit("few_static_links")))
    )


def render_budget(renders: DataFrame, order: list[str], budget: int | None = None) -> DataFrame:
    """Renders of each run, first come first served: all, or those within its ``budget``.

    Only renders that gave something take a slot.
    """
    usable = renders.where(F.col("rendered_html").isNotNull())
    return ranked(usable, ["run_id"], order, budget)


def choose_render(static: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """Static and rendered assessments side by side, with the better one chosen."""
    fields = ["snippet", "description", "useful_snippet", "link_count"]
    r = rendered.select(*keys, *[F.col(c).alias(f"r_{c}") for c in fields])
    d = static.join(r, keys, "left")
    gained_text = ~F.col("useful_snippet") & (
        (_length(F.col("r_snippet")) > _length(F.col("snippet")))
        | (
            (F.coalesce("r_description", F.lit("")) != "")
            & (F.coalesce("description", F.lit("")) == "")
        )
    )
    better = gained_text | (F.col("r_link_count") > F.col("link_count"))
    return d.withColumn(
        "chosen", F.when(F.coalesce(better, F.lit(False)), "rendered").otherwise("static")
    )
