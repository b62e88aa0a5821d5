"""Pages to a ranked inventory: sections, caps, overflow and site names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webcairn import limits as L
from webcairn.functions import text, urls
from webcairn.functions.sections import richness, section_of, section_rank
from webcairn.operators.ranking import positions, top_k

INVENTORY_COLUMNS = (
    "site_id", "section", "section_rank", "pos", "url", "title", "description", "h1", "section_hint",
)


def classify_pages(pages: DataFrame) -> DataFrame:
    """Add section, depth, richness and the homepage flag."""
    url, path = F.col("url"), urls.path_of(F.col("url"))
    return pages.withColumns(
        {
            "section": section_of(path),
            "depth": urls.segment_count(path),
            "rich": richness(F.col("title"), F.col("description"), F.col("snippet")),
            "is_home": urls.is_homepage(url, F.col("origin")),
        }
    )


def site_heads(pages: DataFrame) -> DataFrame:
    """Name, homepage snippet and default summary per site.

    The homepage with the least URL speaks for the site; without one the host does.
    """
    home = F.when(
        urls.is_homepage(F.col("url"), F.col("origin")),
        F.struct("url", "title", "h1", "description", "snippet"),
    )
    heads = pages.groupBy("site_id", "origin").agg(F.min(home).alias("home"))
    heads = heads.withColumn("raw", text.blank_to_null(F.coalesce("home.title", "home.h1")))
    heads = heads.select(
        "site_id",
        "origin",
        F.coalesce(text.strip_title_suffix(F.col("raw")), urls.host_of(F.col("origin"))).alias("site_name"),
        F.coalesce(
            text.blank_to_null(F.col("home.description")), text.blank_to_null(F.col("home.snippet"))
        ).alias("homepage_snippet"),
    )
    return heads.withColumn(
        "summary", text.default_summary(F.col("homepage_snippet"), F.col("site_name"))
    )


def ranked_sections(classified: DataFrame, cap: int = L.MAX_LINKS_PER_SECTION) -> DataFrame:
    """The best ``cap`` pages of every listed section."""
    listed = classified.where(~F.col("is_home") & (F.col("section") != L.OPTIONAL_SECTION))
    order = [F.col("depth"), F.col("rich").desc(), F.col("url")]
    return top_k(listed, ["site_id", "section"], order, cap)


def place_pages(classified: DataFrame, cap: int = L.MAX_LINKS_PER_SECTION) -> DataFrame:
    """Every page but homepages with its final section; ``rank`` is null in Optional.

    Pages past a section's cap overflow into Optional.  The pages kept are few, so
    they are joined back by (site, URL), a key no site can make hot.
    """
    kept = ranked_sections(classified, cap).select("site_id", "url", "rank")
    placed = classified.where(~F.col("is_home")).join(kept, ["site_id", "url"], "left")
    return placed.withColumn(
        "section", F.when(F.col("rank").isNull(), L.OPTIONAL_SECTION).otherwise(F.col("section"))
    )


def build_inventory(pages: DataFrame, cap: int = L.MAX_LINKS_PER_SECTION) -> DataFrame:
    """Inventory rows of every site, each with its dense position in its section.

    ``pages`` should be a stored table (or materialized): it is read twice.
    """
    if "section_hint" not in pages.columns:
        pages = pages.withColumn("section_hint", F.lit(None).cast("string"))
    placed = place_pages(classify_pages(pages), cap).withColumn("poor", -F.col("rich"))
    columns = [
        "site_id",
        "section",
        section_rank(F.col("section")).alias("section_rank"),
        F.col("pos").cast("bigint").alias("pos"),
        "url",
        text.blank_to_null(F.col("title")).alias("title"),
        F.coalesce(
            text.blank_to_null(F.col("description")), text.blank_to_null(F.col("snippet"))
        ).alias("description"),
        text.blank_to_null(F.col("h1")).alias("h1"),
        F.coalesce(text.blank_to_null(F.col("section_hint")), F.col("section")).alias("section_hint"),
    ]
    listed = placed.where(F.col("rank").isNotNull()).withColumnRenamed("rank", "pos")
    optional = positions(
        placed.where(F.col("rank").isNull()).drop("rank"), ["site_id"], ["depth", "poor", "url"]
    )
    return listed.select(columns).unionByName(optional.select(columns))


def nested_inventory(inventory: DataFrame) -> DataFrame:
    """Sections as nested arrays, for the output edge, in parts.

    Part 0 holds the listed sections, which are capped.  Optional has no bound: it goes on in parts
    of ``LINES_PER_PART`` pages from 1 on, each with Optional as its only section.
    """
    page = F.struct("pos", "url", "title", "description", "h1", "section_hint")
    later = F.floor((F.col("pos") - 1) / L.LINES_PER_PART).cast("bigint") + 1
    part = F.when(F.col("section") == L.OPTIONAL_SECTION, later).otherwise(0)
    sections = inventory.groupBy("site_id", part.alias("part_no"), "section_rank", "section").agg(
        F.array_sort(F.collect_list(page)).alias("pages")
    )
    section = F.struct("section_rank", F.col("section").alias("name"), "pages")
    return sections.groupBy("site_id", "part_no").agg(F.array_sort(F.collect_list(section)).alias("sections"))
