"""Landed pages to index documents, for every site in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webcairn.functions.urls import canonical_urls
from webcairn.operators import document, inventory
from webcairn.operators.extract import cap_body, extract_pages, ingest_pages
from webcairn.operators.ranking import spread_join
from webcairn.session import materialize


def pages_from_snapshots(snapshots: DataFrame) -> DataFrame:
    """Fetched rows to the page table: the newest usable body of each (site, URL).

    Newest is the greatest ``fetched_at``, then the greatest ``run_id``, then the
    greatest row.  ``poison_rows`` lists the rows that are no pages.
    """
    usable = ingest_pages(cap_body(snapshots)).where(F.col("ingest") == "html").drop("ingest")
    pages = canonical_urls(extract_pages(usable), "url").where(F.col("url").isNotNull())
    if "rendered_html" in pages.columns:
        pages = pages.drop("rendered_html")
    order = ["fetched_at", "run_id"]
    rest = [c for c in pages.columns if c not in ("site_id", "url", *order)]
    best = pages.groupBy("site_id", "url").agg(F.max(F.struct(*order, *rest)).alias("newest"))
    return best.select("site_id", "url", "newest.*")


def generate_documents(pages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """The index document of every site, in parts, with its number of rule violations.

    ``pages`` is the stored page table (``site_id, url, title, ...``).  The origin comes
    from ``sites`` (``site_id, origin``) unless the pages carry one.
    """
    if "origin" not in pages.columns:
        if sites is None:
            raise ValueError("pages have no origin: pass the sites table")
        pages = spread_join(pages, sites.select("site_id", "origin"), ["site_id"])
    heads = inventory.site_heads(pages)
    lines = document.document_lines(inventory.build_inventory(pages), heads)
    parts = materialize(document.assemble(lines, ("site_id", "origin")))
    errors = (
        document.validate_lines(document.split_documents(parts, ["site_id", "origin"]))
        .groupBy("site_id")
        .agg(F.count(F.lit(1)).alias("errors"))
    )
    return parts.join(errors, "site_id", "left").fillna(0, ["errors"]).drop("origin")
