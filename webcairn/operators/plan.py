"""External refinement plans merged onto inventories, under guardrails."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webcairn import limits as L
from webcairn.functions import text
from webcairn.operators.ranking import first_by, positions, ranked, running_total, spread_join
from webcairn.session import materialize

OPTIONAL_RANK = 1 << 40
RECREATED_RANK = 1 << 30
PAGE_FIELDS = ("section", "url", "title", "description", "h1")


def accepted_plans(plan_heads: DataFrame) -> DataFrame:
    """Sites whose plan may be used, with its clean summary; a blank summary rejects the plan."""
    return plan_heads.select(
        "site_id", text.truncate(F.col("summary"), L.PLAN_SUMMARY_CHARS).alias("summary")
    ).where(F.col("summary").isNotNull())


def placements(plan: DataFrame) -> DataFrame:
    """First mention of each (site, URL): sections in plan order, then the optional list.

    Sections without a name are dropped with their pages.
    """
    rows = plan.select(
        "site_id",
        "url",
        "optional",
        F.when(F.col("optional"), OPTIONAL_RANK).otherwise(F.col("section_pos")).cast("bigint").alias("out_rank"),
        F.col("page_pos").cast("bigint").alias("page_pos"),
        F.when(F.col("optional"), L.OPTIONAL_SECTION)
        .otherwise(text.truncate(F.col("section_name"), L.PLAN_SECTION_CHARS))
        .alias("out_section"),
        text.truncate(F.col("description"), L.PLAN_DESCRIPTION_CHARS).alias("new_description"),
    ).where(F.col("out_section").isNotNull())
    return first_by(rows, ["site_id", "url"], ["out_rank", "page_pos"])


def placed_pages(inventory: DataFrame, plan: DataFrame) -> DataFrame:
    """Inventory pages with where the plan put them; unknown URLs never enter."""
    return inventory.join(placements(plan), ["site_id", "url"], "left")


def section_votes(placed: DataFrame) -> DataFrame:
    """Where most pages of an original section went; ties keep the destination met first."""
    votes = (
        placed.where(
            F.col("out_rank").isNotNull() & ~F.col("optional") & (F.col("section") != L.OPTIONAL_SECTION)
        )
        .groupBy("site_id", "section", "out_rank", "out_section")
        .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first_pos"))
    )
    ranked = F.struct(-F.col("votes"), "first_pos", "out_rank", "out_section", "votes")
    best = votes.groupBy("site_id", "section").agg(F.min(ranked).alias("b"))
    return best.select(
        "site_id",
        "section",
        F.col("b.out_rank").alias("to_rank"),
        F.col("b.out_section").alias("to_section"),
        F.col("b.votes").alias("votes"),
    )


def omitted_pages(placed: DataFrame) -> DataFrame:
    """Pages the plan left out, with the section they go back to.

    Optional pages return to Optional.  Others follow the vote of their section;
    without votes their section is recreated after the planned ones.
    """
    omitted = placed.where(F.col("out_rank").isNull())
    is_optional = F.col("section") == L.OPTIONAL_SECTION
    votes = section_votes(placed)
    listed = omitted.where(~is_optional).join(votes, ["site_id", "section"], "left")
    back = listed.withColumns(
        {
            "out_rank": F.coalesce("to_rank", F.col("section_rank") + RECREATED_RANK),
            "out_section": F.coalesce("to_section", "section"),
        }
    ).drop("to_rank", "to_section", "votes")
    rest = omitted.where(is_optional).withColumns(
        {
            "out_rank": F.lit(OPTIONAL_RANK).cast("bigint"),
            "out_section": F.lit(L.OPTIONAL_SECTION),
        }
    )
    return back.unionByName(rest)


def apply_plan(inventory: DataFrame, plan: DataFrame, plan_heads: DataFrame) -> DataFrame:
    """Refined inventory of the sites with an accepted plan; no page is ever lost."""
    sites = accepted_plans(plan_heads).select("site_id")
    known = spread_join(inventory, sites, ["site_id"])
    placed = placed_pages(known, plan)
    moved = placed.where(F.col("out_rank").isNotNull()).withColumns(
        {"block": F.lit(0), "o1": F.lit(0).cast("bigint"), "o2": F.col("page_pos")}
    )
    back = omitted_pages(placed).withColumns(
        {"block": F.lit(1), "o1": F.col("section_rank"), "o2": F.col("pos")}
    )
    rows = moved.unionByName(back).select(
        "site_id",
        F.col("out_section").alias("section"),
        F.col("out_rank").alias("section_rank"),
        "block",
        "o1",
        "o2",
        "url",
        "title",
        F.coalesce("new_description", "description").alias("description"),
        "h1",
        "section_hint",
    )
    numbered = positions(rows, ["site_id", "section_rank"], ["block", "o1", "o2", "url"])
    return numbered.drop("block", "o1", "o2").withColumn("pos", F.col("pos").cast("bigint"))


def prompt_rows(inventory: DataFrame, budget: int | None = None, field_chars: int | None = None) -> DataFrame:
    """Pages offered to an outside model, numbered: sections first, then Optional.

    All of them with whole fields, or the first ``budget`` per site with fields cut at ``field_chars``.
    """
    sent = ranked(inventory, ["site_id"], ["section_rank", "section", "pos"], budget, salts=32)

    def field(name: str):
        return text.truncate(F.col(name), field_chars).alias(name)

    return sent.select(
        "site_id", F.col("rank").alias("ord"), "section", "url", field("title"), field("description"), field("h1")
    )


def prompt_payloads(
    inventory: DataFrame,
    heads: DataFrame,
    budget: int | None = None,
    part_bytes: int = L.PLAN_PART_BYTES,
    field_chars: int | None = None,
    snippet_chars: int | None = None,
) -> DataFrame:
    """JSON payloads of every site, as many parts as its pages need, each page in one part.

    A part takes the pages that start within its ``part_bytes`` of page JSON, so only the last
    of them may reach past the limit.  Parts are numbered from 1 in page order; a page longer
    than a part leaves the numbers it runs over unused.
    """
    page = F.struct(*PAGE_FIELDS)
    keep_nulls = {"ignoreNullFields": "false"}
    sized = prompt_rows(inventory, budget, field_chars).withColumn(
        "size", F.octet_length(F.to_json(page, keep_nulls)) + 1
    )
    placed = running_total(materialize(sized), ["site_id"], "ord", "size")
    parts = (
        placed.withColumn("part", F.floor(F.col("before") / part_bytes) + 1)
        .groupBy("site_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("ord", *PAGE_FIELDS))).alias("pages"))
    )
    payload = F.to_json(
        F.struct(
            "site_name",
            "origin",
            text.truncate(F.col("homepage_snippet"), snippet_chars).alias("homepage_snippet"),
            F.transform("pages", lambda p: p.dropFields("ord")).alias("pages"),
        ),
        keep_nulls,
    )
    return spread_join(parts, heads, ["site_id"]).select("site_id", "part", payload.alias("payload"))
