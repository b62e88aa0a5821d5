"""Inventories to Markdown lines and documents; line rules of a valid document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from webcairn import limits as L
from webcairn.functions import text
from webcairn.functions.urls import canonical_urls
from webcairn.operators.ranking import spread_join

HEAD_LINES = 4


def document_lines(inventory: DataFrame, heads: DataFrame) -> DataFrame:
    """Numbered lines of every site's document: title, summary, sections, Optional last.

    Line numbers come from section sizes and positions, so no site has to be
    sorted, or even seen, as a whole.
    """
    sizes = inventory.groupBy("site_id", "section_rank", "section").agg(
        F.count(F.lit(1)).alias("links")
    )
    above = (
        Window.partitionBy("site_id")
        .orderBy("section_rank", "section")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.withColumn(
        "heading_no",
        F.coalesce(F.sum(F.col("links") + 2).over(above), F.lit(0)) + HEAD_LINES + 1,
    ).join(heads.select("site_id", "origin"), "site_id")

    def numbered(no: Column, line: Column) -> Column:
        return F.struct(no.cast("bigint").alias("line_no"), line.alias("line"))

    head = heads.select(
        "site_id",
        "origin",
        F.explode(
            F.array(
                numbered(F.lit(1), F.concat(F.lit("# "), text.collapse(F.col("site_name")))),
                numbered(F.lit(2), F.lit("")),
                numbered(F.lit(3), F.concat(F.lit("> "), text.collapse(F.col("summary")))),
                numbered(F.lit(4), F.lit("")),
            )
        ).alias("l"),
    )
    frames = starts.select(
        "site_id",
        "origin",
        F.explode(
            F.array(
                numbered(F.col("heading_no"), F.concat(F.lit("## "), text.collapse(F.col("section")))),
                numbered(F.col("heading_no") + F.col("links") + 1, F.lit("")),
            )
        ).alias("l"),
    )
    label = text.link_label(F.col("title"), F.col("h1"), F.col("url"))
    labelled = spread_join(
        inventory.withColumn("label", label),
        starts.select("site_id", "section_rank", "origin", "heading_no"),
        ["site_id", "section_rank"],
    )
    link = F.concat(
        F.lit("- ["),
        F.col("label"),
        F.lit("]("),
        text.link_target(F.col("url")),
        F.lit("): "),
        text.link_description(F.col("description"), F.col("section"), F.col("label")),
    )
    links = labelled.select(
        "site_id", "origin", numbered(F.col("heading_no") + F.col("pos"), link).alias("l")
    )
    lines = head.unionByName(frames).unionByName(links)
    return lines.select("site_id", "origin", "l.line_no", "l.line")


def assemble(lines: DataFrame, keys: tuple[str, ...] = ("site_id",), per_part: int = L.LINES_PER_PART) -> DataFrame:
    """Lines to text in parts of a bounded number of lines.

    A document within the crawl's page cap is one part; a longer one goes on in
    the next part, so nothing is cut and no task holds more than one part.
    """
    part = F.floor((F.col("line_no") - 1) / per_part).cast("bigint")
    return (
        lines.groupBy(*keys, part.alias("part_no"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
        .select(
            *keys,
            "part_no",
            F.size("ls").cast("bigint").alias("lines"),
            F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"),
        )
    )


def split_documents(docs: DataFrame, keys: list[str], per_part: int = L.LINES_PER_PART) -> DataFrame:
    """Document text (or parts of it) back to numbered lines."""
    offset = F.col("part_no") * per_part if "part_no" in docs.columns else F.lit(0)
    return docs.select(
        *keys, offset.alias("__off"), F.posexplode(F.split("content", "\n")).alias("i", "line")
    ).select(*keys, (F.col("__off") + F.col("i") + 1).cast("bigint").alias("line_no"), "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Kind of each line, and label, target and description of link lines."""
    line = F.col("line")
    pattern = r"^\s*-\s\[([^\]]+)\]\(([^)]+)\)(:?)(.*)$"
    is_link = line.rlike(pattern)
    kind = (
        F.when(line.rlike(r"^#\s"), "h1")
        .when(line.rlike(r"^##\s"), "h2")
        .when(line.startswith(">"), "quote")
        .when(is_link, "link")
        .when(line.rlike(r"^\s*-\s"), "bullet")
        .otherwise("text")
    )

    def group(i: int) -> Column:
        return F.when(kind == "link", F.regexp_extract(line, pattern, i))

    return lines.withColumns(
        {
            "kind": kind,
            "label": group(1),
            "url": group(2),
            "description": F.when(kind == "link", F.trim(F.regexp_extract(line, pattern, 4))),
        }
    )


def _broken(*rules: tuple[Column, str, Column | None]) -> Column:
    """The rules, of (broken, rule, detail), whose condition holds."""
    found = [
        F.when(
            broken,
            F.struct(
                F.lit(rule).alias("rule"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")
            ),
        )
        for broken, rule, detail in rules
    ]
    return F.array_compact(F.array(*found))


def validate_lines(
    lines: DataFrame, keys: tuple[str, ...] = ("site_id",), prefix_origin: bool = False
) -> DataFrame:
    """Rule violations: keys, line_no (0 for the whole document), rule, detail.

    ``detail`` is the link target or the section name where the rule is about one.

    ``lines`` carries the keys, ``origin``, ``line_no`` and ``line``.  "Before" and
    "after" rules only need the first title and first Optional line of a document,
    which are plain minima; link lines are checked where they are.
    ``prefix_origin`` also accepts links that merely start with the origin text.
    """
    line, no = F.col("line"), F.col("line_no")
    is_h1, is_h2, is_quote = line.startswith("# "), line.startswith("## "), line.startswith("> ")
    name = text.strip(F.substr(line, F.lit(4)))
    first = lines.groupBy(*keys).agg(
        F.min(F.when(is_h1, no)).alias("h1_no"),
        F.min(F.when(is_h2 & (name == L.OPTIONAL_SECTION), no)).alias("optional_no"),
        F.max(is_quote).alias("quoted"),
        F.max(no).alias("last_no"),
    )
    is_link = line.startswith("- ")
    is_deep = line.rlike(r"^#{3,}\s")
    target = F.when(
        is_link & line.rlike(L.LINK_LINE), F.regexp_extract(line, r"\((https?://[^)]+)\)", 1)
    )
    marks = lines.where(is_h1 | is_h2 | is_quote | is_deep | is_link).withColumn("target", target)
    marks = canonical_urls(marks, "target", out="link", parts=True)
    # a document's facts go to each block of its lines: one copy for most, and none to the lines of others
    block = F.floor(F.col("line_no") / L.LINES_PER_PART)
    copies = first.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last_no") / L.LINES_PER_PART))))
    marks = marks.withColumn("__block", block).join(copies, [*keys, "__block"]).drop("__block", "last_no")
    late = is_h2 & (no > F.col("optional_no"))
    same = F.col("link_origin") == F.col("origin")
    if prefix_origin:
        same = same | F.startswith(F.col("target"), F.col("origin"))
    untitled = F.col("h1_no").isNull() | (no < F.col("h1_no"))
    line_errors = marks.select(
        *keys,
        "line_no",
        F.inline(
            _broken(
                (is_h1 & (no > F.col("h1_no")), "title_repeated", None),
                (is_h1 & (no != 1), "title_not_first", None),
                (late, "section_after_optional", name),
                (late & (name == L.OPTIONAL_SECTION), "optional_repeated", None),
                (is_quote & untitled, "summary_before_title", None),
                (is_deep, "heading_too_deep", None),
                (is_link & F.col("target").isNull(), "link_malformed", None),
                (F.col("target").isNotNull() & F.col("link").isNull(), "link_invalid", F.col("target")),
                (F.col("link").isNotNull() & ~same, "link_foreign", F.col("target")),
            )
        ),
    )
    whole = first.select(
        *keys,
        F.lit(0).cast("bigint").alias("line_no"),
        F.inline(
            _broken((F.col("h1_no").isNull(), "title_missing", None), (~F.col("quoted"), "summary_missing", None))
        ),
    )
    return line_errors.unionByName(whole)


def choose_documents(heuristic: DataFrame, refined: DataFrame, errors: DataFrame) -> DataFrame:
    """Refined lines of sites whose refinement is valid, heuristic lines of the rest."""
    bad = errors.select("site_id").distinct()
    good = refined.select("site_id").distinct().join(bad, "site_id", "left_anti")
    flag = good.withColumn("refined_ok", F.lit(True))
    taken = spread_join(refined, flag, ["site_id"]).withColumn(
        "generated_by", F.lit(L.GENERATED_BY[1])
    )
    kept = (
        spread_join(heuristic, flag, ["site_id"], "left")
        .where(F.col("refined_ok").isNull())
        .withColumn("generated_by", F.lit(L.GENERATED_BY[0]))
    )
    return kept.unionByName(taken).drop("refined_ok")
