"""Robots documents to crawl rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from webcairn import limits as L
from webcairn.functions.text import strip
from webcairn.functions.urls import is_disallowed
from webcairn.operators.ranking import copied_join

NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def robots_directives(docs: DataFrame, key: str = "site_id", cap: int | None = None) -> DataFrame:
    """One row per line: position, directive name and value (null where there is none).

    A ``cap`` in characters cuts the body; by default it is read whole.
    """
    body = F.col("body") if cap is None else F.substring(F.col("body"), 1, cap)
    lines = docs.select(key, F.posexplode(F.split(body, r"\r?\n")).alias("pos", "raw"))
    lines = lines.withColumn("line", strip(F.regexp_replace("raw", "#.*$", "")))
    named = F.instr("line", ":") > 0
    return lines.select(
        key,
        "pos",
        F.when(named, F.lower(strip(F.substring_index("line", ":", 1)))).alias("name"),
        F.when(named, strip(F.substr("line", F.instr("line", ":") + F.lit(1)))).alias("value"),
    )


def parse_robots(docs: DataFrame, agent: str = L.ROBOTS_AGENT, key: str = "site_id") -> DataFrame:
    """Rules per site: disallow prefixes, crawl delay and sitemaps, in document order.

    Adjacent user-agent lines share the rules below them.  Our own groups apply if
    the document names us, else those of ``*``.  A window holds one document and
    every step reuses the one shuffle by site.
    """
    d = robots_directives(docs, key)
    by_line = Window.partitionBy(key).orderBy("pos")
    rule = F.col("name") != "sitemap"
    d = d.withColumn("is_agent", F.when(rule, F.col("name") == "user-agent"))
    before = F.last("is_agent", ignorenulls=True).over(
        by_line.rowsBetween(Window.unboundedPreceding, -1)
    )
    d = d.withColumn(
        "starts", (F.col("is_agent") & ~F.coalesce(before, F.lit(False))).cast("int")
    )
    d = d.withColumn("grp", F.coalesce(F.sum("starts").over(by_line), F.lit(0)))
    named = F.when(F.col("is_agent"), F.lower("value"))
    group, doc = Window.partitionBy(key, "grp"), Window.partitionBy(key)
    d = d.withColumns(
        {
            "ours": F.count(F.when(named == agent, 1)).over(group),
            "any": F.count(F.when(named == "*", 1)).over(group),
            "has_ours": F.max(F.coalesce(named == agent, F.lit(False))).over(doc),
        }
    )
    # an agent repeated in its group takes each rule as often
    times = F.when(F.col("has_ours"), F.col("ours")).otherwise(F.col("any")).cast("int")
    d = d.withColumn("times", F.when(F.col("is_agent") == False, times).otherwise(0))  # noqa: E712
    seconds = F.nullif(F.regexp_extract("value", NUMBER, 0), F.lit("")).cast("double")
    delay = F.when(
        (F.col("name") == "crawl-delay")
        & (F.col("times") > 0)
        & (seconds >= 0)
        & (seconds < float("inf")),
        seconds,
    )
    banned = (F.col("name") == "disallow") & (F.col("value") != "") & (F.col("times") > 0)
    rules = d.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(banned, F.struct("pos", "value", "times")))).alias("d"),
        F.max(F.when(delay.isNotNull(), F.struct("pos", delay.alias("s"))))["s"].alias("delay_s"),
        F.array_sort(
            F.collect_list(
                F.when((F.col("name") == "sitemap") & (F.col("value") != ""), F.struct("pos", "value"))
            )
        ).alias("s"),
    )
    clamped = F.least(
        F.greatest(F.col("delay_s") * 1000, F.lit(float(L.DEFAULT_DELAY_MS))),
        F.lit(float(L.MAX_DELAY_MS)),
    )
    return rules.select(
        key,
        F.flatten(F.transform("d", lambda x: F.array_repeat(x["value"], x["times"]))).alias("disallow"),
        F.coalesce(clamped, F.lit(float(L.DEFAULT_DELAY_MS))).alias("crawl_delay_ms"),
        F.transform("s", lambda x: x["value"]).alias("sitemaps"),
    )


def exclude_disallowed(pages: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Pages under no disallow prefix: an equi-join on the site, then a check in the row."""
    joined = copied_join(pages, rules.select("site_id", "disallow"), ["site_id"], "left")
    return joined.where(~is_disallowed(F.col(path), F.col("disallow"))).drop("disallow")
