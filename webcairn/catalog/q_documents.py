"""Queries over inventories, documents and refinement plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webcairn import limits as L
from webcairn.catalog import views
from webcairn.catalog.ctes import collapse, define, lit, oracle, section, section_rank, segments, strip, truncate
from webcairn.functions import text, urls
from webcairn.functions.sections import section_of
from webcairn.operators import document, inventory as inv, plan as plans
from webcairn.plans.generate import generate_documents
from webcairn.operators.ranking import positions
from webcairn.session import materialize
from webcairn.sources.sinks import document_table, write_documents
from webcairn.streaming.runner import work_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# A refinement plan derived from the inventory: renamed, merged, promoted, repeated,
# nameless and unknown entries, and pages left out.
PLAN = """
SELECT site_id,
  CASE WHEN pos % 7 = 2 THEN 50 WHEN section = 'About' THEN 3 ELSE section_rank END AS section_pos,
  CASE WHEN pos % 7 = 2 THEN '   ' WHEN site_id = 'example.net' AND section = 'Documentation' THEN 'Optional'
       WHEN section = 'About' THEN 'Blog  guide' ELSE section || '  guide' END AS section_name,
  CASE WHEN section = 'About' THEN 100 + pos ELSE pos END AS page_pos, url,
  CASE pos % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE repeat(coalesce(title, 'none') || ' ', 9) END AS description,
  false AS optional
FROM {inventory}
WHERE section <> 'Optional' AND pos % 4 <> 3 AND NOT (site_id = 'example.com' AND section = 'Products')
UNION ALL
SELECT site_id, 5, 'Core Pages  guide', 1000 + pos, url, 'promoted', false
FROM {inventory} WHERE section = 'Optional' AND pos % 5 = 0
UNION ALL
SELECT site_id, 0, 'none', pos, url, NULL, true
FROM {inventory} WHERE section = 'Optional' AND pos % 5 = 1
UNION ALL
SELECT site_id, 0, 'none', 100000 + section_rank * 100 + pos, url, 'again', true
FROM {inventory} WHERE section <> 'Optional' AND pos % 4 = 1
UNION ALL
SELECT site_id, section_rank, section || '  guide', 0, url || '/unknown', 'unknown', false
FROM {inventory} WHERE pos % 6 = 1
"""
PLAN_HEADS = """
SELECT site_id, CASE WHEN site_id = 'example.org' THEN '  '
  ELSE ' Refined   summary of ' || site_name || ' ' END AS summary
FROM {heads}
"""

# Every document text as a Markdown candidate that may break the line rules.
CANDIDATES = """
SELECT doc_id, 'https://example.com' AS origin, replace(CASE doc_id % 8
  WHEN 0 THEN '# T~~> s~~## Documentation~- [a](https://example.com/x): ' || body
  WHEN 1 THEN body
  WHEN 2 THEN '> q~# T~' || body
  WHEN 3 THEN '# T~> q~## Optional~- [o](https://example.com/o): d~## Blog~' || body || '~## Optional'
  WHEN 4 THEN '# T~> q~# U~### deep~' || body
  WHEN 5 THEN '# T~> q~- [a](https://other.org/x): d~- broken~- ' || body
  WHEN 6 THEN '~# T~> q~' || body
  ELSE '# T~> q~- [p](https://example.com.evil.org/x): d~' || body END, '~', '{nl}') AS content
FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN replace(text, '. ', '.~- ') ELSE replace(text, '~', ' ') END AS body
  FROM {documents}
) AS d
"""

define(
    "classified",
    ("page_rows",),
    f"""
SELECT *, {section('path')} AS section, {segments('path')} AS depth,
  CASE WHEN coalesce({strip('title')}, '') <> '' THEN 2 ELSE 0 END
    + CASE WHEN coalesce({strip('description')}, '') <> '' THEN 2
           WHEN coalesce({strip('snippet')}, '') <> '' THEN 1 ELSE 0 END AS rich,
  path IN ('', '/') AS is_home
FROM (SELECT *, regexp_extract(url, '^https://[^/?]+([^?]*)', 1) AS path FROM page_rows)""",
)
define(
    "heads",
    ("classified",),
    f"""
SELECT site_id, origin, site_name, homepage_snippet,
  coalesce(homepage_snippet, 'Key pages and documentation for ' || site_name || '.') AS summary
FROM (
  SELECT s.site_id, s.origin,
    coalesce(nullif(CASE WHEN instr(raw, ' | ') > 1 THEN split_part(raw, ' | ', 1)
         WHEN instr(raw, ' — ') > 1 THEN split_part(raw, ' — ', 1)
         WHEN instr(raw, ' – ') > 1 THEN split_part(raw, ' – ', 1)
         WHEN instr(raw, ' - ') > 1 THEN split_part(raw, ' - ', 1) ELSE raw END, ''), s.site_id) AS site_name,
    coalesce(nullif({strip('h.description')}, ''), nullif({strip('h.snippet')}, '')) AS homepage_snippet
  FROM (SELECT DISTINCT site_id, origin FROM classified) s
  LEFT JOIN (SELECT *, {strip('coalesce(title, h1)')} AS raw FROM (
      SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY url) AS hn FROM classified WHERE is_home)
    WHERE hn = 1) h USING (site_id)
)""",
)
define(
    "placed",
    ("classified",),
    f"""
SELECT *, CASE WHEN section = 'Optional' OR rank > {L.MAX_LINKS_PER_SECTION} THEN 'Optional' ELSE section END AS final
FROM (SELECT *, row_number() OVER (PARTITION BY site_id, section ORDER BY depth, rich DESC, url) AS rank
      FROM classified WHERE NOT is_home)""",
)
define(
    "inventory",
    ("placed",),
    f"""
SELECT site_id, final AS section, {section_rank('final')} AS section_rank,
  row_number() OVER (PARTITION BY site_id, final ORDER BY depth, rich DESC, url) AS pos, url,
  nullif({strip('title')}, '') AS title,
  coalesce(nullif({strip('description')}, ''), nullif({strip('snippet')}, '')) AS description,
  nullif({strip('h1')}, '') AS h1, final AS section_hint
FROM placed""",
)


def lines_sql(inventory: str, heads: str) -> str:
    label = f"coalesce(nullif(translate({collapse('coalesce(title, h1, url)')}, '[]', '()'), ''), url)"
    return f"""
SELECT site_id, origin, CAST(row_number() OVER (PARTITION BY site_id ORDER BY r, section, k, pos) AS BIGINT) AS line_no, line
FROM (
  SELECT site_id, origin, unnest([-4, -3, -2, -1]) AS r, '' AS section, 0 AS k, 0 AS pos,
    unnest(['# ' || {collapse('site_name')}, '', '> ' || {collapse('summary')}, '']) AS line FROM {heads}
  UNION ALL
  SELECT site_id, origin, section_rank, section, unnest([0, 2]), 0, unnest(['## ' || {collapse('section')}, ''])
  FROM (SELECT DISTINCT site_id, section_rank, section FROM {inventory}) JOIN {heads} USING (site_id)
  UNION ALL
  SELECT site_id, origin, section_rank, section, 1, pos, '- [' || label || '](' ||
    replace(replace(url, ')', '%29'), '(', '%28') || '): ' ||
    coalesce(nullif({collapse('description')}, ''), label || ' (' || section || ').')
  FROM (SELECT *, {label} AS label FROM {inventory}) JOIN {heads} USING (site_id)
)"""


define("lines", ("inventory", "heads"), lines_sql("inventory", "heads"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """The stored page table: extraction is cut off here, as a written table would."""
    return materialize(views.page_rows(spark, sf).drop("etag", "last_modified", "lastmod"))


def built(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = pages(spark, sf)
    return inv.build_inventory(rows), inv.site_heads(rows)


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    return views.page_rows(spark, sf)


QUERIES["page_rows"] = page_rows
ORACLE["page_rows"] = oracle("SELECT * FROM page_rows", "page_rows")


def section_classify(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.web(spark, sf)
    return rows.select("page_id", "url_path", section_of(F.col("url_path")).alias("section"))


QUERIES["section_classify"] = section_classify
ORACLE["section_classify"] = oracle(
    f"SELECT page_id, url_path, {section('url_path')} AS section FROM web", "web"
)


def section_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return inv.ranked_sections(inv.classify_pages(views.page_rows(spark, sf))).select(
        "site_id", "section", F.col("rank").cast("bigint").alias("rank"), "url", "depth", "rich"
    )


QUERIES["section_rank"] = section_ranked
ORACLE["section_rank"] = oracle(
    f"""SELECT site_id, section, rank, url, depth, rich FROM placed
WHERE section <> 'Optional' AND rank <= {L.MAX_LINKS_PER_SECTION}""",
    "placed",
)


def section_overflow(spark: SparkSession, sf: str) -> DataFrame:
    classified = inv.classify_pages(pages(spark, sf)).withColumn("own", F.col("section"))
    return inv.place_pages(classified).where(F.col("rank").isNull()).select("site_id", "own", "url")


QUERIES["section_overflow"] = section_overflow
ORACLE["section_overflow"] = oracle(
    "SELECT site_id, section AS own, url FROM placed WHERE final = 'Optional'", "placed"
)


def site_name(spark: SparkSession, sf: str) -> DataFrame:
    return inv.site_heads(views.page_rows(spark, sf))


QUERIES["site_name"] = site_name
ORACLE["site_name"] = oracle(
    "SELECT site_id, origin, site_name, homepage_snippet, summary FROM heads", "heads"
)


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf)[0]


QUERIES["inventory"] = inventory
ORACLE["inventory"] = oracle("SELECT * FROM inventory", "inventory")


def inventory_nested(spark: SparkSession, sf: str) -> DataFrame:
    nested = inv.nested_inventory(built(spark, sf)[0])
    return nested.select(
        "site_id",
        "part_no",
        F.array_join(F.transform("sections", lambda s: s["name"]), ",").alias("names"),
        F.array_join(
            F.flatten(F.transform("sections", lambda s: F.transform(s["pages"], lambda p: p["url"]))), " "
        ).alias("urls"),
    )


QUERIES["inventory_nested"] = inventory_nested
ORACLE["inventory_nested"] = oracle(
    f"""
SELECT site_id, part_no, array_to_string(list_distinct(list(section)), ',') AS names, string_agg(url, ' ' ORDER BY pos) AS urls
FROM (SELECT *, 1 + (pos - 1) // {L.LINES_PER_PART} AS part_no FROM inventory WHERE section = 'Optional') GROUP BY ALL
UNION ALL
SELECT site_id, 0, string_agg(section, ',' ORDER BY section_rank) FILTER (pos = 1), string_agg(url, ' ' ORDER BY section_rank, pos)
FROM inventory WHERE section <> 'Optional' GROUP BY site_id""",
    "inventory",
)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return generate_documents(pages(spark, sf))


QUERIES["documents"] = documents
ORACLE["documents"] = oracle(
    f"""
SELECT site_id, (line_no - 1) // {L.LINES_PER_PART} AS part_no, count(*) AS lines,
  string_agg(line, chr(10) ORDER BY line_no) AS content, CAST(0 AS BIGINT) AS errors
FROM lines GROUP BY ALL""",
    "lines",
)


def document_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The documents written in two runs, the first of them twice, and read back."""
    parts = materialize(generate_documents(pages(spark, sf)))
    path = work_dir(spark, "documents")
    first = F.pmod(F.xxhash64("site_id"), F.lit(2)) == 0
    for run, rows in (("r1", parts.where(first)), ("r1", parts.where(first)), ("r2", parts.where(~first))):
        write_documents(rows, path, run)
    return document_table(spark, path, parts.schema).read()


QUERIES["document_sink"] = document_sink
ORACLE["document_sink"] = ORACLE["documents"]


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = generate_documents(pages(spark, sf))
    return document.parse_lines(document.split_documents(docs, ["site_id"])).drop("line")


QUERIES["doc_tokens"] = doc_tokens
LINK = r"^\s*-\s\[([^\]]+)\]\(([^)]+)\)(:?)(.*)$"
ORACLE["doc_tokens"] = oracle(
    f"""
SELECT site_id, line_no, kind, CASE WHEN kind = 'link' THEN regexp_extract(line, {lit(LINK)}, 1) END AS label,
  CASE WHEN kind = 'link' THEN regexp_extract(line, {lit(LINK)}, 2) END AS url,
  CASE WHEN kind = 'link' THEN trim(regexp_extract(line, {lit(LINK)}, 4)) END AS description
FROM (SELECT *, CASE WHEN line LIKE '# %' THEN 'h1' WHEN line LIKE '## %' THEN 'h2' WHEN line LIKE '>%' THEN 'quote'
    WHEN regexp_matches(line, {lit(LINK)}) THEN 'link' WHEN line LIKE '- %' THEN 'bullet' ELSE 'text' END AS kind FROM lines)""",
    "lines",
)


def candidate_lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.sql(CANDIDATES.replace("{nl}", "\n"), documents=views.table(spark, sf, "documents"))
    return document.split_documents(docs, ["doc_id", "origin"])


def document_errors(spark: SparkSession, sf: str) -> DataFrame:
    return document.validate_lines(candidate_lines(spark, sf), ("doc_id",))


QUERIES["document_errors"] = document_errors
define("candidates", (), CANDIDATES.replace("{nl}", "\n").format(documents="documents"))
define(
    "candidate_lines",
    ("candidates",),
    "SELECT doc_id, origin, unnest(ls) AS line, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS line_no "
    "FROM (SELECT doc_id, origin, string_split(content, chr(10)) AS ls FROM candidates)",
)
DOCUMENT_ERRORS = rf"""
SELECT doc_id, line_no, broken.rule AS rule, broken.detail AS detail FROM (
  SELECT doc_id, line_no, unnest([
    CASE WHEN line LIKE '# %' AND h1_before > 0 THEN {{rule: 'title_repeated', detail: NULL::VARCHAR}} END,
    CASE WHEN line LIKE '# %' AND line_no > 1 THEN {{rule: 'title_not_first', detail: NULL}} END,
    CASE WHEN line LIKE '## %' AND opt_before > 0 THEN {{rule: 'section_after_optional', detail: {strip('substr(line, 4)')}}} END,
    CASE WHEN line LIKE '## %' AND {strip('substr(line, 4)')} = 'Optional' AND opt_before > 0 THEN {{rule: 'optional_repeated', detail: NULL}} END,
    CASE WHEN line LIKE '> %' AND h1_before = 0 THEN {{rule: 'summary_before_title', detail: NULL}} END,
    CASE WHEN regexp_matches(line, '^#{{3,}}\s') THEN {{rule: 'heading_too_deep', detail: NULL}} END,
    CASE WHEN line LIKE '- %' THEN
      CASE WHEN NOT regexp_matches(line, {lit(L.LINK_LINE)}) THEN {{rule: 'link_malformed', detail: NULL}}
           WHEN regexp_extract(line, '\((https?://[^/)]+)', 1) <> origin
             THEN {{rule: 'link_foreign', detail: regexp_extract(line, '\((https?://[^)]+)\)', 1)}} END END]) AS broken
  FROM (SELECT *,
      coalesce(sum(CASE WHEN line LIKE '# %' THEN 1 ELSE 0 END) OVER w, 0) AS h1_before,
      coalesce(sum(CASE WHEN line LIKE '## %' AND {strip('substr(line, 4)')} = 'Optional' THEN 1 ELSE 0 END) OVER w, 0) AS opt_before
    FROM candidate_lines
    WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
) WHERE broken IS NOT NULL
UNION ALL
SELECT doc_id, 0, 'title_missing', NULL FROM candidate_lines GROUP BY doc_id HAVING count(*) FILTER (line LIKE '# %') = 0
UNION ALL
SELECT doc_id, 0, 'summary_missing', NULL FROM candidate_lines GROUP BY doc_id HAVING count(*) FILTER (line LIKE '> %') = 0"""
ORACLE["document_errors"] = oracle(DOCUMENT_ERRORS, "candidate_lines")


def planned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Inventory, heads, plan and plan heads."""
    rows, heads = built(spark, sf)
    rows = materialize(rows)
    return rows, heads, spark.sql(PLAN, inventory=rows), spark.sql(PLAN_HEADS, heads=heads)


define("plan_rows", ("inventory",), PLAN.format(inventory="inventory"))
define("plan_heads", ("heads",), PLAN_HEADS.format(heads="heads"))
define(
    "accepted",
    ("plan_heads",),
    f"SELECT site_id, {truncate('summary', L.PLAN_SUMMARY_CHARS)} AS summary FROM plan_heads WHERE trim(summary) <> ''",
)
define(
    "plan_placed",
    ("inventory", "plan_rows"),
    f"""
SELECT i.*, p.optional, p.section_pos, p.name, p.page_pos, p.new_description
FROM inventory i LEFT JOIN (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, url ORDER BY optional, section_pos, page_pos) AS first FROM (
      SELECT site_id, url, optional, section_pos, page_pos, {truncate('section_name', L.PLAN_SECTION_CHARS)} AS name,
        {truncate('description', L.PLAN_DESCRIPTION_CHARS)} AS new_description FROM plan_rows)
    WHERE name IS NOT NULL) WHERE first = 1) p USING (site_id, url)""",
)
define(
    "plan_votes",
    ("plan_placed",),
    """
SELECT site_id, section, section_pos AS to_rank, name AS to_section, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, section ORDER BY votes DESC, first_pos) AS rn FROM (
    SELECT site_id, section, section_pos, name, count(*) AS votes, min(pos) AS first_pos FROM plan_placed
    WHERE NOT optional AND section <> 'Optional' GROUP BY ALL)) WHERE rn = 1""",
)
define(
    "refined",
    ("plan_placed", "plan_votes", "accepted"),
    f"""
SELECT site_id, section, section_rank,
  row_number() OVER (PARTITION BY site_id, section_rank ORDER BY block, o1, o2) AS pos,
  url, title, description, h1, section_hint
FROM (
  SELECT site_id, CASE WHEN optional THEN 'Optional' ELSE name END AS section,
    CAST(CASE WHEN optional THEN {plans.OPTIONAL_RANK} ELSE section_pos END AS BIGINT) AS section_rank,
    0 AS block, 0 AS o1, page_pos AS o2, url, title, coalesce(new_description, description) AS description, h1, section_hint
  FROM plan_placed WHERE section_pos IS NOT NULL
  UNION ALL
  SELECT site_id, section, {plans.OPTIONAL_RANK}, 1, 0, pos, url, title, description, h1, section_hint
  FROM plan_placed WHERE section_pos IS NULL AND section = 'Optional'
  UNION ALL
  SELECT p.site_id, coalesce(v.to_section, p.section), coalesce(v.to_rank, p.section_rank + {plans.RECREATED_RANK}),
    1, p.section_rank, pos, url, title, description, h1, section_hint
  FROM plan_placed p LEFT JOIN plan_votes v USING (site_id, section)
  WHERE section_pos IS NULL AND p.section <> 'Optional'
) WHERE site_id IN (SELECT site_id FROM accepted)""",
)


def plan_apply(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, plan, heads = planned(spark, sf)
    return plans.apply_plan(rows, plan, heads)


QUERIES["plan_apply"] = plan_apply
ORACLE["plan_apply"] = oracle("SELECT * FROM refined", "refined")


def plan_votes(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, plan, _ = planned(spark, sf)
    return plans.section_votes(plans.placed_pages(rows, plan))


QUERIES["plan_votes"] = plan_votes
ORACLE["plan_votes"] = oracle("SELECT * FROM plan_votes", "plan_votes")


def plan_strays(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, plan, _ = planned(spark, sf)
    back = plans.omitted_pages(plans.placed_pages(rows, plan))
    return back.select("site_id", "url", "section", "out_section")


QUERIES["plan_strays"] = plan_strays
ORACLE["plan_strays"] = oracle(
    """
SELECT p.site_id, url, p.section, CASE WHEN p.section = 'Optional' THEN 'Optional' ELSE coalesce(to_section, p.section) END AS out_section
FROM plan_placed p LEFT JOIN plan_votes v USING (site_id, section) WHERE section_pos IS NULL""",
    "plan_placed",
    "plan_votes",
)


def documents_chosen(spark: SparkSession, sf: str) -> DataFrame:
    rows, heads, plan, plan_heads = planned(spark, sf)
    heuristic = document.document_lines(rows, heads)
    summaries = plans.accepted_plans(plan_heads)
    refined_heads = heads.drop("summary").join(summaries, "site_id")
    refined = materialize(
        document.document_lines(plans.apply_plan(rows, plan, plan_heads), refined_heads)
    )
    chosen = document.choose_documents(heuristic, refined, document.validate_lines(refined))
    return document.assemble(chosen, ("site_id", "generated_by"))


QUERIES["documents_chosen"] = documents_chosen
define(
    "refined_heads",
    ("heads", "accepted"),
    "SELECT heads.* EXCLUDE (summary), accepted.summary FROM heads JOIN accepted USING (site_id)",
)
define("refined_lines", ("refined", "refined_heads"), lines_sql("refined", "refined_heads"))
ORACLE["documents_chosen"] = oracle(
    f"""
SELECT site_id, generated_by, (line_no - 1) // {L.LINES_PER_PART} AS part_no, count(*) AS lines,
  string_agg(line, chr(10) ORDER BY line_no) AS content
FROM (
  SELECT *, 'heuristic' AS generated_by FROM lines WHERE site_id <> 'example.com'
  UNION ALL
  SELECT *, 'llm-refined' FROM refined_lines WHERE site_id = 'example.com'
) GROUP BY ALL""",
    "lines",
    "refined_lines",
)


def prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    return plans.prompt_rows(built(spark, sf)[0])


QUERIES["prompt_rows"] = prompt_rows
define(
    "prompts",
    ("inventory",),
    f"""
SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY section_rank, section, pos) AS ord, section, url,
  nullif({collapse('title')}, '') AS title, nullif({collapse('description')}, '') AS description,
  nullif({collapse('h1')}, '') AS h1 FROM inventory""",
)
ORACLE["prompt_rows"] = oracle("SELECT * FROM prompts", "prompts")


def prompt_payload(spark: SparkSession, sf: str) -> DataFrame:
    return plans.prompt_payloads(*built(spark, sf))


QUERIES["prompt_payload"] = prompt_payload
define(
    "prompt_parts",
    ("prompts",),
    f"""
SELECT *, CAST(floor(coalesce(sum(strlen(CAST(to_json(page) AS VARCHAR)) + 1) OVER (
    PARTITION BY site_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {L.PLAN_PART_BYTES}) AS BIGINT) + 1 AS part
FROM (SELECT site_id, ord, {{'section': section, 'url': url, 'title': title, 'description': description, 'h1': h1}} AS page FROM prompts)""",
)
ORACLE["prompt_payload"] = oracle(
    f"""
SELECT site_id, part, to_json({{'site_name': any_value(site_name), 'origin': any_value(origin),
  'homepage_snippet': any_value(nullif({collapse('homepage_snippet')}, '')), 'pages': list(page ORDER BY ord)}}) AS payload
FROM prompt_parts JOIN heads USING (site_id) GROUP BY site_id, part""",
    "prompt_parts",
    "heads",
)


def crawled_path_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a site by depth and URL, each with its place in that order."""
    rows = views.page_rows(spark, sf).select("site_id", "url", urls.path_depth(F.col("url")).alias("depth"))
    return positions(materialize(rows), ["site_id"], ["depth", "url"], "place").orderBy("depth", "url")


QUERIES["pages_by_depth"] = crawled_path_depth
ORACLE["pages_by_depth"] = oracle(
    "SELECT site_id, url, depth, row_number() OVER (PARTITION BY site_id ORDER BY depth, url) AS place FROM classified", "classified"
)


def documents_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Lines, links and rule violations of every rendered document."""
    rows, heads = built(spark, sf)
    lines = materialize(document.document_lines(rows, heads))
    errors = document.validate_lines(lines).groupBy("site_id").agg(F.count(F.lit(1)).alias("errors"))
    sizes = lines.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").startswith("- [")).alias("links")
    )
    return sizes.join(errors, "site_id", "left").fillna(0, ["errors"])


QUERIES["documents_valid"] = documents_valid
ORACLE["documents_valid"] = oracle(
    """SELECT site_id, count(*) AS lines, count(*) FILTER (line LIKE '- [%') AS links, CAST(0 AS BIGINT) AS errors FROM lines GROUP BY ALL""",
    "lines",
)


def line_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a link line for every stored page."""
    rows = inv.classify_pages(pages(spark, sf))
    label = text.link_label(text.blank_to_null(F.col("title")), text.blank_to_null(F.col("h1")), F.col("url"))
    rows = rows.withColumn("label", label)
    return rows.select(
        "site_id",
        "url",
        "rich",
        "is_home",
        text.strip_title_suffix(text.blank_to_null(F.col("title"))).alias("short_title"),
        "label",
        text.link_target(F.col("url")).alias("target"),
        text.link_description(F.col("description"), F.col("section"), F.col("label")).alias("line_text"),
        text.truncate(F.col("snippet"), 60).alias("cut"),
    )


QUERIES["line_parts"] = line_parts
ORACLE["line_parts"] = oracle(
    f"""
SELECT site_id, url, CAST(rich AS BIGINT) AS rich, is_home, {strip("CASE WHEN instr(t, ' | ') > 1 THEN split_part(t, ' | ', 1) WHEN instr(t, ' — ') > 1 THEN split_part(t, ' — ', 1) WHEN instr(t, ' – ') > 1 THEN split_part(t, ' – ', 1) WHEN instr(t, ' - ') > 1 THEN split_part(t, ' - ', 1) ELSE t END")} AS short_title,
  label, replace(replace(url, ')', '%29'), '(', '%28') AS target,
  coalesce(nullif({collapse('description')}, ''), label || ' (' || section || ').') AS line_text, {truncate('snippet', 60)} AS cut
FROM (SELECT *, nullif({strip('title')}, '') AS t,
  coalesce(nullif(translate({collapse("coalesce(nullif(" + strip('title') + ", ''), nullif(" + strip('h1') + ", ''), url)")}, '[]', '()'), ''), url) AS label FROM classified)""",
    "classified",
)
