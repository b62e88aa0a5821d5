import json
import random

from pyspark.sql import functions as F

from webcairn.functions import text
from webcairn.operators import document, inventory, plan
from webcairn.plans.generate import generate_documents

PAGES = "site_id string, origin string, url string, title string, description string, h1 string, snippet string, section_hint string"


def pages(spark, rows, site="s", origin="https://e.com"):
    full = [(site, origin, origin + r[0], *(list(r[1:]) + [None] * (5 - len(r)))) for r in rows]
    return spark.createDataFrame([f[:7] + (None,) for f in full], PAGES)


def test_inventory_and_document(spark):
    rows = [
        ("/", "Acme | Home", None, None, "About Acme."),
        ("/docs/a", "Guide [x]", "D1"),
        ("/docs", None, None, None, None),
        ("/pricing", "P", None, None, "Snip"),
        ("/legal/x(y)", "L"),
        ("/2024/05/p", "Post"),
        ("/zzz", "Other"),
    ]
    out = generate_documents(pages(spark, rows)).collect()
    assert len(out) == 1 and out[0]["errors"] == 0
    assert out[0]["content"].split("\n") == [
        "# Acme", "", "> About Acme.", "",
        "## Documentation", "- [https://e.com/docs](https://e.com/docs): https://e.com/docs (Documentation).",
        "- [Guide (x)](https://e.com/docs/a): D1", "",
        "## Products", "- [P](https://e.com/pricing): Snip", "",
        "## Blog", "- [Post](https://e.com/2024/05/p): Post (Blog).", "",
        "## Core Pages", "- [Other](https://e.com/zzz): Other (Core Pages).", "",
        "## Optional", "- [L](https://e.com/legal/x%28y%29): L (Optional).", "",
    ]


def test_caps_and_overflow(spark):
    rows = [(f"/docs/{i:03d}", f"T{i}") for i in range(37)] + [("/jobs", "J")]
    inv = inventory.build_inventory(pages(spark, rows)).orderBy("section_rank", "pos").collect()
    assert [r["url"][-3:] for r in inv[:10]] == [f"{i:03d}" for i in range(10)]
    rest = [r for r in inv if r["section"] == "Optional"]
    assert [r["pos"] for r in rest] == list(range(1, 29))
    assert rest[0]["url"].endswith("/jobs") and rest[1]["url"].endswith("010")


def test_site_name_falls_back_to_host(spark):
    heads = inventory.site_heads(pages(spark, [("/docs", "T")])).first()
    assert (heads["site_name"], heads["summary"]) == ("e.com", "Key pages and documentation for e.com.")


def test_parts_join_to_the_whole(spark):
    rows = [(f"/legal/{i:04d}", f"T{i}") for i in range(120)]
    df = pages(spark, rows)
    lines = document.document_lines(inventory.build_inventory(df), inventory.site_heads(df))
    whole = document.assemble(lines).collect()
    parts = document.assemble(lines, per_part=50).orderBy("part_no").collect()
    assert len(whole) == 1 and len(parts) == 3
    assert "\n".join(p["content"] for p in parts) == whole[0]["content"]
    back = document.split_documents(document.assemble(lines, per_part=50), ["site_id"], 50).orderBy("line_no").collect()
    assert "\n".join(r["line"] for r in back) == whole[0]["content"]


def errors_of(spark, content, **kw):
    df = spark.createDataFrame([("s", "https://e.com", content)], "site_id string, origin string, content string")
    got = document.validate_lines(document.split_documents(df, ["site_id", "origin"]), **kw)
    return sorted((r["line_no"], r["rule"], r["detail"] or "") for r in got.collect())


def test_validator(spark):
    good = "# T\n\n> s\n\n## Docs\n- [a](https://e.com/x): d\n\n## Optional\n- [b](https://e.com/y): d\n"
    assert errors_of(spark, good) == []
    assert errors_of(spark, "") == [(0, "summary_missing", ""), (0, "title_missing", "")]
    assert errors_of(spark, "> s\n# T\n# U\n### x") == [
        (1, "summary_before_title", ""), (2, "title_not_first", ""), (3, "title_not_first", ""),
        (3, "title_repeated", ""), (4, "heading_too_deep", "")]
    assert errors_of(spark, "# T\n> s\n## Optional\n## A\n## Optional") == [
        (4, "section_after_optional", "A"), (5, "optional_repeated", ""), (5, "section_after_optional", "Optional")]
    evil = "# T\n> s\n- [a](https://e.com.evil.org/x): d\n- [a](https://e.com/x)\n- [a](https://e.com:99999/x): d"
    foreign, bad = (3, "link_foreign", "https://e.com.evil.org/x"), (5, "link_invalid", "https://e.com:99999/x")
    assert errors_of(spark, evil) == [foreign, (4, "link_malformed", ""), bad]
    assert errors_of(spark, evil, prefix_origin=True) == [(4, "link_malformed", ""), bad]


def test_random_pages_render_valid_documents(spark):
    rnd = random.Random(7)
    paths = ["/docs", "/blog", "/legal", "/x", "/pricing", "/2023/01/a", ""]
    texts = [None, "", " a\n b ", "[x] (y)", "é — | z", "plain"]
    rows = list({(rnd.choice(paths) + f"/{rnd.randint(0, 60)}") for _ in range(150)})
    df = pages(spark, [(p, *[rnd.choice(texts) for _ in range(4)]) for p in rows])
    out = generate_documents(df).collect()
    assert sum(r["errors"] for r in out) == 0
    assert sum(r["content"].count("\n- [") for r in out) == len(rows)


def test_plan_guardrails(spark):
    rows = [(f"/docs/{i}", f"D{i}") for i in range(4)] + [("/pricing", "P"), ("/about", "A"), ("/jobs", "J"), ("/press", "R")]
    inv = inventory.build_inventory(pages(spark, rows))
    u = "https://e.com"
    plan_rows = [
        ("s", 0, " Start  here ", 0, u + "/docs/1", " better ", False),
        ("s", 0, " Start  here ", 1, u + "/nope", "x", False),
        ("s", 0, " Start  here ", 2, u + "/docs/0", "  ", False),
        ("s", 1, "  ", 0, u + "/docs/2", None, False),
        ("s", 2, "Again", 0, u + "/docs/1", "second", False),
        ("s", 2, "Again", 1, u + "/about", "z" * 300, False),
        ("s", 0, "", 0, u + "/press", None, True),
    ]
    schema = "site_id string, section_pos int, section_name string, page_pos int, url string, description string, optional boolean"
    p = spark.createDataFrame(plan_rows, schema)
    heads = spark.createDataFrame([("s", " sum ")], "site_id string, summary string")
    got = plan.apply_plan(inv, p, heads).orderBy("section_rank", "pos").collect()
    assert [(r["section"], r["url"][13:], r["description"]) for r in got] == [
        ("Start here", "/docs/1", "better"), ("Start here", "/docs/0", None),
        ("Start here", "/docs/2", None), ("Start here", "/docs/3", None),
        ("Again", "/about", "z" * 199 + "…"), ("Products", "/pricing", None),
        ("Optional", "/press", None), ("Optional", "/jobs", None)]
    blank = spark.createDataFrame([("s", "  ")], "site_id string, summary string")
    assert plan.apply_plan(inv, p, blank).count() == 0
    assert plan.prompt_rows(inv, 5).count() == 5


def test_prompt_parts_hold_every_page(spark):
    rows = [(site, 1, "Docs", i, f"https://e.com/{site}/{i}", "t" * (i % 400), "é" * (i % 50), None)
            for site, n in (("big", 9_000), ("one", 1)) for i in range(n)]
    inv = spark.createDataFrame(rows, "site_id string, section_rank int, section string, pos int, url string, title string, description string, h1 string")
    heads = spark.createDataFrame([(s, s, "https://e.com", " x  y ") for s in ("big", "one", "none")], "site_id string, site_name string, origin string, homepage_snippet string")
    got = plan.prompt_payloads(inv, heads, part_bytes=20_000).orderBy("site_id", "part").collect()
    parts = {s: [json.loads(r["payload"]) for r in got if r["site_id"] == s] for s in ("big", "one", "none")}
    assert [p["url"] for part in parts["big"] for p in part["pages"]] == [r[4] for r in rows if r[0] == "big"]
    assert [r["part"] for r in got if r["site_id"] == "big"] == list(range(1, len(parts["big"]) + 1))
    assert max(len(r["payload"].encode()) for r in got) < 20_000 + 1_500
    assert parts["one"][0]["homepage_snippet"] == "x y" and len(parts["one"]) == 1 and parts["none"] == []
    assert max(len(p["title"] or "") for part in parts["big"] for p in part["pages"]) == 399


def test_text_helpers(spark):
    df = spark.createDataFrame([("a  b", "One - Two — Three", "x" * 12)], "a string, b string, c string")
    r = df.select(
        text.collapse(F.col("a")), text.strip_title_suffix(F.col("b")), text.truncate(F.col("c"), 10), text.truncate(F.col("c"), 12)
    ).first()
    assert tuple(r) == ("a b", "One - Two", "x" * 9 + "…", "x" * 12)
    labels = [1800, 3600, 43200, 86400, 604800, 172800]
    d = spark.createDataFrame([(x,) for x in labels], "s bigint")
    assert [x[0] for x in d.select(text.cadence_label(F.col("s"))).collect()] == [
        "every 30 minutes", "hourly", "every 12 hours", "daily", "weekly", "every 2 days"]
    ages = [0, 59, 60, 3600, 86400, 3 * 86400]
    d = spark.createDataFrame([(x,) for x in ages], "s bigint")
    assert [x[0] for x in d.select(text.age_label(F.lit(0) - F.col("s"), F.lit(0))).collect()] == [
        "just now", "just now", "1m ago", "1h ago", "yesterday", "3d ago"]
