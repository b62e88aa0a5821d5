import hashlib

from webcairn.operators import extract, quality

LONG = "word " * 20


def page(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    return extract.extract_pages(df).first()


def test_metadata(spark):
    r = page(
        spark,
        f"""<head><title>\n A   B </title><META Name='Description' content="d1"><meta name=description content=d2>
        <meta property="og:title" content="og"></head><h1><b>Hi</b> there</h1><p>short</p><p><i>{LONG}</i></p>
        <script>'<p>{LONG} no</p><a href="/no">'</script><a href="/x">x</a><a class=q href='/y'>y</a><a href=/z>z</a><a href="">e</a>""",
    )
    assert (r["title"], r["description"], r["h1"]) == ("A B", "d1", "Hi")
    assert r["snippet"] == LONG.strip()
    assert r["links"] == ["/x", "/y", "/z"]
    text = "\n".join(["A B", "d1", "Hi", LONG.strip()])
    assert r["content_hash"] == hashlib.sha256(text.encode()).hexdigest()


def test_fallbacks_and_cuts(spark):
    r = page(
        spark,
        '<title> </title><meta property="OG:Title" content="og"><meta name="description" content=""><meta property="og:description" content="od">'
        f"<h1> <b>x</b></h1><p>open <p>{'y' * 500}</p>",
    )
    assert (r["title"], r["description"], r["h1"]) == ("og", "od", None)
    assert r["snippet"] == "y" * 400
    empty = page(spark, "<html></html>")
    assert (empty["title"], empty["description"], empty["h1"], empty["snippet"], empty["links"]) == (None, None, None, None, [])


def test_links_are_whole_unless_limited(spark):
    html = "".join(f'<a href="/{i}">' for i in range(305))
    assert page(spark, html)["links"] == [f"/{i}" for i in range(305)]
    cut = spark.createDataFrame([(html,)], "html string").select(extract.markup.hrefs(extract.F.col("html"), 300).alias("links"))
    assert cut.first()["links"] == [f"/{i}" for i in range(300)]


def test_ingest(spark):
    rows = [(200, "Text/HTML", "x"), (200, "application/pdf", "x"), (304, None, None), (500, "text/html", "x"), (200, "text/html", None)]
    df = spark.createDataFrame(rows, "status int, content_type string, html string")
    assert [r["ingest"] for r in extract.ingest_pages(df).collect()] == ["html", "error", "unchanged", "error", "error"]


def test_quality(spark):
    rows = [
        ("https://e.com/a", "App", None, " home ", None, ["/x", "/x#1", "https://o.com/y", "/i.png"]),
        ("https://e.com/b", "T", "d", "H", None, ["/1", "/2", "3"]),
        ("https://e.com/c", "T", None, "H", "s" * 80, ["/1", "/2", "/2/"]),
    ]
    df = spark.createDataFrame(
        rows, "url string, title string, description string, h1 string, snippet string, links array<string>"
    )
    got = [(r["link_count"], r["reasons"], r["needs_render"]) for r in quality.assess_quality(df).collect()]
    assert got == [
        (1, ["thin_content", "generic_heading", "few_static_links"], True),
        (3, [], False),
        (2, ["few_static_links"], True),
    ]
    lone = [r["needs_render"] for r in quality.assess_quality(df, follow_links=False).collect()]
    assert lone == [True, False, False]
