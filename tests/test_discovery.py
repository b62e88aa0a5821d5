from webcairn.operators import frontier, robots, sitemap


def rules(spark, body, **kw):
    df = spark.createDataFrame([("s", body)], "site_id string, body string")
    r = robots.parse_robots(df, **kw).first()
    return r["disallow"], r["crawl_delay_ms"], r["sitemaps"]


def test_robots(spark):
    assert rules(spark, "") == ([], 500.0, [])
    assert rules(spark, "User-agent: *\nDisallow: /a # x\nDisallow:\nCrawl-delay: 2\nSitemap: https://e/s.xml") == (
        ["/a"], 2000.0, ["https://e/s.xml"])
    # our own group wins over the wildcard, groups of one agent merge, the last valid delay counts
    body = "user-agent: WebCairn\nuser-agent: other\nDisallow: /1\n\nuser-agent: *\nDisallow: /2\nUser-Agent: webcairn\nCrawl-delay: 99\nCrawl-delay: x\nDisallow: /3"
    assert rules(spark, body) == (["/1", "/3"], 10000.0, [])
    # a sitemap line does not end a run of agents, an allow line does
    assert rules(spark, "User-agent: a\nSitemap: m\nUser-agent: *\nDisallow: /x")[0] == ["/x"]
    assert rules(spark, "User-agent: *\nAllow: /\nUser-agent: b\nDisallow: /x")[0] == []
    assert rules(spark, "Disallow: /early\r\nUser-agent: *\r\nDisallow: /x\r\nCrawl-delay: 0.1")[:2] == (["/x"], 500.0)


def generated(node):
    """Rows that the generators of a finished plan made."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return generated(node.executedPlan())
    if "QueryStage" in name:
        return generated(node.plan())
    rows = node.metrics().apply("numOutputRows").value() if name == "Generate" else 0
    return rows + sum(generated(node.children().apply(i)) for i in range(node.children().size()))


def test_rules_are_copied_for_frequent_sites_only(spark):
    pages = spark.range(5_020).selectExpr(
        "IF(id < 5000, 's0', IF(id < 5010, concat('s', id - 4999), IF(id < 5015, 'other', NULL))) AS site_id",
        "IF(id % 2 = 0, '/a/', '/b/') || id AS path",
    )
    rules = spark.createDataFrame([(f"s{k}", ["/a"] if k % 2 == 0 else []) for k in range(100)], "site_id string, disallow array<string>")
    left = robots.exclude_disallowed(pages, rules)
    rows = [(r["site_id"], int(r["path"][3:])) for r in left.collect()]
    want = [("s0", k) for k in range(1, 5_000, 2)] + [(f"s{k - 4_999}", k) for k in range(5_000, 5_010) if k % 2 or (k - 4_999) % 2]
    want += [("other", k) for k in range(5_010, 5_015)] + [(None, k) for k in range(5_015, 5_020)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert generated(left._jdf.queryExecution().executedPlan()) == 32 + 10


def parsed(spark, body):
    df = spark.createDataFrame([("s", body)], "site_id string, body string")
    r = sitemap.parse_sitemaps(df).first()
    entries = None if r["entries"] is None else [(e["url"], e["lastmod"]) for e in r["entries"]]
    return r["kind"], entries, r["children"], r["is_news"], r["is_feed"]


def test_sitemap_formats(spark):
    urlset = "<?xml?><urlset><url><loc> https://e/ </loc><lastmod>2026-01-01</lastmod></url><url><loc><![CDATA[https://e/a&amp;b]]></loc></url><url></url></urlset>"
    assert parsed(spark, urlset) == ("urlset", [("https://e/", "2026-01-01"), ("https://e/a&b", None)], None, False, False)
    index = "<sitemapindex><sitemap><loc>https://e/1</loc></sitemap><sitemap><x:loc>https://e/2</x:loc></sitemap></sitemapindex>"
    assert parsed(spark, index)[:3] == ("index", None, ["https://e/1", "https://e/2"])
    rss = "<rss><item><guid>https://e/g</guid><pubDate>d</pubDate></item><item><link>https://e/l</link><guid>n</guid></item></rss>"
    assert parsed(spark, rss) == ("urlset", [("https://e/g", "d"), ("https://e/l", None)], None, False, True)
    atom = """<feed><entry><link rel="self" href="https://e/s"/><link href="https://e/r"/><updated>u</updated></entry>
      <entry><link rel='self' href='https://e/1'/><link rel="Alternate" href="https://e/2"/><link href="https://e/3"/></entry>
      <entry><link rel="self" href="https://e/only"/></entry></feed>"""
    assert parsed(spark, atom)[1] == [("https://e/r", "u"), ("https://e/2", None), ("https://e/only", None)]
    assert parsed(spark, "https://e/1\r\n  HTTP://e/2 \nno")[:2] == ("text", [("https://e/1", None), ("HTTP://e/2", None)])
    assert parsed(spark, '<urlset xmlns:news="x"><url><loc>https://e/</loc></url></urlset>')[3] is True


def docs_of(spark, docs):
    return spark.createDataFrame(
        [("s", url, status, body) for url, (status, body) in docs.items()],
        "site_id string, doc_url string, status int, body string",
    )


def expand(spark, declared, docs, **kw):
    d = spark.createDataFrame([("s", i, u) for i, u in enumerate(declared)], "site_id string, pos int, doc_url string")
    origins = spark.createDataFrame([("s", "https://e")], "site_id string, origin string")
    out = sitemap.expand_sitemaps(d, docs_of(spark, docs), origins, **kw)
    return [r["doc_url"] for r in out.orderBy("fetch_no").collect()], out


def test_expansion_order_budget_and_fallback(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://e/{i}</loc></sitemap>" for i in (1, 2, 1, 3)) + "</sitemapindex>"
    leaf = "<urlset><url><loc>https://e/p{}</loc></url></urlset>"
    docs = {"https://e/i": (200, index), "https://e/1": (404, ""), "https://e/2": (200, leaf.format(2)), "https://e/3": (200, leaf.format(3))}
    read, out = expand(spark, ["https://e/gone", "https://e/i", "https://e/i"], docs)
    assert read == ["https://e/gone", "https://e/i", "https://e/1", "https://e/2", "https://e/3"]
    assert sorted(r["url"] for r in sitemap.collected_entries(out).collect()) == ["https://e/p2", "https://e/p3"]
    met, out = expand(spark, ["https://e/i"], docs, budget=2)
    assert met[:4] == ["https://e/i", "https://e/1", "https://e/2", "https://e/3"]
    assert [r["doc_url"] for r in out.where("read").orderBy("fetch_no").collect()] == ["https://e/i", "https://e/1"]
    assert sitemap.collected_entries(out).count() == 0
    docs["https://e/sitemap.xml"] = (200, leaf.format(9))
    assert expand(spark, ["https://e/1"], docs)[0] == ["https://e/1", "https://e/sitemap.xml", "https://e/sitemap_index.xml"]
    assert expand(spark, ["https://e/1"], docs, fallback=False)[0] == ["https://e/1"]


def test_reading_stops_with_enough_entries(spark):
    def leaf(*pages):
        return 200, "<urlset>" + "".join(f"<url><loc>https://e/p{p}</loc></url>" for p in pages) + "</urlset>"

    def index(*names):
        return 200, "<sitemapindex>" + "".join(f"<sitemap><loc>https://e/{n}</loc></sitemap>" for n in names) + "</sitemapindex>"

    # repeated entries count once, also across rounds; a cycle of indexes ends
    docs = {"https://e/a": leaf(1, 2, 1), "https://e/i": index("b", "i", "c", "j"), "https://e/b": leaf(2, 1),
            "https://e/c": leaf(2, 3), "https://e/j": index("d"), "https://e/d": leaf(4)}
    states = {}
    for limit in (2, 3, None):
        _, out = expand(spark, ["https://e/a", "https://e/i"], docs, raw_limit=limit)
        rows = out.orderBy("fetch_no").collect()
        states[limit] = "".join(r["doc_url"][-1] for r in rows if r["read"]), "".join(r["doc_url"][-1] for r in rows if not r["read"])
        assert [r["fetch_no"] for r in rows] == list(range(1, len(rows) + 1))
        assert all(r["kind"] is None and r["entries"] is None for r in rows if not r["read"])
    assert states == {2: ("a", "i"), 3: ("aibc", "j"), None: ("aibcjd", "")}


def test_alias(spark):
    origins = spark.createDataFrame([(x, "https://e.com") for x in "abc"], "site_id string, origin string")
    rows = [("a", "https://www.e.com/x?q=1#f"), ("a", "junk"), ("b", "https://www.e.com/x"), ("b", "https://e.com/y"), ("c", "https://e.com/z")]
    df = spark.createDataFrame(rows, "site_id string, url string")
    got = sorted((r["site_id"], r["url"]) for r in sitemap.alias_entries(df, origins).collect())
    assert got == sorted([("a", "https://e.com/x?q=1#f"), ("a", "junk"), *rows[2:]])


def test_admission(spark):
    sites = spark.createDataFrame([("s", "https://e.com", ["/private"])], "site_id string, origin string, disallow array<string>")
    hrefs = ["/a", "/b", "/a?utm_x=1", "/private/x", "https://o.com/", "/img.png", "/c", "/d"]
    cand = spark.createDataFrame([("s", h, "https://e.com/", i) for i, h in enumerate(hrefs)], "site_id string, href string, base string, o int")
    ok = frontier.eligible_links(cand, sites)
    seen = spark.createDataFrame([("s", "https://e.com/b")], "site_id string, url string")
    found = spark.createDataFrame([("s", 8)], "site_id string, found bigint")
    got = frontier.admit(ok, seen, found, ["o"], 10)
    assert [(r["url"], r["rank"]) for r in got.orderBy("rank").collect()] == [("https://e.com/a", 9), ("https://e.com/c", 10)]
    assert frontier.capped_flags(cand, got, found, 10).first()["capped"] is True


def test_links_are_made_canonical_once(spark):
    """Filters and the join's condition take the URL as it stands, instead of working it out again."""
    sites = spark.createDataFrame([("s", "https://e.com")], "site_id string, origin string")
    cand = spark.createDataFrame([("s", "/a", "https://e.com/", 1)], "site_id string, href string, base string, o int")
    ok = frontier.eligible_links(cand, sites)
    plan = ok._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
    assert [tuple(r) for r in ok.select("site_id", "url", "o").collect()] == [("s", "https://e.com/a", 1)]


def test_walk(spark):
    sites = spark.createDataFrame([("s", "https://e.com")], "site_id string, origin string")
    seeds = spark.createDataFrame([("s", 0, "/")], "site_id string, pos bigint, href string")
    edges = [("/", "/a"), ("/", "/b"), ("/a", "/c"), ("/b", "/"), ("/c", "/d"), ("/d", "/e")]
    df = spark.createDataFrame(
        [("s", "https://e.com" + f, i, t) for i, (f, t) in enumerate(edges)], "site_id string, url string, pos bigint, href string"
    )
    got = {r["url"][13:]: r["depth"] for r in frontier.walk_links(seeds, df, sites).collect()}
    assert got == {"/": 0, "/a": 1, "/b": 1, "/c": 2, "/d": 3}
    assert frontier.walk_links(seeds, df, sites, max_pages=2).count() == 2
    assert frontier.walk_links(seeds, df, sites, follow_links=False).count() == 1


def test_cached_links(spark):
    from pyspark.sql import functions as F

    rows = ['["/a","/b"]', "[]", "[1]", '["/a",null]', '{"a":1}', "nope", None]
    df = spark.createDataFrame([(x,) for x in rows], "j string")
    got = [r[0] for r in df.select(frontier.cached_links(F.col("j"))).collect()]
    assert got == [["/a", "/b"], [], None, None, None, None, None]
