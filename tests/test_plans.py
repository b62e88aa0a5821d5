from pyspark.sql.types import StructType

from webcairn import discover, generate_documents, monitor_tick, pages_from_snapshots, publish_generation, start_generation
from webcairn.operators.extract import poison_rows
from webcairn.operators.reports import run_progress
from webcairn.sources import sinks, tables
from webcairn.sources.versioned import VersionedTable
from webcairn.streaming import pages
from webcairn.streaming.runner import work_dir


def test_discover(spark):
    sites = spark.createDataFrame([("a", "https://a.com"), ("b", "https://b.com")], "site_id string, origin string")
    urls = "".join(f"<url><loc>https://www.a.com/{p}</loc></url>" for p in ("x/y", "p", "private/q", "login"))
    docs = spark.createDataFrame(
        [
            ("a", "https://a.com/robots.txt", "robots", 200, "User-agent: *\nDisallow: /private\nSitemap: https://a.com/s.xml"),
            ("a", "https://a.com/s.xml", "sitemap", 200, f"<urlset>{urls}</urlset>"),
            ("b", "https://b.com/robots.txt", "robots", 404, None),
            ("b", "https://b.com/sitemap.xml", "sitemap", 200, "<urlset></urlset>"),
        ],
        "site_id string, doc_url string, kind string, status int, body string",
    )
    out = discover(docs, sites)
    assert {r["site_id"]: r["method"] for r in out["method"].collect()} == {"a": "sitemap", "b": "links"}
    seeds = sorted((r["url"], r["rank"]) for r in out["seeds"].collect())
    assert seeds == [("https://a.com/p", 1), ("https://a.com/x/y", 2), ("https://b.com/", 1)]
    found = {r["site_id"]: r["found"] for r in out["summary"].collect()}
    assert found == {"a": ["https://a.com/s.xml"], "b": ["https://b.com/sitemap.xml"]}


def test_discover_reads_the_newest_run(spark):
    sites = spark.createDataFrame([("a", "https://a.com")], "site_id string, origin string")
    rows = [("a", run, "https://a.com/robots.txt", "robots", 200, f"User-agent: *\nDisallow: /{run}", None, None) for run in ("r1", "r2")]
    out = discover(spark.createDataFrame(rows, tables.SCHEMAS["site_docs"]), sites)
    assert [r["disallow"] for r in out["rules"].collect()] == [["/r2"]]


def test_newest_by_time_then_run(spark):
    rows = [
        ("a", run, "https://a.com/robots.txt", "robots", 200, f"User-agent: *\nDisallow: /{run}-{t}", None, t)
        for run, t in (("ff", 10), ("0a", 30), ("b1", 30), ("zz", None), (None, 20))
    ]
    sites = spark.createDataFrame([("a", "https://a.com")], "site_id string, origin string")
    out = discover(spark.createDataFrame(rows, tables.SCHEMAS["site_docs"]), sites)
    assert [r["disallow"] for r in out["rules"].collect()] == [["/b1-30"]]


def test_documents_of_declared_pages(spark):
    sites = spark.createDataFrame([("s", "https://e.com")], "site_id string, origin string")
    pages = spark.createDataFrame([{"site_id": "s", "url": "https://e.com/docs/a", "title": "A", "status": "active"}], tables.SCHEMAS["pages"])
    assert "[A](https://e.com/docs/a)" in generate_documents(pages, sites).first()["content"]


def test_progress_of_declared_events(spark):
    import datetime as dt

    rows = [("s", "r", dt.datetime(2024, 1, 1, 0, 0, i), u, e, 0) for i, (u, e) in enumerate((("/a", "seed"), ("/a", "complete"), ("/b", "link")))]
    row = run_progress(spark.createDataFrame(rows, tables.SCHEMAS["crawl_events"])).first()
    assert (row["found"], row["crawled"], row["in_flight"]) == (2, 1, 1)


def test_monitor_tick(spark):
    sites = spark.createDataFrame(
        [("s", "https://e.com", True, 86400, 10, 0), ("later", "https://l.com", True, 86400, 999, 0), ("off", "https://o.com", False, 86400, 10, 0)],
        "site_id string, origin string, monitoring boolean, check_interval_s bigint, next_check_at bigint, change_streak bigint",
    )
    pages = spark.createDataFrame(
        [("s", "https://e.com/a", "1", None, None, "h", "active", None, None, 604800, 0), ("s", "https://e.com/b", "1", None, None, "h", "active", None, None, 604800, 0)],
        "site_id string, url string, sitemap_lastmod string, etag string, last_modified string, content_hash string, status string, "
        "last_checked_at bigint, last_changed_at bigint, page_check_interval_s bigint, page_change_streak bigint",
    )
    entries = spark.createDataFrame([("s", "https://e.com/a/", "1"), ("s", "https://e.com/new", None)], "site_id string, url string, lastmod string")
    responses = spark.createDataFrame(
        [("s", "https://e.com/a", 200, None, None, "h2")], "site_id string, url string, status int, etag string, last_modified string, current_hash string"
    )
    out = monitor_tick(sites, pages, entries, responses, 100)
    assert {r["url"][14:]: r["bucket"] for r in out["changes"].collect()} == {"a": "modified", "b": "removed", "new": "added"}
    assert [tuple(r) for r in out["cadence"].select("site_id", "check_interval_s", "change_streak", "next_check_at").collect()] == [("s", 43200, 1, 43300)]
    (run,) = out["runs"].collect()
    assert (run["site_id"], run["trigger"], run["status"], run["pages_changed"], run["started_at"]) == ("s", "monitor", "queued", 3, 100)
    assert run["change_summary"] == "1 page added, 1 page removed, 1 page modified" and len(run["run_id"]) == 12
    got = {r["url"][14:]: (r["status"], r["last_checked_at"], r["page_check_interval_s"]) for r in out["pages"].collect()}
    assert got == {"a": ("active", 100, 302400), "b": ("removed", None, 604800)}
    # without any entry there is no sitemap to differ from: nothing is removed, due pages are sampled
    out = monitor_tick(sites, pages, entries.limit(0), responses, 100)
    assert {r["url"][14:]: r["bucket"] for r in out["changes"].collect()} == {"a": "modified"}
    assert {r["url"][14:]: r["status"] for r in out["pages"].collect()} == {"a": "active", "b": "active"}


def test_snapshots_to_stored_documents(spark):
    html = "<title>T{0}</title><p>" + "word " * 20 + "{0}</p>"
    rows = [
        ("s", f"run{i // 3}", f"https://E.com/docs/{i % 3}/", 0, i, 200, "text/html", None, None, None, html.format(i), None) for i in range(6)
    ]
    rows += [("s", "run1", url, 0, 9, status, "text/html", None, None, None, "<p>x</p>", None) for url, status in ((None, 200), ("mailto:a", 200), ("https://e.com/docs/0", 500))]
    snaps = spark.createDataFrame(rows, tables.SCHEMAS["page_snapshots"])
    sites = spark.createDataFrame([("s", "https://e.com")], "site_id string, origin string")
    pages = pages_from_snapshots(snaps)
    assert sorted((r["url"], r["title"]) for r in pages.collect()) == [(f"https://e.com/docs/{i}", f"T{i + 3}") for i in range(3)]
    reasons = poison_rows(snaps).where("reason IS NOT NULL").collect()
    assert sorted((r["url"] or "", r["reason"]) for r in reasons) == [("", "bad_url"), ("https://e.com/docs/0", "bad_status"), ("mailto:a", "bad_url")]
    out = work_dir(spark, "sink")
    sinks.write_pages(pages.drop("links"), f"{out}/pages")
    stored = spark.read.parquet(f"{out}/pages")
    parts = generate_documents(stored, sites)
    assert [sinks.write_documents(parts, f"{out}/docs", run, 4) for run in ("r1", "r1")] == [True, False]
    (back,) = sinks.document_table(spark, f"{out}/docs", parts.schema, 4).read().collect()
    assert back["content"].startswith("# e.com") and back["content"].count("\n- [T") == 3
    from pyspark.sql import functions as F

    sinks.export_text(parts.withColumn("version", F.lit(1)), f"{out}/text")
    text = tables.read_documents(spark, f"{out}/text/*/*/*").first()["body"]
    assert text == back["content"] + "\n"


def test_read_tables(spark):
    folder = work_dir(spark, "tables")
    spark.createDataFrame([("s", "https://e.com", 3)], "site_id string, origin string, created_at bigint").write.parquet(folder)
    row = tables.read_table(spark, "sites", folder).first()
    assert (row["origin"], row["monitoring"], row["created_at"]) == ("https://e.com", None, 3)


def test_versioned_table(spark):
    schema = StructType.fromDDL("k string, n int")
    held = VersionedTable(spark, work_dir(spark, "table"), schema, ["k"], 8)
    rows = lambda n, *ks: spark.createDataFrame([(k, n) for k in ks], schema)
    read = lambda: sorted(map(tuple, held.read().collect()))
    assert read() == []
    assert held.merge(rows(1, *"abcdef"), "one") and held.merge(rows(2, "a", "z"), "two")
    want = [("a", 2), *[(k, 1) for k in "bcdef"], ("z", 2)]
    assert read() == want
    assert not held.merge(rows(3, "a"), "one") and read() == want
    # a commit that died before its manifest row leaves a folder that nobody reads
    held._bucketed(rows(9, "a", "q")).write.partitionBy("__bucket").parquet(f"{held.path}/data/lost")
    assert read() == want
    assert held.merge(rows(4), "none") and held.committed("none") and read() == want
    before = {r.folder for r in held.manifest().where("bucket >= 0").collect()}
    held.merge(rows(5, "b"), "three")
    assert held.manifest().where("commit = 'three'").count() == 1  # one bucket is written anew
    assert len({r.folder for r in held.manifest().where("bucket >= 0").collect()} - before) == 1
    assert dict(read())["b"] == 5


def test_pages_move_between_answers(spark):
    schema = "site_id string, url string, seq bigint, status int, etag string, last_modified string, current_hash string"
    answers = [
        ("s", "a", 1, 200, "e1", None, "h1"), ("s", "a", 2, 200, "e1", None, "h1"), ("s", "a", 3, 200, "e2", None, None),
        ("s", "b", 4, 200, "x", None, "n"), ("s", "b", 5, 200, "y", None, "n"), ("s", "a", 6, 410, None, None, None),
        ("s", "a", 7, 200, "e2", None, "h3"), ("s", "c", 8, 404, None, None, None),
    ]
    want = None
    for size in (1, 3, 8):
        store = pages.page_store(spark, work_dir(spark, "store"), 4)
        store.merge(spark.createDataFrame([("s", "a", "e0", None, "h0", "active")], store.schema), "start")
        out = work_dir(spark, "checks")
        update = pages.update_pages(store)(out)
        for n, i in enumerate(range(0, 8, size)):
            for _ in range(2):  # each batch is delivered twice
                update(spark.createDataFrame(answers[i : i + size], schema), n)
        checks = sorted(map(tuple, spark.read.parquet(out).drop("batch").collect()), key=lambda r: r[2])
        got = checks, sorted(map(tuple, store.read().collect()))
        want = want or got
        assert got == want
    assert [(r[2], r[3], r[5]) for r in want[0]] == [
        (1, "modified", True), (2, "unchanged", False), (3, "modified", True), (5, "modified", False), (6, "removed", False), (7, "unchanged", True)]
    assert want[1] == [("s", "a", "e2", None, "h3", "active"), ("s", "b", "y", None, "n", "active")]


def test_published_generation(spark):
    schema = "site_id string, url string, title string, status string, last_seen_at bigint"
    rows = [("a", "https://a.com/", "Home A", "active", 10), ("a", "https://a.com/docs/x", "X", "active", 10), ("a", "https://a.com/docs/y", "Y", "active", 99),
            ("a", "https://a.com/docs/z", "Z", "removed", 99), ("b", "https://other.com/p", "P", "active", 50)]
    declared = spark.createDataFrame([], tables.SCHEMAS["pages"])
    pages = declared.unionByName(spark.createDataFrame(rows, schema), allowMissingColumns=True)
    sites = spark.createDataFrame([("a", "https://a.com"), ("b", "https://b.com"), ("c", "https://c.com")], "site_id string, origin string")
    runs = [("r1", "a", None, None), ("r2", "a", 50, "1 page added"), ("r2", "a", 50, "1 page added"), ("r0", "a", None, None), ("rb", "b", None, None), ("rc", "c", 5, None), ("rx", "x", None, None)]
    runs = spark.createDataFrame(runs, "run_id string, site_id string, started_at bigint, change_summary string")
    versions = spark.createDataFrame([("a", "r0", 4)], "site_id string, run_id string, version bigint")
    started = start_generation(pages, sites, runs, versions)
    assert sorted((r["site_id"], r["url"][-1]) for r in started["inventory"].collect()) == [("r1", "x"), ("r1", "y"), ("r2", "y"), ("rb", "p")]
    out = publish_generation(started, versions, 7)
    got = sorted(tuple(r) for r in out["versions"].collect())
    assert got == [
        ("a", "r1", 5, "a/v5.txt", "initial generation", "heuristic", 7),
        ("a", "r2", 6, "a/v6.txt", "1 page added", "heuristic", 7),
        ("c", "rc", 1, "c/v1.txt", "initial generation", "heuristic", 7),
    ]
    parts = {r["run_id"]: r for r in out["parts"].collect()}
    assert set(parts) == {"r1", "r2", "rc"} and parts["r2"]["version"] == 6
    assert parts["r1"]["content"].startswith("# Home A\n") and "/docs/z" not in parts["r1"]["content"]
    assert parts["rc"]["content"].startswith("# c.com\n\n> Key pages and documentation for c.com.")
    ends = {r["run_id"]: (r["status"], r["error"], r["version"]) for r in out["runs"].collect()}
    assert ends == {
        "r1": ("done", None, 5), "r2": ("done", None, 6), "rc": ("done", None, 1),
        "rb": ("error", "heuristic output failed validation: link_foreign", None), "rx": ("error", "site not found", None)}
    # the same runs once more, now published: nothing happens
    again = start_generation(pages, sites, runs, versions.unionByName(out["versions"].select("site_id", "run_id", "version")))
    assert sorted(r["run_id"] for r in again["runs"].collect()) == ["rb", "rx"]
    assert publish_generation(again, versions, 8)["versions"].count() == 0
    # a refinement is taken where it answers the run and is valid
    plan = spark.createDataFrame([("r1", 0, "Start", 0, "https://a.com/docs/y", "why", False), ("r2", 0, "Optional", 0, "https://a.com/docs/y", None, False),
                                  ("r2", 1, "More", 0, "https://a.com/docs/none", None, False)],
                                 "site_id string, section_pos int, section_name string, page_pos int, url string, description string, optional boolean")
    heads = spark.createDataFrame([("r1", "Refined."), ("rc", " ")], "site_id string, summary string")
    out = publish_generation(started, versions, 7, plan, heads)
    assert {r["run_id"]: r["generated_by"] for r in out["versions"].collect()} == {"r1": "llm-refined", "r2": "heuristic", "rc": "heuristic"}
    assert "> Refined.\n" in {r["run_id"]: r["content"] for r in out["parts"].collect()}["r1"]
    # no runs at all
    none = start_generation(pages, sites, runs.limit(0), versions)
    assert [publish_generation(none, versions, 7)[k].count() for k in ("versions", "parts", "runs")] == [0, 0, 0]
