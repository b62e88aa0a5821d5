import random

import pytest
from pyspark.sql import functions as F

from webcairn import limits as L
from webcairn.functions import freshness
from webcairn.operators import cadence, monitor, upsert
from webcairn.streaming.cadence import _step


def test_conditional_outcomes(spark):
    cases = [
        (304, None, None, "a", None, "unchanged"), (404, None, None, "a", None, "removed"), (410, None, None, None, None, "removed"),
        (500, None, None, "a", None, "error"), (301, None, None, None, None, "error"), (200, "a", None, "a", None, "unchanged"),
        (200, "b", None, "a", None, "modified"), (200, None, "d", None, "d", "unchanged"), (200, "x", "d", "a", "d", "modified"),
        (200, None, None, None, None, "modified"), (200, None, "d", "", "d", "unchanged"),
    ]
    df = spark.createDataFrame(cases, "s int, e string, m string, se string, sm string, want string")
    got = df.select("want", freshness.conditional_outcome(*[F.col(c) for c in ("s", "e", "m", "se", "sm")]).alias("got"))
    assert [(r["got"], r["want"]) for r in got.collect() if r["got"] != r["want"]] == []


@pytest.mark.parametrize(
    ("interval", "changed", "streak", "want", "after"),
    [
        (86400, True, 0, 43200, 1), (86400, True, 3, 28800, 4), (3600, True, 9, 3600, 10), (86400, False, 0, 129600, -1),
        (86400, False, -3, 172800, -4), (604800, False, -9, 604800, -10), (7201, True, -2, 3600, 1), (5001, False, 2, 7501, -1),
    ],
)
def test_steps(spark, interval, changed, streak, want, after):
    df = spark.createDataFrame([(interval, changed, streak)], "i bigint, c boolean, s bigint")
    cols = (F.col("i"), F.col("c"), F.col("s"))
    got = df.select(freshness.next_site_interval(*cols), freshness.next_streak(F.col("s"), F.col("c"))).first()
    assert tuple(got) == (want, after)
    assert _step(interval, streak, changed, L.SITE_FLOOR_S, L.SITE_CEILING_S) == (want, after)


def histories():
    """Random keys, one hot key, and keys whose changes never saturate the interval."""
    rnd = random.Random(5)
    made = {f"k{i}": [rnd.random() < 0.4 for _ in range(rnd.randint(1, 30))] for i in range(12)}
    made["hot"] = [rnd.random() < 0.5 for _ in range(60)]
    made["flat"] = [i % 5 < 2 for i in range(25)]
    made["up"] = [False] * 25
    return made


@pytest.mark.parametrize("chunk", [8, 20, 4096])
def test_fold_equals_brute_force(spark, chunk):
    made = histories()
    data = [(k, i, i, c) for k, v in made.items() for i, c in enumerate(v)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "site_id string, checked_at bigint, event_id bigint, changed boolean")
    got = {r["site_id"]: r for r in cadence.fold_cadence(df, "site_id", ["checked_at", "event_id"], chunk=chunk).collect()}
    streaks = {
        (r["site_id"], r["event_id"]): r["streak"]
        for r in cadence.check_streaks(df, "site_id", ["checked_at", "event_id"], chunk).collect()
    }
    for key, flags in made.items():
        interval, streak = L.SITE_DEFAULT_INTERVAL_S, 0
        for i, changed in enumerate(flags):
            interval, streak = _step(interval, streak, changed, L.SITE_FLOOR_S, L.SITE_CEILING_S)
            assert streaks[key, i] == streak
        row = got[key]
        assert (row["interval_s"], row["streak"], row["checks"]) == (interval, streak, len(flags))
        assert row["last_changed_at"] == max((i for i, c in enumerate(flags) if c), default=None)


def balanced(n):
    """Checks whose steps keep the interval away from both bounds."""
    size, out = 1.0, []
    for _ in range(n):
        out.append(size >= 1)
        size *= 0.5 if out[-1] else 1.5
    return out


def test_chunks_that_never_saturate_take_log_rounds(spark, monkeypatch):
    made = {"even": balanced(400), "short": balanced(21), "late": [False] * 100 + balanced(150), **histories()}
    data = [(k, i, i, c) for k, v in made.items() for i, c in enumerate(v)]
    df = spark.createDataFrame(data, "site_id string, checked_at bigint, event_id bigint, changed boolean")
    written = []
    write = cadence.materialize
    monkeypatch.setattr(cadence, "materialize", lambda d: written.append(d.columns) or write(d))
    rows = cadence.fold_cadence(df, "site_id", ["checked_at", "event_id"], chunk=8).collect()
    got = {r["site_id"]: (r["interval_s"], r["streak"], r["checks"]) for r in rows}
    for key, flags in made.items():
        interval, streak = L.SITE_DEFAULT_INTERVAL_S, 0
        for changed in flags:
            interval, streak = _step(interval, streak, changed, L.SITE_FLOOR_S, L.SITE_CEILING_S)
        assert got[key] == (interval, streak, len(flags))
    # 50 chunks of the longest key: the chunks, their break points, and at most six rounds
    assert 2 < len(written) <= 2 + 6


def test_break_points_are_the_steps(spark):
    flags = balanced(12)
    df = spark.createDataFrame([(1, 0, [(c, 0) for c in flags])], "k int, at bigint, steps array<struct<changed boolean, before bigint>>")
    row = cadence.break_points(df, "k", 10, 900, 20, 800).first()
    for i in range(10, 901):
        want = i
        for c in flags:
            want = _step(want, 0, c, 20, 800)[0]
        assert row.outs[sum(s <= i for s in row.starts) - 1] == want


def test_priors(spark):
    df = spark.createDataFrame(
        [(9, True, False, True), (9, False, True, False), (9, False, False, True), (15, False, False, False), (16, False, False, False)],
        "pages int, news boolean, feed boolean, dated boolean",
    )
    got = [r[0] for r in df.select(freshness.first_interval(*[F.col(c) for c in df.columns])).collect()]
    assert got == [6 * 3600, 6 * 3600, 12 * 3600, 72 * 3600, 24 * 3600]


def test_change_set(spark):
    stored = spark.createDataFrame(
        [("s", u, lm, e, None, h) for u, lm, e, h in [("a", "1", "e", "h"), ("b", "1", None, "h"), ("c", None, None, None), ("d", "1", "e", "h"), ("x", "1", "e", "h")]],
        "site_id string, url string, sitemap_lastmod string, etag string, last_modified string, content_hash string",
    )
    current = spark.createDataFrame([("s", u, lm) for u, lm in [("a", "2"), ("b", "1"), ("c", "9"), ("d", ""), ("n", None)]], "site_id string, url string, lastmod string")
    diff = monitor.diff_sitemap(stored, current)
    assert {r["url"]: r["change"] for r in diff.collect()} == {
        "a": "lastmod_changed", "b": "kept", "c": "kept", "d": "kept", "n": "added", "x": "removed"}
    responses = spark.createDataFrame(
        [("s", "a", 200, "e2", None, "h"), ("s", "b", 200, None, None, "h2"), ("s", "c", 200, None, None, "h"), ("s", "d", 410, None, None, None), ("s", "x", 500, None, None, None)],
        "site_id string, url string, status int, etag string, last_modified string, current_hash string",
    )
    checks = monitor.resolve_checks(stored, responses)
    assert {r["url"]: (r["resolved"], r["changed"]) for r in checks.collect()} == {
        "a": ("unchanged", False), "b": ("unchanged", True), "c": ("unchanged", False), "d": ("removed", False), "x": ("error", False)}
    changes = monitor.build_changes(diff, checks)
    assert {r["url"]: r["bucket"] for r in changes.collect()} == {"n": "added", "x": "removed", "d": "removed", "b": "modified"}
    sites = spark.createDataFrame([("s",), ("quiet",)], "site_id string")
    got = {r["site_id"]: (r["change_summary"], r["regenerate"]) for r in monitor.summarize_changes(changes, sites).collect()}
    assert got == {"s": ("1 page added, 2 pages removed, 1 page modified", True), "quiet": ("no changes", False)}


def test_candidates(spark):
    now = 10 * L.DAY
    pages = spark.createDataFrame(
        [("s", "https://e.com/" + u, at, i) for u, at, i in [("new", None, 9), ("old/deep", 5, 10), ("old", 5, 10), ("fresh", now - 5, 10), ("gone", 1, 1), ("dated", 2, 1)]],
        "site_id string, url string, last_checked_at bigint, page_check_interval_s bigint",
    )
    diff = spark.createDataFrame([("s", "https://e.com/gone", "removed"), ("s", "https://e.com/dated", "lastmod_changed")], "site_id string, url string, change string")
    got = [r["url"][14:] for r in monitor.monitor_candidates(pages, diff, now).orderBy("rank").collect()]
    assert got == ["dated", "new", "old", "old/deep"]
    assert monitor.monitor_candidates(pages, diff, now, limit=2).count() == 2


def test_upsert_is_idempotent_on_unchanged_rows(spark):
    schema = (
        "site_id string, url string, title string, description string, h1 string, snippet string, section_hint string, "
        "content_hash string, etag string, last_modified string, out_links array<string>, status string, last_seen_at bigint, "
        "last_checked_at bigint, last_changed_at bigint, page_check_interval_s bigint, page_change_streak bigint"
    )
    stored = spark.createDataFrame([("s", "https://e.com/docs", "T", None, None, None, None, "h", None, None, None, "active", 1, 1, None, 604800, 0)], schema)
    body = "site_id string, url string, ingest string, title string, description string, h1 string, snippet string, content_hash string, etag string, last_modified string, out_links array<string>"
    fetched = spark.createDataFrame(
        [("s", "https://e.com/docs", "html", "T2", None, None, None, "h2", "e", None, ["/a"]), ("s", "https://e.com/n", "html", "N", None, None, None, "n", None, None, []),
         ("s", "https://e.com/bad", "error", None, None, None, None, None, None, None, None), ("s", "https://e.com/same", "unchanged", None, None, None, None, None, None, None, None)],
        body,
    )
    got = {r["url"]: r for r in upsert.upsert_pages(stored, fetched, 100).collect()}
    assert set(got) == {"https://e.com/docs", "https://e.com/n", "https://e.com/bad"}
    docs = got["https://e.com/docs"]
    assert (docs["title"], docs["section_hint"], docs["last_changed_at"], docs["page_check_interval_s"], docs["page_change_streak"]) == ("T2", "Documentation", 100, 302400, 1)
    assert got["https://e.com/n"]["page_check_interval_s"] == 302400 and got["https://e.com/n"]["page_change_streak"] == 1
    assert (got["https://e.com/bad"]["status"], got["https://e.com/bad"]["page_check_interval_s"]) == ("error", 604800)


def test_versions_append_once(spark):
    have = spark.createDataFrame([("s", "r1", 4)], "site_id string, run_id string, version bigint")
    new = spark.createDataFrame([("s", "r1"), ("s", "r2"), ("s", "r3"), ("t", "r9")], "site_id string, run_id string")
    got = sorted((r["site_id"], r["run_id"], r["version"]) for r in upsert.append_versions(new, have).collect())
    assert got == [("s", "r2", 5), ("s", "r3", 6), ("t", "r9", 1)]
