import pytest
from pyspark.sql import functions as F

from webcairn.functions import urls

BASE = "https://ex.com/a/b?z=1"
CASES = [
    ("HTTPS://Ex.COM:443/a/b/?utm_source=x&b=1 2&c#f", "https://ex.com/a/b?b=1+2&c="),
    ("../x y/é/", "https://ex.com/x%20y/%C3%A9"),
    ("?q=1", "https://ex.com/a/b?q=1"),
    ("?", "https://ex.com/a/b"),
    ("#top", "https://ex.com/a/b?z=1"),
    ("", "https://ex.com/a/b?z=1"),
    ("//Other.com/p", "https://other.com/p"),
    ("mailto:a@b", None),
    ("javascript:void(0)", None),
    ("http://u:p@h.com:8080/%zz?a=%zz&b&=c", "http://u:p@h.com:8080/%zz?a=%25zz&b=&=c"),
    ("./c/./d/../..", "https://ex.com/a"),
    ("/", "https://ex.com/"),
    ("/p//", "https://ex.com/p/"),
    ("http://", None),
    ("http://a b/", None),
    ("p", "https://ex.com/a/p"),
    ("https:p", "https://ex.com/a/p"),
    ("http:p", None),
    ("\\\\other.com\\x", "https://other.com/x"),
    ("https://ex.com/?fbclid=1&REF=2&refer=3&session_x=4&_ga=5&ref_=6", "https://ex.com/?refer=3"),
    ("https://ex.com:8443", "https://ex.com:8443/"),
]


def test_canonical_urls(spark):
    rows = [(i, href, BASE) for i, (href, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, href string, base string")
    got = {r["i"]: r["url"] for r in urls.canonical_urls(df, "href", "base").collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def test_canonical_is_stable(spark):
    # one slash is stripped at a time, so only a doubled one is not final
    df = spark.createDataFrame([(u,) for _, u in CASES if u and not u.endswith("p/")], "url string")
    for r in urls.canonical_urls(df, "url", out="again").collect():
        assert r["again"] == r["url"]


@pytest.mark.parametrize(
    ("host", "blocked"),
    [
        ("localhost", True), ("a.localhost", True), ("[::1]", True), ("[::ffff:10.0.0.1]", True),
        ("[::ffff:7f00:1]", True), ("2130706433", True), ("0x7f000001", True), ("017700000001", True),
        ("0", True), ("8.8.8.8", False), ("172.32.0.1", False), ("172.16.0.1", True),
        ("100.64.0.1", True), ("100.63.0.1", False), ("fe80::1", True), ("fd00:1::", True),
        ("example.com", False), ("99999999999", False), ("192.168.1.1", True), ("169.254.1.1", True),
    ],
)
def test_blocked_hosts(spark, host, blocked):
    df = spark.createDataFrame([(host,)], "host string")
    assert df.select(urls.is_blocked_host(F.col("host"))).first()[0] is blocked


def test_site_origins(spark):
    rows = [" https://Example.com:443/x ", "http://example.com:81", "ftp://example.com", "http://10.0.0.1/", "nope"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    got = [r["origin"] for r in urls.site_origins(df, "t").collect()]
    assert got == ["https://example.com", "http://example.com:81", None, None, None]


def test_crawlable_paths(spark):
    cases = {
        "/docs": True, "/Search/x": False, "/page/2": True, "/page/3": False, "/page/10": True, "/page/39": False,
        "/tag/a/page/1": False, "/a.PDF": False, "/a.pdfx": True, "/cart": False, "/wp-admin/x": False,
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r[0]: r[1] for r in df.select("p", urls.is_crawlable_path(F.col("p"))).collect()}
    assert got == cases


def test_overlong_numbers_are_judged_not_raised(spark):
    hosts = {
        "0x" + "f" * 20: False,
        "0" + "7" * 30: False,
        "9" * 40: False,
        "0x000000000007f000001": True,
        "0x7f000001": True,
        "00000017700000001": True,
        "2130706433": True,
        "0x0": True,
    }
    rows = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r.h: r.b for r in rows.select("h", urls.is_blocked_host(F.col("h")).alias("b")).collect()}
    assert got == hosts
    ports = {"https://e.com:99999999999/x": None, "https://e.com:70000/x": None, "https://e.com:000443/x": "https://e.com/x"}
    rows = spark.createDataFrame([(u,) for u in ports], "u string")
    got = {r.u: r.c for r in rows.select("u", urls.canonical(F.col("u"))["url"].alias("c")).collect()}
    assert got == ports
