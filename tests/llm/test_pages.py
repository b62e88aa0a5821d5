"""URL filter, WARC archives and embeddings against plain Python."""

import base64
import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from webcairn.llm import embeddings, url_filter, warc

URLS = [
    None,
    "",
    "no scheme.org/en/1",
    "HTTP://Sub.Example.ORG/en/1x?q#f",
    "http://example.org/es/",
    "http://example.org/es",
    "http://badexample.org/en/1",
    "https://x.com/fr/a?b",
    "https://x.com/de",
    "https://x.com/dex#y",
    "https://x.com/en/1",
    "https://onlinecasino.com/en/2",
    "https://casinoonline.net/en/3",
    "https://www.casino-online.net?x",
    "ftp://a://b/c",
    "http://exämple.net/ä",
]


def test_url_filter(spark):
    rows = list(enumerate(URLS)) + [(None, URLS[3]), (10, URLS[10])]
    rows += [(100 + i, f"https://quiet{i % 7}.net/en/{i}") for i in range(60)]
    rows += [(200 + i, f"https://casino{i}.net/en/{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("rule", F.lit("clash"))
    words = spark.createDataFrame([("online", 50), ("casino", 20), ("quiet", 50)], "word string, n bigint")
    out = url_filter.filter_urls(df, words).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id is None:
            continue
        url = dict(rows)[r.page_id]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = None
        for rule, verdict in url_filter.RULES:
            name, _, part = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + part):
                best = max(best or (0,), (len(rule), rule, verdict))
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        if best:
            assert r.verdict == best[2]
    verdicts = {r.page_id: r for r in out}
    assert verdicts[11].host_words == ["online", "casino", "com"]
    assert verdicts[12].verdict == verdicts[13].verdict == "block"
    assert verdicts[100].verdict == verdicts[0].verdict == "allow"
    assert url_filter.filter_urls(df.limit(0), words).collect() == []


def pages(spark):
    rows = [
        (1, "http://a.net/x", "<p>same</p>"),
        (2, "http://b.net/", "<p>same</p>"),
        (7, None, "<p>same</p>"),
        (3, "http://c.net/?q\r\nX: y", "WARC/1.1\r\nfake: 1\r\n\r\nä\r\n\r\n"),
        (4, "d", None),
        (5, "e", ""),
        (6, "http://f.net", "x" * 3_000_000),
        (8, "http://g.net", "y" * 10),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    df, rows = pages(spark)
    path = str(tmp_path / "archive")
    warc.write_warc(df, path, min_payload=5)
    records = warc.read_warc(spark, path)
    assert records.count() == 3 * len(rows)
    got = warc.assemble(records).collect()
    assert len(got) == len(rows)
    by_page = {}
    for r in got:
        assert r.request.concurrent_to == [r.capture_id] and len(r.metadata) == 1
        page = re.search(r"page-id: (\d+)", r.metadata[0].payload.decode()).group(1)
        by_page[int(page)] = r
    for page, _, html in rows:
        capture = by_page[page].capture
        assert capture.stated_digest == digest(html)
        if page in (1, 2):
            assert capture.type == "revisit" and capture.refers_to == by_page[7].capture_id
        else:  # payloads below five bytes are never revisits
            assert capture.type == "response" and capture.payload.decode() == (html or "")
    warc.write_warc(df.limit(0), str(tmp_path / "none"))


def test_warc_plain_and_members(spark, tmp_path):
    import gzip

    one = (
        "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Concurrent-To: <r>\r\n"
        "Content-Type: application/http; msgtype=response\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc"
    ).encode()
    two = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <r>\r\nContent-Length: 3\r\n\r\nGET"
    (tmp_path / "plain.warc").write_bytes(one + b"\r\n\r\n" + two + b"\r\n\r\n")
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(one + b"\r\n\r\n") + gzip.compress(two + b"\r\n\r\n"))
    for name in ("plain.warc", "members.warc.gz"):
        (got,) = warc.assemble(warc.read_warc(spark, str(tmp_path / name))).collect()
        assert bytes(got.capture.payload) == b"abc" and got.request.record_id == "<r>" and got.metadata == []


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24))
    x[50:120] = x[50] + 0.05 * rng.standard_normal((70, 24))
    x[120:140] = x[120]
    x[200] = 3 * x[201]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [None] + [1.0] * 23), (904, [1.0, 0.0]), (905, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("kept", F.lit("clash"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(20):
        label = np.array([min(label[i], *label[link[i]]) if link[i].any() else label[i] for i in range(len(x))])
    out = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(out) == len(rows)
    for i in range(len(x)):
        assert (out[i].n_links, out[i].component_id) == (int(link[i].sum()), int(label[i]))
        assert out[i].kept == (label[i] == i)
    assert all(out[i].n_links == 0 and out[i].kept for i in range(900, 906))
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def brute(x, threshold=0.95):
    """Links and least reachable row of each row."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= threshold
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        after = np.array([min(label[i], *label[link[i]]) if link[i].any() else label[i] for i in range(len(x))])
        if (after == label).all():
            return link.sum(axis=1), label
        label = after


def near_groups(rng, groups):
    """Dense groups (0.99 inside) around centres; two of a pair are 0.95 to 0.97 apart, or only their edges are."""
    out = []
    for apart, spread, size in groups:
        c, d, *_ = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
        for centre in (c, np.cos(apart) * c + np.sin(apart) * d):
            noise = rng.standard_normal((size, 32))
            out.append(centre + spread * noise / np.linalg.norm(noise, axis=1, keepdims=True))
    return np.concatenate(out)


def test_embeddings_links_across_dense_groups(spark):
    rng = np.random.default_rng(5)
    x = near_groups(rng, [(0.27, 0.08, 20)] * 4 + [(0.33, 0.1, 25)] * 4 + [(0.36, 0.1, 30)] * 4 + [(0.6, 0.1, 20)] * 2)
    x = np.concatenate([x, rng.standard_normal((300, 32))])
    n_links, label = brute(x)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    out = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    wrong = [i for i in range(len(x)) if (out[i].n_links, out[i].component_id) != (n_links[i], label[i])]
    assert not wrong, len(wrong)


def test_embeddings_lone_pairs(spark):
    rng = np.random.default_rng(6)
    n, pairs = 20_000, 400
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(pairs):
        y = rng.standard_normal(64)
        y -= (y @ x[i]) * x[i]
        x[pairs + i] = 0.951 * x[i] + np.sqrt(1 - 0.951**2) * y / np.linalg.norm(y)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    out = {r.vec_id: r for r in embeddings.near_duplicates(df).where("n_links > 0").collect()}
    found = sum(1 for i in range(pairs) if pairs + i in out and out[pairs + i].component_id == i)
    assert set(out) <= set(range(2 * pairs))
    assert found >= 0.995 * pairs, found


def test_url_filter_rules(spark):
    assert [tuple(r) for r in url_filter.RULES] == [
        ("org/", "allow"),
        ("example.org/es/", "block"),
        ("example.org/en/1", "block"),
        ("com/fr/", "allow"),
        ("com/de/", "block"),
    ]
    urls = ["https://x.com/de/1", "https://x.com/de", "https://x.com/demo", "https://x.com/developers/a"]
    words = spark.createDataFrame([("x", 1)], "word string, n bigint")
    out = url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), words).collect()
    assert {r.url: (r.rule, r.verdict) for r in out} == {
        urls[0]: ("com/de/", "block"),
        **{u: (None, "allow") for u in urls[1:]},
    }


def test_url_filter_concatenated_hosts(spark, tmp_path):
    text = "the best play of the day and all the news of the town " * 3
    hosts = ["bestcasinobets.com", "playpoker.net", "bestnews.net", "casino-best.net"]
    body = "<title>Page of {0}</title><p>{1}<a href='https://{0}/'>{0}</a>"
    rows = [(10 * i + k, f"https://{h}/en/{k}", body.format(h, text)) for i, h in enumerate(hosts) for k in range(8)]
    rows += [(100 + i, f"https://town{i % 9}.net/en/{i}", f"<title>News</title><p>{text}") for i in range(60)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = {r.page_id: r for r in url_filter.op2_url_filter(spark, str(tmp_path)).collect()}
    assert out[0].host_words == ["best", "casino", "bets", "com"]
    assert out[10].host_words == ["play", "poker", "net"]
    assert out[20].host_words == ["best", "news", "net"]
    assert [out[i].verdict for i in (0, 10, 20, 30, 100)] == ["block", "block", "allow", "block", "allow"]
