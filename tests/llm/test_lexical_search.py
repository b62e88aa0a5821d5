"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from webcairn.llm import common, lexical_search as L
from webcairn.llm.common import table

SF = "/root/testdata/sf0.001"


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_words = sum(1 for h in held if h[2]), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, count, size in held:
            score = 0
            for t in set(terms(text)) & set(count):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 10 + (90 * size * n_docs) // n_words
                score += w * ((1000000000 * count[t]) // (1000 * count[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, n + 1, doc, -s) for n, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) if not isinstance(x, str) else (True, x) for x in r))


@pytest.mark.parametrize("docs_in_block, points", [(4096, 1 << 19), (7, 1 << 19), (64, 40)])
def test_search_equals_brute_force(spark, monkeypatch, docs_in_block, points):
    monkeypatch.setattr(L, "BLOCK_DOCS", docs_in_block)
    monkeypatch.setattr(L, "BLOCK_POINTS", points)
    rnd = random.Random(docs_in_block)
    vocabulary = [f"w{i}" for i in range(60)] + ["ñandú", "日本", "The"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [" ".join(rnd.choices(vocabulary, weights, k=rnd.choice([0, 1, 3, 10, 40]))) for _ in range(300)]
    docs = [*enumerate(texts), (None, texts[5]), (7, texts[7]), (8, None), (9, "  ,.\n"), (500, "w1 " * 3000), (501, " ".join(f"long{i}" for i in range(900)))]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 2, 5, 30])))) for i in range(25)]
    items += [(3, "w3 w3"), (None, "w1"), (90, None), (91, ""), (92, "absent"), (93, "WORD long5 w59")]
    left = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "1 as terms", "2 as ids").repartition(3)
    right = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 as number")
    got = [tuple(r) for r in L.search(L.Index(left), right).collect()]
    assert order(got) == order(brute(docs, items))


def test_items_in_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_TERMS", 60)
    docs = [(i, f"a{i % 7} b{i % 11} c{i}") for i in range(100)]
    items = [(i, f"a{i % 7} b{i % 5} x{i}") for i in range(40)]
    left, right = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = [tuple(r) for r in L.search(L.Index(left), right, k=3).collect()]
    assert order(got) == order(brute(docs, items, 3))


def test_query(spark):
    got = [tuple(r) for r in L.op11_lexical_search(spark, SF).collect()]
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert order(got) == order(brute(docs, items))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert L.search(L.Index(none), some, "doc_id").count() == 0
    assert L.search(L.Index(some), none, "doc_id").count() == 0


def test_a_row_group_holds_one_large_block(spark, monkeypatch):
    """A reader holds a row group at a time, so its size may not follow that of a file."""
    monkeypatch.setattr(L, "BLOCK_DOCS", 20)
    monkeypatch.setattr(L, "ROW_GROUP", 1 << 10)
    docs = [(i, " ".join(f"t{(i * 31 + j * j) % 4001}" for j in range(60))) for i in range(400)]
    index = L.Index(spark.createDataFrame(docs, "doc_id int, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.blocks.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert len(groups) == sum(groups) == 20


def test_cells_of_the_index_are_packed(spark):
    """A block takes less than its points do as numbers of 8, 4 and 4 bytes."""
    docs = [(i, " ".join(f"t{j}" for j in range(i % 50, i % 50 + 200))) for i in range(300)]
    index = L.Index(spark.createDataFrame(docs, "doc_id int, text string").coalesce(1))
    size = "length(points) + length(impact) + length(peak)"
    assert index.blocks.selectExpr(f"sum({size})").first()[0] < 300 * 200 * 16 // 4


def test_batches_are_kept_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64())})

    rows = spark.range(0, 100, 1, 1).selectExpr("repeat('x', 1000) AS text")
    counted = lambda: [r[0] for r in rows.mapInArrow(sizes, "rows bigint").collect()]
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert counted() == [100]
    with common.small_batches(spark, 10_000):
        assert len(counted()) >= 9
    with pytest.raises(ZeroDivisionError), common.small_batches(spark, 10_000):
        1 / 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before and counted() == [100]
