import random
from collections import defaultdict

from pyspark.sql import functions as F

from webcairn.operators.ranking import first_by, positions, spread_join, top_k


def rows(n=3000, seed=3):
    """A third of the rows belong to one key."""
    rnd = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}", rnd.randint(0, 500), i) for i in range(n)]


def by_key(data):
    groups = defaultdict(list)
    for k, a, b in data:
        groups[k].append((a, b))
    return {k: sorted(v) for k, v in groups.items()}


def frame(spark, data):
    return spark.createDataFrame(data, "k string, a int, b int").repartition(7)


def test_positions(spark):
    data = rows()
    got = {(r["k"], r["b"]): r["pos"] for r in positions(frame(spark, data), ["k"], ["a", "b"]).collect()}
    want = {(k, b): i for k, v in by_key(data).items() for i, (_, b) in enumerate(v, 1)}
    assert got == want


def test_top_k(spark):
    data = rows()
    want = {(k, b): i for k, v in by_key(data).items() for i, (_, b) in enumerate(v[:20], 1)}
    for salts in (1, 8):
        got = top_k(frame(spark, data), ["k"], [F.col("a"), F.col("b")], 20, salts=salts)
        assert {(r["k"], r["b"]): r["rank"] for r in got.collect()} == want


def test_top_k_prunes_before_the_shuffle(spark):
    df = top_k(frame(spark, rows()), ["k"], [F.col("a"), F.col("b")], 20)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_first_by(spark):
    data = rows()
    got = {r["k"]: (r["a"], r["b"]) for r in first_by(frame(spark, data), ["k"], ["a", "b"]).collect()}
    assert got == {k: v[0] for k, v in by_key(data).items()}


def test_spread_join(spark):
    data = rows(500)
    small = spark.createDataFrame([(k, len(k)) for k in by_key(data) if k != "k3"], "k string, n int")
    big = frame(spark, data)
    assert spread_join(big, small, ["k"]).exceptAll(big.join(small, "k")).isEmpty()
    assert spread_join(big, small, ["k"], "left").count() == 500
