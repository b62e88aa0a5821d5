"""The pipeline's stages against what each promises on its own input."""

import hashlib
import re
from collections import Counter

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = pipeline.table(spark, SF, "documents")
    columns = docs.columns
    held = [docs]
    for name, stage in pipeline.STAGES:
        held.append(pipeline.materialize(stage(spark, held[-1], SF)))
        assert held[-1].columns[: len(columns)] == columns
    start, good, single, clean, mixed, shards = [[tuple(r) for r in x.select(*columns, *[c for c in x.columns if c not in columns]).collect()] for x in held]
    assert set(good) <= set(start) and 0 < len(good) < len(start)
    assert set(single) <= set(good)
    sets = {}
    for r in good:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    place = {i: i for i in ids}
    for _ in range(5):
        for a in ids:
            for b in ids:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[b]:
                    place[a] = place[b] = min(place[a], place[b])
    assert {r[0] for r in single} == {i for i in ids if place[i] == i}
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in pipeline.table(spark, SF, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    dirty = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert set(clean) == {r for r in single if not dirty(r[1])}
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 3
    assert Counter(r[: len(columns)] for r in shards) == Counter(mixed)
    assert hashlib.sha256(str(sorted(r[0] for r in shards)).encode()).hexdigest()


def test_run_repeats(spark):
    one = Counter((r.doc_id, r.shard, r.slot) for r in pipeline.run(spark, SF).collect())
    two = Counter((r.doc_id, r.shard, r.slot) for r in pipeline.run(spark, SF).collect())
    assert one == two
