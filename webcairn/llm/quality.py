"""Quality classifier by importance resampling.

Two generative models of hashed n-grams: target text (labelled good) and raw text (every
document).  Words give their first 4, 5 and 6 bytes, so that stems and endings that were
never seen together still tell, and a shape: last two bytes, capitals, and whether the
word before is the same.  The log ratio of the two models, n-gram by n-gram, weighs a
text, each text under models without its own counts; a document is as good as its worst passage, so its
weight is the least sum over passages of ``passage`` words.  Documents are resampled by
Gumbel top-k: seeded Gumbel noise is added to the log weight and the k largest stay, k
being the rows on the good side of the weight that parts the labelled rows best.

The target is fit on at most MOST_LABELS labelled rows, which tasks get as a list of
that size; raw counts run over all texts.  A task adds its texts into one vector per
model, so what is shuffled is a fixed number of buckets per task, and the driver and the
tasks see two counts per bucket.  The k-th largest key is found by radix selection over
counts of key digits, no sort and no limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from webcairn.llm.common import materialize, table, text_key, textkit as tk

BUCKETS = 1 << 18
BLOCK = 1 << 12
PASSAGE = 4
SHRINK = 10.0
STEMS = (4, 5, 6)
NOISE = 0.05
SEED = 7
DIGIT_BITS = 16
#: Labelled rows used, a seeded sample beyond it.
MOST_LABELS = 200_000


def _grams(data, at):
    """Buckets of every word (one array per kind of n-gram) and the row of every word."""
    low = tk.LOWER[data]
    start, end, row = tk.words(low, at, tk.NON_SPACE)
    if not len(start):
        return [np.zeros(0, np.int64)] * (len(STEMS) + 1), row
    prefix = tk.Prefix(low)

    def bucket(stop, salt):
        hashes = prefix.ranges(start, stop) + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return tk.mix(hashes + np.uint64(salt))

    whole = bucket(end, 0)
    again = np.zeros(len(start), np.int64)
    again[1:] = (whole[1:] == whole[:-1]) & (row[1:] == row[:-1])
    capital = (data >= 65) & (data <= 90)
    second = np.minimum(start + 1, end - 1)
    shape = data[end - 1].astype(np.int64) | data[np.maximum(end - 2, start)].astype(np.int64) << 8
    shape |= capital[start].astype(np.int64) << 16 | capital[second].astype(np.int64) << 17 | again << 18
    hashes = [bucket(np.minimum(end, start + n), n) for n in STEMS] + [tk.mix(shape.astype(np.uint64) + np.uint64(99))]
    return [(h >> np.uint64(20)).astype(np.int64) % BUCKETS for h in hashes], row


def _member(sorted_ids, ids):
    if not len(sorted_ids):
        return np.zeros(len(ids), bool)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return sorted_ids[at] == ids


def _vectors(good_ids):
    """What a task adds to the models: blocks of counts of all texts and of the good ones."""

    def scan(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            label = _member(good_ids.value, batch.column("id").to_numpy())
            for first, data, at in tk.chunks(batch.column("text")):
                grams, row = _grams(data, at)
                use = label[first + row]
                for x in grams:
                    raw += np.bincount(x, minlength=BUCKETS)
                    good += np.bincount(x[use], minlength=BUCKETS)
        for block in range(BUCKETS // BLOCK):
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            if raw[part].any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([raw[part].tobytes()]), pa.array([good[part].tobytes()])],
                    ["block", "raw", "good"],
                )

    return scan


def _merge(batches):
    """Add up what one partition holds of each block."""
    total: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for i, block in enumerate(batch.column("block").to_pylist()):
            held = total.setdefault(block, [np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)])
            held[0] += np.frombuffer(batch.column("raw")[i].as_buffer(), np.int64)
            held[1] += np.frombuffer(batch.column("good")[i].as_buffer(), np.int64)
    for block, (raw, good) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([raw.tobytes()]), pa.array([good.tobytes()])], ["block", "raw", "good"]
        )


def fit(texts: DataFrame, good_ids) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all texts (id, text) and over the good ones."""
    schema = "block int, raw binary, good binary"
    blocks = (
        texts.mapInArrow(_vectors(good_ids), schema)
        .repartition(BUCKETS // BLOCK, "block")
        .mapInArrow(_merge, schema)
        .toArrow()
    )
    raw, good = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    for block, a, b in zip(blocks["block"].to_pylist(), blocks["raw"], blocks["good"]):
        part = slice(block * BLOCK, (block + 1) * BLOCK)
        raw[part] = np.frombuffer(a.as_buffer(), np.int64)
        good[part] = np.frombuffer(b.as_buffer(), np.int64)
    return raw, good


def _ratio(raw, good, share, bucket, row, own_good, shrink):
    """Log ratio of each n-gram under models without its own text."""
    key = row * BUCKETS + bucket
    order = np.argsort(key, kind="stable")
    run = np.cumsum(np.r_[True, np.diff(key[order]) != 0]) - 1
    own = np.empty(len(key))
    own[order] = np.bincount(run)[run]
    target = np.maximum(good[bucket] - np.where(own_good, own, 0.0), 0.0)
    rest = np.maximum(raw[bucket] - own, 0.0)
    return np.log((target + shrink * share) / ((rest + shrink) * share))


def _weigh(models, good_ids, passage, shrink):
    def scan(batches):
        raw, good = models.value
        share = float(good.sum() / raw.sum()) if raw.sum() else 0.0
        for batch in batches:
            label = _member(good_ids.value, batch.column("__id").to_numpy())
            out = []
            for begin, data, at in tk.chunks(batch.column("__text")):
                grams, row = _grams(data, at)
                n = len(at) - 1
                least = np.zeros(n)
                out.append(least)
                if not share or not len(row):
                    continue
                mine = label[begin + row]
                value = sum(_ratio(raw, good, share, x, row, mine, shrink) for x in grams)
                first = tk.firsts(row, n)
                sums = np.r_[0.0, np.cumsum(value)]
                short = np.flatnonzero(np.diff(first) < passage)
                least[short] = sums[first[short + 1]] - sums[first[short]]
                if len(row) >= passage:
                    start = np.flatnonzero(row[: len(row) - passage + 1] == row[passage - 1 :])
                    if len(start):
                        score, of = sums[start + passage] - sums[start], row[start]
                        head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                        least[of[head]] = np.minimum.reduceat(score, head)
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.concatenate(out) if out else np.zeros(0))], [*names, "__weight"]
            )

    return scan


def gumbel(seed: int, *columns: Column) -> Column:
    """Gumbel noise fixed by the columns' values."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def largest(keyed: DataFrame, key: str, k: int) -> Column | None:
    """A condition true for the k rows with the largest ``key`` (a bigint of 48 bits, 0 or more); ties at the end all pass."""
    if k <= 0:
        return F.lit(False)
    prefix, left, bits = 0, k, 48
    while bits:
        bits -= DIGIT_BITS
        digit = F.shiftright(key, bits)
        rows = (
            keyed.where(F.shiftright(F.col(key), bits + DIGIT_BITS) == prefix)
            .groupBy(digit.alias("d"))
            .agg(F.count(F.lit(1)).alias("n"))
            .toArrow()
        )  # at most 2 ** DIGIT_BITS rows
        order = np.argsort(-rows["d"].to_numpy())
        digits, number = rows["d"].to_numpy()[order], np.cumsum(rows["n"].to_numpy()[order])
        at = int(np.searchsorted(number, left))
        if at >= len(digits):
            return F.lit(True)
        left -= int(number[at - 1]) if at else 0
        prefix = int(digits[at])
    return F.col(key) >= prefix


def parting(weight: np.ndarray, good: np.ndarray) -> float:
    """The weight from which on rows stay: most good rows above and bad rows below, by share of each."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    kept = 1.0 - np.r_[0.0, np.cumsum(good[order])] / good.sum()
    gone = np.r_[0.0, np.cumsum(~good[order])] / (~good).sum()
    gain = kept + gone
    sorted_weight = np.r_[weight[order], np.inf]
    gain[1:] = np.where(sorted_weight[1:] > sorted_weight[:-1], gain[1:], -1.0)  # ties fall together
    best = np.flatnonzero(gain == gain.max())
    at = int(best[len(best) // 2])
    return float((sorted_weight[at] + sorted_weight[at - 1]) / 2) if 0 < at < len(order) else float(sorted_weight[at])


def classify(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    passage: int = PASSAGE,
    shrink: float = SHRINK,
    noise: float = NOISE,
    seed: int = SEED,
    most_labels: int = MOST_LABELS,
) -> DataFrame:
    """Rows of ``docs`` without the text, with __key (of the text), log_weight, gumbel_key and keep.

    ``labels`` (doc_id, quality, toxic) names good rows: quality 1 and not toxic; rows
    with a null id or quality do not count, an id labelled twice is good only if always.
    Null and empty texts weigh 0.  Equal rows get equal keys and stay or go together.
    Without both good and bad labelled rows all rows stay.
    """
    spark = docs.sparkSession
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.xxhash64("doc_id").alias("__id"))
        .agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    )
    known = materialize(known.orderBy(F.xxhash64(F.lit(seed), "__id")).limit(most_labels))
    ids = known.where("good").select("__id").toArrow()["__id"].to_numpy()
    good_ids = spark.sparkContext.broadcast(np.sort(ids))
    texts = docs.select(F.xxhash64(F.col(id)).alias("id"), F.col(text).cast("string").alias("text"))
    models = spark.sparkContext.broadcast(fit(texts, good_ids))
    rest = [c for c in docs.columns if c not in (text, "log_weight", "gumbel_key", "keep")]
    rows = docs.select(
        *rest,
        F.xxhash64(F.col(id)).alias("__id"),
        text_key(F.col(text).cast("string")).alias("__key"),
        F.col(text).cast("string").alias("__text"),
    )
    schema = rows.drop("__text").schema.add("__weight", "double")
    scored = materialize(rows.mapInArrow(_weigh(models, good_ids, passage, shrink), schema))
    seen = scored.join(known, "__id").orderBy(F.xxhash64(F.lit(seed), "__id", "__key")).limit(most_labels)
    seen = seen.select("__weight", "good").toArrow()
    edge = parting(seen["__weight"].to_numpy(), seen["good"].to_numpy().astype(bool))
    key = F.col("__weight") + F.lit(noise) * gumbel(seed, F.col("__id"), F.col("__key"))
    # 48 bits of the key over -256..256 part keys 2e-12 apart
    place = F.greatest(F.lit(0), F.least(F.lit((1 << 48) - 1), ((key + 256.0) * float(1 << 39)).cast("bigint")))
    keyed = scored.withColumn("__place", place)
    k = keyed.where(F.col("__weight") >= F.lit(edge)).count()
    return keyed.withColumns(
        {"log_weight": F.col("__weight"), "gumbel_key": key, "keep": largest(keyed, "__place", k)}
    ).drop("__weight", "__place", "__id")


def good_documents(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` that the classifier keeps."""
    verdict = classify(docs.select(id, text), labels, text, id, **options)
    gone = materialize(verdict.where(~F.col("keep")).select("__key", F.xxhash64(F.col(id)).alias("__id")).distinct())
    keyed = docs.withColumns({"__key": text_key(F.col(text).cast("string")), "__id": F.xxhash64(F.col(id))})
    return keyed.join(gone, ["__key", "__id"], "left_anti").select(*docs.columns)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "gumbel_key", "keep")
