"""Benchmark decontamination by winnowing.

Words are hashed; of every ``window`` consecutive words the least hash among their
``gram``-word strings is the fingerprint, so texts that share a window share its
fingerprint at the same place.  Fingerprints of documents and items are joined and each
hit is extended word by word to both sides; spans of ``window`` words or more count.
Items shorter than the window are one fingerprint of all their words.

A document's fingerprints first pass a bit filter of fixed size made from the items
(``filter_bits``), so what is shuffled are hits, not documents.  With more items than
the filter separates, more rows reach the join; results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webcairn.llm.common import filter_bits, in_filter, materialize, table, text_key, textkit as tk

WINDOW = 10
GRAM = 5
_SHORT = np.uint64(0xA0761D6478BD642F)
_KEY40 = np.uint64(((1 << 64) - 1) ^ ((1 << 24) - 1))


def _fingerprints(word, row, first, window, gram):
    """Places (in the whole chunk) and hashes of the fingerprints of every full window."""
    grams = tk.word_grams(word, gram)
    w = window - gram + 1
    if len(grams) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = []
    step = 1 << 22
    for lo in range(0, len(grams) - w + 1, step):
        part = grams[lo : lo + step + w - 1] & _KEY40
        least = tk.sliding_min(part | np.arange(len(part), dtype=np.uint64), w)
        place.append((least & ~_KEY40).astype(np.int64) + lo)
    place = np.concatenate(place)
    start = np.arange(len(place))
    inside = row[start] == row[start + window - 1]
    at = np.unique(place[inside])
    return at, grams[at]


def _around(word, row, at, before, after):
    """Hashes of the neighbours of each place; 0 stands for the end of the text."""
    idx = at[:, None] + np.arange(-before, after)
    ok = (idx >= 0) & (idx < len(word))
    idx = np.clip(idx, 0, max(len(word) - 1, 0))
    ok &= row[idx] == row[at][:, None]
    return np.where(ok, word[idx], np.uint64(0))


def _lists(x):
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), x.shape[1]).cast(
        pa.list_(pa.int64())
    )


def _short_hash(word, n):
    return tk.mix(tk.word_grams(word, n) ^ (_SHORT * np.uint64(n)))


def _scan(window, gram, bits, short):
    """Fingerprint rows of a batch; with ``bits`` only those that an item may have."""
    reach = window - gram

    def scan(batches):
        for batch in batches:
            keys = batch.column("key")
            for base, data, at in tk.chunks(batch.column("text")):
                word, row = tk.word_hashes(data, at, tk.WORD_BYTES)
                first = tk.firsts(row, len(at) - 1)
                place, value = _fingerprints(word, row, first, window, gram)
                kind = np.zeros(len(place), np.int32)
                if bits is None:  # items: those shorter than a window as a whole
                    size = np.diff(first)
                    small = np.flatnonzero((size > 0) & (size < window))
                    for n in np.unique(size[small]):
                        of = first[small[size[small] == n]]
                        place = np.r_[place, of]
                        value = np.r_[value, _short_hash(word, int(n))[of]]
                        kind = np.r_[kind, np.full(len(of), n, np.int32)]
                else:
                    seen = bits.value
                    use = in_filter(seen, value)
                    place, value, kind = place[use], value[use], kind[use]
                    for n in short:
                        own = _short_hash(word, n)
                        of = np.flatnonzero((row[: len(own)] == row[n - 1 :]) & in_filter(seen, own))
                        place = np.r_[place, of]
                        value = np.r_[value, own[of]]
                        kind = np.r_[kind, np.full(len(of), n, np.int32)]
                if not len(place):
                    continue
                place = place.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(row[place] + base)),
                        pa.array(value.view(np.int64)),
                        pa.array(kind),
                        pa.array((place - first[row[place]]).astype(np.int32)),
                        _lists(_around(word, row, place, reach, gram + reach)),
                    ],
                    ["key", "fingerprint", "kind", "place", "around"],
                )

    return scan


def _extend(window, gram):
    """Spans of document words that a hit's window-long matches cover; shorter matches go."""
    reach = window - gram

    def scan(batches):
        for batch in batches:
            if not len(batch):
                continue
            a = batch.column("around").flatten().to_numpy().reshape(len(batch), -1)
            b = batch.column("there").flatten().to_numpy().reshape(len(batch), -1)
            kind, place = batch.column("kind").to_numpy(), batch.column("place").to_numpy()
            same = (a == b) & (a != 0)
            left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, reach + gram :], axis=1).sum(axis=1)
            middle = same[:, reach : reach + gram].all(axis=1)
            short = np.array([same[i, reach : reach + k].all() if k else False for i, k in enumerate(kind)], bool)
            lo = np.where(kind > 0, place, place - left)
            hi = np.where(kind > 0, place + kind, place + gram + right)
            ok = np.where(kind > 0, short, middle & (hi - lo >= window))
            out = pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("item_id"), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                ["key", "item_id", "lo", "hi"],
            )
            yield out.filter(pa.array(ok))

    return scan


def _count_words(batches):
    for batch in batches:
        n = [np.zeros(0, np.int64)]
        for _, data, at in tk.chunks(batch.column("text")):
            _, _, row = tk.words(tk.LOWER[data], at, tk.WORD_BYTES)
            n.append(tk.counts(row, len(at) - 1))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(np.concatenate(n).astype(np.int64))],
            [*(c for c in batch.schema.names if c != "text"), "n_words"],
        )


def matches(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """key (of the document's text), item_id, lo, hi: word spans that an item shares, overlaps included.

    Texts and items without words match nothing.  Items with equal texts all match.
    """
    spark = docs.sparkSession
    if not 1 <= gram <= window:
        raise ValueError("gram must lie within the window")
    schema = "key binary, fingerprint bigint, kind int, place int, around array<bigint>"
    test = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).select(
        text_key(F.col("text")).alias("key"), "item_id", "text"
    )
    prints = materialize(
        test.select("key", "text").dropDuplicates(["key"]).mapInArrow(_scan(window, gram, None, ()), schema)
    )
    short = [r[0] for r in prints.select("kind").distinct().collect() if r[0]]  # fewer than a window's words
    bits = spark.sparkContext.broadcast(filter_bits(prints.select("fingerprint").distinct(), "fingerprint"))
    hits = docs.select(text_key(F.col(text).cast("string")).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        _scan(window, gram, bits, short), schema
    )
    hits = hits.dropDuplicates(["key", "kind", "place"])  # copies of a text count once
    known = prints.select(F.col("key").alias("item_id"), "fingerprint", "kind", F.col("around").alias("there"))
    spans = (
        hits.join(known, ["fingerprint", "kind"])
        .select("key", "item_id", "kind", "place", "around", "there")
        .mapInArrow(_extend(window, gram), "key binary, item_id binary, lo int, hi int")
        .distinct()
    )
    named = test.select(F.col("key").alias("item_key"), "item_id").distinct()
    return materialize(
        spans.withColumnRenamed("item_id", "item_key").join(named, "item_key").select("key", "item_id", "lo", "hi")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """Every row of ``docs`` without its text, with n_words, n_hit, n_items, items (sorted strings), contaminated."""
    spans = matches(docs, items, text, item_id, item_text, window, gram)
    named = spans.groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # words covered: what each span adds beyond all spans that start before it, inside one text
    from pyspark.sql import Window

    before = Window.partitionBy("key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        spans.select("key", "lo", "hi")
        .distinct()
        .withColumn("reached", F.coalesce(F.max("hi").over(before), F.lit(0)))
        .groupBy("key")
        .agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "reached"))).cast("bigint").alias("n_hit"))
    )
    found = materialize(named.join(covered, "key"))
    clash = {"n_words", "n_hit", "n_items", "items", "contaminated", "key", text}
    rest = [c for c in docs.columns if c not in clash]
    rows = docs.select(*rest, text_key(F.col(text).cast("string")).alias("key"), F.col(text).cast("string").alias("text"))
    sized = rows.mapInArrow(_count_words, rows.drop("text").schema.add("n_words", "long"))
    return sized.join(found, "key", "left").select(
        *rest,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0).cast("bigint")) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that share no window with any item."""
    text = options.get("text", "text")
    hit = materialize(matches(docs, items, **options).select("key").distinct())
    keyed = docs.withColumn("__key", text_key(F.col(text).cast("string")))
    return keyed.join(hit.withColumnRenamed("key", "__key"), "__key", "left_anti").select(*docs.columns)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
