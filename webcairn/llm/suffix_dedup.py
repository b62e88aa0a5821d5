"""Exact substring dedup: which bytes lie in a string of ``length`` bytes that starts elsewhere too.

Depth-limited radix sort, most significant digit first, of the suffixes at every byte
through ``length`` bytes only.  Equal groups at full depth are the repeated windows.

1. First digit of a suffix: the least hash among the ``gram``-byte strings of its
   window, and where it lies.  Equal windows have equal digits.  Neighbouring suffixes
   share a digit, so one row stands for a run of them (1.3 % of the bytes).  Runs whose
   digit occurs once in the corpus are done.
2. Second digit: everything a run covers.  Two equal runs are repeated through full
   depth, so copies of any number end here, counted map-side.
3. Last digit: single windows, of the distinct runs left that share a first digit with
   another run.  Windows of a run overlap, so the first and last repeated one of a run
   give what it covers.

Digits are grouped by counting, never by collecting a group, so a passage held by a
third of the corpus is a number per task.  Null text counts as empty; equal texts get
equal results whatever their ids.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webcairn.llm.common import filter_bits, in_filter, materialize, text_key, textkit as tk

LENGTH = 200
GRAM = 50
#: Windows held at a time, and bytes of text worked on at once.
HELD, CHUNK = 1 << 17, 1 << 18
_LENGTH_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 24) - 1)


def _runs(data, at, length, gram):
    """First digit, second digit, first and last window start, and digit place of every run."""
    prefix = tk.Prefix(data)
    hashes = prefix.grams(gram)
    w = length - gram + 1
    if len(hashes) < w:
        return None
    if len(hashes) <= 1 << 24:  # place in the low bits: one pass gives the leftmost least hash
        place = tk.sliding_min((hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64), w)
        place = (place & _LOW).astype(np.int64)
    else:
        least = tk.sliding_min(hashes & ~_LOW, w)
        place = np.empty(len(least), np.int64)
        step = 1 << 22
        for lo in range(0, len(least), step):
            part = hashes[lo : lo + step + w - 1] & ~_LOW
            key = part | np.arange(len(part), dtype=np.uint64)
            place[lo : lo + step] = (tk.sliding_min(key, w) & _LOW).astype(np.int64) + lo
    size = np.diff(at)
    edge = np.zeros(len(data) + 1, np.int32)
    ok = size >= length
    np.add.at(edge, at[:-1][ok], 1)
    np.add.at(edge, at[:-1][ok] + size[ok] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(edge)[: len(place)] > 0)
    if not len(start):
        return None
    place = place[start]
    doc = np.searchsorted(at, start, "right") - 1
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(doc) != 0)) + 1
    head, tail = np.r_[0, cut], np.r_[cut - 1, len(start) - 1]
    lo, hi, place, doc = start[head], start[tail], place[head], doc[head]
    first = hashes[place]
    second = prefix.ranges(lo, hi + length)
    second += (hi - lo).astype(np.uint64) * _LENGTH_MIX
    second += (place - lo).astype(np.uint64) * tk.BASE
    return first, tk.mix(second), lo, hi, place, doc, prefix


def _signed(x):
    return np.ascontiguousarray(x).view(np.int64)


def _first_digits(length, gram):
    def scan(batches):
        for batch in batches:
            for _, data, at in tk.chunks(batch.column("text"), CHUNK):
                got = _runs(data, at, length, gram)
                if got is None:
                    continue
                value, back, n = np.unique(got[0], return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(value)), pa.array(n.astype(np.int64))], ["first", "n"])

    return scan


def _repeated_runs(length, gram, bits):
    """Runs whose first digit may occur twice; runs repeated inside their text come once with their number."""

    def scan(batches):
        seen = bits.value
        for batch in batches:
            keys = batch.column("key")
            for row, data, at in tk.chunks(batch.column("text"), CHUNK):
                got = _runs(data, at, length, gram)
                if got is None:
                    continue
                first, second, lo, hi, place, doc, _ = got
                use = np.flatnonzero(in_filter(seen, _signed(first)))
                first, second, lo, hi, place, doc = (x[use] for x in (first, second, lo, hi, place, doc))
                base = at[doc]
                order = np.lexsort((lo, second, first, doc))
                head = np.ones(len(order), bool)
                s = [x[order] for x in (doc, first, second)]
                head[1:] = np.any([x[1:] != x[:-1] for x in s], axis=0) if len(order) else True
                group = np.cumsum(head) - 1
                number = np.bincount(group, minlength=0)
                n = np.zeros(len(order), np.int64)
                n[order] = np.where(head, number[group] if len(group) else 0, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(doc + row)),
                        pa.array(_signed(first)),
                        pa.array(_signed(second)),
                        pa.array(n),
                        pa.array((lo - base).astype(np.int32)),
                        pa.array((hi - base).astype(np.int32)),
                    ],
                    ["key", "first", "second", "n", "lo", "hi"],
                )

    return scan


def _windows(length, bits=None):
    """Last digits of the listed runs of each text, a bounded number at a time.

    With ``bits`` only those of single runs that may occur twice, with their places.
    """

    def scan(batches):
        for batch in batches:
            texts, sizes, runs = batch.column("__packed"), batch.column("__size"), batch.column("runs")
            for i in range(len(batch)):
                items = runs[i].values
                use = slice(None) if bits is None else items.field("single").to_numpy(zero_copy_only=False)
                lo, hi, first, run = (items.field(c).to_numpy()[use] for c in ("lo", "hi", "first", "run"))
                if not len(lo):
                    continue
                data = np.frombuffer(pa.decompress(texts[i].as_buffer(), sizes[i].as_py(), "zstd"), np.uint8)
                prefix = tk.Prefix(data)
                ends = np.cumsum(hi - lo + 1)
                at = 0
                while at < len(lo):  # runs of about HELD windows; one longer run comes alone
                    done = ends[at - 1] if at else 0
                    to = max(int(np.searchsorted(ends, done + HELD, "right")), at + 1)
                    part = slice(at, to)
                    n = hi[part] - lo[part] + 1
                    of = np.repeat(np.arange(at, to), n)
                    p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of]
                    digit = _signed(tk.mix(prefix.ranges(p, p + length) + tk.mix(first[of].view(np.uint64))))
                    if bits is None:
                        yield pa.RecordBatch.from_arrays([pa.array(run[of]), pa.array(digit)], ["run", "digit"])
                    else:
                        maybe = np.flatnonzero(in_filter(bits.value, digit))
                        step = (p - lo[of]).astype(np.int32)
                        columns = [pa.array(x[maybe]) for x in (run[of], step, digit)]
                        yield pa.RecordBatch.from_arrays(columns, ["run", "step", "digit"])
                    at = to
            pa.default_memory_pool().release_unused()

    return scan


def _packed(text):
    raw = [x.as_buffer() if x.is_valid else pa.py_buffer(b"") for x in text]
    packed = pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())
    return packed, pa.array([x.size for x in raw], pa.int64())


def _pack(batches):
    for batch in batches:
        names = [c for c in batch.schema.names if c != "__text"]
        columns = [*(batch.column(c) for c in names), *_packed(batch.column("__text"))]
        yield pa.RecordBatch.from_arrays(columns, [*names, "__packed", "__size"])


def _pack_once(batches):
    """Texts of a key once per task; the join behind copes with the few that are left."""
    seen: set = set()
    for batch in batches:
        use = []
        for i, key in enumerate(batch.column("key").to_pylist()):
            if key not in seen:
                seen.add(key)
                use.append(i)
        batch = batch.take(pa.array(use, pa.int64()))
        columns = [batch.column("key"), *_packed(batch.column("__text"))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "__packed", "__size"])


def _cut(batches):
    """Texts without their spans: what is left, its size and the number of removed runs."""
    for batch in batches:
        texts, sizes, spans = batch.column("__packed"), batch.column("__size"), batch.column("__spans")
        left, removed, number = [], [], []
        for i in range(len(batch)):
            size = sizes[i].as_py()
            data = np.frombuffer(pa.decompress(texts[i].as_buffer(), size, "zstd"), np.uint8)
            kept, cut, n = data, 0, 0
            if spans[i].is_valid and len(spans[i].values):
                items = spans[i].values
                edge = np.zeros(size + 1, np.int32)
                np.add.at(edge, items.field("lo").to_numpy(), 1)
                np.add.at(edge, items.field("hi").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept, cut = data[~gone], int(gone.sum())
                n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            left.append(kept.tobytes())
            removed.append(cut)
            number.append(n)
        names = [c for c in batch.schema.names if c not in ("__packed", "__size", "__spans", "__key")]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in names),
                pa.array(left, pa.binary()),
                sizes,
                pa.array(removed, pa.int64()),
                pa.array(number, pa.int64()),
            ],
            [*names, "kept", "n_bytes", "n_removed", "n_spans"],
        )


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key (of the text), spans: array of [lo, hi) byte ranges covered by repeated windows, unmerged.

    Texts without any are absent; texts shorter than ``length`` never have any.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(text).cast("string").alias("text"))
    # first digit
    repeated = materialize(
        source.mapInArrow(_first_digits(length, gram), "first bigint, n bigint")
        .groupBy("first")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .select("first")
    )
    bits = spark.sparkContext.broadcast(filter_bits(repeated, "first"))
    runs = materialize(
        source.select(text_key(F.col("text")).alias("key"), "text").mapInArrow(
            _repeated_runs(length, gram, bits),
            "key binary, first bigint, second bigint, n bigint, lo int, hi int",
        ).withColumn("run", F.monotonically_increasing_id())
    )
    # second digit: n = 0 marks the further places of a run inside one text
    known = materialize(
        runs.groupBy("first", "second").agg(
            F.sum("n").alias("number"), F.min(F.when(F.col("n") > 0, F.col("run"))).alias("one")
        )
    )
    shared = known.groupBy("first").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("first")
    open_runs = materialize(known.join(shared, "first", "left_semi").select("first", "second", "number", "one"))
    marked = runs.join(known.select("first", "second", "number"), ["first", "second"])
    whole = marked.where("number > 1").select("key", "lo", (F.col("hi") + length).alias("hi"))
    # last digit: one place of every run left
    places = materialize(
        runs.select("key", "lo", "hi", "run").join(
            open_runs.select("first", "number", F.col("one").alias("run")), "run"
        )
    )
    listed = places.groupBy("key").agg(
        F.collect_list(F.struct("lo", "hi", "first", "run", (F.col("number") == 1).alias("single"))).alias("runs")
    )
    # one Python function a stage, so that a task never feeds several workers at once
    texts = materialize(
        source.select(text_key(F.col("text")).alias("key"), F.col("text").alias("__text"))
        .mapInArrow(_pack_once, "key binary, __packed binary, __size bigint")
        .join(listed, "key")
    )
    # windows are many times the text, so they are made once more and not written
    windows = texts.mapInArrow(_windows(length), "run bigint, digit bigint")
    twice = materialize(  # a text that stands in several tasks gives its windows again, under the same run
        windows.groupBy("digit").agg(F.min("run").alias("a"), F.max("run").alias("b")).where("a <> b").select("digit")
    )
    digits = spark.sparkContext.broadcast(filter_bits(twice, "digit"))
    ends = (
        texts.mapInArrow(_windows(length, digits), "run bigint, step int, digit bigint")
        .join(twice, "digit")
        .groupBy("run")
        .agg(F.min("step").alias("a"), F.max("step").alias("b"))
    )
    partly = places.join(ends, "run").select(
        "key", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b") + length).alias("hi")
    )
    return (
        whole.unionByName(partly).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    )


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Every row of ``docs`` without its text, with kept (binary, the bytes left), n_bytes, n_removed, n_spans.

    A removed run may start or end inside a character, hence bytes.  Null text gives
    empty bytes, equal rows equal results; no rows give no rows.  Other columns stay, also those named
    key, size, spans or packed; names that begin with two underscores are this module's own.
    """
    added = {"kept": "binary", "n_bytes": "long", "n_removed": "long", "n_spans": "long"}
    rest = [c for c in docs.columns if c not in (*added, text)]
    spans = materialize(repeated_spans(docs, text, length, gram)).withColumnsRenamed({"key": "__key", "spans": "__spans"})
    value = F.col(text).cast("string")
    rows = docs.select(*rest, text_key(value).alias("__key"), value.alias("__text"))
    packed = rows.mapInArrow(_pack, rows.select(*rest, "__key").schema.add("__packed", "binary").add("__size", "long"))
    joined = materialize(packed.join(spans, "__key", "left"))
    schema = joined.select(*rest).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return joined.select(*rest, "__key", "__packed", "__size", "__spans").mapInArrow(_cut, schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from webcairn.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
