"""N-gram Jaccard join: texts whose word-shingle sets are alike, grouped by links.

Blocked sparse matrix product.  The incidence matrix has a row per distinct shingle set
and a column per shingle; columns are cut into blocks by shingle hash, sized so that a
block is a few million entries.  A block multiplies its columns with themselves and adds
up, per pair of sets, how many shingles the two share; pairs whose sizes alone rule out
the threshold never start.  Sums over all blocks give the overlap.

A column held by more than COMMON sets is not multiplied (its square would be).  It adds
to each set's number of common shingles instead, which bounds what a pair's sum may lack:
* sum enough for the threshold: linked;
* sum plus the bound too small: discarded;
* between: the two texts are compared.
A set linked to another misses at most n - 0.85 n of its shingles there, so a pair can
share common columns only if both sets have no more uncommon shingles than that.  Such
sets (large groups of near copies, boilerplate) are listed by their lowest hashes; each is
compared with the least set of its lists, and sets that lists connect but links do not
are multiplied row block by row block, over all their columns.  A product returns what it
connects, a row per set and block, never its pairs.

Sets that are equal collapse before any of this, so copies cost one row each.  A set is
named by 64 bits of hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from webcairn.llm.common import filter_bits, in_filter, materialize, table, text_key, textkit as tk
from webcairn.llm.graph import components

SHINGLE = 4
PERCENT = 85
#: Sets that a column may have and still be multiplied.
COMMON = 12
#: Sets of one buffer of a task that make a column common at once, before the shuffle.
LOCAL_COMMON = 12
BLOCK_ENTRIES = 6_000_000
ROW_BLOCK = 256
BUFFER_ENTRIES = 1_000_000
_LENGTH_MIX = np.uint64(0xD6E8FEB86659FD93)
_TOKEN_BITS = 40
_OWNER_BITS = 24


def shingle_sets(data, at, size):
    """Distinct shingle hashes of each row: values sorted inside their row, and offsets."""
    word, row = tk.word_hashes(data, at, tk.NON_SPACE)
    n = len(at) - 1
    first = tk.firsts(row, n)
    grams = tk.word_grams(word, size)
    inside = np.flatnonzero(row[: len(grams)] == row[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
    value, owner = grams[inside], row[inside]
    length = np.diff(first)
    for k in range(1, size):  # a text of fewer words is one shingle
        of = np.flatnonzero(length == k)
        if len(of):
            value = np.r_[value, tk.mix(tk.word_grams(word, k)[first[of]] + np.uint64(k * int(_LENGTH_MIX) % (1 << 64)))]
            owner = np.r_[owner, of]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, tk.firsts(owner, n)


def set_ids(value, at):
    """64 bits per row that stand for its set: a sum over the shingles, and their number."""
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(tk.mix(value + np.uint64(0x1B873593)), out=sums[1:])
    return tk.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * _LENGTH_MIX)


def _signed(x):
    return np.ascontiguousarray(x).view(np.int64)


def _describe(size):
    def scan(batches):
        for batch in batches:
            ids, number = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, data, at in tk.chunks(batch.column("__text")):
                value, offsets = shingle_sets(data, at, size)
                ids.append(set_ids(value, offsets))
                number.append(np.diff(offsets))
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array(_signed(np.concatenate(ids))),
                    pa.array(np.concatenate(number).astype(np.int64)),
                ],
                [*names, "set_id", "n_shingles"],
            )

    return scan


def _planes(x, width):
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw, n, width):
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _spread(blocks, size):
    """A task's part of each block: its sets, their entries, and the columns already known as common."""

    def flush(ids, numbers, values, owners):
        ids, numbers = np.concatenate(ids), np.concatenate(numbers)
        value, owner = np.concatenate(values), np.concatenate(owners)
        block = (value >> np.uint64(_TOKEN_BITS)).astype(np.int64) % blocks
        token = value & np.uint64((1 << _TOKEN_BITS) - 1)
        order = np.lexsort((owner, token, block))
        block, token, owner = block[order], token[order], owner[order]
        cut = np.searchsorted(block, np.arange(blocks + 1))
        out_block, out_data = [], []
        for b in range(blocks):
            part = slice(cut[b], cut[b + 1])
            t, o = token[part], owner[part]
            if not len(t):
                continue
            head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            df = np.diff(np.r_[head, len(t)])
            often = df > LOCAL_COMMON
            common = t[head[often]]
            drop = np.repeat(often, df)
            hot = np.bincount(o[drop], minlength=len(ids))
            sets = np.unique(o)
            place = np.zeros(len(ids), np.int64)
            place[sets] = np.arange(len(sets))
            t, o = t[~drop], place[o[~drop]]
            head = np.array([len(sets), len(t), len(common)], "<i8").tobytes()
            raw = b"".join(
                [
                    head,
                    ids[sets].tobytes(),
                    _planes(numbers[sets], 4),
                    _planes(hot[sets], 4),
                    _planes(common, 5),
                    _planes(np.diff(np.r_[np.uint64(0), t]), 5),
                    _planes(o, 4),
                ]
            )
            out_block.append(b)
            out_data.append(np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(out_block, pa.int32()), pa.array(out_data, pa.binary())], ["block", "data"])

    def scan(batches):
        seen: set = set()
        held, base, entries = ([], [], [], []), 0, 0
        for batch in batches:
            for _, data, at in tk.chunks(batch.column("text")):
                value, offsets = shingle_sets(data, at, size)
                ids, number = set_ids(value, offsets), np.diff(offsets)
                use = np.zeros(len(number), bool)
                for i, key in enumerate(ids.tolist()):
                    if number[i] and key not in seen:
                        seen.add(key)
                        use[i] = True
                owner = np.repeat(np.arange(len(number)), number)
                mine = use[owner]
                place = np.cumsum(use) - 1 + base
                for x, y in zip(held, (ids[use], number[use], value[mine], place[owner[mine]])):
                    x.append(y)
                base += int(use.sum())
                entries += int(mine.sum())
                if entries > BUFFER_ENTRIES:
                    yield flush(*held)
                    held, base, entries = ([], [], [], []), 0, 0
        if entries:
            yield flush(*held)

    return scan


def _multiply(percent, common_sets, parts):
    """One block: shared entries per pair of sets, and per set its common entries, packed by part of the first set."""

    def block(rows: pa.Table) -> pa.Table:
        ids, numbers, hots, flagged, tokens, owners, base = [], [], [], [], [], [], 0
        for cell in rows.column("data"):
            raw = cell.as_buffer()
            raw = pa.decompress(raw[8:], int(np.frombuffer(raw[:8], "<i8")[0]), "zstd").to_pybytes()
            k, m, c = np.frombuffer(raw, "<i8", 3)
            at = 24
            ids.append(np.frombuffer(raw, "<u8", k, at))
            at += 8 * k
            for out, n, width in ((numbers, k, 4), (hots, k, 4), (flagged, c, 5), (tokens, m, 5), (owners, m, 4)):
                out.append(_unplanes(raw[at : at + n * width], int(n), width))
                at += n * width
            tokens[-1] = np.cumsum(tokens[-1], dtype=np.uint64)
            owners[-1] = owners[-1] + np.uint64(base)
            base += int(k)
        every, number, hot = np.concatenate(ids), np.concatenate(numbers).astype(np.int64), np.concatenate(hots).astype(np.int64)
        ids, first, group = np.unique(every, return_index=True, return_inverse=True)
        number = number[first]
        lost = np.zeros(len(ids), np.int64)
        np.maximum.at(lost, group, hot)
        flagged = np.unique(np.concatenate(flagged))
        width = _OWNER_BITS
        if len(ids) >= 1 << width:
            raise ValueError("too many sets in a block; use smaller blocks")
        for t, o in zip(tokens, owners):
            t <<= np.uint64(width)
            t |= group[o.astype(np.int64)].astype(np.uint64)
        entry = np.concatenate(tokens)
        del tokens, owners
        entry.sort()
        entry = entry[np.r_[True, entry[1:] != entry[:-1]]] if len(entry) else entry
        owner = (entry & np.uint64((1 << width) - 1)).astype(np.int32)
        entry >>= np.uint64(width)
        token = entry
        head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
        df = np.diff(np.r_[head, len(token)])
        often = (df > common_sets) | np.isin(token[head], flagged)
        lost += np.bincount(owner[np.repeat(often, df)], minlength=len(ids))
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, waiting = [], 0

        def add():
            nonlocal keys, sums, held, waiting
            key, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], sums[:0])
            both = np.r_[keys, key]
            keys, back = np.unique(both, return_inverse=True)
            sums = np.bincount(back, weights=np.r_[sums, n], minlength=len(keys)).astype(np.int64)
            held, waiting = [], 0

        for size in np.unique(df[(df > 1) & ~often]):
            start = head[(df == size) & ~often]
            i, j = np.triu_indices(size, 1)
            step = max(1, 1_000_000 // len(i))
            for s in range(0, len(start), step):
                sets = owner[start[s : s + step, None] + np.arange(size)]
                a, b = sets[:, i].ravel(), sets[:, j].ravel()
                fit = 100 * np.minimum(number[a], number[b]) >= percent * np.maximum(number[a], number[b])
                held.append(a[fit].astype(np.uint64) << np.uint64(width) | b[fit].astype(np.uint64))
                waiting += int(fit.sum())
                if waiting > 4_000_000:
                    add()
        add()
        some = np.flatnonzero(lost)
        a = np.r_[ids[(keys >> np.uint64(width)).astype(np.int64)], ids[some]]
        b = np.r_[ids[(keys & np.uint64((1 << width) - 1)).astype(np.int64)], ids[some]]  # a set with itself: its common entries
        n = np.r_[sums, lost[some]]
        part = (a % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        used = np.flatnonzero(np.diff(cut))
        pick = [order[cut[i] : cut[i + 1]] for i in used]
        return pa.table(
            {
                "part": pa.array(used.astype(np.int32)),
                "a": pa.array([a[x].tobytes() for x in pick], pa.binary()),
                "b": pa.array([b[x].tobytes() for x in pick], pa.binary()),
                "n": pa.array([n[x].astype("<i4").tobytes() for x in pick], pa.binary()),
            }
        )

    return block


def _total(rows: pa.Table) -> pa.Table:
    """The sums of one part over all blocks: a row per pair, and per set (null b) with common entries."""
    a, b = (np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in rows.column(c)]) for c in ("a", "b"))
    n = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("n")])
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order].astype(np.int64)
    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    a, b = a[head], b[head]
    return pa.table({"a": pa.array(a), "b": pa.array(b, mask=a == b), "n": pa.array(np.add.reduceat(n, head))})


def _compare(size, percent):
    """Pairs of texts that reach the threshold."""

    def one(cell, n):
        data = np.frombuffer(pa.decompress(cell.as_buffer(), n.as_py(), "zstd"), np.uint8)
        return shingle_sets(data, np.array([0, len(data)]), size)[0]

    def scan(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("left_text", "left_size", "right_text", "right_size")]
            use = []
            last, kept = None, None
            for i in range(len(batch)):
                key = batch.column("a")[i].as_py()
                if key != last:
                    last, kept = key, one(columns[0][i], columns[1][i])
                other = one(columns[2][i], columns[3][i])
                both = len(np.intersect1d(kept, other, assume_unique=True))
                if 100 * both >= percent * (len(kept) + len(other) - both):
                    use.append(i)
            yield batch.select(["a", "b"]).take(pa.array(use, pa.int64()))

    return scan


def _packed(bits):
    """Texts whose key may be wanted, packed."""

    def scan(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(bits.value, batch.column("short_key").to_numpy())))
            raw = [x.as_buffer() if x.is_valid else pa.py_buffer(b"") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_key"),
                    pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary()),
                    pa.array([x.size for x in raw], pa.int64()),
                ],
                ["text_key", "packed", "size"],
            )

    return scan


def _short_key(key: Column) -> Column:
    return F.xxhash64(key)


class _Texts:
    """The texts of chosen sets, one per set."""

    def __init__(self, docs: DataFrame, text: str, sets: DataFrame):
        self.docs = docs.select(F.col(text).cast("string").alias("text")).select(text_key(F.col("text")).alias("text_key"), "text")
        self.sets = sets

    def of(self, wanted: DataFrame) -> DataFrame:
        """set_id, packed, size for every set_id in ``wanted``."""
        chosen = materialize(self.sets.join(wanted, "set_id", "left_semi").select("set_id", "text_key", _short_key(F.col("text_key")).alias("k")))
        bits = self.docs.sparkSession.sparkContext.broadcast(filter_bits(chosen, "k"))
        texts = self.docs.withColumn("short_key", _short_key(F.col("text_key"))).mapInArrow(
            _packed(bits), "text_key binary, packed binary, size bigint"
        )
        return materialize(
            texts.join(chosen.select("set_id", "text_key"), "text_key")
            .groupBy("set_id")
            .agg(F.any_value("packed").alias("packed"), F.any_value("size").alias("size"))
        )


def _verified(pairs: DataFrame, texts: _Texts, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold."""
    pairs = materialize(pairs)
    packed = texts.of(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct())
    left = packed.select(F.col("set_id").alias("a"), F.col("packed").alias("left_text"), F.col("size").alias("left_size"))
    right = packed.select(F.col("set_id").alias("b"), F.col("packed").alias("right_text"), F.col("size").alias("right_size"))
    return materialize(
        pairs.join(right, "b").join(left, "a").mapInArrow(_compare(size, percent), "a bigint, b bigint")
    )


def _in_rounds(pairs: DataFrame, links: DataFrame, texts: _Texts, size: int, percent: int) -> DataFrame:
    """Links that connect all that the pairs connect: each set with its least partner first, then pairs still apart."""
    pairs = materialize(pairs)
    if pairs.isEmpty():
        return links
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = links.unionByName(_verified(_apart(first, links), texts, size, percent))
    rest = materialize(_apart(pairs.join(first, ["a", "b"], "left_anti"), links))
    if rest.isEmpty():
        return links
    return links.unionByName(_verified(rest, texts, size, percent))


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs whose ends the links do not connect yet."""
    if links.isEmpty():
        return pairs
    place = materialize(components(links))
    at = lambda end: F.coalesce(F.col(f"{end}_place"), F.col(end))
    return (
        pairs.join(place.select(F.col("node").alias("a"), F.col("component").alias("a_place")), "a", "left")
        .join(place.select(F.col("node").alias("b"), F.col("component").alias("b_place")), "b", "left")
        .where(at("a") != at("b"))
        .select("a", "b")
    )


def _sets(size):
    """Packed texts to their sets, as sorted hashes."""

    def scan(batches):
        for batch in batches:
            packed, sizes = batch.column("packed"), batch.column("size")
            rows = []
            for i in range(len(batch)):
                data = np.frombuffer(pa.decompress(packed[i].as_buffer(), sizes[i].as_py(), "zstd"), np.uint8)
                rows.append(shingle_sets(data, np.array([0, len(data)]), size)[0].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(rows, pa.binary())], ["set_id", "entries"])

    return scan


def _lowest(percent):
    """The lowest hashes of each set, as many as a linked set cannot all miss."""

    def scan(batches):
        for batch in batches:
            rows = []
            for cell in batch.column("entries"):
                value = np.frombuffer(cell.as_buffer(), np.int64)
                rows.append(value[: len(value) + (-percent * len(value) // 100) + 1])
            at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_id").take(pa.array(at)), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))],
                ["set_id", "token"],
            )

    return scan


def _connect(percent):
    """What one pair of row blocks connects: each set with the least set it reaches there."""

    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("set_id")
        ids = rows["set_id"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in rows["entries"]]
        n = np.array([len(x) for x in sets])
        value = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        column = np.cumsum(np.r_[True, value[1:] != value[:-1]]) - 1
        use = np.bincount(column)[column] > 1
        column, owner = column[use], owner[use]
        column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            part = slice(*np.searchsorted(column, [low, low + 4096]))
            dense = np.zeros((len(sets), 4096), np.float32)
            dense[owner[part], column[part] - low] = 1
            shared += dense @ dense.T
        shared = np.rint(shared).astype(np.int64)
        link = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
        label = np.arange(len(sets))
        while True:
            after = np.where(link, label[None, :], len(sets)).min(axis=1)
            after = np.minimum(label, after)
            after = np.minimum(after, after[after])
            if (after == label).all():
                break
            label = after
        some = np.flatnonzero(label != np.arange(len(sets)))
        return pa.table({"a": pa.array(ids[label[some]]), "b": pa.array(ids[some])})

    return block


def _crowded_links(crowd: DataFrame, links: DataFrame, texts: _Texts, size: int, percent: int) -> DataFrame:
    """Links among the sets of ``crowd`` (set_id, entries) that connect all their pairs."""
    lists = materialize(crowd.mapInArrow(_lowest(percent), "set_id bigint, token bigint"))
    hubs = lists.groupBy("token").agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).where("a <> z").select("token", "a")
    star = materialize(
        lists.join(materialize(hubs), "token").where("set_id <> a").select("a", F.col("set_id").alias("b")).distinct()
    )
    if star.isEmpty():
        return links
    near = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = links.unionByName(_verified(_apart(near, links), texts, size, percent))
    group = components(star).select(F.col("node").alias("set_id"), F.col("component").alias("g"))
    placed = group
    if not links.isEmpty():
        placed = placed.join(components(links).withColumnRenamed("node", "set_id"), "set_id", "left")
        placed = placed.withColumn("c", F.coalesce("component", "set_id")).drop("component")
    else:
        placed = placed.withColumn("c", F.col("set_id"))
    placed = materialize(placed)
    parts = placed.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m"))
    apart = materialize(parts.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.when(F.col("m") < ROW_BLOCK, F.col("m"))).alias("small")).where("kinds > 1"))
    if apart.isEmpty():
        return links
    # blocks of rows: large components apart, small ones together
    large = F.col("m") >= ROW_BLOCK
    blocks = F.ceil(F.when(large, F.col("m")).otherwise(F.col("small")) / F.lit(float(ROW_BLOCK)))
    members = materialize(
        placed.join(parts, ["g", "c"])
        .join(apart, "g")
        .select(
            "g",
            "set_id",
            F.when(large, F.col("c")).alias("of"),
            F.pmod(F.xxhash64("set_id"), blocks.cast("bigint")).alias("block"),
        )
    )
    name = F.struct(F.coalesce("of", F.lit(-1)).alias("of"), F.col("of").isNull().alias("mixed"), "block")
    named = members.select("g", "set_id", "of", name.alias("name"))
    kinds = named.select("g", "of", "name").distinct()
    pairs = (
        kinds.withColumnsRenamed({"of": "of1", "name": "name1"})
        .join(kinds.withColumnsRenamed({"of": "of2", "name": "name2"}), "g")
        .where((F.col("name1") <= F.col("name2")) & ~F.coalesce(F.col("of1") == F.col("of2"), F.lit(False)))
        .select("g", "name1", "name2")
    )
    ends = pairs.select("g", "name1", "name2", F.col("name1").alias("name")).union(
        pairs.where("name1 <> name2").select("g", "name1", "name2", "name2")
    )
    rows = named.select("g", "set_id", "name").join(materialize(ends), ["g", "name"]).join(crowd, "set_id")
    more = rows.select("g", "name1", "name2", "set_id", "entries").groupBy("g", "name1", "name2").applyInArrow(
        _connect(percent), "a bigint, b bigint"
    )
    return links.unionByName(materialize(more.distinct()))


def set_links(docs: DataFrame, sets: DataFrame, text: str, size: int, percent: int, common: int) -> DataFrame:
    """a, b: links between distinct sets that connect every pair reaching the threshold."""
    needed = F.ceil((F.col("a_n") + F.col("b_n")) * percent / F.lit(100.0 + percent) - F.lit(1e-9))
    entries = sets.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = max(1, math.ceil(entries / BLOCK_ENTRIES))
    body = docs.select(F.col(text).cast("string").alias("text"))
    out = materialize(
        body.mapInArrow(_spread(blocks, size), "block int, data binary")
        .groupBy("block")
        .applyInArrow(_multiply(percent, common, 4 * blocks), "part int, a binary, b binary, n binary")
        .groupBy("part")
        .applyInArrow(_total, "a bigint, b bigint, n bigint")
    )
    lost = out.where("b IS NULL").select(F.col("a").alias("set_id"), F.col("n").alias("common"))
    known = materialize(
        sets.join(lost, "set_id", "left").select("set_id", F.col("n_shingles").alias("n"), F.coalesce("common", F.lit(0)).alias("common"))
    )
    side = lambda end: known.select(F.col("set_id").alias(end), F.col("n").alias(f"{end}_n"), F.col("common").alias(f"{end}_common"))
    judged = materialize(
        out.where("b IS NOT NULL")
        .withColumnRenamed("n", "shared")
        .join(side("a"), "a")
        .join(side("b"), "b")
        .where(F.col("shared") + F.least("a_common", "b_common") >= needed)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("shared") >= needed).alias("sure"))
    )
    texts = _Texts(docs, text, sets)
    links = materialize(judged.where("sure").select("a", "b"))
    links = _in_rounds(_apart(judged.where("NOT sure").select("a", "b"), links), links, texts, size, percent)
    # sets whose uncommon shingles may all be missing in a linked set
    allowed = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0) - F.lit(1e-9))
    crowded = materialize(known.where(F.col("n") - F.col("common") <= allowed).select("set_id"))
    if crowded.isEmpty():
        return links
    crowd = materialize(texts.of(crowded).mapInArrow(_sets(size), "set_id bigint, entries binary"))
    return _crowded_links(crowd, links, texts, size, percent)


def jaccard_groups(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    size: int = SHINGLE,
    percent: int = PERCENT,
    common: int = COMMON,
) -> DataFrame:
    """Rows of ``docs`` without the text, with set_id, n_shingles and component_id.

    Sets of two rows link when 100 * shared >= percent * united; component_id is the
    least id reachable by links.  Null, empty and blank texts have empty sets and link
    with nothing, so they keep their own id.  Texts of fewer than ``size`` words are one
    shingle.  Rows with equal sets are linked whatever their ids.
    """
    rest = [c for c in docs.columns if c not in (text, "set_id", "n_shingles", "component_id")]
    keep = docs.select(*rest, text_key(F.col(text).cast("string")).alias("__text_key"), F.col(text).cast("string").alias("__text"))
    schema = keep.drop("__text").schema.add("set_id", "long").add("n_shingles", "long")
    rows = materialize(keep.mapInArrow(_describe(size), schema))
    sets = materialize(
        rows.where("n_shingles > 0")
        .groupBy("set_id")
        .agg(F.max("n_shingles").alias("n_shingles"), F.min("__text_key").alias("text_key"), F.min(id).alias("least"))
    )
    links = set_links(docs, sets, text, size, percent, common)
    place = components(links) if not links.isEmpty() else sets.limit(0).select(F.col("set_id").alias("node"), F.col("set_id").alias("component"))
    placed = sets.join(place.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "least", F.coalesce("component", "set_id").alias("component")
    )
    placed = materialize(placed)
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    final = materialize(placed.select("set_id", "component").join(named, "component").select("set_id", "component_id"))
    return rows.join(final, "set_id", "left").select(
        *rest, "set_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id)).alias("component_id")
    )


def one_per_group(docs: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs`` whose id is the least of their group; rows with a null id stay."""
    groups = jaccard_groups(docs.select(id, text), text, id, **options)
    gone = materialize(groups.where(F.col(id) != F.col("component_id")).select(F.col(id).alias("__id")).distinct())
    return docs.withColumn("__id", F.col(id)).join(gone, "__id", "left_anti").select(*docs.columns)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")
