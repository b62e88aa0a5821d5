"""Ranked search over a K2-treap of the term-document grid.

Documents come in blocks; a block is a grid of its distinct terms (rows, most frequent
first) by its documents (columns, those with the same commonest term side by side).  Points
are the integer impacts of a term in a document, sorted along the Z-curve.  A quadtree over
them stores for every cell with two points or more the greatest impact inside; a cell with
one point is that point, so empty ground and single paths cost nothing.  The index holds every
document and every term and is one Parquet table; a block is a row of it, packed before it
leaves the worker and opened alone, so a task holds about one block at a time.

An item searches a block by ranges of documents.  In a range each of its terms is at one
cell of its row's path; the sum of term weight times cell maximum bounds every score
in the range.  Ranges are opened best bound first, a few at a time: all paths go down one
level into both halves.  A range of one document has its exact score.  Ranges below the item's
``k``-th score so far, kept from block to block of a task, are dropped; equal bounds are opened,
so ties are decided by document id and nothing is lost.

Terms are named by 64-bit hashes.  Items meet all blocks in groups of a bounded number
of terms, each group broadcast and run over the whole index.  Null texts have no terms:
they count nowhere and match nothing.  Document ids are integers, nulls last among ties;
rows with equal ids are documents of their own, items with equal ids are searched each.  Other
columns are ignored, whatever their names.  Empty tables give no rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from webcairn.llm.common import materialize, small_batches, table, textkit as tk
from webcairn.session import checkpoint_dir

#: A block ends at this many documents or points; a longer document is a block alone.
BLOCK_DOCS, BLOCK_POINTS = 1 << 12, 1 << 19
#: Most terms of the items that are searched together; one longer item goes alone.
ITEM_TERMS = 1 << 18
#: Ranges opened at a time.
WIDE = 256
TOP = 10
#: Bytes after which a row group of the index ends; a longer block is a row group alone.
ROW_GROUP = 1 << 20
LEVEL = np.int64(56)
#: Stands for a null id.
LAST = np.iinfo(np.int64).max


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 28-bit numbers moved to the even places."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & mask
    return x


def _terms(data: np.ndarray, at: np.ndarray):
    """row, term and occurrences of every distinct (row, term) of a chunk."""
    word, row = tk.word_hashes(data, at, tk.WORD_BYTES)
    order = np.lexsort((word, row))
    word, row = word[order], row[order]
    first = np.ones(len(word), bool)
    first[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    return row[start], word[start], np.diff(np.append(start, len(word)))


def _sizes(text):
    def scan(batches):
        for batch in batches:
            docs = words = 0
            for _, data, at in tk.chunks(batch.column(text)):
                n = tk.counts(tk.words(tk.LOWER[data], at, tk.WORD_BYTES)[2], len(at) - 1)
                docs, words = docs + int((n > 0).sum()), words + int(n.sum())
            yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "words": pa.array([words], pa.int64())})

    return scan


def _cells(points: np.ndarray, n_docs: int):
    """By level: codes of the cells with points, where each starts, and which hold two points or more."""
    for level in range(1, max(n_docs - 1, 1).bit_length() + 1):
        code = points >> (2 * level)
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        yield code[start] | (np.int64(level) << LEVEL), start, np.diff(np.append(start, len(code))) > 1


INDEX = "ids binary, nulls binary, terms binary, rows binary, df binary, points binary, impact binary, peak binary"


def _pack(x: np.ndarray, kind: str) -> bytes:
    """An array as bytes: its size, then what zstd makes of it."""
    raw = x.astype(kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpack(cell: pa.BinaryScalar, kind: str) -> np.ndarray:
    raw = cell.as_buffer()
    size = int.from_bytes(raw[:8].to_pybytes(), "little")
    return np.frombuffer(pa.Codec("zstd").decompress(raw[8:], size), kind)


def build_block(ids: list, size: np.ndarray, col: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_words: int) -> list:
    """The index row of one block: ids and lengths by document, its (document, term, count) points by document."""
    # documents with the same commonest term side by side, shorter ones first
    start = np.searchsorted(col, np.arange(len(ids)))
    common = np.zeros(len(ids), np.uint64)
    by = np.lexsort((term, -tf, col))
    held = np.flatnonzero(size)
    common[held] = term[by[start[held]]]
    order = np.lexsort((size, common))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    col = place[col]
    del by
    # terms: those in most documents first, so rare ones share cells with rare ones
    terms, back, df = np.unique(term, return_inverse=True, return_counts=True)
    row = np.empty(len(terms), np.int64)
    row[np.argsort(-df, kind="stable")] = np.arange(len(terms))
    damp = 10 + (90 * size[order] * n_docs) // max(n_words, 1)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * damp[col])
    points = _spread(row[back]) << 1 | _spread(col)
    del back, col, tf
    by = np.argsort(points)
    points, impact = points[by], impact[by].astype(np.uint32)
    del by
    peak = [np.maximum.reduceat(impact, start)[many] for _, start, many in _cells(points, len(ids))]
    null = np.array([ids[i] is None for i in order.tolist()])
    return [
        _pack(np.array([LAST if ids[i] is None else ids[i] for i in order.tolist()], np.int64), "<i8"),
        _pack(null, "?"),
        _pack(terms, "<u8"),
        _pack(row, "<u4"),
        _pack(df, "<u4"),
        _pack(np.diff(points, prepend=0), "<i8"),
        _pack(impact, "<u4"),
        _pack(np.concatenate(peak), "<u4"),
    ]


def _build(text, n_docs, n_words):
    def scan(batches):
        ids, size, parts, points = [], [], [], 0

        def flush():
            nonlocal ids, size, parts, points
            held, sizes, pieces = ids, np.array(size, np.int64), list(zip(*parts))
            ids, size, parts, points = [], [], [], 0
            col, term, tf = (np.concatenate(pieces.pop(0)) for _ in range(3))
            row = build_block(held, sizes, col, term, tf, n_docs, n_words)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], [f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            name = batch.column("__id").to_pylist()
            for first, data, at in tk.chunks(batch.column(text)):
                n = len(at) - 1
                row, term, tf = _terms(data, at)
                words = np.bincount(row, weights=tf, minlength=n).astype(np.int64)
                cut = tk.firsts(row, n)
                doc = 0
                while doc < n:  # as many documents as the block still takes, at least one
                    room = int(np.searchsorted(cut, cut[doc] + max(BLOCK_POINTS - points, 0), "right")) - 1
                    last = min(max(room, doc + (not ids)), doc + BLOCK_DOCS - len(ids), n)
                    if last > doc:
                        a, b = cut[doc], cut[last]
                        parts.append((row[a:b] - doc + len(ids), term[a:b], tf[a:b]))
                        ids += name[first + doc : first + last]
                        size += words[doc:last].tolist()
                        points += int(b - a)
                        doc = last
                    if ids and (doc < n or len(ids) >= BLOCK_DOCS or points >= BLOCK_POINTS):
                        if points:
                            yield flush()
                        ids, size, parts, points = [], [], [], 0
        if points:
            yield flush()

    return scan


class Index:
    """The blocks of a table of documents, with the number of documents that have terms and of all terms."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"))
        totals = rows.select("__text").mapInArrow(_sizes("__text"), "docs bigint, words bigint")
        totals = totals.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)))
        spark, path = docs.sparkSession, f"{checkpoint_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}"
        with small_batches(spark):
            self.n_docs, self.n_words = totals.first()
            blocks = rows.mapInArrow(_build("__text", self.n_docs, self.n_words), INDEX).write
            # rows are megabytes: sizes are looked at after every row (by default after 100), so few are in memory at a time
            often = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
            blocks.options(**often, **{"parquet.block.size": ROW_GROUP, "parquet.enable.dictionary": False, "compression": "none"}).parquet(path)
        self.blocks = spark.read.schema(INDEX).parquet(path)

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        """Documents that hold each of the (sorted, distinct) terms."""
        sent = self.blocks.sparkSession.sparkContext.broadcast(terms)

        def scan(batches):
            wanted, total = sent.value, None
            for batch in batches:
                total = np.zeros(len(wanted), np.int64) if total is None else total
                for held, df in zip(batch.column("terms"), batch.column("df")):
                    held, df = _unpack(held, "<u8"), _unpack(df, "<u4")
                    at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                    total += np.where(held[at] == wanted, df[at], 0)
            if total is not None:
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"number": some, "df": total[some]})

        counted = self.blocks.select("terms", "df").mapInArrow(scan, "number bigint, df bigint")
        with small_batches(self.blocks.sparkSession):
            got = counted.groupBy("number").agg(F.sum("df").alias("df")).toArrow()
        out = np.zeros(len(terms), np.int64)
        out[got["number"].to_numpy()] = got["df"].to_numpy()
        return out

    def weights(self, terms: np.ndarray) -> np.ndarray:
        most = 2 * self.n_docs + 2
        return np.array([math.floor(1000 * math.log(most / (2 * df + 1))) for df in self.frequencies(terms).tolist()], np.int64)


class Block:
    """One index row, opened for searching."""

    def __init__(self, batch, i):
        read = lambda name, kind: _unpack(batch.column(name)[i], kind)
        self.ids, self.null = read("ids", "<i8"), read("nulls", "?")
        self.terms, self.rows = read("terms", "<u8"), read("rows", "<u4").astype(np.int64)
        self.points, self.impact = np.cumsum(read("points", "<i8")), read("impact", "<u4")
        cells = np.concatenate([code[many] for code, _, many in _cells(self.points, len(self.ids))])
        peak = read("peak", "<u4")
        self.top = max(len(self.ids) - 1, 1).bit_length()
        self.n, self.cells = len(cells), cells
        #: Greatest impact by reference: cells, then points, and nothing for -1.
        self.peaks = np.concatenate([peak, self.impact, [0]]).astype(np.int64)
        level, code = cells >> LEVEL, cells & ((1 << LEVEL) - 1)
        self.children = np.full((self.n + 1, 4), -1, np.int32)
        inner = np.flatnonzero(level < self.top)
        self._link(code[inner] >> 2, level[inner] + 1, code[inner] & 3, inner)
        # a point hangs below the smallest cell it shares with the point before or behind it
        shared = np.full(len(self.points) + 1, self.top + 1, np.int64)
        shared[1:-1] = (np.frexp((self.points[1:] ^ self.points[:-1]).astype(np.float64))[1] + 1) >> 1
        under = np.minimum(shared[1:], shared[:-1])
        low = np.flatnonzero(under <= self.top)
        under = under[low]
        self._link(self.points[low] >> 2 * under, under, self.points[low] >> 2 * (under - 1) & 3, self.n + low)

    def _link(self, code, level, quarter, child) -> None:
        self.children[np.searchsorted(self.cells, code | (level << LEVEL)), quarter] = child

    def roots(self, row: np.ndarray) -> np.ndarray:
        """Reference of the cell or point that holds each row in the range of all documents; -1 where it is empty."""
        code = _spread(row >> self.top) << 1
        at = np.minimum(np.searchsorted(self.points, code << (2 * self.top)), len(self.points) - 1)
        out = np.where(self.points[at] >> (2 * self.top) == code, self.n + at, -1)
        if self.n:
            key = code | (self.top << LEVEL)
            cell = np.minimum(np.searchsorted(self.cells, key), self.n - 1)
            out = np.where(self.cells[cell] == key, cell, out)
        return out

    def below(self, ref: np.ndarray, level: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """References one level down, at ``level``, on the path of a row into a range of documents."""
        quarter = (row >> level & 1) << 1 | (col & 1)
        point = self.points[np.maximum(ref - self.n, 0)] >> 2 * level & 3
        return np.where(ref < self.n, self.children[np.minimum(ref, self.n), quarter], np.where(point == quarter, ref, -1))

    def search(self, terms: np.ndarray, weight: np.ndarray, best: "Best") -> None:
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = (self.terms[at] == terms) & (weight > 0)
        row, weight = self.rows[at[held]], weight[held]
        if not len(row):
            return
        level, col = np.array([self.top]), np.zeros(1, np.int64)
        refs = self.roots(row)[None, :]
        bound = self.peaks[refs] @ weight
        while True:
            keep = (bound >= best.least) & (bound > 0)
            level, col, refs, bound = level[keep], col[keep], refs[keep], bound[keep]
            if not len(bound):
                return
            opened = np.argpartition(-bound, WIDE)[:WIDE] if len(bound) > WIDE else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[opened] = False
            # both halves of every opened range, on the paths that still hold something
            half_level = np.repeat(level[opened] - 1, 2)
            half_col = np.repeat(col[opened] << 1, 2)
            half_col[1::2] += 1
            half = np.repeat(refs[opened], 2, axis=0)
            entry, path = np.nonzero(half >= 0)
            half[entry, path] = self.below(half[entry, path], half_level[entry], row[path], half_col[entry])
            total = self.peaks[half] @ weight
            done = half_level == 0
            exact = done & (total > 0)
            if exact.any():
                at = half_col[exact]
                best.add(total[exact], self.ids[at], self.null[at])
            go = ~done
            level = np.concatenate([level[rest], half_level[go]])
            col = np.concatenate([col[rest], half_col[go]])
            refs = np.concatenate([refs[rest], half[go]])
            bound = np.concatenate([bound[rest], total[go]])


class Best:
    """The ``k`` best documents of an item so far: highest score, then least id, null ids last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score, ids, null) -> None:
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def _item_terms(batches):
    for batch in batches:
        lists = []
        for _, data, at in tk.chunks(batch.column("text")):
            row, term, _ = _terms(data, at)
            cut = tk.firsts(row, len(at) - 1)
            lists += [term[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("number"), pa.array(lists, pa.binary()), pa.array([len(x) // 8 for x in lists], pa.int64())],
            ["number", "terms", "size"],
        )


def _search(items, k):
    def scan(batches):
        best = None
        for batch in batches:
            best = best or [Best(k) for _ in items.value]
            for i in range(batch.num_rows):
                block = Block(batch, i)
                for (_, terms, weight), so_far in zip(items.value, best):
                    block.search(terms, weight, so_far)
                del block
        found = [(n, b) for (n, _, _), b in zip(items.value, best or []) if len(b.score)]
        if found:
            ids = np.concatenate([b.ids for _, b in found])
            null = np.concatenate([b.null for _, b in found])
            yield pa.RecordBatch.from_pydict(
                {
                    "number": np.repeat(np.array([n for n, _ in found], np.int64), [len(b.score) for _, b in found]),
                    "doc_id": pa.array(ids, pa.int64(), mask=null),
                    "score": np.concatenate([b.score for _, b in found]),
                }
            )

    return scan


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item."""
    spark = items.sparkSession
    numbered = materialize(
        items.select(
            F.monotonically_increasing_id().alias("number"), F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")
        )
    )
    asked = materialize(numbered.select("number", "text").mapInArrow(_item_terms, "number bigint, terms binary, size bigint"))
    total = asked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = max(1, -(-2 * total // ITEM_TERMS))
    asked = asked.where("size > 0").withColumn("part", F.pmod(F.xxhash64("number"), F.lit(groups)))
    schema = "number bigint, doc_id bigint, score bigint"
    found = spark.createDataFrame([], schema)
    for part in range(groups):
        held = asked.where(F.col("part") == part)
        size = held.agg(F.sum("size"), F.count(F.lit(1))).first()
        if size[1] > 1 and size[0] > ITEM_TERMS:
            raise ValueError(f"group {part} of the items has {size[0]} terms; raise the number of groups")
        rows = [(r.number, np.frombuffer(r.terms, "<u8")) for r in held.select("number", "terms").collect()]
        if not rows or not index.n_words:
            continue
        every = np.unique(np.concatenate([t for _, t in rows]))
        weight = index.weights(every)
        sent = spark.sparkContext.broadcast([(n, t, weight[np.searchsorted(every, t)]) for n, t in rows])
        with small_batches(spark):
            found = found.unionByName(materialize(index.blocks.mapInArrow(_search(sent, k), schema)))
    w = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("number", "item_id"), "number").select(F.col("item_id").alias(item_id), "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    index = Index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS held
  FROM documents WHERE text IS NOT NULL
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(held)) AS BIGINT) AS n_words FROM words WHERE len(held) > 0
), points AS (
  SELECT doc, any_value(doc_id) AS doc_id, any_value(len(held)) AS size, term, count(*) AS tf
  FROM words, unnest(held) AS u(term) GROUP BY doc, term
), asked AS (
  SELECT DISTINCT item, item_id, term FROM (
    SELECT row_number() OVER () AS item, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL)
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM points, totals GROUP BY term
), scores AS (
  SELECT item, any_value(item_id) AS item_id, doc, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * n_docs) // n_words)))) AS BIGINT) AS score
  FROM asked JOIN points USING (term) JOIN weights USING (term), totals GROUP BY item, doc
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0
) WHERE rank <= 10
"""
