"""SentencePiece (BPE) ids of whole texts through a table of prefixes, and texts from ids.

The encoding of a text is a row of tokens in which every two neighbours are compatible: the
two alone encode to themselves.  The encoding of a prefix of it ends in one token only, and
the prefix left of that token is encoded in the same way.  So a table holds one token for
each prefix: of the vocabulary's tokens that end there, found by an Aho-Corasick automaton,
the one that is compatible with the token stored where it starts.  Walking the table
backwards from the end gives the ids.  Merging is plain only inside the test of two
neighbours, whose results are kept: the pair of the best score is merged first, the leftmost
of equals; a character is a token even when the vocabulary lacks it and becomes byte pieces.

No piece goes from another character to a space after it (checked when the model is read),
so a text falls into spaces plus what follows them; equal parts of a chunk are encoded once,
short ones are kept.  A part without spaces may be of any length, its table is linear.

Only models with byte fallback and without normalisation or own symbols are compiled; others
raise.  Null text is empty: only the begin and end ids.  The other columns of the input stay, save
those of the names given to the output.  Rows stand alone, so repeated rows and ties get equal
results and an empty table an empty one.
"""

from __future__ import annotations

import heapq
import math
import struct
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webcairn.llm.common import table, textkit as tk

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Parts and pairs a task keeps; past it the tables start anew.  Longer parts are not kept.
KEPT, KEPT_BYTES = 400_000, 64


class Pieces:
    """A compiled model file."""

    def __init__(self, source: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(source)
        kinds = {p.type for p in model.pieces}
        rule, spec = model.normalizer_spec, model.trainer_spec
        if spec.model_type != spec.BPE or not spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and plain pieces are compiled")
        if rule.precompiled_charsmap or not rule.add_dummy_prefix or rule.remove_extra_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation, with a space put first, are compiled")
        self.ids, self.score, self.bytes = {}, {}, {}
        self.kind = np.array([p.type for p in model.pieces], np.uint8)
        self.raw = []
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                if any(a != SPACE and b == SPACE for a, b in zip(p.piece, p.piece[1:])):
                    raise ValueError(f"piece {p.piece!r} goes on past the end of a word")
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.raw.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.raw.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.raw.append(b"" if p.type == CONTROL else spec.unk_surface.encode())
        self.begin, self.end = spec.bos_id, spec.eos_id
        self.automaton = None
        #: Tokens that encode to themselves or not, and the last merge of each.
        self.own: dict[str, bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.misses = 0
        self.known: dict[bytes, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first and leftmost of equals; for a token or two."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = []

        def offer(i, j):
            if i >= 0 and j < len(part):
                score = self.score.get(part[i] + part[j])
                if score is not None:
                    heapq.heappush(heap, (-score, i, j, part[i] + part[j]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if not part[i] or after[i] != j or part[i] + part[j] != whole:
                continue
            self.halves[whole] = part[i], part[j]
            part[i], part[j] = whole, ""
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in part if p]

    def _whole(self, token: str) -> bool:
        """Does the token encode to itself?  ``halves`` then holds its last merge."""
        if token not in self.own:
            self.own[token] = self.merged(token) == [token]
        return self.own[token]

    def compatible(self, left: str, right: str) -> bool:
        """Do the two tokens alone encode to themselves?

        Merges are undone from the latest on: a pair that meets across the border would
        have been merged if it is better than the merge that has just been undone.
        """
        if not left or left[-1] == SPACE:  # pieces of spaces share one score, so their merges have no fixed halves
            return self._whole(right) if not left else self.merged(left + right) == [left, right]
        if not self._whole(right):
            return False
        score, halves = self.score, self.halves
        limit, equal = -math.inf, False
        while True:
            pair = score.get(left + right)
            if pair is not None and (pair > limit or (equal and pair == limit)):
                return False
            a = score[left] if len(left) > 1 else math.inf
            b = score[right] if len(right) > 1 else math.inf
            if a < b:
                limit, equal, left = a, False, halves[left][1]
            elif len(right) > 1:
                limit, equal, right = b, True, halves[right][0]
            else:
                return True

    def _miss(self, left: str, right: str, held: dict[str, bool]) -> bool:
        self.misses += 1
        if self.misses > KEPT:
            self.misses = 0
            for _, _, other in self.automaton.values():
                other.clear()
        held[left] = got = self.compatible(left, right)
        return got

    def tokens(self, text: str) -> list[str]:
        """The last token of every prefix, then the tokens from the end backwards."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for piece in self.ids:  # with the tokens it was tested behind
                self.automaton.add_word(piece, (piece, len(piece), {}))
            self.automaton.make_automaton()
        last = ["", *text]  # a character without a piece stands for itself
        found = -1
        for at, (piece, size, held) in self.automaton.iter(text):
            if at != found:
                left = last[at + 1 - size]
                fits = held.get(left)
                if fits is None:
                    fits = self._miss(left, piece, held)
                if fits:
                    last[at + 1], found = piece, at
        out, at = [], len(text)
        while at:
            piece = last[at]
            out.append(piece)
            at -= len(piece)
        out.reverse()
        return out

    def encode_part(self, part: bytes) -> bytes:
        got = self.known.get(part)
        if got is None:
            out, ids = [], self.ids
            for token in self.tokens(part.decode().replace(" ", SPACE)):
                if token in ids:
                    out.append(ids[token])
                else:
                    out.extend(self.bytes[b] for b in token.encode())
            got = struct.pack(f"<{len(out)}I", *out)
            if len(part) <= KEPT_BYTES:
                if len(self.known) > KEPT:
                    self.known.clear()
                self.known[part] = got
        return got

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, with begin and end."""
        lines = [b" " + t.replace(SPACE, " ").encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(lines), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(data))[: len(start)]
        ids, size = np.zeros(0, np.uint32), np.zeros(len(start) + 1, np.int64)
        if len(start):
            name = tk.Prefix(data).ranges(start, end) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            _, shown, back = np.unique(tk.mix(name), return_index=True, return_inverse=True)
            raw = data.tobytes()
            found = [self.encode_part(raw[s:e]) for s, e in zip(start[shown].tolist(), end[shown].tolist())]
            each = np.array([len(f) >> 2 for f in found], np.int64)
            place = np.concatenate([[0], np.cumsum(each)])[:-1]
            each = each[back]
            np.cumsum(each, out=size[1:])
            ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(place[back] - size[:-1], each) + np.arange(size[-1])]
        cut = size[np.searchsorted(start, at)]
        ends = np.array([self.begin, self.end], np.uint32)
        return [np.concatenate([ends[:1], ids[a:b], ends[1:]]) for a, b in zip(cut[:-1], cut[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, bytes read as UTF-8, the space put first taken off."""
        held = ids.tolist()
        parts = [self.raw[i] for i in held]
        spoken = np.flatnonzero(self.kind[ids] != CONTROL)
        if len(spoken) and self.kind[held[spoken[0]]] == NORMAL and parts[spoken[0]].startswith(b" "):
            parts[spoken[0]] = parts[spoken[0]][1:]
        kind = self.kind[ids]
        if not (kind[1:-1] == CONTROL).any():
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        # bytes on both sides of a control id do not belong together
        cut = np.flatnonzero((kind[1:] == BYTE) != (kind[:-1] == BYTE)) + 1
        runs = zip([0, *cut.tolist()], [*cut.tolist(), len(parts)])
        return "".join(_characters(b"".join(parts[a:b])) for a, b in runs)


def _characters(raw: bytes) -> str:
    """Bytes as UTF-8; each byte that starts no character is one replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            out.append(raw[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("\ufffd")
            at += 1
    return "".join(out)


def compiled(source: bytes) -> Pieces:
    """A model's tables, kept by a worker from task to task."""
    shelf = sys.modules.setdefault("_webcairn_compiled", types.ModuleType("_webcairn_compiled"))
    name = f"p{hash(source)}"
    if not hasattr(shelf, name):
        setattr(shelf, name, Pieces(source))
    return getattr(shelf, name)


def _groups(column: pa.Array, limit: int = tk.CHUNK_BYTES):
    """Runs of rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    _, at = tk.buffer_of(column)
    row, n = 0, len(column)
    while row < n:
        last = min(max(int(np.searchsorted(at, at[row] + limit, "right")) - 1, row + 1), n)
        yield row, last
        row = last


def _encode(source, text, added):
    def scan(batches):
        model = compiled(source.value)
        for batch in batches:
            names = [c for c in batch.schema.names if c != text]
            texts = batch.column(text)
            for a, b in _groups(texts):
                ids = model.encode(texts.slice(a, b - a).to_pylist())
                size = pa.array([len(i) for i in ids], pa.int64())
                packed = pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), size, packed], [*names, *added])

    return scan


def _decode(source, ids, text):
    def scan(batches):
        model = compiled(source.value)
        for batch in batches:
            names = [c for c in batch.schema.names if c != text]
            texts = [None if i is None else model.decode(np.frombuffer(i, "<u4")) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, text])

    return scan


def _source(spark, model: str):
    with open(model, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Rows without the text, with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers, begin and end included).

    ``model`` is a path on the driver; the file's content, of fixed size, goes to the tasks.
    """
    rest = [c for c in docs.columns if c not in (text, ids, n_tokens)]
    rows = docs.select(*rest, F.col(text).cast("string").alias(text))
    schema = rows.select(*rest).schema.add(n_tokens, "long").add(ids, "binary")
    return rows.mapInArrow(_encode(_source(docs.sparkSession, model), text, (n_tokens, ids)), schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Rows with the ``text`` of their ``ids``; null ids give null, an id outside the vocabulary raises."""
    held = rows.drop(text)
    return held.mapInArrow(_decode(_source(rows.sparkSession, model), ids, text), rows.drop(text).schema.add(text, "string"))


def op12_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path(MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(docs, model), model).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
