"""Token counts of a byte-level BPE vocabulary through deterministic transducers.

Two transducers stand for the tokenizer.  The first splits text into pieces by the
classes of its characters (letters, numbers, white space, others); every white-space
character after another kind resets it, so its state map over a chunk is constant and
chunks compose by adding what they emit.  The second reads the bytes of a piece.  Its
state is what the longest tokens still open at this byte need to know: place in the
vocabulary trie, token before it and tokens since.  Each transition carries how many
more tokens the prefix now has, and the count of a piece is their sum.  States and
transitions are compiled as texts need them and shared by all later pieces; pieces
already summed are looked up.

Which token may follow which, and the class of a character, are asked of the
vocabulary's own library once each.
"""

from __future__ import annotations

import json
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webcairn.llm.common import table, textkit as tk

VOCABULARY = "byte_bpe_50k.json"
MOST_TOKENS = 1024
#: Pieces and states that a task keeps compiled; past it the tables start anew.
KEPT_PIECES = 1_000_000
KEPT_STATES = 250_000
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + extra)
            extra += 1
    return [names[b] for b in range(256)]


class PieceTransducer:
    """Bytes of a piece in, number of tokens out."""

    def __init__(self, model, vocabulary: dict[str, int]):
        self.model = model
        self.names = byte_names()
        back = {c: b for b, c in enumerate(self.names)}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[str | None] = [None]
        for word in vocabulary:
            if any(c not in back for c in word):
                continue  # a special string, never part of a piece
            node = 0
            for b in (back[c] for c in word):
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                node = self.child[node][b]
            self.token[node] = word
        self.follows: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, "", 0),)
        self.number = {start: 0}
        self.states = [start]
        self.moves: dict[int, int] = {}  # (state, byte) to (next state, tokens emitted)

    def may_follow(self, left: str, right: str) -> bool:
        key = (left, right)
        if key not in self.follows:
            if len(self.follows) > KEPT_PIECES:
                self.follows.clear()
            got = [t.value for t in self.model.tokenize(left + right)]
            self.follows[key] = got == ([left, right] if left else [right])
        return self.follows[key]

    def compile(self, state: int, byte: int) -> int:
        """The transition of a state on a byte: next state and tokens emitted."""
        grown, emitted, last = [], None, None
        for node, before, since in self.states[state]:
            node = self.child[node].get(byte)
            if node is None:
                continue
            grown.append((node, before, since))
            token = self.token[node]
            if emitted is None and token is not None and self.may_follow(before, token):
                emitted, last = since + 1, token
        if emitted is None:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        after = tuple((n, b, s - emitted) for n, b, s in grown if self.child[n]) + ((0, last, 0),)
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        move = self.number[after] << 9 | emitted + 256  # a longer prefix may have fewer tokens
        self.moves[state << 8 | byte] = move
        return move

    def count(self, piece: bytes) -> int:
        if len(self.states) > KEPT_STATES:
            self.reset()
        state = total = 0
        moves = self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self.compile(state, byte)
            state = move >> 9
            total += (move & 511) - 256
        return total


class Compiled:
    """Both transducers of a vocabulary file, with what they have learnt so far."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without prefix space or normalizer is compiled")
        self.library = Tokenizer.from_str(source)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.pieces = PieceTransducer(self.library.model, spec["model"]["vocab"])
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.known: dict[int, int] = {}

    def _classify(self, code: int) -> int:
        one = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s)) == 1
        c = chr(code)
        return LETTER if one("a" + c) else NUMBER if one("1" + c) else OTHER if one("!" + c) else SPACE

    def _segments(self, data, at):
        """Bounds of texts cut at special strings, each segment's row and whether it is special."""
        raw = data.tobytes()
        found = []
        for word in self.special:
            i = raw.find(word)
            while i >= 0:
                row = int(np.searchsorted(at, i, "right")) - 1
                if i + len(word) <= at[row + 1]:
                    found.append((i, i + len(word)))
                    i = raw.find(word, i + len(word))
                else:
                    i = raw.find(word, i + 1)
        cuts = np.unique(np.r_[at, [x for pair in found for x in pair]]).astype(np.int64)
        return cuts, found

    def boundaries(self, data, cuts):
        """Start and end bytes of all pieces; every cut starts a piece."""
        text = data.tobytes().decode("utf-8", "replace")
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        place = np.zeros(len(code) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        kind = self.kind[code]
        if (kind == UNKNOWN).any():
            for c in np.unique(code[kind == UNKNOWN]):
                self.kind[c] = self._classify(int(c))
            kind = self.kind[code]
        edge = np.zeros(len(code) + 1, bool)
        edge[np.searchsorted(place, cuts)] = True
        change = edge[:-1].copy()
        change[0] = True
        change[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(change)
        end = np.r_[start[1:], len(code)]
        of = kind[start]
        last = edge[end]  # the run ends its text
        space = of == SPACE
        plain = code[end - 1] == 32
        joins = space & ~last & plain  # its last blank goes with what follows
        after = np.zeros(len(start), bool)
        after[1:] = joins[:-1]
        a, b = start - after, end.copy()
        # apostrophe and a fixed ending
        quote = np.flatnonzero((of == OTHER) & (end - start == 1) & (code[start] == 39) & ~after & ~last)
        quote = quote[of[quote + 1] == LETTER] if len(quote) else quote
        if len(quote):
            one = code[end[quote]]
            two = np.where(end[quote + 1] - end[quote] > 1, code[np.minimum(end[quote] + 1, len(code) - 1)], 0)
            ends = lambda x, y: (one == ord(x)) & (two == ord(y))
            long = ends("r", "e") | ends("v", "e") | ends("l", "l")
            size = np.where(long, 2, np.isin(one, [ord(x) for x in "stmd"]).astype(np.int64))
            b[quote] = end[quote] + size
            a[quote + 1] = b[quote]
        # white space: all but its last character, then that one unless it joins
        head = space & ~last & (end - start > 1)
        b = np.where(space & ~last, end - 1, b)
        keep = np.where(space & ~last, head, b > a)
        tail = np.flatnonzero(space & ~last & ~plain)
        s = np.r_[a[keep], end[tail] - 1]
        e = np.r_[b[keep], end[tail]]
        return place[s], place[e]

    def rows(self, data, at):
        """Tokens of every text of a chunk."""
        n = len(at) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        cuts, special = self._segments(data, at)
        start, end = self.boundaries(data, cuts)
        hashes = tk.Prefix(data).ranges(start, end)
        hashes += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        value, first, back = np.unique(tk.mix(hashes), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        known, count = self.known, self.pieces.count
        number = np.empty(len(value), np.int64)
        raw = data.tobytes()
        for i, (key, s, e) in enumerate(zip(value.tolist(), start[first].tolist(), end[first].tolist())):
            got = known.get(key)
            if got is None:
                got = known[key] = count(raw[s:e])
            number[i] = got
        each = number[back]
        if special:
            for s, e in special:
                each[(start >= s) & (start < e)] = 0
        row = np.searchsorted(at, start, "right") - 1
        total = np.bincount(row, weights=each, minlength=n).astype(np.int64)
        for s, _ in special:
            total[int(np.searchsorted(at, s, "right")) - 1] += 1
        return total


def compiled(source: str) -> Compiled:
    """The transducers of a vocabulary, kept by a worker from task to task."""
    shelf = sys.modules.setdefault("_webcairn_compiled", types.ModuleType("_webcairn_compiled"))
    name = f"v{hash(source)}"
    if not hasattr(shelf, name):
        setattr(shelf, name, Compiled(source))
    return getattr(shelf, name)


def _count(source):
    def scan(batches):
        machine = compiled(source.value)
        for batch in batches:
            size, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, data, at in tk.chunks(batch.column("__text")):
                size.append(np.diff(at))
                tokens.append(machine.rows(data, at))
            names = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(np.concatenate(size)), pa.array(np.concatenate(tokens))],
                [*names, "n_bytes", "n_tokens"],
            )

    return scan


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", most: int = MOST_TOKENS) -> DataFrame:
    """Rows of ``docs`` without the text, with n_bytes, n_tokens and over_limit (more than ``most``).

    ``vocabulary`` is the path of the tokenizer file on the driver; its content, of
    fixed size, goes to the tasks.  Null text is empty and has no tokens.  Columns of
    the same names are replaced.
    """
    with open(vocabulary, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*rest, F.col(text).cast("string").alias("__text"))
    schema = rows.select(*rest).schema.add("n_bytes", "long").add("n_tokens", "long")
    return rows.mapInArrow(_count(source), schema).withColumn("over_limit", F.col("n_tokens") > most)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY))
