"""Array kernels over the bytes of whole texts, run inside Spark tasks.

A batch of texts is one byte buffer with offsets; hashes of any byte range come from
prefix sums of a polynomial modulo 2**64, whose odd base has an inverse, so a range
costs one subtraction and one product.  Texts are worked on in chunks of a few
megabytes (a longer text is a chunk of its own), never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of digits, a-z and every byte of a character beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = True
WORD_BYTES[97:123] = True
WORD_BYTES[128:] = True

#: Words as everything between ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    width = np.int64 if big else np.int32
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes."""
    data, at = buffer_of(column)
    n, row = len(at) - 1, 0
    while row < n:
        last = int(np.searchsorted(at, at[row] + limit, "right")) - 1
        last = min(max(last, row + 1), n)
        yield row, data[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


class Prefix:
    """Hashes of byte ranges of one chunk."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        cls = type(self)
        if len(cls._powers) <= n:
            size = max(n + 1, CHUNK_BYTES + 1)
            grow = np.full(size, BASE)
            grow[0] = 1
            cls._powers = np.multiply.accumulate(grow)
            grow = np.full(size, BASE_INVERSE)
            grow[0] = 1
            cls._inverse = np.multiply.accumulate(grow)
        self.sums = np.zeros(n + 1, np.uint64)
        step = data.astype(np.uint64)
        step += np.uint64(1)
        step *= cls._powers[:n]
        np.cumsum(step, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hash of each [start, end)."""
        out = self.sums[end] - self.sums[start]
        out *= self._inverse[start]
        return out

    def grams(self, k: int) -> np.ndarray:
        """Mixed hash of the k bytes from every position that has them."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.sums[k:] - self.sums[:n]
        out *= self._inverse[:n]
        return mix(out)


def words(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of member bytes; runs end with their text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of lower-cased texts."""
    low = LOWER[data]
    start, end, row = words(low, at, member)
    out = Prefix(low).ranges(start, end)
    out += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out), row


def word_grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of k words from every word on that has k words left in the whole array."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word[:n].copy()
    for j in range(1, k):
        out *= BASE
        out += word[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x
    pad = -len(x) % w
    top = np.iinfo(x.dtype).max
    blocks = np.concatenate([x, np.full(pad, top, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n)


def firsts(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets (n + 1) of each row's items in a sorted row array."""
    return np.searchsorted(row, np.arange(n + 1))
