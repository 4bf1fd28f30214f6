"""Words, spans and hashes of whole Arrow string batches with numpy: no Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one step of numpy works on; its arrays take some hundred times that.
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = np.zeros((2, 0), U64)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _places(n: int) -> np.ndarray:
    """Random factors of the first n places of a span, one row for each of two independent hashes."""
    global _PLACE
    if _PLACE.shape[1] < n:
        at = np.arange(1 << max(10, (n - 1).bit_length()), dtype=np.uint64)
        with np.errstate(over="ignore"):
            _PLACE = np.stack([mix64(mix64(at * U64(0x9E3779B97F4A7C15) + _COEF[60 + k]) + _COEF[62 + k]) | U64(1) for k in range(2)])
    return _PLACE


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of values[a:b] for each span: every place of a span has a random factor of its own (multilinear hashing), so
    unlike a polynomial in one base no family of inputs, however regular, collides more often than by chance."""
    size = ends - starts
    to = np.cumsum(size)
    begin = to - size
    total = int(to[-1]) if len(to) else 0
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    at = np.arange(total, dtype=kind)
    place = _places(int(size.max(initial=0)))[which]
    with np.errstate(over="ignore"):
        sums = np.zeros(total + 1, U64)
        np.cumsum(place[at - np.repeat(begin.astype(kind), size)] * values[at + np.repeat((starts - begin).astype(kind), size)], out=sums[1:])
        return mix64(sums[to] - sums[begin] + size.astype(U64) * _COEF[58 + which])


class Texts:
    """Some rows of a string column: bytes laid end to end, and where each row begins. Nulls read as empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        if column.null_count:
            sizes = np.diff(off)
            sizes[column.is_null().to_numpy(zero_copy_only=False)] = 0
            raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
            keep = [raw[a : a + k] for a, k in zip(off[:-1].tolist(), sizes.tolist(), strict=True)]
            self.data = np.concatenate([*keep, np.zeros(0, np.uint8)])
            self.off = np.r_[0, np.cumsum(sizes)]
        else:
            total = int(off[-1] - off[0])
            self.data = np.frombuffer(data, np.uint8, total, int(off[0])) if total else np.zeros(0, np.uint8)
            self.off = off - off[0]
        if lower:
            self.data = _LOWER[self.data]
        self.n = n

    def row(self, i: int) -> np.ndarray:
        return self.data[self.off[i] : self.off[i + 1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the first word of each row (n + 1 entries)."""
        word = ~_IS_SPACE[self.data]
        before = np.zeros(len(word), bool)
        before[1:] = word[:-1]
        inner = self.off[(self.off > 0) & (self.off < len(word))]
        cut = np.zeros(len(word) + 1, bool)
        cut[inner] = True
        starts = np.flatnonzero(word & (~before | cut[:-1]))
        after = np.zeros(len(word), bool)
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-split lines of all rows (an empty row has one empty line), and the first line of each row."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.r_[self.off[:-1], breaks + 1], kind="stable")
        ends = np.sort(np.r_[breaks, self.off[1:]], kind="stable")
        row = np.searchsorted(breaks, self.off) + np.arange(self.n + 1)
        return starts, ends, row

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """64-bit hash of each span's bytes, as span_hashes() has it; spans are in order and do not overlap. which: 0 or 1, for
        two that are independent."""
        n = len(self.data)
        if not len(starts):
            return np.zeros(0, U64)
        size = np.diff(np.r_[0, starts, n])  # a byte's place counts from the last start before it
        at = np.arange(n, dtype=np.int32)
        at -= np.repeat(np.r_[0, starts].astype(np.int32), size)
        with np.errstate(over="ignore"):
            value = _places(int(size.max(initial=0)))[which].take(at)
            value *= _BYTE[which].take(self.data)
            sums = np.zeros(n + 1, U64)
            np.cumsum(value, out=sums[1:])
            return mix64(sums[ends] - sums[starts] + (ends - starts).astype(U64) * _COEF[58 + which])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for each i, order included; len(h) - k + 1 of them."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j : j + n] * _COEF[j]
        return mix64(out)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose `column` holds about `limit` bytes; a longer text comes alone and whole."""
    lengths = np.diff(Texts(batch.column(batch.schema.get_field_index(column))).off)
    total, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def batches(frames: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        yield from slices(frame, column, limit)


def binary(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())
