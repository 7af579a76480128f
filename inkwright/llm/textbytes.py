"""Vectorised words, runs and hashes over Arrow string columns.

Everything works on the UTF-8 buffer of a slice of rows at a time, so memory is bounded by
``SLICE_BYTES`` (or by the longest single text, if that is longer) and no Python loop runs per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Words are runs of bytes other than these: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LOWER_TABLE = np.frombuffer(LOWER, dtype=np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: a bijection that spreads every input bit."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


#: Spans over so many bytes are hashed by BLAKE2b, one at a time; all others together, eight bytes a step.
LONG = 256
LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _seeds(lengths: np.ndarray, lane: int) -> np.ndarray:
    return mix64(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03 * (lane + 1) & (1 << 64) - 1))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zero bytes after the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:-8] = data
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for every span; ``lane`` names one of several independent hashes.

    The length and each eight bytes go through a bijection, one after another, so spans of up to eight
    bytes of one length never collide, and no pattern of bytes cancels out.
    """
    length = ends - starts
    heads = eights(data)
    h = mix64(_seeds(length, lane) ^ (heads[starts] & LOW[np.minimum(length, 8)]))
    live, at = np.flatnonzero((length > 8) & (length <= LONG)), 8
    while len(live):
        rest = length[live] - at
        h[live] = mix64(h[live] ^ (heads[starts[live] + at] & LOW[np.minimum(rest, 8)]))
        live, at = live[rest > 8], at + 8
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([lane])).digest(), "little")
    return h


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a : a + length] and data[b : b + length] hold the same bytes, for every pair of places."""
    heads = eights(data)
    low = LOW[np.minimum(length, 8)]
    same = (heads[a] & low) == (heads[b] & low)
    live, at = np.flatnonzero(same & (a != b) & (length > 8) & (length <= LONG)), 8
    while len(live):
        rest = length[live] - at
        low = LOW[np.minimum(rest, 8)]
        here = (heads[a[live] + at] & low) == (heads[b[live] + at] & low)
        same[live] = here
        live, at = live[here & (rest > 8)], at + 8
    for i in np.flatnonzero(same & (a != b) & (length > LONG)).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + length[i]], data[b[i] : b[i] + length[i]])
    return same


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span, one span of each number): equal numbers mean equal bytes, confirmed byte by byte."""
    h = span_hashes(data, starts, ends)
    _, example, ids = np.unique(h, return_index=True, return_inverse=True)
    length, of = ends - starts, example[ids]
    if not ((length == length[of]).all() and equal_spans(data, starts, starts[of], length).all()):
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
        example = np.unique(ids, return_index=True)[1]
    return ids, example


def chain_hashes(values: np.ndarray, starts: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of ``size`` values from each start on; order and number of the values count."""
    h = np.repeat(_seeds(np.array([size]), lane + 16), len(starts))
    for k in range(size):
        h = mix64(h ^ values[starts + k])
    return h


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of at most ``limit`` bytes, or of one row."""
    data, offsets = string_buffers(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Spans:
    """Spans of bytes (words or runs) of a slice: starts, ends, the row of each, and row offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.offsets, self.starts, self.ends = data, offsets, starts, ends
        self.first = np.searchsorted(starts, offsets)  # row r has the spans first[r] to first[r + 1]
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, data: np.ndarray | None = None, lane: int = 0) -> np.ndarray:
        """Hash of each span's bytes, or of those of ``data`` at its place."""
        return span_hashes(self.data if data is None else data, self.starts, self.ends, lane)


def words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Runs of non-space bytes within each row."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Spans(data, offsets, starts, ends)


#: 0 space, 1 letter (ASCII, or any byte of a longer character), 2 digit, 3 other.
CLASS = np.full(256, 3, dtype=np.uint8)
CLASS[SPACE] = 0
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASS[48:58] = 2


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[Spans, np.ndarray]:
    """Maximal runs of letters, of digits and of other signs, with their class."""
    kind = np.zeros(len(data) + 1, dtype=np.uint8)
    kind[:-1] = CLASS[data]
    change = np.empty(len(data) + 1, dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return Spans(data, offsets, starts, ends), kind[starts]


def window_starts(spans: Spans, size: int) -> np.ndarray:
    """The first span of each window of ``size`` consecutive spans that lies within one row."""
    n = len(spans.starts)
    if n < size:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(spans.row[: n - size + 1] == spans.row[size - 1 :])


def window_hashes(hashes: np.ndarray, spans: Spans, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first span, hash) of each window."""
    at = window_starts(spans, size)
    return at, chain_hashes(hashes, at, size, lane)
