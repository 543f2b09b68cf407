"""Vectorised work on the UTF-8 bytes of many texts at once. No Python object is made for a word.

A batch of texts is one byte array and the offsets of its texts; words, lines and windows are pairs of positions;
their hashes come from one prefix sum over the bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes that are handled together; a longer text is handled alone.
PIECE = 1 << 20

BYTES = np.arange(256)
SPACE = np.isin(BYTES, [0x20, *range(0x09, 0x0E)])
IN_WORD = ~SPACE
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)


def translated(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for a table of 256 bytes, without a place of eight bytes for each byte."""
    return np.ndarray(len(data), np.uint8, bytearray(data).translate(table.tobytes()))


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A to Z and of the accented Latin letters U+00C0 to U+00DE (two bytes, the first 0xC3)."""
    low = translated(data, LOWER)
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[accented] += 32
    return low


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


_BYTE = randoms(256, 7)
_BASE, _UNBASE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> list[np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(max(n, PIECE) + 1, base)
            steps[0] = U(1)
            _powers[k] = np.cumprod(steps)
    return _powers


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, limit: int = PIECE, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most `limit` bytes of text (or one row): the rows, their bytes, their offsets."""
    data, offsets = texts(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mapped(fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], limit: int = PIECE):
    """A function for mapInArrow that applies fn to each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, limit):
                out = fn(rows, data, offsets)
                if out is not None:
                    yield out

    return run


def trim() -> None:
    """Gives memory that is free again back to the system: a worker keeps running, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def filtered(fn: Callable[[np.ndarray, np.ndarray], np.ndarray], text: str, limit: int = PIECE):
    """A function for mapInArrow that keeps the rows, with all their columns, for which fn(bytes, offsets) is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch, limit, text):
                yield rows.filter(pa.array(fn(data, offsets)))

    return run


def spans(keep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of kept bytes; runs end with their text."""
    n = len(keep)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = keep.copy()
    start[1:] &= ~keep[:-1] | edge[1:n]
    end = keep.copy()
    end[:-1] &= ~keep[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line that has any byte."""
    return spans(data != 10, offsets)


def bounds(start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Text i has the spans from bounds[i] to bounds[i + 1]."""
    return np.searchsorted(start, offsets, "left")


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, the same in every batch. Starts and ends must not fall."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, lo + PIECE, "left")))
        hi = int(end[j - 1])
        power, unpower = powers(hi - lo)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix64((total[e] - total[s]) * unpower[s])
        i = j
    return out


_PART = np.append((U(1) << (U(8) * np.arange(8, dtype=U))) - U(1), ~U(0))


def short_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 64) -> np.ndarray:
    """As span_hash, with other values, for spans without zero bytes of which few are long: eight bytes at a time are
    read where a span is, up to `most`; longer spans are left to span_hash. No two of up to eight bytes have one hash."""
    word = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    size = end - start
    out = mix64(word[start] & _PART[np.minimum(size, 8)])
    rest = np.flatnonzero((size > 8) & (size <= most))
    at = 8
    while len(rest):
        out[rest] = mix64(out[rest] * _BASE + (word[start[rest] + at] & _PART[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    long_ = np.flatnonzero(size > most)
    out[long_] = span_hash(data, start[long_], end[long_])
    return out


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbouring hashes, by its first."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for i in range(k):
        out = out * _BASE + h[i : i + n]
    return mix64(out)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def owners(at: np.ndarray) -> np.ndarray:
    """The i of each element under bounds `at`."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def inside(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of [start, start + size), one span after the other."""
    size = size.astype(np.int64)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[inside(start, size)], without holding a place of eight bytes for each value."""
    out = np.empty(int(size.sum()), values.dtype)
    ends = np.cumsum(size.astype(np.int64))
    i = done = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(ends, done + PIECE, "right")))
        out[done : ends[j - 1]] = values[inside(start[i:j], size[i:j])]
        i, done = j, int(ends[j - 1])
    return out


def sorted_with_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys from 0 on, sorted, and the stable order that sorts them: from one sort of both, where these fit 63 bits."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + bits > 63:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort(key << bits | np.arange(len(key)))
    return both >> bits, both & ((1 << bits) - 1)


def found_twice(key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if len(key) < 2:
        return np.zeros(len(key), bool)
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    return among(key, np.unique(twice))


def among(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(key), bool)
    at = np.searchsorted(known, key)
    at[at == len(known)] = 0
    return known[at] == key


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [start, end). Beside the intervals it holds two bytes a place."""
    step = np.zeros(n + 1, np.int8)
    if len(start):
        order = np.argsort(start, kind="stable")
        first, reach = start[order], np.maximum.accumulate(end[order])
        # intervals that neither overlap nor touch: no place begins or ends two of them
        head = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
        step[first[head]] = 1
        step[reach[np.append(head[1:], len(first)) - 1]] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)
