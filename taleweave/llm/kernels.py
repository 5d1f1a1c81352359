"""Vectorised text kernels used inside Spark tasks.

They work on the bytes of a bounded slice of an Arrow string column, so a task
holds a few megabytes of temporary arrays however long its partition is (a
single longer text is a slice of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 2**64)

#: Bytes that separate words: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Maps A-Z to a-z and all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), dtype=U64)
        out[0] = 1
        done = 1
        while done < len(out):
            step = min(done, len(out) - done)
            out[done : done + step] = out[:step] * U64(pow(base, done, 2**64))
            done += step
        if len(out) > 1 << 22:  # tables for a giant text aren't kept
            return out[:n]
        have = _powers[base] = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def give_back() -> None:
    """Return freed memory to the system: a worker that waits between stages should hold none of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row that each belongs to."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    gap = SEPARATOR[data]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[cuts] = True
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[cuts - 1] = True
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, n + 1)[starts] + (ends - starts).astype(U64))


def window_hashes(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` successive items of one owner, and where each window starts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    out = np.zeros(len(at), dtype=U64)
    for k in range(size):
        out = out * U64(BASE) + hashes[at + k]
    return mix(out), at


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row, in order.

    Words are lower-cased (A-Z) runs of non-separators; a text of 1 to size-1
    words has its whole sequence as one shingle, a text without words none.
    """
    for first, end, data, offsets in slices(column):
        low = LOWER[data]
        starts, ends, owner = word_spans(low, offsets)
        hashes = span_hashes(low, starts, ends) if len(starts) else np.empty(0, U64)
        shingles, at = window_hashes(hashes, owner, size)
        bounds = np.searchsorted(owner[at], np.arange(end - first + 1)) if len(at) else np.zeros(end - first + 1, np.int64)
        words = np.searchsorted(owner, np.arange(end - first + 1))
        for k in range(end - first):
            a, b = bounds[k], bounds[k + 1]
            if b > a:
                own = np.sort(shingles[a:b])
                keep = np.empty(b - a, dtype=bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield first + k, own[keep]
            elif words[k + 1] > words[k]:
                h = hashes[words[k] : words[k + 1]]
                total = 0
                for x in h.tolist():
                    total = (total * BASE + x) % 2**64
                yield first + k, mix(np.array([(total + len(h)) % 2**64], dtype=U64))
            else:
                yield first + k, np.empty(0, U64)


def to_planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers as ``width`` byte planes, low bytes first; sorted ones compress well."""
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return raw[:, :width].T.tobytes()


def from_planes(blob: bytes, width: int) -> np.ndarray:
    n = len(blob) // width
    raw = np.zeros((n, 8), dtype=np.uint8)
    raw[:, :width] = np.frombuffer(blob, dtype=np.uint8).reshape(width, n).T
    return raw.reshape(-1).view("<u8")
