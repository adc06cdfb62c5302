"""Whole Arrow batches of text as numpy arrays: bytes, words, prefix hashes.

Nothing here makes a Python object per word.  Offsets keep documents apart, and
``pieces`` bounds how many bytes are worked on at a time.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_seed = np.random.default_rng(20240229)
_TABLE = _seed.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (int(_seed.integers(1 << 40, 1 << 62, dtype=np.int64)) * 8 + 5) % (1 << 64)
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_power = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


#: What a module keeps between the tasks of a worker, as functions that drop it.
KEPT: list[Callable[[], None]] = []


def release(dropping: bool = True) -> None:
    """Returns what a task no longer holds to the system: kept tables, Arrow's pool, the heap's free pages."""
    if dropping:
        _power.update(n=0, up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))
        for drop in KEPT:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def byte_class(spec: str) -> np.ndarray:
    """Membership of the 256 byte values: ``space`` words or ``alnum`` words (all bytes over 7F belong)."""
    m = np.ones(256, bool)
    if spec == "space":
        m[9:14] = m[32] = False
    elif spec == "alnum":
        m[:0x30] = m[0x3A:0x61] = m[0x7B:0x80] = False
    else:
        raise ValueError(spec)
    return m


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte kept."""
    return _FOLD[data]


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n+1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, ends, body = col.buffers()
    if len(col) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(ends, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(data: np.ndarray, off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive documents ``lo:hi`` of about ``limit`` bytes, at least one; documents stay whole."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes, and each document's first word (n+1 bounds)."""
    inside = member[data]
    first = inside.copy()
    last = inside.copy()
    if len(data):
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64."""
    if _power["n"] < n + 1:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            a = np.full(size, np.uint64(base), np.uint64)
            a[0] = 1
            _power[name] = np.multiply.accumulate(a)
        _power["n"] = size
    return _power["up"], _power["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; ``span_hash`` compares any two spans in constant time."""
    up, _ = powers(len(data))
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]``, equal for equal bytes wherever they stand."""
    _, down = powers(len(h))
    return (h[end] - h[start]) * down[start]


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hash(prefix_hash(data), starts, ends))


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For n+1 bounds of items by document, the document of each item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, length), one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    if not len(s):
        return np.zeros(0, np.int64)
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def strings(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``text_bytes`` of a Python list."""
    return text_bytes(pa.array(texts, pa.string()))
