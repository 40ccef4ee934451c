"""Vectorised word tokens over Arrow string columns.

A word is a maximal run of ASCII letters, digits and ``_`` or of characters beyond ASCII, in lower case. Hashes are
64-bit: a random value a byte, summed with powers of an odd number modulo 2**64, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same words for RE2 and Java, applied to lower-cased text.
WORD_PATTERN = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
CHUNK_BYTES = 1 << 20

try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _malloc_trim = None

_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz_":
    _WORD[_c] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for i, p in enumerate((_P, _PINV)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens(NamedTuple):
    hash: np.ndarray  # uint64, one a word
    start: np.ndarray  # first byte in the lower-cased text of the document
    end: np.ndarray
    ptr: np.ndarray  # words of document i are ptr[i]:ptr[i + 1]


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    n = len(arr)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def tokenize(arr: pa.Array) -> Tokens:
    """All words of all documents of a string array, in order."""
    data, off = string_buffers(pc.utf8_lower(arr))
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Tokens(np.zeros(0, np.uint64), z, z, np.zeros(len(off), np.int64))
    word = _WORD[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:n]
    stop = np.empty(n, bool)
    stop[:-1] = word[:-1] & (~word[1:] | first[1:n])
    stop[-1] = word[-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    pw, inv = _grow(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[:n], out=total[1:])
    h = mix64((total[e] - total[s]) * inv[s])
    ptr = np.searchsorted(s, off)
    doc = np.repeat(off[:-1], np.diff(ptr))
    return Tokens(h, s - doc, e - doc, ptr)


def chunks(arr: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) with about ``most`` bytes a slice; one document is never split."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if not len(arr):
        return
    size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(arr):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, arr.slice(at, to - at)
        at = to


def ngrams(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and their documents. A document with 1 to n-1 words has one: all of its words."""
    count = np.diff(t.ptr)
    doc = np.repeat(np.arange(len(count)), count)
    m = len(t.hash)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(m, np.uint64)
    left = t.ptr[doc + 1] - np.arange(m)  # words from here to the document's end
    for k in range(n):
        x = np.zeros(m, np.uint64)
        x[: m - k] = t.hash[k:]
        x[left <= k] = np.uint64(k + 1)
        g = mix64(g * np.uint64(0xD6E8FEB86659FD93) + x)
    keep = (left >= n) | ((count[doc] < n) & (np.arange(m) == t.ptr[doc]))
    return g[keep], doc[keep]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the task gives freed memory back to the system: workers live on and wait for other tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return whole


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)
