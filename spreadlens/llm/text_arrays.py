"""Words, shingles and byte hashes of Arrow text batches as numpy arrays.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``, with A-Z in lower case. All hashes are
polynomials modulo 2^64 over random byte values, finished with a mixer; equal content has equal hashes anywhere.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
WORD_MUL = U(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SLICE_BYTES = 1 << 20

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2^64 for i <= n."""
    global _powers, _inverse
    if len(_powers) <= n:
        m = max(n + 1, SLICE_BYTES + 1)
        p, q = np.full(m, BASE, dtype=np.uint64), np.full(m, BASE_INV, dtype=np.uint64)
        p[0] = q[0] = 1
        _powers, _inverse = np.cumprod(p), np.cumprod(q)
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, o = len(column), column.offset
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[o:o + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray):
    """Ranges of rows that together hold about SLICE_BYTES; a longer text is a slice of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (n + 1 numbers)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    low, space = LOWER[data], SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | edge[1:n]
    last[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, q = powers(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(BYTE[low] * p[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingles_of(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle as a whole."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, size)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        h = h * WORD_MUL + words[j:n - width + 1 + j]
    return np.unique(mix(h))


def each_text(batch: pa.RecordBatch, column: str = "text"):
    """(row, words) of every text of a batch."""
    data, offsets = text_bytes(batch.column(column))
    for i, j in slices(offsets):
        words, at = words_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        for r in range(i, j):
            yield r, words[at[r - i]:at[r - i + 1]]
