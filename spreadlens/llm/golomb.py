"""Golomb-Rice code of a sorted list of unsigned numbers: quotients in unary, remainders in k bits each."""
from __future__ import annotations

import struct

import numpy as np


def encode(values: np.ndarray) -> bytes:
    """``values`` sorted, uint64, repeats allowed."""
    n = len(values)
    if n == 0:
        return struct.pack("<IBQ", 0, 0, 0)
    gaps = np.diff(values)
    mean = int(values[-1] - values[0]) // max(1, n - 1)
    k = max(0, mean.bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    stops = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1 if n > 1 else 0, dtype=np.uint8)
    unary[stops] = 1
    rest = np.zeros((n - 1, k), dtype=np.uint8)
    for j in range(k):
        rest[:, j] = (gaps >> np.uint64(k - 1 - j)) & np.uint64(1)
    return struct.pack("<IBQ", n, k, int(values[0])) + struct.pack("<I", len(unary)) + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def decode(code: bytes) -> np.ndarray:
    n, k, first = struct.unpack_from("<IBQ", code)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    (bits,) = struct.unpack_from("<I", code, 13)
    body = np.frombuffer(code, dtype=np.uint8, offset=17)
    split = -(-bits // 8)
    stops = np.flatnonzero(np.unpackbits(body[:split])[:bits])
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    rest = np.unpackbits(body[split:])[:(n - 1) * k].reshape(n - 1, k)
    for j in range(k):
        gaps += rest[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    out = np.empty(n, dtype=np.uint64)
    out[0] = first
    out[1:] = gaps
    return np.cumsum(out)
