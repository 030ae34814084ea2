"""Lossless counting quotient filters over packed word-id n-grams, as sorted and bit-packed arrays.

An n-gram of up to three word ids (1 to 2**bits - 1, absent ones 0) is a number of 3 x bits bits. Four rounds that add a
digest of one part to the other (each can be undone) spread it evenly; the upper bits of the result are the quotient, all
others the remainder, so nothing of the key is lost. A filter holds distinct keys in order: for every quotient slot its
number of keys in unary, the remainders packed, and counters where a key was seen more than once. The slots of a filter
divide the range of its keys into about as many as it has keys. Filters are merged like sorted runs, counters add up.
"""
from __future__ import annotations

import struct

import numpy as np

from .text_arrays import U, mix

#: Largest width of a word id; two of them fit one machine word.
MAX_BITS = 31
TOP_BITS = 40
_KEYS = [U(k) for k in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


class Permutation:
    """(first, second, third word id) <-> (top, rest): the upper ``top_bits`` bits of the permuted key and the others."""

    def __init__(self, bits: int):
        if not 1 <= bits <= MAX_BITS:
            raise ValueError(f"word ids need {bits} bits; {MAX_BITS} are possible")
        self.bits = bits
        self.top_bits = min(3 * bits, TOP_BITS)
        self.rest_bits = 3 * bits - self.top_bits
        self.left_mask, self.right_mask = U((1 << bits) - 1), U((1 << 2 * bits) - 1)

    def _rounds(self, keys):
        return [(k, n % 2) for n, k in enumerate(keys)]

    def forward(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = x.astype(np.uint64), y.astype(np.uint64) << U(self.bits) | z.astype(np.uint64)
        for k, n in enumerate(_KEYS):
            if k % 2 == 0:
                left ^= mix(right + n) & self.left_mask
            else:
                right ^= mix(left + n) & self.right_mask
        down, up = 2 * self.bits, self.top_bits - self.bits
        top = left << U(up) | right >> U(down - up)
        return top, right & U((1 << down - up) - 1)

    def backward(self, top: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        down, up = 2 * self.bits, self.top_bits - self.bits
        left = top >> U(up)
        right = (top & U((1 << up) - 1)) << U(down - up) | rest
        for k, n in reversed(list(enumerate(_KEYS))):
            if k % 2 == 0:
                left ^= mix(right + n) & self.left_mask
            else:
                right ^= mix(left + n) & self.right_mask
        return left, right >> U(self.bits), right & self.left_mask


def in_order(top: np.ndarray, rest: np.ndarray, count: np.ndarray | None, rest_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (top, rest) in order with their counts added up; runs that are in order already are merged."""
    n = len(top)
    if n == 0:
        return top, rest, np.zeros(0, dtype=np.int64)
    if rest_bits + TOP_BITS <= 64:
        key = top << U(rest_bits) | rest
        if count is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        key = key[at]
        top, rest = key >> U(rest_bits), key & U((1 << rest_bits) - 1)
    else:
        order = np.lexsort((rest, top))
        top, rest, count = top[order], rest[order], None if count is None else count[order]
        at = np.flatnonzero(np.concatenate([[True], (top[1:] != top[:-1]) | (rest[1:] != rest[:-1])]))
        top, rest = top[at], rest[at]
    return top, rest, np.diff(at, append=n) if count is None else np.add.reduceat(count, at)


def packed(values: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bits of each value, one after another."""
    if width == 0 or len(values) == 0:
        return b""
    bytes_ = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - -(-width // 8):]
    bits = np.unpackbits(np.ascontiguousarray(bytes_), axis=1)[:, -width:]
    return np.packbits(bits).tobytes()


def unpacked(code: bytes, n: int, width: int) -> np.ndarray:
    if width == 0 or n == 0:
        return np.zeros(n, dtype=np.uint64)
    size = -(-width // 8)
    bits = np.zeros((n, 8 * size), dtype=np.uint8)
    bits[:, -width:] = np.unpackbits(np.frombuffer(code, dtype=np.uint8), count=n * width).reshape(n, width)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, 8 - size:] = np.packbits(bits, axis=1)
    return out.view(">u8")[:, 0].astype(np.uint64)


_HEAD = struct.Struct("<IQBII")


def encode(top: np.ndarray, rest: np.ndarray, count: np.ndarray, rest_bits: int) -> bytes:
    """A filter of distinct keys in order."""
    n = len(top)
    base = int(top[0]) if n else 0
    span = int(top[-1]) - base + 1 if n else 1
    shift = max(0, (span // max(1, n)).bit_length() - 1)
    offset = top - U(base)
    slot = (offset >> U(shift)).astype(np.int64)
    unary = np.zeros(n + (int(slot[-1]) if n else 0), dtype=np.uint8)
    unary[slot + np.arange(n)] = 1  # a zero closes a slot, a one is a key
    more = count > 1
    large = count[more] - 2
    small = np.minimum(large, 255).astype(np.uint8)
    wide = large[large >= 255].astype("<u8")
    parts = [np.packbits(unary).tobytes(), packed(offset, shift), packed(rest, rest_bits), np.packbits(more).tobytes(), small.tobytes(), wide.tobytes()]
    return _HEAD.pack(n, base, shift, len(unary), len(small)) + b"".join(parts)


def decode(code: bytes, rest_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, base, shift, bits, counters = _HEAD.unpack_from(code)
    at = _HEAD.size

    def part(size: int) -> bytes:
        nonlocal at
        at += size
        return code[at - size:at]

    bytes_of = lambda b: -(-b // 8)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(part(bytes_of(bits)), dtype=np.uint8), count=bits))
    slot = (ones - np.arange(n)).astype(np.uint64)
    top = (slot << U(shift)) + unpacked(part(bytes_of(n * shift)), n, shift) + U(base)
    rest = unpacked(part(bytes_of(n * rest_bits)), n, rest_bits)
    more = np.unpackbits(np.frombuffer(part(bytes_of(n)), dtype=np.uint8), count=n).astype(bool)
    large = np.frombuffer(part(counters), dtype=np.uint8).astype(np.int64)
    wide = np.frombuffer(code, dtype="<u8", offset=at)
    large[large == 255] = wide.astype(np.int64)
    count = np.ones(n, dtype=np.int64)
    count[more] = large + 2
    return top, rest, count


def owners_of(top: np.ndarray, top_bits: int, owners: int) -> np.ndarray:
    """Which of ``owners`` equal ranges of the permuted keys a key lies in; at most 2**24 owners."""
    return (top * U(owners)) >> U(top_bits)
