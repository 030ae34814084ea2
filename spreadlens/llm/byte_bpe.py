"""Byte-level BPE encoding and decoding; boundaries by transition-function scans instead of a regex.

1. Every code point gets a class (space, other white space, number, apostrophe, five kinds of letters, rest) from a table
   that asks the library itself which code points are letters, numbers and white space, so both follow one Unicode version.
2. The pattern of the rank files (contractions, then an optional space with letters, numbers or other signs, then white
   space) is an automaton of ten states. A class is a function from state to state; the functions that compositions of
   classes can give are finite in number, so they are numbered and composed by a table. Rows of characters are composed
   column by column, the rows' functions by an associative scan, and a second pass gives the state at every character.
3. A token begins where a table over (state before, class, next class) says so. Longer texts are scanned in stretches that
   hand the state on. The slices between the beginnings go through a table of merged slices, which belongs to a worker process,
   holds ``TABLE`` slices and starts anew when full; this changes the speed alone.
4. Ids keep their byte offsets: decoding copies each id's bytes to its offset.

Null texts count as empty: no ids, an empty decoded text. Rows are done one by one, so repeated rows, ties, null or
repeated ids and columns with clashing names cannot matter; no text is cut, and an empty table gives an empty result.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text_arrays import slices, text_bytes

TABLE = 500_000
PAIRS = 1_000_000
#: Longer slices are merged without being kept.
KEEP_BYTES = 64
STRETCH = 1 << 20

# ---- classes and states ------------------------------------------------------------------------------------------

SPACE, WHITE, NUMBER, REST, APOSTROPHE, LETTER, STMD, RV, L, E, EDGE, NONE = range(12)
LETTERS = {LETTER, STMD, RV, L, E}
START, IN_SPACE, IN_WHITE, IN_LETTERS, IN_NUMBERS, IN_REST, APART, APART_RV, APART_L, CONTRACTED = range(10)
STATES = 10


def step(state: int, kind: int) -> int:
    """The state after a character; APART is an apostrophe that begins a token, so a contraction may follow."""
    if kind == NONE:
        return state
    if kind == EDGE:
        return START
    if kind in (SPACE, WHITE):
        return IN_SPACE if kind == SPACE else IN_WHITE
    if kind == NUMBER:
        return IN_NUMBERS
    if kind == REST:
        return IN_REST
    if kind == APOSTROPHE:
        return IN_REST if state in (IN_SPACE, IN_REST, APART) else APART
    if state == APART:
        return {STMD: CONTRACTED, RV: APART_RV, L: APART_L}.get(kind, IN_LETTERS)
    return CONTRACTED if (state, kind) in ((APART_RV, E), (APART_L, L)) else IN_LETTERS


def begins(state: int, kind: int, following: int) -> bool:
    """Whether a token begins at a character of class ``kind``, given the state before it and the class after it."""
    if state in (START, CONTRACTED):
        return True
    if kind in (SPACE, WHITE):  # a run of white space gives up its last character if another kind follows
        return state not in (IN_SPACE, IN_WHITE) or following not in (SPACE, WHITE, EDGE)
    if state == IN_SPACE:
        return False
    if state == IN_WHITE:
        return True
    if state == IN_NUMBERS:
        return kind != NUMBER
    if state == IN_REST:
        return kind not in (REST, APOSTROPHE)
    if state == APART:
        joins = kind in (REST, APOSTROPHE, STMD) or (kind, following) in ((RV, E), (L, L))
        return not joins
    return kind not in LETTERS


STEP = np.array([[step(s, k) for k in range(NONE + 1)] for s in range(STATES)], dtype=np.uint8)
BEGINS = np.array([[[k < EDGE and begins(s, k, n) for n in range(NONE + 1)] for k in range(NONE + 1)] for s in range(STATES)])


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each class's function, table of compositions "first then second", table of values)."""
    found = {tuple(range(STATES)): 0}
    todo = list(found)
    own = [tuple(int(x) for x in STEP[:, k]) for k in range(NONE + 1)]
    while todo:
        f = todo.pop()
        for g in own:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    values = np.array(list(found), dtype=np.uint8)
    compose = np.array([[found[tuple(g[x] for x in f)] for g in found] for f in found], dtype=np.uint16)
    return np.array([found[g] for g in own], dtype=np.uint16), compose, values


FUNCTION, COMPOSE, VALUE = _closure()


@cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.full(0x110000, REST, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        library = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(library.encode_ordinary(every)).decode().encode("utf-32-le"), dtype=np.uint32)] = kind
    for kind, signs in ((SPACE, " "), (APOSTROPHE, "'"), (STMD, "stmd"), (RV, "rv"), (L, "l"), (E, "e")):
        table[[ord(x) for x in signs]] = kind
    return table


def states_of(kinds: np.ndarray, state: int) -> np.ndarray:
    """The state after every character, beginning with ``state``."""
    n = len(kinds)
    width = int(np.ceil(np.sqrt(n)))
    rows = -(-n // width)
    grid = np.full(rows * width, NONE, dtype=np.uint8)
    grid[:n] = kinds
    columns = np.ascontiguousarray(grid.reshape(rows, width).T)
    whole = np.zeros(rows, dtype=np.uint16)
    for column in columns:
        whole = COMPOSE[whole, FUNCTION[column]]
    reach = 1
    while reach < rows:  # associative scan of the rows' functions
        whole[reach:] = COMPOSE[whole[:-reach], whole[reach:]]
        reach *= 2
    now = np.full(rows, state, dtype=np.uint8)
    now[1:] = VALUE[whole[:-1], state]
    out = np.empty_like(columns)
    for j, column in enumerate(columns):
        now = STEP[now, column]
        out[j] = now
    return out.T.reshape(-1)[:n]


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which tokens begin, for texts that lie one after another; ``offsets`` has n + 1 numbers."""
    table, state, found = class_table(), START, []
    lead = (data & 0xC0) != 0x80
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    cuts = [0]
    while cuts[-1] < len(data):  # stretches end before the first byte of a character
        at = min(cuts[-1] + STRETCH, len(data))
        while at < len(data) and not lead[at]:
            at += 1
        cuts.append(at)
    kinds = [table[np.frombuffer(data[a:b].tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)] for a, b in zip(cuts, cuts[1:])]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        own, first = kinds[k], edge[a:b][lead[a:b]]
        if first.any():  # an edge is a character of its own before a text's first one
            places = np.flatnonzero(first)
            own = np.insert(own, places, EDGE)
        after = kinds[k + 1][:1] if b < len(data) and not edge[b] else np.array([EDGE], dtype=np.uint8)
        states = states_of(own, state)
        before = np.concatenate([[np.uint8(state)], states[:-1]])
        flags = BEGINS[before, own, np.concatenate([own[1:], after])]
        state, kinds[k] = int(states[-1]), None
        flags = flags[own != EDGE]
        at_byte = np.zeros(b - a, dtype=bool)
        at_byte[lead[a:b]] = flags
        found.append(np.flatnonzero(at_byte) + a)
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


# ---- merges ------------------------------------------------------------------------------------------------------

def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


NEVER = 1 << 40


class PairTable(dict):
    """(left id << 20 | right id) -> the id of both bytes together, NEVER if there is none; filled as it is asked, at most ``PAIRS``."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}

    def __missing__(self, pair: int) -> int:
        if len(self) >= PAIRS:
            self.clear()
        rank = self[pair] = self.ranks.get(self.token[pair >> 20] + self.token[pair & 0xFFFFF], NEVER)
        return rank


def merged(piece: bytes, ranks: dict[bytes, int], pairs: PairTable) -> list[int]:
    """Ids of a slice: the pair of lowest rank is merged first, of equal ones the leftmost."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > KEEP_BYTES:
        return _merged_long(piece, ranks)
    ids = [ranks[piece[i:i + 1]] for i in range(len(piece))]
    rank = [pairs[a << 20 | b] for a, b in zip(ids, ids[1:])]
    while rank:
        best = min(rank)
        if best == NEVER:
            break
        i = rank.index(best)
        ids[i] = best
        del ids[i + 1], rank[i]
        if i < len(rank):
            rank[i] = pairs[best << 20 | ids[i + 1]]
        if i:
            rank[i - 1] = pairs[ids[i - 1] << 20 | best]
    return ids


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and linked parts: n log n for slices of any length."""
    n = len(piece)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def push(i: int) -> None:
        if end[i] < n and (r := ranks.get(piece[i:end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[end[i]]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        if end[i] != middle or end[middle] != last:
            continue
        end[i], end[middle] = last, 0
        if last < n:
            left[last] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class SliceTable(dict):
    """slice -> its ids as little-endian 32-bit numbers; merges what it misses."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pairs = ranks, PairTable(ranks)

    def __missing__(self, piece: bytes) -> bytes:
        ids = merged(piece, self.ranks, self.pairs)
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= KEEP_BYTES:
            if len(self) >= TABLE:
                self.clear()
            self[piece] = ids
        return ids


class Decoder:
    """Bytes of ids, each copied to its offset."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        parts = [b""] * len(self.size)
        for token, i in ranks.items():
            parts[i], self.size[i] = token, len(token)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes begin, and at last where they end."""
        return np.concatenate([[0], np.cumsum(self.size[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        out = np.empty(int(offsets[-1]), dtype=np.uint8)
        for i in range(0, len(ids), STRETCH):
            own = ids[i:i + STRETCH]
            at = offsets[i:i + len(own)]
            size = self.size[own]
            lo, hi = at[0], at[-1] + size[-1]
            out[lo:hi] = self.bytes[np.arange(lo, hi) + np.repeat(self.first[own] - at, size)]
        return out.tobytes()


@cache
def codec_of(path: str) -> tuple[SliceTable, Decoder]:
    """The tables of a worker process, which its later tasks use again."""
    ranks = load_ranks(path)
    return SliceTable(ranks), Decoder(ranks)


def encode_texts(data: np.ndarray, offsets: np.ndarray, table: SliceTable) -> Iterator[np.ndarray]:
    """The ids of each text."""
    starts = token_starts(data, offsets)
    of = np.searchsorted(starts, offsets)
    raw, at = data.tobytes(), [*starts.tolist(), len(data)]
    for i, j in zip(of, of[1:]):
        pieces = [raw[a:b] for a, b in zip(at[i:j], at[i + 1:j + 1])]
        yield np.frombuffer(b"".join(map(table.__getitem__, pieces)), dtype="<u4")


def _codec(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, decoder = codec_of(path)
        for b in batches:
            data, offsets = text_bytes(b.column("_text"))
            sizes, sha, back, more = [], [], [], {"ids": [], "offsets": [], "decoded": []}
            for i, j in slices(offsets):
                for ids in encode_texts(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], table):
                    at = decoder.offsets(ids)
                    decoded = decoder.decode(ids, at)
                    sizes.append(len(ids))
                    sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if keep:
                        for name, value in (("ids", ids.astype(np.int32)), ("offsets", at[:-1]), ("decoded", decoded)):
                            more[name].append(value)
            columns = {"id": b.column("id"), "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if keep:
                columns |= {"ids": pa.array(more["ids"], pa.list_(pa.int32())), "offsets": pa.array(more["offsets"], pa.list_(pa.int64())), "decoded": pa.array(more["decoded"], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_and_decode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and with ``keep`` also ids, their byte offsets and the decoded bytes."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    kind = own.schema["id"].dataType.simpleString()
    more = ", ids array<int>, offsets array<bigint>, decoded binary" if keep else ""
    return own.mapInArrow(_codec(ranks, keep), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
