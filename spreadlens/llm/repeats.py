"""Repeated byte strings across documents by prefix-free parsing.

1. Parse. A rolling hash of ``GRAM`` bytes triggers: every window of ``WIDTH`` bytes belongs to the smallest rolling hash
   in it, and neighbouring windows with the same trigger make one phrase. Phrases overlap by ``WIDTH - 1`` bytes, so no
   phrase is needed to read past another's end (they are prefix-free), and every window lies in exactly one phrase.
   Equal windows have equal triggers wherever they stand.
2. Dictionary. Blocks of documents send their distinct phrases to the owners of their triggers, as numbers and not as
   bytes: sorted triggers, Golomb-Rice coded, phrase fingerprints, and which document. Equal phrases are one dictionary
   entry with the smallest id that has it. A trigger with one phrase needs nothing more: in later documents the phrase
   repeats whole, in the first it does not.
3. Only where a trigger has several phrases in several documents are the suffixes of the phrases, their windows, sorted:
   they are sent in the same way, keyed by fingerprints, and put in order with the first id of each.
4. The answers are bits in the order of what was sent. Every block parses its texts again, gives each phrase and window
   its answer, and drops the bytes that the repeated ones cover.

Blocks are stored once, compressed, in a table bucketed by block, so that texts are never shuffled. Triggers and window
keys have 48 bits (shared ones only mean more sorting), fingerprints 48 more. A text is parsed in stretches of
``STRETCH`` windows, so that long texts need little more memory than their bytes; a phrase cut by a stretch only moves
work from step 2 to step 3.

Null texts count as empty; shorter texts than ``WIDTH`` keep all bytes. Rows with the same id count as one document: none
of them is earlier than the other. Rows with a null id are compared with nothing and keep all bytes. An empty table
gives an empty result; further columns are left alone.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..core.session import scratch_folder
from . import golomb
from .common import checkpointed, shares
from .text_arrays import BASE, BYTE, U, mix, powers, text_bytes

WIDTH, GRAM = 50, 20
STRETCH = 1 << 19
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 50_000
BYTES_A_PHRASE = 16
KEY_BITS = 48


def _power(n: int) -> np.uint64:
    return U(pow(BASE, n, 2**64))


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Rolling polynomial hash of every ``size`` neighbouring values, by doubling."""
    h, width, out, done = values, 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, done = h, width
            else:
                n = len(h) - done
                out, done = out[:n] * _power(width) + h[done:], done + width
        if 2 * width > size:
            return out
        h = h[:-width] * _power(width) + h[width:]
        width *= 2


def smallest(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbouring values, by doubling."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def phrases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, fingerprint, first window, number of windows) of a text's phrases."""
    parts = []
    for at in range(0, len(data) - WIDTH + 1, STRETCH):
        piece = data[at:at + STRETCH + WIDTH - 1]
        values = BYTE[piece]
        trigger = smallest(mix(gram_hashes(values, GRAM)), WIDTH - GRAM + 1)
        first = np.concatenate([[0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1])
        count = np.diff(first, append=len(trigger))
        p, q = powers(len(piece))
        total = np.empty(len(piece) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(values * p[:len(piece)], out=total[1:])
        print_ = mix((total[first + count + WIDTH - 1] - total[first]) * q[first] + count.astype(np.uint64))
        parts.append((mix(trigger[first]), print_, first + at, count))  # mixed: the smallest of many crowd at zero
    if not parts:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*parts))


REPEATED, SEVERAL = 1, 2
BLOCK = "block string, ids array<bigint>, sizes array<bigint>, bytes bigint, data binary"
SENT = "block string, ids binary, sent array<struct<owner:int,keys:binary,marks:binary,docs:binary>>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, k = TaskContext.get().partitionId(), 0
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        i, n = 0, len(offsets) - 1
        while i < n:
            j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1), i + BLOCK_ROWS)
            own = data[offsets[i]:offsets[j]]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([f"{task}-{k}"]), "ids": pa.array([b.column("id").slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([np.diff(offsets[i:j + 1])], pa.list_(pa.int64())), "bytes": pa.array([len(own)], pa.int64()),
                "data": pa.array([pa.Codec("zstd", 6).compress(own.tobytes(), asbytes=True)], pa.binary())})
            i, k = j, k + 1


class Sorted:
    """Distinct (key, mark, document) in order, and the place of every given one in it."""

    def __init__(self, key: np.ndarray, mark: np.ndarray, doc: np.ndarray):
        shift = U(64 - KEY_BITS)
        key, mark = key >> shift, mark >> shift
        order = np.lexsort((doc, mark, key))
        key, mark, doc = key[order], mark[order], doc[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.key, self.mark, self.doc = key[new], mark[new], doc[new]

    def cuts(self, owners: int) -> np.ndarray:
        return np.searchsorted((self.key * U(owners)) >> U(KEY_BITS), np.arange(owners + 1, dtype=np.uint64))

    def sent(self, owners: int) -> list[dict]:
        cut, out = self.cuts(owners), []
        marks = self.mark[:, None].view(np.uint8)[:, :KEY_BITS // 8]
        for o in np.flatnonzero(np.diff(cut)):
            i, j = cut[o], cut[o + 1]
            out.append({"owner": int(o), "keys": golomb.encode(self.key[i:j]), "marks": marks[i:j].tobytes(), "docs": self.doc[i:j].astype(np.uint16).tobytes()})
        return out

    def answered(self, answers, owners: int) -> np.ndarray:
        """The answer to every given one."""
        cut, state = self.cuts(owners), np.zeros(len(self.key), dtype=np.int8)
        for a in answers or []:
            i, j = cut[a["owner"]], cut[a["owner"] + 1]
            bits = np.unpackbits(np.frombuffer(a["bits"], np.uint8))
            state[i:j] = bits[:j - i] * REPEATED + bits[len(bits) // 2:][:j - i] * SEVERAL
        return state[self.place] if len(self.key) else np.zeros(0, np.int8)


def _owner(group: pd.DataFrame) -> pd.DataFrame:
    """All that was sent of a key is here: which marks stand in a smaller id, which keys have several marks and ids."""
    keys = [golomb.decode(x) for x in group["keys"]]
    width = KEY_BITS // 8
    marks = np.zeros((sum(map(len, keys)), 8), dtype=np.uint8)
    marks[:, :width] = np.frombuffer(b"".join(group["marks"]), np.uint8).reshape(-1, width)
    mark = marks.view(np.uint64)[:, 0]
    of = np.concatenate([golomb.decode(i)[np.frombuffer(d, np.uint16)] for i, d in zip(group["ids"], group["docs"])])
    key = np.concatenate(keys)
    order = np.lexsort((of, mark, key))
    k, m, d = key[order], mark[order], of[order]
    new_k = np.concatenate([[True], k[1:] != k[:-1]])
    new_m = new_k.copy()
    new_m[1:] |= m[1:] != m[:-1]
    at = np.flatnonzero(new_k)
    several = (np.add.reduceat(new_m.astype(np.int64), at) > 1) & (np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at))
    repeated = d > d[np.flatnonzero(new_m)][np.cumsum(new_m) - 1]
    back = np.empty((2, len(k)), dtype=np.uint8)
    back[0, order] = repeated
    back[1, order] = several[np.cumsum(new_k) - 1] & ~repeated
    ends = np.cumsum([0, *map(len, keys)])
    bits = [np.packbits(back[0, i:j]).tobytes() + np.packbits(back[1, i:j]).tobytes() for i, j in zip(ends, ends[1:])]
    return pd.DataFrame({"block": group["block"].to_numpy(), "owner": group["owner"].to_numpy(), "bits": bits})


class Block:
    """A block's texts with their phrases, and the windows of the phrases that are several."""

    def __init__(self, row: dict, owners: int):
        data = pa.Codec("zstd").decompress(row["data"], decompressed_size=row["bytes"]) if row["bytes"] else b""
        ends = np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])
        data = np.frombuffer(data, dtype=np.uint8)
        self.texts = [data[i:j] for i, j in zip(ends, ends[1:])]
        self.ids, self.owners, self.name = row["ids"], owners, row["block"]
        self.known = np.unique(np.array([i for i in self.ids if i is not None], dtype=np.int64))
        none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        parts = [phrases(t) if i is not None else none for i, t in zip(self.ids, self.texts)]
        self.counts = [len(p[0]) for p in parts]
        self.trigger, self.mark, self.first, self.count = (np.concatenate(x) for x in zip(*parts))
        rank = np.searchsorted(self.known, np.array([i if i is not None else 0 for i in self.ids], dtype=np.int64))
        self.doc = np.repeat(rank, self.counts)

    def ids_code(self) -> bytes:
        return golomb.encode((self.known.view(np.uint64) ^ U(1 << 63)))

    def phrases_sent(self) -> Sorted:
        return Sorted(self.trigger, self.mark, self.doc)

    def windows_sent(self, state: np.ndarray) -> tuple[list[np.ndarray], Sorted]:
        """Per text the places of its open windows, and all of them as they are sent."""
        places, keys, marks, docs, i = [], [], [], [], 0
        for text, n in zip(self.texts, self.counts):
            open_ = np.flatnonzero(state[i:i + n] == SEVERAL) + i
            width = self.count[open_]
            at = np.repeat(self.first[open_] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum()) if len(open_) else np.zeros(0, np.int64)
            key, mark = window_keys(text, at)
            places.append(at)
            keys.append(key)
            marks.append(mark)
            docs.append(np.full(len(at), self.doc[i] if n else 0))
            i += n
        return places, Sorted(np.concatenate(keys), np.concatenate(marks), np.concatenate(docs))


def _rows(batches: Iterator[pa.RecordBatch], owners: int):
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            yield row, Block(row, owners)


def _send(owners: int, windows: bool):
    kind = pa.list_(pa.struct([("owner", pa.int32()), ("keys", pa.binary()), ("marks", pa.binary()), ("docs", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _rows(batches, owners):
            sent = block.phrases_sent()
            if windows:
                sent = block.windows_sent(sent.answered(row["phrase_answers"], owners))[1]
            yield pa.RecordBatch.from_pydict({"block": pa.array([block.name]), "ids": pa.array([block.ids_code()], pa.binary()), "sent": pa.array([sent.sent(owners)], kind)})

    return run


def window_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of the windows that start at the positions ``at``."""
    a, b = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for lo in range(0, len(data) - WIDTH + 1, STRETCH):
        i, j = np.searchsorted(at, [lo, lo + STRETCH])
        if i < j:
            piece = data[lo:lo + STRETCH + WIDTH - 1]
            a[i:j] = mix(gram_hashes(BYTE[piece], WIDTH)[at[i:j] - lo])
            b[i:j] = mix(gram_hashes(BYTE[255 - piece] | U(1), WIDTH)[at[i:j] - lo])
    return a, b


def cover_of(size: int, first: np.ndarray, count: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Which bytes the repeated phrases (first window, number of windows) and windows cover."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count + WIDTH - 1, -1)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + WIDTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(owners: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _rows(batches, owners):
            state = block.phrases_sent().answered(row["phrase_answers"], owners)
            places, sent = block.windows_sent(state)
            again = sent.answered(row["window_answers"], owners) == REPEATED
            out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "starts", "ends")}
            i = w = 0
            for text, n, at in zip(block.texts, block.counts, places):
                own = np.flatnonzero(state[i:i + n] == REPEATED) + i
                cover = cover_of(len(text), block.first[own], block.count[own], at[again[w:w + len(at)]])
                step = np.diff(cover.astype(np.int8), prepend=0, append=0)
                kept = text[~cover].tobytes()
                for name, value in (("n_bytes", len(text)), ("n_removed", int(cover.sum())), ("n_spans", int((step == 1).sum())), ("kept_sha256", hashlib.sha256(kept).hexdigest()),
                                    ("kept", kept), ("starts", np.flatnonzero(step == 1)), ("ends", np.flatnonzero(step == -1))):
                    out[name].append(value)
                i, w = i + n, w + len(at)
            numbers = {n: pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")}
            more = {"kept": pa.array(out["kept"], pa.binary()), "starts": pa.array(out["starts"], pa.list_(pa.int64())), "ends": pa.array(out["ends"], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({"id": pa.array(block.ids, pa.int64()), **numbers, "kept_sha256": pa.array(out["kept_sha256"], pa.string())} | (more if keep_text else {}))

    return run


def _answers(sent: DataFrame, name: str) -> DataFrame:
    """(block, answers of all owners)."""
    each = sent.select("block", "ids", F.explode("sent").alias("s")).select("block", "ids", "s.*")
    bits = each.groupBy("owner").applyInPandas(_owner, "block string, owner int, bits binary")
    return checkpointed(bits.groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias(name)))


def _bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """The blocks as a table bucketed by block in the shared folder: joins on the block don't move it."""
    name = f"text_blocks_{uuid.uuid4().hex}"
    blocks.write.bucketBy(buckets, "block").option("path", scratch_folder(blocks.sparkSession)).option("compression", "none").format("parquet").saveAsTable(name)
    return blocks.sparkSession.table(name)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also the kept bytes and the removed spans."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = shares(spark, size // BYTES_A_PHRASE, 1_500_000)
    blocks = _bucketed(own.mapInArrow(_blocks, BLOCK), shares(spark, size, 16 * BLOCK_BYTES))
    first = _answers(blocks.mapInArrow(_send(owners, False), SENT), "phrase_answers")
    second = _answers(blocks.join(first, "block", "left").mapInArrow(_send(owners, True), SENT), "window_answers")
    kind = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    more = ", kept binary, starts array<bigint>, ends array<bigint>" if keep_text else ""
    return blocks.join(first, "block", "left").join(second, "block", "left").mapInArrow(_cut(owners, keep_text), kind + more)
