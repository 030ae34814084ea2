"""SentencePiece encoding and decoding with a table of distinct chunks.

A text's marked form is the marker, then the text with every space replaced by the marker. A chunk is a run of markers
and what follows up to the next run. ``assert_chunks`` checks that no piece of the model has a marker after another
character; then no piece, and no merge, crosses from one chunk to the next, and the ids of a text are those of its
chunks in order. Each distinct chunk of a task is segmented once, by the library, into a table; texts take their ids
and decoded chunks from it by position. The table belongs to one task, is limited to ``TABLE`` chunks and started anew
when full, which changes the speed alone: a table of the whole corpus would shuffle every word to reach it.

Null texts count as empty: no ids, an empty decoded text. Every row is done by itself, so repeated rows, null or
repeated ids and clashing columns cannot matter; a text is never cut, and an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
TABLE = 300_000
#: Longer chunks are segmented without being kept.
KEEP_CHARS = 64
#: Rows that are encoded before they leave the task: ids and decoded texts of a whole Arrow batch are never held at once.
ROWS_OUT = 256
_RUNS = re.compile(" *[^ ]+| +")


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def assert_chunks(processor) -> None:
    """The condition under which chunks can be segmented alone, and how this model marks white space."""
    pieces = (processor.id_to_piece(i) for i in range(processor.vocab_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece of this model crosses a white space marker")
    probe = "a  b "
    if [processor.id_to_piece(i) for i in processor.encode(probe)] != [f"{MARK}a", MARK, f"{MARK}b", MARK]:
        raise ValueError("this model changes white space")


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without its first marker: joined by spaces they are the text."""
    text = text.replace(MARK, " ")
    if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ") if text else []
    marked = " " + text
    return [c[1:] for c in _RUNS.findall(marked)]


class ChunkTable(dict):
    """chunk -> (ids joined by commas, number of ids, decoded chunk); segments what it misses."""

    def __init__(self, processor):
        super().__init__()
        self.processor = processor
        self.marker = processor.piece_to_id(MARK)

    def __missing__(self, chunk: str) -> tuple[str, int, str]:
        ids = self.processor.encode(chunk, num_threads=1) if chunk else [self.marker]
        row = (",".join(map(str, ids)), len(ids), self.processor.decode(ids))
        if len(chunk) <= KEEP_CHARS:
            if len(self) >= TABLE:
                self.clear()
            self[chunk] = row
        return row


def encode_with(table: ChunkTable, text: str) -> tuple[str, int, str]:
    """(decimal ids joined by commas, number of ids, decoded text)."""
    rows = [table[c] for c in chunks_of(text)]
    if not rows:
        return "", 0, ""
    ids, sizes, decoded = zip(*rows)
    return ",".join(ids), sum(sizes), " ".join(decoded)


def _codec(model: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model)
        assert_chunks(processor)
        table = ChunkTable(processor)
        for b in (whole.slice(i, ROWS_OUT) for whole in batches for i in range(0, max(1, len(whole)), ROWS_OUT)):
            sizes, sha, back, ids_out, text_out = [], [], [], [], []
            for t in b.column("_text"):
                ids, n, decoded = encode_with(table, t.as_py() or "")
                sizes.append(n)
                sha.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep:
                    ids_out.append(np.fromstring(ids, dtype=np.int32, sep=","))
                    text_out.append(decoded)
            columns = {n: b.column(n) for n in b.schema.names if n != "_text"}
            columns |= {"n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if keep:
                columns |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(text_out, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_and_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and with ``keep`` also ids and decoded."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    kind = own.schema["id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if keep else ""
    return own.mapInArrow(_codec(model, keep), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
