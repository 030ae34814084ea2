"""Fill-in-the-middle transformation by secondary sort.

1. A text is cut into units (lines), and two digest numbers of its id choose where the middle begins and ends, two more
   whether it stays plain and in which order the parts stand. Every part is emitted as pieces of whole units, at most
   ``PIECE_BYTES`` each unless one unit is longer (it is then cut), keyed by document and output position.
2. Pieces are partitioned by document and sorted by (document, position) inside the partitions, so each document streams
   by in output order and its digest grows piece by piece; no output is ever put together in memory.
3. The reader finds the marks in that stream, tells prefix, suffix and middle apart and passes the pieces on with their
   place in the original. The same partitions are sorted once more, by that place, without a second exchange, and the
   digest of the restored text grows in the same way.

The key of a document is a digest of its id and text. Equal rows of a task travel once, with their number, and come back
as that many rows; so a hot row costs one copy a batch. Null texts count as empty, and empty texts are plain; a null id
has the digest of the empty id. A text that holds a mark stays plain. Texts are never cut short, clashing columns are
left alone, and an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
PIECE_BYTES = 1 << 18
LINES = re.compile(r"[^\n]*\n|[^\n]+")


@dataclass(frozen=True)
class Rule:
    """Shares in percent of the documents that are transformed, and of these that begin with the suffix."""

    percent: int = 100
    spm_percent: int = 50
    seed: str = "7"


def choices(doc_id, rule: Rule) -> list[int]:
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


@dataclass
class Plan:
    form: str
    units: int
    first: int = 0
    last: int = 0
    prefix_chars: int | None = None
    middle_chars: int | None = None


def plan(doc_id, text: str, rule: Rule) -> Plan:
    """How a text is transformed; ``first`` and ``last`` are the code points at which the middle begins and ends."""
    h1, h2, h3, h4 = choices(doc_id, rule)
    ends = [m.end() for m in LINES.finditer(text)]
    n = len(ends)
    if not text or h3 % 100 >= rule.percent or any(m in text for m in PLACE):
        return Plan("plain", n)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, last = (ends[k - 1] if k else 0 for k in (a, b))
    return Plan("spm" if h4 % 100 < rule.spm_percent else "psm", n, first, last, first, last - first)


def pieces_of(data: bytes) -> Iterator[bytes]:
    """Whole units up to ``PIECE_BYTES``; a longer unit is cut."""
    i = 0
    while i < len(data):
        j = min(i + PIECE_BYTES, len(data))
        if j < len(data):
            j = data.rfind(b"\n", i, j) + 1 or j
        yield data[i:j]
        i = j


def output_pieces(text: str, how: Plan) -> Iterator[bytes]:
    """The output in order."""
    if how.form == "plain":
        yield from pieces_of(text.encode())
        return
    parts = {PREFIX: text[:how.first], MIDDLE: text[how.first:how.last], SUFFIX: text[how.last:]}
    for mark in ORDERS[how.form]:
        yield mark.encode()
        yield from pieces_of(parts[mark].encode())


PIECES = "key binary, position bigint, copies bigint, id {id}, form string, n bigint, prefix_chars bigint, middle_chars bigint, piece binary"
PARTS = "key binary, position bigint, place int, copies bigint, id {id}, form string, n bigint, prefix_chars bigint, middle_chars bigint, output_sha256 string, output binary, piece binary"
HEAD = ("copies", "id", "form", "n", "prefix_chars", "middle_chars")


class Rows:
    """Collects rows and hands them on as record batches of about 4 MB."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, size: int = 0, **row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size + 100
        if self.bytes > 1 << 22:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(self.rows, self.schema)
        self.rows, self.bytes = [], 0
        return batch


def _schema(ddl: str, id_type: pa.DataType) -> pa.Schema:
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "{id}": id_type}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _emit(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = Rows(_schema(PIECES, b.schema.field("id").type))
            ids, texts = b.column("id").to_pylist(), b.column("text")
            keys = [hashlib.blake2b(f"{i!r}:{t.as_py() or ''}".encode(), digest_size=16).digest() for i, t in zip(ids, texts)]
            copies = Counter(keys)
            for doc_id, text, key in zip(ids, texts, keys):
                if key not in copies:
                    continue
                text = text.as_py() or ""
                how = plan(doc_id, text, rule)
                yield from out.add(key=key, position=0, copies=copies.pop(key), id=doc_id, form=how.form, n=how.units, prefix_chars=how.prefix_chars, middle_chars=how.middle_chars)
                for k, piece in enumerate(output_pieces(text, how)):
                    yield from out.add(len(piece), key=key, position=k + 1, piece=piece)
            yield out.flush()

    return run


class Reader:
    """Reads one document's output in order and tells its parts apart; a mark may lie across two pieces."""

    def __init__(self, form: str):
        self.marks = [m.encode() for m in ORDERS.get(form, ())]
        self.now, self.rest = None, b""

    def feed(self, piece: bytes, final: bool = False) -> Iterator[tuple[int, bytes]]:
        """(place in the original, bytes) of what is certain so far."""
        data = self.rest + piece
        while self.marks:
            at = data.find(self.marks[0])
            if at < 0:
                break
            if at:
                yield self.place, data[:at]
            self.now, data = self.marks.pop(0), data[at + len(PREFIX):]
        keep = 0 if final or not self.marks else min(len(data), len(PREFIX) - 1)
        self.rest = data[len(data) - keep:]
        if len(data) > keep:
            yield self.place, data[:len(data) - keep]

    @property
    def place(self) -> int:
        return PLACE[self.now.decode()] if self.now else 0


def _documents(batches: Iterator[pa.RecordBatch], of):
    """Calls ``of(key)`` for a new document, its ``row(row)`` for each of its rows and ``end()`` after the last."""
    now = None
    for row in (row for b in batches for i in range(0, b.num_rows, 256) for row in b.slice(i, 256).to_pylist()):
        if now is None or row["key"] != now.key:
            if now is not None:
                yield from now.end()
            now = of(row["key"])
        yield from now.row(row)
    if now is not None:
        yield from now.end()


def _same_position(now, row) -> bool:
    """Equal rows of other tasks have sent the same pieces: the first of each position counts."""
    again = row["position"] == now.position
    now.position = row["position"]
    return again


def _read(keep: bool):
    """Digests of outputs; passes their parts on, and last a row with what is known of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        class Document:
            def __init__(self, key: bytes):
                self.key, self.position, self.sent, self.sha, self.copies = key, None, 0, hashlib.sha256(), 0
                self.kept = []

            def row(self, row: dict):
                again = _same_position(self, row)
                if row["position"] == 0:
                    self.copies += row["copies"]
                    if not again:
                        self.head = row
                        self.reader = Reader(row["form"])
                elif not again:
                    self.sha.update(row["piece"])
                    if keep:
                        self.kept.append(row["piece"])
                    yield from self.pass_on(self.reader.feed(row["piece"]))

            def pass_on(self, parts):
                for place, piece in parts:
                    self.sent += 1
                    yield from out.add(len(piece), key=self.key, place=place, position=self.sent, piece=piece)

            def end(self):
                yield from self.pass_on(self.reader.feed(b"", final=True))
                head = {k: self.head[k] for k in HEAD} | {"copies": self.copies}
                yield from out.add(key=self.key, place=9, position=0, output_sha256=self.sha.hexdigest(), output=b"".join(self.kept) if keep else None, **head)

        def rows():
            nonlocal out
            for b in batches:
                if out is None:
                    out = Rows(_schema(PARTS, b.schema.field("id").type))
                yield b

        yield from _documents(rows(), Document)
        if out is not None:
            yield out.flush()

    return run


RESULT = "id {id}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
KEPT = ", output binary, restored binary"


def _restore(keep: bool):
    """Digests of restored texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        class Document:
            def __init__(self, key: bytes):
                self.key, self.sha, self.kept = key, hashlib.sha256(), []

            def row(self, row: dict):
                if row["place"] != 9:
                    self.sha.update(row["piece"])
                    if keep:
                        self.kept.append(row["piece"])
                    return
                made = {k: row[k] for k in ("id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")} | {"restored_sha256": self.sha.hexdigest()}
                if keep:
                    made |= {"output": row["output"], "restored": b"".join(self.kept)}
                for _ in range(row["copies"]):
                    yield from out.add(2 * len(row["output"] or b""), **made)

            def end(self):
                yield from ()

        def rows():
            nonlocal out
            for b in batches:
                if out is None:
                    out = Rows(_schema(RESULT + KEPT * keep, b.schema.field("id").type))
                yield b

        yield from _documents(rows(), Document)
        if out is not None:
            yield out.flush()

    return run


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Per row: id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; with ``keep`` also both as bytes."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    pieces = own.mapInArrow(_emit(rule), PIECES.format(id=kind))
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = pieces.repartition(shares, "key").sortWithinPartitions("key", "position")
    parts = in_order.mapInArrow(_read(keep), PARTS.format(id=kind))
    return parts.sortWithinPartitions("key", "place", "position").mapInArrow(_restore(keep), (RESULT + KEPT * keep).format(id=kind))
