"""WARC archives: writing, and a sequential reader.

Writing: every Spark task rolls its rows into ``.warc.gz`` files of the shared folder, one gzip member per record, and
returns their names; only files named by tasks that succeeded are read, so a task that runs again does no harm.
Reading: a file is one row of work; its bytes pass through incremental zlib decompression in small pieces, one member
per record, framed by Content-Length, and every block and payload digest is verified. Memory is one record.

Of records with equal payloads the one with the smallest page id is a response and the others revisit it, if the
payload has at least ``min_bytes``; shorter ones are all responses. A revisit holds the HTTP head of the original, with
the length of its payload, and no payload.

Null payloads count as empty. Null urls are empty. A null page id is written as an absent one; beside known ids it is a
revisit, among nulls alone a response. Rows that repeat the smallest id are responses too. An empty table gives an
empty result; further columns are not written.
"""
from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.session import scratch_folder
from .common import checkpointed

ROLL_BYTES = 32 << 20
READ_BYTES = 1 << 16
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str):
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record_bytes(page_id, url: str, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One record, not compressed."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE),
              ("WARC-Target-URI", urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
              ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + CRLF + block + CRLF + CRLF


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Inflated:
    """Decompressed bytes of a file of gzip members, member by member, read in small pieces."""

    def __init__(self, stream):
        self.stream, self.raw, self.buffer, self.codec = stream, b"", bytearray(), None

    def _more(self) -> bool:
        """Add bytes of the current member to the buffer; False at its end."""
        while not self.codec.eof:
            piece = self.raw or self.stream.read(READ_BYTES)
            if not piece:
                raise ValueError("a gzip member ends early")
            got = self.codec.decompress(piece, READ_BYTES)
            self.raw = self.codec.unused_data if self.codec.eof else self.codec.unconsumed_tail
            if got:
                self.buffer += got
                return True
        return False

    def next_member(self) -> bool:
        self.raw = self.raw or self.stream.read(READ_BYTES)
        self.codec, self.buffer = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def until(self, mark: bytes) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if not self._more():
                raise ValueError("a record head has no end")
        out = bytes(self.buffer[:at])
        del self.buffer[:at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("a block is shorter than its Content-Length")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def finish(self) -> None:
        """The record ends with two line ends, and the member with the record."""
        if self.take(4) != CRLF + CRLF or self.buffer or self._more():
            raise ValueError("bytes follow a record in its member")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def read_records(stream) -> Iterator[dict]:
    """The records of one archive, in order."""
    inflated = Inflated(stream)
    while inflated.next_member():
        head = inflated.until(CRLF + CRLF)
        if not head.startswith(b"WARC/"):
            raise ValueError("a member does not begin with a record")
        fields = _fields(head)
        block = inflated.take(int(fields["content-length"]))
        inflated.finish()
        http, _, payload = block.partition(CRLF + CRLF)
        revisit = fields["warc-type"] == "revisit"
        told = fields["warc-payload-digest"].removeprefix("sha1:")
        if digest(block) != fields["warc-block-digest"].removeprefix("sha1:") or not revisit and digest(payload) != told:
            raise ValueError(f"the digest of {fields['warc-record-id']} is wrong")
        length = int(_fields(http)["content-length"])
        if not revisit and length != len(payload):
            raise ValueError(f"the payload of {fields['warc-record-id']} has another length")
        yield {"page_id": _page(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": length, "payload_digest": told,
               "record_type": fields["warc-type"], "refers_to": _page(fields["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pfs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out, written = None, []

        def close():
            out.close()
            written[-1][1] = size

        size = records = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id"))):
                page_id, url, html, first = r
                revisit = first is not None and page_id != first
                if out is None:
                    written.append([f"{uuid.uuid4().hex}.warc.gz", 0, 0])
                    out, size = fs.open_output_stream(f"{path}/{written[-1][0]}", compression=None), 0
                member = gzip_member(record_bytes(page_id, url, html.encode(), first, revisit))
                out.write(member)
                size += len(member)
                written[-1][2] += 1
                if size >= ROLL_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if written:
            name, size, records = zip(*written)
            yield pa.RecordBatch.from_pydict({"file": pa.array(name), "bytes": pa.array(size, pa.int64()), "records": pa.array(records, pa.int64())})

    return run


def _reader(folder: str, payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pfs.FileSystem.from_uri(folder)
        batch = lambda rows: pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names})
        for b in batches:
            for name in b.column("file").to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for r in read_records(stream):
                        rows.append(r)
                        held += len(r["payload"] or b"") if payload else 100
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return run


def located(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark itself gives it: that of the default file system where it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{whole.removeprefix('file:')}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) to archives in ``folder``; the table of the files written."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                       F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("same", F.sha1(F.col("html")))
    first = own.filter(F.octet_length("html") >= min_bytes).groupBy("same").agg(F.min("page_id").alias("first_id"))
    known = own.join(first, "same", "left").select("page_id", "url", "html", "first_id")
    return checkpointed(known.mapInArrow(_writer(folder), "file string, bytes bigint, records bigint"))


def read_archives(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the archives that ``files`` names, each file read by one task from its beginning to its end."""
    n = max(1, files.count())
    kind = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return files.select("file").repartition(n, "file").mapInArrow(_reader(folder, payload), kind + ", payload binary" * payload)


def round_trip(pages: DataFrame, min_bytes: int = 0, payload: bool = False) -> DataFrame:
    """Write the pages to archives in the shared folder and read the records back."""
    folder = located(pages.sparkSession, scratch_folder(pages.sparkSession))
    return read_archives(write_archives(pages, folder, min_bytes), folder, payload)
