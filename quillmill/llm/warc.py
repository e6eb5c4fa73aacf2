"""WARC archives: a writer with revisit records, and a sequential reader.

Every record is a gzip member of its own. The reader inflates a member piece
by piece, frames the block by Content-Length, and verifies block and payload
digests while the bytes pass, so memory does not depend on a record's size.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, scratch, written

ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 18
DATE = "1970-01-01T00:00:00Z"  # records carry no time of capture; a fixed one keeps archives reproducible
REVISIT_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _hex(value: str) -> str:
    return base64.b32decode(value.removeprefix("sha1:")).hex()


def _line(value: str) -> str:
    """A header value without control characters or blanks, which are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member: a response, or where ``refers_to`` is given a revisit of that page's response."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}{':revisit' if revisit else ''}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {_b32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None

    @property
    def page_id(self) -> int | None:
        number = self.headers["warc-record-id"].removeprefix("<urn:page:").removesuffix(">").removesuffix(":revisit")
        return int(number) if number else None

    @property
    def refers_to(self) -> int | None:
        at = self.headers.get("warc-refers-to")
        return int(at.removeprefix("<urn:page:").removesuffix(">")) if at else None


class _Member:
    """The inflated bytes of one gzip member."""

    def __init__(self, source, ahead: bytes):
        self.source, self.ahead, self.z, self.buffer = source, ahead, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        if self.z.eof:
            return False
        data = self.z.unconsumed_tail
        if not data:
            data, self.ahead = self.ahead or self.source.read(BLOCK), b""
        if not data:
            raise WarcError("the archive ends within a record")
        self.buffer += self.z.decompress(data, BLOCK)
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if len(self.buffer) > most or not self.more():
                raise WarcError("a header has no end")
        head = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self.more():
                raise WarcError("the block is shorter than its Content-Length")
            got = bytes(self.buffer[:n])
            del self.buffer[: len(got)]
            n -= len(got)
            if got:
                yield got

    def rest(self) -> bytes:
        """What follows the block; the member has to end soon."""
        while len(self.buffer) <= 4 and self.more():
            pass
        return bytes(self.buffer)


def _fields(head: bytes) -> dict[str, str]:
    rows = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (r.partition(":") for r in rows)}


def read_records(source, keep_payload: bool = False) -> Iterator[Record]:
    """Records of an archive, in its order. ``source`` has ``read(n)``. Raises WarcError on any flaw."""
    ahead = source.read(BLOCK)
    while ahead:
        member = _Member(source, ahead)
        head = member.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise WarcError("a record does not start with its version")
        headers = _fields(head)
        left = int(headers["content-length"])
        block, payload, size, kept = hashlib.sha1(), hashlib.sha1(), 0, bytearray()
        http: bytes | None = b""
        for data in member.take(left):
            block.update(data)
            if http is not None:
                http += data
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                fields, data, http = _fields(http[:at]), http[at + 4 :], None
            payload.update(data)
            size += len(data)
            if keep_payload:
                kept += data
        if http is not None:
            raise WarcError("the block has no HTTP header")
        if member.rest() != b"\r\n\r\n":
            raise WarcError("a record does not end with two line ends")
        if _b32(block.digest()) != headers["warc-block-digest"]:
            raise WarcError("the block digest differs")
        if headers["warc-type"] == "response":
            if size != int(fields["content-length"]) or _b32(payload.digest()) != headers["warc-payload-digest"]:
                raise WarcError("the payload digest differs")
        elif size:
            raise WarcError("a revisit has a payload")
        yield Record(headers, int(fields["content-length"]), _hex(headers["warc-payload-digest"]), bytes(kept) if keep_payload else None)
        ahead = member.z.unused_data or member.ahead or source.read(BLOCK)


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``; a table (path, records) of those complete.

    Of equal payloads of at least ``least`` bytes the page with the largest id
    is a response and the others revisit it; where the largest id is repeated,
    each of its rows is a response, as are equal payloads without any id. Null
    html is an empty payload. Files carry their task attempt's number, and the
    table names only files of attempts that ended well, so a lost executor or
    a second attempt leaves no record twice.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    tops = p.where(large).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("k")).where("k > 1").select("digest", "top")
    tops = written(tops, "tops")  # both sides of the join are then plain shuffles, and a hot digest can be split
    p1 = p.where(large).join(tops, "digest", "left").select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top")).alias("refers_to"))
    rows = p1.union(p.where(~large).select("page_id", "url", "payload", F.lit(None).cast("long")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        made: list[tuple[str, int]] = []
        out, size, n, name = None, 0, 0, ""
        for b in batches:
            for page_id, url, payload, refers in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    name, size, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):05d}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id, url, payload, refers)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append((name, n))
                    out = None
        if out is not None:
            out.close()
            made.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{m[0]}" for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "records"])

    return written(rows.mapInArrow(write, "path string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of ``archives`` (path).

    A file with a flaw fails the job rather than losing records.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("path").to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as f:
                    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.headers["warc-type"], r.refers_to) for r in read_records(f)]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = archives.select("path").repartition(parts(archives.sparkSession))
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back: a row per row of ``pages``.

    Nulls, ties and repeated rows as in ``write_archives``. A very long payload
    is compressed whole when written and read in blocks.
    """
    return read_archives(write_archives(pages, scratch(pages.sparkSession, "warc")))
