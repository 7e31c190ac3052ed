"""Web archives: one gzip member per record, written and read in sequence.

Archives are rows ``(archive_id, content)`` of bounded size, so that Spark's own writers
and readers move them through any store; ``content`` is a byte-exact ``.warc.gz`` file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 8 << 20
#: Bytes that the reader inflates at a time.
READ_BYTES = 1 << 16

_END = b"\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit carries the HTTP header alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END * 2 + block + _END * 2


class Members:
    """The inflated bytes of one gzip member after the other."""

    def __init__(self, content: bytes, step: int = READ_BYTES):
        self.content, self.step, self.at = memoryview(content), step, 0

    def __iter__(self) -> Iterator[Iterator[bytes]]:
        while self.at < len(self.content):
            yield self._member()

    def _member(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            part = self.content[self.at : self.at + self.step]
            if not len(part):
                raise ValueError("truncated gzip member")
            self.at += len(part)
            data = z.decompress(part)
            if z.eof:
                self.at -= len(z.unused_data)
            if data:
                yield data


def _frame(parts: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record: header lines, then exactly content-length bytes."""
    buffer = bytearray()
    while (head := buffer.find(_END * 2)) < 0:
        try:
            buffer += next(parts)
        except StopIteration:
            raise ValueError("record header does not end") from None
    version, *lines = bytes(buffer[:head]).decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    del buffer[: head + 4]
    size = int(headers["content-length"])
    for part in parts:
        buffer += part
    if len(buffer) != size + 4 or buffer[size:] != _END * 2:
        raise ValueError("content length and record do not agree")
    return headers, bytes(buffer[:size])


def _agrees(stated: str | None, data: bytes) -> bool:
    """Whether a stated SHA-1 (hexadecimal or Base32) is that of the data; other digests are not verified."""
    name, _, value = (stated or "").partition(":")
    if name.lower() != "sha1":
        return True
    found = hashlib.sha1(data)
    return value.lower() == found.hexdigest() or value.upper() == base64.b32encode(found.digest()).decode()


def _page(header: str | None) -> int | None:
    """The page of a record's name ``<urn:page:N>``; None for other names."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", header or "")
    return int(found[1]) if found else None


def records(content: bytes) -> Iterator[dict]:
    """Read an archive in sequence, verifying every digest and length that it states.

    Records without HTTP headers (``warcinfo`` and the like) are payload as a whole.
    """
    for member in Members(content):
        headers, block = _frame(member)
        if not _agrees(headers.get("warc-block-digest"), block):
            raise ValueError("block digest differs")
        http, payload, fields = b"", block, {}
        if block.startswith(b"HTTP/"):
            http, _, payload = block.partition(_END * 2)
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
        kind, stated = headers["warc-type"], headers.get("warc-payload-digest")
        size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else len(payload)
        if kind == "response" and (not _agrees(stated, payload) or len(payload) != size):
            raise ValueError("payload digest differs")
        digest = stated.partition(":")[2] if stated else hashlib.sha1(payload).hexdigest()
        yield {"page_id": _page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": _page(headers.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": size, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """Archive every page; returns ``archive_id, content``.

    Of pages with equal payloads of at least ``min_revisit_bytes``, that with the largest
    page_id is stored and the others revisit it.  A null html is an empty payload; rows
    repeated with the largest page_id are stored each; a null page_id is below all others
    and is written without a record id (if all ids of a payload are null, each is stored).
    """
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    flat = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "n": F.length("payload")})
    shared = flat.filter(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "stored")
    rows = flat.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("stored").eqNullSafe(F.col("page_id")), F.col("stored")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, content = TaskContext.get().partitionId(), 0, bytearray()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}.warc.gz"]), pa.array([bytes(content)], pa.binary())], names=["archive_id", "content"])

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(map(lambda v: v.as_py(), b.column(k)) for k in range(5)), strict=True):
                content += _member(record(page_id, url, payload, digest, refers_to))
                if len(content) >= ARCHIVE_BYTES:
                    yield out()
                    n, content = n + 1, bytearray()
        if content:
            yield out()

    return rows.mapInArrow(write, "archive_id string, content binary")


_READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def read_archives(archives: DataFrame, with_payload: bool = False, content_col: str = "content") -> DataFrame:
    """Read archives (rows of ``write_archives``, or Spark's ``binaryFile`` format) record by record.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and, if
    asked, ``url`` and ``payload``.  A record with a wrong length or digest raises; digests
    that are not stated are not asked for, and foreign records have no page_id.
    """
    schema = T.StructType([*_READ.fields, *([T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType())] if with_payload else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.get(k, pa.string())) for k in schema.names], names=schema.names)

        for b in batches:
            for content in b.column(0):
                rows: list[dict] = []
                for r in records(content.as_py()):
                    rows.append(r)
                    if len(rows) == 500:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return archives.select(content_col).mapInArrow(read, schema)
