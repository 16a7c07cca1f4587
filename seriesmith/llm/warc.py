"""WARC archives: a writer, and a reader that salvages what it can.

Archives are ordinary files of gzip members, one for each record, below a shared folder. Spark's text sink writes them, so
they can lie in any store that Spark writes to and come whole or not at all. A member ends with the top byte of its length,
which is zero below 16 MiB; that byte is left to the sink as the separator of rows. A record of 16 MiB or more is written
as several members. A row of the sink has ROW_BYTES of members or little more, and a file ROWS_PER_FILE rows, so files are
rolled by bytes. A file is read whole by one task; Spark's binary source ends at 2 GiB a file.

The reader takes a member or, in plain archives, a version line, checks it (gzip's sum and length, the version line, the
headers, the block's length and digest) and goes on after it. After a failed check it searches for the next gzip member or
version line that starts a valid record and logs the bytes between as quarantined. archive_pages() writes these gaps to a
table beside the archives and warns if there are any, or if fewer records were read than pages written.

Records with equal payloads of ``min_bytes`` or more: that with the largest page_id is a response, the others revisit it
and have no payload of their own. Revisits carry length and digest of the full payload in their headers.

Defined cases: null html counts as empty; null page_ids are smallest; repeated rows with a group's largest page_id are all
responses, and each record has an id of its own; an empty table gives no records; record headers are written in one line
each, so that line ends in a target URI are escaped as percent codes; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import warnings
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmith.llm.common import materialize, scratch_path

VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
HEAD_END = re.compile(rb"\r?\n\r?\n")
MEMBER = b"\x1f\x8b\x08"
#: Bytes that a member may hold for its last byte to be zero.
MEMBER_BYTES = (1 << 24) - 1
#: Bytes of members in a row of the sink, at least, and rows in a file.
ROW_BYTES, ROWS_PER_FILE = 1 << 20, 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 3
READ = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("uri", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_ARROW = pa.schema(
    [(f.name, {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}[f.dataType]) for f in READ]
)


class Record(NamedTuple):
    """A record that passed its checks."""

    headers: dict[str, str]
    block: bytes


class Damaged(ValueError):
    """Bytes that are no valid record; the message says why."""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, uri: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, refers_uri: str | None = None, serial: str = "0", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A record; payload is None for a revisit. serial tells records of one page apart."""
    block = payload or b""
    safe = "!#$%&'()*+,/:;=?@[]~"
    headers = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}:{serial}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(uri or "", safe=safe)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(size)),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if payload is None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", quote(refers_uri or "", safe=safe)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", str(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"%b\r\n%b\r\n%b\r\n\r\n" % (VERSION, head.encode(), block)


def members(record: bytes, level: int = LEVEL) -> bytes:
    """The record as gzip members, of which the last ends with a zero byte."""
    out = []
    for at in range(0, len(record), MEMBER_BYTES):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += [z.compress(record[at : at + MEMBER_BYTES]), z.flush()]
    return b"".join(out)


def parse_record(data: bytes, at: int) -> tuple[Record, int]:
    """The record at a version line, and where it ends; raises Damaged."""
    m = VERSION_LINE.match(data, at)
    if not m:
        raise Damaged("no version line")
    head = HEAD_END.search(data, m.end() - 1)
    if not head:
        raise Damaged("headers are cut")
    headers = {}
    for line in data[m.end() : head.start()].decode("utf-8", "replace").splitlines():
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header has no colon")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise Damaged("no content length")
    end = head.end() + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block's length is wrong")
    block = data[head.end() : end]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{digest32(block)}":
        raise Damaged("the block's digest is wrong")
    return Record(headers, block), end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the member at this place, and where it ends; raises Damaged."""
    z = zlib.decompressobj(31)
    out, view = [], memoryview(data)
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + 16384]))
            at += 16384
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    if not z.eof:
        raise Damaged("gzip: the member is cut")
    return b"".join(out), min(at, len(data)) - len(z.unused_data)


def _record_at(data: bytes, at: int) -> tuple[Record, int]:
    """The record in the members, or at the version line, that start here; raises Damaged."""
    if not data.startswith(MEMBER, at):
        return parse_record(data, at)
    text, end = _inflate(data, at)
    while True:
        try:
            record, length = parse_record(text, 0)
        except Damaged:
            # the record may go on in the next member, which then has no version line
            if len(text) % MEMBER_BYTES or not text or not data.startswith(MEMBER, end):
                raise
            more, end = _inflate(data, end)
            text += more
            continue
        if length != len(text):
            raise Damaged("the member holds more than its record")
        return record, end


def _next_start(data: bytes, at: int) -> int:
    """Where the next member or version line could start; the end if none does."""
    member = data.find(MEMBER, at)
    line = VERSION_LINE.search(data, at)
    return min(x for x in (member if member >= 0 else len(data), line.start() if line else len(data)))


def salvage(data: bytes) -> Iterator[tuple[int, int, Record | str]]:
    """(start, end, record, or why these bytes are quarantined) for all of an archive."""
    at = 0
    gap, why = None, ""
    while at < len(data):
        try:
            record, end = _record_at(data, at)
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at = _next_start(data, at + 1)
            continue
        if gap is not None:
            yield gap, at, why
            gap = None
        yield at, end, record
        at = end
    if gap is not None:
        yield gap, len(data), why


def _number(value: str | None) -> int | None:
    return int(value) if re.fullmatch(r"-?\d+", value or "") else None


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(path: str, start: int, end: int, found: Record | str) -> tuple:
            if isinstance(found, str):
                return path, "gap", start, end, found, None, None, None, None, None, None, None
            h, revisit = found.headers, found.headers.get("warc-type") == "revisit"
            size = int(h.get("x-payload-length", "0")) if revisit else len(found.block)
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest32(found.block)
            refers = _number(h.get("x-refers-to-page")) if revisit else None
            return path, "record", start, end, None, _number(h.get("x-page-id")), h.get("warc-target-uri"), size, digest, h.get("warc-type"), refers, found.block if with_payload else None

        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, held = [], 0
                for x in salvage(data):
                    rows.append(row(path, *x))
                    held += len(rows[-1][-1] or b"") + 300
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _writer(date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of members; the zero byte at the end of a row is the sink's."""
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["members"])

        for batch in batches:
            for page_id, uri, payload, head, head_uri in zip(*(batch.column(c).to_pylist() for c in ("page_id", "uri", "payload", "head", "head_uri")), strict=True):
                revisit = head is not None and head != page_id
                record = record_bytes(page_id, uri, None if revisit else payload, len(payload), digest32(payload), head, head_uri, f"{task}.{n}", date)
                held.append(members(record))
                n, size = n + 1, size + len(held[-1])
                if size >= ROW_BYTES:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return write


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, html: str = "html", url: str | None = "url") -> None:
    """Writes a record for each row of pages (page_id, html and perhaps a url) into archives below path."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    uri = F.col(url) if url else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), uri.alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("_key"))
    large = rows.filter(F.length("payload") >= min_bytes)
    groups = large.groupBy("_key").agg(F.max(F.struct("page_id", "uri")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = materialize(groups.select(F.col("_key").alias("_group"), F.col("head.page_id").alias("head"), F.col("head.uri").alias("head_uri")), "copies")
    typed = rows.join(groups, F.col("_key") == F.col("_group"), "left").select("page_id", "uri", "payload", "head", "head_uri")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    made = typed.mapInArrow(_writer(date), "members binary").select(F.col("members").cast("string").alias("value"))
    made.write.option("lineSep", "\x00").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records (kind record) and quarantined gaps (kind gap) of all archives below path, as READ."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(with_payload), READ)


def salvaged(spark: SparkSession, path: str, quarantine: str, expected: int | None = None) -> DataFrame:
    """The records of the archives below path, without payloads; gaps go to a table (archive, start, end, reason) at quarantine.
    Warns of gaps, and of records missing from those expected."""
    read = materialize(read_archives(spark, path), "records")
    read.filter("kind = 'gap'").select("archive", "start", "end", "reason").write.parquet(quarantine)
    n, gaps = read.agg(F.count_if(F.col("kind") == "record"), F.count_if(F.col("kind") == "gap")).first()
    if gaps or n < (expected or 0):
        warnings.warn(f"{gaps} gaps, logged in {quarantine}; {n} of {expected or 'an unknown number of'} records were read", stacklevel=2)
    return read.filter("kind = 'record'")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """What is read back from archives of pages: a row for each record."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes, url="url" if "url" in pages.columns else None)
    return salvaged(spark, path, scratch_path(spark, "quarantine"), pages.count())
