"""WARC archives: written by tasks, read back through a Python data source.

Each record is a gzip member of its own, whose header tells its compressed length.  The source plans
one partition for each range of a file between members, takes predicates on record type and header
fields, inflates a record's headers first and its payload only if the record passes and payloads are
wanted; otherwise it skips to the next member.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from .common import filesystem, shared_dir, stage

#: Bytes of records after which a task begins a new file.
FILE_BYTES = 256 << 20
#: Bytes of a file that make one input partition; cuts lie between records.
SPLIT_BYTES = 32 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HEAD = struct.Struct("<10sH2sHII")

#: Column of the source and the header field it holds.
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, payload binary"


def record_id(number: int) -> str:
    """A URN that holds a 64-bit id."""
    return f"<urn:uuid:{uuid.UUID(int=number & (1 << 64) - 1)}>"


def number_of(name: str | None) -> int | None:
    if not name:
        return None
    value = uuid.UUID(name[10:-1]).int
    return value - (1 << 64) if value >> 63 else value


def number_column(name: str) -> Column:
    """The 64-bit id in a column of record names; null for names of other kinds."""
    hexadecimal = F.regexp_replace(F.substring(name, 30, 17), "-", "")
    number = F.conv(hexadecimal, 16, -10).cast("long")
    return F.when(F.col(name).startswith("<urn:uuid:00000000-0000-0000-"), number).alias(name)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(kind: str, name: str, uri: str | None, sha1: str, size: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date)]
    if uri and _line(uri):
        fields.append(("WARC-Target-URI", _line(uri)))
    fields.append(("WARC-Payload-Digest", f"sha1:{sha1}"))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(content: bytes) -> bytes:
    """A gzip member with the extra field ``sl``: its own length and that of its content."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(content) + squeeze.flush()
    length = _HEAD.size + len(body) + 8
    head = _HEAD.pack(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", 12, b"sl", 8, length, len(content))
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


class _Archive:
    """A file of records, with the offsets at which a reader may begin."""

    def __init__(self, folder: str):
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        self.name, self.size, self.records, self.splits = f"{uuid.uuid4().hex}.warc.gz", 0, 0, [0]
        self.sink = fs.open_output_stream(f"{path}/{self.name}", compression=None)

    def add(self, content: bytes) -> None:
        if self.size - self.splits[-1] >= SPLIT_BYTES:
            self.splits.append(self.size)
        member = gzip_member(content)
        self.sink.write(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.sink.close()
        return self.name, self.size, self.records, self.splits


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True)


def write_archives(
    pages: DataFrame,
    least_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    folder: str | None = None,
) -> DataFrame:
    """Write a record for every page; return the manifest (folder, file, bytes, records, splits).

    Of pages with equal payloads of ``least_bytes`` or more, the one with the smallest id is a response
    and the others revisit it; rows that repeat that id are responses too.  A null page counts as empty; a null url has
    no target field; a page without an id is a response under a name of its own and is never
    revisited.  No pages: no files.  A task that runs again writes files under new names, and only
    files in the manifest count.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    narrow = rows.select("id", F.length("payload").cast("long").alias("size"), F.unhex(F.sha1("payload")).alias("sha1"))
    narrow = stage(narrow, "payloads").where(F.col("id").isNotNull() & (F.col("size") >= least_bytes))
    first = narrow.groupBy("sha1", "size").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # Only payloads that repeat are looked up; their narrow rows are joined, never the payloads.
    revisits = stage(narrow.join(first, ["sha1", "size"]).where("id <> first").select("id", "sha1", "size", "first").distinct(), "revisits")
    again = revisits.select("id", F.col("sha1").alias("again"), "first")
    # An id may repeat with another payload, so the payload is compared too.
    marked = rows.join(again, (rows["id"] == again["id"]) & (F.unhex(F.sha1(rows["payload"])) == again["again"]), "left")
    marked = marked.select(rows["id"], "url", "first", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for number, url, first_id, body in _rows(batches):
            name = record_id(number) if number is not None else f"<urn:uuid:{uuid.UUID(int=uuid.uuid4().int | 1 << 127)}>"
            kind, kept = ("response", body) if first_id is None else ("revisit", b"")
            target = record_id(first_id) if first_id is not None else None
            archive = archive or _Archive(folder)
            archive.add(record(kind, name, url, digest(body), len(body), kept, target, date))
            if archive.size >= FILE_BYTES:
                done.append(archive.close())
                archive = None
        if archive:
            done.append(archive.close())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=["file", "bytes", "records", "splits"])

    written = marked.mapInArrow(write, "file string, bytes long, records long, splits array<long>")
    return stage(written, "warc-manifest").select(F.lit(folder).alias("folder"), "file", "bytes", "records", "splits")


@dataclass
class Range(InputPartition):
    """Bytes of one file, from the start of a record on."""

    path: str
    begin: int
    end: int


class _Stream:
    """A buffered part of a file."""

    def __init__(self, source, begin: int, end: int):
        self.source, self.left, self.buffer = source, end - begin, b""
        source.seek(begin)

    def need(self, size: int) -> bytes:
        """The buffer, with ``size`` bytes or all that are left."""
        while len(self.buffer) < size and self.left > 0:
            data = self.source.read(min(self.left, max(1 << 20, size - len(self.buffer))))
            if not data:
                break
            self.left -= len(data)
            self.buffer += data
        return self.buffer

    def drop(self, size: int) -> None:
        self.buffer = self.buffer[size:]


def members(source, begin: int, end: int) -> Iterator[_Member]:
    stream = _Stream(source, begin, end)
    while head := stream.need(_HEAD.size)[: _HEAD.size]:
        fields = _HEAD.unpack(head) if len(head) == _HEAD.size else None
        if fields and fields[0][3] & 4 and fields[2] == b"sl":
            length = fields[4]
            raw = stream.need(length)[:length]
            if len(raw) < length:
                raise ValueError("a record breaks off")
            yield _Member(raw)
        else:  # from another writer: the end shows only when all is inflated
            inflate, text, length = zlib.decompressobj(31), b"", 0
            while not inflate.eof:
                data = stream.need(length + 1)[length:]
                if not data:
                    raise ValueError("a record breaks off")
                text += inflate.decompress(data)
                length += len(data) - len(inflate.unused_data)
            yield _Member(b"", text)
        stream.drop(length)


class _Member:
    """One record; what is not asked for is not inflated."""

    def __init__(self, raw: bytes, text: bytes = b""):
        self.rest, self.text, self.inflate = raw, text, zlib.decompressobj(31)

    def _pull(self) -> bool:
        data = self.inflate.unconsumed_tail or self.rest[:4096]
        if not self.inflate.unconsumed_tail:
            self.rest = self.rest[4096:]
        found = self.inflate.decompress(data, 2048) if data else b""
        self.text += found
        return bool(data)

    def _block(self) -> bytes:
        """What stands before the next empty line."""
        while b"\r\n\r\n" not in self.text and self._pull():
            pass
        head, _, self.text = self.text.partition(b"\r\n\r\n")
        return head

    def head(self) -> dict[str, str]:
        lines = self._block().decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def http_length(self) -> int | None:
        """The payload's length by the HTTP header that opens the block."""
        for line in self._block().split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            if k.strip().lower() == b"content-length":
                return int(v)
        return None

    def payload(self, size: int) -> bytes:
        if not self.inflate.eof:
            self.text += self.inflate.decompress(self.inflate.unconsumed_tail + self.rest)
        return self.text[:size]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges = [Range(*r) for r in json.loads(options["ranges"])]
        self.decode = options.get("payload", "true") == "true"
        self.tests: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes equality, membership and not-null of header columns; hands back the others."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in FIELDS and isinstance(f, (EqualTo, In, IsNotNull)):
                values = None if isinstance(f, IsNotNull) else frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.tests.append((FIELDS[name].lower(), values))
            else:
                yield f

    def partitions(self) -> list[Range]:
        return self.ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = filesystem(partition.path)
        rows, held = [], 0
        with fs.open_input_file(path) as source:
            for member in members(source, partition.begin, partition.end):
                head = member.head()
                if all(k in head and (v is None or head[k] in v) for k, v in self.tests):
                    size = member.http_length() if "application/http" in head.get("content-type", "") else int(head.get("content-length", 0))
                    body = None
                    if self.decode and head.get("warc-type") != "revisit":
                        body = member.payload(size or 0)
                        told = head.get("warc-payload-digest", "")
                        if told.startswith("sha1:") and told[5:] != digest(body):
                            raise ValueError(f"payload of {head.get('warc-record-id')} differs from its digest")
                    rows.append((*(head.get(f.lower()) for f in FIELDS.values()), size, body))
                    held += len(body or b"") + 500
                if held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * len(FIELDS) + [pa.int64(), pa.binary()]
        names = [*FIELDS, "payload_bytes", "payload"]
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


class WarcSource(DataSource):
    """Format ``warc_records``; options: ``ranges`` (JSON list of path, begin, end) and ``payload`` (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "warc_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_archives(spark: SparkSession, manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the files in a manifest; with ``payload=False`` bodies are never inflated into rows."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ranges = []
    for r in manifest.collect():  # one row per file
        for begin, end in zip(r["splits"], [*r["splits"][1:], r["bytes"]], strict=True):
            ranges.append((f"{r['folder'].rstrip('/')}/{r['file']}", begin, end))
    options = {"ranges": json.dumps(ranges), "payload": str(payload).lower()}
    return spark.read.format("warc_records").options(**options).load()
