"""WARC archives: a writer with revisit records, and a reader that splits gzip archives by byte ranges.

The reader's tasks each take a byte range of a file.  A task looks for the gzip magic, takes a place for a member's
start only if the bytes from there decompress to a WARC header, and owns the records that start inside its range; a
record that runs over the end is read to its end by its owner.  So a file is read in parallel, each record once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, shared_dir

MAGIC = b"\x1f\x8b\x08"
# Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, bytes long, records long"
RECORDS = "path string, offset long, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_RECORD_SCHEMA = pa.schema([(n, pa.int64() if k == "long" else pa.binary() if k == "binary" else pa.string()) for n, k in (x.split(" ") for x in RECORDS.split(", "))])
PREFIX = "urn:page:"


def _line(value: object) -> str:
    """A header value on one line."""
    return "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in str(value))


def record(kind: str, name: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record; a revisit keeps the HTTP header with the payload's length and digest but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"WARC-Target-URI: {_line(uri)}"] * (uri is not None)
    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if kind == "revisit" else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 3, folder: str | None = None) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html), an archive a partition; returns (path, bytes, records).

    Of rows whose payloads (html in UTF-8, null: empty) are equal and of least_bytes or more, those with the largest page_id
    are responses and the others revisits of it; smaller payloads are all responses.  A null page_id is never the largest; where
    all are null, all are responses.  An archive appears under its name only when it is whole, and a task that runs
    again writes the same records to the same name.  An empty table writes archives without records.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    base = pages.selectExpr("cast(page_id as long) AS page_id", "url", "cast(coalesce(html, '') as binary) AS payload").withColumn("digest", F.sha1("payload"))
    sized = base.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
    repeated = kept(sized.agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL").drop("n"), "repeated")
    rows = base.join(repeated, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/part-{context.partitionId():06d}.warc.gz"
        part, total, n = f"{root}/.{context.partitionId()}-{context.taskAttemptId()}", 0, 0
        with fs.open_output_stream(part) as out:
            for batch in batches:
                for page, url, payload, keeper in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    kind, other = ("response", None) if keeper is None else ("revisit", f"{PREFIX}{keeper}")
                    member = gzip.compress(record(kind, f"{PREFIX}{'' if page is None else page}", url, payload, other, date), level, mtime=0)
                    out.write(member)
                    total += len(member)
                    n += 1
        fs.move(part, path)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([total]), pa.array([n])], ["path", "bytes", "records"])

    return kept(rows.mapInArrow(run, FILES), "archives")


class _Source:
    """Reads of a file at any place, a block at a time."""

    def __init__(self, uri: str, block: int = 1 << 20) -> None:
        fs, path = FileSystem.from_uri(uri)
        self.file, self.block = fs.open_input_file(path), block
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(n, self.block), at) if at < self.size else b""
        return self.held[at - self.at : at - self.at + n]

    def member(self, at: int, start: bytes = b"WARC/") -> tuple[bytes, int] | None:
        """(decompressed member, place after it) if a gzip member that begins with start stands there, else None."""
        codec, out, seen, place = zlib.decompressobj(31), [], b"", at
        try:
            while not codec.eof:
                step = 1 << 10 if place == at else 1 << 16
                data = self.read(place, step)
                if not data:
                    return None
                got = codec.decompress(data)
                place += len(data)
                out.append(got)
                seen = (seen + got)[: len(start)] if len(seen) < len(start) else seen
                if not start.startswith(seen):
                    return None
        except zlib.error:
            return None
        return (b"".join(out), place - len(codec.unused_data)) if seen == start else None


def members(uri: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that start in [start, end) of a gzip archive."""
    source, at = _Source(uri), start
    while at < min(end, source.size):
        window = source.read(at, 1 << 16)
        found = window.find(MAGIC)
        if found < 0 or at + found >= end:
            if len(window) < len(MAGIC) or found >= 0:
                return
            at += len(window) - len(MAGIC) + 1
            continue
        at += found
        member = source.member(at)
        if member is None:
            at += 1
            continue
        yield at, member[0]
        at = member[1]


def _digest(value: str) -> str | None:
    """Bare lower-case hex of a digest header's value, be it in base 32 or in hex."""
    text = value.split(":", 1)[-1].strip()
    try:
        return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()
    except ValueError:
        return text.lower()


def parse(path: str, offset: int, data: bytes) -> tuple:
    """A row of RECORDS. A response's digest and length are those of its payload as read, a revisit's those it states."""
    head, _, block = data.partition(b"\r\n\r\n")
    names = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        names[k.strip().lower()] = v.strip()
    block = block[: int(names.get("content-length", len(block)))]
    kind, payload, stated = names.get("warc-type"), block, None
    if names.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        lengths = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        stated = int(lengths[0]) if lengths else None
    bare = lambda x: x.strip("<>") if x else None
    if kind == "revisit":
        found = (_digest(names["warc-payload-digest"]) if "warc-payload-digest" in names else None, stated, None)
    else:
        found = (hashlib.sha1(payload).hexdigest(), len(payload), payload)
    return path, offset, kind, bare(names.get("warc-record-id")), names.get("warc-target-uri"), names.get("warc-date"), bare(names.get("warc-refers-to")), *found


def read_archives(files: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """One row of RECORDS per record of gzip archives, from rows (path, bytes).

    Ranges of range_bytes are dealt out over the tasks.  An archive without records gives no rows; bytes that don't begin a
    record are passed over.  A payload that itself is a stored (not compressed) gzip WARC and spans a whole range could be taken
    for records; compressed members as written here never hold one.
    """
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD_SCHEMA, strict=True)], schema=_RECORD_SCHEMA)

        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                for offset, data in members(path, start, start + range_bytes):
                    rows.append(parse(path, offset, data))
                    size += len(data)
                    if size > 4 << 20 or len(rows) >= 1000:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    return ranges.repartition(tasks, "path", "start").mapInArrow(run, RECORDS)
