"""WARC archives: written by tasks, read back by a splittable Spark data source.

A task of the reader scans its byte range for gzip's first bytes, takes a place for a member only if a whole gzip member
decodes there to a WARC header, and then goes from member to member; it owns the records that start in its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .archives import SPAN, ByteRange, batches, byte_ranges
from .storage import file_system, shared_path

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: High halves of record ids: of a page id, and of a null one. They mark version 8 (free form) UUIDs.
KNOWN, NONE = 0x766563_74726F_8000, 0x766563_74726F_8001
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def record_id(page_id: int | None) -> str:
    return f"<{uuid.UUID(int=(NONE << 64) if page_id is None else (KNOWN << 64) | (page_id & (1 << 64) - 1)).urn}>"


def page_of(record: str) -> int | None:
    whole = uuid.UUID(record.strip("<>")).int
    low = whole & (1 << 64) - 1
    return None if whole >> 64 == NONE else low - (1 << 64) * (low >> 63)


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id, url, payload: bytes, digest: str, size: int, response: bool, refers_to) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if response else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f%]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(raw: bytes) -> tuple:
    """The row of a decoded record; its digest and sizes are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: ")))
    digest, response = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
    if rest[len(block) :] != b"\r\n\r\n" or response and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    if url is not None and "%" in url:
        url = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), url.encode()).decode()
    return page_of(fields["WARC-Record-ID"]), url, fields["WARC-Type"], None if response else page_of(fields["WARC-Refers-To"]), digest, size, payload if response else None


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.span = options["path"], int(options.get("span", SPAN))

    def partitions(self):
        return byte_ranges(self.folder, ".warc.gz", self.span)

    def read(self, part: ByteRange):
        return batches(self._records(part), ARROW, lambda row: len(row[6] or b""))

    def _records(self, part: ByteRange):
        if not part.path:
            return
        system, path = file_system(part.path)
        with system.open_input_file(path) as f:
            at = first_member(f, part.start, part.end)
            while at is not None and at < part.end:
                raw, at = member(f, at)
                yield parse_record(raw)


def member(f, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The decoded gzip member at an offset, and the offset after it; ValueError if there is none."""
    unpack, parts, size = zlib.decompressobj(31), [], f.size()
    here = at
    while not unpack.eof:
        f.seek(here)
        data = f.read(min(step, size - here))
        if not data:
            raise ValueError(f"a member at {at} does not end")
        try:
            parts.append(unpack.decompress(data))
        except zlib.error as e:
            raise ValueError(f"no member at {at}") from e
        if len(parts) == 1 and parts[0] and not parts[0][:7] == b"WARC/1."[: len(parts[0])]:
            raise ValueError(f"no WARC record at {at}")
        here += len(data)
    raw = b"".join(parts)
    if raw[:7] != b"WARC/1.":
        raise ValueError(f"no WARC record at {at}")
    return raw, here - len(unpack.unused_data)


def first_member(f, start: int, end: int, step: int = 1 << 20) -> int | None:
    """Offset of the first member that starts in [start, end)."""
    at, size = start, f.size()
    while at < end:
        f.seek(at)
        window = f.read(min(step, end - at + len(MAGIC) - 1, size - at))
        here = window.find(MAGIC)
        while here >= 0:
            try:
                member(f, at + here)
                return at + here
            except ValueError:
                here = window.find(MAGIC, here + 1)
        at += max(1, len(window) - len(MAGIC) + 1)
    return None


class WarcSource(DataSource):
    """spark.read.format("vectrove_warc").load(folder): a row per response and revisit record."""

    @classmethod
    def name(cls):
        return "vectrove_warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def write_warc(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> int:
    """Write a record per page; returns the number of records.

    Of equal payloads of at least `least` bytes, that with the largest page id is the response, also where it repeats,
    and the others revisit it. Only digests met more than once go into the join that finds it; its skew is Spark's to split.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    best = rows.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null").drop("n")
    rows = rows.join(best, "sha", "left").withColumn("response", F.expr(f"best is null or size < {int(least)} or page_id <=> best"))
    rows = rows.select("page_id", "url", F.expr("if(response, payload, null)").alias("payload"), "sha", "size", "response", F.expr("if(response, null, best)").alias("best"))

    def write(parts):
        part, n = TaskContext.get().partitionId(), 0
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        final = f"{path}/part-{part:07d}.warc.gz"
        partial = f"{final}.{TaskContext.get().taskAttemptId()}.partial"
        with system.open_output_stream(partial) as out:
            for batch in parts:
                for page_id, url, payload, sha, size, response, best_id in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(make_record(page_id, url, payload or b"", base64.b32encode(bytes.fromhex(sha)).decode(), size, response, best_id))
                    n += 1
        system.move(partial, final)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_warc(spark: SparkSession, folder: str, span: int = SPAN) -> DataFrame:
    """The records of all archives in a folder."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("vectrove_warc").option("span", str(span)).load(folder)


def warc_round_trip(pages: DataFrame, least: int = 0, folder: str | None = None, span: int = SPAN) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives and read them back, a row per page.

    Columns as in SCHEMA; payload is null for revisits, whose size and digest are those of the full payload. A null html is
    an empty payload; a null page id is only a response if no equal payload has an id; other columns are ignored; no rows
    in, no rows out.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    write_warc(pages, folder, least)
    return read_warc(pages.sparkSession, folder, span)
