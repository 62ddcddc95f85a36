"""Media columns: payloads stored as 8-bit grey images in archive folders, read back by a Spark data source.

Writing: each task streams one zip archive of PNG members (stored as they are) to the shared folder, under a temporary
name that is moved at the end; a retried task replaces its archive by one of equal content. Reading: the source plans
byte ranges over the archives; a task reads an archive's central directory, takes the members that start in its range,
and reads each by its offset, again from the start if a read or its checksum fails, without touching the others.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .archives import SPAN, ByteRange, batches, byte_ranges
from .storage import file_system, shared_path
from .substring import table_type
from .words import small

#: Samples of an image row, PNG's first bytes, reads of a member before its task fails.
WIDTH, MAGIC, TRIES = 576, b"\x89PNG\r\n\x1a\n", 3
SCHEMA = "id string, n_bytes long, media binary, payload binary"
ARROW = pa.schema([("id", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary())])


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of WIDTH."""
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)


def to_png(payload: bytes) -> bytes:
    """The payload as an 8-bit grey image, WIDTH samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png has made; ValueError for anything else."""
    at, data, shape = len(MAGIC), b"", None
    if media[:at] != MAGIC:
        raise ValueError("not a PNG file")
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum of a PNG chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += size + 12
    if shape is None or shape[2:4] != (8, 0):
        raise ValueError("only 8-bit grey images are read")
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return lines[:, 1:].tobytes()


def write_media(rows: DataFrame, folder: str, id_col: str, text_col: str) -> int:
    """Store each text's bytes as a member, an archive for each task that has rows; returns the number of members."""

    def write(parts):
        part = TaskContext.get().partitionId()
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        final, n = f"{path}/part-{part:07d}.zip", 0
        partial = f"{final}.{TaskContext.get().taskAttemptId()}.partial"
        with system.open_output_stream(partial) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for batch in small(parts):
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = text or b""
                    info = zipfile.ZipInfo(f"{n:09d}.png")
                    info.comment = json.dumps({"id": name, "n_bytes": len(raw)}).encode()
                    archive.writestr(info, to_png(padded(raw)))
                    n += 1
        if n:
            system.move(partial, final)
        else:
            system.delete_file(partial)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.span = options["path"], int(options.get("span", SPAN))

    def partitions(self):
        return byte_ranges(self.folder, ".zip", self.span)

    def read(self, part: ByteRange):
        return batches(self._members(part), ARROW, lambda row: len(row[2]) + len(row[3]))

    def _members(self, part: ByteRange):
        if not part.path:
            return
        system, path = file_system(part.path)
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if part.start <= m.header_offset < part.end]
        for member in members:
            about, media, payload = json.loads(member.comment), *self._member(system, path, member)
            yield about["id"], about["n_bytes"], media, payload

    @staticmethod
    def _member(system, path: str, member: zipfile.ZipInfo) -> tuple[bytes, bytes]:
        """One member by its offset, on a new handle for each try."""
        for left in range(TRIES - 1, -1, -1):
            try:
                with system.open_input_file(path) as f:
                    f.seek(member.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError(f"no member at {member.header_offset} of {path}")
                    names = sum(struct.unpack_from("<HH", head, 26))
                    f.seek(member.header_offset + 30 + names)
                    media = f.read(member.compress_size)
                if zlib.crc32(media) != member.CRC:
                    raise ValueError(f"bad checksum of the member at {member.header_offset} of {path}")
                return media, from_png(media)
            except (OSError, ValueError, zlib.error):
                if not left:
                    raise


class MediaSource(DataSource):
    """spark.read.format("vectrove_media").load(folder): id, n_bytes, media (the stored form), payload."""

    @classmethod
    def name(cls):
        return "vectrove_media"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MediaReader(self.options)


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of which tiles are brighter than their neighbour."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    mean = float(counts @ np.arange(256)) / len(x)
    spread = max(0.0, float(counts @ np.arange(256) ** 2) / len(x) - mean * mean) ** 0.5
    rows = x.reshape(-1, WIDTH)
    edges = np.linspace(0, len(rows), 9).astype(int)
    tiles = [rows[i : max(j, i + 1)].reshape(-1, 9, WIDTH // 9).mean(axis=(0, 2)) if i < len(rows) else np.zeros(9) for i, j in zip(edges, edges[1:])]
    bits = np.packbits(np.array([t[1:] > t[:-1] for t in tiles])).tobytes().hex()
    return f"{mean:.4f},{spread:.4f},{float(-(share * np.log2(share)).sum()) + 0.0:.4f},{bits}"


def read_media(spark: SparkSession, folder: str, span: int = SPAN) -> DataFrame:
    """The members of all archives in a folder."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("vectrove_media").option("span", str(span)).load(folder)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Store whole texts as media, read them back, and describe what was read.

    Returns the id, n_bytes (of the text), payload_bytes, payload_sha256, tail_crc32 (of the last 32 payload bytes),
    media_bytes, media_sha256 and feature; equal texts give equal values. Null and empty texts are one row of 255;
    repeated rows are members of their own; other columns are ignored; no rows in, no rows out. Map only, no shuffle.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "media")
    write_media(docs, folder, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("id", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def describe(parts):
        for batch in parts:
            rows = [(i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)) for i, n, m, p in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_media(spark, folder).mapInArrow(describe, ddl).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
