"""What the archive sources share: listing, byte-range partitions, and Arrow batches of bounded size."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import InputPartition

from .storage import file_system

#: Bytes of an archive that one task reads, and of payloads that go into one Arrow batch.
SPAN, BATCH = 8 << 20, 4 << 20


@dataclass
class ByteRange(InputPartition):
    """Members that start in [start, end) of an archive."""

    path: str
    start: int
    end: int


def byte_ranges(folder: str, suffix: str, span: int) -> list[ByteRange]:
    """Ranges over all archives of a folder, planned from names and sizes alone; at least one, so that no archive is no row."""
    system, path = file_system(folder)
    prefix = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
    files = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and f.path.endswith(suffix))
    return [ByteRange(prefix + p, i, min(i + span, n)) for p, n in files for i in range(0, n, span)] or [ByteRange("", 0, 0)]


def batches(rows, schema: pa.Schema, size_of):
    """Arrow batches of rows (tuples), cut when the payloads reach BATCH bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= BATCH:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
