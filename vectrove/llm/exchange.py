"""Which keys occur more than once anywhere? Answered for billions of keys in compact rows.

Each block (a group of documents) sends its distinct keys once, sorted and cut by key range into buckets: one row for a
block and bucket. A bucket's task counts them and answers each block with one bit a key, in the block's own order. A key
that a third of all rows hold is sent once by each block, so no bucket grows with a hot key. In place of the bit the answer
may be a byte: at how many places the key occurs, a block with several counting as two, 255 at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import U

SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])
ANSWER = pa.schema([("block", pa.int32()), ("round", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])
SENT_DDL = "bucket int, block int, keys binary, many binary"
ANSWER_DDL = "block int, round int, bucket int, n int, bits binary"


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of an (n, width) array, width 1 or 2, and how often each occurs."""
    if keys.shape[1] == 1:
        found, many = np.unique(keys[:, 0], return_counts=True)
        return found[:, None], many
    keys = keys[np.lexsort(keys.T[::-1])]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)][: len(keys)])
    return keys[first], np.diff(np.r_[first, len(keys)])


def places(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each row of keys among the sorted distinct rows `found`, all of which are present."""
    if found.shape[1] == 1:
        return np.searchsorted(found[:, 0], keys[:, 0])
    order = np.lexsort(keys.T[::-1])
    ranked = keys[order]
    step = np.r_[False, (ranked[1:] != ranked[:-1]).any(axis=1)][: len(keys)]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step)
    return out


def sent(block: int, found: np.ndarray, many: np.ndarray, buckets: int) -> pa.Table:
    """The block's rows for the buckets."""
    bucket = (((found[:, 0] >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    twice = (many > 1).astype(np.uint8)
    rows = [(cut[b], cut[b + 1]) for b in full]
    return pa.table([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int32()), pa.array([found[i:j].tobytes() for i, j in rows], pa.binary()), pa.array([np.packbits(twice[i:j]).tobytes() for i, j in rows], pa.binary())], schema=SENT)


def answers(rows: DataFrame, width: int, round_: int, counts: bool = False) -> DataFrame:
    """For each block and bucket: bits of the block's keys, set where the key occurs at two places or more; or its counts, as bytes."""

    def count(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, U).reshape(-1, width) for x in table["keys"].to_pylist()]
        sizes = np.array([len(k) for k in keys])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["many"].to_pylist(), sizes)])
        keys = np.concatenate(keys)
        found, _ = distinct(keys)
        at = places(found, keys)
        total = np.bincount(at, 1 + twice, len(found))
        found = (np.minimum(total, 255) if counts else total > 1).astype(np.uint8)[at]
        parts = np.split(found, np.cumsum(sizes)[:-1])
        n = len(parts)
        return pa.table([table["block"].combine_chunks(), pa.array([round_] * n, pa.int32()), table["bucket"].combine_chunks(), pa.array(sizes, pa.int32()), pa.array([(p if counts else np.packbits(p)).tobytes() for p in parts], pa.binary())], schema=ANSWER)

    return rows.groupBy("bucket").applyInArrow(count, ANSWER_DDL)


def answered(table: pa.Table, round_: int, counts: bool = False) -> np.ndarray:
    """The bits, or counts, for a block's sorted distinct keys."""
    rows = sorted((b, n, bits) for r, b, n, bits in zip(*(table[c].to_pylist() for c in ("round", "bucket", "n", "bits"))) if r == round_)
    if not rows:
        return np.empty(0, np.uint8 if counts else bool)
    if counts:
        return np.concatenate([np.frombuffer(found, np.uint8) for _, _, found in rows])
    return np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=n) for _, n, bits in rows]).astype(bool)
