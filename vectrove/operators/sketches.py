"""Quantile sketches of whole vectors, built in Arrow batches, and percentiles per dimension from them.

All dimensions of a group's vectors have the same number of values, so one ladder of buffers serves them all: a buffer is a
matrix, each column in its own order. A buffer of more than SIZE rows is sorted by column and every other row goes up a level,
where a row stands for twice as many values. That moves no value's rank by more than the weight of a row, so the sum of those
weights, kept with the sketch, is a proven bound of the rank error: at most n / SIZE a level, log2(n / SIZE) levels. Groups of
SIZE vectors or fewer are never thinned and exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import doubles
from ..shared import stored

#: Rows of a buffer; bytes that a task holds before it sends its sketches on; sketches of a group are first merged in so many shares.
SIZE, BYTES, SHARES = 1024, 64 << 20, 64


class Sketch:
    """Buffers by level; a row of level h stands for 2 ** h vectors."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []
        self.turns: list[int] = []
        self.error = 0

    def add(self, rows: np.ndarray, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
            self.turns.append(0)
        held = self.levels[level]
        held.append(rows)
        if sum(map(len, held)) > SIZE:
            rows = np.sort(np.concatenate(held), axis=0)
            even = len(rows) // 2 * 2
            self.levels[level] = [rows[even:]] if even < len(rows) else []
            self.error += 1 << level
            self.turns[level] ^= 1  # upper and lower rows in turn, so that errors cancel
            self.add(rows[self.turns[level] : even : 2], level + 1)

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each level that holds rows, with them."""
        for h, held in enumerate(self.levels):
            if held:
                yield h, np.concatenate(held)

    def percentiles(self, shares: list[float]) -> tuple[int, np.ndarray]:
        """The number of vectors, and for each share the values at rank (n - 1) * share, between neighbours by line. NaN counts as largest."""
        parts = list(self.rows())
        values = np.concatenate([m for _, m in parts])
        weight = np.repeat([1 << h for h, _ in parts], [len(m) for _, m in parts])
        n, order = int(weight.sum()), np.argsort(values, axis=0, kind="stable")
        values, upto = np.take_along_axis(values, order, axis=0), np.cumsum(weight[order], axis=0)
        at = lambda rank: np.take_along_axis(values, (upto <= rank).sum(axis=0)[None], axis=0)[0]
        out = np.empty((len(shares), values.shape[1]))
        for i, share in enumerate(shares):
            place = (n - 1) * share
            low, high = at(math.floor(place)), at(math.ceil(place))
            with np.errstate(invalid="ignore"):
                between = (math.ceil(place) - place) * low + (place - math.floor(place)) * high
            out[i] = np.where(low == high, low, between) if math.ceil(place) > math.floor(place) else low
        return n, out


def vector_percentiles(df: DataFrame, shares: list[float], by: str = "patient_id", vector: str = "embedding") -> DataFrame:
    """(by, n, error, values): for each group an array of its vectors' percentiles by dimension, one for each share.

    `error` bounds how many ranks a value may be off; it is 0 where n is SIZE or less. Which of the values within the bound
    comes out may change with the order of rows. A group has a row for each length of its vectors. Vectors with null elements
    are left out, and their group has a row with n = 0 and no values; null and empty vectors are left out without one. NaN
    counts as largest. A null group is a group. No rows in, no rows out; other columns are ignored.

    A task sends one row a group and level, not a row a value. Sketches of a group meet in SHARES tasks first, then in one,
    so a hot group brings its last task SHARES sketches.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must lie in [0, 1]")
    rows = df.select(F.col(by).alias("key"), doubles(F.col(vector)).alias("v")).where("size(v) > 0").withColumn("v", F.when(F.exists("v", F.isnull), F.array().cast("array<double>")).otherwise(F.col("v")))
    kind = rows.schema["key"].dataType.simpleString()
    typed = f"key {kind}, width int, share int, level int, error long, data binary"

    key_type = df.sparkSession.createDataFrame([], rows.select("key").schema).toArrow().schema.field(0).type
    schema = pa.schema([("key", key_type), ("width", pa.int32()), ("share", pa.int32()), ("level", pa.int32()), ("error", pa.int64()), ("data", pa.binary())])

    def packed(share, found):
        """Batches of about BYTES / 16 of a row for each sketch and level."""
        waiting, size = [], 0
        for (key, width), sketch in found:
            for i, (level, m) in enumerate(sketch.rows() if width else [(0, np.empty((0, 0)))]):
                waiting.append((key, width, share, level, 0 if i else sketch.error, m.tobytes()))
                size += m.nbytes
            if size > BYTES // 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
                waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)

    def build(batches):
        share, held, size = TaskContext.get().partitionId() % SHARES, {}, 0
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            names, which = keys.dictionary.to_pylist(), keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            names.append(None)
            vectors = batch.column(1)
            start = vectors.offsets.to_numpy()
            flat, width = vectors.values.to_numpy(zero_copy_only=False), np.diff(start)
            order = np.lexsort((width, which))
            edge = np.flatnonzero(np.r_[True, (np.diff(which[order]) != 0) | (np.diff(width[order]) != 0), True]) if len(order) else [0]
            for i, j in zip(edge, edge[1:]):
                mine = order[i:j]
                w = int(width[mine[0]])
                held.setdefault((names[which[mine[0]]], w), Sketch()).add(flat[start[mine][:, None] + np.arange(w)])
            size += flat.nbytes
            if size > BYTES and (size := sum(m.nbytes for s in held.values() for _, m in s.rows())) > BYTES // 2:
                yield from packed(share, held.items())
                held, size = {}, 0
        if held:
            yield from packed(share, held.items())

    def merged(batches):
        """(key, width, sketch) of rows that come in the order of key and width."""
        now, sketch = None, None
        for batch in batches:
            for key, width, level, error, data in zip(*(batch.column(c).to_pylist() for c in ("key", "width", "level", "error", "data"))):
                if now != (key, width):
                    if now:
                        yield (*now, sketch)
                    now, sketch = (key, width), Sketch()
                sketch.error += error
                if width:
                    sketch.add(np.frombuffer(data).reshape(-1, width), level)
        if now:
            yield (*now, sketch)

    def in_shares(batches):
        yield from packed(0, (((key, width), sketch) for key, width, sketch in merged(batches)))

    out = pa.schema([("key", key_type), ("n", pa.int64()), ("error", pa.int64()), ("q", pa.list_(pa.list_(pa.float64())))])

    def finish(batches):
        waiting, size = [], 0
        for key, width, sketch in merged(batches):
            n, q = sketch.percentiles(shares) if width else (0, np.empty((0, 0)))
            waiting.append((key, n, sketch.error, q.tolist()))
            size += q.nbytes
            if size > BYTES // 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), out)], schema=out)
                waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), out)], schema=out)

    first = rows.mapInArrow(build, typed).repartition("key", "width", "share").sortWithinPartitions("key", "width", "share")
    second = first.mapInArrow(in_shares, typed).repartition("key", "width").sortWithinPartitions("key", "width")
    return second.mapInArrow(finish, f"key {kind}, n long, error long, q array<array<double>>").select(F.col("key").alias(by), "n", "error", F.col("q").alias("values"))


def _element(i: int):
    return lambda q: F.get(q, F.lit(i))


def percentiles_by_dimension(df: DataFrame, shares: list[float], by: str = "patient_id", vector: str = "embedding", exact: bool = True) -> DataFrame:
    """(by, values): for each share an array of percentiles by dimension; null elements are left out, as are null and empty vectors.

    Groups come from sketches where those are exact, or with exact=False within their bound. Other groups, of more than SIZE
    vectors, of several lengths or with null elements, take a row per value: exactly, or with exact=False approximately. The
    sketches are made when this is called, one row a group and length in the shared folder; df is read a second time only where there are other groups.
    """
    rows = df.select(F.col(by).alias("_g"), F.col(vector).alias("_v"))
    found = stored(vector_percentiles(rows, shares, "_g", "_v"), "percentiles")
    odd = (F.count("*") > 1) | (F.min("n") == 0) | ((F.max("error") > 0) if exact else F.lit(False))
    groups = found.groupBy("_g").agg(odd.alias("_odd"), F.first("values").alias("values"))
    regular, other = groups.where("not _odd").select("_g", "values"), groups.where("_odd").select(F.col("_g").alias("_o"))
    if other.isEmpty():
        return regular.withColumnRenamed("_g", by)
    one: Column = F.percentile("v", F.array(*map(F.lit, shares))) if exact else F.percentile_approx("v", list(shares))
    again = rows.join(other, F.col("_g").eqNullSafe(F.col("_o")), "left_semi")
    each = again.select("_g", F.posexplode(doubles(F.col("_v"))).alias("d", "v")).groupBy("_g", "d").agg(one.alias("q"))
    gathered = each.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("d", "q"))).alias("_f"))
    long = gathered.select("_g", F.array(*(F.transform(F.col("_f.q"), _element(i)) for i in range(len(shares)))).alias("values"))
    return regular.unionByName(long).withColumnRenamed("_g", by)
