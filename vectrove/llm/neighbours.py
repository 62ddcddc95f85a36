"""Embedding near-dedup by an exact metric range join.

Unit vectors have a cosine of c or more if their distance is sqrt(2 - 2c) or less. Each vector belongs to the cell of its
nearest pivot, and is stored once, there. A block of a cell's own vectors meets the vectors of other cells that the
triangle inequality cannot keep out of their reach: its task reads those cells' files from the shared folder, batch by batch,
and two cells meet in the tasks of one of them. So nothing is copied, and disk grows with the vectors even where few cells can
be ruled out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .components import components, roots
from .storage import file_system, shared_path, stored

#: Distinct vectors of a cell, on average; most pivots; vectors of a block.
CELL, PIVOTS, SIDE = 4096, 256, 4096
#: Vectors read at once; left vectors of a block compared at once; rows found that a task gathers before it merges them.
READ, STEP, GATHER = 16384, 256, 1_000_000
#: Slack of distances, and of cosines in single precision, so that rounding loses no pair.
NEAR, ROUGH = 1e-6, 1e-4


def unit(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_of(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each unit vector, and the mask of cells within reach."""
    square = np.maximum(0, 2 - 2 * (x @ pivots.T))
    own = square.argmin(axis=1)
    nearest = square[np.arange(len(x)), own][:, None]
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))[own]
    by_radius = np.sqrt(square) - np.sqrt(nearest) <= 2 * reach + NEAR
    by_plane = square - nearest <= 2 * apart * reach + NEAR
    near = by_radius & by_plane
    near[np.arange(len(x)), own] = True
    return own, near


def in_reach(y: np.ndarray, two: np.ndarray, reach: float) -> np.ndarray:
    """Which vectors of the first pivot's cell are within reach of the second's, by the same bounds."""
    square = np.maximum(0, 2 - 2 * (y @ two.T))
    apart = np.sqrt(max(0.0, 2 - 2 * float(two[0] @ two[1])))
    by_radius = np.sqrt(square[:, 1]) - np.sqrt(square[:, 0]) <= 2 * reach + NEAR
    return by_radius & (square[:, 1] - square[:, 0] <= 2 * apart * reach + NEAR)


def read_cell(path: str, cell: int, columns: list[str]):
    """Batches of at most READ rows of a cell's files, in the same order each time."""
    system, folder = file_system(f"{path}/cell={cell}")
    for file in sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")):
        with system.open_input_file(file) as source:
            yield from pq.ParquetFile(source).iter_batches(READ, columns=columns)


class Met:
    """Links of the own vectors of a block: sums of `many` for both ends, and spanning edges."""

    def __init__(self, node: np.ndarray, many: np.ndarray, x: np.ndarray, cosine: float):
        self.node, self.many, self.x, self.x4, self.cosine = node, many, x, x.astype(np.float32), cosine
        self.slack = max(ROUGH, 2 * x.shape[1] * 2.0**-23)
        self.got, self.sums, self.parts, self.held = np.zeros(len(node), np.int64), [], [], 0

    def meet(self, node: np.ndarray, many: np.ndarray, y: np.ndarray, own: bool) -> None:
        """Link with vectors of another cell, or with those of the own cell that have a larger number."""
        y4 = y.astype(np.float32)
        got = np.zeros(len(node), np.int64)
        for at in range(0, len(self.node), STEP):
            rough = (self.x4[at : at + STEP] @ y4.T).ravel()
            found = np.flatnonzero(rough >= self.cosine - self.slack)
            row, col = at + found // len(node), found % len(node)
            near = rough[found] >= self.cosine + self.slack
            open_ = np.flatnonzero(~near)  # only these need double precision
            for i in range(0, len(open_), 1 << 16):
                k = open_[i : i + (1 << 16)]
                near[k] = np.einsum("ij,ij->i", self.x[row[k]], y[col[k]]) >= self.cosine
            if own:
                near &= self.node[row] < node[col]
            row, col = row[near], col[near]
            if len(row):
                np.add.at(self.got, row, many[col])
                np.add.at(got, col, self.many[row])
                self._edges(self.node[row], node[col])
        linked = np.flatnonzero(got)
        self._links(node[linked], got[linked])

    def _links(self, node: np.ndarray, got: np.ndarray) -> None:
        """Links of vectors met, added up when many are gathered."""
        self.sums.append((node, got))
        if sum(len(x) for x, _ in self.sums) > GATHER + 2 * len(self.sums[0][0]):
            self.sums = [_added(self.sums)]

    def _edges(self, u: np.ndarray, v: np.ndarray) -> None:
        self.parts.append(_spanning(u, v))
        self.held += len(self.parts[-1][0])
        if self.held > GATHER:
            self.parts = [_spanning(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.held = len(self.parts[0][0]) // 2  # so that what does not shrink is not merged each time

    def result(self) -> pa.RecordBatch:
        """(node, links, low) of the vectors with links here; low is the least node that this block's links reach."""
        u, v = _spanning(*(np.concatenate(x) for x in zip(*self.parts))) if self.parts else (np.empty(0, np.int64),) * 2
        node, links = _added([*self.sums, (self.node, self.got)])
        node, links = node[links > 0], links[links > 0]
        low = node.copy()
        low[np.searchsorted(node, u)] = v
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(low)], names=["node", "links", "low"])


def _added(sums: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes, sorted, and the sums of their numbers."""
    names, at = np.unique(np.concatenate([x for x, _ in sums]), return_inverse=True)
    out = np.zeros(len(names), np.int64)
    np.add.at(out, at, np.concatenate([n for _, n in sums]))
    return names, out


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that is not the least of its component, and that least one."""
    names, at = np.unique(np.r_[u, v], return_inverse=True)
    root = roots(len(names), at[: len(u)], at[len(u) :])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def metric_join(path: str, cells: DataFrame, pivots: dict, kind: type, cosine: float, side: int) -> tuple[DataFrame, DataFrame]:
    """For distinct valid vectors in the files of their cells (cell int, node long, many long, vector binary): links as
    (node, links), where links is the sum of `many` over the other linked vectors, and spanning edges (u, v) of the links."""
    reach, spark = float(np.sqrt(max(0.0, 2 - 2 * cosine))), cells.sparkSession
    base = _bases(pivots)

    def reaches(batches):
        """How many of a cell's vectors are within reach of a cell."""
        for batch in batches:
            cell, raw = batch.column("cell").to_numpy(), np.array(batch.column("vector").to_pylist(), object)
            for s, points in pivots.items():
                mine = np.flatnonzero((cell >= base[s]) & (cell < base[s] + len(points)))
                sums = np.zeros((len(points), len(points)), np.int64)
                for at in range(0, len(mine), 1024):
                    some = mine[at : at + 1024]
                    _, near = cells_of(unit(raw[some].tolist(), kind), points, reach)
                    row, col = np.nonzero(near)
                    np.add.at(sums, (cell[some][row] - base[s], col), 1)
                own, other = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(own + base[s], pa.int32()), pa.array(other + base[s], pa.int32()), pa.array(sums[own, other])], names=["mine", "cell", "n"])

    sources, owners = {}, {}
    for r in cells.select("cell", "vector").mapInArrow(reaches, "mine int, cell int, n long").groupBy("mine", "cell").agg(F.sum("n").alias("n")).collect():  # a row for two pivots
        sources.setdefault(r.cell, []).append(r.mine)
        if r.mine == r.cell:
            owners[r.cell] = -(-r.n // side)
    blocks = [(c, i) for c in sorted(owners) for i in range(owners[c])]
    place = {base[s] + k: (s, k) for s in pivots for k in range(len(pivots[s]))}

    def join(batches):
        """Links of each block's own vectors with all vectors in their reach."""
        for batch in batches:
            for c, i in (blocks[k] for k in batch.column(0).to_pylist()):
                begun, parts = 0, []
                for own in read_cell(path, c, ["node", "many", "vector"]):
                    low, high = (min(max(k * side - begun, 0), own.num_rows) for k in (i, i + 1))
                    cut = own.slice(low, high - low)
                    begun += own.num_rows
                    if cut.num_rows:
                        parts.append(cut)
                mine = pa.Table.from_batches(parts)
                met = Met(mine["node"].to_numpy(), mine["many"].to_numpy(), unit(mine["vector"].to_pylist(), kind), cosine)
                size, at = place[c]
                for d in sorted(sources[c]):
                    if d != c and (c < d) != bool((c + d) % 2):
                        continue  # two cells meet once, in the task of one
                    two = pivots[size][[place[d][1], at]]
                    for other in read_cell(path, d, ["node", "many", "vector"]):
                        y = unit(other.column("vector").to_pylist(), kind)
                        near = np.ones(len(y), bool) if c == d else in_reach(y, two, reach)
                        if near.any():
                            met.meet(other.column("node").to_numpy()[near], other.column("many").to_numpy()[near], y[near], own=c == d)
                yield met.result()

    found = stored(spark.range(0, len(blocks), 1, max(1, len(blocks))).mapInArrow(join, "node long, links long, low long"), "links")
    return found.groupBy("node").agg(F.sum("links").alias("links")), found.where("node <> low").select("node", "low").distinct()


def _bases(pivots: dict) -> dict:
    """The number of the first cell of each length of vectors."""
    return dict(zip(sorted(pivots), np.cumsum([0, *(len(pivots[s]) for s in sorted(pivots))]).tolist()))


def embedding_dedup(rows: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = CELL, side: int = SIDE) -> DataFrame:
    """Link vectors with a cosine of `cosine` or more, in double precision; a row per vector.

    Returns the id, n_links (other rows linked directly, equal vectors included), component_id (least id that links reach,
    its own included) and kept (whether it is that one). Vectors that are null, empty, zero, or hold null or non-finite
    components, and rows with a null id, link with nothing and are kept; vectors of different lengths do not link. Equal
    vectors are compared once, for all their rows, also of one id; other columns are ignored; no rows in, no rows out.
    """
    spark = rows.sparkSession
    kind = np.float32 if isinstance(rows.schema[vector_col].dataType.elementType, FloatType) else np.float64
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = "id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    base = base.withColumn("good", F.expr(f"coalesce({good}, false)"))
    valid = base.where("good").select("id", F.expr("transform(v, x -> x + 0D)").alias("v"))

    pivots, code = {}, F.xxhash64("v").alias("code")
    for size, n in sorted((r["size"], r["count"]) for r in valid.groupBy(F.size("v").alias("size")).count().collect()):
        some = valid.where(F.size("v") == size).select(code, "v")
        least = [r.code for r in some.select("code").distinct().orderBy("code").limit(min(PIVOTS, max(1, -(-n // cell)))).collect()]
        pivots[size] = unit([np.array(r.v).tobytes() for r in some.where(F.col("code").isin(least)).dropDuplicates(["code"]).orderBy("code").collect()], np.float64)
    numbers = _bases(pivots)

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([np.asarray(v, kind).tobytes() for v in batch.column("v").to_pylist()], pa.binary())], names=["id", "vector"])

    def assign(batches):
        """The cell of each vector."""
        width = np.dtype(kind).itemsize
        for batch in batches:
            raw = np.array([*batch.column("vector").to_pylist(), None], object)[:-1]
            sizes = np.array([len(x) // width for x in raw])
            cells = np.zeros(len(raw), np.int32)
            for s in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == s)
                for at in range(0, len(mine), 1024):
                    x = unit(raw[mine[at : at + 1024]].tolist(), kind)
                    cells[mine[at : at + 1024]] = numbers[s] + (x @ pivots[s].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    packed = valid.mapInArrow(pack, "id long, vector binary")
    digest = F.unhex(F.sha2("vector", 256)).alias("digest")
    groups = packed.groupBy("vector").agg(F.min("id").alias("low"), F.count("*").alias("many")).select("low", "many", "vector")
    # numbers that no two vectors share; stored, so that they stay
    placed = groups.mapInArrow(assign, "low long, many long, vector binary, cell int").select("cell", F.monotonically_increasing_id().alias("node"), "low", "many", digest, "vector")
    path = shared_path(spark, "cells")
    placed.repartitionByRange("cell", "node").write.partitionBy("cell").parquet(path)
    cells = spark.read.schema(placed.schema).parquet(path)
    links, edges = metric_join(path, cells, pivots, kind, cosine, side)
    whole = components(edges)
    # from here on a vector goes by its SHA-256
    each = cells.select("node", "low", "many", "digest").join(links, "node", "left").join(whole, "node", "left").select("digest", "low", F.expr("coalesce(links, 0) + many - 1").alias("n_links"), F.coalesce("component", "node").alias("group_key"))
    each = each.join(each.groupBy("group_key").agg(F.min("low").alias("component_id")), "group_key").select("digest", "n_links", "component_id")
    alone = base.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))  # not through the join
    out = packed.select("id", digest).join(each, "digest").select("id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.expr("id <=> component_id")).withColumnRenamed("id", id_col)
