"""Embedding whitening with covariances recovered from variances of sums.

Entries become whole numbers. A first pass gives the number of vectors and each dimension's sum, exactly. A second adds up,
exactly, the squares of every dimension's centred value and of every pair's centred sum; by polarisation,
2 cov(a, b) = var(a + b) - var(a) - var(b), so differences of these variances are all the cross-covariances. Values are
centred on the whole part of their mean, and the rest of the mean enters the variance exactly, in whole numbers of any size.
What comes to the driver is two numbers a pair of dimensions, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .storage import stored

#: Rows squared at once; largest entry, in size, of a vector that takes part; sums that stay below it are added as 64-bit numbers.
STEP, LARGEST, SMALL = 512, 2**53, 2**62
#: Eigenvalues below this share of the largest, times the number of dimensions, count as zero.
ZERO = 1e-14


def _vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """(id, x) of the rows that take part, x as array<long>."""
    taken = f"coalesce(size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs({scale}D * c) < {LARGEST}D), false)"
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(taken)
    return found.select("id", F.expr(f"transform(v, c -> floor({scale}D * c) + {shift}L)").alias("x"))


def _by_size(batch: pa.RecordBatch):
    """(size, rows, matrix of whole numbers) of a batch's vectors of each length."""
    x = batch.column("x")
    size = np.diff(x.offsets.to_numpy())
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        yield int(s), at, x.take(pa.array(at)).flatten().to_numpy().reshape(-1, int(s))


def _added(rows: DataFrame, partial, names: list[str]) -> list:
    """Sums, as Python numbers, of the (names..., number) that partial gives for a batch; a row a task and key is shuffled."""

    def sums(batches):
        held: dict = {}
        for batch in batches:
            for key, number in partial(batch):
                held[key] = held.get(key, 0) + number
        if held:
            keys = list(zip(*held))
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array(list(map(int, held.values())), pa.decimal128(38, 0))], names=[*names, "s"])

    ddl = ", ".join(f"{n} int" for n in names)
    total = rows.mapInArrow(sums, f"{ddl}, s decimal(38,0)").groupBy(*names).agg(F.sum("s").cast(DecimalType(38, 0)).alias("s"))
    return [(*(r[n] for n in names), int(r.s)) for r in total.collect()]


def _squares(y: np.ndarray, most: int):
    """Sum over the rows of each column's square, exactly."""
    if most * most * len(y) < SMALL:
        return np.einsum("ij,ij->j", y, y)
    return (y.astype(object) ** 2).sum(axis=0)


class Fit:
    """What a fit of vectors of one length has: number, exact sums, and the leading components with their eigenvalues."""

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int], most: int):
        d = len(sums)
        self.n, self.sums = n, sums
        self.whole, self.rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
        centred = lambda i, j: n * squares[i, j] - (self.rest[i] + (self.rest[j] if i != j else 0)) ** 2  # noqa: E731  n^2 times the variance
        alone = [centred(i, i) for i in range(d)]
        v = np.empty((d, d))
        for i in range(d):
            v[i, i] = alone[i] / n**2
            for j in range(i + 1, d):
                v[i, j] = v[j, i] = (centred(i, j) - alone[i] - alone[j]) / (2 * n**2)  # whole numbers; rounded once
        value, vector = np.linalg.eigh(v)
        k = min(most, d)
        self.value, self.vector = value[::-1][:k], vector[:, ::-1][:, :k]
        self.trace = float(sum(alone) / n**2)
        self.open = self.value > ZERO * d * max(float(value[-1]), 0.0)
        self.width = np.where(self.open, np.sqrt(np.maximum(self.value, 0)), np.nan)
        self.shift = np.array([r / n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN in components without variance."""
        return ((x - self.whole) - self.shift) @ self.vector / self.width

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of the squares of n x - S, exactly."""
        y, n = x - self.whole, self.n
        big = int(np.abs(y).max(initial=0))
        if max(big * big, big * n) * y.shape[1] < SMALL:
            square, cross = (y * y).sum(axis=1), y @ np.array(self.rest, np.int64)
        else:
            square, cross = (y.astype(object) ** 2).sum(axis=1), y.astype(object) @ np.array(self.rest, object)
        rest = sum(r * r for r in self.rest)
        return [n * n * a - 2 * n * b + rest for a, b in zip(square.tolist(), cross.tolist())]


def fit(x: DataFrame, components: int) -> dict[int, Fit]:
    """A fit for each length of vectors; x has a column x."""

    def first(batch):
        for s, _, m in _by_size(batch):
            yield (s, -1), len(m)
            big = int(np.abs(m).max())
            yield from (((s, i), v) for i, v in enumerate((m if big * len(m) < SMALL else m.astype(object)).sum(axis=0).tolist()))

    found: dict[int, dict[int, int]] = {}
    for s, i, v in _added(x, first, ["size", "i"]):
        found.setdefault(s, {})[i] = v
    mean = {s: np.array([v[i] // v[-1] for i in range(s)], np.int64) for s, v in found.items()}

    def second(batch):
        for s, _, m in _by_size(batch):
            for at in range(0, len(m), STEP):
                y = m[at : at + STEP] - mean[s]
                most = int(np.abs(y).max())
                yield from (((s, i, i), v) for i, v in enumerate(_squares(y, most).tolist()))
                for i in range(s - 1):
                    both = _squares(y[:, i : i + 1] + y[:, i + 1 :], 2 * most).tolist()
                    yield from (((s, i, i + 1 + j), v) for j, v in enumerate(both))

    squares: dict[int, dict] = {}
    for s, i, j, v in _added(x, second, ["size", "i", "j"]):
        squares.setdefault(s, {})[i, j] = v
    return {s: Fit(v[-1], [v[i] for i in range(s)], squares[s], components) for s, v in found.items()}


def _identity_errors(white: DataFrame, sizes: dict[int, np.ndarray]) -> dict[int, float]:
    """Per length of vectors, the largest entry, in size, of the covariance of the whitened rows less the identity."""
    schema = pa.schema([("size", pa.int32()), ("sums", pa.binary())])

    def joined(a, b):
        """Of two lots (n, means, sums of centred products) the same of both."""
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * b[0] / n, a[2] + b[2] + np.outer(gap, gap) * a[0] * b[0] / n

    def told(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.concatenate([[n], m, c.ravel()]).tobytes() for n, m, c in held.values()], pa.binary())], schema=schema)

    def read(raw):
        x = np.frombuffer(raw, np.float64)
        k = round(((4 * len(x) - 3) ** 0.5 - 1) / 2)  # 1 + k + k * k numbers
        return x[0], x[1 : k + 1], x[k + 1 :].reshape(k, k)

    def partial(batches):
        held = {}
        for batch in batches:
            size = batch.column("size").to_numpy()
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                w = batch.column("w").take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)[:, sizes[s]]
                m = w.mean(axis=0)
                lot = float(len(w)), m, (w - m).T @ (w - m)
                held[s] = joined(held[s], lot) if s in held else lot
        if held:
            yield told(held)

    def merged(table):
        lots = [read(x) for x in table["sums"].to_pylist()]
        total = lots[0]
        for lot in lots[1:]:
            total = joined(total, lot)
        return pa.Table.from_batches([told({table["size"][0].as_py(): total})])

    ddl = "size int, sums binary"
    out = {}
    for r in white.mapInArrow(partial, ddl).groupBy("size").applyInArrow(merged, ddl).collect():  # a few numbers a task
        n, _, c = read(bytes(r.sums))
        out[r.size] = float(np.abs(c / n - np.eye(len(c))).max(initial=0.0))
    return out


def whiten(rows: DataFrame, components: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates on the leading principal components, a row for each vector and component.

    Entries c become x = floor(scale * c) + shift. The fit is on all vectors: n of them, S their sum; covariances have the
    divisor n. Returns the id, component (from 1, by falling eigenvalue), n, deviation (sum over dimensions of the square of
    n x - S, exact, decimal(38,0)), whitened ((x - S/n) on the component, over the root of its eigenvalue), explained (the
    eigenvalue's share of the trace) and identity_error (largest entry, in size, of the covariance of `whitened`, taken from
    the rows themselves, less the identity; one value).

    Left out are vectors that are null or empty, or hold null or non-finite entries or ones of 2**53 / scale or more in size.
    Vectors of another length are another fit. Components without variance (all vectors equal, fewer vectors than
    components) have null for `whitened` and do not count in identity_error; with no variance at all `explained` is null.
    Null and repeated ids give their rows like others; other columns are ignored; no rows in, no rows out. `rows` is read
    three times and has to give the same rows each time.
    """
    scale = float(scale)
    x = _vectors(rows, id_col, vector_col, scale, shift)
    fits = fit(x.select("x"), components)
    schema = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("deviation", pa.decimal128(38, 0)), ("w", pa.list_(pa.float64()))])

    def project(batches):
        for batch in batches:
            for s, at, m in _by_size(batch):
                w = fits[s].whitened(m)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(np.full(len(m), s), pa.int32()), pa.array(fits[s].deviation(m), pa.decimal128(38, 0)), lists], schema=schema)

    white = stored(x.mapInArrow(project, "id long, size int, deviation decimal(38,0), w array<double>"), "whitened")
    errors = _identity_errors(white, {s: np.flatnonzero(f.open) for s, f in fits.items()})
    facts = [(s, int(f.n), [float(e / f.trace) if f.trace > 0 else None for e in f.value], errors.get(s, 0.0)) for s, f in fits.items()]
    known = rows.sparkSession.createDataFrame(facts, "size int, n long, share array<double>, identity_error double")
    each = white.join(F.broadcast(known), "size").select("id", "n", "deviation", "share", "identity_error", F.posexplode("w").alias("k", "whitened"))  # a row for each length of vectors
    return each.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), "n", "deviation", F.expr("if(isnan(whitened), null, whitened)").alias("whitened"), F.expr("share[k]").alias("explained"), "identity_error")
