"""Linear heads of many splits and settings, fitted together.

Each pass over the rows sums, for every fit at once, the gradient and the curvature of its loss in the tasks' batches; partial
sums are added by fit in two levels, and only a fit's own sums (of its number of features, squared) reach the driver, which
takes the Newton step. So 100 splits of three heads take as many passes as one, each row is read once a pass, and a row is
not copied for each split. Fits are taken some at a time, so that the sums stay below SUMS numbers.

A fit that has not converged after PASSES passes is an error. Objectives: C sum w loss + (1 - r) / 2 |b|^2 + r |b|_1, with balanced weights w = n / (2 n_class). Logistic heads leave their
intercept out of the penalty; the linear SVC has the squared hinge and penalises it. Rows are scaled by each split's training
rows. A split whose training rows have one class gives NaN scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored

#: Kinds of heads fitted here; most passes; step at which a fit has converged; numbers in one pass's sums; groups of partial sums.
LINEAR, PASSES, ENOUGH, SUMS, SALT = ("logistic_l2", "logistic_l1", "logistic_en", "linear_svc"), 60, 1e-9, 4_000_000, 16


@dataclass
class Fits:
    """Per split and head: coefficients of scaled features and an intercept; per split: shift and width of each feature."""

    heads: list[tuple[str, dict]]
    shift: np.ndarray
    width: np.ndarray
    coef: np.ndarray
    intercept: np.ndarray

    def decision(self, r: int, x: np.ndarray) -> np.ndarray:
        """Linear scores of rows by every head of a split."""
        return ((x - self.shift[r]) / self.width[r]) @ self.coef[r].T + self.intercept[r]

    def score(self, r: int, x: np.ndarray) -> np.ndarray:
        """Probabilities of logistic heads, decision values of linear SVCs."""
        margin = self.decision(r, x)
        for h, (kind, _) in enumerate(self.heads):
            if kind != "linear_svc":
                margin[:, h] = sigmoid(margin[:, h])
        return margin


class Unconverged(RuntimeError):
    """A fit has not reached its optimum within the passes allowed."""


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def by_flag(df: DataFrame, flag: str, label: str = "label") -> DataFrame:
    """Rows of one split: training rows are those of the flag."""
    return df.withColumn("target", F.array(F.when(F.expr(flag), F.col(label)).otherwise(-1).cast("int")))


def by_tests(df: DataFrame, tests: DataFrame, key: str = "patient_id", label: str = "label") -> DataFrame:
    """Rows with a target for each repeat of tests (repeat_id from 0, key, is_test): -1 in the test set, else the label."""
    each = tests.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("repeat_id", "is_test"))).alias("_t"))
    return df.join(each, key).withColumn("target", F.transform("_t", lambda t: F.when(t.is_test, -1).otherwise(F.col(label)).cast("int"))).drop("_t")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _members(batch: pa.RecordBatch):
    """(split, rows, classes) of a batch's training rows; rows with a repeat_id belong to that split alone."""
    x = matrix(batch.column("features"))
    target = matrix(batch.column("target")).astype(np.int64)
    if "repeat_id" in batch.schema.names:
        mine = batch.column("repeat_id").to_numpy()
        for r in np.unique(mine):
            at = np.flatnonzero((mine == r) & (target[:, 0] >= 0))
            yield int(r), x[at], target[at, 0]
    else:
        for r in range(target.shape[1]):
            at = np.flatnonzero(target[:, r] >= 0)
            yield r, x[at], target[at, r]


def added(rows: DataFrame, partial, add) -> dict[int, np.ndarray]:
    """partial(batch) gives (group, numbers); all numbers of a group are brought together by add, first within SALT parts where more tasks have some."""
    schema = pa.schema([("g", pa.int32()), ("salt", pa.int32()), ("sums", pa.binary())])

    def sums(batches):
        from pyspark import TaskContext

        held: dict = {}
        for batch in batches:
            if batch.num_rows:
                for g, numbers in partial(batch):
                    held[g] = add(held[g], numbers) if g in held else numbers
        salt = TaskContext.get().partitionId() % SALT
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([salt] * len(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], schema=schema)

    def merged(table: pa.Table) -> pa.Table:
        total = None
        for raw in table["sums"]:
            numbers = np.frombuffer(raw.as_py(), np.float64)
            total = numbers.copy() if total is None else add(total, numbers)
        return pa.table({"g": [table["g"][0].as_py()], "salt": [table["salt"][0].as_py()], "sums": [total.tobytes()]}, schema=schema)

    ddl = "g int, salt int, sums binary"
    parts = rows.mapInArrow(sums, ddl)
    if rows.rdd.getNumPartitions() > SALT:
        parts = parts.groupBy("g", "salt").applyInArrow(merged, ddl)
    parts = parts.groupBy("g").applyInArrow(merged, ddl)
    return {r.g: np.frombuffer(bytes(r.sums), np.float64) for r in parts.collect()}  # a row a group


def _moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per split: number of training rows, of positive ones, then means, squared deviations, minima and maxima of each feature."""

    def partial(batch):
        for r, x, y in _members(batch):
            if len(x):
                m = x.mean(axis=0)
                yield r, np.r_[len(x), y.sum(), m, ((x - m) ** 2).sum(axis=0), x.min(axis=0), x.max(axis=0)]

    def add(a, b):
        d = (len(a) - 2) // 4
        n = a[0] + b[0]
        gap = b[2 : 2 + d] - a[2 : 2 + d]
        mean = a[2 : 2 + d] + gap * b[0] / n
        spread = a[2 + d : 2 + 2 * d] + b[2 + d : 2 + 2 * d] + gap**2 * a[0] * b[0] / n
        return np.r_[n, a[1] + b[1], mean, spread, np.minimum(a[2 + 2 * d : 2 + 3 * d], b[2 + 2 * d : 2 + 3 * d]), np.maximum(a[2 + 3 * d :], b[2 + 3 * d :])]

    return added(rows, partial, add)


def _loss(kind: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each row, its slope and its curvature in the margin."""
    if kind == "linear_svc":
        sign = 2.0 * y - 1
        gap = np.maximum(0, 1 - sign * margin)
        return gap**2, -2 * sign * gap, 2.0 * (gap > 0)
    p = sigmoid(margin)
    return np.logaddexp(0, margin) - y * margin, p - y, p * (1 - p)


def _step(b: np.ndarray, slope: np.ndarray, curve: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """For every fit, the minimum of its quadratic model with penalties |.|_1 and |.|^2 / 2, by coordinate descent on all fits at once."""
    if not l1.any():
        dims = np.arange(b.shape[1])
        whole = curve.copy()
        whole[:, dims, dims] += l2 + 1e-10
        return b - np.linalg.solve(whole, (slope + l2 * b)[..., None])[..., 0]
    new, rest = b.copy(), slope.copy()  # rest: slope of the smooth model at new
    diagonal = np.diagonal(curve, axis1=1, axis2=2)
    for _ in range(1000):
        moved = 0.0
        for j in range(b.shape[1]):
            at = diagonal[:, j] * new[:, j] - rest[:, j]
            value = np.sign(at) * np.maximum(0, np.abs(at) - l1[:, j]) / np.maximum(diagonal[:, j] + l2[:, j], 1e-300)
            change = value - new[:, j]
            rest += curve[:, j] * change[:, None]
            new[:, j] = value
            moved = max(moved, float(np.abs(change).max()))
        if moved < 1e-12:
            break
    return new


@dataclass
class Scaling:
    """Per split: number of training rows and of positive ones, and the scale of each feature; spread is the variance of all scaled entries."""

    n: np.ndarray
    ones: np.ndarray
    shift: np.ndarray
    width: np.ndarray
    spread: np.ndarray


def scaling(rows: DataFrame, splits: int, scale: str | None) -> Scaling:
    """One pass. scale: standard, minmax or None."""
    found = _moments(rows)
    if not found:
        raise ValueError("no training rows")
    d = (len(next(iter(found.values()))) - 2) // 4
    nothing = np.r_[0.0, 0.0, np.zeros(4 * d)]
    m = np.array([found.get(r, nothing) for r in range(splits)])
    n, ones = m[:, 0], m[:, 1]
    mean, spread, low, high = (m[:, 2 + i * d : 2 + (i + 1) * d] for i in range(4))
    if scale == "standard":
        std = np.sqrt(spread / np.maximum(n, 1)[:, None])
        shift, width = mean, np.where(std > 0, std, 1.0)
    elif scale == "minmax":
        shift, width = low, np.where(high > low, high - low, np.inf)
    else:
        shift, width = np.zeros((splits, d)), np.ones((splits, d))
    middle = (mean - shift) / width
    squares = spread / np.maximum(n, 1)[:, None] / width**2 + middle**2
    return Scaling(n, ones, shift, width, squares.mean(axis=1) - middle.mean(axis=1) ** 2)


def fit(rows: DataFrame, splits: int, heads: list[tuple[str, dict]], scale: str | None = "standard", parent: np.ndarray | None = None, first: int = 0) -> Fits:
    """Fit every head on every split. rows: features (array<double>), target (array<int>, one for each split, -1 outside training);
    with a repeat_id column each row has one target and belongs to that split. scale: standard, minmax or None. A split may
    take the scale of another, its parent; splits before `first` are not fitted. Kinds outside LINEAR are an error, and so is a
    fit that has not converged."""
    for kind, _ in heads:
        if kind not in LINEAR:
            raise ValueError(f"not a linear head: {kind}")
    columns = ["features", "target"] + ["repeat_id"] * ("repeat_id" in rows.columns)
    rows = rows.select(*columns)
    found = scaling(rows, splits, scale)
    n, ones, shift, width = found.n, found.ones, found.shift, found.width
    if parent is not None:
        shift, width = shift[parent], width[parent]
    d = shift.shape[1]
    usable = (ones > 0) & (ones < n) & (np.arange(splits) >= first)
    coef, intercept = np.full((splits, len(heads), d), np.nan), np.full((splits, len(heads)), np.nan)
    fits = [(r, h) for r in range(splits) if usable[r] for h in range(len(heads))]
    at_once = max(1, SUMS // (d + 1) ** 2)
    for i in range(0, len(fits), at_once):
        some = fits[i : i + at_once]
        b = _fit_some(rows, some, heads, shift, width, n, ones, d)
        for (r, h), x in zip(some, b):
            coef[r, h], intercept[r, h] = x[:d], x[d]
    return Fits(heads, shift, width, coef, intercept)


def _fit_some(rows, fits, heads, shift, width, n, ones, d):
    c = np.array([float(heads[h][1].get("c", 1.0)) for _, h in fits])
    ratio = np.array([{"logistic_l1": 1.0, "logistic_en": heads[h][1].get("l1_ratio", 0.5)}.get(heads[h][0], 0.0) for _, h in fits])
    l1, l2 = np.repeat(ratio[:, None], d + 1, axis=1), np.repeat(1 - ratio[:, None], d + 1, axis=1)
    l1[:, d] = 0
    l2[:, d] = [1.0 if heads[h][0] == "linear_svc" else 0.0 for _, h in fits]
    of = {r: [k for k, (s, _) in enumerate(fits) if s == r] for r in {r for r, _ in fits}}
    kinds = [heads[h][0] for _, h in fits]
    b, tried = np.zeros((len(fits), d + 1)), np.zeros((len(fits), d + 1))
    best, size = np.full(len(fits), np.inf), np.ones(len(fits))
    slope, curve, done = np.zeros_like(b), np.zeros((len(fits), d + 1, d + 1)), np.zeros(len(fits), bool)
    for _ in range(PASSES):
        open_ = np.flatnonzero(~done)
        if not len(open_):
            break
        wanted, points = {r: [k for k in ks if not done[k]] for r, ks in of.items()}, tried.copy()

        def partial(batch, wanted=wanted, points=points):
            for r, x, y in _members(batch):
                if not len(x) or not wanted.get(r):
                    continue
                z = np.concatenate([(x - shift[r]) / width[r], np.ones((len(x), 1))], axis=1)
                w = np.where(y == 1, n[r] / (2 * ones[r]), n[r] / (2 * (n[r] - ones[r])))
                for k in wanted[r]:
                    value, first, second = _loss(kinds[k], z @ points[k], y)
                    yield k, c[k] * np.r_[w @ value, z.T @ (w * first), (z.T @ ((w * second)[:, None] * z)).ravel()]

        sums = added(rows, partial, np.add)
        for k in open_:
            s = sums[int(k)]
            objective = s[0] + l1[k] @ np.abs(tried[k]) + 0.5 * l2[k] @ tried[k] ** 2
            if objective <= best[k] + 1e-12 * max(1, abs(best[k])) or size[k] < 1e-6:
                done[k] = abs(best[k] - objective) <= 1e-14 * max(1, abs(objective)) and bool(np.abs(tried[k] - b[k]).max() < 1e-6)
                best[k], b[k], size[k] = objective, tried[k], 1.0
                slope[k], curve[k] = s[1 : d + 2], s[d + 2 :].reshape(d + 1, d + 1)
            else:  # too far: a shorter step from the last point
                size[k] /= 2
        open_ = np.flatnonzero(~done)
        if not len(open_):
            break
        aim = _step(b[open_], slope[open_], curve[open_], l1[open_], l2[open_])
        tried[open_] = b[open_] + size[open_, None] * (aim - b[open_])
        done[open_] = np.abs(tried[open_] - b[open_]).max(axis=1) < ENOUGH
    if not done.all():
        raise Unconverged(f"{int((~done).sum())} of {len(done)} fits after {PASSES} passes")
    return b


def scores(rows: DataFrame, fits, keep: list[str]) -> DataFrame:
    """(repeat_id, config, keep..., is_test, score) of every row for every fit, or of its own split's if it has a repeat_id.

    fits has heads, and score(split, matrix) with a column for each of them: the score of a linear SVC is the decision value,
    of other heads a probability.
    """
    own = "repeat_id" in rows.columns
    names = [c for c in keep if c != "repeat_id"]
    types = [(c, rows.schema[c].dataType.simpleString()) for c in names]
    rows = rows.select(*names, "features", "target", *["repeat_id"] * own)

    def score(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, target = matrix(part.column("features")), matrix(part.column("target")).astype(np.int64)
                mine = part.column("repeat_id").to_numpy() if own else None
                for r in np.unique(mine) if own else range(target.shape[1]):
                    i = np.flatnonzero(mine == r) if own else np.arange(len(x))
                    test = target[i, 0 if own else r] < 0
                    value = fits.score(int(r), x[i])
                    for h in range(len(fits.heads)):
                        columns = [pa.array(np.full(len(i), r), pa.int32()), pa.array(np.full(len(i), h), pa.int32())] + [part.column(c).take(pa.array(i)) for c in names] + [pa.array(test), pa.array(value[:, h])]
                        yield pa.RecordBatch.from_arrays(columns, names=["repeat_id", "config", *names, "is_test", "score"])

    ddl = ", ".join(["repeat_id int", "config int", *(f"{c} {t}" for c, t in types), "is_test boolean", "score double"])
    return rows.mapInArrow(score, ddl)


def kept(rows: DataFrame) -> DataFrame:
    """Rows written once, because every pass reads them."""
    return stored(rows, "fit-rows")
