"""Gaussian-kernel SVCs and calibrated linear SVCs of many splits and settings, fitted together.

The kernel machine is solved in the primal. Landmarks, at most LANDMARKS distinct rows by a hash, span the functions: with as
many rows or fewer all are landmarks and the solution is the exact one, beyond that it is the best in their span (Nystroem).
Each pass over the rows sums gradient and curvature of all open fits, as for linear heads, and the driver takes the steps.

Probabilities are sigmoids of decision values. The folds that these come from are targets of the same passes: beside each
split stand its training rows without each fold, and the sigmoids of all splits are one more grouped fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouped
from .grouped import SUMS, Unconverged, added, matrix, sigmoid

#: Most landmarks; most passes; gap between primal and dual value at which a fit has converged: values are within the root of twice it.
LANDMARKS, PASSES, GAP = 512, 400, 1e-7
#: Widths of the hinge in each round, the first LOOSE of which need not be exact; folds of the sigmoids of either kind, and the least common multiple of all parts of training rows.
WIDTHS = (2.0, 0.5, 0.2, 0.05) + (0.01,) * 56
LOOSE = 3
FOLDS, FOLD = {"rbf_svc": 5, "calibrated_svc": 3}, 30


def multipliers(t: np.ndarray, c: np.ndarray, widths: list[float]) -> np.ndarray:
    """The rows' dual values after a sequence of rounds; t has a column of signed margins for each of them."""
    value = np.zeros(len(c))
    for k, width in enumerate(widths):
        value = np.clip(value + (1 - t[:, k]) * c / width, 0, c)
    return value


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return np.exp(-gamma * np.maximum(square, 0))


def with_folds(rows: DataFrame, splits: int, k: int) -> tuple[DataFrame, np.ndarray]:
    """The rows with k further targets a split, its training rows without fold % k = 0, 1, ..., and each split's parent."""
    if "fold" not in rows.columns or "repeat_id" in rows.columns:
        raise ValueError("rows need a fold, and targets of all splits")
    inner = F.flatten(F.transform("target", lambda t: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(F.col("fold") % k == j, -1).otherwise(t))))
    return rows.withColumn("target", F.concat("target", inner)), np.r_[np.arange(splits), np.repeat(np.arange(splits), k)]


@dataclass
class Kernels:
    """Decision functions of each (split, head): weights of the landmarks' kernel values, and an intercept."""

    heads: list[tuple[str, dict]]
    shift: np.ndarray
    width: np.ndarray
    gamma: np.ndarray
    landmarks: np.ndarray
    weight: np.ndarray
    intercept: np.ndarray

    def decision(self, r: int, x: np.ndarray) -> np.ndarray:
        z, l = (x - self.shift[r]) / self.width[r], (self.landmarks - self.shift[r]) / self.width[r]  # noqa: E741
        return np.stack([gaussian(z, l, self.gamma[r, h]) @ self.weight[r, h] + self.intercept[r, h] for h in range(len(self.heads))], axis=1)


def _gamma(value, spread: float, d: int) -> float:
    if value == "scale":
        return 1.0 / (d * spread) if spread > 0 else 1.0
    return 1.0 / d if value == "auto" else float(value)


def fit_kernels(rows: DataFrame, splits: int, heads: list[tuple[str, dict]], scale: str | None = "standard", parent: np.ndarray | None = None) -> Kernels:
    """SVCs with balanced weights, C sum w hinge + |f|^2 / 2 and a free intercept. Parameters: c, gamma (scale, auto or a number)."""
    rows = rows.select("features", "target")
    found = grouped.scaling(rows, splits, scale)
    up = np.arange(splits) if parent is None else parent
    shift, width, d = found.shift[up], found.width[up], found.shift.shape[1]
    gamma = np.array([[_gamma(p.get("gamma", "scale"), found.spread[u], d) for _, p in heads] for u in up])
    picked = rows.select("features").distinct().orderBy(F.xxhash64("features"), F.col("features").cast("string")).limit(LANDMARKS).collect()  # a bounded number
    landmarks = np.array([r.features for r in picked], float)
    m = len(landmarks)
    weight, intercept = np.full((splits, len(heads), m), np.nan), np.full((splits, len(heads)), np.nan)
    fits = [(r, h) for r in range(splits) if 0 < found.ones[r] < found.n[r] for h in range(len(heads))]
    at_once = max(1, SUMS // (m + 1) ** 2)
    for i in range(0, len(fits), at_once):
        some, bases = fits[i : i + at_once], []
        for r, h in some:
            l = (landmarks - shift[r]) / width[r]  # noqa: E741
            value, vector = np.linalg.eigh(gaussian(l, l, gamma[r, h]))
            kept = value > 1e-12 * value[-1]
            bases.append((l, vector[:, kept] / np.sqrt(value[kept])))
        b = _fit_some(rows, some, heads, shift, width, gamma, found.n, found.ones, bases)
        for (r, h), (_, basis), x in zip(some, bases, b):
            weight[r, h], intercept[r, h] = basis @ x[:-1], x[-1]
    return Kernels(heads, shift, width, gamma, landmarks, weight, intercept)


def _fit_some(rows, fits, heads, shift, width, gamma, n, ones, bases) -> list[np.ndarray]:
    """Proximal point steps on the dual: in each round the hinge is a parabola within a width of where the rows' dual values put
    it, Newton steps minimise that, and the dual values follow. Rows keep nothing: theirs follow from the points of the rounds.
    After a round the point and the dual values are feasible, and their gap bounds how far the decision values may be off. The
    intercept, which the rows may leave free, is the middle of its range."""
    c = [float(heads[h][1].get("c", 1.0)) for _, h in fits]
    of: dict[int, list[int]] = {}
    for k, (r, _) in enumerate(fits):
        of.setdefault(r, []).append(k)
    b = [np.zeros(basis.shape[1] + 1) for _, basis in bases]
    tried, aim = [x.copy() for x in b], [x.copy() for x in b]
    rounds: list[list[np.ndarray]] = [[] for _ in fits]
    best, size, done = np.full(len(fits), np.inf), np.ones(len(fits)), np.zeros(len(fits), bool)

    def duals(batch, wanted, past):
        """Of each wanted fit: its number, and the rows' largest dual values, signs, signed features, dual values and rate of the round."""
        for r, x, y in grouped._members(batch):
            if not len(x) or not wanted.get(r):
                continue
            z = (x - shift[r]) / width[r]
            w, sign = np.where(y == 1, n[r] / (2 * ones[r]), n[r] / (2 * (n[r] - ones[r]))), 2.0 * y - 1
            for k in wanted[r]:
                most = c[k] * w
                phi = sign[:, None] * np.column_stack([gaussian(z, bases[k][0], gamma[r, fits[k][1]]) @ bases[k][1], np.ones(len(z))])
                old = multipliers(phi @ np.array(past[k]).T if past[k] else np.empty((len(x), 0)), most, WIDTHS[: len(past[k])])
                yield k, most, sign, phi, old, WIDTHS[len(past[k])] / most

    for _ in range(PASSES):
        if done.all():
            break
        wanted, points, past = {r: [k for k in ks if not done[k]] for r, ks in of.items()}, list(tried), [list(x) for x in rounds]

        def partial(batch, wanted=wanted, points=points, past=past):
            for k, most, sign, phi, old, give in duals(batch, wanted, past):
                t = phi @ points[k]
                new = old + (1 - t) / give
                inside = (new > 0) & (new < most)
                new = np.clip(new, 0, most)
                value = new * (1 - t) - give / 2 * (new - old) ** 2
                yield k, np.r_[value.sum(), most @ np.maximum(0, 1 - t) - new.sum(), -(new @ phi), (phi.T @ ((inside / give)[:, None] * phi)).ravel()]

        sums = added(rows, partial, np.add)
        for k in np.flatnonzero(~done):
            s, d = sums[int(k)], len(b[k])
            objective = s[0] + 0.5 * tried[k][:-1] @ tried[k][:-1]
            if objective > best[k] + 1e-12 * max(1, abs(best[k])) and size[k] > 1e-9:  # too far: a shorter step
                size[k] /= 4
            else:
                b[k], best[k], size[k] = tried[k], objective, 1.0
                slope, curve = s[2 : d + 2].copy(), s[d + 2 :].reshape(d, d).copy()
                slope[:-1] += b[k][:-1]
                curve[np.arange(d - 1), np.arange(d - 1)] += 1
                curve[-1, -1] += 1e-3 * c[k]  # the intercept has no curvature where no row lies near the hinge
                step = np.linalg.solve(curve, slope)
                aim[k] = b[k] - step
                if slope @ step <= (1e-16 if len(rounds[k]) >= LOOSE else 1e-7) * max(1.0, abs(objective)):
                    dual = s[2 : d + 2]  # less the sum of the dual values' features
                    gap = s[1] + 0.5 * (b[k][:-1] @ b[k][:-1] + dual[:-1] @ dual[:-1]) + abs(dual[-1] * b[k][-1])
                    done[k] = abs(gap) <= GAP
                    if not done[k] and len(rounds[k]) + 1 < len(WIDTHS):
                        rounds[k].append(b[k])  # the next round begins at the same point
                        best[k], aim[k] = np.inf, b[k]
            tried[k] = b[k] + size[k] * (aim[k] - b[k])
    if not done.all():
        raise Unconverged(f"{int((~done).sum())} of {len(done)} fits after {PASSES} passes")

    def intercepts(batch):
        """The intercepts that rows allow: none lower than the first number, none higher than less the second."""
        for k, most, sign, phi, old, give in duals(batch, of, rounds):
            new = np.clip(old + (1 - phi @ b[k]) / give, 0, most)
            own = sign - sign * (phi[:, :-1] @ b[k][:-1])  # the intercept that brings the row to the hinge
            raised, lowered = new < most * (1 - 1e-9), new > most * 1e-9
            low, high = np.where(sign > 0, raised, lowered), np.where(sign > 0, lowered, raised)
            yield k, np.array([own[low].max(initial=-np.inf), -own[high].min(initial=np.inf)])

    for k, (low, high) in added(rows, intercepts, np.maximum).items():
        b[k][-1] = (low - high) / 2
    return b


@dataclass
class Calibrated:
    """Probabilities of each split: means over `parts` (a decision function's split, slope, offset) of sigmoids."""

    heads: list[tuple[str, dict]]
    inner: object
    parts: dict[tuple[int, int], list[tuple[int, float, float]]]

    def score(self, r: int, x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), len(self.heads)), np.nan)
        values = {s: self.inner.decision(s, x) for s in {s for h in range(len(self.heads)) for s, _, _ in self.parts.get((r, h), [])}}
        for h in range(len(self.heads)):
            if mine := self.parts.get((r, h)):
                out[:, h] = np.mean([sigmoid(a * values[s][:, h] + b) for s, a, b in mine], axis=0)
        return out


def sigmoids(rows: DataFrame, groups: dict[int, list[tuple[int, int, int]]], inner, heads: int) -> dict[tuple[int, int], tuple[float, float]]:
    """Slope and offset of a sigmoid for each (group, head), at most likelihood, over held-out decision values.

    groups: per group the (split, fold, folds) whose decision function rates the split's rows of that fold; splits are those
    of inner, targets those of the group's own training rows, of which there is one at the group's place in `target`. Targets
    of the sigmoid are Platt's, (n1 + 1) / (n1 + 2) and 1 / (n0 + 2).
    """

    def values(batch):
        x, fold, target = matrix(batch.column("features")), batch.column("fold").to_numpy(), matrix(batch.column("target")).astype(np.int64)
        for g, parts in groups.items():
            for split, k, folds in parts:
                at = np.flatnonzero((fold % folds == k) & (target[:, g[0]] >= 0))
                if len(at):
                    v = inner.decision(split, x[at])
                    for h in range(heads):
                        if not np.isnan(v[:, h]).any():
                            yield (g, h), v[:, h], target[at, g[0]]

    names = [(g, h) for g in groups for h in range(heads)]
    number = {name: i for i, name in enumerate(names)}

    def sizes(batch):
        for name, _, y in values(batch):
            yield number[name], np.array([(y == 0).sum(), (y == 1).sum()], float)

    n = added(rows, sizes, np.add)
    open_ = {i: None for i, (a, b) in n.items() if a and b}
    high, low = {i: (n[i][1] + 1) / (n[i][1] + 2) for i in open_}, {i: 1 / (n[i][0] + 2) for i in open_}
    point = {i: np.array([0.0, np.log((n[i][1] + 1) / (n[i][0] + 1))]) for i in open_}
    tried, best, size = dict(point), dict.fromkeys(open_, np.inf), dict.fromkeys(open_, 1.0)
    aim = dict(point)
    for _ in range(PASSES):
        if not open_:
            break
        at = {i: tried[i] for i in open_}

        def partial(batch, at=at):
            for name, v, y in values(batch):
                if (i := number[name]) in at:
                    f = np.column_stack([v, np.ones(len(v))])
                    m, t = f @ at[i], np.where(y == 1, high[i], low[i])
                    p = sigmoid(m)
                    yield i, np.r_[(np.logaddexp(0, m) - t * m).sum(), f.T @ (p - t), (f.T @ ((p * (1 - p))[:, None] * f)).ravel()]

        sums = added(rows, partial, np.add)
        for i in list(open_):
            s = sums[i]
            if s[0] > best[i] + 1e-12 * max(1, abs(best[i])) and size[i] > 1e-9:
                size[i] /= 4
            else:
                point[i], best[i], size[i] = tried[i], s[0], 1.0
                step = np.linalg.solve(s[3:].reshape(2, 2) + 1e-12 * np.eye(2), s[1:3])
                aim[i] = point[i] - step
                if s[1:3] @ step < 1e-12 * max(1, abs(s[0])):
                    del open_[i]
                    continue
            tried[i] = point[i] + size[i] * (aim[i] - point[i])
    if open_:
        raise Unconverged(f"{len(open_)} sigmoids after {PASSES} passes")
    return {names[i]: (float(p[0]), float(p[1])) for i, p in point.items()}


def fit_calibrated(rows: DataFrame, splits: int, kind: str, heads: list[tuple[str, dict]], scale: str | None = "standard") -> Calibrated:
    """rbf_svc: the SVC of all training rows, with one sigmoid from the values that its five folds' SVCs give to rows left out.
    calibrated_svc: three folds' linear SVCs, each with a sigmoid from its left-out rows; the mean of the three.

    rows need a fold, dealt out within the classes. A fold without both classes has no part; a split without any gives NaN.
    """
    k = FOLDS[kind]
    wide, parent = with_folds(rows, splits, k)
    total = len(parent)
    if kind == "rbf_svc":
        inner = fit_kernels(wide, total, heads, scale, parent)
        groups = {(r,): [(splits + r * k + j, j, k) for j in range(k)] for r in range(splits)}
    else:
        inner = grouped.fit(wide, total, [("linear_svc", p) for _, p in heads], scale, parent, splits)
        groups = {(r, j): [(splits + r * k + j, j, k)] for r in range(splits) for j in range(k)}
    found = sigmoids(rows.select("features", "target", "fold"), groups, inner, len(heads))
    parts: dict = {}
    for (g, h), (a, b) in found.items():
        parts.setdefault((g[0], h), []).append((g[0] if kind == "rbf_svc" else splits + g[0] * k + g[1], a, b))
    return Calibrated(heads, inner, parts)
