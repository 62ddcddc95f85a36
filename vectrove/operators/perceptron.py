"""Perceptrons with one hidden ReLU layer, of many splits and settings, fitted together.

Each pass over the rows sums, for every open fit, the loss and its gradient over the training rows and the loss over held-out
ones; the driver holds each fit's own weights and takes an Adam step. A tenth of each split's training rows is held out; a fit
ends when their loss has not fallen by TOLERANCE for PATIENCE passes, or after PASSES, and keeps the weights of the least one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import grouped
from .grouped import added, matrix, sigmoid

#: Most passes; passes without a gain before a fit ends; least gain; Adam's rate; parts of the training rows, one of which is held out.
PASSES, PATIENCE, TOLERANCE, RATE, PARTS = 300, 20, 1e-4, 0.02, 10


def shapes(d: int, hidden: int) -> list[tuple[int, ...]]:
    return [(d, hidden), (hidden,), (hidden,), (1,)]


def unpacked(w: np.ndarray, d: int, hidden: int) -> list[np.ndarray]:
    """Weights and offsets of the hidden layer, weights and offset of the output."""
    out, at = [], 0
    for s in shapes(d, hidden):
        n = int(np.prod(s))
        out.append(w[at : at + n].reshape(s))
        at += n
    return out


def started(d: int, hidden: int, seed: int) -> np.ndarray:
    """Uniform weights within the root of 2 / (inputs + outputs) of a layer."""
    rng = np.random.default_rng(seed)
    parts = [rng.uniform(-1, 1, s) * np.sqrt(2 / (i + o)) for s, i, o in zip(shapes(d, hidden), (d, d, hidden, hidden), (hidden, hidden, 1, 1))]
    return np.concatenate([p.ravel() for p in parts])


def margin(w: np.ndarray, z: np.ndarray, hidden: int) -> np.ndarray:
    a, b, c, e = unpacked(w, z.shape[1], hidden)
    return np.maximum(z @ a + b, 0) @ c + e[0]


def loss_and_gradient(w: np.ndarray, z: np.ndarray, y: np.ndarray, hidden: int) -> np.ndarray:
    """Sum of the rows' log-losses, then its gradient."""
    a, b, c, e = unpacked(w, z.shape[1], hidden)
    inner = z @ a + b
    act = np.maximum(inner, 0)
    m = act @ c + e[0]
    gap = sigmoid(m) - y
    back = gap[:, None] * c * (inner > 0)
    return np.r_[(np.logaddexp(0, m) - y * m).sum(), (z.T @ back).ravel(), back.sum(axis=0), act.T @ gap, gap.sum()]


@dataclass
class Perceptrons:
    """Weights of each (split, head)."""

    heads: list[tuple[str, dict]]
    shift: np.ndarray
    width: np.ndarray
    weights: dict[tuple[int, int], np.ndarray]

    def score(self, r: int, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift[r]) / self.width[r]
        out = np.full((len(x), len(self.heads)), np.nan)
        for h, (_, p) in enumerate(self.heads):
            if (r, h) in self.weights:
                out[:, h] = sigmoid(margin(self.weights[r, h], z, p.get("hidden", 16)))
        return out


def fit(rows: DataFrame, splits: int, heads: list[tuple[str, dict]], scale: str | None = "standard") -> Perceptrons:
    """Mean log-loss plus alpha |w|^2 / (2 n) of the weights (offsets are free). Parameters: alpha (1e-4), hidden (16), seed (42).

    rows: features, target (one for each split) and fold, dealt out within the classes: fold % PARTS = 0 is held out. A split
    with one class in training gives NaN; one without held-out rows goes by its training loss.
    """
    if "fold" not in rows.columns or "repeat_id" in rows.columns:
        raise ValueError("rows need a fold, and targets of all splits")
    rows = rows.select("features", "target", "fold")
    found = grouped.scaling(rows, splits, scale)
    d = found.shift.shape[1]
    fits = [(r, h) for r in range(splits) if 0 < found.ones[r] < found.n[r] for h in range(len(heads))]
    hidden, alpha = [p.get("hidden", 16) for _, p in heads], [float(p.get("alpha", 1e-4)) for _, p in heads]
    w = [started(d, hidden[h], heads[h][1].get("seed", 42)) for _, h in fits]
    kept, least, since = list(w), [np.inf] * len(fits), [0] * len(fits)
    first, second, done = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], [False] * len(fits)
    of: dict[int, list[int]] = {}
    for k, (r, _) in enumerate(fits):
        of.setdefault(r, []).append(k)
    for step in range(1, PASSES + 1):
        points = {r: [(k, w[k]) for k in ks if not done[k]] for r, ks in of.items()}
        if not any(points.values()):
            break

        def partial(batch, points=points):
            x, target, out = matrix(batch.column("features")), matrix(batch.column("target")).astype(np.int64), batch.column("fold").to_numpy() % PARTS == 0
            for r, mine in points.items():
                if mine:
                    z, y = (x - found.shift[r]) / found.width[r], target[:, r]
                    a, b = (y >= 0) & ~out, (y >= 0) & out
                    for k, at in mine:
                        h = hidden[fits[k][1]]
                        m = margin(at, z[b], h)
                        yield k, np.r_[a.sum(), b.sum(), (np.logaddexp(0, m) - y[b] * m).sum(), loss_and_gradient(at, z[a], y[a], h)]

        sums = added(rows, partial, np.add)
        for mine in points.values():
            for k, at in mine:
                s, h = sums[k], fits[k][1]
                n = max(s[0], 1)
                parts = unpacked(at, d, hidden[h])
                held = s[2] / s[1] if s[1] else s[3] / n
                if held < least[k] - TOLERANCE:
                    kept[k], least[k], since[k] = at, held, 0
                else:
                    since[k] += 1
                    done[k] = since[k] >= PATIENCE
                g = s[4:] / n + alpha[h] / n * np.concatenate([parts[0].ravel(), 0 * parts[1], parts[2], 0 * parts[3]])
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                w[k] = at - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Perceptrons(heads, found.shift, found.width, dict(zip(fits, kept)))
