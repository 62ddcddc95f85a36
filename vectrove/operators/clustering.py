"""Spherical k-means in Spark: prototypes are a small matrix, tokens stay where they are.

Each round is one pass over the stored unit vectors: a task adds up its members of each cluster, K rows leave it, and Spark sums
them. The same pass counts tokens whose nearest prototype differs between the last two rounds, which is the test to stop.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import l2_normalise
from ..shared import stored
from .grouped import added, matrix
from .joins import assign_prototypes


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


def _starts(rows: DataFrame, key: str, n: int, seed: int) -> list:
    """The first n rows in md5 order: distinct, and the same for every engine."""
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return [np.array(r.x) for r in rows.orderBy(order, key).limit(n).select("x").collect()]


def spherical_kmeans(tokens: DataFrame, k: int = 64, most: int = 50, seed: int = 42, key: str = "token_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(prototypes (k, centroid), assigned tokens). Fewer tokens than k is an error.

    All tokens start in cluster 0; a round gives each the prototype of the largest product (ties: the lowest) and stops if none
    has moved, else moves prototypes to their members' normalised means; an empty cluster takes a fresh row. Where the
    rounds run out, assignments are those before the last move.
    """
    spark = tokens.sparkSession
    rows = stored(tokens.select(key, l2_normalise(F.col(vector)).alias("x")), "unit-vectors")
    firsts = _starts(rows, key, k, seed)
    if len(firsts) < k:
        raise ValueError(f"{len(firsts)} tokens cannot make {k} clusters")
    now, before, spare, used = _unit(np.array(firsts)), None, [], 0

    def members(old, new):
        def partial(batch):
            x = matrix(batch.column("x"))
            to = (x @ new.T).argmax(axis=1)
            moved = to != ((x @ old.T).argmax(axis=1) if old is not None else 0)
            order = np.argsort(to, kind="stable")
            found, first = np.unique(to[order], return_index=True)
            for c, n, m, total in zip(found, np.diff(np.r_[first, len(to)]), np.bincount(to, moved)[found], np.add.reduceat(x[order], first)):
                yield int(c), np.r_[n, m, total]

        return partial

    for _ in range(most):
        sums = added(rows.select("x"), members(before, now), np.add)
        if not sum(s[1] for s in sums.values()):
            before = now
            break
        total, n = np.zeros(now.shape), np.zeros(k)
        for c, s in sums.items():
            n[c], total[c] = s[0], s[2:]
        new = total / np.maximum(n, 1)[:, None]
        for c in np.flatnonzero(n == 0):
            if used >= len(spare):
                spare = _starts(rows, key, 2 * k + used, seed + 1)
            new[c] = spare[used % len(spare)]
            used += 1
        before, now = now, _unit(new)
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "k int, centroid array<double>")
    return frame(now), assign_prototypes(rows.select(key, F.col("x").alias(vector)), frame(before), vector)


def fit_assign(tokens: DataFrame, fit_ids: DataFrame, k: int, most: int = 50, seed: int = 42, by: str = "patient_id") -> tuple[DataFrame, DataFrame]:
    """Cluster the tokens of the fitting groups, and assign those of the others to the frozen prototypes: (prototypes, assigned)."""
    inside = tokens.join(fit_ids.select(by), by, "left_semi")
    outside = tokens.join(fit_ids.select(by), by, "left_anti")
    prototypes, fitted = spherical_kmeans(inside, k, most, seed)
    rest = assign_prototypes(outside.select("token_id", l2_normalise(F.col("embedding")).alias("embedding")), prototypes)
    return prototypes, fitted.withColumn("fitted", F.lit(True)).unionByName(rest.withColumn("fitted", F.lit(False)))
