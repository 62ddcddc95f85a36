"""Connected components of an edge table, by alternating star contractions in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of an edge: component is the least node that links reach.

    edges has two columns of one orderable type. Nulls, loops and repeated edges are dropped; a node with no other edge
    has no row; no edges, no rows. Rounds repeat until the edges stay as they are: a star for each component.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, mark = stored(now, "edges"), None
    for _ in range(most):
        now = stored(_small_star(_large_star(now)), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index that links reach from each of n nodes: for the bounded groups inside a task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
