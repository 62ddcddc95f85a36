"""Joins and set operations of cohorts, tokens and predictions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_scores(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = ("score_a", "score_b"), key: str = "patient_id") -> DataFrame:
    """Inner join on the id as text; scores become numbers and rows without both are dropped."""
    left, right = a.withColumn(key, F.col(key).cast("string")), b.withColumn(key, F.col(key).cast("string"))
    out = left.join(right, key)
    for c in columns:
        out = out.withColumn(c, F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")))
    return out.dropna(subset=list(columns))


def join_oos(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("repeat_id", "patient_id"), labels: DataFrame | None = None) -> DataFrame:
    """Inner join of two towers' predictions; labels of both sides must agree, or it is an error when the row is read.

    The label is that of the side that has one, else of a label table.
    """
    keys = list(keys)
    left = a.withColumnRenamed("label", "label_a") if "label" in a.columns else a.withColumn("label_a", F.lit(None).cast("int"))
    right = b.withColumnRenamed("label", "label_b") if "label" in b.columns else b.withColumn("label_b", F.lit(None).cast("int"))
    out = left.join(right, keys)
    if labels is not None:
        out = out.join(labels.select("patient_id", F.col("label").alias("label_c")), "patient_id", "left")
    else:
        out = out.withColumn("label_c", F.lit(None).cast("int"))
    conflict = F.col("label_a") != F.col("label_b")
    label = F.when(conflict, F.raise_error(F.lit("labels of the two sides differ")).cast("int")).otherwise(F.coalesce("label_a", "label_b", "label_c"))
    return out.withColumn("label", label).drop("label_a", "label_b", "label_c")


def label_conflicts(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("repeat_id", "patient_id")) -> DataFrame:
    """Rows whose labels differ between the sides."""
    return a.select(*keys, F.col("label").alias("label_a")).join(b.select(*keys, F.col("label").alias("label_b")), list(keys)).where("label_a <> label_b")


def left_attach(df: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Left join; columns that both have get the suffix _extra."""
    renamed = extra.select(F.col(key), *(F.col(c).alias(f"{c}_extra" if c in df.columns else c) for c in extra.columns if c != key))
    return df.join(renamed, key, "left")


def outer_merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join after each side has one row a key."""
    return a.dropDuplicates(keys).join(b.dropDuplicates(keys), keys, "outer")


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "patient_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def train_rows(cohort: DataFrame, tests: DataFrame, key: str = "patient_id", split: str = "repeat_id") -> DataFrame:
    """For each split, the cohort without its test ids: (split, cohort columns). A test id outside the cohort is an error."""
    outside = tests.join(cohort, key, "left_anti").limit(1)
    if not outside.isEmpty():
        raise ValueError("a test id is not in the cohort")
    splits = tests.select(split).distinct()
    return cohort.join(splits).join(tests.select(split, key), [split, key], "left_anti")


def resolve_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, match, tier) of left ids among right ids: 1 exact, 2 case-insensitive, 3 the left id is a prefix; ties take the first.

    The prefix tier is an equi-join on every prefix length that occurs among the left ids, not a comparison of all pairs.
    """
    exact = left.join(right.select(F.col("id").alias("match"), F.col("id")), "id").select("id", "match", F.lit(1).alias("tier"))
    lower = left.withColumn("low", F.lower("id")).join(right.select(F.col("id").alias("match"), F.lower("id").alias("low")), "low").select("id", "match", F.lit(2).alias("tier"))
    lengths = left.select(F.length("id").alias("size")).distinct()
    heads = right.select(F.col("id").alias("match")).join(F.broadcast(lengths)).where("length(match) >= size").select("match", F.expr("substr(match, 1, size)").alias("id"))  # lengths: a few numbers
    prefix = left.join(heads, "id").select("id", "match", F.lit(3).alias("tier"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("tier", "match"))
    return exact.unionByName(lower).unionByName(prefix).withColumn("place", first).where("place = 1").drop("place")


def align_sources(frames: list[DataFrame], key: str = "patient_id") -> DataFrame:
    """Ids that every source has, once each."""
    return reduce(lambda a, b: a.join(b, key, "left_semi"), (f.select(key).distinct() for f in frames))


def scan_weights(df: DataFrame, weights: list[float]) -> DataFrame:
    """A row for each weight of the grid; weights outside [0, 1] are an error."""
    if any(not 0 <= w <= 1 for w in weights):
        raise ValueError("a weight lies outside [0, 1]")
    return df.withColumn("w", F.explode(F.array(*(F.lit(float(w)) for w in weights))))


def centroids(tokens: DataFrame, least: int, vector: str = "embedding", by: str = "patient_id") -> DataFrame:
    """(by, cluster_id, n, centroid) of each group's clusters with `least` tokens or more."""
    n = tokens.groupBy(by, "cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    mean = tokens.select(by, "cluster_id", F.posexplode(vector).alias("d", "v")).groupBy(by, "cluster_id", "d").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return mean.groupBy(by, "cluster_id").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("c")).select(by, "cluster_id", F.col("c.v").alias("centroid")).join(n, [by, "cluster_id"])


def centroid_pairs(tokens: DataFrame, least: int = 1, by: str = "patient_id") -> DataFrame:
    """(by, i, j, distance) of each pair i < j of a group's cluster centroids; clusters are as few as prototypes."""
    from ..functions.arrays import norm

    c = centroids(tokens, least, by=by)
    a, b = c.select(by, F.col("cluster_id").alias("i"), F.col("centroid").alias("ci")), c.select(by, F.col("cluster_id").alias("j"), F.col("centroid").alias("cj"))
    return a.join(b, by).where("i < j").select(by, "i", "j", norm(F.zip_with("ci", "cj", lambda x, y: x - y)).alias("distance"))


def leave_one_split_out(df: DataFrame, score: str, key: str = "patient_id", split: str = "repeat_id") -> DataFrame:
    """Adds loo: mean of the id's score over its other splits, else the mean of all rows. One window, no self-join."""
    mine = Window.partitionBy(key)
    s, n = F.sum(score).over(mine), F.count(score).over(mine)
    whole = df.agg(F.avg(score).alias("_all"))
    return df.withColumn("_loo", F.when(n > 1, (s - F.col(score)) / (n - 1))).join(F.broadcast(whole)).withColumn("loo", F.coalesce("_loo", "_all")).drop("_loo", "_all")  # one row


def assign_prototypes(tokens: DataFrame, prototypes: DataFrame, vector: str = "embedding", most: int = 16384) -> DataFrame:
    """Adds proto and similarity: the prototype (k, centroid) with the largest product; ties take the lowest k.

    Prototypes are a model's K rows, shipped to the tasks as one matrix; Arrow batches are multiplied with it. More than
    `most` of them are an error.
    """
    rows = sorted(prototypes.select("k", "centroid").limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"more than {most} prototypes")
    names, matrix = np.array([r.k for r in rows]), np.array([r.centroid for r in rows], float)

    @F.pandas_udf("struct<proto:int,similarity:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(float) if len(v) else np.empty((0, matrix.shape[1]))
        s = x @ matrix.T
        best = s.argmax(axis=1)
        return pd.DataFrame({"proto": names[best], "similarity": s[np.arange(len(x)), best]})

    return tokens.withColumn("_n", nearest(F.col(vector))).withColumns({"proto": F.col("_n.proto"), "similarity": F.col("_n.similarity")}).drop("_n")


def resample_grid(seq: DataFrame, n: int, by: str = "patient_id", order: tuple[str, ...] = ("pos", "slice_index"), value: str = "value") -> DataFrame:
    """(by, g, t, value): linear interpolation of each group's ordered values at n even points of [0, 1]; length 1 is constant.

    Each token serves the grid points between itself and the next, so a group is never gathered into an array.
    """
    w = Window.partitionBy(by).orderBy(*order)
    rows = seq.select(by, F.row_number().over(w).alias("_i"), F.count("*").over(Window.partitionBy(by)).alias("_k"), F.col(value).alias("_a"), F.lead(value).over(w).alias("_b"))
    rows = rows.withColumn("_i", F.col("_i") - 1)
    last = n - 1
    # floor(g (k - 1) / last) = i holds for ceil(i last / (k - 1)) <= g < ceil((i + 1) last / (k - 1))
    start = F.expr(f"if(_k = 1, 0, (_i * {last} + _k - 2) div (_k - 1))")
    stop = F.expr(f"if(_k = 1, {last}, if(_i = _k - 1, {last}, ((_i + 1) * {last} + _k - 2) div (_k - 1) - 1))")
    points = rows.withColumn("_from", start).withColumn("_to", stop).where("_from <= _to").withColumn("g", F.explode(F.sequence("_from", "_to")))
    into = F.col("g") * (F.col("_k") - 1) / float(last) - F.col("_i")
    out = F.when((F.col("_k") == 1) | F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_a") + into * (F.col("_b") - F.col("_a")))
    return points.select(by, F.col("g").cast("long").alias("g"), (F.col("g") / float(last)).alias("t"), out.alias("value"))


def lookup_slice_position(tokens: DataFrame, slices: DataFrame, by: tuple[str, ...] = ("patient_id", "slice_index")) -> DataFrame:
    """Copies a slice's values to each of its tokens."""
    return tokens.join(slices, list(by))


def concat_blocks(a: DataFrame, b: DataFrame, key: str = "patient_id") -> DataFrame:
    """Feature arrays of two sources side by side."""
    return a.select(key, F.col("features").alias("_a")).join(b.select(key, F.col("features").alias("_b")), key).select(key, F.concat("_a", "_b").alias("features"))


def check_disjoint(splits: dict[str, DataFrame], key: str = "patient_id", strict: bool = False) -> DataFrame:
    """(left, right, overlap, duplicates) for each pair of id lists; with strict an overlap is an error."""
    names, parts = list(splits), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = splits[a].select(key).intersect(splits[b].select(key)).agg(F.count("*").alias("overlap"))
            twice = splits[a].agg((F.count(key) - F.count_distinct(key)).alias("duplicates"))
            parts.append(both.join(twice).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "overlap", "duplicates"))
    out = reduce(DataFrame.unionByName, parts)
    if strict and not out.where("overlap > 0").isEmpty():
        raise ValueError("the splits overlap")
    return out


def union_sources(frames: list[DataFrame], key: str = "patient_id") -> DataFrame:
    """Harmonised tables one after another; of rows with one key the last table's stays."""
    from ..functions.clean import dedupe_last

    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    return dedupe_last(reduce(DataFrame.unionByName, tagged), key, "_source").drop("_source")


def intersect_ids(frames: list[DataFrame], key: str = "patient_id") -> DataFrame:
    return reduce(DataFrame.intersect, (f.select(key) for f in frames))


def except_ids(ids: DataFrame, known: DataFrame, key: str = "patient_id") -> DataFrame:
    return ids.select(key).join(known.select(key), key, "left_anti")


def fit_and_assign_ids(train: DataFrame, val: DataFrame, other: DataFrame, key: str = "patient_id") -> DataFrame:
    """(key, fit): distinct trimmed ids of train and val fit; ids of other that are in neither are only assigned."""
    clean: Column = F.trim(F.col(key).cast("string")).alias(key)
    fit = train.select(clean).union(val.select(clean)).where(F.col(key) != "").distinct()
    rest = other.select(clean).where(F.col(key) != "").distinct().join(fit, key, "left_anti")
    return fit.withColumn("fit", F.lit(True)).unionByName(rest.withColumn("fit", F.lit(False)))
