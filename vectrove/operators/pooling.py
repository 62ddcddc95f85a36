"""Pooling of a group's tokens to features, cluster histograms, spreads, and summaries of groups.

Moments work on long rows (group, dimension, value), with partial aggregation before the shuffle; percentiles come from sketches
of whole vectors (`sketches`). No group is gathered into one array of tokens. Results are arrays of doubles ordered by dimension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import doubles, norm
from .sketches import percentiles_by_dimension


def long_rows(df: DataFrame, by: str = "patient_id", vector: str = "embedding") -> DataFrame:
    """(by, d, v), a row per token and dimension."""
    return df.select(by, F.posexplode(doubles(F.col(vector))).alias("d", "v"))


def _gather(df: DataFrame, by: str, value: str = "v", name: str = "features") -> DataFrame:
    """One array per group from a row per dimension: a vector's length, not a group's size."""
    return df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("d", value))).alias("_f")).select(by, F.col(f"_f.{value}").alias(name))


#: The plug-in point: name to a function of (long value column name, exact) giving an aggregate column, or to two shares whose percentiles are subtracted.
POOLINGS: dict[str, Callable[[str, bool], Column] | tuple[float, float]] = {
    "mean": lambda v, exact: F.avg(v),
    "std": lambda v, exact: F.stddev_pop(v),
    "max": lambda v, exact: F.max(v),
    "p90_p10": (0.9, 0.1),
    "iqr": (0.75, 0.25),
}


def register(name: str, pooling: Callable[[str, bool], Column] | tuple[float, float]) -> None:
    """Add a pooling: a builder of an aggregate column, a grouped pandas UDF wrapped in one, or two shares."""
    POOLINGS[name] = pooling


def pool(df: DataFrame, name: str, by: str = "patient_id", vector: str = "embedding", exact: bool = True) -> DataFrame:
    """(by, features) by a registered pooling, or mean_std (mean, then std) or mad; an unknown name is an error.

    Percentiles come from sketches, which are exact up to 1 024 tokens a group; larger groups, and those with null elements or
    vectors of several lengths, take a row per value. exact=False keeps larger groups in their sketches, within a proven
    rank error (`sketches.vector_percentiles`).
    """
    if name == "mad":
        middle = percentiles_by_dimension(df, [0.5], by, vector, exact).select(F.col(by).alias("_m"), F.get("values", F.lit(0)).alias("_middle"))
        away = F.zip_with(doubles(F.col(vector)), "_middle", lambda v, m: F.abs(v - m)).alias("_away")
        off = df.select(by, vector).where(F.size(vector) > 0).join(middle, F.col(by).eqNullSafe(F.col("_m"))).select(by, away)
        return percentiles_by_dimension(off, [0.5], by, "_away", exact).select(by, F.get("values", F.lit(0)).alias("features"))
    if name not in POOLINGS and name != "mean_std":
        raise ValueError(f"unknown pooling: {name}")
    shares = POOLINGS.get(name)
    if isinstance(shares, tuple):
        found = percentiles_by_dimension(df, list(shares), by, vector, exact)
        return found.select(by, F.zip_with(F.get("values", F.lit(0)), F.get("values", F.lit(1)), lambda high, low: high - low).alias("features"))
    rows = long_rows(df, by, vector)
    if name == "mean_std":
        both = rows.groupBy(by, "d").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        each = both.select(by, "d", F.col("m").alias("v")).unionByName(both.select(by, (F.col("d") + 1_000_000).alias("d"), F.col("s").alias("v")))
        return _gather(each, by)
    return _gather(rows.groupBy(by, "d").agg(POOLINGS[name]("v", exact).alias("v")), by)


def masked_if_two(df: DataFrame, by: str = "patient_id") -> DataFrame:
    """Tokens inside the mask, for groups that have two of them or more; all tokens of other groups."""
    n = F.sum(F.when(F.col("mask") == 1, 1).otherwise(0)).over(Window.partitionBy(by))
    return df.withColumn("_n", n).where("mask = 1 or _n < 2").drop("_n")


def infer_k(df: DataFrame) -> int:
    """Largest cluster id plus one."""
    return (df.agg(F.max("cluster_id")).first()[0] or 0) + 1


def cluster_hist(df: DataFrame, k: int | None = None, by: str = "patient_id", use_mask: bool = True) -> DataFrame:
    """(by, cluster, share): dense normalised counts inside the mask.

    Without k it is inferred, and ids are clipped to k - 1. With a smaller k, larger ids are dropped and the rest
    normalised again; a group with nothing left is dropped. With a larger k, zeros are added. A group with a negative id
    is dropped; one without a token inside the mask has zeros.
    """
    found = infer_k(df)
    inside = F.col("mask") == 1 if use_mask and "mask" in df.columns else F.lit(True)
    groups = df.groupBy(by).agg(F.min("cluster_id").alias("low"), F.sum(inside.cast("int")).alias("inside")).where("low >= 0").select(by, "inside")
    size = found if k is None else k
    ids = F.least("cluster_id", F.lit(size - 1)) if k is None else F.col("cluster_id")
    counts = df.where(inside).select(by, ids.alias("cluster")).where(F.col("cluster") < size).groupBy(by, "cluster").count()
    dense = groups.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("cluster", F.col("cluster").cast("long"))
    total = F.sum(F.coalesce("count", F.lit(0))).over(Window.partitionBy(by))
    out = dense.join(counts, [by, "cluster"], "left").withColumn("total", total)
    if k is not None and k < found:
        out = out.where("total > 0 or inside = 0")
    return out.select(by, "cluster", F.when(F.col("total") > 0, F.coalesce("count", F.lit(0)) / F.col("total")).otherwise(0.0).alias("share"))


def cluster_hist_raw(df: DataFrame, k: int, by: str = "patient_id") -> DataFrame:
    """(by, cluster, share) without mask; ids out of range are skipped; nothing in range gives zeros."""
    counts = df.where((F.col("cluster_id") >= 0) & (F.col("cluster_id") < k)).groupBy(by, F.col("cluster_id").cast("long").alias("cluster")).count()
    dense = df.select(by).distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("cluster", F.col("cluster").cast("long"))
    total = F.sum("count").over(Window.partitionBy(by))
    return dense.join(counts, [by, "cluster"], "left").withColumn("total", total).select(by, "cluster", F.coalesce(F.col("count") / F.col("total"), F.lit(0.0)).alias("share"))


def cluster_hist_thirds(df: DataFrame, k: int, order: list[str], by: str = "patient_id") -> DataFrame:
    """(by, cluster, share) of three histograms over index thirds, clusters numbered 0 to 3k - 1."""
    i, n = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1, F.count("*").over(Window.partitionBy(by))
    third = F.when(F.col("_i") < F.floor(F.col("_n") / 3), 0).when(F.col("_i") < F.floor(2 * F.col("_n") / 3), 1).otherwise(2)
    parts = df.withColumn("_i", i).withColumn("_n", n).withColumn("third", third)
    counts = parts.where((F.col("cluster_id") >= 0) & (F.col("cluster_id") < k)).groupBy(by, "third", "cluster_id").count()
    total = F.sum("count").over(Window.partitionBy(by, "third"))
    counts = counts.withColumn("share", F.col("count") / total).select(by, (F.col("third") * k + F.col("cluster_id")).cast("long").alias("cluster"), "share")
    dense = df.select(by).distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(3 * k - 1)))).withColumn("cluster", F.col("cluster").cast("long"))
    return dense.join(counts, [by, "cluster"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def cluster_entropy(hist: DataFrame, by: str = "patient_id") -> DataFrame:
    return hist.groupBy(by).agg(F.sum(-F.col("share") * F.log(F.col("share") + 1e-8)).alias("entropy"))


def dominant_cluster(df: DataFrame, by: str = "patient_id") -> DataFrame:
    """Most frequent cluster; ties take the lowest id."""
    return df.groupBy(by, "cluster_id").count().groupBy(by).agg(F.max_by("cluster_id", F.struct("count", -F.col("cluster_id"))).alias("dominant"))


def cluster_purity(dominant: DataFrame, labels: DataFrame, by: str = "patient_id") -> DataFrame:
    """Counts by dominant cluster and label with margins (null), and the majority share of each cluster."""
    table = dominant.join(labels, by).cube("dominant", "label").agg(F.count("*").alias("n"), F.grouping("dominant").alias("gd"), F.grouping("label").alias("gl"))
    share = table.where("gd = 0 and gl = 0").groupBy("dominant").agg((F.max("n") / F.sum("n")).alias("purity"))
    return table.select("dominant", "label", "n").join(share, "dominant", "left")


def cluster_spread(df: DataFrame, least: int, by: str = "patient_id") -> DataFrame:
    """(by, cluster_id, n, mean_std, l2_std) of clusters with `least` tokens or more."""
    n = df.groupBy(by, "cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    std = df.select(by, "cluster_id", F.posexplode(doubles(F.col("embedding"))).alias("d", "v")).groupBy(by, "cluster_id", "d").agg(F.stddev_pop("v").alias("s"))
    return n.join(std, [by, "cluster_id"]).groupBy(by, "cluster_id", "n").agg(F.avg("s").alias("mean_std"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("l2_std"))


def centroid_spread(pairs: DataFrame, by: str = "patient_id") -> DataFrame:
    """Sum, mean and number of a group's centroid distances."""
    return pairs.groupBy(by).agg(F.sum("distance").alias("total"), F.avg("distance").alias("mean"), F.count("*").alias("n_pairs"))


def mean_pair_matrix(pairs: DataFrame, labels: DataFrame, by: str = "patient_id") -> DataFrame:
    """(i, j, mean_0, n_0, mean_1, n_1, difference) of centroid distances by class."""
    side = lambda k: F.when(F.col("label") == k, F.col("distance"))
    return pairs.join(labels, by).groupBy("i", "j").agg(F.avg(side(0)).alias("mean_0"), F.count(side(0)).alias("n_0"), F.avg(side(1)).alias("mean_1"), F.count(side(1)).alias("n_1")).withColumn("difference", F.col("mean_1") - F.col("mean_0"))


def dimwise_class_diff(features: DataFrame, labels: DataFrame, by: str = "patient_id") -> DataFrame:
    """(d, mean_0, mean_1, diff, abs_diff) of each feature."""
    side = lambda k: F.avg(F.when(F.col("label") == k, F.col("v")))
    out = features.select(by, F.posexplode("features").alias("d", "v")).join(labels, by).groupBy("d").agg(side(0).alias("mean_0"), side(1).alias("mean_1"))
    return out.withColumn("diff", F.col("mean_1") - F.col("mean_0")).withColumn("abs_diff", F.abs("diff"))


def scalar_spread(features: DataFrame, kind: str = "mean", by: str = "patient_id") -> DataFrame:
    """One number per group: the mean or the l2 norm of its feature array."""
    value = norm(F.col("features")) if kind == "l2" else F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / F.size("features")
    return features.select(by, value.alias("value"))


def grid_heat(df: DataFrame, weight: str = "weight", relu: bool = False, transpose: bool = False, band: tuple[float, float] | None = None, position: str = "slice_index") -> DataFrame:
    """(y, x, heat): sums of token weights per cell, weights of about 0 skipped."""
    w = F.greatest(F.col(weight), F.lit(0.0)) if relu else F.col(weight)
    rows = df.withColumn("_w", w).where(F.abs("_w") >= 1e-18)
    if band:
        rows = rows.where((F.col(position) >= band[0]) & (F.col(position) <= band[1]))
    y, x = ("x", "y") if transpose else ("y", "x")
    return rows.groupBy(F.col(y).alias("y"), F.col(x).alias("x")).agg(F.sum("_w").alias("heat"))


def cohort_profile(grid: DataFrame, labels: DataFrame, width: float = 1.0, error: str = "sd", by: str = "patient_id") -> DataFrame:
    """(label, g, mean, low, high) of resampled profiles: mean and width times SD or SEM."""
    sd = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    half = width * (sd / F.sqrt(F.count("*")) if error == "sem" else sd)
    return grid.join(labels, by).groupBy("label", "g").agg(F.avg("value").alias("mean"), (F.avg("value") - half).alias("low"), (F.avg("value") + half).alias("high"))


def eta_squared(df: DataFrame, value: str, by: list[str], cluster: str = "cluster_id") -> DataFrame:
    """Between-cluster share of the sum of squares, in [0, 1]; null below two rows or two clusters, 0 without spread."""
    each = df.groupBy(*by, cluster).agg(F.count(value).alias("n"), F.avg(value).alias("m"))
    whole = df.groupBy(*by).agg(F.count(value).alias("all_n"), F.avg(value).alias("all_m"), (F.var_pop(value) * F.count(value)).alias("ss"))
    out = each.join(whole, by).groupBy(*by, "all_n", "ss").agg(F.sum(F.col("n") * (F.col("m") - F.col("all_m")) ** 2).alias("between"), F.count("*").alias("k"))
    eta = F.when((F.col("all_n") < 2) | (F.col("k") < 2), None).when(F.col("ss") <= 1e-300, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("between") / F.col("ss"))))
    return out.select(*by, eta.alias("eta"))


def coef_stability(df: DataFrame, tolerance: float = 1e-9, stable_at: float = 0.8) -> DataFrame:
    """Per feature over repeats (repeat_id, feature, coef): how often it is not zero, its moments, and whether it is stable."""
    top = F.max(F.abs("coef")).over(Window.partitionBy("repeat_id"))
    rows = df.withColumn("nonzero", (F.abs("coef") > F.greatest(F.lit(tolerance), 1e-15 * top)).cast("int"))
    out = rows.groupBy("feature").agg(F.avg("nonzero").alias("frequency"), F.avg("coef").alias("mean"), F.stddev_pop("coef").alias("std"), F.avg(F.abs("coef")).alias("mean_abs"))
    return out.withColumn("stable", F.col("frequency") >= stable_at)


def sparsity_summary(df: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Moments of the number of coefficients that are not zero, over repeats."""
    n = df.groupBy("repeat_id").agg(F.sum((F.abs("coef") > tolerance).cast("int")).alias("n"))
    return n.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.percentile("n", 0.5).alias("median"), F.min("n").alias("low"), F.max("n").alias("high"))


def prototype_contribution(df: DataFrame, weight: str, labels: DataFrame, by: str = "patient_id") -> DataFrame:
    """(cluster_id, weight_0, weight_1, delta): token weight of each prototype by class."""
    side = lambda k: F.sum(F.when(F.col("label") == k, F.col(weight)).otherwise(0.0))
    return df.join(labels, by).groupBy("cluster_id").agg(side(0).alias("weight_0"), side(1).alias("weight_1")).withColumn("delta", F.col("weight_1") - F.col("weight_0"))


def exact_sum(df: DataFrame, column: str):
    """Sum of a column in decimals, the same in any order of the rows; of doubles where one is not finite or has more than 27 digits."""
    top = df.agg(F.max(F.abs(F.col(column).cast("double")))).first()[0]
    if top is None or not top < 1e27:  # NaN too
        return F.sum(column)
    return F.sum(F.col(column).cast(f"decimal(28,{28 - len(str(int(top))) - 1})"))


def prototype_regions(df: DataFrame, weight: str, region: str, top: int = 5, by: str = "patient_id") -> DataFrame:
    """(region, n): tokens of each group's `top` prototypes of largest weight, by region. Weights are added exactly, so equal ones tie."""
    sums = df.groupBy(by, "cluster_id").agg(exact_sum(df, weight).alias("w"))
    best = sums.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("w").desc(), "cluster_id"))).where(F.col("place") <= top)
    return df.join(best.select(by, "cluster_id"), [by, "cluster_id"]).groupBy(region).agg(F.count("*").alias("n"))


def prototype_distance(assigned: DataFrame, by: str = "patient_id") -> DataFrame:
    """Mean and median of 1 - similarity to the nearest prototype."""
    return assigned.groupBy(by).agg(F.avg(1 - F.col("similarity")).alias("mean"), F.percentile(1 - F.col("similarity"), 0.5).alias("median"))


def prototype_similarity(prototypes: DataFrame) -> DataFrame:
    """Least, largest and mean cosine of different prototypes: K rows."""
    from ..functions.arrays import dot

    a, b = prototypes.select(F.col("k").alias("i"), F.col("centroid").alias("a")), prototypes.select(F.col("k").alias("j"), F.col("centroid").alias("b"))
    s = a.join(b, F.col("i") < F.col("j")).select((dot(F.col("a"), F.col("b")) / (norm(F.col("a")) * norm(F.col("b")))).alias("s"))
    return s.agg(F.min("s").alias("low"), F.max("s").alias("high"), F.avg("s").alias("mean"))


def depth_profile(df: DataFrame, weight: str, labels: DataFrame, position: str = "slice_index", by: str = "patient_id") -> DataFrame:
    return df.join(labels, by).groupBy("label", position).agg(F.avg(weight).alias("weight"))


def coverage(ids: DataFrame, have: DataFrame, key: str = "patient_id") -> DataFrame:
    """(missing, examples): number of ids without data, and the first five."""
    gone = ids.select(key).distinct().join(have.select(key), key, "left_anti")
    first = gone.orderBy(key).limit(5).agg(F.array_join(F.sort_array(F.collect_list(key)), ",").alias("examples"))
    return gone.agg(F.count("*").alias("missing")).join(first)


def percentile_window(df: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """(by, low, high) percentiles of a group's values; high is low + 1 where they fall together."""
    out = df.groupBy(*by).agg(F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"))
    return out.withColumn("high", F.when(F.col("high") <= F.col("low"), F.col("low") + 1).otherwise(F.col("high")))


#: Named feature sets: blocks side by side. vol, vol_mm and the like come from operators.sequences.
FEATURE_SETS = {
    "std": ("std",), "vol": ("vol",), "p90_p10": ("p90_p10",), "vol_mm": ("vol_mm",), "std_vol": ("std", "vol"), "std_p90_p10": ("std", "p90_p10"), "std_vol_mm": ("std", "vol_mm"), "p90_p10_vol": ("p90_p10", "vol"),
    "p90_p10_vol_mm": ("p90_p10", "vol_mm"), "std_p90_p10_vol": ("std", "p90_p10", "vol"), "std_p90_p10_vol_mm": ("std", "p90_p10", "vol_mm"), "global_mean_vol_mm": ("global_mean_vol_mm",),
    "p90_vol_mm": ("p90_vol_mm",), "regional_vol_mm": ("regional_vol_mm",), "p90_p10_regional_vol_mm": ("p90_p10", "regional_vol_mm"), "std_regional_vol_mm": ("std", "regional_vol_mm"),
}


def feature_set(df: DataFrame, name: str, by: str = "patient_id", order: tuple[str, ...] = ("z_mm", "slice_index")) -> DataFrame:
    """(by, features): the blocks of a named set, one after another; an unknown name is an error."""
    from . import sequences

    if name not in FEATURE_SETS:
        raise ValueError(f"unknown feature set: {name}")
    out = None
    for block in FEATURE_SETS[name]:
        part = pool(df, block, by) if block in POOLINGS else sequences.block(df, block, by, order)
        part = part.withColumnRenamed("features", f"_{block}")
        out = part if out is None else out.join(part, by)
    return out.select(by, F.concat(*(F.col(f"_{b}") for b in FEATURE_SETS[name])).alias("features"))
