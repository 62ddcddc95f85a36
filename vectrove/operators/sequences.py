"""Ordered sequences of a group: neighbour differences, rates, positions, runs, concentrations, ranks.

Order is by position, then index; windows are partitioned by the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import doubles, norm
from .pooling import _gather
from .sketches import percentiles_by_dimension


def ordered(by: str, order: tuple[str, ...]):
    return Window.partitionBy(by).orderBy(*order)


def order_tokens(df: DataFrame, by: str = "patient_id", position: str = "z_mm", index: str = "slice_index") -> DataFrame:
    """Adds place, from 0, by (position, index); groups without one usable position go by index alone."""
    usable = F.max(F.when(F.col(position).isNotNull() & ~F.isnan(position), 1)).over(Window.partitionBy(by))
    key = F.when(usable == 1, F.col(position))
    return df.withColumn("_key", key).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_key", index)) - 1).drop("_key")


def normalised_position(df: DataFrame, by: str = "patient_id", position: str = "z_mm", index: str = "slice_index") -> DataFrame:
    """Adds pos_norm in [0, 1] from the least to the largest position; evenly by order where they fall together; a single row has 0."""
    w = Window.partitionBy(by)
    low, high, n = F.min(position).over(w), F.max(position).over(w), F.count("*").over(w)
    place = F.row_number().over(w.orderBy(position, index)) - 1
    out = df.withColumns({"_l": low, "_h": high, "_n": n, "_p": place})
    value = F.when(F.col("_n") == 1, 0.0).when(F.col("_h") - F.col("_l") <= 1e-9, F.col("_p") / (F.col("_n") - 1)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(position) - F.col("_l")) / (F.col("_h") - F.col("_l")))))
    return out.withColumn("pos_norm", value).drop("_l", "_h", "_n", "_p")


def step_rates(df: DataFrame, by: str = "patient_id", value: str = "value", position: str = "pos", index: str = "slice_index", eps: float = 1e-3) -> DataFrame:
    """(by, index, step, rate, mid): |difference| of neighbours, the same over the distance (at least eps), and the middle."""
    w = ordered(by, (position, index))
    rows = df.select(by, index, F.abs(F.col(value) - F.lag(value).over(w)).alias("step"), F.abs(F.col(position) - F.lag(position).over(w)).alias("_gap"), ((F.col(position) + F.lag(position).over(w)) / 2).alias("mid"))
    return rows.where("step is not null").select(by, index, "step", (F.col("step") / F.greatest("_gap", F.lit(eps))).alias("rate"), "mid")


def whole_steps(df: DataFrame, by: str = "patient_id", order: tuple[str, ...] = ("z_mm", "slice_index"), vector: str = "embedding", eps: float = 1e-3) -> DataFrame:
    """(by, steps, rates, mid_norm) for each neighbour pair: |differences| by dimension and the same over the distance (at least eps)."""
    w, whole = ordered(by, order), Window.partitionBy(by)
    position = order[0]
    low, high = F.min(position).over(whole), F.max(position).over(whole)
    rows = df.select(by, F.zip_with(doubles(F.col(vector)), doubles(F.lag(vector).over(w)), lambda x, y: F.abs(x - y)).alias("steps"), F.greatest(F.abs(F.col(position) - F.lag(position).over(w)), F.lit(eps)).alias("_over"), F.lag(position).over(w).alias("_before"), F.col(position).alias("_at"), (((F.col(position) + F.lag(position).over(w)) / 2 - low) / F.nullif(high - low, F.lit(0.0))).alias("mid_norm"))
    rows = rows.where("steps is not null and _before is not null and _at is not null")
    return rows.select(by, "steps", F.transform("steps", lambda x: x / F.col("_over")).alias("rates"), "mid_norm")


def vector_steps(df: DataFrame, by: str = "patient_id", order: tuple[str, ...] = ("z_mm", "slice_index"), vector: str = "embedding", eps: float = 1e-3) -> DataFrame:
    """(by, d, step, rate, mid_norm) for each neighbour pair and dimension."""
    pairs = whole_steps(df, by, order, vector, eps).select(by, "mid_norm", F.posexplode(F.arrays_zip("steps", "rates")).alias("d", "_s"))
    return pairs.select(by, "d", F.col("_s.steps").alias("step"), F.col("_s.rates").alias("rate"), "mid_norm")


def volatility(df: DataFrame, by: str = "patient_id", order: tuple[str, ...] = ("z_mm", "slice_index")) -> DataFrame:
    """Mean |difference| of neighbours per dimension; groups of one token have none."""
    return _gather(vector_steps(df, by, order).groupBy(by, "d").agg(F.avg("step").alias("v")), by)


def volatility_rate(df: DataFrame, by: str = "patient_id", order: tuple[str, ...] = ("z_mm", "slice_index"), eps: float = 1e-3) -> DataFrame:
    return _gather(vector_steps(df, by, order, eps=eps).groupBy(by, "d").agg(F.avg("rate").alias("v")), by)


def volatility_rate_p90(df: DataFrame, by: str = "patient_id", order: tuple[str, ...] = ("z_mm", "slice_index")) -> DataFrame:
    """90 % point of the rates per dimension, from sketches of whole rate vectors where these are exact."""
    return percentiles_by_dimension(whole_steps(df, by, order), [0.9], by, "rates").select(by, F.get("values", F.lit(0)).alias("features"))


def volatility_rate_regions(df: DataFrame, by: str = "patient_id", order: tuple[str, ...] = ("z_mm", "slice_index")) -> DataFrame:
    """Mean rate per dimension in each third of the normalised middle positions; an empty third gives nulls."""
    m = F.coalesce("mid_norm", F.lit(0.0))
    third = lambda k: F.avg(F.when((m >= k / 3) & ((m < (k + 1) / 3) if k < 2 else F.lit(True)), F.col("rate")))
    each = vector_steps(df, by, order).groupBy(by, "d").agg(*(third(k).alias(f"v{k}") for k in range(3)))
    rows = each.select(by, "d", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "v")).select(by, (F.col("k") * 1_000_000 + F.col("d")).alias("d"), "v")
    return _gather(rows, by)


def block(df: DataFrame, name: str, by: str, order: tuple[str, ...]) -> DataFrame:
    """A trajectory block of a feature set."""
    if name == "global_mean_vol_mm":
        return volatility_rate(df, by, order).select(by, F.array(F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / F.size("features")).alias("features"))
    return {"vol": volatility, "vol_mm": volatility_rate, "p90_vol_mm": volatility_rate_p90, "regional_vol_mm": volatility_rate_regions}[name](df, by, order)


def runs(df: DataFrame, by: str, order: tuple[str, ...], flag: str) -> DataFrame:
    """(by, flag, length) of each maximal run of equal flags: gaps and islands."""
    i, j = F.row_number().over(ordered(by, order)), F.row_number().over(Window.partitionBy(by, flag).orderBy(*order))
    return df.withColumn("_island", i - j).groupBy(by, flag, "_island").agg(F.count("*").alias("length")).drop("_island")


def run_lengths(df: DataFrame, k: int, least: int, by: str = "patient_id", order: tuple[str, ...] = ("pos", "slice_index")) -> DataFrame:
    """(by, cluster, longest, mean, flag), dense over k: longest and mean run over the group's size, and whether longest >= least."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    each = runs(df, by, order, "cluster_id").groupBy(by, F.col("cluster_id").cast("long").alias("cluster")).agg(F.max("length").alias("top"), F.avg("length").alias("avg"))
    dense = n.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("cluster", F.col("cluster").cast("long"))
    top = F.coalesce("top", F.lit(0))
    return dense.join(each, [by, "cluster"], "left").select(by, "cluster", (top / F.col("n")).alias("longest"), (F.coalesce("avg", F.lit(0.0)) / F.col("n")).alias("mean"), (top >= least).cast("int").alias("flag"))


def longest_run(weights: DataFrame, by: str = "patient_id", order: tuple[str, ...] = ("pos", "slice_index"), weight: str = "weight") -> DataFrame:
    """Longest run of weights of at least max(0.1, 1 / n)."""
    n = F.count("*").over(Window.partitionBy(by))
    flagged = weights.withColumn("high", F.col(weight) >= F.greatest(F.lit(0.1), 1.0 / n))
    return runs(flagged, by, order, "high").groupBy(by).agg(F.max(F.when(F.col("high"), F.col("length")).otherwise(0)).alias("longest"))


def first_difference(df: DataFrame, by: str = "patient_id", order: tuple[str, ...] = ("pos", "slice_index"), value: str = "value") -> DataFrame:
    return df.withColumn("difference", F.col(value) - F.lag(value).over(ordered(by, order))).where("difference is not null")


def relative_peak(df: DataFrame, by: list[str], order: list[str], value: str = "v") -> DataFrame:
    """Index of the largest |value| (first on ties) over max(1, n - 1)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("_p", place).groupBy(*by).agg((F.max_by("_p", F.struct(F.abs(F.col(value)), -F.col("_p"))) / F.greatest(F.lit(1), F.count("*") - 1)).alias("peak"))


def mass_to_reach(df: DataFrame, target: float, by: str = "patient_id", weight: str = "weight", tie: str = "slice_index") -> DataFrame:
    """Smallest number of largest weights that together reach the target; all if they do not."""
    w = Window.partitionBy(by).orderBy(F.col(weight).desc(), tie)
    run = df.withColumn("_sum", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return run.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("_sum") >= target, F.col("_n"))), F.count("*")).cast("long").alias("n"))


def adjacent_delta_similarity(a: DataFrame, by: str, order: tuple[str, ...], left: str, right: str) -> DataFrame:
    """Correlation and mean absolute error of the mean squared neighbour differences of two vector series."""
    w = ordered(by, order)
    change = lambda c: F.aggregate(F.zip_with(doubles(F.col(c)), doubles(F.lag(c).over(w)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(c)
    rows = a.select(by, change(left).alias("p"), change(right).alias("q")).where("p is not null")
    return rows.groupBy(by).agg(F.corr("p", "q").alias("correlation"), F.avg(F.abs(F.col("p") - F.col("q"))).alias("mae"))


def zscore_within(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds z: (x - mean) / max(population std, 1e-6) of the group."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(stats, by).withColumn("z", (F.col(value) - F.col("_m")) / F.greatest("_s", F.lit(1e-6))).drop("_m", "_s")


def cdf_position(reference: DataFrame, distribution: DataFrame, by: str, value: str) -> DataFrame:
    """Share of the distribution at or below each group's reference value."""
    ref = reference.select(by, F.col(value).alias("_r"))
    return distribution.join(ref, by).groupBy(by).agg(F.avg((F.col(value) <= F.col("_r")).cast("double")).alias("position"))


def bh_fdr(df: DataFrame, p: str, by: list[str], tie: str) -> DataFrame:
    """Adds q: Benjamini-Hochberg adjusted p within each metric."""
    up = Window.partitionBy(*by).orderBy(p, tie)
    n = F.count("*").over(Window.partitionBy(*by))
    raw = df.withColumn("_raw", F.col(p) * n / F.row_number().over(up)).withColumn("_i", F.row_number().over(up))
    back = Window.partitionBy(*by).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min("_raw").over(back)))).drop("_raw", "_i")


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 within the group, ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def attention_concentration(df: DataFrame, k: int, by: str = "patient_id", weight: str = "weight", tie: str = "slice_index") -> DataFrame:
    """Entropy, effective number 1 / sum of squares, top-1 and top-k mass of normalised weights; even weights if their sum is 0."""
    whole = Window.partitionBy(by)
    total, n = F.sum(weight).over(whole), F.count("*").over(whole)
    share = df.withColumn("_t", total).withColumn("_n", n).withColumn("a", F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise(1.0 / F.col("_n")))
    rank = share.withColumn("_i", F.row_number().over(whole.orderBy(F.col("a").desc(), tie)))
    return rank.groupBy(by).agg(F.sum(-F.col("a") * F.log(F.col("a") + 1e-12)).alias("entropy"), (1 / F.sum(F.col("a") * F.col("a"))).alias("effective"), F.max("a").alias("top1"), F.sum(F.when(F.col("_i") <= k, F.col("a")).otherwise(0.0)).alias("topk"))


def vector_norm_by_group(features: DataFrame, by: str = "patient_id") -> DataFrame:
    return features.select(by, norm(F.col("features")).alias("score"))
