"""Functions of vector and grid columns. Arrays are columns of numbers; results are doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def total(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column, eps: float = 1e-8) -> Column:
    """Elements over the norm plus eps."""
    n = norm(v) + F.lit(eps)
    return F.transform(doubles(v), lambda x: x / n)


def clip_scale(v: Column, low: float = -1000.0, high: float = 400.0) -> Column:
    """Clip, map to [0, 1] with 1e-8 in the denominator, then to [-1, 1]."""
    return F.transform(doubles(v), lambda x: 2.0 * ((F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / (high - low + 1e-8)) - 1.0)


def mask_array(v: Column, m: Column) -> Column:
    """Elements where the mask is positive, else 0; shapes must agree."""
    shaped = F.when(F.size(v) == F.size(m), doubles(v)).otherwise(F.raise_error(F.lit("mask and array differ in size")).cast("array<double>"))
    return F.zip_with(shaped, m, lambda x, k: F.when(k > 0, x).otherwise(0.0))


def nan_to_zero(v: Column) -> Column:
    return F.transform(doubles(v), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def explode_slices(df: DataFrame, column: str, depth: int) -> DataFrame:
    """A row (volume part) for each depth index of a flat volume of `depth` equal slices."""
    return df.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("values", F.expr(f"slice({column}, cast(slice * (size({column}) div {depth}) as int) + 1, cast(size({column}) div {depth} as int))"))


def grid_coords(df: DataFrame, decode: str = "row_major", flat: str = "spatial_flat_idx", height: str = "grid_h", width: str = "grid_w") -> DataFrame:
    """Adds y and x of a flat cell index; cells out of range are dropped."""
    y, x = {"row_major": (f"{flat} div {width}", f"{flat} % {width}"), "col_major": (f"{flat} % {height}", f"{flat} div {height}"), "transpose": (f"{flat} % {width}", f"{flat} div {width}")}[decode]
    return df.withColumn("y", F.expr(y)).withColumn("x", F.expr(x)).where(f"y >= 0 and x >= 0 and y < {height} and x < {width}")


def flip_grid(df: DataFrame, mode: str, height: str = "grid_h", width: str = "grid_w") -> DataFrame:
    """none, lr (x), ud (y) or lr_ud."""
    if mode not in ("none", "lr", "ud", "lr_ud"):
        raise ValueError(f"unknown mode: {mode}")
    if "lr" in mode:
        df = df.withColumn("x", F.expr(f"{width} - 1 - x"))
    return df.withColumn("y", F.expr(f"{height} - 1 - y")) if "ud" in mode else df


def position_kernel(pos: Column, centre: float, half: float) -> Column:
    """A triangle of height 1 at the centre."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.abs(pos - centre) / max(half, 1e-6)))


def cluster_weight(tokens: DataFrame, coef: DataFrame, top_k: int = 0) -> DataFrame:
    """Adds weight: the coefficient of the token's cluster; with top_k only the clusters of the largest positive ones count.

    coef (cluster_id, coef) has a row per cluster, a model's number of coefficients.
    """
    if top_k > 0:
        rank = F.row_number().over(Window.orderBy(F.col("coef").desc(), "cluster_id"))
        coef = coef.withColumn("rank", rank).select("cluster_id", F.when((F.col("rank") <= top_k) & (F.col("coef") > 0), F.col("coef")).otherwise(0.0).alias("coef"))
    return tokens.join(coef, "cluster_id", "left").withColumn("weight", F.coalesce("coef", F.lit(0.0))).drop("coef")


def cosine_relu(df: DataFrame, by: str, vector: str, weight: str) -> DataFrame:
    """Adds factor: the positive part of the product of each unit vector with its group's mean direction over weighted tokens."""
    unit = df.withColumn("_unit", l2_normalise(F.col(vector)))
    mean = unit.where(F.col(weight) > 0).select(by, F.posexplode("_unit").alias("d", "v")).groupBy(by, "d").agg(F.avg("v").alias("v")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("m")).select(by, l2_normalise(F.col("m.v")).alias("_ref"))
    return unit.join(mean, by, "left").withColumn("factor", F.greatest(F.lit(0.0), F.coalesce(dot(F.col("_unit"), F.col("_ref")), F.lit(0.0)))).drop("_unit", "_ref")


def norm_dampen(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Adds dampen: sqrt(median norm of the group / own norm); 1 where that median is about 0."""
    normed = df.withColumn("_norm", norm(F.col(vector)))
    middle = normed.groupBy(*by).agg(F.percentile("_norm", 0.5).alias("_middle"))
    return normed.join(middle, by).withColumn("dampen", F.when(F.col("_middle") < 1e-12, 1.0).otherwise(F.sqrt(F.col("_middle") / F.greatest("_norm", F.lit(1e-12))))).drop("_norm", "_middle")


def js_divergence(p: Column, q: Column, eps: float = 1e-8) -> Column:
    """Jensen-Shannon divergence of two histograms, natural logarithm, eps added before they are normalised."""
    even = lambda h: F.transform(doubles(h), lambda x: (x + eps) / (total(h) + eps * F.size(h)))
    part = lambda a, m: F.aggregate(F.zip_with(a, m, lambda x, y: x * F.log(x / y)), F.lit(0.0), lambda s, x: s + x)
    a, b = even(p), even(q)
    m = F.zip_with(a, b, lambda x, y: (x + y) / 2.0)
    return (part(a, m) + part(b, m)) / 2.0


def centre_of_mass(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Weighted mean of y and x; null where the mass is 1e-8 or less."""
    mass = F.sum(value)
    return df.groupBy(*by).agg(F.when(mass > 1e-8, F.sum(F.col(value) * F.col("y")) / mass).alias("cy"), F.when(mass > 1e-8, F.sum(F.col(value) * F.col("x")) / mass).alias("cx"))


def pair_error(a: Column, b: Column) -> Column:
    """struct(mae, mse) of two arrays."""
    d = F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)
    mean = lambda f: F.aggregate(F.transform(d, f), F.lit(0.0), lambda s, x: s + x) / F.size(d)
    return F.struct(mean(F.abs).alias("mae"), mean(lambda x: x * x).alias("mse"))


def thresholded_area(v: Column, m: Column, threshold: float) -> Column:
    """Number of elements above the threshold inside the mask."""
    return F.aggregate(F.zip_with(doubles(v), m, lambda x, k: F.when((x > threshold) & (k > 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def block_meta(index: Column, layout: list[str], dims: int) -> Column:
    """struct(block, dim) of a feature index in blocks of `dims` features laid out in order."""
    return F.struct(F.element_at(F.array(*map(F.lit, layout)), (F.floor(index / dims) + 1).cast("int")).alias("block"), (index % dims).alias("dim"))
