"""Resampling on md5 draws, and hypothesis tests by ranks and moments.

Random choices are orders or draws of md5 values, so any engine reproduces them. p-values of ranks are exact for small samples
without ties (EXACT_CLASS, EXACT_PAIRS), else normal approximations with tie correction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..shared import stored
from .ranks import ties
from .replicates import drawn_curves, drawn_means, ordered_permutations, weighted_curves, weighted_means

#: Exact p-values: at most so many rows in the smaller class, at most so many pairs.
EXACT_CLASS, EXACT_PAIRS = 8, 50


@F.pandas_udf(DoubleType())
def normal_two_sided(z: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Two-sided p of a standard normal z."""
    for s in z:
        yield s.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else float("nan"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([_beta(n / 2, 0.5, n / (n + x * x)) if x == x and n == n and n > 0 else float("nan") for x, n in zip(t, df)])


def chi1_p(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return normal_two_sided(F.sqrt(x))


@lru_cache(256)
def rank_sum_counts(m: int, n: int) -> np.ndarray:
    """How many of the choices of m among m + n ranks have U = 0, 1, ..., m n: the coefficients of a Gaussian binomial, as whole numbers of any size."""
    ways = np.zeros(m * n + 1, object)
    ways[0] = 1
    for i in range(1, m + 1):  # times 1 - x**(n + i), over 1 - x**i; degrees above m n are not needed
        if n + i < len(ways):
            ways[n + i :] = ways[n + i :] - ways[: -(n + i)]
        for j in range(min(i, len(ways))):
            ways[j::i] = np.cumsum(ways[j::i])
    return ways


@lru_cache(64)
def signed_rank_counts(n: int) -> np.ndarray:
    """How many of the 2**n choices of signs give the positive ranks the sum 0, 1, ..., n (n + 1) / 2."""
    ways = np.zeros(n * (n + 1) // 2 + 1, object)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] = ways[k:] + ways[:-k]
    return ways


def _tail(ways: np.ndarray, at: float, alternative: str) -> float:
    """P(at least `at`), P(at most `at`), or twice the lesser, at most 1."""
    k, whole = round(at), ways.sum()
    up, down = ways[k:].sum() / whole, ways[: k + 1].sum() / whole
    return float({"greater": up, "less": down}.get(alternative, min(1.0, 2 * min(up, down))))


def _exact(kind: str, alternative: str):
    """Column function of an exact p: U with the sizes of its class and of the other, or W with the number of pairs. Null in, NaN out."""
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"unknown alternative {alternative!r}")

    @F.pandas_udf(DoubleType())
    def p(at: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
        def each(x, m, n):
            if x != x or m != m or n != n:
                return float("nan")
            return _tail(rank_sum_counts(min(int(m), int(n)), max(int(m), int(n))) if kind == "u" else signed_rank_counts(int(m)), x, alternative)

        return pd.Series([each(*r) for r in zip(at, n1, n0)], dtype="float64")

    return p


def normal_tail(z: Column, alternative: str) -> Column:
    """p of a standard normal z; `z` must be right for the alternative's continuity correction."""
    both = normal_two_sided(z)
    up = F.when(z > 0, both / 2).otherwise(1 - both / 2)
    return {"two-sided": both, "greater": up, "less": F.when(z < 0, both / 2).otherwise(1 - both / 2)}[alternative]


def mcnemar(df: DataFrame, threshold: float, a: str = "prob_a", b: str = "prob_b", by: str = "repeat_id", label: str = "label") -> DataFrame:
    """(by, b, c, chi2, p) with continuity correction; groups without discordant rows are left out."""
    right = lambda c: (F.col(c) >= threshold).cast("int") == F.col(label)
    n = df.groupBy(by).agg(F.sum((right(a) & ~right(b)).cast("int")).alias("b"), F.sum((~right(a) & right(b)).cast("int")).alias("c")).where("b + c > 0")
    return n.withColumn("chi2", (F.abs(F.col("b") - F.col("c")) - 1) ** 2 / (F.col("b") + F.col("c"))).withColumn("p", chi1_p(F.col("chi2")))


def score_agreement(df: DataFrame, a: str = "prob_a", b: str = "prob_b", by: str = "repeat_id") -> DataFrame:
    """Pearson r by split (more than two rows): mean, std and the middle 95 %, beside the pooled r."""
    each = df.groupBy(by).agg(F.corr(a, b).alias("r"), F.count("*").alias("n")).where("n > 2")
    return each.agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.975).alias("high")).join(df.agg(F.corr(a, b).alias("pooled")))


def _corr(x: str, y: str) -> Column:
    """Pearson's r, null where a side is constant (`corr` divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, pearson, spearman, note) over finite pairs."""
    good = df.where(f"{x} is not null and {y} is not null and not isnan({x}) and not isnan({y})")
    rank = lambda c, name: ties(good, c, by).select(*by, c, F.col("rank").alias(name))
    ranked = good.select(*by, x, y).join(rank(x, "_rx"), [*by, x]).join(rank(y, "_ry"), [*by, y])
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), _corr(x, y).alias("pearson"), _corr("_rx", "_ry").alias("spearman"), F.min(x).alias("_l"), F.max(x).alias("_h"))
    note = F.when(F.col("n") < 3, "too_few_finite_pairs").when(F.col("_l") == F.col("_h"), "x_constant").otherwise("")
    return out.withColumn("note", note).drop("_l", "_h")


def point_biserial(df: DataFrame, x: str, by: list[str], label: str = "label") -> DataFrame:
    """(by, n, r, t, df, p, note): correlation of a 0/1 label with x over finite pairs, by Student's t; too few pairs, one class and a constant x give a note and no r."""
    good = df.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & F.col(label).isin(0, 1))
    out = good.groupBy(*by).agg(F.count("*").alias("n"), _corr(label, x).alias("_r"), F.min(label).alias("_y"), F.max(label).alias("_z"), F.min(x).alias("_l"), F.max(x).alias("_h"))
    note = F.when(F.col("n") < 3, "too_few_finite_pairs").when(F.col("_y") == F.col("_z"), "single_class").when(F.col("_l") == F.col("_h"), "x_constant").otherwise("")
    out = out.withColumn("note", note).withColumn("r", F.when(F.col("note") == "", F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "_r"))))
    out = out.withColumn("df", F.when(F.col("r").isNotNull(), (F.col("n") - 2).cast("double"))).withColumn("t", F.col("r") * F.sqrt(F.try_divide("df", 1 - F.col("r") ** 2)))
    return out.select(*by, "n", "r", "t", "df", F.when(F.abs("r") == 1, 0.0).when(F.col("t").isNotNull(), t_two_sided("t", "df")).alias("p"), "note")


def mann_whitney(df: DataFrame, value: str, by: list[str], label: str = "label", alternative: str = "two-sided") -> DataFrame:
    """(by, n1, n0, u, z, p, exact): U of label 1, z with tie and continuity correction.

    p is counted out where a class has at most EXACT_CLASS rows and no value is tied, else from the normal distribution; it is
    NaN where a class is empty or all values are equal. "greater" means that label 1 tends to larger values.
    """
    ranked = ties(df, value, by, ones=F.sum(label), rest=F.sum(1 - F.col(label)))
    out = ranked.groupBy(*by).agg(F.sum(F.col("ones") * F.col("rank")).alias("_rs"), F.sum("ones").alias("n1"), F.sum("rest").alias("n0"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("_t"))
    out = out.withColumn("u", F.col("_rs") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    n = F.col("n1") + F.col("n0")
    spread = F.sqrt(F.col("n1") * F.col("n0") / 12.0 * ((n + 1) - F.try_divide("_t", n * (n - 1))))
    gap = F.col("u") - F.col("n1") * F.col("n0") / 2.0
    z = F.when(spread > 0, F.signum(gap) * F.greatest(F.lit(0.0), F.abs(gap) - 0.5) / spread)
    counted = _exact("u", alternative)
    out = out.withColumns({"z": z, "exact": (F.least("n1", "n0") <= EXACT_CLASS) & (F.least("n1", "n0") > 0) & (F.col("_t") == 0)})
    shift = {"two-sided": 0.0, "greater": 0.5, "less": -0.5}[alternative]
    side = F.col("z") if alternative == "two-sided" else F.when(spread > 0, (gap - shift) / spread)
    only = lambda c: F.when(F.col("exact"), F.col(c).cast("double"))
    return out.withColumn("p", F.when(F.col("exact"), counted(only("u"), only("n1"), only("n0"))).otherwise(normal_tail(side, alternative))).drop("_rs", "_t")


def welch_t(df: DataFrame, value: str, by: list[str], label: str = "label") -> DataFrame:
    """(by, t, df, p) of unequal variances; NaN values are left out."""
    v = lambda k: F.when((F.col(label) == k) & ~F.isnan(value), F.col(value))
    s = df.groupBy(*by).agg(*(x for k in (0, 1) for x in (F.avg(v(k)).alias(f"m{k}"), F.var_samp(v(k)).alias(f"v{k}"), F.count(v(k)).alias(f"n{k}"))))
    e0, e1 = F.try_divide("v0", "n0"), F.try_divide("v1", "n1")
    out = s.select(*by, F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(e0 + e1)).alias("t"), F.try_divide((e0 + e1) ** 2, F.try_divide(e0**2, F.col("n0") - 1) + F.try_divide(e1**2, F.col("n1") - 1)).alias("df"))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def permutation_p(df: DataFrame, value: str, key: str, n: int, seed: int, label: str = "label") -> DataFrame:
    """(difference, p) of class means under n permutations of the labels: (times as far + 1) / (n + 1).

    The rows of least md5 get label 1 (`replicates`). Rows without a value take part in the order, not in the means. No rows in, no rows out.
    """
    one = lambda c, k: F.avg(F.when(F.col(label) == k, F.col(c)))
    rows = stored(df.select(key, label, F.col(value).cast("double").alias(value)), "rows")
    whole = rows.agg(F.sum(label).alias("_k"), (one(value, 1) - one(value, 0)).alias("difference"), F.sum(value).alias("_all"), F.count(value).alias("_m"), F.count("*").alias("_rows"))
    told = whole.first()  # one row
    each = ordered_permutations(rows, value, key, n if told["_rows"] else 0, seed, int(told["_k"] or 0), max(1, told["_rows"]))
    each = each.join(F.broadcast(whole)).withColumn("_d", F.try_divide("_s", "_c") - F.try_divide(F.col("_all") - F.col("_s"), F.col("_m") - F.col("_c")))  # one row
    return each.groupBy("difference").agg(((F.coalesce(F.sum((F.abs("_d") >= F.abs("difference") - 1e-12).cast("int")), F.lit(0)) + 1) / F.lit(n + 1.0)).alias("p"))


def cliffs_delta(df: DataFrame, value: str, by: list[str], label: str = "label") -> DataFrame:
    """2 U / (n m) - 1 by ranks; 0 where a class is empty."""
    u = mann_whitney(df, value, by, label)
    return u.select(*by, F.when(F.col("n1") * F.col("n0") > 0, 2 * F.col("u") / (F.col("n1") * F.col("n0")) - 1).otherwise(0.0).alias("delta"))


def _interval(df: DataFrame, value: str, alpha: float = 0.05) -> list[Column]:
    good = F.when(~F.isnan(value), F.col(value))
    return [F.percentile(good, alpha / 2).alias(f"{value}_low"), F.percentile(good, 0.5).alias(f"{value}_mid"), F.percentile(good, 1 - alpha / 2).alias(f"{value}_high")]


def bootstrap_metric(df: DataFrame, score: str, key: str, n: int, seed: int, label: str = "label") -> DataFrame:
    """2.5, 50 and 97.5 percent points of both areas of rows drawn with replacement (`replicates`); replicates of one class are skipped."""
    each = stored(drawn_curves(df, score, key, n, seed, label), "replicates")  # n rows, read by several percentiles
    return each.agg(F.count("*").alias("n_valid"), *_interval(each, "roc_auc"), *_interval(each, "pr_auc"))


def bootstrap_threshold(df: DataFrame, score: str, key: str, n: int, seed: int, label: str = "label") -> DataFrame:
    """Interval of the Youden threshold and of its index under class-wise resampling."""
    each = stored(drawn_curves(df, score, key, n, seed, label, label), "replicates")
    return each.agg(*_interval(each, "threshold"), *_interval(each, "youden"))


def bootstrap_mean_ci(df: DataFrame, value: str, key: str, n: int, seed: int, alpha: float = 0.05) -> DataFrame:
    each = drawn_means(df, value, key, n, seed)
    return df.agg(F.avg(value).alias("mean")).join(each.agg(*_interval(each, value, alpha)))


def weighted_bootstrap_metric(df: DataFrame, score: str, key: str, n: int, seed: int, label: str = "label") -> DataFrame:
    """As bootstrap_metric, by weights drawn where the rows are (`replicates`)."""
    each = stored(weighted_curves(df, score, key, n, seed, label), "replicates")  # n rows, read by several percentiles
    return each.agg(F.count("*").alias("n_valid"), *_interval(each, "roc_auc"), *_interval(each, "pr_auc"))


def weighted_bootstrap_threshold(df: DataFrame, score: str, key: str, n: int, seed: int, label: str = "label") -> DataFrame:
    """Intervals of the Youden threshold, its sensitivity and specificity, and the area, by weights of each class's rows."""
    each = stored(weighted_curves(df, score, key, n, seed, label), "replicates")
    return each.agg(F.count("*").alias("n_valid"), *(x for c in ("threshold", "sensitivity", "specificity", "roc_auc") for x in _interval(each, c)))


def weighted_mean_ci(df: DataFrame, value: str, key: str, n: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """As bootstrap_mean_ci, by weights; one scan."""
    return df.agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias("mean")).join(weighted_means(df, value, key, n, seed).agg(*_interval(df, value, alpha)))


def wilcoxon(df: DataFrame, difference: str, by: list[str], alternative: str = "two-sided") -> DataFrame:
    """(by, n, w_plus, z, p, exact, note): zeros dropped, ties at mean ranks; fewer than three pairs give a note and no p.

    p is counted out for at most EXACT_PAIRS pairs without ties and zeros, else from the normal distribution. "greater" means
    that differences tend to be positive. A group of nothing but zeros has no row.
    """
    zeros = df.where(F.col(difference) == 0).groupBy(*by).agg(F.count("*").alias("_zeros"))
    rows = df.where(F.col(difference) != 0).withColumn("_a", F.abs(difference))
    ranked = ties(rows, "_a", by, ups=F.sum((F.col(difference) > 0).cast("int")))
    out = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("ups") * F.col("rank")).alias("w_plus"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("_t"))
    n = F.col("n")
    z = (F.col("w_plus") - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_t") / 48.0)
    counted = _exact("w", alternative)
    same = F.lit(True)
    for c in by:
        same = same & out[c].eqNullSafe(zeros[c])
    out = out.join(zeros, same, "left").select(*(out[c] for c in out.columns), F.coalesce(zeros["_zeros"], F.lit(0)).alias("_zeros"))
    out = out.withColumns({"z": F.when(n >= 3, z), "exact": (n >= 3) & (n <= EXACT_PAIRS) & (F.col("_t") == 0) & (F.col("_zeros") == 0)})
    only = lambda c: F.when(F.col("exact"), F.col(c).cast("double"))
    p = F.when(F.col("exact"), counted(only("w_plus"), only("n"), only("n"))).otherwise(normal_tail(F.col("z"), alternative))
    return out.withColumn("p", F.when(n >= 3, p)).withColumn("note", F.when(n < 3, "too_few_pairs").otherwise("")).drop("_t", "_zeros")


def paired_delta(splits: DataFrame, reference: str, challenger: str, n: int, seed: int, split: str = "repeat_id") -> DataFrame:
    """Per-split difference of two metrics: mean, bootstrap interval, Wilcoxon."""
    d = stored(splits.select(split, (F.col(challenger) - F.col(reference)).alias("delta")), "differences")
    return bootstrap_mean_ci(d, "delta", split, n, seed).join(wilcoxon(d, "delta", []).select("w_plus", "z", "p"))


def weighted_paired_delta(splits: DataFrame, reference: str, challenger: str, n: int, seed: int, split: str = "repeat_id", alternative: str = "two-sided") -> DataFrame:
    """As paired_delta, by weights, with the Wilcoxon test of the named alternative. Splits without a finite difference are left out."""
    d = F.col(challenger) - F.col(reference)
    d = stored(splits.select(split, d.alias("delta")).where(d.isNotNull() & ~F.isnan(d)), "differences")
    return weighted_mean_ci(d, "delta", split, n, seed).join(wilcoxon(d, "delta", [], alternative).select("w_plus", "z", "p", "exact"))


def ellipse_outliers(df: DataFrame, x: str, y: str, by: str, confidence: float = 0.95) -> DataFrame:
    """Adds d2 (squared Mahalanobis distance within the class) and outlier; chi-square with two degrees has the limit -2 ln(1 - c)."""
    limit = -2 * math.log(1 - confidence)
    m = df.groupBy(by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_a"), F.covar_pop(x, y).alias("_b"), F.var_pop(y).alias("_c"))
    rows = df.join(m, by).withColumns({"_dx": F.col(x) - F.col("_mx"), "_dy": F.col(y) - F.col("_my"), "_det": F.expr("_a * _c - _b * _b")})
    d2 = F.expr("(_c * _dx * _dx - 2 * _b * _dx * _dy + _a * _dy * _dy) / _det")
    return rows.withColumn("d2", d2).withColumn("outlier", F.col("d2") > limit).drop("_mx", "_my", "_a", "_b", "_c", "_dx", "_dy", "_det")


def ellipse_area(df: DataFrame, x: str, y: str, by: str, confidence: float = 0.95) -> DataFrame:
    """Area of each class's ellipse: pi times the limit times the root of the eigenvalues' product."""
    limit = -2 * math.log(1 - confidence)
    m = df.groupBy(by).agg(F.var_pop(x).alias("a"), F.covar_pop(x, y).alias("b"), F.var_pop(y).alias("c"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    return m.select(by, (math.pi * limit * F.sqrt(F.greatest(half + root, F.lit(1e-12)) * F.greatest(half - root, F.lit(1e-12)))).alias("area"))


def group_tests(df: DataFrame, value: str, by: list[str], label: str = "label") -> DataFrame:
    """(by, mean_0, mean_1, change, u, z, t, df): class means, their per cent difference, and both tests."""
    side = lambda k: F.avg(F.when(F.col(label) == k, F.col(value)))
    m = df.groupBy(*by).agg(side(0).alias("mean_0"), side(1).alias("mean_1")).withColumn("change", F.when(F.abs("mean_0") >= 1e-15, 100 * (F.col("mean_1") - F.col("mean_0")) / F.abs("mean_0")))
    return m.join(mann_whitney(df, value, by, label).select(*by, "u", "z"), by).join(welch_t(df, value, by, label).select(*by, "t", "df"), by)


def controls_sex_test(df: DataFrame, score: str, sex: str = "sex", label: str = "label") -> DataFrame:
    """Of class 0: mean score by sex, and both tests of M against F."""
    rows = df.where(F.col(label) == 0).select(score, (F.upper(F.trim(sex)) == "M").cast("int").alias("male"))
    side = lambda k: F.avg(F.when(F.col("male") == k, F.col(score)))
    return rows.agg(side(0).alias("mean_f"), side(1).alias("mean_m")).join(mann_whitney(rows, score, [], "male").select("u", "z")).join(welch_t(rows, score, [], "male").select("t", "df"))


def stable_dim_profiles(features: DataFrame, stability: DataFrame, by: str = "d", label: str = "label", least: int = 3) -> DataFrame:
    """For stable dimensions: class means of a per-group value (by, label, value), with U where both classes have `least` rows."""
    rows = features.join(stability.where("stable").select(F.col("feature").alias(by)), by, "left_semi")
    side = lambda k: F.avg(F.when(F.col(label) == k, F.col("value")))
    m = rows.groupBy(by).agg(side(0).alias("mean_0"), side(1).alias("mean_1"))
    u = mann_whitney(rows, "value", [by], label)
    return m.join(u, by).select(by, "mean_0", "mean_1", F.when((F.col("n1") >= least) & (F.col("n0") >= least), F.col("u")).alias("u"))
