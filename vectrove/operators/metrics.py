"""Exact ranking metrics, curves, thresholds, summaries and audits, grouped by any keys.

Everything is a window or a group over score ties, so results do not depend on how equal scores are ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored
from .ranks import running


def _ties(df: DataFrame, score: str, by: list[str], label: str) -> DataFrame:
    """(by, score, pos, n) for each distinct score: pre-aggregated, so that windows see one row a tie, and stored, as they read it several times."""
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n"))
    return stored(rows, "ties")


def roc_auc(df: DataFrame, score: str, by: list[str], label: str = "label") -> DataFrame:
    """(by, roc_auc): chance that a positive ranks above a negative, ties half; NaN with one class."""
    below = running(_ties(df, score, by, label), "_s", by, {"_below": F.col("n") - F.col("pos")})
    part = below.withColumn("_won", F.col("pos") * (F.col("_below") + (F.col("n") - F.col("pos")) / 2.0))
    out = part.groupBy(*by).agg(F.sum("_won").alias("won"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return out.select(*by, F.when(F.col("p") * F.col("q") > 0, F.col("won") / (F.col("p") * F.col("q"))).otherwise(F.lit(float("nan"))).alias("roc_auc"))


def curve(df: DataFrame, score: str, by: list[str], label: str = "label") -> DataFrame:
    """(by, threshold, tp, fp, p, q, pos, neg) at each distinct score; pos and neg are its own."""
    rows = _ties(df, score, by, label)
    whole = rows.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    below = running(rows, "_s", by, {"_pos": F.col("pos"), "_neg": F.col("n") - F.col("pos")})
    out = below.join(whole, by) if by else below.join(F.broadcast(whole))  # one row
    return out.select(*by, F.col("_s").alias("threshold"), (F.col("p") - F.col("_pos")).alias("tp"), (F.col("q") - F.col("_neg")).alias("fp"), "p", "q", "pos", (F.col("n") - F.col("pos")).alias("neg"))


def _precision() -> Column:
    """Average precision of a curve's rows."""
    return F.when(F.max("p") > 0, F.sum(F.try_divide("pos", "p") * F.col("tp") / (F.col("tp") + F.col("fp")))).otherwise(F.lit(float("nan")))


def average_precision(df: DataFrame, score: str, by: list[str], label: str = "label") -> DataFrame:
    """(by, pr_auc): sum of precision times recall gained over distinct thresholds; NaN without positives."""
    return curve(df, score, by, label).groupBy(*by).agg(_precision().alias("pr_auc"))


def both_areas(df: DataFrame, score: str, by: list[str], label: str = "label") -> DataFrame:
    """(by, roc_auc, pr_auc) as above, from one curve."""
    won = F.sum(F.col("pos") * (F.col("q") - F.col("fp") + F.col("neg") / 2.0))
    pairs = F.max("p") * F.max("q")
    roc = F.when(pairs > 0, won / pairs).otherwise(F.lit(float("nan")))
    return curve(df, score, by, label).groupBy(*by).agg(roc.alias("roc_auc"), _precision().alias("pr_auc"))


def areas_trapz(df: DataFrame, score: str, by: list[str], tie: str, label: str = "label") -> DataFrame:
    """The legacy areas: running counts row by row, no tie groups, no (0, 0) start, trapezoids."""
    down = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    run, whole = down.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    rows = df.withColumns({"_tp": F.sum(label).over(run), "_i": F.row_number().over(down), "_p": F.sum(label).over(whole), "_n": F.count("*").over(whole)})
    rows = rows.withColumns({"_tpr": F.try_divide("_tp", "_p"), "_fpr": F.try_divide(F.col("_i") - F.col("_tp"), F.col("_n") - F.col("_p")), "_prec": F.col("_tp") / F.col("_i")})
    trapezoid = lambda x, y: (F.col(x) - F.lag(x).over(down)) * (F.col(y) + F.lag(y).over(down)) / 2
    rows = rows.withColumns({"_roc": trapezoid("_fpr", "_tpr"), "_pr": trapezoid("_tpr", "_prec")})
    return rows.groupBy(*by).agg(F.sum("_roc").alias("roc_trapz"), F.sum("_pr").alias("pr_trapz"))


def roc_curve(df: DataFrame, score: str, by: list[str], label: str = "label") -> DataFrame:
    return curve(df, score, by, label).select(*by, "threshold", F.try_divide("fp", "q").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


def youden_threshold(df: DataFrame, score: str, by: list[str], label: str = "label") -> DataFrame:
    """(by, threshold, youden) of the largest TPR - FPR; ties take the highest threshold; one class gives no row."""
    rows = roc_curve(df, score, by, label).withColumn("youden", F.col("tpr") - F.col("fpr")).where("youden is not null")
    return rows.groupBy(*by).agg(F.max_by("threshold", F.struct("youden", "threshold")).alias("threshold"), F.max("youden").alias("youden"))


def blend(a: Column, b: Column, w: float) -> Column:
    """w a + (1 - w) b, w brought into [0, 1]."""
    w = min(1.0, max(0.0, w))
    return w * a + (1 - w) * b


def weight_scan(df: DataFrame, weights: list[float], a: str = "prob_a", b: str = "prob_b", split: str = "repeat_id") -> DataFrame:
    """(split, w, roc_auc, pr_auc) of each blend."""
    from .joins import scan_weights

    rows = scan_weights(df.select(split, "label", a, b), weights).withColumn("_score", F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b))
    return both_areas(rows, "_score", [split, "w"])


def best_weight(scan: DataFrame, split: str = "repeat_id") -> DataFrame:
    """Exploratory: the weight of the best AUC on the split's own test rows; ties take the least weight."""
    return scan.groupBy(split).agg(F.max_by("w", F.struct("roc_auc", -F.col("w"))).alias("w"), F.max("roc_auc").alias("roc_auc"))


#: Statistics of a metric over splits.
STATISTICS = {
    "mean": F.avg, "std": F.stddev_pop, "median": lambda c: F.percentile(c, 0.5), "iqr": lambda c: F.percentile(c, 0.75) - F.percentile(c, 0.25),
    "min": F.min, "max": F.max, "p2p5": lambda c: F.percentile(c, 0.025), "p97p5": lambda c: F.percentile(c, 0.975),
}


def _known(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def summary_stats(df: DataFrame, by: list[str], metrics: tuple[str, ...] = ("roc_auc", "pr_auc")) -> DataFrame:
    """Eight statistics of each metric; missing values are skipped, std is that of the population."""
    clean = df.select(*by, *(_known(m).alias(m) for m in metrics))
    return clean.groupBy(*by).agg(*(f(F.col(m)).alias(f"{m.removesuffix('_auc')}_{n}") for m in metrics for n, f in STATISTICS.items()))


def nan_summary(df: DataFrame, by: list[str], metrics: tuple[str, ...] = ("roc_auc", "pr_auc")) -> DataFrame:
    """Number of finite values of the first metric, mean and population std of each."""
    clean = df.select(*by, *(_known(m).alias(m) for m in metrics))
    return clean.groupBy(*by).agg(F.count(metrics[0]).alias("n_valid"), *(x for m in metrics for x in (F.avg(m).alias(f"{m.removesuffix('_auc')}_mean"), F.stddev_pop(m).alias(f"{m.removesuffix('_auc')}_std"))))


def cv_summary(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """mean, sample std, min, max and number of folds."""
    return df.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("low"), F.max(metric).alias("high"), F.count(metric).alias("folds"))


def class_stats_by_split(df: DataFrame, split: str, label: str, value: str) -> DataFrame:
    """mean, std and n by split and class, and by class with split 'all'."""
    both = df.groupBy(F.col(split).cast("string").alias("split"), label)
    stats = (F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))
    return both.agg(*stats).unionByName(df.groupBy(F.lit("all").alias("split"), label).agg(*stats))


def subgroup_auc(df: DataFrame, groups: dict[str, Column], score: str, least: int, label: str = "label") -> DataFrame:
    """(subgroup, n_pos, n_neg, roc_auc, note) of overlapping groups; a class below `least` rows gives a note and no area."""
    member = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in groups.items()))))
    rows = df.withColumn("subgroup", member)
    counts = rows.groupBy("subgroup").agg(F.sum(label).alias("n_pos"), F.sum(1 - F.col(label)).alias("n_neg"))
    out = counts.join(roc_auc(rows, score, ["subgroup"], label), "subgroup")
    few = (F.col("n_pos") < least) | (F.col("n_neg") < least)
    return out.withColumn("roc_auc", F.when(~few, F.col("roc_auc"))).withColumn("note", F.when(few, "class_too_small").otherwise(""))


def outcome(score: str, threshold: float, label: str = "label") -> Column:
    said = F.col(score) >= threshold
    return F.when(said & (F.col(label) == 1), "TP").when(~said & (F.col(label) == 0), "TN").when(said, "FP").otherwise("FN")


def confusion_group_stats(df: DataFrame, score: str, threshold: float, values: list[str]) -> DataFrame:
    """mean and sample std of values per TP, TN, FP, FN."""
    return df.groupBy(outcome(score, threshold).alias("outcome")).agg(F.count("*").alias("n"), *(x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"))))


def classification_metrics(df: DataFrame, score: str, threshold: float, by: list[str], label: str = "label") -> DataFrame:
    """Counts and rates at a threshold; an undefined rate is 0."""
    k = outcome(score, threshold, label)
    n = lambda x: F.sum(F.when(k == x, 1).otherwise(0)).alias(x.lower())
    c = df.groupBy(*by).agg(n("TN"), n("FP"), n("FN"), n("TP"))
    rate = lambda a, b: F.when(F.expr(b) > 0, F.expr(a) / F.expr(b)).otherwise(0.0)
    out = c.withColumns({"accuracy": rate("tp + tn", "tp + tn + fp + fn"), "sensitivity": rate("tp", "tp + fn"), "specificity": rate("tn", "tn + fp"), "precision": rate("tp", "tp + fp"), "f1": rate("2 * tp", "2 * tp + fp + fn")})
    return out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def stack_audit(df: DataFrame, before: str, after: str, margin: float, split: str = "repeat_id", label: str = "label") -> DataFrame:
    """Counts and shares of what a second score changes, by split and over all (split null): wrong, ambiguous, fixed, recovered,
    regressed, moved toward the label."""
    wrong = lambda c: (F.col(c) >= 0.5).cast("int") != F.col(label)
    ambiguous = F.abs(F.col(before) - 0.5) < margin
    toward = F.abs(F.col(after) - F.col(label)) < F.abs(F.col(before) - F.col(label))
    flags = {"wrong": wrong(before), "ambiguous": ambiguous, "fixed": wrong(before) & ~wrong(after), "recovered": ambiguous & wrong(before) & ~wrong(after), "regressed": ~wrong(before) & wrong(after), "toward": toward}
    out = df.withColumns({k: v.cast("int") for k, v in flags.items()}).rollup(split).agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in flags))
    most = lambda c: F.greatest(F.col(c), F.lit(1))
    return out.withColumns({"fixed_share": F.col("fixed") / most("wrong"), "recovered_share": F.col("recovered") / most("ambiguous"), "toward_share": F.col("toward") / most("n")})


def mean_by_id(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*(F.avg(v).alias(v) for v in values))


def metric_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n) of equal widths between the least and the largest value, the last bin closed; empty bins are not listed."""
    edges = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    at = F.least(F.floor((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.join(F.broadcast(edges)).groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row of edges


def robust_plane_scores(df: DataFrame, columns: list[str], label: str = "label", weights: tuple[float, ...] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Adds z_<c> (standardised by class 0 alone), total, delta_raw and delta_norm = half of the last two less the first."""
    base = df.where(F.col(label) == 0).agg(*(x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    rows = df.join(F.broadcast(base))  # one row
    z = {f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.greatest(f"_s_{c}", F.lit(1e-12)) for c in columns}
    a, b, c = columns
    rows = rows.withColumns(z).withColumn("total", reduce(lambda x, y: x + y, (w * F.col(f"z_{k}") for w, k in zip(weights, columns))))
    rows = rows.withColumns({"delta_raw": 0.5 * (F.col(b) + F.col(c)) - F.col(a), "delta_norm": 0.5 * (F.col(f"z_{b}") + F.col(f"z_{c}")) - F.col(f"z_{a}")})
    return rows.drop(*(x for k in columns for x in (f"_m_{k}", f"_s_{k}")))


def area_of_each(df: DataFrame, scores: list[str], by: list[str], label: str = "label") -> DataFrame:
    """(by, metric, roc_auc) of several score columns."""
    long = df.unpivot([*by, label], scores, "metric", "value")
    return roc_auc(long, "value", [*by, "metric"], label)


def method_summary(splits: DataFrame, methods: dict[str, tuple[str, str]]) -> DataFrame:
    """(method, n_splits_valid_roc, roc_mean, roc_std, pr_mean, pr_std) from per-split columns (roc, pr) of each method."""
    rows = reduce(DataFrame.unionByName, (splits.select(F.lit(m).alias("method"), F.col(f"`{r}`").cast("double").alias("roc_auc"), F.col(f"`{p}`").cast("double").alias("pr_auc")) for m, (r, p) in methods.items()))
    return nan_summary(rows, ["method"]).withColumnRenamed("n_valid", "n_splits_valid_roc")


def correctness_2x2(df: DataFrame, threshold: float, a: str = "prob_a", b: str = "prob_b", split: str = "repeat_id", label: str = "label") -> DataFrame:
    """Shares of rows that both, one or neither score gets right, by split, and that their mean gets right."""
    right = lambda c: (c >= threshold).cast("int") == F.col(label)
    x, y, z = right(F.col(a)), right(F.col(b)), right((F.col(a) + F.col(b)) / 2)
    share = lambda c, n: F.avg(c.cast("double")).alias(n)
    return df.groupBy(split).agg(F.count("*").alias("n"), share(x & y, "both"), share(x & ~y, "a_only"), share(~x & y, "b_only"), share(~x & ~y, "neither"), share(z, "ensemble"))


# Top rows


def extremes(df: DataFrame, value: str, n: int, tie: str, by_deviation: str | None = None) -> DataFrame:
    """Top and bottom n rows by a value, or by its squared deviation from the mean of the group by_deviation."""
    if by_deviation:
        mean = df.groupBy(by_deviation).agg(F.avg(value).alias("_m"))
        df = df.join(mean, by_deviation).withColumn("rank_value", (F.col(value) - F.col("_m")) ** 2).drop("_m")
    else:
        df = df.withColumn("rank_value", F.col(value))
    top = df.orderBy(F.col("rank_value").desc(), tie).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(df.orderBy("rank_value", tie).limit(n).withColumn("side", F.lit("bottom")))


def top_dims(coef: DataFrame, k: int) -> DataFrame:
    return coef.orderBy(F.abs("coef").desc(), "d").limit(k)


def best_per_group(df: DataFrame, by: str, metric: str, second: str, tie: str) -> DataFrame:
    """The row of the largest metric, then of the largest second one."""
    w = Window.partitionBy(by).orderBy(F.col(metric).desc(), F.col(second).desc(), tie)
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def median_split(df: DataFrame, metric: str, by: list[str], split: str = "repeat_id", first: bool = False) -> DataFrame:
    """The split in the middle (n div 2) by metric, or the lowest split."""
    order = [split] if first else [metric, split]
    w = Window.partitionBy(*by)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    return rows.where("_i = 0" if first else "_i = _n div 2").drop("_i", "_n")


def closest_to_median(df: DataFrame, metric: str, split: str = "repeat_id") -> DataFrame:
    middle = df.agg(F.percentile(metric, 0.5).alias("_m"))
    return df.join(F.broadcast(middle)).orderBy(F.abs(F.col(metric) - F.col("_m")), split).limit(1).drop("_m")  # one row


def topk_per_group(df: DataFrame, k: int, by: str, value: str, tie: str, name: str) -> DataFrame:
    """(by, joined): the k rows of largest value of each group, as text in order."""
    w = Window.partitionBy(by).orderBy(F.col(value).desc(), tie)
    best = df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k)
    return best.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_i", F.col(tie).cast("string").alias("t")))).alias("_l")).select(by, F.array_join("_l.t", ",").alias(name))


def confident_examples(df: DataFrame, score: str, threshold: float, n: int, tie: str) -> DataFrame:
    """n rows each: of the highest score for TP and FP, of the lowest for TN and FN."""
    rows = df.withColumn("outcome", outcome(score, threshold))
    key = F.when(F.col("outcome").isin("TP", "FP"), -F.col(score)).otherwise(F.col(score))
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy("outcome").orderBy(key, tie))).where(F.col("_i") <= n).drop("_i")


def worst_rows(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(value).desc(), tie).limit(n)


def most_ambiguous(df: DataFrame, score: str, k: int, tie: list[str]) -> DataFrame:
    return df.orderBy(F.abs(F.col(score) - 0.5), *tie).limit(k)


def stable_configs(df: DataFrame, by: str, tie: str) -> DataFrame:
    """(by, pick, tie): per source the configuration of lowest ROC std (ties: higher mean), lowest PR std, best ROC mean."""
    keys = {"roc_std": [F.col("roc_std"), F.col("roc_mean").desc()], "pr_std": [F.col("pr_std"), F.col("pr_mean").desc()], "roc_mean": [F.col("roc_mean").desc()]}
    picks = [df.withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(*k, tie))).where("_i = 1").select(by, F.lit(n).alias("pick"), tie) for n, k in keys.items()]
    return reduce(DataFrame.unionByName, picks)


def misclassified(df: DataFrame, score: str, threshold: float, label: str = "label") -> DataFrame:
    return df.where((F.col(score) >= threshold).cast("int") != F.col(label))
