"""Reproducible splits and folds on md5 orders, scaling fitted on training rows, and small parameter tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def md5_order(key: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), *(p.cast("string") for p in parts)))


def stratified_repeats(df: DataFrame, n: int = 100, test: float = 0.2, seed: int = 42, key: str = "patient_id", label: str = "label") -> DataFrame:
    """(repeat_id, key, label, is_test): per repeat ceil(test N) rows, shared out to classes by largest remainder, ties to the lower label."""
    ids = df.select(key, label)
    classes = ids.groupBy(label).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy()
    share = classes.withColumn("_all", F.sum("_c").over(whole)).withColumn("_want", F.ceil(F.lit(test) * F.col("_all"))).withColumn("_q", F.col("_want") * F.col("_c") / F.col("_all"))
    share = share.withColumn("_floor", F.floor("_q")).withColumn("_left", F.col("_want") - F.sum("_floor").over(whole))
    share = share.withColumn("_take", F.col("_floor") + (F.row_number().over(whole.orderBy((F.col("_floor") - F.col("_q")), label)) <= F.col("_left")).cast("int"))
    rows = ids.withColumn("repeat_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(share.select(label, "_take"), label)
    place = F.row_number().over(Window.partitionBy("repeat_id", label).orderBy(md5_order(key, F.col("repeat_id"), F.lit(seed)), key))
    return rows.select("repeat_id", key, label, (place <= F.col("_take")).alias("is_test"))


def adaptive_folds(df: DataFrame, label: str = "label", most: int = 5) -> int:
    """max(2, min(most, size of the smaller class))."""
    return max(2, min(most, df.groupBy(label).count().agg(F.min("count")).first()[0] or 0))


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "patient_id", label: str = "label") -> DataFrame:
    """Adds fold, dealt in md5 order within each class."""
    return df.withColumn("fold", ((F.row_number().over(Window.partitionBy(label).orderBy(md5_order(key, F.lit(seed)), key)) - 1) % k).cast("int"))


def split_masks(df: DataFrame, lists: dict[str, DataFrame], key: str = "patient_id") -> DataFrame:
    """Adds split: the first list that has the id, else null."""
    out, tags = df, []
    for name, ids in lists.items():
        out = out.join(ids.select(key).distinct().withColumn(f"_in_{name}", F.lit(name)), key, "left")
        tags.append(f"_in_{name}")
    return out.withColumn("split", F.coalesce(*tags)).drop(*tags)


def _train_stats(df: DataFrame, flag: str, vector: str, by: list[str], *aggregates: Column) -> DataFrame:
    return df.where(flag).select(*by, F.posexplode(vector).alias("d", "v")).groupBy(*by, "d").agg(*aggregates)


def _scaled(df: DataFrame, stats: DataFrame, value: Column, by: list[str], vector: str) -> DataFrame:
    """Replace the vector by value(v and the statistics of its dimension); statistics are a row per dimension and split."""
    table = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("d", *[c for c in stats.columns if c not in (*by, "d")]))).alias("_t"))
    rows = df.join(table, by) if by else df.join(F.broadcast(table))  # one row without keys
    return rows.withColumn(vector, F.zip_with(vector, "_t", lambda v, t: value(v, t))).drop("_t")


def standardise(df: DataFrame, flag: str, vector: str = "features", by: tuple[str, ...] = ()) -> DataFrame:
    """(v - mean) / population std of the training rows; a zero std divides by 1."""
    stats = _train_stats(df, flag, vector, list(by), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return _scaled(df, stats, lambda v, t: (v - t.m) / F.when(t.s > 0, t.s).otherwise(1.0), list(by), vector)


def minmax(df: DataFrame, flag: str, vector: str = "features", by: tuple[str, ...] = ()) -> DataFrame:
    """(v - min) / (max - min) of the training rows; others may leave [0, 1]; a constant gives 0."""
    stats = _train_stats(df, flag, vector, list(by), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return _scaled(df, stats, lambda v, t: F.when(t.hi > t.lo, (v - t.lo) / (t.hi - t.lo)).otherwise(0.0), list(by), vector)


def append_clinical(df: DataFrame, flag: str, variant: str = "A", by: tuple[str, ...] = ()) -> DataFrame:
    """A: standardised features, min-max age, sex; B: all side by side, then standardised. Needs features, age, sex_code."""
    if variant == "A":
        age = minmax(df.withColumn("_age", F.array("age")), flag, "_age", by)
        return standardise(age, flag, "features", by).withColumn("features", F.concat("features", "_age", F.array("sex_code"))).drop("_age")
    if variant == "B":
        return standardise(df.withColumn("features", F.concat("features", F.array("age", "sex_code"))), flag, "features", by)
    raise ValueError(f"unknown variant: {variant}")


#: The grid of heads.
C_VALUES, L1_RATIOS = (0.01, 0.1, 1.0, 10.0), (0.2, 0.5, 0.8)


def head_grid(spark: SparkSession, extra: bool = False) -> DataFrame:
    """(kind, c, l1_ratio, alpha): 24 configurations, 30 with the extra ones."""
    c = spark.createDataFrame([(x,) for x in C_VALUES], "c double")
    one = lambda kind: c.select(F.lit(kind).alias("kind"), "c", F.lit(None).cast("double").alias("l1_ratio"), F.lit(None).cast("double").alias("alpha"))
    out = one("logistic_l2").unionByName(one("logistic_l1"))
    out = out.unionByName(c.crossJoin(spark.createDataFrame([(x,) for x in L1_RATIOS], "l1_ratio double")).select(F.lit("logistic_en").alias("kind"), "c", "l1_ratio", F.lit(None).cast("double").alias("alpha")))  # 4 x 3 parameters
    out = out.unionByName(one("linear_svc"))
    if extra:
        out = out.unionByName(one("calibrated_svc").where("c < 10"))
        out = out.unionByName(spark.createDataFrame([(x,) for x in (1e-4, 1e-3, 1e-2)], "alpha double").select(F.lit("mlp").alias("kind"), F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("l1_ratio"), "alpha"))
    return out


def block_scores(df: DataFrame, coef: list[float], intercept: float, blocks: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds score_<block> and decision: the parts of a linear score; they and the intercept add up to the decision value."""
    terms = F.zip_with("features", F.array(*map(F.lit, coef)), lambda x, w: x * w)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = df.withColumn("_terms", terms)
    for name, (i, j) in blocks.items():
        out = out.withColumn(f"score_{name}", add(F.slice("_terms", i + 1, j - i)))
    return out.withColumn("decision", add(F.col("_terms")) + intercept).drop("_terms")


def merge_summaries(roc: DataFrame, pr: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Runs' ROC and PR parts in one row a key, with fixed-test positions beside them."""
    from .joins import outer_merge

    return outer_merge(roc, pr, keys).join(extra, keys, "left")
