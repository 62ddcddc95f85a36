"""Classifier heads, repeated evaluation, selection and stacking.

Heads of all splits and settings are fitted together, linear ones in grouped, Gaussian and calibrated SVCs in kernels,
perceptrons in perceptron. Matrices stay distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grouped, kernels, perceptron
from .metrics import best_per_group, both_areas, cv_summary, nan_summary, roc_auc, summary_stats
from .ranks import numbered
from .splits import standardise, stratified_folds, stratified_repeats

#: Most levels of a site in the confounder models.
SITES = 500


def with_vector(df: DataFrame, column: str = "features") -> DataFrame:
    return df.withColumn("vector", array_to_vector(F.col(column)))


def with_inner_folds(df: DataFrame, key: str = "patient_id", label: str = "label") -> DataFrame:
    """Adds fold, from which heads take the rows that they leave out of their own training rows."""
    return stratified_folds(df, kernels.FOLD, 7, key, label)


@dataclass
class Together:
    """Fits of heads of any kinds: per family, its places among the heads."""

    heads: list[tuple[str, dict]]
    parts: list[tuple[list[int], object]]

    def score(self, r: int, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.heads)))
        for places, fits in self.parts:
            out[:, places] = fits.score(r, x)
        return out


def fit_heads(rows: DataFrame, splits: int, heads: list[tuple[str, dict]], scale: str | None = "standard") -> Together:
    """Fit heads of any registered kinds on every split; rows as in grouped.fit, with a fold for kinds that are not linear."""
    for kind, _ in heads:
        if kind not in HEADS:
            raise ValueError(f"unknown head: {kind}")
    parts, families = [], {"calibrated_svc": lambda h: kernels.fit_calibrated(rows, splits, "calibrated_svc", h, scale), "rbf_svc": lambda h: kernels.fit_calibrated(rows, splits, "rbf_svc", h, scale), "mlp": lambda h: perceptron.fit(rows, splits, h, scale)}
    family = lambda kind: "linear" if kind in grouped.LINEAR else kind
    for name in dict.fromkeys(family(kind) for kind, _ in heads):
        places = [i for i, (kind, _) in enumerate(heads) if family(kind) == name]
        mine = [heads[i] for i in places]
        parts.append((places, grouped.fit(rows, splits, mine, scale) if name == "linear" else families[name](mine)))
    return Together(heads, parts)


@dataclass
class Linear:
    """Coefficients and intercept of a fitted linear head."""

    coefficients: np.ndarray
    intercept: float

    def decision(self, features: Column) -> Column:
        weighted = F.zip_with(features, F.array(*map(F.lit, map(float, self.coefficients))), lambda x, w: x * w)
        return F.aggregate(weighted, F.lit(float(self.intercept)), lambda a, x: a + x)


def fit_linear(train: DataFrame, kind: str, params: dict) -> Linear:
    """A linear head on all rows as they are."""
    rows = grouped.kept(train.select(vector_to_array("vector").alias("features"), F.array(F.col("label").cast("int")).alias("target")))
    found = grouped.fit(rows, 1, [(kind, params)], None)
    return Linear(found.coef[0, 0], float(found.intercept[0, 0]))


def fit_logistic(train: DataFrame, penalty: str = "l2", c: float = 1.0, l1_ratio: float = 0.0):
    """(model, score function) of a balanced logistic. penalty: l2, l1 or en."""
    model = fit_linear(train, f"logistic_{penalty}", {"c": c, "l1_ratio": l1_ratio})
    return model, lambda df: df.withColumn("score", 1 / (1 + F.exp(-model.decision(vector_to_array("vector")))))


def fit_linear_svc(train: DataFrame, c: float = 1.0):
    """Balanced linear SVC (squared hinge, at its minimum); the score is the decision value."""
    model = fit_linear(train, "linear_svc", {"c": c})
    return model, lambda df: df.withColumn("score", model.decision(vector_to_array("vector")))


def fit_nonlinear(train: DataFrame, kind: str, params: dict, key: str = "patient_id"):
    """(fits, score function) of one head on all rows as they are; rows need a key, by whose md5 inner folds are dealt out."""
    if key not in train.columns:
        raise ValueError(f"{kind} needs a {key}")
    rows = train.select(key, F.col("label").cast("int").alias("label"), vector_to_array("vector").alias("features"))
    rows = with_inner_folds(rows, key).select("features", "fold", F.array("label").alias("target"))
    found = fit_heads(grouped.kept(rows), 1, [(kind, params)], None)

    def rate(v):
        return pd.Series(found.score(0, np.stack(v.to_numpy()))[:, 0] if len(v) else [], dtype=float)

    rate.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return found, lambda df: df.withColumn("score", F.pandas_udf(rate, "double")(vector_to_array("vector")))


def fit_rbf_svc(train: DataFrame, c: float = 1.0, gamma: str | float = "scale"):
    """A Gaussian-kernel SVC, with a sigmoid for probabilities."""
    return fit_nonlinear(train, "rbf_svc", {"c": c, "gamma": gamma})


def fit_calibrated_svc(train: DataFrame, c: float = 1.0):
    """A linear SVC per fold, sigmoids fitted on scores of rows left out, their mean as probability."""
    return fit_nonlinear(train, "calibrated_svc", {"c": c})


def fit_mlp(train: DataFrame, hidden: int = 16, alpha: float = 1e-4):
    """One hidden ReLU layer, with early stopping."""
    return fit_nonlinear(train, "mlp", {"hidden": hidden, "alpha": alpha})


#: Kind of a head to its fit function of (training rows, parameters).
HEADS: dict[str, Callable] = {
    "logistic_l2": lambda t, p: fit_logistic(t, "l2", p.get("c", 1.0)),
    "logistic_l1": lambda t, p: fit_logistic(t, "l1", p.get("c", 1.0)),
    "logistic_en": lambda t, p: fit_logistic(t, "en", p.get("c", 1.0), p.get("l1_ratio", 0.5)),
    "linear_svc": lambda t, p: fit_linear_svc(t, p.get("c", 1.0)),
    "rbf_svc": lambda t, p: fit_rbf_svc(t, p.get("c", 1.0), p.get("gamma", "scale")),
    "calibrated_svc": lambda t, p: fit_calibrated_svc(t, p.get("c", 1.0)),
    "mlp": lambda t, p: fit_mlp(t, p.get("hidden", 16), p.get("alpha", 1e-4)),
}


def fit_head(train: DataFrame, kind: str, **params):
    if kind not in HEADS:
        raise ValueError(f"unknown head: {kind}")
    return HEADS[kind](train, params)


def pca_2d(df: DataFrame, flag: str) -> tuple[DataFrame, list[float]]:
    """Scale and project on training rows, transform all: rows with x, y, and the explained variance ratios."""
    scaled = with_vector(standardise(df, flag))
    model = PCA(k=2, inputCol="vector", outputCol="_p").fit(scaled.where(flag))
    out = model.transform(scaled).withColumn("_a", vector_to_array("_p")).withColumns({"x": F.col("_a")[0], "y": F.col("_a")[1]})
    return out.drop("_p", "_a", "vector"), [float(x) for x in model.explainedVariance]


def fusion_pca(a: DataFrame, b: DataFrame, flag: str, key: str = "patient_id") -> tuple[DataFrame, list[float]]:
    """Each block scaled on its training rows, side by side, then projected."""
    left, right = standardise(a, flag), standardise(b, flag).select(key, F.col("features").alias("_b"))
    return pca_2d(left.join(right, key).withColumn("features", F.concat("features", "_b")).drop("_b"), flag)


def _named(heads: list[tuple[str, dict]]) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k, _ in heads)), F.col("config") + 1)


def all_predictions(df: DataFrame, heads: list[tuple[str, dict]], n: int, test: float = 0.2, seed: int = 42, scale: bool = True, key: str = "patient_id") -> DataFrame:
    """Training and test scores of each repeat and head: (repeat_id, model, key, label, is_test, prob_tts)."""
    df = grouped.kept(df.select(key, "label", "features"))  # folds, repeats and rows each read it
    rows = grouped.kept(grouped.by_tests(_for(df, heads, key), stratified_repeats(df, n, test, seed, key), key))
    found = grouped.scores(rows, fit_heads(rows, n, heads, "standard" if scale else None), [key, "label"])
    return found.select("repeat_id", _named(heads).alias("model"), key, "label", "is_test", F.col("score").alias("prob_tts"))


def _for(df: DataFrame, heads: list[tuple[str, dict]], key: str) -> DataFrame:
    """The rows with inner folds, where a head needs them."""
    return df if all(kind in grouped.LINEAR for kind, _ in heads) else with_inner_folds(df, key)


def names_of(heads: list[tuple[str, dict]]) -> list[str]:
    """A name for each head from its kind and parameters."""
    return [kind + "".join(f"_{a}{b:g}" if isinstance(b, float) else f"_{a}{b}" for a, b in params.items()) for kind, params in heads]


def oos_predictions(scored: DataFrame, source: str, pooling: str, n: int, test: float, seed: int, clinical: bool = False) -> DataFrame:
    """Test rows with the protocol columns."""
    protocol = {"latent_source": source, "pooling": pooling, "n_splits": n, "test_size": test, "split_random_state": seed, "concat_age_sex": clinical}
    return scored.where("is_test").drop("is_test").select(*(F.lit(v).alias(k) for k, v in protocol.items()), "*")


def repeated_eval(scored: DataFrame, key: str = "patient_id") -> DataFrame:
    """Per repeat and model: test and training areas, sizes and test ids."""
    scored = grouped.kept(scored)  # read five times
    by = ["repeat_id", "model"]
    test, train = scored.where("is_test"), scored.where("not is_test")
    a = both_areas(test, "prob_tts", by)
    b = both_areas(train, "prob_tts", by).withColumnsRenamed({"roc_auc": "train_roc_auc", "pr_auc": "train_pr_auc"})
    ids = test.groupBy(*by).agg(F.count("*").alias("test_size"), F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ";").alias("test_patient_ids"))
    return a.join(b, by).join(train.groupBy(*by).agg(F.count("*").alias("train_size")), by).join(ids, by)


def eval_summary(repeats: DataFrame) -> DataFrame:
    return summary_stats(repeats, ["model"])


def kfold_scores(df: DataFrame, heads: list[tuple[str, dict]], k: int = 5, key: str = "patient_id") -> DataFrame:
    """(model, config, fold, roc_auc) of stratified folds; each fold is a split of one grouped fit."""
    df = grouped.kept(df.select(key, "label", "features"))
    folds = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.when(f == F.col("fold"), -1).otherwise(F.col("label")).cast("int"))
    rows = stratified_folds(df, k, key=key).select(key, "label", "features", folds.alias("target"))
    rows = grouped.kept(_for(rows, heads, key))
    found = grouped.scores(rows, fit_heads(rows, k, heads), ["label"]).where("is_test").withColumnRenamed("repeat_id", "fold")
    areas = roc_auc(found, "score", ["config", "fold"])
    return areas.select(F.element_at(F.array(*map(F.lit, names_of(heads))), F.col("config") + 1).alias("model"), "config", "fold", "roc_auc")


def kfold_select(df: DataFrame, heads: list[tuple[str, dict]], k: int = 5, key: str = "patient_id") -> DataFrame:
    """Configurations by mean of the folds, with the best flagged."""
    s = cv_summary(kfold_scores(df, heads, k, key).where("not isnan(roc_auc)"), ["model", "config"], "roc_auc")
    return s.withColumn("best", F.row_number().over(Window.orderBy(F.col("mean").desc(), "config")) == 1)


def refit_and_test(df: DataFrame, flag: str, kind: str, params: dict, n: int = 100, seed: int = 7, key: str = "patient_id", weighted: bool = False) -> DataFrame:
    """Fit on the flagged rows, test once on the others, with a bootstrap interval, by weights if `weighted`."""
    from .tests_of_hypotheses import bootstrap_metric, weighted_bootstrap_metric

    rows = with_vector(standardise(df, flag))
    _, score = fit_head(rows.where(flag), kind, **params)
    test = grouped.kept(score(rows.where(f"not ({flag})")).select(key, "label", "score"))
    return both_areas(test, "score", []).join((weighted_bootstrap_metric if weighted else bootstrap_metric)(test, "score", key, n, seed))


def grid_search(df: DataFrame, kind: str, grid: list[dict], k: int = 3, key: str = "patient_id") -> dict:
    """The parameters of the best mean area over inner folds."""
    best = kfold_select(df, [(kind, p) for p in grid], k, key).where("best").select("config").first()
    return grid[best.config]


def clinical_baseline(cohort: DataFrame, n: int, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Repeated evaluation of min-max age and sex by a balanced logistic."""
    df = grouped.kept(cohort.select("patient_id", "label", F.array("age", "sex_code").alias("features")))
    return _clinical(grouped.kept(grouped.by_tests(df, stratified_repeats(df, n, test, seed))), n, "clinical")


def _clinical(rows: DataFrame, n: int, name: str, only: str = "true") -> DataFrame:
    """A balanced logistic on min-max features of each split, and scores of the rows of a condition; a split with one class in training has NaN scores. Every pass reads the rows."""
    found = grouped.scores(rows.where(only), grouped.fit(rows, n, [("logistic_l2", {"c": 1.0})], "minmax"), ["patient_id", "label"])
    return found.select("repeat_id", F.lit(name).alias("model"), "patient_id", "label", "is_test", F.col("score").alias("prob_tts"))


def stack_features(preds: DataFrame, cohort: DataFrame, blend: str = "prob") -> DataFrame:
    """(repeat_id, patient_id, label, age, sex_code, is_test, stacked): a test row's own blend of the split; a training row's mean
    blend over the splits in which it was tested, else the mean of all."""
    preds = grouped.kept(preds.select("repeat_id", "patient_id", blend))  # read four times
    whole = preds.agg(F.avg(blend).alias("_all"))
    mean = preds.groupBy("patient_id").agg(F.avg(blend).alias("_mean"))
    splits = preds.select("repeat_id").distinct()
    own = preds.select("repeat_id", "patient_id", F.col(blend).alias("_own"))
    rows = cohort.join(splits).join(own, ["repeat_id", "patient_id"], "left").join(mean, "patient_id", "left").join(F.broadcast(whole))  # one row
    return rows.select("repeat_id", "patient_id", "label", "age", "sex_code", F.col("_own").isNotNull().alias("is_test"), F.coalesce("_own", "_mean", "_all").alias("stacked"))


def _stack_rows(preds: DataFrame, cohort: DataFrame, blend: str) -> DataFrame:
    """Stored rows of stack_features; a task has a split's rows one after the other, so that a batch meets few splits."""
    return grouped.kept(stack_features(preds, cohort, blend).sortWithinPartitions("repeat_id"))


def _stacked(rows: DataFrame, names: list[str], name: str, only: str = "true") -> DataFrame:
    n = rows.agg(F.max("repeat_id")).first()[0] + 1
    target = F.array(F.when(F.col("is_test"), -1).otherwise(F.col("label")).cast("int"))
    return _clinical(rows.select(F.col("repeat_id").cast("int").alias("repeat_id"), "patient_id", "label", F.array(*names).alias("features"), target.alias("target")), n, name, only)


def clinical_stack(preds: DataFrame, cohort: DataFrame, blend: str = "prob") -> DataFrame:
    """Per split a balanced logistic on min-max stacked score, min-max age and sex."""
    return _stacked(_stack_rows(preds, cohort, blend), ["stacked", "age", "sex_code"], "stack")


def clinical_vs_stack(preds: DataFrame, cohort: DataFrame, blend: str = "prob") -> DataFrame:
    """Per split: areas of clinical alone and of the stack on the same rows, and their differences."""
    rows = _stack_rows(preds, cohort, blend)
    stack, alone = (_stacked(rows, names, name, "target[0] < 0") for names, name in ((["stacked", "age", "sex_code"], "stack"), (["age", "sex_code"], "clinical")))  # test rows
    area = lambda df, s: both_areas(df, "prob_tts", ["repeat_id"]).withColumnsRenamed({"roc_auc": f"roc_{s}", "pr_auc": f"pr_{s}"})
    return area(alone, "clinical").join(area(stack, "stack"), "repeat_id").withColumns({"delta_roc": F.col("roc_stack") - F.col("roc_clinical"), "delta_pr": F.col("pr_stack") - F.col("pr_clinical")})


def coef_table(spark, model) -> DataFrame:
    """(d, coef, abs_coef), largest first."""
    rows = [(i, float(x), abs(float(x))) for i, x in enumerate(model.coefficients)]
    return spark.createDataFrame(rows, "d int, coef double, abs_coef double").orderBy(F.col("abs_coef").desc(), "d")


def coef_repeat_matrix(df: DataFrame, n: int, c: float, l1_ratio: float, seed: int = 42) -> DataFrame:
    """(repeat_id, feature, coef) of an elastic net per repeat."""
    df = grouped.kept(df.select("patient_id", "label", "features"))
    rows = grouped.kept(grouped.by_tests(df, stratified_repeats(df, n, 0.2, seed)))
    found = grouped.fit(rows, n, [("logistic_en", {"c": c, "l1_ratio": l1_ratio})]).coef[:, 0]
    return df.sparkSession.createDataFrame([(r, i, float(x)) for r, each in enumerate(found) for i, x in enumerate(each)], "repeat_id int, feature int, coef double")


def pooling_ablation(features: dict[str, DataFrame], cohort: DataFrame, heads: list[tuple[str, dict]], n: int = 100) -> DataFrame:
    """(pooling, model, statistics) of each pooling and head."""
    parts, cohort = [], grouped.kept(cohort.select("patient_id", "label"))
    for name, f in features.items():
        scored = all_predictions(f.join(cohort.select("patient_id", "label"), "patient_id"), heads, n)
        parts.append(nan_summary(repeated_eval(scored), ["model"]).withColumn("pooling", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def batch_from_settings(settings: DataFrame, features: dict[str, DataFrame], cohort: DataFrame, n: int, most: int = 10_000) -> DataFrame:
    """Run each (tag, pooling, model, parameters) row of a settings table, at most `most` rows, under its own tag.

    Parameters are the columns c, l1_ratio, gamma, alpha and hidden, as far as there are such; nulls take a head's default. The
    settings of a pooling are fitted together; an unknown pooling or model is an error.
    """
    found = settings.orderBy("tag").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} settings")
    parts = []
    for pooling in dict.fromkeys(s.pooling for s in found):
        mine = [s for s in found if s.pooling == pooling]
        f = grouped.kept(features[pooling].join(cohort.select("patient_id", "label"), "patient_id").select("patient_id", "label", "features"))
        heads = [(s.model, {p: s[p] for p in ("c", "l1_ratio", "gamma", "alpha", "hidden") if p in settings.columns and s[p] is not None}) for s in mine]
        rows = grouped.kept(grouped.by_tests(_for(f.select("patient_id", "label", "features"), heads, "patient_id"), stratified_repeats(f, n)))
        scored = grouped.scores(rows, fit_heads(rows, n, heads), ["patient_id", "label"]).withColumnsRenamed({"config": "model", "score": "prob_tts"})
        tag, model = (F.element_at(F.array(*(F.lit(x) for x in xs)), F.col("model") + 1) for xs in ([s.tag for s in mine], [s.model for s in mine]))
        parts.append(repeated_eval(scored).select(tag.alias("tag"), "repeat_id", model.alias("model"), "roc_auc", "pr_auc"))
    return reduce(DataFrame.unionByName, parts)


def best_of_sources(summary: DataFrame, by: str, tie: str) -> DataFrame:
    return best_per_group(summary, by, "roc_mean", "pr_mean", tie)


def label_shuffle_null(df: DataFrame, flag: str, kind: str, params: dict, n: int, seed: int = 42, key: str = "patient_id") -> DataFrame:
    """(true_auc, n, p): test area against those of refits on permuted training labels; all refits are one grouped fit."""
    df = grouped.kept(df)
    train = numbered(df.where(flag).select(key, "label"), key, "_i")
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("replicate").cast("string"), F.lit(str(seed))))
    drawn = train.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = drawn.select("replicate", "label", (F.row_number().over(Window.partitionBy("replicate").orderBy(order, key)) - 1).alias("_i"))
    lists = drawn.groupBy("_i").agg(F.transform(F.sort_array(F.collect_list(F.struct("replicate", "label"))), lambda x: x.label.cast("int")).alias("_l"))
    targets = train.join(lists, "_i").select(key, F.concat(F.array(F.col("label").cast("int")), "_l").alias("target"))
    rows = _for(df.select(key, "label", "features"), [(kind, params)], key).join(targets, key, "left").withColumn("target", F.coalesce("target", F.array_repeat(F.lit(-1), n + 1)))
    rows = grouped.kept(rows)
    found = roc_auc(grouped.scores(rows, fit_heads(rows, n + 1, [(kind, params)]), ["label"]).where("is_test"), "score", ["repeat_id"])
    true = found.where("repeat_id = 0").select(F.col("roc_auc").alias("true_auc"))
    return found.where("repeat_id > 0").join(F.broadcast(true)).groupBy("true_auc").agg(F.count("*").cast("int").alias("n"), F.avg((F.col("roc_auc") >= F.col("true_auc")).cast("double")).alias("p"))  # one row


def confounder_models(df: DataFrame, score: str = "score", site: str | None = None) -> DataFrame:
    """(model, term, coef, p, odds_ratio) of score ~ age + sex (+ site) by least squares, and label ~ score + age + sex (+ site)."""
    spark, rows, extra = df.sparkSession, df, []
    if site:
        levels = [r[0] for r in df.select(site).distinct().orderBy(site).limit(SITES + 1).collect()][1:]
        if len(levels) >= SITES:
            raise ValueError(f"more than {SITES} sites")
        for v in levels:
            rows = rows.withColumn(f"site_{v}", (F.col(site) == v).cast("double"))
        extra = [f"site_{v}" for v in levels]
    linear, logit = ["age", "sex_code", *extra], [score, "age", "sex_code", *extra]
    lm = LinearRegression(featuresCol="vector", labelCol=score, solver="normal").fit(with_vector(rows.withColumn("_f", F.array(*linear)), "_f"))
    gm = GeneralizedLinearRegression(featuresCol="vector", labelCol="label", family="binomial", regParam=0.0).fit(with_vector(rows.withColumn("_f", F.array(*logit)), "_f"))
    out = []
    for name, terms, model in (("linear", linear, lm), ("logistic", logit, gm)):
        try:
            p = list(model.summary.pValues)
        except Exception:  # noqa: BLE001  a singular fit has no p-values
            p = [None] * (len(terms) + 1)
        for t, c, q in zip([*terms, "intercept"], [*model.coefficients.toArray(), model.intercept], p):
            out.append((name, t, float(c), None if q is None else float(q), math.exp(min(700.0, float(c))) if name == "logistic" else None))
    return spark.createDataFrame(out, "model string, term string, coef double, p double, odds_ratio double")


