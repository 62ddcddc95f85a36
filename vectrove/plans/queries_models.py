"""Queries of clustering, splitting, scaling, models and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import sex_code
from ..operators import clustering as K
from ..operators import heads as H
from ..operators import pooling as P
from ..operators import splits as S
from ..streaming import assign as ST
from .queries_basic import prototypes, scratch
from .registry import query
from .views import Data

REPEATS = 100


def cohort(d: Data) -> DataFrame:
    return d.cohort.withColumn("sex_code", sex_code(F.col("sex"), "m0f1"))


def features(d: Data, pooling: str = "std") -> DataFrame:
    return P.pool(d.tokens, pooling).join(d.cohort.select("patient_id", "label"), "patient_id")


def cluster_shares(d: Data) -> DataFrame:
    """(patient_id, features): cluster histograms as vectors."""
    rows = P.cluster_hist(d.tokens).groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct("cluster", "share"))).alias("s"))
    return rows.select("patient_id", F.col("s.share").alias("features"))


def predictions(d: Data) -> DataFrame:
    """Blended predictions of all repeats, with the cohort of their patients."""
    return d.preds.select("repeat_id", "patient_id", "label", ((F.col("prob_a") + F.col("prob_b")) / 2).alias("prob"))


def doc_cohort(d: Data) -> DataFrame:
    return d.labels.select(F.col("doc_id").alias("patient_id"), F.col("quality").alias("label"), (F.lit(40.0) + F.col("doc_id") % 45).alias("age"), (F.col("doc_id") % 2).cast("double").alias("sex_code"))


UNIT = "ev AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), en AS (SELECT vec_id, sqrt(sum(v * v)) + 1e-8 AS n FROM ev GROUP BY 1), x AS (SELECT vec_id, d, v / n AS v FROM ev JOIN en USING (vec_id))"
ONE_STEP = f"""{UNIT}, st AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat(CAST(vec_id AS VARCHAR), '|42')), vec_id) - 1 AS k FROM embeddings), p0 AS (SELECT k, d, v FROM x JOIN st USING (vec_id) WHERE k < 64),
pn AS (SELECT k, sqrt(sum(v * v)) + 1e-8 AS n FROM p0 GROUP BY 1), p AS (SELECT k, d, v / n AS v FROM p0 JOIN pn USING (k)), s AS (SELECT x.vec_id, p.k, sum(x.v * p.v) AS s FROM x JOIN p USING (d) GROUP BY 1, 2),
a AS (SELECT vec_id, k FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) = 1)"""


@query(f"WITH {ONE_STEP}, m AS (SELECT k, d, avg(v) AS v FROM x JOIN a USING (vec_id) GROUP BY 1, 2), mn AS (SELECT k, sqrt(sum(v * v)) + 1e-8 AS n FROM m GROUP BY 1) SELECT CAST(k AS INTEGER) AS k, d, v / n AS v FROM m JOIN mn USING (k)", "v")
def t01_spherical_kmeans_step(d: Data) -> DataFrame:
    found, _ = K.spherical_kmeans(d.tokens, 64, 1)
    return found.select("k", F.posexplode("centroid").alias("d", "v"))


@query()
def t01_spherical_kmeans(d: Data) -> DataFrame:
    _, assigned = K.spherical_kmeans(d.tokens, 64, 50)
    return assigned.select("token_id", "proto", "similarity")


@query()
def t02_fit_assign(d: Data) -> DataFrame:
    _, assigned = K.fit_assign(d.tokens, d.cohort.where("patient_id % 5 <> 0"), 64, 50)
    return assigned.select("token_id", "proto", "fitted")


E = "e AS (SELECT patient_id, d, stddev_pop(v) AS v FROM (SELECT patient_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM tokens) GROUP BY 1, 2)"


@query(f"WITH {E}, m AS (SELECT d, avg(v) AS m, stddev_pop(v) AS s FROM e WHERE patient_id % 4 <> 0 GROUP BY 1) SELECT patient_id, d, (v - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS v FROM e JOIN m USING (d)", "v")
def t03_standardise(d: Data) -> DataFrame:
    return S.standardise(P.pool(d.tokens, "std"), "patient_id % 4 <> 0").select("patient_id", F.posexplode("features").alias("d", "v"))


@query(f"WITH {E}, m AS (SELECT d, min(v) AS l, max(v) AS h FROM e WHERE patient_id % 4 <> 0 GROUP BY 1) SELECT patient_id, d, CASE WHEN h > l THEN (v - l) / (h - l) ELSE 0 END AS v FROM e JOIN m USING (d)", "v")
def t04_minmax(d: Data) -> DataFrame:
    return S.minmax(P.pool(d.tokens, "std"), "patient_id % 4 <> 0").select("patient_id", F.posexplode("features").alias("d", "v"))


@query(f"""WITH {E}, m AS (SELECT d, avg(v) AS m, stddev_pop(v) AS s FROM e WHERE patient_id % 4 <> 0 GROUP BY 1), g AS (SELECT min(age) AS l, max(age) AS h FROM cohort WHERE patient_id % 4 <> 0)
SELECT patient_id, d, (v - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS v FROM e JOIN m USING (d) UNION ALL SELECT patient_id, 64, (age - l) / (h - l) FROM cohort CROSS JOIN g UNION ALL SELECT patient_id, 65, CASE sex WHEN 'M' THEN 0 ELSE 1 END FROM cohort""", "v")
def t05_append_clinical(d: Data) -> DataFrame:
    rows = P.pool(d.tokens, "std").join(cohort(d), "patient_id")
    return S.append_clinical(rows, "patient_id % 4 <> 0", "A").select("patient_id", F.posexplode("features").alias("d", "v"))


@query("""WITH c AS (SELECT quality AS label, count(*) AS c, sum(count(*)) OVER () AS n FROM labels GROUP BY 1), q AS (SELECT *, ceil(0.2::DOUBLE * n) AS want, ceil(0.2::DOUBLE * n) * c / n AS q FROM c), f AS (SELECT *, floor(q) AS fl, want - sum(floor(q)) OVER () AS rest FROM q),
t AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY fl - q, label) <= rest THEN 1 ELSE 0 END AS take FROM f)
SELECT d.repeat_id, d.patient_id, d.label, d.rn <= t.take AS is_test FROM draws d JOIN t USING (label)""")
def t06_stratified_repeats(d: Data) -> DataFrame:
    return S.stratified_repeats(d.labels.select(F.col("doc_id").alias("patient_id"), F.col("quality").alias("label")), REPEATS)


@query("SELECT doc_id AS patient_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '|42')), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def t07_stratified_folds(d: Data) -> DataFrame:
    rows = d.labels.select(F.col("doc_id").alias("patient_id"), F.col("quality").alias("label"))
    return S.stratified_folds(rows, S.adaptive_folds(rows)).select("patient_id", "fold")


@query("SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 3 = 0 THEN 'train' WHEN c_custkey % 5 = 0 THEN 'val' WHEN c_custkey % 7 = 0 THEN 'test' END AS split FROM customer")
def t08_split_masks(d: Data) -> DataFrame:
    ids = d.customer.select(F.col("c_custkey").alias("patient_id"))
    return S.split_masks(ids, {"train": ids.where("patient_id % 3 = 0"), "val": ids.where("patient_id % 5 = 0"), "test": ids.where("patient_id % 7 = 0")})


def one_head(kind: str, **params):
    def run(d: Data) -> DataFrame:
        rows = H.with_vector(S.standardise(features(d), "patient_id % 4 <> 0"))
        _, score = H.fit_head(rows.where("patient_id % 4 <> 0"), kind, **params)
        return score(rows).select("patient_id", "label", "score")

    return run


for _name, _kind, _params in (
    ("t09_fit_logistic", "logistic_en", {"c": 0.1, "l1_ratio": 0.2}), ("t10_fit_linear_svc", "linear_svc", {"c": 0.1}), ("t11_fit_rbf_svc", "rbf_svc", {}), ("t12_fit_calibrated_svc", "calibrated_svc", {"c": 0.1}), ("t13_fit_mlp", "mlp", {}),
):
    _f = one_head(_kind, **_params)
    _f.__name__ = _name
    query()(_f)


#: The heads of the repeated evaluation, with the settings of its towers; every registered kind.
TOWERS = [("logistic_l2", {"c": 1.0}), ("logistic_en", {"c": 0.1, "l1_ratio": 0.2}), ("linear_svc", {"c": 1.0}), ("rbf_svc", {"c": 1.0, "gamma": "scale"})]
EVERY = [*TOWERS, ("logistic_l1", {"c": 1.0}), ("calibrated_svc", {"c": 0.1}), *(("mlp", {"alpha": a}) for a in (1e-4, 1e-3, 1e-2))]


@query()
def x02_head_registry(d: Data) -> DataFrame:
    rows = features(d).withColumn("target", F.array(F.when(F.expr("patient_id % 4 <> 0"), F.col("label")).otherwise(-1).cast("int")))
    rows = H.grouped.kept(H.with_inner_folds(rows))
    found = H.grouped.scores(rows, H.fit_heads(rows, 1, EVERY), ["patient_id", "label"])
    return found.select("patient_id", F.element_at(F.array(*map(F.lit, H.names_of(EVERY))), F.col("config") + 1).alias("head"), "label", "is_test", "score")


def grid(d: Data) -> list[tuple[str, dict]]:
    """The heads of the 24 settings."""
    return [(r.kind, {k: r[k] for k in ("c", "l1_ratio") if r[k] is not None}) for r in S.head_grid(d.spark).orderBy("kind", "c", "l1_ratio").collect()]


@query("""WITH c AS (SELECT unnest([0.01, 0.1, 1.0, 10.0]::DOUBLE[]) AS c), k AS (SELECT 'logistic_l2' AS kind UNION ALL SELECT 'logistic_l1' UNION ALL SELECT 'linear_svc'), g AS (SELECT kind, c, NULL::DOUBLE AS l1_ratio FROM k CROSS JOIN c UNION ALL SELECT 'logistic_en', c, r FROM c CROSS JOIN (SELECT unnest([0.2, 0.5, 0.8]::DOUBLE[]) AS r))
SELECT g.kind, g.c, g.l1_ratio, s.site, s.n FROM g CROSS JOIN (SELECT site, count(*) AS n FROM scores GROUP BY 1) s""", "c l1_ratio")
def t14_head_grid(d: Data) -> DataFrame:
    return S.head_grid(d.spark).drop("alpha").crossJoin(d.scores.groupBy("site").agg(F.count("*").alias("n")))  # 24 parameter rows by site


@query()
def t15_pca_2d(d: Data) -> DataFrame:
    rows, _ = H.pca_2d(features(d), "patient_id % 4 <> 0")
    return rows.select("patient_id", F.abs("x").alias("x"), F.abs("y").alias("y"))


@query()
def t16_fusion_pca(d: Data) -> DataFrame:
    rows, _ = H.fusion_pca(features(d), P.pool(d.tokens, "mean"), "patient_id % 4 <> 0")
    return rows.select("patient_id", F.abs("x").alias("x"), F.abs("y").alias("y"))


@query()
def t17_oos_predictions(d: Data) -> DataFrame:
    return H.oos_predictions(H.all_predictions(features(d), [("logistic_l2", {"c": 1.0})], REPEATS), "tokens", "std", REPEATS, 0.2, 42)


@query()
def t18_repeated_eval(d: Data) -> DataFrame:
    return H.repeated_eval(H.all_predictions(features(d), TOWERS, REPEATS))


@query()
def t18_cluster_hist_rbf(d: Data) -> DataFrame:
    """Tower 2: cluster histograms and the Gaussian-kernel SVC, over all repeats."""
    rows = cluster_shares(d).join(d.cohort.select("patient_id", "label"), "patient_id")
    return H.repeated_eval(H.all_predictions(rows, [("rbf_svc", {"c": 1.0, "gamma": "scale"})], REPEATS))


@query()
def t18_eval_summary(d: Data) -> DataFrame:
    return H.eval_summary(H.repeated_eval(H.all_predictions(features(d), [("logistic_l2", {"c": 1.0})], REPEATS)))


@query()
def t19_kfold_select(d: Data) -> DataFrame:
    return H.kfold_select(features(d), grid(d), 5)


@query()
def t20_refit_and_test(d: Data) -> DataFrame:
    return H.refit_and_test(features(d), "patient_id % 3 <> 0", "logistic_l2", {"c": 1.0}, 2000)


@query()
def t21_grid_search(d: Data) -> DataFrame:
    best = H.grid_search(features(d), "logistic_l2", [{"c": c} for c in S.C_VALUES], 5)
    rows = H.with_vector(S.standardise(features(d), "true"))
    return H.fit_head(rows, "logistic_l2", **best)[1](rows).select("patient_id", F.lit(best["c"]).alias("c"), "score")


@query()
def t22_clinical_baseline(d: Data) -> DataFrame:
    return H.repeated_eval(H.clinical_baseline(cohort(d), REPEATS))


@query("""WITH p AS (SELECT repeat_id, patient_id, (prob_a + prob_b) / 2 AS prob FROM preds), m AS (SELECT patient_id, avg(prob) AS m FROM p GROUP BY 1)
SELECT r.repeat_id, l.doc_id AS patient_id, p.prob IS NOT NULL AS is_test, coalesce(p.prob, m.m, (SELECT avg(prob) FROM p)) AS stacked FROM labels l CROSS JOIN (SELECT DISTINCT repeat_id FROM p) r LEFT JOIN p ON p.repeat_id = r.repeat_id AND p.patient_id = l.doc_id LEFT JOIN m ON m.patient_id = l.doc_id""", "stacked")
def t23_stack_features(d: Data) -> DataFrame:
    return H.stack_features(predictions(d), doc_cohort(d)).select("repeat_id", "patient_id", "is_test", "stacked")


@query()
def t23_clinical_stack(d: Data) -> DataFrame:
    return H.clinical_stack(predictions(d), doc_cohort(d))


@query()
def t24_clinical_vs_stack(d: Data) -> DataFrame:
    return H.clinical_vs_stack(predictions(d), doc_cohort(d))


@query(f"WITH {E} SELECT patient_id, sum(CASE WHEN d < 32 THEN v * (d % 5 - 2) ELSE 0 END) AS score_mean, sum(CASE WHEN d >= 32 THEN v * (d % 5 - 2) ELSE 0 END) AS score_std, sum(v * (d % 5 - 2)) + 0.5 AS decision FROM e GROUP BY 1", "score_mean score_std decision")
def t25_block_scores(d: Data) -> DataFrame:
    coef = [float(i % 5 - 2) for i in range(64)]
    return S.block_scores(P.pool(d.tokens, "std"), coef, 0.5, {"mean": (0, 32), "std": (32, 64)}).drop("features")


@query()
def t26_coef_table(d: Data) -> DataFrame:
    model, _ = H.fit_logistic(H.with_vector(S.standardise(features(d), "true")))
    return H.coef_table(d.spark, model)


@query()
def t27_pooling_ablation(d: Data) -> DataFrame:
    features = {name: P.pool(d.tokens, name) for name in ("mean", "std", "mean_std")} | {"cluster_hist": cluster_shares(d)}
    return H.pooling_ablation(features, d.cohort, [TOWERS[0], TOWERS[2], TOWERS[3]], REPEATS)


@query()
def t28_coef_repeat_matrix(d: Data) -> DataFrame:
    return H.coef_repeat_matrix(features(d), REPEATS, 0.5, 0.2)


@query()
def t29_batch_from_settings(d: Data) -> DataFrame:
    rows = [(f"{pooling}_{kind}", pooling, kind, p.get("c"), p.get("l1_ratio")) for pooling in ("mean", "std") for kind, p in TOWERS[:3]]
    settings = d.spark.createDataFrame(rows, "tag string, pooling string, model string, c double, l1_ratio double")
    return H.batch_from_settings(settings, {p: P.pool(d.tokens, p) for p in ("mean", "std")}, d.cohort, REPEATS)


@query("""WITH r AS (SELECT c_nationkey AS source, avg(c_acctbal) AS roc_mean FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1), p AS (SELECT s_nationkey AS source, avg(s_acctbal) AS pr_mean FROM supplier GROUP BY 1), x AS (SELECT n_nationkey AS source, n_name AS position FROM nation)
SELECT coalesce(r.source, p.source) AS source, roc_mean, pr_mean, position FROM r FULL JOIN p ON r.source = p.source LEFT JOIN x ON x.source = coalesce(r.source, p.source)""", "roc_mean pr_mean")
def t30_merge_summaries(d: Data) -> DataFrame:
    roc = d.customer.where("c_nationkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("source")).agg(F.avg("c_acctbal").alias("roc_mean"))
    pr = d.supplier.groupBy(F.col("s_nationkey").alias("source")).agg(F.avg("s_acctbal").alias("pr_mean"))
    return S.merge_summaries(roc, pr, d.nation.select(F.col("n_nationkey").alias("source"), F.col("n_name").alias("position")), ["source"])


@query()
def m22_label_shuffle_null(d: Data) -> DataFrame:
    return H.label_shuffle_null(features(d), "patient_id % 3 <> 0", "logistic_l2", {"c": 1.0}, 200)


@query("SELECT regr_slope(score_a / 1000, score_b) AS slope FROM scores", "slope")
def m25_ols_slope(d: Data) -> DataFrame:
    rows = d.scores.select((F.col("score_a") / 1000).alias("score"), F.col("score_b").alias("age"), "label")
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(featuresCol="vector", labelCol="score", solver="normal").fit(H.with_vector(rows.withColumn("f", F.array("age")), "f"))
    return rows.limit(1).select(F.lit(float(model.coefficients[0])).alias("slope"))


@query()
def m25_confounder_models(d: Data) -> DataFrame:
    rows = d.scores.select("label", (F.col("score_a") / 1000).alias("score"), F.col("score_b").alias("age"), (F.col("patient_id") % 2).cast("double").alias("sex_code"), "site")
    return H.confounder_models(rows, "score", "site")


@query("""WITH p AS (SELECT CAST(label AS INTEGER) AS k, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT t.vec_id AS token_id, p.k, list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[]))) + 1e-8) AS s FROM embeddings t CROSS JOIN p JOIN embeddings q ON q.vec_id = p.vec_id)
SELECT token_id, k AS proto, s AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY s DESC, k) = 1""", "similarity")
def st1_assign_stream(d: Data) -> DataFrame:
    source, out = scratch(d, "stream-in"), scratch(d, "stream-out")
    d.tokens.select("token_id", "embedding").write.parquet(source)
    stream = ST.read_token_stream(d.spark, source, d.tokens.select("token_id", "embedding").schema)
    ST.write_assignments(ST.assign_stream(stream, prototypes(d)), out, scratch(d, "stream-state"), once=True).awaitTermination()
    return d.spark.read.parquet(out)
