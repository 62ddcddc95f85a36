"""Queries of pooling, cluster histograms and ordered sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import clean as C
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import pooling as P
from ..operators import sequences as Q
from ..operators.sketches import vector_percentiles
from ..shared import stored
from .queries_basic import PAIRS, PROTOS, RESAMPLED, prototypes
from .registry import query
from .views import Data

E = "e AS (SELECT token_id, patient_id, slice_index, z_mm, mask, cluster_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM tokens)"
RATES = f"""{E}, st AS (SELECT patient_id, d, abs(v - lag(v) OVER w) AS step, abs(z_mm - lag(z_mm) OVER w) AS gap, (z_mm + lag(z_mm) OVER w) / 2 AS mid, min(z_mm) OVER (PARTITION BY patient_id, d) AS low, max(z_mm) OVER (PARTITION BY patient_id, d) AS high FROM e WINDOW w AS (PARTITION BY patient_id, d ORDER BY z_mm, slice_index)),
steps AS (SELECT patient_id, d, step, step / greatest(gap, 1e-3) AS rate, (mid - low) / (high - low) AS m FROM st WHERE step IS NOT NULL)"""
RUNS = "o AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY pos, slice_index) AS i FROM seq), r AS (SELECT *, i - row_number() OVER (PARTITION BY patient_id, cluster_id ORDER BY pos, slice_index) AS island FROM o), runs AS (SELECT patient_id, cluster_id, count(*) AS len FROM r GROUP BY patient_id, cluster_id, island), n AS (SELECT patient_id, count(*) AS n FROM seq GROUP BY 1)"


def spread(df: DataFrame, by: str = "patient_id") -> DataFrame:
    return df.select(by, F.posexplode("features").alias("d", "v"))


@query(f"WITH {E}, f AS (SELECT patient_id, d, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS v FROM e WHERE mask = 1 GROUP BY 1, 2), s AS (SELECT patient_id, sqrt(sum(v * v)) AS score FROM f GROUP BY 1), x AS (SELECT score, label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s JOIN cohort USING (patient_id) WHERE age IS NOT NULL) SELECT count(*) AS n, (sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS roc_auc, sum(score) AS total FROM x", "roc_auc total")
def spread_separates_classes(d: Data) -> DataFrame:
    tokens = C.cohort_gate(C.valid_tokens(d.tokens), d.cohort.select("patient_id", "age", "sex")).select("patient_id", "embedding")
    score = stored(P.pool(tokens, "p90_p10").select("patient_id", A.norm(F.col("features")).alias("score")).join(d.cohort, "patient_id"), "scores")
    return M.roc_auc(score, "score", []).join(score.agg(F.count("*").alias("n"), F.sum("score").alias("total"))).select("n", "roc_auc", "total")


for _id, _name, _sql in (("a01", "mean", "avg(v)"), ("a02", "std", "stddev_pop(v)"), ("a04", "max", "max(v)"), ("a05", "p90_p10", "quantile_cont(v, 0.9) - quantile_cont(v, 0.1)"), ("a06", "iqr", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)")):

    def _pooled(d: Data, name: str = _name) -> DataFrame:
        return spread(P.pool(d.tokens, name))

    _pooled.__name__ = f"{_id}_pool_{_name}"
    query(f"WITH {E} SELECT patient_id, d, {_sql} AS v FROM e GROUP BY 1, 2", "v")(_pooled)


@query(f"WITH {E} SELECT patient_id, d, avg(v) AS v FROM e GROUP BY 1, 2 UNION ALL SELECT patient_id, d + 64, stddev_pop(v) FROM e GROUP BY 1, 2", "v")
def a03_pool_mean_std(d: Data) -> DataFrame:
    return spread(P.pool(d.tokens, "mean_std"))


@query(f"WITH {E}, m AS (SELECT patient_id, d, median(v) AS m FROM e WHERE mask = 1 GROUP BY 1, 2) SELECT patient_id, d, median(abs(v - m)) AS v FROM e JOIN m USING (patient_id, d) WHERE mask = 1 GROUP BY 1, 2", "v")
def a06_pool_mad(d: Data) -> DataFrame:
    return spread(P.pool(P.masked_if_two(d.tokens), "mad"))


@query()
def a05_sketched_by_cluster(d: Data) -> DataFrame:
    """Groups of any size by sketches alone: 90 and 10 % points by dimension, with the bound of their rank error."""
    found = vector_percentiles(d.tokens, [0.9, 0.1], "cluster_id")
    return found.select("cluster_id", "n", "error", F.posexplode(F.arrays_zip(F.get("values", F.lit(0)).alias("p90"), F.get("values", F.lit(1)).alias("p10"))).alias("d", "_p")).select("cluster_id", "d", "n", "error", "_p.p90", "_p.p10")


_HIST = "WITH c AS (SELECT patient_id, cluster_id, count(*) AS n FROM {t} GROUP BY 1, 2), g AS (SELECT DISTINCT patient_id FROM {all}), x AS (SELECT g.patient_id, k.cluster, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.patient_id) AS t FROM g CROSS JOIN (SELECT unnest(range({k})) AS cluster) k LEFT JOIN c ON c.patient_id = g.patient_id AND c.cluster_id = k.cluster) SELECT patient_id, cluster, CASE WHEN t > 0 THEN n / t ELSE 0 END AS share FROM x"


@query(_HIST.format(t="tokens WHERE mask = 1", all="tokens", k=10), "share")
def a07_cluster_hist(d: Data) -> DataFrame:
    return P.cluster_hist(d.tokens)


@query(_HIST.format(t="tokens WHERE mask = 1", all="tokens", k=6) + " WHERE t > 0", "share")
def a07_cluster_hist_smaller_k(d: Data) -> DataFrame:
    return P.cluster_hist(d.tokens, 6)


@query(_HIST.format(t="grid_tokens", all="grid_tokens", k=12), "share")
def a08_cluster_hist_raw(d: Data) -> DataFrame:
    return P.cluster_hist_raw(d.grid_tokens, 12)


@query("SELECT max(cluster_id) + 1 AS k, count(*) AS n FROM tokens")
def a09_infer_k(d: Data) -> DataFrame:
    return d.tokens.agg(F.count("*").alias("n")).select(F.lit(P.infer_k(d.tokens)).cast("long").alias("k"), "n")


@query("""WITH o AS (SELECT patient_id, cluster_id, row_number() OVER (PARTITION BY patient_id ORDER BY pos, slice_index) - 1 AS i, count(*) OVER (PARTITION BY patient_id) AS n FROM seq),
t AS (SELECT patient_id, CASE WHEN i < n // 3 THEN 0 WHEN i < 2 * n // 3 THEN 1 ELSE 2 END * 5 + cluster_id AS cluster FROM o), c AS (SELECT patient_id, cluster, count(*) AS n FROM t GROUP BY 1, 2),
g AS (SELECT p.patient_id, k.cluster, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT patient_id FROM seq) p CROSS JOIN (SELECT unnest(range(15)) AS cluster) k LEFT JOIN c ON c.patient_id = p.patient_id AND c.cluster = k.cluster)
SELECT patient_id, cluster, coalesce(n / nullif(sum(n) OVER (PARTITION BY patient_id, cluster // 5), 0), 0) AS share FROM g""", "share")
def a10_cluster_hist_thirds(d: Data) -> DataFrame:
    return P.cluster_hist_thirds(d.seq, 5, ["pos", "slice_index"])


@query("WITH h AS (SELECT patient_id, count(*) / sum(count(*)) OVER (PARTITION BY patient_id) AS p FROM seq GROUP BY patient_id, cluster_id) SELECT patient_id, sum(-p * ln(p + 1e-8)) AS entropy FROM h GROUP BY 1", "entropy")
def a11_cluster_entropy(d: Data) -> DataFrame:
    return P.cluster_entropy(P.cluster_hist_raw(d.seq, 5))


DOMINANT = "SELECT patient_id, cluster_id AS dominant FROM (SELECT patient_id, cluster_id, count(*) AS n FROM tokens GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY n DESC, cluster_id) = 1"


@query(DOMINANT)
def a12_dominant_cluster(d: Data) -> DataFrame:
    return P.dominant_cluster(d.tokens)


@query(f"WITH dom AS ({DOMINANT}), t AS (SELECT dominant, label, count(*) AS n FROM dom JOIN cohort USING (patient_id) GROUP BY CUBE (dominant, label)), s AS (SELECT dominant, max(n) / sum(n) AS purity FROM t WHERE dominant IS NOT NULL AND label IS NOT NULL GROUP BY 1) SELECT t.dominant, t.label, t.n, s.purity FROM t LEFT JOIN s ON s.dominant = t.dominant", "purity")
def a13_cluster_purity(d: Data) -> DataFrame:
    return P.cluster_purity(P.dominant_cluster(d.tokens), d.cohort.select("patient_id", "label"))


@query(f"WITH {RATES} SELECT patient_id, d, avg(step) AS v FROM steps GROUP BY 1, 2", "v")
def a14_volatility(d: Data) -> DataFrame:
    return spread(Q.volatility(d.tokens))


@query(f"WITH {RATES} SELECT patient_id, d, avg(rate) AS v FROM steps GROUP BY 1, 2", "v")
def a15_volatility_rate(d: Data) -> DataFrame:
    return spread(Q.volatility_rate(d.tokens))


@query(f"WITH {RATES} SELECT patient_id, d, quantile_cont(rate, 0.9) AS v FROM steps GROUP BY 1, 2", "v")
def a16_volatility_rate_p90(d: Data) -> DataFrame:
    return spread(Q.volatility_rate_p90(d.tokens))


@query(f"WITH {RATES}, t AS (SELECT *, CASE WHEN m < 1.0::DOUBLE / 3 THEN 0 WHEN m < 2.0::DOUBLE / 3 THEN 1 ELSE 2 END AS k FROM steps) SELECT patient_id, CAST(k * 64 + d AS INTEGER) AS d, avg(rate) AS v FROM t GROUP BY 1, 2", "v")
def a17_volatility_rate_regions(d: Data) -> DataFrame:
    return spread(Q.volatility_rate_regions(d.tokens)).where("v is not null")


@query(f"WITH {RATES} SELECT patient_id, d, quantile_cont(v, 0.9) - quantile_cont(v, 0.1) AS v FROM e GROUP BY 1, 2 UNION ALL SELECT patient_id, d + 64, avg(rate) FROM steps GROUP BY 1, 2", "v")
def a18_feature_set(d: Data) -> DataFrame:
    return spread(P.feature_set(d.tokens, "p90_p10_vol_mm"))


@query(f"WITH {E}, s AS (SELECT patient_id, cluster_id, d, stddev_pop(v) AS s, count(*) AS n FROM e GROUP BY 1, 2, 3) SELECT patient_id, cluster_id, n, avg(s) AS mean_std, sqrt(sum(s * s)) AS l2_std FROM s WHERE n >= 2 GROUP BY 1, 2, 3", "mean_std l2_std")
def a19_cluster_spread(d: Data) -> DataFrame:
    return P.cluster_spread(d.tokens, 2)


@query(f"WITH {PAIRS} SELECT patient_id, sum(distance) AS total, avg(distance) AS mean, count(*) AS n_pairs FROM pairs GROUP BY 1", "total mean")
def a20_centroid_spread(d: Data) -> DataFrame:
    return P.centroid_spread(J.centroid_pairs(d.tokens, 2))


@query(f"WITH {PAIRS}, m AS (SELECT i, j, avg(distance) FILTER (WHERE label = 0) AS mean_0, count(*) FILTER (WHERE label = 0) AS n_0, avg(distance) FILTER (WHERE label = 1) AS mean_1, count(*) FILTER (WHERE label = 1) AS n_1 FROM pairs JOIN cohort USING (patient_id) GROUP BY 1, 2) SELECT *, mean_1 - mean_0 AS difference FROM m", "mean_0 mean_1 difference")
def a21_mean_pair_matrix(d: Data) -> DataFrame:
    return P.mean_pair_matrix(J.centroid_pairs(d.tokens, 2), d.cohort.select("patient_id", "label"))


@query(f"WITH {E}, s AS (SELECT patient_id, d, stddev_pop(v) AS v FROM e GROUP BY 1, 2), m AS (SELECT d, avg(v) FILTER (WHERE label = 0) AS mean_0, avg(v) FILTER (WHERE label = 1) AS mean_1 FROM s JOIN cohort USING (patient_id) GROUP BY 1) SELECT *, mean_1 - mean_0 AS diff, abs(mean_1 - mean_0) AS abs_diff FROM m", "mean_0 mean_1 diff abs_diff")
def a22_dimwise_class_diff(d: Data) -> DataFrame:
    return P.dimwise_class_diff(P.pool(d.tokens, "std"), d.cohort.select("patient_id", "label"))


@query(f"WITH {E}, s AS (SELECT patient_id, d, stddev_pop(v) AS v FROM e GROUP BY 1, 2) SELECT patient_id, sqrt(sum(v * v)) AS value FROM s GROUP BY 1", "value")
def a23_scalar_spread(d: Data) -> DataFrame:
    return P.scalar_spread(P.pool(d.tokens, "std"), "l2")


@query("SELECT spatial_flat_idx % 4 AS y, spatial_flat_idx // 4 AS x, sum(greatest(w, 0)) AS heat FROM (SELECT *, CAST(embedding[1] AS DOUBLE) AS w FROM grid_tokens) WHERE greatest(w, 0) >= 1e-18 AND slice_index BETWEEN 1 AND 4 GROUP BY 1, 2", "heat")
def a30_grid_heat(d: Data) -> DataFrame:
    return P.grid_heat(A.grid_coords(d.grid_tokens).withColumn("weight", F.col("embedding")[0].cast("double")), relu=True, transpose=True, band=(1, 4))


@query(f"WITH {RESAMPLED}, s AS (SELECT label, g, avg(value) AS mean, 2 * coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS h FROM grid JOIN seq_cohort USING (patient_id) GROUP BY 1, 2) SELECT label, g, mean, mean - h AS low, mean + h AS high FROM s", "mean low high")
def a31_cohort_profile(d: Data) -> DataFrame:
    return P.cohort_profile(J.resample_grid(d.seq, 21), d.seq_cohort, 2.0, "sem")


@query("WITH c AS (SELECT patient_id, cluster_id, count(*) AS n, avg(value) AS m FROM seq GROUP BY 1, 2), w AS (SELECT patient_id, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM seq GROUP BY 1) SELECT w.patient_id, CASE WHEN w.n < 2 OR count(*) < 2 THEN NULL WHEN w.ss <= 1e-300 THEN 0 ELSE least(1, sum(c.n * (c.m - w.m) ** 2) / w.ss) END AS eta FROM c JOIN w USING (patient_id) GROUP BY w.patient_id, w.n, w.ss", "eta")
def a32_eta_squared(d: Data) -> DataFrame:
    return P.eta_squared(d.seq, "value", ["patient_id"])


COEFS = "coefs AS (SELECT repeat_id, patient_id % 40 AS feature, avg(CASE WHEN prob_a > prob_b THEN prob_a - prob_b ELSE 0 END) * (patient_id % 40 % 3) AS coef FROM preds GROUP BY 1, 2)"


def _coefs(d: Data) -> DataFrame:
    f = F.expr("patient_id % 40")
    return d.preds.groupBy("repeat_id", f.alias("feature")).agg(F.avg(F.expr("case when prob_a > prob_b then prob_a - prob_b else 0D end")).alias("c")).select("repeat_id", "feature", (F.col("c") * (F.col("feature") % 3)).alias("coef"))


@query(f"WITH {COEFS}, t AS (SELECT *, CASE WHEN abs(coef) > greatest(1e-9, 1e-15 * max(abs(coef)) OVER (PARTITION BY repeat_id)) THEN 1 ELSE 0 END AS nz FROM coefs), s AS (SELECT feature, avg(nz) AS frequency, avg(coef) AS mean, stddev_pop(coef) AS std, avg(abs(coef)) AS mean_abs FROM t GROUP BY 1) SELECT *, frequency >= 0.8 AS stable FROM s", "frequency mean std mean_abs")
def a33_coef_stability(d: Data) -> DataFrame:
    return P.coef_stability(_coefs(d))


@query(f"WITH {COEFS}, n AS (SELECT repeat_id, count(*) FILTER (WHERE abs(coef) > 1e-9) AS n FROM coefs GROUP BY 1) SELECT avg(n) AS mean, stddev_pop(n) AS std, median(n) AS median, min(n) AS low, max(n) AS high FROM n", "mean std median")
def a34_sparsity_summary(d: Data) -> DataFrame:
    return P.sparsity_summary(_coefs(d))


@query("WITH s AS (SELECT cluster_id, sum(CASE WHEN label = 0 THEN value ELSE 0 END) AS weight_0, sum(CASE WHEN label = 1 THEN value ELSE 0 END) AS weight_1 FROM seq JOIN seq_cohort USING (patient_id) GROUP BY 1) SELECT *, weight_1 - weight_0 AS delta FROM s", "weight_0 weight_1 delta")
def a35_prototype_contribution(d: Data) -> DataFrame:
    return P.prototype_contribution(d.seq, "value", d.seq_cohort)


@query("WITH s AS (SELECT patient_id, cluster_id FROM (SELECT patient_id, cluster_id, sum(value) AS w FROM seq GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY w DESC, cluster_id) <= 2) SELECT slice_index % 3 AS region, count(*) AS n FROM seq JOIN s USING (patient_id, cluster_id) GROUP BY 1")
def a35_prototype_regions(d: Data) -> DataFrame:
    return P.prototype_regions(d.seq.withColumn("region", F.col("slice_index") % 3), "value", "region", 2)


SIMS = f"p AS ({PROTOS}), s AS (SELECT t.vec_id, p.k, list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings t CROSS JOIN p JOIN embeddings q ON q.vec_id = p.vec_id)"


@query(f"WITH {SIMS}, b AS (SELECT vec_id % 25 AS patient_id, 1 - max(s) AS far FROM s GROUP BY vec_id) SELECT patient_id, avg(far) AS mean, median(far) AS median FROM b GROUP BY 1", "mean median")
def a36_prototype_distance(d: Data) -> DataFrame:
    return P.prototype_distance(J.assign_prototypes(d.tokens, prototypes(d)))


@query(f"WITH {SIMS}, c AS (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM p x JOIN p y ON x.k < y.k JOIN embeddings a ON a.vec_id = x.vec_id JOIN embeddings b ON b.vec_id = y.vec_id) SELECT min(s) AS low, max(s) AS high, avg(s) AS mean FROM c", "low high mean")
def a37_prototype_similarity(d: Data) -> DataFrame:
    return P.prototype_similarity(prototypes(d))


@query("SELECT label, slice_index % 50 AS depth, avg(value) AS weight FROM seq JOIN seq_cohort USING (patient_id) GROUP BY 1, 2", "weight")
def a38_depth_profile(d: Data) -> DataFrame:
    return P.depth_profile(d.seq.withColumn("depth", F.col("slice_index") % 50), "value", d.seq_cohort, "depth")


@query("WITH g AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) SELECT count(*) AS missing, coalesce((SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (SELECT k FROM g ORDER BY k LIMIT 5)), '') AS examples FROM g")
def a43_coverage(d: Data) -> DataFrame:
    return P.coverage(d.customer.select(F.col("c_custkey").alias("patient_id")), d.orders.select(F.col("o_custkey").alias("patient_id")))


@query("SELECT patient_id, quantile_cont(value, 0.02) AS low, CASE WHEN quantile_cont(value, 0.98) <= quantile_cont(value, 0.02) THEN quantile_cont(value, 0.02) + 1 ELSE quantile_cont(value, 0.98) END AS high FROM seq GROUP BY 1", "low high")
def a45_percentile_window(d: Data) -> DataFrame:
    return P.percentile_window(d.seq, ["patient_id"], "value", 0.02, 0.98)


# Sequences


@query("SELECT token_id, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY z_mm, slice_index) - 1 AS INTEGER) AS place FROM tokens")
def w01_order_tokens(d: Data) -> DataFrame:
    return Q.order_tokens(d.tokens).select("token_id", "place")


@query("SELECT token_id, (z_mm - min(z_mm) OVER w) / (max(z_mm) OVER w - min(z_mm) OVER w) AS pos_norm FROM tokens WINDOW w AS (PARTITION BY patient_id)", "pos_norm")
def w02_normalised_position(d: Data) -> DataFrame:
    return Q.normalised_position(d.tokens).select("token_id", "pos_norm")


STEPS = "st AS (SELECT patient_id, slice_index, abs(value - lag(value) OVER w) AS step, abs(pos - lag(pos) OVER w) AS gap, (pos + lag(pos) OVER w) / 2 AS mid FROM {t} WINDOW w AS (PARTITION BY patient_id ORDER BY pos, slice_index))"


@query(f"WITH {STEPS.format(t='seq')} SELECT patient_id, slice_index, step, step / greatest(gap, 1e-3) AS rate, mid FROM st WHERE step IS NOT NULL", "step rate mid")
def w03_step_rates(d: Data) -> DataFrame:
    return Q.step_rates(d.seq)


@query(f"WITH {STEPS.format(t='big')} SELECT patient_id, avg(step / greatest(gap, 1e-3)) AS rate FROM st WHERE step IS NOT NULL GROUP BY 1", "rate")
def w03_big_step_rates(d: Data) -> DataFrame:
    return Q.step_rates(d.big).groupBy("patient_id").agg(F.avg("rate").alias("rate"))


@query(f"WITH {RUNS} SELECT n.patient_id, k.cluster, coalesce(max(r.len), 0) / n.n AS longest, coalesce(avg(r.len), 0) / n.n AS mean, CASE WHEN coalesce(max(r.len), 0) >= 3 THEN 1 ELSE 0 END AS flag FROM n CROSS JOIN (SELECT unnest(range(5)) AS cluster) k LEFT JOIN runs r ON r.patient_id = n.patient_id AND r.cluster_id = k.cluster GROUP BY n.patient_id, k.cluster, n.n", "longest mean")
def w04_run_lengths(d: Data) -> DataFrame:
    return Q.run_lengths(d.seq, 5, 3)


WEIGHTS = "SELECT patient_id, slice_index, pos, value / sum(value) OVER (PARTITION BY patient_id) AS weight FROM seq"


def weights(d: Data) -> DataFrame:
    from pyspark.sql import Window

    return d.seq.select("patient_id", "slice_index", "pos", (F.col("value") / F.sum("value").over(Window.partitionBy("patient_id"))).alias("weight"))


@query(f"WITH w AS ({WEIGHTS}), h AS (SELECT *, weight >= greatest(0.1, 1.0::DOUBLE / count(*) OVER (PARTITION BY patient_id)) AS high FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY pos, slice_index) - row_number() OVER (PARTITION BY patient_id, high ORDER BY pos, slice_index) AS island FROM h), n AS (SELECT patient_id, high, count(*) AS len FROM r GROUP BY patient_id, high, island) SELECT patient_id, max(CASE WHEN high THEN len ELSE 0 END) AS longest FROM n GROUP BY 1")
def w05_longest_run(d: Data) -> DataFrame:
    return Q.longest_run(weights(d))


@query("SELECT patient_id, slice_index, value - lag(value) OVER (PARTITION BY patient_id ORDER BY pos, slice_index) AS difference FROM seq QUALIFY difference IS NOT NULL", "difference")
def w06_first_difference(d: Data) -> DataFrame:
    return Q.first_difference(d.seq).select("patient_id", "slice_index", "difference")


@query(f"WITH {E}, p AS (SELECT patient_id, d, v, row_number() OVER (PARTITION BY patient_id, d ORDER BY z_mm, slice_index) - 1 AS i, count(*) OVER (PARTITION BY patient_id, d) AS n FROM e) SELECT patient_id, d, i / greatest(1, n - 1) AS peak FROM p QUALIFY row_number() OVER (PARTITION BY patient_id, d ORDER BY abs(v) DESC, i) = 1", "peak")
def w07_relative_peak(d: Data) -> DataFrame:
    rows = d.tokens.select("patient_id", "z_mm", "slice_index", F.posexplode(A.doubles(F.col("embedding"))).alias("d", "v"))
    return Q.relative_peak(rows, ["patient_id", "d"], ["z_mm", "slice_index"])


@query(f"WITH w AS ({WEIGHTS}), s AS (SELECT patient_id, sum(weight) OVER o AS s, row_number() OVER o AS i FROM w WINDOW o AS (PARTITION BY patient_id ORDER BY weight DESC, slice_index)) SELECT patient_id, coalesce(min(i) FILTER (WHERE s >= 0.7), count(*)) AS n FROM s GROUP BY 1")
def w08_mass_to_reach(d: Data) -> DataFrame:
    return Q.mass_to_reach(weights(d), 0.7)


@query("""WITH o AS (SELECT patient_id, CAST(embedding AS DOUBLE[]) AS p, lag(CAST(embedding AS DOUBLE[])) OVER w AS lp, list_reverse(CAST(embedding AS DOUBLE[]))[:32] AS q, lag(list_reverse(CAST(embedding AS DOUBLE[]))[:32]) OVER w AS lq FROM tokens WINDOW w AS (PARTITION BY patient_id ORDER BY z_mm, slice_index)),
c AS (SELECT patient_id, list_avg(list_transform(list_zip(p, lp), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS p, list_avg(list_transform(list_zip(q, lq), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS q FROM o WHERE lp IS NOT NULL)
SELECT patient_id, corr(p, q) AS correlation, avg(abs(p - q)) AS mae FROM c GROUP BY 1""", "correlation mae")
def w09_adjacent_delta_similarity(d: Data) -> DataFrame:
    rows = d.tokens.withColumn("right", F.slice(F.reverse("embedding"), 1, 32))
    return Q.adjacent_delta_similarity(rows, "patient_id", ("z_mm", "slice_index"), "embedding", "right")


@query("SELECT patient_id, (score_a - avg(score_a) OVER w) / greatest(stddev_pop(score_a) OVER w, 1e-6) AS z FROM scores WINDOW w AS (PARTITION BY site)", "z")
def w10_zscore_within(d: Data) -> DataFrame:
    return Q.zscore_within(d.scores, ["site"], "score_a").select("patient_id", "z")


@query("WITH r AS (SELECT repeat_id, avg(prob_a) AS v FROM preds GROUP BY 1) SELECT p.repeat_id, avg(CASE WHEN p.prob_a <= r.v THEN 1.0 ELSE 0.0 END) AS position FROM preds p JOIN r USING (repeat_id) GROUP BY 1", "position")
def w11_cdf_position(d: Data) -> DataFrame:
    return Q.cdf_position(d.preds.groupBy("repeat_id").agg(F.avg("prob_a").alias("prob_a")), d.preds, "repeat_id", "prob_a")


@query("WITH x AS (SELECT repeat_id, patient_id, prob_b * count(*) OVER (PARTITION BY repeat_id) / row_number() OVER (PARTITION BY repeat_id ORDER BY prob_b, patient_id) AS raw, row_number() OVER (PARTITION BY repeat_id ORDER BY prob_b, patient_id) AS i FROM preds) SELECT repeat_id, patient_id, least(1, min(raw) OVER (PARTITION BY repeat_id ORDER BY i DESC)) AS q FROM x", "q")
def w12_bh_fdr(d: Data) -> DataFrame:
    return Q.bh_fdr(d.preds, "prob_b", ["repeat_id"], "patient_id").select("repeat_id", "patient_id", "q")


@query("SELECT patient_id, rank() OVER (PARTITION BY site ORDER BY score_b) + (count(*) OVER (PARTITION BY site, score_b) - 1) / 2.0::DOUBLE AS r FROM scores", "r")
def w13_average_rank(d: Data) -> DataFrame:
    return d.scores.select("patient_id", Q.average_rank("score_b", ["site"]).alias("r"))


@query(f"WITH w AS ({WEIGHTS}), r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY weight DESC, slice_index) AS i FROM w) SELECT patient_id, sum(-weight * ln(weight + 1e-12)) AS entropy, 1 / sum(weight * weight) AS effective, max(weight) AS top1, sum(CASE WHEN i <= 5 THEN weight ELSE 0 END) AS topk FROM r GROUP BY 1", "entropy effective top1 topk")
def w14_attention_concentration(d: Data) -> DataFrame:
    return Q.attention_concentration(weights(d), 5)
