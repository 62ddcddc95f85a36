"""Queries of ranking metrics, summaries, top rows, resampling and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import pooling as P
from ..operators import replicates as R
from ..operators import sequences as Q
from ..operators import tests_of_hypotheses as H
from .registry import query
from .views import Data


def auc_sql(source: str, score: str, by: str) -> str:
    """CTE auc(by, roc_auc) by ranks."""
    part, group = f"PARTITION BY {by}" if by else "", f"GROUP BY {by}" if by else ""
    tie = f"PARTITION BY {by}, {score}" if by else f"PARTITION BY {score}"
    comma = f"{by}, " if by else ""
    return f"rk AS (SELECT {comma}label, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE AS r FROM {source}), auc AS (SELECT {comma}(sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label)) AS roc_auc FROM rk {group})"


def ap_sql(source: str, score: str, by: str) -> str:
    """CTE ap(by, pr_auc), and cv with the counts at each threshold."""
    part, comma = f"PARTITION BY {by}" if by else "", f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""tg AS (SELECT {comma}{score} AS s, sum(label) AS pos, count(*) AS n FROM {source} GROUP BY {comma}{score}),
cv AS (SELECT {comma}s, pos, sum(pos) OVER ({part} ORDER BY s DESC) AS tp, sum(n - pos) OVER ({part} ORDER BY s DESC) AS fp, sum(pos) OVER ({part}) AS p, sum(n - pos) OVER ({part}) AS q FROM tg),
ap AS (SELECT {comma}sum(pos / p * tp / (tp + fp)) AS pr_auc FROM cv {group})"""


SPLITS = f"{auc_sql('preds', 'prob_a', 'repeat_id')}, {ap_sql('preds', 'prob_a', 'repeat_id')}, splits AS (SELECT * FROM auc JOIN ap USING (repeat_id))"


def splits(d: Data, score: str = "prob_a") -> DataFrame:
    return M.both_areas(d.preds, score, ["repeat_id"])


@query(f"WITH {auc_sql('scores', 'score_b', 'site')} SELECT * FROM auc", "roc_auc")
def m01_roc_auc(d: Data) -> DataFrame:
    return M.roc_auc(d.scores, "score_b", ["site"])


@query(f"WITH {auc_sql('big', 'score_a', '')} SELECT * FROM auc", "roc_auc")
def m01_big_roc_auc(d: Data) -> DataFrame:
    return M.roc_auc(d.big, "score_a", [])


@query(f"WITH {auc_sql('big', 'value', '')} SELECT * FROM auc", "roc_auc")
def m01_big_roc_auc_of_prices(d: Data) -> DataFrame:
    return M.roc_auc(d.big, "value", [])


@query(f"WITH {ap_sql('scores', 'score_b', 'site')} SELECT * FROM ap", "pr_auc")
def m02_average_precision(d: Data) -> DataFrame:
    return M.average_precision(d.scores, "score_b", ["site"])


@query("""WITH r AS (SELECT site, label, row_number() OVER o AS i, sum(label) OVER (o ROWS UNBOUNDED PRECEDING) AS tp, sum(label) OVER w AS p, count(*) OVER w AS n, score_b, patient_id FROM scores WINDOW w AS (PARTITION BY site), o AS (PARTITION BY site ORDER BY score_b DESC, patient_id)),
x AS (SELECT site, i, tp / nullif(p, 0) AS tpr, (i - tp) / nullif(n - p, 0) AS fpr, tp / i AS prec FROM r), t AS (SELECT site, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a, (tpr - lag(tpr) OVER w) * (prec + lag(prec) OVER w) / 2 AS b FROM x WINDOW w AS (PARTITION BY site ORDER BY i)) SELECT site, sum(a) AS roc_trapz, sum(b) AS pr_trapz FROM t GROUP BY 1""", "roc_trapz pr_trapz")
def m03_areas_trapz(d: Data) -> DataFrame:
    return M.areas_trapz(d.scores, "score_b", ["site"], "patient_id")


@query(f"WITH {ap_sql('scores', 'score_b', 'site')} SELECT site, s AS threshold, fp / nullif(q, 0) AS fpr, tp / nullif(p, 0) AS tpr FROM cv", "threshold fpr tpr")
def m04_roc_curve(d: Data) -> DataFrame:
    return M.roc_curve(d.scores, "score_b", ["site"])


@query(f"WITH {ap_sql('scores', 'score_b', 'site')} SELECT site, s AS threshold, tp / p - fp / q AS youden FROM cv WHERE p > 0 AND q > 0 QUALIFY row_number() OVER (PARTITION BY site ORDER BY tp / p - fp / q DESC, s DESC) = 1", "threshold youden")
def m05_youden_threshold(d: Data) -> DataFrame:
    return M.youden_threshold(d.scores, "score_b", ["site"])


@query("SELECT repeat_id, patient_id, CAST(0.3 AS DOUBLE) * prob_a + CAST(0.7 AS DOUBLE) * prob_b AS half, prob_a AS high FROM preds", "half high")
def m06_blend(d: Data) -> DataFrame:
    return d.preds.select("repeat_id", "patient_id", M.blend(F.col("prob_a"), F.col("prob_b"), 0.3).alias("half"), M.blend(F.col("prob_a"), F.col("prob_b"), 1.7).alias("high"))


GRID = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
BLENDS = "bl AS (SELECT repeat_id, label, w, w * prob_a + (1 - w) * prob_b AS s0 FROM preds CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS w))"


@query(f"WITH {BLENDS}, {auc_sql('bl', 's0', 'repeat_id, w')}, {ap_sql('bl', 's0', 'repeat_id, w')} SELECT * FROM auc JOIN ap USING (repeat_id, w)", "w roc_auc pr_auc")
def m07_weight_scan(d: Data) -> DataFrame:
    return M.weight_scan(d.preds, GRID)


@query(f"WITH {BLENDS}, {auc_sql('bl', 's0', 'repeat_id, w')} SELECT repeat_id, w, roc_auc FROM auc QUALIFY row_number() OVER (PARTITION BY repeat_id ORDER BY roc_auc DESC, w) = 1", "w roc_auc")
def m07_best_weight(d: Data) -> DataFrame:
    return M.best_weight(M.weight_scan(d.preds, GRID))


@query(f"WITH {SPLITS} SELECT 'a' AS method, count(*) AS n_splits_valid_roc, avg(roc_auc) AS roc_mean, stddev_pop(roc_auc) AS roc_std, avg(pr_auc) AS pr_mean, stddev_pop(pr_auc) AS pr_std FROM splits", "roc_mean roc_std pr_mean pr_std")
def m08_method_summary(d: Data) -> DataFrame:
    return M.method_summary(splits(d), {"a": ("roc_auc", "pr_auc")})


@query("WITH x AS (SELECT repeat_id, (prob_a >= 0.5)::INT = label AS a, (prob_b >= 0.5)::INT = label AS b, ((prob_a + prob_b) / 2 >= 0.5)::INT = label AS e FROM preds) SELECT repeat_id, count(*) AS n, avg((a AND b)::INT) AS \"both\", avg((a AND NOT b)::INT) AS a_only, avg((NOT a AND b)::INT) AS b_only, avg((NOT a AND NOT b)::INT) AS neither, avg(e::INT) AS ensemble FROM x GROUP BY 1", '"both" a_only b_only neither ensemble')
def m09_correctness_2x2(d: Data) -> DataFrame:
    return M.correctness_2x2(d.preds, 0.5)


@query("WITH x AS (SELECT repeat_id, (prob_a >= 0.5)::INT = label AS a, (prob_b >= 0.5)::INT = label AS b FROM preds), n AS (SELECT repeat_id, count(*) FILTER (WHERE a AND NOT b) AS b, count(*) FILTER (WHERE b AND NOT a) AS c FROM x GROUP BY 1) SELECT repeat_id, b, c, (abs(b - c) - 1) ** 2 / (b + c) AS chi2 FROM n WHERE b + c > 0", "chi2")
def m10_mcnemar(d: Data) -> DataFrame:
    return H.mcnemar(d.preds, 0.5).drop("p")


@query("WITH r AS (SELECT repeat_id, corr(prob_a, prob_b) AS r FROM preds GROUP BY 1 HAVING count(*) > 2) SELECT avg(r) AS mean, stddev_pop(r) AS std, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high, (SELECT corr(prob_a, prob_b) FROM preds) AS pooled FROM r", "mean std low high pooled")
def m11_score_agreement(d: Data) -> DataFrame:
    return H.score_agreement(d.preds)


RANKS = "rank() OVER (PARTITION BY site ORDER BY {c}) + (count(*) OVER (PARTITION BY site, {c}) - 1) / 2.0::DOUBLE"


@query(f"WITH r AS (SELECT site, score_a, score_b, {RANKS.format(c='score_a')} AS ra, {RANKS.format(c='score_b')} AS rb FROM scores) SELECT site, count(*) AS n, corr(score_a, score_b) AS pearson, corr(ra, rb) AS spearman, '' AS note FROM r GROUP BY 1", "pearson spearman")
def m12_correlations(d: Data) -> DataFrame:
    return H.correlations(d.scores, "score_a", "score_b", ["site"])


MWU = f"""r AS (SELECT site, label, {RANKS.format(c='score_b')} AS r FROM scores), t AS (SELECT site, sum(n::DOUBLE ** 3 - n) AS t FROM (SELECT site, score_b, count(*) AS n FROM scores GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT site, sum(r) FILTER (WHERE label = 1) AS rs, CAST(sum(label) AS BIGINT) AS n1, CAST(sum(1 - label) AS BIGINT) AS n0 FROM r GROUP BY 1), u AS (SELECT site, n1, n0, rs - n1 * (n1 + 1) / 2.0::DOUBLE AS u, t FROM s JOIN t USING (site)),
mwu AS (SELECT site, n1, n0, u, sign(u - n1 * n0 / 2.0::DOUBLE) * greatest(0, abs(u - n1 * n0 / 2.0::DOUBLE) - 0.5) / nullif(sqrt(n1 * n0 / 12.0::DOUBLE * (n1 + n0 + 1 - t / nullif((n1 + n0)::DOUBLE * (n1 + n0 - 1), 0))), 0) AS z FROM u)"""


@query(f"WITH {MWU} SELECT site, n1, n0, u, z FROM mwu", "u z")
def m13_mann_whitney(d: Data) -> DataFrame:
    return H.mann_whitney(d.scores, "score_b", ["site"]).drop("p", "exact")


WELCH = """w AS (SELECT site, avg(score_a) FILTER (WHERE label = 0) AS m0, avg(score_a) FILTER (WHERE label = 1) AS m1, var_samp(score_a) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 0) AS e0, var_samp(score_a) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 1) AS e1, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM scores GROUP BY 1)"""


@query(f'WITH {WELCH} SELECT site, (m1 - m0) / nullif(sqrt(e0 + e1), 0) AS t, (e0 + e1) ** 2 / nullif(e0 ** 2 / nullif(n0 - 1, 0) + e1 ** 2 / nullif(n1 - 1, 0), 0) AS df FROM w', "t df")
def m14_welch_t(d: Data) -> DataFrame:
    return H.welch_t(d.scores, "score_a", ["site"]).drop("p")


@query("""WITH o AS (SELECT sum(label) AS k, avg(score_b) FILTER (WHERE label = 1) - avg(score_b) FILTER (WHERE label = 0) AS difference FROM scores),
p AS (SELECT r, score_b, row_number() OVER (PARTITION BY r ORDER BY md5(concat(CAST(patient_id AS VARCHAR), '|', CAST(r AS VARCHAR), '|42')), patient_id) AS i FROM scores CROSS JOIN (SELECT unnest(range(20000)) AS r)),
e AS (SELECT r, avg(score_b) FILTER (WHERE i <= k) - avg(score_b) FILTER (WHERE i > k) AS d FROM p CROSS JOIN o GROUP BY 1) SELECT difference, (count(*) FILTER (WHERE abs(d) >= abs(difference) - 1e-12) + 1) / 20001.0::DOUBLE AS p FROM e CROSS JOIN o GROUP BY 1""", "difference p")
def m15_permutation_p(d: Data) -> DataFrame:
    return H.permutation_p(d.scores, "score_b", "patient_id", 20000, 42)


@query(f"WITH {MWU} SELECT site, coalesce(2 * u / nullif(n1 * n0, 0) - 1, 0) AS delta FROM mwu", "delta")
def m16_cliffs_delta(d: Data) -> DataFrame:
    return H.cliffs_delta(d.scores, "score_b", ["site"])


def boot_sql(strata: str = "") -> str:
    s, part = f"{strata}, " if strata else "", f"PARTITION BY {strata} " if strata else ""
    on = f"n.{strata} = d.{strata} AND " if strata else ""
    n = f"count(*) OVER (PARTITION BY {strata})" if strata else "count(*) OVER ()"
    return f"""nb AS (SELECT patient_id, label, score_b, row_number() OVER ({part}ORDER BY patient_id) - 1 AS i, {n} AS n FROM scores),
dr AS (SELECT {s}r AS replicate, CAST(least(floor($U(concat(CAST(i AS VARCHAR), '|', CAST(r AS VARCHAR), '|7')) * n), n - 1) AS BIGINT) AS pick FROM nb CROSS JOIN (SELECT unnest(range(2000)) AS r)),
bt AS (SELECT d.replicate, n.label, n.score_b FROM dr d JOIN nb n ON {on}n.i = d.pick)"""


def three(c: str, t: str) -> str:
    return f"quantile_cont({t}.{c}, 0.025) AS {c}_low, quantile_cont({t}.{c}, 0.5) AS {c}_mid, quantile_cont({t}.{c}, 0.975) AS {c}_high"


@query(f"WITH {boot_sql()}, {auc_sql('bt', 'score_b', 'replicate')}, {ap_sql('bt', 'score_b', 'replicate')}, m AS (SELECT * FROM auc JOIN ap USING (replicate)) SELECT count(*) AS n_valid, {three('roc_auc', 'm')}, {three('pr_auc', 'm')} FROM m", "roc_auc_low roc_auc_mid roc_auc_high pr_auc_low pr_auc_mid pr_auc_high")
def m17_bootstrap_metric(d: Data) -> DataFrame:
    return H.bootstrap_metric(d.scores.select("patient_id", "label", "score_b"), "score_b", "patient_id", 2000, 7)


@query(f"WITH {boot_sql('label')}, {ap_sql('bt', 'score_b', 'replicate')}, m AS (SELECT replicate, s AS threshold, tp / p - fp / q AS youden FROM cv WHERE p > 0 AND q > 0 QUALIFY row_number() OVER (PARTITION BY replicate ORDER BY tp / p - fp / q DESC, s DESC) = 1) SELECT {three('threshold', 'm')}, {three('youden', 'm')} FROM m", "threshold_low threshold_mid threshold_high youden_low youden_mid youden_high")
def m18_bootstrap_threshold(d: Data) -> DataFrame:
    return H.bootstrap_threshold(d.scores.select("patient_id", "label", "score_b"), "score_b", "patient_id", 2000, 7)


@query(f"WITH {boot_sql()}, m AS (SELECT replicate, avg(score_b) AS score_b FROM bt GROUP BY 1) SELECT (SELECT avg(score_b) FROM scores) AS mean, {three('score_b', 'm')} FROM m", "mean score_b_low score_b_mid score_b_high")
def m19_bootstrap_mean_ci(d: Data) -> DataFrame:
    return H.bootstrap_mean_ci(d.scores, "score_b", "patient_id", 2000, 7)


DIFFS = "df AS (SELECT repeat_id, patient_id, prob_b - prob_a AS d FROM preds), a AS (SELECT repeat_id, d, abs(d) AS m, rank() OVER (PARTITION BY repeat_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY repeat_id, abs(d)) - 1) / 2.0::DOUBLE AS r FROM df WHERE d <> 0), t AS (SELECT repeat_id, sum(c::DOUBLE ** 3 - c) AS t FROM (SELECT repeat_id, m, count(*) AS c FROM a GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH {SPLITS}, {auc_sql('preds', 'prob_b', 'repeat_id').replace('rk AS', 'rk2 AS').replace('FROM rk ', 'FROM rk2 ').replace('auc AS (', 'auc2 AS (')}, x AS (SELECT repeat_id, auc2.roc_auc - splits.roc_auc AS d FROM splits JOIN auc2 USING (repeat_id)),
nb AS (SELECT d, row_number() OVER (ORDER BY repeat_id) - 1 AS i, count(*) OVER () AS n FROM x), dr AS (SELECT r, CAST(least(floor($U(concat(CAST(i AS VARCHAR), '|', CAST(r AS VARCHAR), '|7')) * n), n - 1) AS BIGINT) AS pick FROM nb CROSS JOIN (SELECT unnest(range(5000)) AS r)), m AS (SELECT r, avg(d) AS delta FROM dr JOIN nb ON nb.i = dr.pick GROUP BY 1),
a AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM x WHERE d <> 0)
SELECT (SELECT avg(d) FROM x) AS mean, {three('delta', 'm')}, (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) FROM a) AS w_plus FROM m""", "mean delta_low delta_mid delta_high w_plus")
def m20_paired_delta(d: Data) -> DataFrame:
    both = splits(d).select("repeat_id", F.col("roc_auc").alias("a")).join(splits(d, "prob_b").select("repeat_id", F.col("roc_auc").alias("b")), "repeat_id")
    return H.paired_delta(both, "a", "b", 5000, 7).drop("z", "p")


@query(f"WITH {DIFFS} SELECT a.repeat_id, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, (sum(CASE WHEN d > 0 THEN r ELSE 0 END) - count(*) * (count(*) + 1) / 4.0::DOUBLE) / sqrt(count(*)::DOUBLE * (count(*) + 1) * (2 * count(*) + 1) / 24.0::DOUBLE - max(t) / 48.0::DOUBLE) AS z, '' AS note FROM a JOIN t USING (repeat_id) GROUP BY 1", "w_plus z")
def m21_wilcoxon(d: Data) -> DataFrame:
    return H.wilcoxon(d.preds.withColumn("d", F.col("prob_b") - F.col("prob_a")), "d", ["repeat_id"]).drop("p", "exact")


STEPS = "[" + ", ".join(str(x) for x in R.STEPS.tolist()) + "]"


def weights_sql(source: str, key: str, columns: str, n: int, seed: int = 7) -> str:
    """CTE wt(replicate, columns, w): the rows of positive weight; a weight is the number of steps not above a row's md5 digits."""
    digits = f"CAST(('0x' || substr(md5(concat(CAST({key} AS VARCHAR), '|', CAST(r // 4 AS VARCHAR), '|{seed}')), 1 + 8 * (r % 4), 8)) AS BIGINT)"
    return f"wd AS (SELECT r AS replicate, {columns}, {digits} AS u FROM {source} CROSS JOIN (SELECT unnest(range({n})) AS r)), wt AS (SELECT replicate, {columns}, len(list_filter({STEPS}, lambda x: x <= u)) AS w FROM wd WHERE u >= {R.STEPS[0]})"


CURVES = """tied AS (SELECT replicate, score_b AS s, sum(w * label) AS pos, sum(w * (1 - label)) AS neg FROM wt GROUP BY 1, 2),
cw AS (SELECT *, sum(pos) OVER (PARTITION BY replicate ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY replicate ORDER BY s DESC) AS fp, sum(pos) OVER (PARTITION BY replicate)::DOUBLE AS p, sum(neg) OVER (PARTITION BY replicate)::DOUBLE AS q FROM tied),
best AS (SELECT replicate, s AS threshold, tp / p AS sensitivity, 1 - fp / q AS specificity FROM cw WHERE p > 0 AND q > 0 QUALIFY row_number() OVER (PARTITION BY replicate ORDER BY tp / p - fp / q DESC, s DESC) = 1),
m AS (SELECT replicate, sum(pos * (q - fp + neg / 2.0::DOUBLE)) / max(p * q) AS roc_auc, sum(pos / p * tp / (tp + fp)) AS pr_auc FROM cw WHERE p > 0 AND q > 0 GROUP BY 1)"""


@query(f"WITH {weights_sql('scores', 'patient_id', 'label, score_b', 2000)}, {CURVES} SELECT count(*) AS n_valid, {three('roc_auc', 'm')}, {three('pr_auc', 'm')} FROM m", "roc_auc_low roc_auc_mid roc_auc_high pr_auc_low pr_auc_mid pr_auc_high")
def m17_weighted_metric(d: Data) -> DataFrame:
    return H.weighted_bootstrap_metric(d.scores, "score_b", "patient_id", 2000, 7)


@query(f"WITH {weights_sql('scores', 'patient_id', 'label, score_b', 2000)}, {CURVES}, x AS (SELECT * FROM m JOIN best USING (replicate)) SELECT count(*) AS n_valid, {three('threshold', 'x')}, {three('sensitivity', 'x')}, {three('specificity', 'x')}, {three('roc_auc', 'x')} FROM x", "threshold_low threshold_mid threshold_high sensitivity_low sensitivity_mid sensitivity_high specificity_low specificity_mid specificity_high roc_auc_low roc_auc_mid roc_auc_high")
def m18_weighted_threshold(d: Data) -> DataFrame:
    return H.weighted_bootstrap_threshold(d.scores, "score_b", "patient_id", 2000, 7)


@query(f"WITH {weights_sql('scores', 'patient_id', 'score_b', 2000)}, m AS (SELECT replicate, sum(w * score_b) / sum(w) AS score_b FROM wt GROUP BY 1) SELECT (SELECT avg(score_b) FROM scores) AS mean, {three('score_b', 'm')} FROM m", "mean score_b_low score_b_mid score_b_high")
def m19_weighted_mean_ci(d: Data) -> DataFrame:
    return H.weighted_mean_ci(d.scores, "score_b", "patient_id", 2000, 7)


@query(f"""WITH {SPLITS}, {auc_sql('preds', 'prob_b', 'repeat_id').replace('rk AS', 'rk2 AS').replace('FROM rk ', 'FROM rk2 ').replace('auc AS (', 'auc2 AS (')}, x AS (SELECT repeat_id, auc2.roc_auc - splits.roc_auc AS d FROM splits JOIN auc2 USING (repeat_id)), {weights_sql('x', 'repeat_id', 'd', 5000)},
m AS (SELECT replicate, sum(w * d) / sum(w) AS delta FROM wt GROUP BY 1), a AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM x WHERE d <> 0)
SELECT (SELECT avg(d) FROM x) AS mean, {three('delta', 'm')}, (SELECT sum(CASE WHEN d > 0 THEN r ELSE 0 END) FROM a) AS w_plus FROM m""", "mean delta_low delta_mid delta_high w_plus")
def m20_weighted_paired_delta(d: Data) -> DataFrame:
    both = splits(d).select("repeat_id", F.col("roc_auc").alias("a")).join(splits(d, "prob_b").select("repeat_id", F.col("roc_auc").alias("b")), "repeat_id")
    return H.weighted_paired_delta(both, "a", "b", 5000, 7).drop("z", "p", "exact")


@query()
def m15_permutation_split(d: Data) -> DataFrame:
    return R.permutation_split(d.scores, "score_b", 20000, 42)


#: Every choice of ranks up to 16 as bits: (c, s, top), the number, the sum and the largest of the chosen ranks.
CHOICES = f"ch AS (SELECT {' + '.join(f'(b >> {i} & 1)' for i in range(16))} AS c, {' + '.join(f'(b >> {i} & 1) * {i + 1}' for i in range(16))} AS s, len(ltrim(bin(b), '0')) AS top FROM (SELECT unnest(range(65536)) AS b))"


@query(f"""WITH {CHOICES}, v AS (SELECT CAST(floor(patient_id / 16.0) AS BIGINT) AS block, label, score_a FROM scores), r AS (SELECT *, rank() OVER (PARTITION BY block ORDER BY score_a) AS k, count(*) OVER (PARTITION BY block, score_a) AS c FROM v),
g AS (SELECT block, CAST(sum(label) AS BIGINT) AS n1, CAST(sum(1 - label) AS BIGINT) AS n0, sum(k) FILTER (WHERE label = 1) AS rs FROM r GROUP BY 1 HAVING max(c) = 1 AND sum(label) > 0 AND sum(1 - label) > 0),
t AS (SELECT n, c, s, sum(count(*)) OVER (PARTITION BY n, c ORDER BY s) AS low, sum(count(*)) OVER (PARTITION BY n, c) AS whole, count(*) AS own FROM ch JOIN (SELECT unnest(range(1, 17)) AS n) ON top <= n GROUP BY n, c, s)
SELECT block, n1, n0, rs - n1 * (n1 + 1) / 2.0::DOUBLE AS u, least(1, 2 * least(low, whole - low + own) / whole::DOUBLE) AS p FROM g JOIN t ON t.n = n1 + n0 AND t.c = n1 AND t.s = rs""", "u p")
def m13_exact_by_block(d: Data) -> DataFrame:
    rows = d.scores.withColumn("block", F.floor(F.col("patient_id") / 16.0))
    return H.mann_whitney(rows, "score_a", ["block"]).where("exact").select("block", "n1", "n0", "u", "p")


@query(f"""WITH {CHOICES}, v AS (SELECT repeat_id, CAST(floor(patient_id / 16.0) AS BIGINT) AS block, prob_b - prob_a AS d FROM preds), r AS (SELECT *, rank() OVER (PARTITION BY repeat_id, block ORDER BY abs(d)) AS k, count(*) OVER (PARTITION BY repeat_id, block, abs(d)) AS c FROM v),
g AS (SELECT repeat_id, block, count(*) AS n, coalesce(sum(k) FILTER (WHERE d > 0), 0) AS w FROM r GROUP BY 1, 2 HAVING max(c) = 1 AND count(*) >= 3 AND min(abs(d)) > 0),
t AS (SELECT n, s, sum(count(*)) OVER (PARTITION BY n ORDER BY s) AS low, sum(count(*)) OVER (PARTITION BY n) AS whole, count(*) AS own FROM ch JOIN (SELECT unnest(range(3, 17)) AS n) ON top <= n GROUP BY n, s)
SELECT repeat_id, block, g.n, w::DOUBLE AS w_plus, (whole - low + own) / whole::DOUBLE AS p FROM g JOIN t ON t.n = g.n AND t.s = w""", "w_plus p")
def m21_exact_greater(d: Data) -> DataFrame:
    rows = d.preds.select("repeat_id", F.floor(F.col("patient_id") / 16.0).alias("block"), (F.col("prob_b") - F.col("prob_a")).alias("d"))
    return H.wilcoxon(rows, "d", ["repeat_id", "block"], "greater").where("exact").select("repeat_id", "block", "n", F.col("w_plus").cast("double"), "p")


@query("""WITH g AS (SELECT site, count(*) AS n, corr(label, score_a) AS r0, min(label) AS a, max(label) AS b, min(score_a) AS l, max(score_a) AS h FROM scores GROUP BY 1), k AS (SELECT *, CASE WHEN n < 3 THEN 'too_few_finite_pairs' WHEN a = b THEN 'single_class' WHEN l = h THEN 'x_constant' ELSE '' END AS note FROM g),
z AS (SELECT site, n, note, CASE WHEN note = '' THEN r0 END AS r FROM k) SELECT site, n, note, r, r * sqrt((n - 2) / (1 - r ** 2)) AS t, CASE WHEN note = '' THEN (n - 2)::DOUBLE END AS df FROM z""", "r t df")
def m12_point_biserial(d: Data) -> DataFrame:
    return H.point_biserial(d.scores, "score_a", ["site"]).drop("p")


FEATURES = "ff AS (SELECT patient_id, d, stddev_pop(v) AS v FROM (SELECT patient_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM tokens) GROUP BY 1, 2), fl AS (SELECT d, label, v FROM ff JOIN cohort USING (patient_id))"


def _features(d: Data) -> DataFrame:
    return P.pool(d.tokens, "std").select("patient_id", F.posexplode("features").alias("d", "v")).join(d.cohort.select("patient_id", "label"), "patient_id")


@query(f"WITH {FEATURES}, {auc_sql('fl', 'v', 'd')} SELECT d, roc_auc FROM auc ORDER BY roc_auc DESC, d LIMIT 1", "roc_auc")
def m23_best_single_dim(d: Data) -> DataFrame:
    return M.roc_auc(_features(d), "v", ["d"]).orderBy(F.col("roc_auc").desc(), "d").limit(1)


MOMENTS = "mo AS (SELECT label, avg(score_a) AS mx, avg(score_b) AS my, var_pop(score_a) AS a, covar_pop(score_a, score_b) AS b, var_pop(score_b) AS c FROM scores GROUP BY 1)"


@query(f"WITH {MOMENTS}, x AS (SELECT patient_id, (c * (score_a - mx) ** 2 - 2 * b * (score_a - mx) * (score_b - my) + a * (score_b - my) ** 2) / (a * c - b * b) AS d2 FROM scores JOIN mo USING (label)) SELECT patient_id, d2, d2 > -2 * ln(0.05::DOUBLE) AS outlier FROM x", "d2")
def m24_ellipse_outliers(d: Data) -> DataFrame:
    return H.ellipse_outliers(d.scores, "score_a", "score_b", "label").select("patient_id", "d2", "outlier")


@query(f"WITH {MOMENTS} SELECT label, pi() * (-2 * ln(0.05::DOUBLE)) * sqrt(a * c - b * b) / 1000 AS area FROM mo", "area")
def m24_ellipse_area(d: Data) -> DataFrame:
    return H.ellipse_area(d.scores, "score_a", "score_b", "label").withColumn("area", F.col("area") / 1000)


@query(f"WITH {MWU}, {WELCH}, ma AS (SELECT site, avg(score_b) FILTER (WHERE label = 0) AS mean_0, avg(score_b) FILTER (WHERE label = 1) AS mean_1 FROM scores GROUP BY 1), wb AS (SELECT site, var_samp(score_b) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 0) AS e0, var_samp(score_b) FILTER (WHERE label = 1) / count(*) FILTER (WHERE label = 1) AS e1, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM scores GROUP BY 1) SELECT site, mean_0, mean_1, 100 * (mean_1 - mean_0) / abs(mean_0) AS change, u, z, (mean_1 - mean_0) / nullif(sqrt(e0 + e1), 0) AS t, (e0 + e1) ** 2 / nullif(e0 ** 2 / nullif(wb.n0 - 1, 0) + e1 ** 2 / nullif(wb.n1 - 1, 0), 0) AS df FROM ma JOIN mwu USING (site) JOIN wb USING (site)", "mean_0 mean_1 change u z t df")
def m26_group_tests(d: Data) -> DataFrame:
    return H.group_tests(d.scores, "score_b", ["site"])


@query("""WITH x AS (SELECT score_b AS s, CASE WHEN patient_id % 2 = 0 THEN 1 ELSE 0 END AS male FROM scores WHERE label = 0), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM x)
SELECT avg(s) FILTER (WHERE male = 0) AS mean_f, avg(s) FILTER (WHERE male = 1) AS mean_m, sum(r) FILTER (WHERE male = 1) - sum(male) * (sum(male) + 1) / 2.0::DOUBLE AS u,
(avg(s) FILTER (WHERE male = 1) - avg(s) FILTER (WHERE male = 0)) / sqrt(var_samp(s) FILTER (WHERE male = 0) / sum(1 - male) + var_samp(s) FILTER (WHERE male = 1) / sum(male)) AS t FROM r""", "mean_f mean_m u t")
def m27_controls_sex_test(d: Data) -> DataFrame:
    rows = d.scores.withColumn("sex", F.when(F.col("patient_id") % 2 == 0, " m").otherwise("F"))
    return H.controls_sex_test(rows, "score_b").select("mean_f", "mean_m", "u", "t")


@query(f"WITH {FEATURES}, {RANKS and 'r AS (SELECT d, label, v, rank() OVER (PARTITION BY d ORDER BY v) + (count(*) OVER (PARTITION BY d, v) - 1) / 2.0::DOUBLE AS r FROM fl WHERE d % 3 = 0)'} SELECT d, avg(v) FILTER (WHERE label = 0) AS mean_0, avg(v) FILTER (WHERE label = 1) AS mean_1, sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE AS u FROM r GROUP BY 1", "mean_0 mean_1 u")
def m28_stable_dim_profiles(d: Data) -> DataFrame:
    rows = _features(d).withColumnRenamed("v", "value")
    stable = rows.select(F.col("d").alias("feature")).distinct().withColumn("stable", F.col("feature") % 3 == 0)
    return H.stable_dim_profiles(rows, stable)


# Summaries and audits


@query(f"WITH {SPLITS} SELECT repeat_id % 2 AS half, avg(roc_auc) AS roc_mean, stddev_pop(roc_auc) AS roc_std, median(roc_auc) AS roc_median, quantile_cont(roc_auc, 0.75) - quantile_cont(roc_auc, 0.25) AS roc_iqr, min(roc_auc) AS roc_min, max(roc_auc) AS roc_max, quantile_cont(roc_auc, 0.025) AS roc_p2p5, quantile_cont(roc_auc, 0.975) AS roc_p97p5, avg(pr_auc) AS pr_mean, stddev_pop(pr_auc) AS pr_std, median(pr_auc) AS pr_median, quantile_cont(pr_auc, 0.75) - quantile_cont(pr_auc, 0.25) AS pr_iqr, min(pr_auc) AS pr_min, max(pr_auc) AS pr_max, quantile_cont(pr_auc, 0.025) AS pr_p2p5, quantile_cont(pr_auc, 0.975) AS pr_p97p5 FROM splits GROUP BY 1", " ".join(f"{m}_{s}" for m in ("roc", "pr") for s in M.STATISTICS))
def a24_summary_stats(d: Data) -> DataFrame:
    return M.summary_stats(splits(d).withColumn("half", F.col("repeat_id") % 2), ["half"])


@query(f"WITH {SPLITS}, x AS (SELECT repeat_id % 2 AS half, CASE WHEN repeat_id <> 3 THEN roc_auc END AS r, pr_auc AS p FROM splits) SELECT half, count(r) AS n_valid, avg(r) AS roc_mean, stddev_pop(r) AS roc_std, avg(p) AS pr_mean, stddev_pop(p) AS pr_std FROM x GROUP BY 1", "roc_mean roc_std pr_mean pr_std")
def a25_nan_summary(d: Data) -> DataFrame:
    rows = splits(d).withColumn("half", F.col("repeat_id") % 2).withColumn("roc_auc", F.when(F.col("repeat_id") == 3, F.lit(float("nan"))).otherwise(F.col("roc_auc")))
    return M.nan_summary(rows, ["half"])


@query(f"WITH {SPLITS} SELECT repeat_id % 3 AS config, avg(roc_auc) AS mean, stddev_samp(roc_auc) AS std, min(roc_auc) AS low, max(roc_auc) AS high, count(*) AS folds FROM splits GROUP BY 1", "mean std low high")
def a26_cv_summary(d: Data) -> DataFrame:
    return M.cv_summary(splits(d).withColumn("config", F.col("repeat_id") % 3), ["config"], "roc_auc")


@query("SELECT site AS split, label, avg(score_a) AS mean, stddev_pop(score_a) AS std, count(*) AS n FROM scores GROUP BY 1, 2 UNION ALL SELECT 'all', label, avg(score_a), stddev_pop(score_a), count(*) FROM scores GROUP BY 2", "mean std")
def a27_class_stats_by_split(d: Data) -> DataFrame:
    return M.class_stats_by_split(d.scores, "site", "label", "score_a")


@query(f"WITH g AS (SELECT 'all' AS subgroup, label, score_b FROM scores UNION ALL SELECT CASE WHEN score_a < 1500 THEN 'short' ELSE 'long' END, label, score_b FROM scores UNION ALL SELECT 'es', label, score_b FROM scores WHERE site = 'es'), {auc_sql('g', 'score_b', 'subgroup')}, n AS (SELECT subgroup, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg FROM g GROUP BY 1) SELECT subgroup, n_pos, n_neg, CASE WHEN least(n_pos, n_neg) < 10 THEN NULL ELSE roc_auc END AS roc_auc, CASE WHEN least(n_pos, n_neg) < 10 THEN 'class_too_small' ELSE '' END AS note FROM n JOIN auc USING (subgroup)", "roc_auc")
def a28_subgroup_auc(d: Data) -> DataFrame:
    return M.subgroup_auc(d.scores, {"all": F.lit(True), "short": F.col("score_a") < 1500, "long": F.col("score_a") >= 1500, "es": F.col("site") == "es"}, "score_b", 10)


OUTCOME = "CASE WHEN prob_a >= 0.5 AND label = 1 THEN 'TP' WHEN prob_a < 0.5 AND label = 0 THEN 'TN' WHEN prob_a >= 0.5 THEN 'FP' ELSE 'FN' END"


@query(f"SELECT {OUTCOME} AS outcome, count(*) AS n, avg(prob_b) AS prob_b_mean, stddev_samp(prob_b) AS prob_b_std FROM preds GROUP BY 1", "prob_b_mean prob_b_std")
def a29_confusion_group_stats(d: Data) -> DataFrame:
    return M.confusion_group_stats(d.preds, "prob_a", 0.5, ["prob_b"])


@query("""WITH f AS (SELECT repeat_id, label, prob_a AS p, prob_b AS q, (prob_a >= 0.5)::INT <> label AS wb, (prob_b >= 0.5)::INT <> label AS wa, abs(prob_a - 0.5) < 0.1 AS am FROM preds),
s AS (SELECT repeat_id, count(*) AS n, count(*) FILTER (WHERE wb) AS wrong, count(*) FILTER (WHERE am) AS ambiguous, count(*) FILTER (WHERE wb AND NOT wa) AS fixed, count(*) FILTER (WHERE am AND wb AND NOT wa) AS recovered, count(*) FILTER (WHERE NOT wb AND wa) AS regressed, count(*) FILTER (WHERE abs(q - label) < abs(p - label)) AS toward FROM f GROUP BY ROLLUP (repeat_id))
SELECT *, fixed / greatest(wrong, 1) AS fixed_share, recovered / greatest(ambiguous, 1) AS recovered_share, toward / greatest(n, 1) AS toward_share FROM s""", "fixed_share recovered_share toward_share")
def a39_stack_audit(d: Data) -> DataFrame:
    return M.stack_audit(d.preds, "prob_a", "prob_b", 0.1)


@query("""WITH c AS (SELECT repeat_id, count(*) FILTER (WHERE prob_a < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE prob_a >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE prob_a < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE prob_a >= 0.5 AND label = 1) AS tp FROM preds GROUP BY 1),
r AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c) SELECT *, (sensitivity + specificity) / 2 AS balanced_accuracy FROM r""", 'accuracy sensitivity specificity "precision" f1 balanced_accuracy')
def a40_classification_metrics(d: Data) -> DataFrame:
    return M.classification_metrics(d.preds, "prob_a", 0.5, ["repeat_id"])


@query("SELECT user_id, avg(value) AS value FROM events GROUP BY 1", "value")
def a41_mean_by_id(d: Data) -> DataFrame:
    return M.mean_by_id(d.events, "user_id", ["value"])


@query("WITH e AS (SELECT min(l_extendedprice) AS l, max(l_extendedprice) AS h FROM lineitem) SELECT CAST(least(floor((l_extendedprice - l) / (h - l) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM lineitem CROSS JOIN e GROUP BY 1")
def a42_metric_histogram(d: Data) -> DataFrame:
    return M.metric_histogram(d.lineitem, "l_extendedprice")


PLANES = "SELECT patient_id, label, score_a, score_b, score_a % 97 AS score_c FROM scores"


@query(f"""WITH x AS ({PLANES}), m AS (SELECT avg(score_a) AS ma, stddev_pop(score_a) AS sa, avg(score_b) AS mb, stddev_pop(score_b) AS sb, avg(score_c) AS mc, stddev_pop(score_c) AS sc FROM x WHERE label = 0), z AS (SELECT *, (score_a - ma) / sa AS za, (score_b - mb) / sb AS zb, (score_c - mc) / sc AS zc FROM x CROSS JOIN m)
SELECT patient_id, za + zb + zc AS total, 0.5 * (score_b + score_c) - score_a AS delta_raw, 0.5 * (zb + zc) - za AS delta_norm FROM z""", "total delta_raw delta_norm")
def a46_robust_plane_scores(d: Data) -> DataFrame:
    rows = d.scores.withColumn("score_c", F.col("score_a") % 97)
    return M.robust_plane_scores(rows, ["score_a", "score_b", "score_c"]).select("patient_id", "total", "delta_raw", "delta_norm")


@query(f"WITH x AS (SELECT repeat_id, label, 'prob_a' AS metric, prob_a AS v FROM preds UNION ALL SELECT repeat_id, label, 'prob_b', prob_b FROM preds), {auc_sql('x', 'v', 'repeat_id, metric')} SELECT * FROM auc", "roc_auc")
def a47_offset_sweep_auc(d: Data) -> DataFrame:
    return M.area_of_each(d.preds, ["prob_a", "prob_b"], ["repeat_id"])


# Top rows


@query("""WITH x AS (SELECT token_id, patient_id, CAST(embedding[1] AS DOUBLE) AS v FROM tokens), y AS (SELECT token_id, (v - avg(v) OVER (PARTITION BY patient_id)) ** 2 AS rank_value FROM x)
(SELECT token_id, rank_value, 'top' AS side FROM y ORDER BY rank_value DESC, token_id LIMIT 10) UNION ALL (SELECT token_id, rank_value, 'bottom' FROM y ORDER BY rank_value, token_id LIMIT 10)""", "rank_value")
def k01_extremes(d: Data) -> DataFrame:
    rows = d.tokens.select("token_id", "patient_id", F.col("embedding")[0].cast("double").alias("v"))
    return M.extremes(rows, "v", 10, "token_id", "patient_id").select("token_id", "rank_value", "side")


@query("WITH c AS (SELECT CAST(unnest(range(len(embedding))) AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM tokens) SELECT d, avg(v) AS coef FROM c GROUP BY 1 ORDER BY abs(avg(v)) DESC, d LIMIT 8", "coef")
def k02_top_dims(d: Data) -> DataFrame:
    coef = P.long_rows(d.tokens).groupBy("d").agg(F.avg("v").alias("coef"))
    return M.top_dims(coef, 8)


@query("SELECT site, patient_id, score_b, score_a FROM scores QUALIFY row_number() OVER (PARTITION BY site ORDER BY score_b DESC, score_a DESC, patient_id) = 1", "score_b score_a")
def k03_best_per_group(d: Data) -> DataFrame:
    return M.best_per_group(d.scores, "site", "score_b", "score_a", "patient_id").select("site", "patient_id", "score_b", "score_a")


@query(f"WITH {SPLITS}, x AS (SELECT *, row_number() OVER (ORDER BY roc_auc, repeat_id) - 1 AS i, count(*) OVER () AS n FROM splits) SELECT repeat_id, roc_auc FROM x WHERE i = n // 2", "roc_auc")
def k04_median_split(d: Data) -> DataFrame:
    return M.median_split(splits(d).withColumn("one", F.lit(1)), "roc_auc", ["one"]).select("repeat_id", "roc_auc")


@query(f"WITH {SPLITS} SELECT repeat_id, roc_auc FROM splits ORDER BY abs(roc_auc - (SELECT median(roc_auc) FROM splits)), repeat_id LIMIT 1", "roc_auc")
def k05_closest_to_median(d: Data) -> DataFrame:
    return M.closest_to_median(splits(d), "roc_auc").select("repeat_id", "roc_auc")


@query("WITH t AS (SELECT patient_id, slice_index, row_number() OVER (PARTITION BY patient_id ORDER BY value DESC, slice_index) AS i FROM seq) SELECT patient_id, string_agg(CAST(slice_index AS VARCHAR), ',' ORDER BY i) AS top FROM t WHERE i <= 5 GROUP BY 1")
def k06_topk_per_group(d: Data) -> DataFrame:
    return M.topk_per_group(d.seq, 5, "patient_id", "value", "slice_index", "top")


@query(f"WITH x AS (SELECT patient_id, {OUTCOME} AS outcome, prob_a FROM preds WHERE repeat_id = 0) SELECT patient_id, outcome FROM x QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY CASE WHEN outcome IN ('TP', 'FP') THEN -prob_a ELSE prob_a END, patient_id) <= 4")
def k07_confident_examples(d: Data) -> DataFrame:
    return M.confident_examples(d.preds.where("repeat_id = 0"), "prob_a", 0.5, 4, "patient_id").select("patient_id", "outcome")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12", "o_totalprice")
def k08_worst_rows(d: Data) -> DataFrame:
    return M.worst_rows(d.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 12, "o_orderkey")


@query("SELECT repeat_id, patient_id, prob_a FROM preds ORDER BY abs(prob_a - 0.5), repeat_id, patient_id LIMIT 9", "prob_a")
def k09_most_ambiguous(d: Data) -> DataFrame:
    return M.most_ambiguous(d.preds.select("repeat_id", "patient_id", "prob_a"), "prob_a", 9, ["repeat_id", "patient_id"])


CONFIGS = "cf AS (SELECT c_nationkey % 3 AS source, c_nationkey AS config, avg(c_acctbal) AS roc_mean, stddev_pop(c_acctbal) AS roc_std, avg(c_custkey) AS pr_mean, stddev_pop(c_custkey) AS pr_std FROM customer GROUP BY 2)"


@query(f"""WITH {CONFIGS} SELECT source, 'roc_std' AS pick, config FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY roc_std, roc_mean DESC, config) AS i FROM cf) WHERE i = 1 UNION ALL SELECT source, 'pr_std', config FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pr_std, pr_mean DESC, config) AS i FROM cf) WHERE i = 1
UNION ALL SELECT source, 'roc_mean', config FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY roc_mean DESC, config) AS i FROM cf) WHERE i = 1""")
def k10_stable_configs(d: Data) -> DataFrame:
    rows = d.customer.groupBy(F.col("c_nationkey").alias("config")).agg(F.avg("c_acctbal").alias("roc_mean"), F.stddev_pop("c_acctbal").alias("roc_std"), F.avg("c_custkey").alias("pr_mean"), F.stddev_pop("c_custkey").alias("pr_std")).withColumn("source", F.col("config") % 3)
    return M.stable_configs(rows, "source", "config")


@query("SELECT repeat_id, patient_id, label FROM preds WHERE (prob_a >= 0.5)::INT <> label")
def k11_misclassified(d: Data) -> DataFrame:
    return M.misclassified(d.preds, "prob_a", 0.5).select("repeat_id", "patient_id", "label")


@query(f"WITH {FEATURES}, s AS (SELECT patient_id, sqrt(sum(v * v)) AS score FROM ff GROUP BY 1) SELECT patient_id, score FROM s", "score")
def x01_pooling_registry(d: Data) -> DataFrame:
    P.register("std_again", lambda v, exact: F.sqrt(F.var_pop(v)))
    return Q.vector_norm_by_group(P.pool(d.tokens, "std_again"))
