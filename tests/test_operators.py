"""Hand-made cases of the cohort operators: ties, constants, masks, missing values, golden tables."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vectrove.functions import arrays as A
from vectrove.functions import clean as C
from vectrove.operators import clustering as K
from vectrove.operators import joins as J
from vectrove.operators import metrics as M
from vectrove.operators import pooling as P
from vectrove.operators import sequences as Q
from vectrove.operators import splits as S
from vectrove.operators import tests_of_hypotheses as H
from vectrove.plans import catalog, queries_models
from vectrove.plans.views import Data
from vectrove.sources import tables as T


def test_labels_and_sex(spark):
    df = spark.createDataFrame([("1.0", " m "), ("TTS", "F"), ("7", "X"), ("no", None), (None, "male")], "t string, s string")
    rows = df.select(C.binary_label(F.col("t")).alias("y"), C.sex_code(F.col("s"), "m0f1").alias("a"), C.sex_code(F.col("s"), "male").alias("b"), C.sex_code(F.col("s"), "half").alias("c")).collect()
    assert [r.y for r in rows] == [0, 1, 7, 0, None]
    assert [r.a for r in rows] == [0.0, 1.0, None, None, 0.0]
    assert [r.b for r in rows] == [1.0, 0.0, None, None, 1.0]
    assert [r.c for r in rows] == [1.0, 0.0, 0.5, 0.5, 0.5]
    with pytest.raises(PySparkException):
        df.select(C.sex_code(F.col("s"), "f0m1")).collect()


def test_dedupe_before_and_after_dropping(spark):
    df = spark.createDataFrame([("p", 1, 50.0), ("p", 2, None), ("q", 3, 60.0)], "id string, n int, age double")
    assert {(r.id, r.n) for r in C.dedupe_last(df, "id", "n", ["age"]).collect()} == {("p", 1), ("q", 3)}
    assert {(r.id, r.n) for r in C.dedupe_last(df, "id", "n", ["age"], drop_first=False).collect()} == {("q", 3)}


def test_split_ids_and_columns(spark):
    df = spark.createDataFrame([("a; ;b;", 1.0)], "ids string, `roc_ensemble_w0.5` double")
    assert [r.ids for r in C.split_ids(df, "ids").collect()] == ["a", "b"]
    assert C.resolve_weight_column(df, 0.5) == "roc_ensemble_w0.5"
    with pytest.raises(ValueError):
        C.resolve_weight_column(df, 0.4)
    with pytest.raises(ValueError):
        C.harmonise_cohort(df)


def test_resolve_ids_takes_the_best_tier(spark):
    left = spark.createDataFrame([("ab",), ("X1",), ("zz",)], "id string")
    right = spark.createDataFrame([("ab2",), ("ab1",), ("x1",), ("X1",)], "id string")
    assert {(r.id, r.match, r.tier) for r in J.resolve_ids(left, right).collect()} == {("ab", "ab1", 3), ("X1", "X1", 1)}


def test_resolve_ids_of_every_customer(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name").collect()
    names, expected = [r.c_name for r in rows], {}
    for r in rows:
        i = (r.c_name, r.c_name.upper(), r.c_name[:17])[r.c_custkey % 3]
        found = [(1, n) for n in names if n == i] + [(2, n) for n in names if n.lower() == i.lower()] + [(3, n) for n in names if n.startswith(i)]
        expected[i] = min(found)
    got = catalog.queries()["j07_resolve_ids"](spark, sf_dir).collect()
    assert len(got) == len(expected) and {r.id: (r.tier, r.match) for r in got} == expected


def test_blend_weight_outside_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        J.scan_weights(df, [1.2])


def test_label_conflict_is_an_error(spark):
    a, b = spark.createDataFrame([(0, 1, 1)], "repeat_id int, patient_id int, label int"), spark.createDataFrame([(0, 1, 0)], "repeat_id int, patient_id int, label int")
    assert J.label_conflicts(a, b).count() == 1
    with pytest.raises(PySparkException):
        J.join_oos(a, b).collect()


def hist(spark, rows, k=None):
    df = spark.createDataFrame(rows, "patient_id string, cluster_id long, mask int")
    out = {}
    for r in P.cluster_hist(df, k).collect():
        out.setdefault(r.patient_id, {})[r.cluster] = r.share
    return {p: [v[c] for c in sorted(v)] for p, v in out.items()}


def test_cluster_hist_rules(spark):
    rows = [("a", 0, 1), ("a", 2, 1), ("a", 2, 0), ("b", 2, 1), ("c", 1, 0), ("d", -1, 1), ("d", 0, 1)]
    assert hist(spark, rows) == {"a": [0.5, 0, 0.5], "b": [0, 0, 1.0], "c": [0, 0, 0]}
    assert hist(spark, rows, 2) == {"a": [1.0, 0], "c": [0, 0]}
    assert hist(spark, rows, 4)["b"] == [0, 0, 1.0, 0]
    assert all(abs(sum(v) - 1) < 1e-12 or sum(v) == 0 for v in hist(spark, rows).values())


def tokens(spark, rows):
    return spark.createDataFrame(rows, "token_id long, patient_id string, z_mm double, slice_index long, embedding array<double>")


def test_sequences_of_one_token_equal_positions_and_empty_third(spark):
    df = tokens(spark, [(0, "a", 0.0, 0, [1.0]), (1, "b", 5.0, 0, [0.0]), (2, "b", 5.0, 1, [2.0]), (3, "c", 0.0, 0, [0.0]), (4, "c", 0.1, 1, [1.0]), (5, "c", 10.0, 2, [3.0])])
    rate = {r.patient_id: r.features for r in Q.volatility_rate(df).collect()}
    assert "a" not in rate and rate["b"] == pytest.approx([2000.0]) and rate["c"] == pytest.approx([(10 + 2 / 9.9) / 2])
    regions = {r.patient_id: r.features for r in Q.volatility_rate_regions(df).collect()}
    assert regions["c"][2] is None and P.long_rows(df).count() == 6
    pos = {(r.patient_id, r.slice_index): r.pos_norm for r in Q.normalised_position(df).collect()}
    assert pos[("a", 0)] == 0 and pos[("b", 1)] == 1.0 and pos[("c", 1)] == pytest.approx(0.01)


def test_mass_and_runs(spark):
    df = spark.createDataFrame([("a", i, float(i), w) for i, w in enumerate([0.4, 0.4, 0.1, 0.1])], "patient_id string, slice_index int, pos double, weight double")
    assert Q.mass_to_reach(df, 0.8).first().n == 2 and Q.mass_to_reach(df, 5.0).first().n == 4
    assert Q.longest_run(df).first().longest == 2
    zero = df.withColumn("weight", F.lit(0.0))
    assert Q.attention_concentration(zero, 2).first().effective == pytest.approx(4.0)


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_areas_against_brute_force(spark):
    rng = random.Random(1)
    y, s = [rng.random() < 0.4 for _ in range(80)], [rng.randrange(12) / 10 for _ in range(80)]
    df = spark.createDataFrame([(i, int(a), b) for i, (a, b) in enumerate(zip(y, s))], "patient_id int, label int, score double")
    assert M.roc_auc(df, "score", []).first().roc_auc == pytest.approx(brute_auc(y, s))
    flipped = df.withColumn("score", -F.col("score"))
    assert M.roc_auc(flipped, "score", []).first().roc_auc == pytest.approx(1 - brute_auc(y, s))
    ap, last = 0.0, 0
    for t in sorted(set(s), reverse=True):
        said = [a for a, b in zip(y, s) if b >= t]
        ap += (sum(said) - last) / sum(y) * sum(said) / len(said)
        last = sum(said)
    assert M.average_precision(df, "score", []).first().pr_auc == pytest.approx(ap)
    assert math.isnan(M.roc_auc(df.where("label = 1"), "score", []).first().roc_auc)
    assert H.cliffs_delta(df, "score", []).first().delta == pytest.approx(2 * brute_auc(y, s) - 1)


def test_p_values(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 3.0), (12.706, 1.0)], "t double, n double")
    got = [r.p for r in df.select(H.t_two_sided("t", "n").alias("p")).collect()]
    assert got == pytest.approx([0.07338803, 1.0, 0.05], abs=1e-5)
    assert spark.range(1).select(H.chi1_p(F.lit(3.841459)).alias("p")).first().p == pytest.approx(0.05, abs=1e-6)


def test_wilcoxon_too_few(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-2.0,)], "d double")
    r = H.wilcoxon(df, "d", []).first()
    assert (r.n, r.w_plus, r.z, r.note) == (2, 1.0, None, "too_few_pairs")


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([("a", [1.0, 5.0], True), ("b", [3.0, 5.0], True), ("c", [5.0, 6.0], False)], "patient_id string, features array<double>, train boolean")
    assert {r.patient_id: r.features for r in S.standardise(df, "train").collect()} == {"a": [-1.0, 0.0], "b": [1.0, 0.0], "c": [3.0, 1.0]}
    assert {r.patient_id: r.features for r in S.minmax(df, "train").collect()} == {"a": [0.0, 0.0], "b": [1.0, 0.0], "c": [2.0, 0.0]}


def test_repeats_are_disjoint_and_stratified(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(29)], "patient_id int, label int")
    rows = S.stratified_repeats(df, 4).collect()
    for r in range(4):
        test = [x for x in rows if x.repeat_id == r and x.is_test]
        assert len(test) == 6 and sum(x.label for x in test) == 2
    assert len({frozenset(x.patient_id for x in rows if x.repeat_id == r and x.is_test) for r in range(4)}) == 4
    assert rows and S.stratified_repeats(df.orderBy(F.rand(3)), 4).exceptAll(spark.createDataFrame(rows, S.stratified_repeats(df, 4).schema)).count() == 0


def test_kmeans_improves_and_needs_enough_rows(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(3, 8))
    rows = [(i, "p", 0.0, i, (centres[i % 3] + rng.normal(size=8) * 0.1).tolist()) for i in range(90)]
    df = tokens(spark, rows)
    last = -1.0
    for most in (1, 2, 10):
        _, assigned = K.spherical_kmeans(df, 3, most)
        total = assigned.agg(F.sum("similarity")).first()[0]
        assert total >= last - 1e-9
        last = total
    with pytest.raises(ValueError):
        K.spherical_kmeans(df.limit(2), 3)


def test_zero_embedding_and_nan(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.u for r in df.select(A.l2_normalise(F.col("v")).alias("u")).collect()] == [[0.0, 0.0], pytest.approx([0.6, 0.8])]
    odd = spark.createDataFrame([([float("nan"), float("inf"), None, 1.0],)], "v array<double>")
    assert odd.select(A.nan_to_zero(F.col("v")).alias("u")).first().u == [0.0, 0.0, 0.0, 1.0]
    assert odd.where(C.finite("v")).count() == 0


def test_unknown_names_are_errors(spark):
    df = tokens(spark, [(0, "a", 0.0, 0, [1.0])])
    with pytest.raises(ValueError):
        P.pool(df, "nothing")
    with pytest.raises(ValueError):
        P.feature_set(df, "nothing")


def test_manifest_table_notes_and_golden_rows(spark):
    towers = spark.createDataFrame([(0.874, 0.0564, 0.7642, 0.8766, 0.0632, 0.7522)], "ROC_mean double, ROC_std double, ROC_p2p5 double, PR_mean double, PR_std double, PR_p2p5 double")
    summary = spark.createDataFrame([("ensemble_fixed_w0.5", 0.89, 0.05, 0.90, 0.04)], "method string, roc_mean double, roc_std double, pr_mean double, pr_std double")
    splits = spark.createDataFrame([(0.7 + i / 100, 0.8 + i / 200) for i in range(41)], "`roc_ensemble_w0.5` double, `pr_ensemble_w0.5` double")
    head = {"model": "m", "representation": "r", "classifier_or_fusion": "c"}
    rows = [
        head | {"id": "1", "kind": "single_row_summary_csv", "path": "t"}, head | {"id": "2", "kind": "single_row_summary_csv", "path": "gone"}, head | {"id": "4", "kind": "odd"},
        head | {"id": "3", "kind": "ensemble_method", "summary_methods": "s", "per_split_metrics": "p", "method_key": "ensemble_fixed_w0.5"},
    ]
    got = {r.branch_id: r for r in T.manifest_table(spark, rows, {"t": towers, "s": summary, "p": splits}).collect()}
    assert got["1"].ROC_mean == 0.874 and got["2"].notes == "MISSING CSV" and got["4"].notes.startswith("Unknown kind")
    assert got["3"].ROC_p2p5 == pytest.approx(0.71) and got["3"].PR_p2p5 == pytest.approx(0.805) and got["3"].notes == "ensemble:ensemble_fixed_w0.5 from=results"


#: Per-split areas of two repeats and their summary, for the mean and population deviation of methods.
def test_method_summary_uses_population_deviation(spark):
    splits = spark.createDataFrame([(0, 0.8047619047619048, 0.8642008608675275), (1, 0.8095238095238095, 0.8210149889097257)], "repeat_id int, roc double, pr double")
    r = M.method_summary(splits, {"a": ("roc", "pr")}).first()
    assert r.n_splits_valid_roc == 2 and r.roc_mean == pytest.approx(0.8071428571428572) and r.roc_std == pytest.approx(0.00238095238, abs=1e-9)


def test_stacks_take_every_repeat(spark, sf_dir):
    d = Data(spark, sf_dir)
    preds = [(r.repeat_id, r.patient_id, r.prob) for r in queries_models.predictions(d).collect()]
    repeats, own, mine = sorted({r for r, _, _ in preds}), {(r, p): s for r, p, s in preds}, {}
    for _, p, s in preds:
        mine.setdefault(p, []).append(s)
    whole, ids = np.mean([s for _, _, s in preds]), [r.doc_id for r in d.labels.collect()]
    assert repeats == list(range(100))
    expected = {(r, p): ((r, p) in own, own.get((r, p), np.mean(mine[p]) if p in mine else whole)) for r in repeats for p in ids}
    got = {(r.repeat_id, r.patient_id): (r.is_test, r.stacked) for r in catalog.queries()["t23_stack_features"](spark, sf_dir).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k][0] == t and math.isclose(got[k][1], s, abs_tol=2e-6) for k, (t, s) in expected.items())


def test_heads_fit_all_dimensions(spark, sf_dir):
    assert {r.d for r in catalog.queries()["t26_coef_table"](spark, sf_dir).collect()} == set(range(64))
    got = [(r.repeat_id, r.feature) for r in catalog.queries()["t28_coef_repeat_matrix"](spark, sf_dir).collect()]
    assert sorted(got) == [(r, f) for r in range(queries_models.REPEATS) for f in range(64)]


def grouped_rows(spark, n=160, d=5, repeats=4):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 1, 0] + 3
    y = (x[:, 0] - x[:, 1] * 0.2 + rng.normal(size=n) > 2.4).astype(int)
    target = np.where(rng.random((n, repeats)) < 0.25, -1, y[:, None])
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), target[i].tolist()) for i in range(n)], "patient_id int, features array<double>, label int, target array<int>").repartition(5)
    return x, y, target, rows


def test_grouped_fits_are_at_the_optimum(spark):
    from vectrove.operators import grouped as G

    x, y, target, rows = grouped_rows(spark)
    heads = [("logistic_l2", {"c": 1.0}), ("logistic_l1", {"c": 0.3}), ("logistic_en", {"c": 0.1, "l1_ratio": 0.2}), ("linear_svc", {"c": 1.0})]
    found = G.fit(rows, 4, heads)
    scores = {(r.repeat_id, r.config, r.patient_id): (r.is_test, r.score) for r in G.scores(rows, found, ["patient_id"]).collect()}
    for r in range(4):
        inside = target[:, r] >= 0
        std = x[inside].std(axis=0)
        z = (x - x[inside].mean(axis=0)) / np.where(std > 0, std, 1)
        ones = y[inside].sum()
        w = np.where(y == 1, inside.sum() / (2 * ones), inside.sum() / (2 * (inside.sum() - ones))) * inside
        for h, (kind, p) in enumerate(heads):
            b, a = found.coef[r, h], found.intercept[r, h]
            m, sign, c = z @ b + a, 2 * y - 1, p["c"]
            slope = -2 * sign * np.maximum(0, 1 - sign * m) if kind == "linear_svc" else 1 / (1 + np.exp(-m)) - y
            ratio = {"logistic_l1": 1.0, "logistic_en": 0.2}.get(kind, 0.0)
            g = c * z.T @ (w * slope) + (1 - ratio) * b
            assert np.where(b != 0, np.abs(g + ratio * np.sign(b)), np.maximum(0, np.abs(g) - ratio)).max() < 1e-6
            assert abs(c * (w * slope).sum() + (a if kind == "linear_svc" else 0)) < 1e-6
            for i in (0, 7, 33):
                test, score = scores[(r, h, i)]
                assert test == (not inside[i]) and abs(score - (m[i] if kind == "linear_svc" else 1 / (1 + np.exp(-m[i])))) < 1e-9


def test_grouped_fits_in_parts_by_split_and_of_one_class(spark, monkeypatch):
    from vectrove.operators import grouped as G

    _, _, target, rows = grouped_rows(spark)
    heads = [("logistic_l2", {"c": 1.0}), ("linear_svc", {"c": 0.5})]
    whole = G.fit(rows, 4, heads)
    monkeypatch.setattr(G, "SUMS", 3 * 36)  # three fits at a time
    assert np.allclose(whole.coef, G.fit(rows, 4, heads).coef)
    long = rows.select("patient_id", "label", "features", F.posexplode("target").alias("repeat_id", "t")).withColumn("target", F.array("t"))
    assert np.allclose(whole.coef, G.fit(long, 4, heads).coef)
    one = rows.withColumn("target", F.transform("target", lambda t: F.when(t == 1, -1).otherwise(t)))
    assert np.isnan(G.fit(one, 4, heads).coef).all()
    with pytest.raises(ValueError):
        G.fit(rows.limit(0), 4, heads)
    assert G.scores(long, whole, ["patient_id"]).count() == 160 * 4 * 2


def test_ranks_by_ranges(spark):
    from vectrove.operators import ranks as R

    rng = np.random.default_rng(3)
    rows = [(int(i), ["a", "b", None][i % 3], float(v)) for i, v in enumerate(rng.integers(0, 40, 500))] + [(500, "a", float("nan")), (501, "a", None)]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    good = [r for r in rows if r[2] is not None and r[2] == r[2]]
    for by in ([], ["g"]):
        got = {(r["g"] if by else 0, r.v): (r.n, r["rank"]) for r in R.ties(df, "v", by).collect()}
        groups = {}
        for _, g, v in good:
            groups.setdefault(g if by else 0, []).append(v)
        want = {(g, v): (vs.count(v), sum(x < v for x in vs) + (vs.count(v) + 1) / 2) for g, vs in groups.items() for v in set(vs)}
        assert got == want
    assert [r.i for r in R.numbered(df, "k", "i").orderBy("k").collect()] == list(range(502))
    named = R.numbered(df.withColumn("s", F.col("k").cast("string")), "s", "i").select("s", "i").collect()
    assert [r.i for r in sorted(named, key=lambda r: r.s)] == list(range(502))
    assert R.ties(df.limit(0), "v", []).count() == 0 and R.numbered(df.limit(0), "k", "i").count() == 0


def test_permutations_against_brute_force(spark):
    import hashlib

    from vectrove.operators import tests_of_hypotheses as T

    rng = np.random.default_rng(6)
    rows = [(i, float(v), int(y)) for i, (v, y) in enumerate(zip(rng.normal(size=60), rng.integers(0, 2, 60)))]
    got = T.permutation_p(spark.createDataFrame(rows, "k long, v double, label int"), "v", "k", 40, 42).first()
    k = sum(y for _, _, y in rows)
    true = np.mean([v for _, v, y in rows if y]) - np.mean([v for _, v, y in rows if not y])
    far = 0
    for r in range(40):
        order = sorted(rows, key=lambda x: (hashlib.md5(f"{x[0]}|{r}|42".encode()).hexdigest(), x[0]))
        far += abs(np.mean([v for _, v, _ in order[:k]]) - np.mean([v for _, v, _ in order[k:]])) >= abs(true) - 1e-12
    assert abs(got.difference - true) < 1e-12 and abs(got.p - (far + 1) / 41) < 1e-12


def test_cohort_files_with_numeric_and_text_labels(spark):
    numbers = spark.createDataFrame([("1", 1.0, "61", " m "), ("2", 0.0, "x", "F"), ("3", None, None, None)], "ID string, case double, age string, sex string")
    assert [(r.label, r.age, r.sex) for r in C.harmonise_cohort(numbers).orderBy("patient_id").collect()] == [(1, 61.0, "M"), (0, None, "F"), (None, None, None)]
    texts = spark.createDataFrame([("1", "Takotsubo", 1, "F"), ("2", "control case", 1, "F"), ("3", "12", 1, "F"), ("4", "1.0", 1, "F"), ("5", None, 1, "F")], "id string, Label string, age int, sex string")
    assert [r.label for r in C.harmonise_cohort(texts).orderBy("patient_id").collect()] == [1, 0, 12, 0, None]


def test_prototypes_of_equal_weight_tie_in_any_order_of_the_rows(spark):
    from vectrove.operators import pooling as P

    rows = []
    for g in range(40):  # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ as doubles
        for c, values in ((0, (0.1, 0.2, 0.3)), (1, (0.3, 0.2, 0.1))) if g % 2 else ((0, (0.3, 0.2, 0.1)), (1, (0.1, 0.2, 0.3))):
            rows += [(g, c, v) for v in values]
    df = spark.createDataFrame(rows, "patient_id int, cluster_id int, v double").coalesce(1)
    for top in (0.0, 1e30, float("nan")):  # a weight too large for decimals takes doubles
        more = df.unionByName(spark.createDataFrame([(99, 0, top)], "patient_id int, cluster_id int, v double"))
        got = {r.cluster_id: r.n for r in P.prototype_regions(more, "v", "cluster_id", 1).collect()}
        assert got == {0: 121} if top == 0.0 else sum(got.values()) == 121
