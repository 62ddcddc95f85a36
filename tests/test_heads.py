"""Kernel machines, calibrated SVCs and perceptrons of many splits against plain numpy."""

import numpy as np
import pytest

from vectrove.operators import grouped as G
from vectrove.operators import heads as H
from vectrove.operators import kernels as K
from vectrove.operators import perceptron as P


def table(spark, n=90, d=3, repeats=3, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 3, 0.5][:d]
    y = ((x[:, 0] ** 2 + (x[:, 1] / 3) ** 2 + 0.3 * rng.normal(size=n)) > 1.6).astype(int)
    target = np.where(rng.random((n, repeats)) < 0.25, -1, y[:, None])
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), target[i].tolist()) for i in range(n)], "patient_id int, features array<double>, label int, target array<int>")
    rows = H.with_inner_folds(rows).repartition(4)
    fold = {r.patient_id: r.fold for r in rows.collect()}
    return x, y, target, np.array([fold[i] for i in range(n)]), G.kept(rows)


def exact_svc(kernel, y, c):
    """Dual of the SVC with a free intercept, by sequential pairs to a gap of 1e-10: decision weights and the intercept."""
    n, s = len(y), 2.0 * y - 1
    q = s[:, None] * s * kernel
    a, g = np.zeros(n), -np.ones(n)
    for _ in range(400_000):
        more, less = a < c - 1e-12, a > 1e-12  # by how far sums may be off a bound
        up = ((s > 0) & more) | ((s < 0) & less)
        low = ((s > 0) & less) | ((s < 0) & more)
        f = -s * g
        i, j = np.flatnonzero(up)[f[up].argmax()], np.flatnonzero(low)[f[low].argmin()]
        if f[i] - f[j] < 1e-9:
            break
        t = (f[i] - f[j]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        t = min(t, (c[i] - a[i]) if s[i] > 0 else a[i], a[j] if s[j] > 0 else (c[j] - a[j]))
        a[i], a[j] = a[i] + s[i] * t, a[j] - s[j] * t
        g += q[:, i] * s[i] * t - q[:, j] * s[j] * t
    return a * s, (f[i] + f[j]) / 2


def scaled(x, inside):
    std = x[inside].std(axis=0)
    return (x - x[inside].mean(axis=0)) / np.where(std > 0, std, 1)


def weights(y, inside, c):
    ones, n = y[inside].sum(), inside.sum()
    return c * np.where(y[inside] == 1, n / (2 * ones), n / (2 * (n - ones)))


def test_kernel_machines_are_the_exact_duals(spark):
    x, y, target, _, rows = table(spark, repeats=2)
    heads = [("rbf_svc", {"c": 1.0}), ("rbf_svc", {"c": 10.0, "gamma": "auto"}), ("rbf_svc", {"c": 0.1, "gamma": 2.0})]
    found = K.fit_kernels(rows, 2, heads)
    for r in range(2):
        inside = target[:, r] >= 0
        z = scaled(x, inside)
        for h, (_, p) in enumerate(heads):
            gamma = {"scale": 1 / (3 * z[inside].var()), "auto": 1 / 3}.get(p.get("gamma", "scale"), 2.0)
            kernel = K.gaussian(z, z[inside], gamma)
            a, b = exact_svc(kernel[inside], y[inside], weights(y, inside, p["c"]))
            assert np.abs(found.decision(r, x)[:, h] - (kernel @ a + b)).max() < 1e-3


def test_fewer_landmarks_still_separate_and_parts_agree(spark, monkeypatch):
    x, y, target, _, rows = table(spark, repeats=2)
    heads = [("rbf_svc", {"c": 0.5})]
    monkeypatch.setattr(K, "LANDMARKS", 30)
    few = K.fit_kernels(rows, 2, heads)
    monkeypatch.setattr(K, "SUMS", 31**2)  # a fit at a time
    assert np.allclose(few.decision(1, x), K.fit_kernels(rows, 2, heads).decision(1, x), atol=1e-6)
    assert len(few.landmarks) == 30 and np.mean((few.decision(0, x)[:, 0] > 0) == (y == 1)) > 0.85


def platt(v, y):
    """Slope and offset at most likelihood for Platt's targets, by plain Newton steps with halving."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    f, p = np.column_stack([v, np.ones(len(v))]), np.zeros(2)
    loss = lambda q: (np.logaddexp(0, f @ q) - t * (f @ q)).sum()
    for _ in range(200):
        s = G.sigmoid(f @ p)
        step = np.linalg.solve((f.T * (s * (1 - s))) @ f + 1e-12 * np.eye(2), f.T @ (s - t))
        while loss(p - step) > loss(p) + 1e-13 and np.abs(step).max() > 1e-12:
            step /= 2
        p = p - step
    return p


def test_calibrated_svcs_equal_those_of_each_split(spark):
    x, y, target, fold, rows = table(spark)
    got = K.fit_calibrated(rows, 3, "calibrated_svc", [("calibrated_svc", {"c": 0.1}), ("calibrated_svc", {"c": 1.0})])
    for r in range(3):
        inside = target[:, r] >= 0
        z = scaled(x, inside)
        for h, c in enumerate((0.1, 1.0)):
            rates = []
            for k in range(3):
                fit, left = inside & (fold % 3 != k), inside & (fold % 3 == k)
                one = spark.createDataFrame([(z[i].tolist(), [int(y[i])]) for i in np.flatnonzero(fit)], "features array<double>, target array<int>")
                svc = G.fit(one, 1, [("linear_svc", {"c": c})], None)
                v = svc.decision(0, z)[:, 0]
                a, b = platt(v[left], y[left])
                rates.append(G.sigmoid(a * v + b))
            assert np.allclose(got.score(r, x)[:, h], np.mean(rates, axis=0), atol=1e-6)


def test_probabilities_of_the_kernel_machine(spark):
    x, y, target, fold, rows = table(spark, repeats=1)
    got = K.fit_calibrated(rows, 1, "rbf_svc", [("rbf_svc", {"c": 1.0})])
    inside = target[:, 0] >= 0
    z, out = scaled(x, inside), np.zeros(len(x))
    gamma = 1 / (3 * z[inside].var())
    for k in range(5):
        fit = inside & (fold % 5 != k)
        kernel = K.gaussian(z, z[fit], gamma)
        a, b = exact_svc(kernel[fit], y[fit], weights(y, fit, 1.0))
        mine = inside & (fold % 5 == k)
        out[mine] = (kernel @ a + b)[mine]
    slope, offset = platt(out[inside], y[inside])
    kernel = K.gaussian(z, z[inside], gamma)
    a, b = exact_svc(kernel[inside], y[inside], weights(y, inside, 1.0))
    assert np.abs(got.score(0, x)[:, 0] - G.sigmoid(slope * (kernel @ a + b) + offset)).max() < 5e-3


def test_perceptron_gradient_by_finite_differences():
    rng = np.random.default_rng(2)
    z, y, w = rng.normal(size=(20, 4)), rng.integers(0, 2, 20), rng.normal(size=4 * 5 + 5 + 5 + 1)
    whole = P.loss_and_gradient(w, z, y, 5)
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = 1e-6
        slope = (P.loss_and_gradient(w + e, z, y, 5)[0] - P.loss_and_gradient(w - e, z, y, 5)[0]) / 2e-6
        assert slope == pytest.approx(whole[1 + i], abs=1e-4)


def test_perceptrons_of_three_alphas_stop_by_held_out_rows(spark, monkeypatch):
    x, y, target, fold, rows = table(spark, n=200, repeats=2)
    heads = [("mlp", {"alpha": a}) for a in (1e-4, 1.0, 30.0)]
    got = P.fit(rows, 2, heads)
    scores = got.score(0, x)
    assert all(np.abs(scores[:, i] - scores[:, j]).max() > 1e-3 for i, j in ((0, 1), (1, 2)))
    test = target[:, 0] < 0
    assert np.mean((scores[test, 0] > 0.5) == (y[test] == 1)) > 0.8
    sizes = [np.abs(got.weights[0, h]).sum() for h in range(3)]
    assert sizes[0] > sizes[2]
    # the weights kept are those of the least held-out loss of all steps
    monkeypatch.setattr(P, "PASSES", 5)
    monkeypatch.setattr(P, "PATIENCE", 1)
    short = P.fit(rows, 2, heads[:1])
    assert np.abs(short.score(0, x) - scores[:, :1]).max() > 1e-3


def test_unknown_and_unconverged_heads_are_errors(spark, monkeypatch):
    _, _, _, _, rows = table(spark)
    for kind in ("rbf_svc", "no_such_head"):
        with pytest.raises(ValueError):
            G.fit(rows, 3, [(kind, {})])
    with pytest.raises(ValueError):
        H.fit_heads(rows, 3, [("no_such_head", {})])
    with pytest.raises(ValueError):
        H.fit_heads(rows.drop("fold"), 3, [("mlp", {})])
    monkeypatch.setattr(G, "PASSES", 2)
    with pytest.raises(G.Unconverged):
        G.fit(rows, 3, [("logistic_l2", {"c": 1.0})])
    monkeypatch.setattr(K, "PASSES", 3)
    with pytest.raises(G.Unconverged):
        K.fit_kernels(rows, 3, [("rbf_svc", {})])


def test_settings_run_their_own_heads(spark):
    rng = np.random.default_rng(1)
    cohort = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "patient_id int, label int")
    features = spark.createDataFrame([(i, (rng.normal(size=3) + (i % 3 == 0)).tolist()) for i in range(60)], "patient_id int, features array<double>")
    rows = [("a", "f", "logistic_l2", 1.0, None, None, None), ("b", "f", "logistic_en", 0.1, 0.8, None, None), ("c", "f", "rbf_svc", 1.0, None, "scale", None), ("d", "f", "calibrated_svc", 0.1, None, None, None), ("e", "f", "mlp", None, None, None, 0.01), ("g", "f", "logistic_en", 0.1, 0.2, None, None)]
    schema = "tag string, pooling string, model string, c double, l1_ratio double, gamma string, alpha double"
    got = H.batch_from_settings(spark.createDataFrame(rows, schema), {"f": features}, cohort, 2).collect()
    areas = {t: tuple(round(r.roc_auc, 6) for r in sorted(got, key=lambda r: r.repeat_id) if r.tag == t) for t in "abcdeg"}
    assert all(len(a) == 2 for a in areas.values()) and len(set(areas.values())) > 3
    with pytest.raises(ValueError):
        H.batch_from_settings(spark.createDataFrame([("x", "f", "no_such_head", 1.0, None, None, None)], schema), {"f": features}, cohort, 2)
    null = H.label_shuffle_null(features.join(cohort, "patient_id"), "patient_id % 4 <> 0", "calibrated_svc", {"c": 1.0}, 5).collect()
    assert null[0].n == 5 and 0 <= null[0].p <= 1


def test_one_head_by_its_registered_name(spark):
    x, y, _, _, rows = table(spark, n=40, repeats=1)
    df = H.with_vector(rows.select("patient_id", "label", "features"))
    for kind in H.HEADS:
        scores = H.fit_head(df, kind)[1](df).select("score", "label").collect()
        high = np.mean([r.score for r in scores if r.label == 1]) - np.mean([r.score for r in scores if r.label == 0])
        assert len(scores) == 40 and np.isfinite(high)
    with pytest.raises(ValueError):
        H.fit_head(df.drop("patient_id"), "calibrated_svc")
    

def test_repeated_fits_read_their_features_once_and_stacks_their_predictions(spark):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    counted = counted.asNondeterministic()  # neither moved nor dropped
    rows = spark.createDataFrame([(i, i % 2, float(i % 7)) for i in range(40)], "patient_id int, label int, v double")
    H.all_predictions(rows.select("patient_id", "label", F.array(counted("v")).alias("features")), [("logistic_l2", {"c": 1.0})], 3).count()
    assert read.value == 40
    preds = spark.createDataFrame([(r, i, 0.1 * (i % 5) + 0.2 * (i % 2)) for r in range(3) for i in range(40) if i % 3 == r], "repeat_id int, patient_id int, p double")
    cohort = rows.select("patient_id", "label", F.col("v").alias("age"), (F.col("label") * 0.0).alias("sex_code"))
    assert H.clinical_vs_stack(preds.select("repeat_id", "patient_id", counted("p").alias("prob")), cohort).count() == 3
    assert read.value == 80
