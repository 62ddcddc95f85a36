"""Weighted bootstraps, permutations over blocks and exact rank tests, against brute force."""

import itertools
import math
from hashlib import md5

import numpy as np
import pytest

from vectrove.operators import replicates as R
from vectrove.operators import tests_of_hypotheses as H
from vectrove.operators.joins import assign_prototypes
from vectrove.operators.ranks import numbered


def drawn(key, n, seed):
    """Weights one by one: Poisson numbers of mean 1 by inversion."""
    out = []
    for r in range(n):
        u = int(md5(f"{key}|{r // 4}|{seed}".encode()).hexdigest()[8 * (r % 4) :][:8], 16)
        k, term, total = 0, math.exp(-1), math.exp(-1)
        while u >= round(2**32 * total) and k < len(R.STEPS):
            k += 1
            term /= k
            total += term
        out.append(k)
    return out


def test_weights_are_poisson_numbers():
    keys = [str(i) for i in range(300)]
    w = R.weights(keys, 10, 3)
    assert w.tolist() == [drawn(k, 10, 3) for k in keys]
    big = R.weights(keys, 2000, 1)
    assert abs(big.mean() - 1) < 0.01 and abs(big.var() - 1) < 0.02 and R.weights([], 5, 1).shape[1] == 5


def test_curves_and_means_against_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 150
    # a third of the rows has one score; some rows repeat, some have no label or score
    rows = [(i % 350, 5.0 if i % 3 == 0 else float(rng.integers(0, 60)) - (0.0 if i % 2 else 20.5), int(rng.integers(0, 2))) for i in range(500)]
    rows += [(900, None, 1), (901, float("nan"), 0), (902, 1.0, None), (None, -0.0, 1), (903, 0.0, 0)]
    df = spark.createDataFrame(rows, "k long, s double, label int").repartition(5)
    got = {r.replicate: r for r in R.weighted_curves(df, "s", "k", n, 7).collect()}
    means = {r.replicate: r.s for r in R.weighted_means(df, "s", "k", n, 7).collect()}
    scored = [(k, s, y) for k, s, y in rows if s is not None and s == s]
    every = np.array([drawn("" if k is None else k, n, 7) for k, _, _ in scored])
    s, y = np.array([s for _, s, _ in scored]), np.array([-1 if y is None else y for _, _, y in scored])
    for r in range(n):
        w = every[:, r]
        assert means[r] == pytest.approx((w * s).sum() / w.sum(), abs=1e-12)
        pos, neg = w * (y == 1), w * (y == 0)
        p, q = pos.sum(), neg.sum()
        won = sum(a * (neg[s < x].sum() + neg[s == x].sum() / 2) for a, x in zip(pos, s)) / (p * q)
        cuts = sorted({x for x, a in zip(s, pos + neg) if a})
        rates = {x: (pos[s >= x].sum() / p, neg[s >= x].sum() / q) for x in cuts}
        ap = sum(pos[s == x].sum() / p * pos[s >= x].sum() / (pos + neg)[s >= x].sum() for x in cuts)
        best = max(cuts, key=lambda x: (rates[x][0] - rates[x][1], x))
        assert (got[r].roc_auc, got[r].pr_auc) == pytest.approx((won, ap), abs=1e-12)
        assert got[r].threshold == best and (got[r].sensitivity, got[r].specificity) == pytest.approx((rates[best][0], 1 - rates[best][1]), abs=1e-12)


def test_curves_of_little_or_nothing(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (2, 2.0, 1)], "k long, s double, label int")
    assert R.weighted_curves(df, "s", "k", 20, 1).count() == 0  # one class
    assert R.weighted_curves(df.limit(0), "s", "k", 20, 1).count() == 0
    assert R.weighted_means(df.limit(0), "s", "k", 20, 1).count() == 0
    empty = H.weighted_bootstrap_metric(df.limit(0), "s", "k", 20, 1).first()
    assert empty.n_valid == 0 and empty.roc_auc_mid is None


def test_weighted_intervals_are_those_of_drawing_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.normal() + y), y) for i, y in enumerate([0, 1] * 200)]
    df = spark.createDataFrame(rows, "k long, s double, label int")
    a, b = H.weighted_bootstrap_metric(df, "s", "k", 600, 5).first(), H.bootstrap_metric(df, "s", "k", 600, 5).first()
    assert (a.roc_auc_low, a.roc_auc_mid, a.roc_auc_high) == pytest.approx((b.roc_auc_low, b.roc_auc_mid, b.roc_auc_high), abs=0.012)
    a, b = H.weighted_mean_ci(df, "s", "k", 600, 5).first(), H.bootstrap_mean_ci(df, "s", "k", 600, 5).first()
    assert (a.mean, a.s_low, a.s_high) == pytest.approx((b.mean, b.s_low, b.s_high), abs=0.03)


def test_places_dealt_to_blocks():
    sizes = np.array([5, 0, 7, 1, 20])
    k = np.array([R.dealt(sizes, b, 11, 4000, 2) for b in range(5)])
    assert (k.sum(0) == 11).all() and (k >= 0).all() and (k <= sizes[:, None]).all()
    share = sizes / sizes.sum()
    assert np.allclose(k.mean(1), 11 * share, atol=0.1)
    assert np.allclose(k.var(1), 11 * share * (1 - share) * (33 - 11) / 32, atol=0.25)


def test_permutations_over_blocks(spark):
    values, labels = [1.0, 2.0, 4.0, 8.0, 16.0, 3.0, 5.0, 9.0, 7.5], [0, 0, 0, 1, 1, 0, 1, 0, 1]
    true = np.mean([v for v, y in zip(values, labels) if y]) - np.mean([v for v, y in zip(values, labels) if not y])
    all_ = [abs(np.mean(c) - (sum(values) - sum(c)) / 5) >= abs(true) - 1e-12 for c in itertools.combinations(values, 4)]
    old = R.ROWS
    try:
        for R.ROWS in (2, 256):  # several blocks and one
            df = spark.createDataFrame(list(zip(values, labels)), "v double, label int").repartition(3)
            got = R.permutation_split(df, "v", 20000, 1).first()
            assert got.difference == pytest.approx(true) and got.p == pytest.approx(np.mean(all_), abs=0.015)
    finally:
        R.ROWS = old
    few = R.permutation_split(spark.createDataFrame([(1.0, 1), (2.0, 0), (None, 0), (3.0, None), (float("nan"), 1)], "v double, label int"), "v", 50, 1).first()
    assert few.difference == -1.0 and math.isnan(few.p)
    none = R.permutation_split(spark.createDataFrame([], "v double, label int"), "v", 50, 1).first()
    assert none.difference is None and math.isnan(none.p)


def test_exact_counts_are_those_of_enumeration():
    for m, n in ((1, 1), (2, 5), (4, 4), (5, 7), (8, 4)):
        us = [sum(c) - m * (m + 1) // 2 for c in itertools.combinations(range(1, m + n + 1), m)]
        assert H.rank_sum_counts(m, n).tolist() == [us.count(u) for u in range(m * n + 1)]
    for n in range(1, 13):
        sums = np.bincount([sum(i + 1 for i in range(n) if b >> i & 1) for b in range(2**n)])
        assert H.signed_rank_counts(n).tolist() == sums.tolist()
    assert H.rank_sum_counts(8, 3000).sum() == math.comb(3008, 8) and H.signed_rank_counts(50).sum() == 2**50


def test_exact_and_one_sided_p(spark):
    rows = [("a", x, int(x in (6.0, 9.0, 10.0))) for x in map(float, range(1, 11))] + [("b", float(i // 2), i % 2) for i in range(12)] + [("c", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, label int")
    us = [sum(c) - 6 for c in itertools.combinations(range(1, 11), 3)]
    want = {"greater": np.mean([u >= 19 for u in us]), "less": np.mean([u <= 19 for u in us])}
    want["two-sided"] = 2 * min(want.values())
    for alternative, p in want.items():
        got = {r.g: r for r in H.mann_whitney(df, "v", ["g"], alternative=alternative).collect()}
        assert got["a"].exact and got["a"].u == 19 and got["a"].p == pytest.approx(p, abs=1e-12)
        assert not got["b"].exact and 0 < got["b"].p <= 1  # ties
        assert not got["c"].exact and (got["c"].p is None or math.isnan(got["c"].p))  # no second class
    pairs = [("a", x) for x in (1.0, -2.0, 3.0, 4.0, 5.0)] + [("z", x) for x in (1.0, 0.0, 3.0, 4.0, 5.0)] + [(None, x) for x in (1.0, 1.0, 3.0, -4.0)]
    ws = [sum(i + 1 for i in range(5) if b >> i & 1) for b in range(32)]
    want = {"greater": np.mean([w >= 13 for w in ws]), "less": np.mean([w <= 13 for w in ws])}
    want["two-sided"] = 2 * min(want.values())
    ups = {}
    for alternative, p in want.items():
        got = {r.g: r for r in H.wilcoxon(spark.createDataFrame(pairs, "g string, d double"), "d", ["g"], alternative).collect()}
        assert got["a"].exact and got["a"].w_plus == 13 and got["a"].p == pytest.approx(p, abs=1e-12)
        assert not got["z"].exact and not got[None].exact  # a zero, a tie
        ups[alternative] = got["z"].p
    assert ups["greater"] < 0.5 < ups["less"] and ups["greater"] + ups["less"] == pytest.approx(1) and ups["two-sided"] == pytest.approx(2 * ups["greater"])
    with pytest.raises(ValueError):
        H.wilcoxon(df, "v", ["g"], "up")


def test_point_biserial_notes(spark):
    rows = [("a", 1.0, 0), ("a", 2.0, 1), ("a", 4.0, 1), ("a", None, 1), ("b", 1.0, 1), ("b", 2.0, 1), ("b", 3.0, 1), ("c", 1.0, 0), ("c", 1.0, 1), ("c", 1.0, 1), ("d", 1.0, 1), ("e", 0.0, 0), ("e", 0.0, 0), ("e", 1.0, 1)]
    got = {r.g: r for r in H.point_biserial(spark.createDataFrame(rows, "g string, x double, label int"), "x", ["g"]).collect()}
    assert {g: r.note for g, r in got.items()} == {"a": "", "b": "single_class", "c": "x_constant", "d": "too_few_finite_pairs", "e": ""}
    assert got["a"].r == pytest.approx(np.corrcoef([0, 1, 1], [1, 2, 4])[0, 1]) and got["a"].n == 3 and got["b"].r is None
    assert got["e"].r == pytest.approx(1) and got["e"].p == pytest.approx(0, abs=1e-6)


def test_correlations_of_a_constant(spark):
    rows = [("a", 1.0, float(i)) for i in range(4)] + [("b", float(i), 2.0) for i in range(4)] + [("c", float(i), 8.0 - 2 * i) for i in range(4)]
    got = {r.g: r for r in H.correlations(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert (got["a"].pearson, got["a"].note) == (None, "x_constant") and got["b"].pearson is None
    assert (got["c"].pearson, got["c"].spearman) == pytest.approx((-1, -1))


def test_numbers_of_keys_that_are_not_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 4 == 0 else f"g{i % 3}", None if i == 7 else f"k{int(x):04d}") for i, x in enumerate(rng.permutation(400))]
    df = spark.createDataFrame(rows, "g string, k string").repartition(6)
    key = lambda k: (k is not None, k or "")
    assert [r.i for r in sorted(numbered(df, "k", "i").collect(), key=lambda r: key(r.k))] == list(range(400))
    got = numbered(df, "k", "i", ("g",)).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in got if r.g == g), key=lambda r: key(r.k))
        assert [r.i for r in mine] == list(range(len(mine))) and len(mine) == sum(x[0] == g for x in rows)
    pairs = df.selectExpr("named_struct('a', g is null, 'b', k) as s")
    assert sorted(r.i for r in numbered(pairs, "s", "i").collect()) == list(range(400))
    assert numbered(df.limit(0), "k", "i").count() == 0


def test_too_many_prototypes_are_an_error(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "k int, centroid array<double>")
    tokens = spark.createDataFrame([([1.0, 0.0],)], "embedding array<double>")
    assert assign_prototypes(tokens, rows, most=3).first().proto == 2
    with pytest.raises(ValueError):
        assign_prototypes(tokens, rows, most=2)


def picked(n, r, seed):
    """How often each of n rows is drawn in a replicate, draw by draw."""
    out = [0] * n
    for i in range(n):
        out[min(n - 1, math.floor(int(md5(f"{i}|{r}|{seed}".encode()).hexdigest()[:8], 16) / 4294967295.0 * n))] += 1
    return out


def test_draws_with_replacement_one_by_one_over_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "COUNTS", 500)  # several blocks of rows
    monkeypatch.setattr(R, "DRAWS", 70)  # several parts of a replicate
    rows = [(3 * i, i / 7, i % 3 if i % 3 < 2 else None) for i in range(250)]
    df = spark.createDataFrame(rows, "k long, s double, label int").repartition(5)
    got = {r.k: list(r._w) for r in R.drawn(df, "k", 6, 7).collect()}
    every = np.array([picked(250, r, 7) for r in range(6)]).T
    assert [got[3 * i] for i in range(250)] == every.tolist()
    for y in (0, 1):  # within classes, without the rows of none
        mine = [k for k, _, z in rows if z == y]
        got = {r.k: list(r._w) for r in R.drawn(df, "k", 6, 7, "label").where(f"label = {y}").collect()}
        assert [got[k] for k in mine] == np.array([picked(len(mine), r, 7) for r in range(6)]).T.tolist()
    assert R.drawn(df, "k", 6, 7, "label").where("label is null").count() == 0
    assert R.drawn(df.limit(0), "k", 6, 7).count() == 0


def test_areas_of_drawn_rows(spark):
    rows = [(i, float(i % 9), int(i % 9 + i % 4 > 5)) for i in range(120)]
    df = spark.createDataFrame(rows + [(500, None, 1)], "k long, s double, label int")
    got = {r.replicate: r for r in R.drawn_curves(df, "s", "k", 40, 7).collect()}
    s, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for r in range(40):
        w = np.array(picked(121, r, 7)[:120])  # the row without a score is drawn too
        pos, neg = w * (y == 1), w * (y == 0)
        won = sum(a * (neg[s < x].sum() + neg[s == x].sum() / 2) for a, x in zip(pos, s)) / (pos.sum() * neg.sum())
        assert got[r].roc_auc == pytest.approx(won, abs=1e-12)
    assert H.bootstrap_metric(df, "s", "k", 40, 7).first().n_valid == 40
    assert H.bootstrap_metric(df.limit(0), "s", "k", 40, 7).first().n_valid == 0


def test_means_of_drawn_rows(spark):
    rows = [(i, None if i % 10 == 3 else float(i % 17)) for i in range(90)]
    got = {r.replicate: r.v for r in R.drawn_means(spark.createDataFrame(rows, "k long, v double"), "v", "k", 20, 7).collect()}
    for r in range(20):
        w = picked(90, r, 7)
        has = [(a, v) for a, (_, v) in zip(w, rows) if v is not None]
        assert got[r] == pytest.approx(sum(a * v for a, v in has) / sum(a for a, _ in has), abs=1e-12)
    odd = R.drawn_means(spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, 2.0)], "k long, v double"), "v", "k", 20, 7).collect()
    assert {r.replicate for r in odd if r.v != r.v} == {r for r in range(20) if picked(3, r, 7)[0]}


def test_thresholds_of_rows_drawn_within_classes(spark):
    rows = [(i, float(i % 11), int(i % 11 + i % 5 > 6)) for i in range(130)]
    got = {r.replicate: r for r in R.drawn_curves(spark.createDataFrame(rows, "k long, s double, label int"), "s", "k", 20, 7, "label", "label").collect()}
    classes = [[s for _, s, y in rows if y == z] for z in (0, 1)]
    for r in range(20):
        neg, pos = ([(s, a) for s, a in zip(mine, picked(len(mine), r, 7)) if a] for mine in classes)
        rate = lambda some, x: sum(a for s, a in some if s >= x) / sum(a for _, a in some)
        best = max({s for s, _ in pos + neg}, key=lambda x: (rate(pos, x) - rate(neg, x), x))
        assert (got[r].threshold, got[r].youden) == (best, pytest.approx(rate(pos, best) - rate(neg, best), abs=1e-12))


def test_ordered_permutations_over_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(R, "KEYS", 30)
    monkeypatch.setattr(R, "SOME", 7)
    rows = [(f"k{i}" * (1 + 20 * (i % 50 == 0)), None if i % 9 == 4 else float(i % 31)) for i in range(140)]  # some keys longer than an md5 block
    df = spark.createDataFrame(rows, "k string, v double")
    for ones in (0, 1, 50, 140):
        got = {r.replicate: (r._s, r._c) for r in R.ordered_permutations(df, "v", "k", 20, 42, ones, 140).collect()}
        for r in range(20):
            first = [v for k, v in sorted(rows, key=lambda x: md5(f"{x[0]}|{r}|42".encode()).hexdigest())[:ones] if v is not None]
            assert got[r] == (sum(first), len(first))


def test_means_send_sums_of_blocks_and_numbers_are_laid_out_once(spark, monkeypatch):
    monkeypatch.setattr(R, "DRAWS", 70)
    monkeypatch.setattr(R, "drawn", None)  # a row never carries its draws to a mean
    rows = [(i, None if i % 9 == 0 else float(i)) for i in range(200)]
    found = R.drawn_means(spark.createDataFrame(rows, "k long, v double").repartition(3), "v", "k", 12, 7)
    got = {r.replicate: r.v for r in found.collect()}
    for r in range(12):
        picks = [min(199, int(int(md5(f"{i}|{r}|7".encode()).hexdigest()[:8], 16) / 4294967295 * 200)) for i in range(200)]
        assert got[r] == pytest.approx(np.mean([rows[p][1] for p in picks if rows[p][1] is not None]), abs=1e-12)
