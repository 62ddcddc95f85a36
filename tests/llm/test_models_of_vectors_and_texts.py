"""Whitening, language identification and hard negatives against brute force, with every awkward case."""

import collections
import math
import zlib

import numpy as np
import pytest

from vectrove.llm import language, negatives, whitening

VECTORS = "vec_id long, embedding array<float>, label int, id long, n int, row string, anchor string, x int"


def vectors(spark, rows):
    """(id, vector, label) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, label, 7, 1, "r", "a", 2) for i, v, label in rows], VECTORS)


def random_rows(n, d=6, seed=3, labels=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 0.3, (n, d)), 2).astype(np.float32)
    return [(i, [float(v) for v in x[i]], int(rng.integers(labels))) for i in range(n)]


BAD = [(900, None, 0), (901, [0.1] * 5 + [None], 0), (902, [0.1] * 5 + [float("nan")], 1), (903, [float("inf")] + [0.1] * 5, 1), (904, [], 2)]


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def test_whitening_against_exact_numbers(spark):
    rows = random_rows(120) + BAD + [(None, [0.5, 0.1, -0.2, 0.3, 0.25, -0.125], None), (7, [0.5] * 6, 1), (7, [0.5] * 6, 1)]
    got = whitening.whiten(vectors(spark, rows).repartition(5), components=8).collect()
    good = [(i, whole(v)) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(good), [sum(x[k] for _, x in good) for k in range(6)]
    assert len(got) == 6 * n and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4, 5, 6}
    deviations = collections.Counter((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in good)
    assert collections.Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == deviations
    x = np.array([x for _, x in good], float)
    centred = x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    want = centred @ u / np.sqrt(e)
    for k in range(6):
        mine = sorted(((r.vec_id is None, r.vec_id or 0), r.whitened) for r in got if r.component == k + 1)
        theirs = [sorted(((i is None, i or 0), s * w) for (i, _), w in zip(good, want[:, k])) for s in (1, -1)]
        assert any(all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(mine, t)) for t in theirs)
        assert all(abs(r.explained - e[k] / e.sum()) < 1e-12 for r in got if r.component == k + 1)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_whitening_of_large_numbers_few_rows_and_lengths(spark):
    big = [(1, [1e9, -3.5e8], 0), (2, [-2.5e9, 4e8], 0), (3, [7.0, 1e-3], 0)]
    got = whitening.whiten(vectors(spark, big)).collect()
    x = [whole(v) for _, v, _ in big]
    sums = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in got} == {i + 1: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert got[0].identity_error < 1e-6
    two = whitening.whiten(vectors(spark, [(1, [0.1, 0.2, 0.3], 0), (2, [0.3, 0.2, 0.1], 0), (3, [0.5], 0), (4, [1e30], 0)])).collect()
    assert {(r.vec_id, r.component, r.n) for r in two} == {(i, k, 2) for i in (1, 2) for k in (1, 2, 3)} | {(3, 1, 1)}
    assert sorted(abs(r.whitened) for r in two if r.whitened is not None) == pytest.approx([1, 1])
    assert [r.explained for r in two if r.vec_id == 3] == [None]
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, BAD)).count() == 0


def test_polarised_covariances_are_those_of_the_products(spark):
    rows = random_rows(50, 4)
    found = whitening.fit(whitening._vectors(vectors(spark, rows), "vec_id", "embedding", 1024.0, 100_000).select("x"), 4)[4]
    x = np.array([whole(v) for _, v, _ in rows], float)
    v = (found.vector * found.value) @ found.vector.T
    assert np.allclose(v, np.cov(x.T, bias=True), rtol=1e-12) and found.sums == x.sum(axis=0).astype(int).tolist()


def brute_negatives(rows, anchors, low=80, keep=5):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    by_id = lambda i: (i is None, i or 0)
    out = []
    for k, (i, v, label) in enumerate(good):
        if i is None or not anchors(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, (j, w, other) in enumerate(good) if m != k and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], by_id(s[1])))
        for p, positive, _ in [s for s in scored if s[2] == label][:keep]:
            fits = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= 100 * p][:keep]
            out += [(i, positive, r + 1, j, p, s) for r, (s, j, _) in enumerate(fits)]
    return collections.Counter(out)


@pytest.mark.parametrize("group,anchor_group", [(1_000_000, 8192), (40, 3)])
def test_hard_negatives(spark, group, anchor_group, monkeypatch):
    monkeypatch.setattr(negatives, "FEW", 30)
    same = [(1000 + i, [0.25, 0.5, 0.25, 0.0, 0.1, 0.1], i % 3) for i in range(60)]  # ties by the dozen
    rows = random_rows(150) + BAD + same + [(20, [0.3] * 6, None), (None, [0.25, 0.5, 0.25, 0.0, 0.1, 0.1], 1), (30, [0.2] * 6, 1), (30, [0.2] * 6, 1), (2000, [0.5], 0), (2001, [0.25], 0), (2002, [0.25], 1), (2010, [], 0), (2011, [], 0), (2012, [], 1)]
    got = negatives.hard_negatives(vectors(spark, rows).repartition(3), anchors="vec_id % 10 = 0", group=group, anchor_group=anchor_group).collect()
    assert collections.Counter(map(tuple, got)) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(vectors(spark, rows), anchors="false").count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(vectors(spark, [(1, [1e9], 0)]))


def test_residue_products_are_exact():
    rng = np.random.default_rng(1)
    for d, size in ((1, 2**24), (64, 200), (200, 2**20), (64, 510), (0, 1)):
        a, b = rng.integers(-size, size + 1, (5, d)), rng.integers(-size, size + 1, (7, d))
        a[0], b[0] = size, -size
        primes = negatives.moduli(d * size * size)
        assert (negatives.products(negatives.residues(a.astype(float), primes), negatives.residues(b.astype(float), primes), primes) == a @ b.T).all()
    assert all(negatives.WIDTH * (p // 2) ** 2 < 2**24 for p in negatives.moduli(2**50))


def kneser_ney(texts):
    """log2 of a letter after its context, by the definition, from dictionaries."""
    order = language.ORDER
    raw = collections.Counter()
    for t in texts:
        for w in language.letters(t):
            s = language.START + w + language.END
            raw.update(s[max(0, i + 1 - order) : i + 1] for i in range(1, len(s)))
    counts = {order: {g: n for g, n in raw.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        counts[k] = dict(collections.Counter(g[1:] for g in counts[k + 1])) | {g: n for g, n in raw.items() if len(g) == k}

    def p(h, c):
        k = len(h) + 1
        mine = {g: n for g, n in counts[k].items() if g[:-1] == h}
        lower = p(h[1:], c) if h else None
        if not mine:
            return lower
        n1, n2 = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 else 0.5
        total = sum(mine.values())
        return max(mine.get(h + c, 0) - d, 0) / total + d * len(mine) / total * (lower if h else 1 / (len(mine) + 1))

    def cost(word):
        s = language.START + word + language.END
        return -sum(math.log2(p(s[max(0, i + 1 - order) : i], s[i])) for i in range(1, len(s)))

    return cost


ENGLISH = ["The cat sat on the mat and the dog ran.", "A man in the house, the end!", "this is that, and these are those", "x", "the the the"]
GERMAN = ["Der Hund und die Katze sind nicht über das Haus gegangen.", "Ein Mann ist in dem Haus", "straße ÜBER größer und der die das"]


def test_kneser_ney_by_its_definition(spark):
    rows = [("en", t) for t in ENGLISH] + [("de", t) for t in GERMAN]
    model = language.train(spark.createDataFrame(rows, "lang string, text string").repartition(3), 6_000_000)
    words = ["the", "x", "haus", "übermut", "zzz", "a", "thethe", "Σ", "straßenhund"]
    assert model.langs == ["de", "en"]
    want = np.array([[f(w) for f in (kneser_ney(GERMAN), kneser_ney(ENGLISH))] for w in words])
    assert np.allclose(model.cost(words), want, rtol=1e-5)
    text = "the haus, the übermut 12"
    entropy, many = model.entropies([text, None, "12 !"])
    w = language.letters(text)
    assert np.allclose(entropy[0] * many[0], [sum(f(x) for x in w) for f in (kneser_ney(GERMAN), kneser_ney(ENGLISH))], rtol=1e-5)
    assert many.tolist() == [sum(len(x) + 1 for x in w), 0, 0]


def test_letters_are_one_distribution(spark):
    """The probabilities of all letters known, and of one unknown, after any context add up to 1."""
    model = language.train(spark.createDataFrame([("en", t) for t in ENGLISH], "lang string, text string"), 6_000_000)
    cost = lambda s: float(model.cost([s])[0, 0])
    known = sorted({c for t in ENGLISH for w in language.letters(t) for c in w})
    for prefix in ("", "t", "th", "the", "thea", "qqqq"):
        end = lambda w: cost(w)
        # p(c | prefix) = cost of prefix + c up to c: taken from words with and without an unknown end
        total = 2 ** -(end(prefix) - _bits_before(model, prefix))
        total += sum(2 ** -(_bits_before(model, prefix + c) - _bits_before(model, prefix)) for c in [*known, "一"])
        assert total == pytest.approx(1, abs=1e-4)


def _bits_before(model, prefix):
    """Bits of the letters of prefix, without the word's end."""
    if not prefix:
        return 0.0
    keys, size = language._points([language.START + prefix + language.END])
    full = float(model.cost([prefix])[0, 0])
    table = model.tables[0]
    s = language.START + prefix + language.END
    bits = table[4]
    for k in range(1, min(language.ORDER, len(s)) + 1):
        hit, value = model._found(table[0], table[1], language.keys([s[-k:]]))
        known, left = model._found(table[2], table[3], language.keys([s[-k:-1]]))
        bits = float(value[0]) if hit[0] else bits + (float(left[0]) if k > 1 and known[0] else 0.0)
    return full + bits


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, id long, out boolean, gram string, n int"
    en, de = "the cat and the dog are in the house with this man ", "der hund und die katze sind nicht in dem haus mit "
    texts = [(i, (en if i % 2 else de) * (1 + i % 3), "en" if i % 2 else "de") for i in range(200)]
    odd = [(300, None, "en"), (301, "", "de"), (302, "12 34 !", "en"), (303, "the dog", None), (304, "THE HOUSE", "en"), (None, de, "de"), (305, en * 3000, None), (306, "a" * 200_000, None), (1, en * 2, "en"), (307, "的", "zz"), (308, "中" * 5, None)]
    docs = spark.createDataFrame([(*r, 1, True, "g", 2) for r in texts + odd], schema)
    got = language.predict_language(docs).collect()
    assert len(got) == len(texts + odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang for i, _, lang in texts) and by[None].lang_pred == "de" and by[None].held_out
    assert [by[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and all(by[i].score == 0 and by[i].rejected for i in (300, 301, 302))
    assert [by[i].lang_pred for i in (303, 304, 305)] == ["en"] * 3 and by[306].lang_pred in ("de", "en", "zz")
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id == 1)[0][1:] == sorted((r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id == 1)[1][1:]
    none = language.predict_language(docs.where("lang is null")).collect()
    assert {r.lang_pred for r in none} == {"und"} and language.predict_language(docs.limit(0)).count() == 0
    one = language.predict_language(docs.where("lang = 'en'")).collect()
    assert {r.lang_pred for r in one if r.doc_id not in (300, 301, 302)} == {"en"}


def test_language_with_few_grams_and_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    for most in (6_000_000, 20_000):
        held = [r for r in language.predict_language(docs, most_grams=most).collect() if r.held_out]
        assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95


def test_all_grams_are_kept_unless_a_limit_is_given(spark):
    import inspect

    rows = spark.createDataFrame([("en", t) for t in ENGLISH], "lang string, text string")
    every, few = language.train(rows), language.train(rows, 60)
    n = language.probabilities(language.counted(rows)).where("p > 0").count()
    assert len(every.tables[0][0]) == n > len(few.tables[0][0])
    assert inspect.signature(language.predict_language).parameters["most_grams"].default is None
