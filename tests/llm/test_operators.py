"""The ten operators against brute force, on small fixtures with every awkward case."""

import collections
import hashlib
import math
import pathlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vectrove.llm import bpe, exchange, jaccard, media, neighbours, packing, quality, quotes, substring, toxicity, warc
from vectrove.llm.components import components
from vectrove.llm.words import Memo

SCHEMA = "doc_id long, text string, id long, block string, hash string, v int"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "b", "h", 1) for i, t in zip(ids, texts)], SCHEMA)


PASSAGE = " ".join(f"w{i}" for i in range(60))
AWKWARD = [None, "", " \t\n", "one", "one two three", PASSAGE, f"start {PASSAGE} end", "x " * 200, "a\x0bb\x0cc\rd", "é " * 40 + PASSAGE[:120], " ".join(f"u{i}" for i in range(5000)), PASSAGE]


def words(text):
    return (text or "").encode().split()


def brute_substring(texts, size=35):
    seen = collections.Counter(tuple(w[i : i + size]) for t in texts for w in [words(t)] for i in range(len(w) - size + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [1000, 8 << 20])
def test_substring(spark, block_bytes):
    got = {r.doc_id: r for r in substring.substring_dedup(docs(spark, AWKWARD), block_bytes=block_bytes, with_text=True, carry=("id", "block")).collect()}
    for i, want in enumerate(brute_substring(AWKWARD)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == want
        assert got[i].carried.id == 7
    assert got[0].text is None and got[8].text == AWKWARD[8] and got[6].text.split() == ["start", "end"]
    assert [(x.start, x.end) for x in got[6].removed] == [(1, 61)]


def test_substring_repeats_and_empty(spark):
    twice = docs(spark, [PASSAGE, PASSAGE, "kept"], [1, 1, None])
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring.substring_dedup(twice).collect())
    assert got == [(0, 0), (1, 60), (1, 60)]
    assert substring.substring_dedup(docs(spark, [])).count() == 0


def test_exchange_keys():
    keys = np.array([[3, 1], [3, 2], [3, 1], [1, 9]], np.uint64)
    found, many = exchange.distinct(keys)
    assert many.tolist() == [1, 2, 1] and exchange.places(found, keys).tolist() == [1, 2, 1, 0]


def test_media(spark):
    got = {r.doc_id: r for r in media.media_columns(docs(spark, AWKWARD)).collect()}
    for i, t in enumerate(AWKWARD):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[5][1:] == got[11][1:] and got[0].feature == got[1].feature
    assert media.media_columns(docs(spark, [])).count() == 0
    assert media.media_columns(docs(spark, ["a", "a"], [None, None])).where("doc_id is null").count() == 2


def test_media_damage_is_found():
    png = media.to_png(media.padded(b"hello"))
    assert media.from_png(png) == media.padded(b"hello")
    with pytest.raises(ValueError):
        media.from_png(png[:-20] + b"\x00" + png[-19:])


def train_texts(n=120):
    good = [f"The river {i} runs past a mill and a small town, where {i % 7} people live. It is quiet there." for i in range(n)]
    bad = [("BUY!! NOW!! " * (3 + i % 5)) + f"{i}%%% $$$" for i in range(n // 2)]
    return good + bad, [1] * n + [0] * (n // 2)


def test_quality(spark):
    texts, y = train_texts()
    labels = spark.createDataFrame([(i, q, 1 - q) for i, q in enumerate(y)], "doc_id long, quality int, toxic int")
    d = docs(spark, [*texts, None, "", "word " * 30000], [*range(len(texts)), 1000, None, 1001])
    rows = quality.quality_scores(d, labels).collect()
    assert len(rows) == len(texts) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < len(texts)]
    assert held and all(r.predicted == y[r.doc_id] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert quality.quality_scores(docs(spark, []), labels).count() == 0
    assert {r.score for r in quality.quality_scores(d, labels.limit(0)).collect()} == {0.5}
    kept = quality.quality_filter(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < len(texts)} == {i for i, q in enumerate(y) if q}


def test_quality_sums_against_one_solve(spark):
    rng = np.random.default_rng(4)
    x, fold = rng.normal(size=(200, quality.WIDTH)), rng.integers(0, quality.FOLDS, 200)
    y = (x[:, 0] > 0).astype(int)
    sample = spark.createDataFrame([(r.tolist(), int(a), int(f)) for r, a, f in zip(x, y, fold)], "x array<double>, y int, fold int").repartition(7)
    middle, scale = np.zeros(quality.WIDTH), np.ones(quality.WIDTH)
    weights, points, values = quality.train(sample, middle, scale, 1.0)
    z = quality.fourier(x, middle, scale)
    for k, w in enumerate(weights):  # the last is of all rows
        mine = fold != k
        want = np.linalg.solve(z[mine].T @ z[mine] + np.eye(z.shape[1]), z[mine].T @ y[mine])
        assert np.allclose(w, want, atol=1e-6)
    assert (np.diff(points) > 0).all() and (np.diff(values) >= 0).all()


def test_labels_that_clash_count_as_one(spark):
    texts, y = train_texts()
    d = docs(spark, texts)
    plain = [(i, q, 1 - q) for i, q in enumerate(y)]
    clash = [(i, 0, 0) for i, q in enumerate(y) if q and i % 3 == 0]
    for run in (quality.quality_scores, toxicity.toxicity_scores):
        tables = [spark.createDataFrame(rows, "doc_id long, quality int, toxic int") for rows in (plain, plain + plain[::2])]
        one, two = ({r.doc_id: r.score for r in run(d, t).collect()} for t in tables)
        assert one == two
    both = {r.doc_id: r.score for r in quality.quality_scores(d, spark.createDataFrame(clash + plain, "doc_id long, quality int, toxic int")).collect()}
    assert both == {r.doc_id: r.score for r in quality.quality_scores(d, spark.createDataFrame(plain, "doc_id long, quality int, toxic int")).collect()}


def test_embeddings_of_repeated_and_null_ids_and_many_copies(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=24)
    near = base + rng.normal(size=(700, 24)) * 0.01
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)] + [(3, near[3].tolist()), (None, near[5].tolist()), (9000, rng.normal(size=24).tolist())], "vec_id long, embedding array<double>")
    got = neighbours.embedding_dedup(rows, cell=100, side=64).collect()
    assert len(got) == 703
    assert {r.n_links for r in got if r.vec_id is not None and r.vec_id < 700} == {700} and {r.component_id for r in got if r.vec_id is not None and r.vec_id < 700} == {0}
    assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)] and [(r.n_links, r.component_id) for r in got if r.vec_id == 9000] == [(0, 9000)]


def test_isotonic():
    assert quality.isotonic(np.array([0.0, 0.5, 0.2, 1.0]), np.array([1.0, 1, 1, 1])).tolist() == [0.0, 0.35, 0.35, 1.0]


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, 40)) for _ in range(240)]
    y = [int(i % 4 == 0) for i in range(240)]
    texts = [f"{t[: len(t) // 2]} grunk{'lo' if i % 8 else 'ta'} {t[len(t) // 2 :]}" if k else t for i, (t, k) in enumerate(zip(texts, y))]
    labels = spark.createDataFrame([(i, 1, k) for i, k in enumerate(y)], "doc_id long, quality int, toxic int")
    d = docs(spark, [*texts, None, "", "plain " * 30000 + "grunklo"], [*range(240), 1000, None, 1001])
    rows = toxicity.toxicity_scores(d, labels).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 243 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    assert by[1001].predicted == 1 and by[1000].score == by[None].score and by[1000].predicted == 0
    assert toxicity.toxicity_scores(docs(spark, []), labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(d, labels.limit(0)).collect()} == {0.5}
    assert 1001 not in {r.doc_id for r in toxicity.toxicity_filter(d, labels).collect()}


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    texts = [f"word{i % 97} word{i % 89} word{i % 83}" + (" grunk" if i % 2 else "") for i in range(9000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(9000)] + [(20_000 + i, 1) for i in range(50)], "doc_id int, toxic int")
    seen, learned = [], toxicity.learned
    monkeypatch.setattr(toxicity, "learned", lambda blocks, n: seen.append((blocks.collect(), n)) or learned(blocks, n))
    rows = toxicity.toxicity_scores(docs(spark, texts + ["no label"], [*range(9000), 50_000]), labels).collect()
    (blocks, n), = seen
    allowed = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 != 1]
    y = np.concatenate([np.frombuffer(r.y, np.int8) for r in blocks])
    assert len(blocks) > 1 and len(y) == n.sum() == len(allowed) and y.sum() == n[:, 1].sum() == sum(i % 2 for i in allowed)
    assert np.frombuffer(b"".join(r.met for r in blocks), np.int32).reshape(-1, 2, 2, toxicity.BUCKETS).sum(axis=(0, 1))[:, zlib.crc32(b"grunk") % toxicity.BUCKETS].tolist()[1] == y.sum()
    assert np.mean([r.predicted == r.doc_id % 2 for r in rows if r.doc_id < 9000 and r.held_out]) > 0.99


def test_toxicity_in_many_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{k}" for k in rng.integers(0, 300, 30)) + (" grunklo" if i % 4 == 0 else "") for i in range(600)]
    monkeypatch.setattr(toxicity, "ROWS", 50)
    rows = toxicity.toxicity_scores(docs(spark, texts), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in rows if r.held_out]) > 0.95


def test_toxicity_tasks_hold_one_block_at_a_time(spark, monkeypatch):
    key, batches, summed = "spark.sql.execution.arrow.maxRecordsPerBatch", [], toxicity.summed
    largest = lambda found: (pa.RecordBatch.from_pydict({"n": [batch.num_rows]}) for batch in found)
    monkeypatch.setattr(toxicity, "summed", lambda parts: batches.append(max(r.n for r in spark.range(0, 40, 1, 2).mapInArrow(largest, "n long").collect())) or summed(parts))
    monkeypatch.setattr(toxicity, "ROWS", 50)
    before = spark.conf.get(key)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    toxicity.toxicity_scores(docs(spark, [f"word{i % 50}" + " grunk" * (i % 2) for i in range(300)]), labels).collect()
    assert len(batches) == 1 + toxicity.PASSES and set(batches) == {1} and spark.conf.get(key) == before


def test_scoring_empties_the_cache_of_another_operator():
    other = Memo(len, 10)
    assert other.use()["word"] == 4
    toxicity.Scorer(toxicity.Net())(["word"])
    assert not other


def test_buckets_are_hashes_of_words_and_runs():
    words = ["a", "é", "ab", "abc", "grunklo", "日本語", "." * 300]
    marked = [b"<" + w.encode() + b">" for w in words]
    want = [[zlib.crc32(w.encode()), *(zlib.crc32(m[i : i + 4]) for i in range(max(1, len(m) - 3)))] for w, m in zip(words, marked)]
    ids, sizes = toxicity.buckets(words)
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [v % toxicity.BUCKETS for x in want for v in x]


def brute_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def shingle_set(text, n):
    w = words((text or "").encode().lower().decode())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def near_texts():
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(150)]
    out = []
    for k in range(40):
        w = base.copy()
        for p in rng.integers(0, 150, k % 9):
            w[p] = f"new{k}{p}"
        out.append(" ".join(w))
    return [*AWKWARD, *out, "One  two THREE", *(" ".join(rng.choice(base, 12)) for _ in range(60))]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, n, percent):
    texts = near_texts()
    sets = [shingle_set(t, n) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = brute_components(len(texts), links)
    got = {r.doc_id: r for r in jaccard.ngram_jaccard_join(docs(spark, texts), n, percent, block_bytes=4000).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == [(len(s), c) for s, c in zip(sets, want)]


def test_jaccard_edges(spark):
    assert jaccard.ngram_jaccard_join(docs(spark, [])).count() == 0
    got = jaccard.ngram_jaccard_join(docs(spark, ["a b", "A B", None, "a b"], [3, None, 9, 3])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 1, 3), (3, 1, 3), (3, 1, 3), (9, 0, 9)]


def test_jaccard_levels_are_safe():
    sizes = jaccard.Sizes(85)
    rng = np.random.default_rng(0)
    for n in [*range(1, 60), 300, 2000]:
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        levels = jaccard.part_keys(s, sizes)
        assert len(levels) >= 2 and all(need >= 1 for _, need in levels)
        k = sizes.of(n)
        assert sizes.low[k] <= n < sizes.low[k + 1] and 100 * n // 85 < sizes.low[k + 2] if k + 2 < len(sizes.low) else True


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (None, 3)]
    want = brute_components(500, [e for e in edges if None not in e])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want[x] for e in edges if None not in e and e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("span", [200, 8 << 20])
def test_warc(spark, span):
    rows = [(1, "http://a/ x", "<p>hi</p>"), (2, "http://b", "<p>hi</p>"), (3, None, None), (4, "u", ""), (-5, "http://é/", "long " * 40000), (6, "z", "\x1f\x08 odd"), (7, "z%41", "<p>hi</p>"), (None, "n", "only"), (None, "n", "<p>hi</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = sorted(warc.warc_round_trip(pages, span=span).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert len(got) == len(rows)
    for i, url, html in rows[:7]:
        raw = (html or "").encode()
        best = max(p for p, _, h in rows[:7] if (h or "") == (html or ""))
        assert (by[i].url, by[i].payload_bytes, by[i].payload_digest) == (url, len(raw), warc.digest_of(raw))
        assert (by[i].record_type, by[i].refers_to) == (("response", None) if i == best else ("revisit", best))
        assert by[i].payload == (raw if i == best else None)
    assert [(r.record_type, r.refers_to) for r in got[-2:]] == [("response", None), ("revisit", 7)]
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    near = base[:20] + rng.normal(size=(20, 16)) * 0.08
    vectors = [*base.tolist(), *near.tolist(), base[0].tolist(), (base[1] * 3).tolist(), [0.0] * 16, None, [], [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    n = len(vectors)
    ok = [i for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)]
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(a, b) for a in ok for b in ok if b < a and len(vectors[a]) == len(vectors[b]) and cos(vectors[a], vectors[b]) >= 0.95]
    count = collections.Counter(x for e in links for x in e)
    want = brute_components(n, links)
    rows = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, node int, many int")
    got = {r.vec_id: r for r in neighbours.embedding_dedup(rows, cell=20, side=7).collect()}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(n)] == [(count[i], want[i], want[i] == i) for i in range(n)]
    assert neighbours.embedding_dedup(rows.limit(0)).count() == 0


RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["  a  b\n\n c ", "x" * 1500 + "é" * 900, "ab\t c  d  e\x1c f\x85 g　h", "don't we'll  I'm\r\n  ok ", "<|endoftext|> hi", "日本語 テキスト 123 4a5b ...!?", "a.b, c|d. e,, F."]


def test_bpe(spark):
    import tiktoken

    codec = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = [*AWKWARD, *ODD]
    out = bpe.bpe_encode(docs(spark, texts), RANKS, public_tokenizers.PATTERN, with_ids=True)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.bytes) for r in bpe.bpe_decode(out, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(back[i].decode() == (t or "") for i, t in enumerate(texts))
    assert bpe.bpe_encode(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_many_and_of_very_long_words():
    import random

    import tiktoken

    codec = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    word = lambda n, letters="etaoinshrdlucmfwypvbgkjqxz": "".join(rng.choices(letters, k=n))
    texts = [
        " ".join(word(60) for _ in range(10_000)), " ".join(word(900) for _ in range(150)), word(100_000, "ACGT"), "a" * 100_001, "=" * 70_001 + "ab" * 5001, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(5000)),
        word(2000), " ".join(word(30) for _ in range(9_000)),
    ]
    ids, many = codec.encode(texts)
    assert ids.tolist() == [x for t in texts for x in encoding.encode_ordinary(t)] and len(many) == len(texts)
    assert [b"".join(p).decode() for p in codec.decode(ids, many)] == texts


def test_bpe_by_ranks_that_do_not_grow_with_their_parts(tmp_path):
    import base64

    import tiktoken

    # fixed values: "bcd" has a lower rank than its part "bc" and is not reached from its letters
    names = [bytes([i]) for i in range(256)] + [b"cd", b"bcd", b"bc", b"ab", b"abc", b"dd", b"bcdd", b"dda"]
    for order in (names, names[:256] + [b"bcd", b"bc", b"cd", b"cdab", b"ab", b"bcda", b"da", b"dab"]):
        ranks = {t: r for r, t in enumerate(order)}
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        codec = bpe.Codec(str(path), public_tokenizers.PATTERN)
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        rng = np.random.default_rng(2)
        texts = [" ".join("".join("abcd"[i] for i in rng.integers(0, 4, n)) for n in rng.integers(1, 14, 300))]
        assert codec.encode(texts)[0].tolist() == encoding.encode_ordinary(texts[0])


def test_known_pieces_do_not_depend_on_what_was_met(monkeypatch):
    from vectrove.llm import pieces

    codec = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
    texts = [t or "" for t in [*AWKWARD, *ODD]]
    whole = [codec.encode([t])[0].tolist() for t in texts]
    monkeypatch.setattr(pieces, "PIECES", 3)
    assert [codec.encode([t])[0].tolist() for t in reversed(texts)] == whole[::-1]
    for t in texts:
        assert "".join(pieces.spelled(k) for k in pieces.keys(t)) == t
        assert [pieces.spelled(pieces.named(p)) for p in t.split(" ") if p] == [p for p in t.split(" ") if p]


def test_repeated_rows_and_null_ids_are_encoded_and_packed(spark):
    rows = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 5), (1, "other text", 5), (None, "no id", 5), (None, None, 5)], "doc_id long, text string, length int")
    made = bpe.bpe_encode(rows, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in made) == [(0, 0), (0, 2), (1, 2), (1, 3), (1, 3)]
    packed = packing.pack(rows, JSON, public_tokenizers.PATTERN, size=8).collect()
    assert sorted((r.doc_id or 0, r.length) for r in packed) == [(0, 1), (0, 3), (1, 3), (1, 4), (1, 4)] and len({(r.sequence_id, r.offset) for r in packed}) == 5


def least_sequences(lengths, size):
    """Fewest sequences for these lengths, by trying all."""
    best = len(lengths)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for k in {f: k for k, f in enumerate(free) if f >= lengths[i]}.values():
            place(i + 1, free[:k] + (free[k] - lengths[i],) + free[k + 1 :])
        place(i + 1, (*free, size - lengths[i]))

    lengths = sorted(lengths, reverse=True)
    place(0, ())
    return best


def test_patterns_against_the_optimum():
    rng = np.random.default_rng(9)
    more = []
    for _ in range(25):
        lengths = rng.integers(1, 31, 11).tolist()
        more.append(sum(n for _, n in packing.fill(collections.Counter(lengths), 30)) - least_sequences(lengths, 30))
    assert set(more) <= {0, 1} and sum(more) <= 1


def test_patterns_may_leave_tokens_free():
    for counts, most in (({700: 1000}, 500), ({1500: 500, 400: 500}, 500), ({900: 300, 800: 300, 300: 200}, 300), ({100: 1000}, 50)):
        assert sum(n for _, n in packing.fill(counts, 2048)) == most
        assert sum(n for _, n in packing.fit_patterns(counts, 2048, 2048)) >= 0.7 * most  # not by best fit
    assert packing.fit_patterns({}, 2048, 1) == [] and packing.fill({}, 2048) == []


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(JSON)
    texts = [*AWKWARD, *ODD, "a <|endoftext|> hi", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y <|endof text|>", *(" ".join(f"w{j}" for j in range(i * 3)) for i in range(150))]
    rows = packing.pack(docs(spark, texts), JSON, public_tokenizers.PATTERN, size=256).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == 256 or k == 0
            at += r.length
        assert at == len(ids) and (len(ids) > 256 or len(pieces[i]) == 1)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 256
    bound = -(-sum(r.length for r in rows) // 256)
    assert len(sequences) <= bound * 1.01 + 1
    assert packing.pack(docs(spark, []), JSON, public_tokenizers.PATTERN).count() == 0


def test_plan_places_every_rank():
    rng = np.random.default_rng(4)
    counts = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 101), 60, replace=False), rng.integers(1, 400, 60))}
    plan = packing.make_plan(counts, 100)
    used = collections.defaultdict(int)
    for length, rows in plan.items():
        ranks = np.r_[rows[:, 0], counts[length]]
        assert ranks[0] == 0 and (np.diff(ranks) > 0).all()
        for (first, sequence, offset, times), last in zip(rows, ranks[1:]):
            for r in range(last - first):
                used[(sequence + r // times, offset + r % times * length)] += 1
    assert all(v == 1 for v in used.values()) and len(used) == sum(counts.values())


def test_quotes(spark):
    rows = [
        ("c", 0, "user", "Hello  there\nfriend"), ("c", 1, "bot", "> hello there\n> FRIEND\nGood day"), ("c", 2, "user", "> > Hello there\n> > friend\n> Good day\nBye"), ("c", 3, "bot", ">> hello there friend\nback to the top"),
        ("c", 4, "user", "> never said\nlost"), ("c", 5, "user", None), ("c", 6, "user", "> \n"), (None, 1, "user", "alone"), (None, 2, "bot", "> alone\nyes"), ("d", 0, "user", "same"), ("d", 1, "user", "same"), ("d", 2, "bot", "> same\nthird"),
    ]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn int, role string, text string, hash int")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(d).collect()}
    link = {k: (r.reply_to, r.thread, r.n_quotes, r.text) for k, r in got.items()}
    assert link[("c", 1)] == (0, 0, 1, "Good day") and link[("c", 2)] == (1, 0, 2, "Bye") and link[("c", 3)] == (0, 0, 1, "back to the top")
    assert link[("c", 4)] == (None, 4, 1, "lost") and link[("c", 5)] == (None, 5, 0, "") and link[("c", 6)][0] is None
    assert link[(None, 2)] == (1, 1, 1, "yes") and link[("d", 2)][0] == 1 and got[("d", 2)].position == 3
    assert got[("c", 1)].formatted == "<|bot|>\nGood day\n"
    assert quotes.link_quotes(d.limit(0)).count() == 0
    assert quotes.link_quotes(d.where("turn = 0").unionByName(d.where("turn = 0"))).count() == 4


def test_quotes_round_trip(spark, sf_dir):
    plain = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(quotes.with_quotes(plain)).collect()}
    for r in plain.collect():
        g = got[(r.conv_id, r.turn)]
        assert (g.text, g.reply_to) == (r.text, r.turn - 1 if r.turn else None)


def brute_links(rows):
    """(conv_id, turn) to reply_to, by comparing each quote with all earlier messages."""
    even = lambda text: " ".join(text.lower().split())

    def read(text):
        own, found = [[]], []
        for line in text.split("\n"):
            level = line[: len(line) - len(line.lstrip("> \t"))].count(">") if line.startswith(">") else 0
            if not level:
                own[-1].append(line)
                found.append((0, []))
                continue
            if own[-1]:
                own.append([])
            if not found or found[-1][0] != level:
                found.append((level, []))
            found[-1][1].append(line.lstrip("> \t"))
        texts = {even(" ".join(sum(own, [])))} | {even(line) for part in own for line in part} | {even(" ".join(part)) for part in own} | {even(p) for part in own for p in re.split(r"\n\s*\n", "\n".join(part))}
        return texts - {""}, [(level, lines) for level, lines in found if level]

    seen, out = {k: read(text) for k, text in rows.items()}, {}
    for (c, t), (_, passages) in seen.items():
        finds = []
        for level, lines in passages:
            earlier = [u for d, u in seen if d == c and u < t]
            each = {even(line) for line in lines} - {""}
            hits = [u for u in earlier if even(" ".join(lines)) in seen[(c, u)][0]] or [u for u in earlier if each and each <= seen[(c, u)][0]]
            finds += [(-level, max(hits))] if hits else []
        out[(c, t)] = max(finds)[1] if finds else None
    return out


def test_partial_and_interleaved_quotes(spark):
    import random

    base = "alpha one\nbeta two\n\ngamma three\ndelta four\nyes"
    rows = {
        ("a", 0): base, ("a", 1): "other\nyes", ("a", 2): "> beta two\na line", ("a", 3): "> gamma three\n> delta four\n> yes\na paragraph", ("a", 4): "> beta two\n>\n> gamma three\nfirst\n> delta four\nsecond",
        ("a", 5): "> first\n> second\nof a split text", ("a", 6): "> yes\nlatest", ("a", 7): "> yes\n> nowhere\nnone", ("a", 8): "> beta\nhalf a line", (None, 0): base, (None, 1): "> delta four\n> alpha one\nmixed",
    }
    rng = random.Random(5)
    for c in ("r", "s", None):
        for t in range(2, 40):
            rows[(c, t)] = "\n".join(rng.choice(("", "", "> ", "> > ")) + rng.choice(("alpha one", "beta two", "gamma", "delta", "eps", "yes", "")) for _ in range(rng.randrange(1, 7)))
    d = spark.createDataFrame([(c, t, "user", text) for (c, t), text in rows.items()], "conv_id string, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.link_quotes(d).collect()}
    assert [got[("a", t)] for t in range(9)] == [None, None, 0, 0, 0, 4, 1, None, None] and got[(None, 1)] == 0
    assert got == brute_links(rows)


def test_with_quotes_makes_partial_and_interleaved_quotes(spark, sf_dir):
    plain = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    made = {(r.conv_id, r.turn): r.text for r in quotes.with_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()}
    passages = {k: [p for level, p in quotes.parse(text)[1] if level == 1] for k, text in made.items()}
    assert any(len(p) == 2 and "\n".join(p) == plain[(c, t - 1)] for (c, t), p in passages.items())
    assert any(len(p) == 1 and p[0] != plain[(c, t - 1)] for (c, t), p in passages.items())


def test_new_pieces_go_to_the_tokenizer_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, plain = packing.Encoder(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    texts = ["one, two. three's 4x (five)! " * 3, " lead", "a  b \n c\n\nd\t e ", "é漢字!? ünï", "", "x" * 3000 + ", y", "they'll'll 　wide\xa0space", "two. <|endoftext|> two.", "tail\n"]
    for mine in (texts, texts[::-1], texts):  # from the tokenizer, then from the store
        ids, many = encode(mine)
        want = [plain.encode(t, add_special_tokens=False).ids for t in mine]
        assert many.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    fresh = packing.Encoder(path, public_tokenizers.PATTERN)
    fresh(["go word, word. word, stop!"])
    assert len(fresh.known.at) == 4  # pieces alone, not their matches too


def test_embeddings_are_not_copied_to_the_cells_in_reach(spark):
    x = np.random.default_rng(4).normal(size=(3000, 16))  # no structure: nearly all cells are in reach of each vector
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(np.r_[x, x[:50] + 0.01].astype(np.float32).tolist())], "vec_id long, embedding array<float>")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    known = {p for p in pathlib.Path(folder).rglob("*.parquet")}
    got = {r.vec_id: r for r in neighbours.embedding_dedup(rows, cell=50, side=20).collect()}
    assert all(got[i].n_links >= 1 and got[3000 + i].component_id <= i for i in range(50))
    assert sum(r.n_links for r in got.values()) % 2 == 0
    written = sum(p.stat().st_size for p in pathlib.Path(folder).rglob("*.parquet") if p not in known and "vector" in pq.ParquetFile(p).schema_arrow.names)
    assert written < 3 * 3050 * (16 * 4 + 48)  # each vector once, with its digest; files have a head and a foot


def test_jaccard_rare_keys_and_stars(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SIDE", 8)  # so that components are cut into stars or blocks
    texts = near_texts()
    sets = [shingle_set(t, 4) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in jaccard.ngram_jaccard_join(docs(spark, texts), 4, 85, block_bytes=4000).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(len(texts), links)


def test_jaccard_chains_of_shared_keys_are_not_sent_to_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SIDE", 16)
    chain = spark.createDataFrame([(i, 100, [i, i + 1]) for i in range(800)], "node long, n long, keys array<long>")
    met = jaccard.meetings(chain).collect()
    assert sum(r.blocks for r in met) <= 3 * 800  # as one component each set would go to 50 blocks
    groups = collections.defaultdict(set)
    for r in met:
        groups[r.grp].add(r.node)
    assert all(any({i, i + 1} <= g for g in groups.values()) for i in range(799))


def test_jaccard_keeps_the_rarest_keys(spark):
    table = pa.table({"id": [b"x"], "text": [" ".join(f"w{i}" for i in range(200)).encode()]})
    block = jaccard.Block(table, 4, 85)
    found = np.unique(block.keys)
    (kept,) = block.candidates(np.full(len(found), 9, np.uint8)).values()
    assert [len(k) for k in kept] == [len(key) - need + 1 for _, key, need in block.levels]
    frequent = found[::2]
    (kept,) = block.candidates(np.where(np.isin(found, frequent), 200, 2).astype(np.uint8)).values()
    for k, (_, key, need) in zip(kept, block.levels):
        assert len(k) == len(key) - need + 1 and np.isin(k, frequent).sum() == max(0, len(k) - (~np.isin(key, frequent)).sum())
