"""The pipeline's stages on a small corpus with planted cases, and run() against brute force."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from vectrove.llm import quality, stages, toxicity

from .test_operators import brute_components, shingle_set, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def cut_windows(texts, size=35):
    """Texts without the words of windows that start at two places, by comparing all windows."""
    seen = collections.Counter(tuple(w[i : i + size]) for t in texts for w in [words(t)] for i in range(len(w) - size + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = {k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] + [len(t or "")]
        out.append(t[: starts[0]] + "".join(t[starts[k] : starts[k + 1]] for k in range(len(w)) if k not in gone) if gone else t)
    return out


def test_run_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(12)
    vocabulary = [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary, n)) + ". It is quiet there."
    good = [say(60 + int(i) % 30) for i in range(150)]
    texts = [f"{t} grunk{'lo' if i % 2 else 'ta'} here" if i % 5 == 0 else t for i, t in enumerate(good)]
    shared = say(50)
    texts += ["BUY!! NOW!! " * (3 + i % 5) + f"{i}%%% $$$" for i in range(70)] + [texts[1], texts[2] + " tail", texts[3].upper(), f"{say(20)} {shared}", f"{shared} {say(30)}", None, "", say(2500)]
    quality_of = [int(i < 150 or i >= 220) for i in range(len(texts))]
    toxic_of = [int(i < 150 and i % 5 == 0) for i in range(len(texts))]
    docs = as_docs(spark, enumerate(texts))
    labels = spark.createDataFrame([(i, q, x) for i, (q, x) in enumerate(zip(quality_of, toxic_of)) if i < 220], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    left = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.score >= 0.3}
    assert not left & set(range(150, 220)) and set(range(150)) <= left
    some = docs.where(docs.doc_id.isin(list(left)))
    left = sorted(r.doc_id for r in toxicity.toxicity_scores(some, labels).collect() if r.score < 0.7)
    assert not left or np.mean([toxic_of[i] for i in left if i < 150]) < 0.02
    sets = [shingle_set(texts[i], 5) for i in left]
    links = [(a, b) for a in range(len(left)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = brute_components(len(left), links)
    left = [i for k, i in enumerate(left) if root[k] == k]
    cut = dict(zip(left, cut_windows([texts[i] for i in left])))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in cut.items()}

    pieces = collections.defaultdict(list)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in sorted(rows, key=lambda r: r.piece):
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(left)
    for i, found in pieces.items():
        assert sum(r.length for r in found) == len(ids[i])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()) for r in found)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_stages_on_the_smallest_tables(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_copies", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.schema.fieldNames() == docs.columns and after.count() <= docs.count(), name


def test_stages_without_rows_and_with_clashing_columns(spark, sf_dir):
    rows = as_docs(spark, [(1, "some words in a row here"), (2, None), (None, ""), (2, None)])
    for name in ("hash", "id", "key", "block", "n", "name", "x", "score", "component_id", "text_md5"):
        rows = rows.withColumn(name, rows.n_chars)
    for stage_name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), sf_dir).count() == 0, stage_name
        out = stage(spark, rows, sf_dir)
        if stage_name != "packing":
            assert out.columns == rows.columns, stage_name
        assert out.count() <= 4
    assert stages.pack_sequences(spark, rows, sf_dir).count() == 4
    assert sorted(r.doc_id or 0 for r in stages.keep_one_of_near_copies(spark, rows, sf_dir).collect()) == [0, 1, 2]


def test_near_copies_of_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(200))
    lone, far = " ".join(f"x{i}" for i in range(80)), " ".join(f"y{i}" for i in range(80))
    rows = [(1, base), (4, base + " tail"), (4, lone), (5, far), (5, far + " end"), (5, far), (None, far + " more"), (None, "only here is this text")]
    kept = stages.keep_one_of_near_copies(spark, as_docs(spark, rows), "").collect()
    assert {(r.doc_id, r.text) for r in kept if r.doc_id != 5} == {(1, base), (4, lone), (None, "only here is this text")}
    assert [r.doc_id for r in kept].count(5) == 1


def test_near_copies_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(3, base), (1, base + " tail"), (2, base.upper()), (9, "other text of its own here"), (9, "other text of its own here"), (None, base), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.keep_one_of_near_copies(spark, docs, "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 5), (False, 6), (False, 9)]
    cut = {r.doc_id: r for r in stages.remove_repeated_passages(spark, docs, "").collect() if r.doc_id is not None}
    assert cut[1].text == "tail" and cut[1].n_chars == 4 and cut[5].text is None and cut[9].text == "other text of its own here"


def test_near_copies_end_in_a_small_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stages.keep_one_of_near_copies(spark, docs, sf_dir)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 4 and kept.count() < docs.count()
