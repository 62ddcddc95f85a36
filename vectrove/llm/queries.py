"""The registered queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, language, media, negatives, neighbours, packing, quality, quotes, substring, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"), window=35)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.7)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.embedding_dedup(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=2048)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.link_quotes(quotes.with_quotes(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", "role", "reply_to", "thread", "position", "n_quotes", F.sha2("text", 256).alias("text_sha256"), F.sha2("formatted", 256).alias("formatted_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)
    # null where the exact number does not fit a long, which takes millions of vectors
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_language(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(rows.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")), anchors="vec_id % 100 = 0")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_media_columns, op3_quality_classifier, op4_toxicity, op5_ngram_jaccard_join, op6_warc, op7_embedding_dedup, op8_best_fit_packing, op9_byte_bpe, op10_quotation_linking,
        op11_embedding_whitening, op12_language_id, op13_hard_negatives,
    )
}

_REACH = """
hop(a, b) AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, other) AS (SELECT a, b FROM hop UNION SELECT r.id, h.b FROM reach r JOIN hop h ON h.a = r.other)"""

ORACLE_SQL = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 34), ' ') AS run FROM starts),
twice AS (SELECT run FROM windows GROUP BY run HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM windows JOIN twice USING (run)),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w WHERE len(words) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS rest, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)""",
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0),
sets AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(words, i, i + 3), ' ')) AS gram FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
link(a, b) AS (SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * k >= 85 * (sx.n + sy.n - k)),"""
    + _REACH
    + """
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.id = d.doc_id), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)""",
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
best AS (SELECT hex, max(page_id) AS best FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM p JOIN best USING (hex)""",
    "op7_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link(a, b) AS (SELECT x.vec_id, y.vec_id FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),"""
    + _REACH
    + """
SELECT vec_id, (SELECT count(*) FROM hop WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(other) FROM reach WHERE id = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(other) FROM reach WHERE id = vec_id), vec_id)) AS kept
FROM embeddings""",
    "op10_quotation_linking": """
SELECT conv_id, turn, role, lag(turn) OVER w AS reply_to, first_value(turn) OVER w AS thread, row_number() OVER w AS position, CAST(least(row_number() OVER w - 1, 2) AS BIGINT) AS n_quotes,
  sha256(coalesce(text, '')) AS text_sha256, sha256('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10)) AS formatted_sha256
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5""",
}
