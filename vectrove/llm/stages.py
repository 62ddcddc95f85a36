"""Stages of corpus_pipeline.py: each takes (spark, docs, sf_dir) and returns the documents that it keeps, or the packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard import ngram_jaccard_join
from .packing import pack
from .quality import quality_filter
from .storage import stored
from .substring import substring_dedup
from .toxicity import toxicity_filter


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels of rows still here, accepts; all columns, other columns too.

    Null and empty texts are scored like others, texts of any length whole. Rows that repeat are kept or leave together, as
    are equal texts; a score of exactly the limit stays. Without labels of both kinds all scores are one share, 0.5 without
    any, and all rows stay or leave by it. No rows in, no rows out.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on the labels of rows still here, accepts; all columns, other columns too.

    Null and empty texts are scored like a text without words, texts of any length whole. Rows that repeat are kept or
    leave together, as are equal texts; a score of exactly the limit leaves. Without labels of both kinds all scores are one
    share, 0.5 without any, and all rows stay or leave by it. No rows in, no rows out.
    """
    return toxicity_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles with similarity 0.8 or more connect, the document with the least id.

    A document is an id with a text: an id that repeats with other texts is several documents, and of those in one group the
    one with the least md5 of its text stays; rows that repeat id and text are one document, one row of which stays. A null
    id is larger than all others. Null, empty and blank texts link with nothing and stay, but for repeated rows. All columns
    are kept, other columns too, but for `_text_md5`, which must not be there. No rows in, no rows out.
    """
    keyed = docs.withColumn("_text_md5", F.md5(F.coalesce("text", F.lit(""))))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text_md5")
    groups = ngram_jaccard_join(keyed.select(key.alias("key"), "text"), n=5, percent=80, id_col="key")
    gone = groups.where("component_id <> key").select(F.col("key.doc_id").alias("gone_id"), F.col("key._text_md5").alias("gone_md5")).distinct()
    gone = stored(gone, "gone")  # what follows is a small plan, not the whole join several times
    kept = keyed.join(gone, keyed.doc_id.eqNullSafe(gone.gone_id) & (keyed._text_md5 == gone.gone_md5), "left_anti")
    twice = keyed.groupBy("doc_id", "_text_md5").count().where("count > 1").select(F.col("doc_id").alias("twice_id"), F.col("_text_md5").alias("twice_md5"))
    if twice.isEmpty():
        return kept.select(*docs.columns)
    again = kept.doc_id.eqNullSafe(twice.twice_id) & (kept._text_md5 == twice.twice_md5)
    one = kept.join(twice, again, "left_semi").dropDuplicates(["doc_id", "_text_md5"])
    return kept.join(twice, again, "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 35-word windows that occur twice; n_chars, which must be there, follows the text.

    Null texts stay null and keep their n_chars; texts without such a window stay as they are, others lose its words with the
    white space behind each, and are empty if no word is left. Texts of any length are taken whole; rows that repeat lose what they repeat, as
    other documents do. Other columns are kept, whatever their names. No rows in, no rows out.
    """
    out = substring_dedup(docs, window=35, with_text=True, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")))
    return out.select("doc_id", "text", "carried.*").withColumn("n_chars", F.expr("if(text is null, n_chars, cast(char_length(text) as long))")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, a row per piece; edge cases as in pack: nulls and empty texts are one end id,
    repeated rows are packed each, other columns are ignored, no rows in, no rows out."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=2048)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_harmless),
    ("near_copies", keep_one_of_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("packing", pack_sequences),
]
