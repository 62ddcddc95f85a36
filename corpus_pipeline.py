"""The corpus pipeline: documents are filtered, deduplicated and packed, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectrove.llm.stages import STAGES
from vectrove.llm.storage import stored
from vectrove.packaging import ship

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's result is written and read again before the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
