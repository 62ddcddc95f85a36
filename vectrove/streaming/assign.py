"""A stream of tokens assigned to frozen prototypes: stateless, so appended as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.arrays import l2_normalise
from ..operators.joins import assign_prototypes


def read_token_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(folder)


def assign_stream(stream: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(token_id, proto, similarity) of each new token."""
    rows = stream.select("token_id", l2_normalise(F.col("embedding")).alias("embedding"))
    return assign_prototypes(rows, prototypes).select("token_id", "proto", "similarity")


def write_assignments(assigned: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet, exactly once by the checkpoint; with once, what is there now and then stop."""
    writer = assigned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
