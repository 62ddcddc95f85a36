"""Tables and folders that every executor and the driver can see."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests on one machine) a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = getattr(spark, "_vectrove_scratch", None)
    if root is None:
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._vectrove_scratch = root
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def single_rows(spark: SparkSession):
    """While it lasts, jobs that start here hand rows to Python one by one: for tables of a few large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or plain path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_whole(uri: str, chunks) -> None:
    """Write chunks under a temporary name, then move: a retried task replaces the file by equal content."""
    system, path = file_system(uri)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with system.open_output_stream(partial) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(partial, path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
