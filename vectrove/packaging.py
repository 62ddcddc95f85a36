"""Make this package importable for Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless PYTHONPATH already has its parent folder."""
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(ROOT.parent) in known or getattr(context, "_vectrove_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "vectrove_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(ROOT.rglob("*.py")):
            z.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(target)
    context._vectrove_shipped = True
