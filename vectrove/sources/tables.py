"""Sources and sinks of cohort tables."""

from __future__ import annotations

import io
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = ("ID", "age", "sex", "case")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its extension, anything else as CSV with a header."""
    if path.lower().endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True)


def scan_archives(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """One row per token of all .npz archives in a folder: (patient_id, slice_index, z_mm, mask, cluster_id, embedding).

    The group is the stored patient_id, else the file's stem; absent arrays are null. A task holds one archive at a time.
    """
    import pandas as pd

    def decode(frames):
        import numpy as np

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    n = len(z["embeddings"])
                    take = lambda k, default=None: list(z[k]) if k in z.files and len(z[k]) == n else [default] * n  # noqa: E731,B023
                    group = str(z["patient_id"].ravel()[0]) if "patient_id" in z.files else path.rsplit("/", 1)[-1].removesuffix(".npz")
                    yield pd.DataFrame({"patient_id": group, "slice_index": take("slice_index"), "z_mm": take("slice_z_mm"), "mask": take("mask"), "cluster_id": take("cluster_ids"), "embedding": [x.astype("float32").tolist() for x in z["embeddings"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "content").mapInPandas(decode, "patient_id string, slice_index long, z_mm double, mask int, cluster_id long, embedding array<float>")


def pack_archives(tokens: DataFrame) -> DataFrame:
    """(patient_id, content): a group's tokens as the bytes of one .npz archive, the layout that scan_archives reads."""
    import pandas as pd

    def pack(frame):
        import numpy as np

        frame, out = frame.sort_values("slice_index"), io.BytesIO()
        np.savez_compressed(out, patient_id=np.array([str(frame["patient_id"].iloc[0])]), slice_index=frame["slice_index"].to_numpy("int64"), slice_z_mm=frame["z_mm"].to_numpy("float64"), mask=frame["mask"].to_numpy("int64"), cluster_ids=frame["cluster_id"].to_numpy("int64"), embeddings=np.stack(frame["embedding"]).astype("float32"))
        return pd.DataFrame({"patient_id": [str(frame["patient_id"].iloc[0])], "content": [out.getvalue()]})

    return tokens.select("patient_id", "slice_index", "z_mm", "mask", "cluster_id", "embedding").groupBy("patient_id").applyInPandas(pack, "patient_id string, content binary")


def write_tokens(df: DataFrame, path: str) -> None:
    """The token table, a folder per source."""
    df.write.mode("overwrite").partitionBy("source").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Image metadata; a missing column is an error; roi_file, if present, gives a second key."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    missing = [c for c in METADATA if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    second = F.regexp_replace(F.regexp_extract("roi_file", r"([^/]*)$", 1), r"_roi\.nii\.gz$", "") if "roi_file" in df.columns else F.lit(None).cast("string")
    return df.select(*METADATA, second.alias("roi_key"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(index, value) of a column without header, a small file; what is not a number is 0."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("index", "text"))
    return lines.select("index", F.coalesce(F.trim("text").try_cast("double"), F.lit(0.0)).alias("value"))


def collect_runs(spark: SparkSession, root: str, name: str = "summary.csv") -> DataFrame:
    """All run_*/**/name files below a root with the run's folder name."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).csv(root, header=True, inferSchema=True, enforceSchema=False)
    return df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"/(run_[^/]+)/", 1)).where("run <> ''")


def json_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Adds columns from paths into a column of JSON text; absent ones are null."""
    return df.select("*", *(F.get_json_object(column, path).alias(name) for name, path in fields.items()))


def read_summaries_json(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """A row per JSON file: its path and the fields wanted."""
    return json_fields(spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path")), "value", fields).drop("value")


def write_csv_atomic(df: DataFrame, path: str) -> None:
    """One CSV part; the committer moves it when it is whole. For summaries: the rows go to one task."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not among the new, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def matrix_long(df: DataFrame, row: str, array: str) -> DataFrame:
    """(row, j, value) of a matrix kept as one array per row."""
    return df.select(row, F.posexplode(array).alias("j", "value"))


def pick_best(df: DataFrame, metric: str) -> DataFrame:
    """The row with the largest metric."""
    return df.orderBy(F.col(metric).desc_nulls_last()).limit(1)


#: The columns of the benchmark table.
BENCHMARK = ("branch_id", "model", "representation", "classifier_or_fusion", "ROC_mean", "ROC_std", "ROC_p2p5", "PR_mean", "PR_std", "PR_p2p5", "notes")


def manifest_table(spark: SparkSession, rows: list[dict], tables: dict[str, DataFrame]) -> DataFrame:
    """The benchmark table: one row per manifest entry; what is missing or empty gives a row with a note.

    tables has the data frames that the entries name. The manifest is a short list kept by hand.
    """
    numbers, parts = BENCHMARK[4:10], []
    for spec in rows:
        head = [F.lit(spec[k]).alias(n) for k, n in zip(("id", "model", "representation", "classifier_or_fusion"), BENCHMARK)]
        note = lambda text: spark.range(1).select(*head, *(F.lit(None).cast("double").alias(n) for n in numbers), F.lit(text).alias("notes"))  # noqa: E731,B023
        pick = lambda df, notes: df.select(*head, *(F.col(n.lower()).cast("double").alias(n) for n in numbers), notes.alias("notes"))  # noqa: E731,B023
        kind = spec["kind"]
        if kind in ("single_row_summary_csv", "pick_best_from_summary_csv"):
            df = tables.get(spec["path"])
            if df is None or df.isEmpty():
                parts.append(note("MISSING CSV" if df is None else "EMPTY CSV"))
            elif kind.startswith("single"):
                parts.append(pick(df.limit(1), F.lit("")))
            else:
                metric = spec.get("pick_metric", "roc_mean")
                parts.append(pick(pick_best(df, metric), F.concat(F.lit(f"pick_best:{metric}; "), F.col("model"))))
        elif kind == "ensemble_method":
            summary, splits, method = tables.get(spec["summary_methods"]), tables.get(spec["per_split_metrics"]), spec["method_key"]
            if summary is None or splits is None:
                parts.append(note("MISSING ensemble CSV"))
                continue
            found = summary.where(F.col("method") == method)
            tail = method.removeprefix("ensemble_fixed_")
            tail = "plus_age_sex_lr" if tail.endswith("plus_age_sex_lr") else tail
            low = splits.agg(*(F.percentile(F.col(f"`{m}_ensemble_{tail}`").cast("double"), 0.025).alias(f"{m}_p2p5") for m in ("roc", "pr")))
            parts.append(note(f"No method={method!r}") if found.isEmpty() else pick(found.join(low), F.lit(f"ensemble:{method} from=results")))
        else:
            parts.append(note(f"Unknown kind={kind!r}"))
    return reduce(DataFrame.unionByName, parts)
