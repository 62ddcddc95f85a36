"""Views on the driver's tables that give the cohort operators inputs of their shape, in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: $HOURS: a timestamp's microseconds; $U(x): a number in [0, 1] from the md5 of a string; $GRID: a hundred repeat numbers; $TEXT: the string type.
VIEWS = {
    "tokens": "SELECT vec_id AS token_id, vec_id % 25 AS patient_id, CAST((vec_id - vec_id % 25) / 25 AS BIGINT) AS slice_index, CAST((vec_id - vec_id % 25) / 25 AS DOUBLE) * CAST(1.5 AS DOUBLE) + CAST(vec_id % 7 AS DOUBLE) * CAST(0.1 AS DOUBLE) AS z_mm, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE 1 END AS mask, CAST(label AS BIGINT) AS cluster_id, embedding FROM embeddings",
    "grid_tokens": "SELECT vec_id AS token_id, vec_id % 5 AS patient_id, CAST((vec_id - vec_id % 80) / 80 AS BIGINT) AS slice_index, CAST((vec_id % 80 - vec_id % 5) / 5 AS BIGINT) AS spatial_flat_idx, 4 AS grid_h, 4 AS grid_w, CAST(label AS BIGINT) AS cluster_id, embedding FROM embeddings",
    "cohort": "SELECT DISTINCT vec_id % 25 AS patient_id, CASE WHEN (vec_id % 25) % 5 < 2 THEN 1 ELSE 0 END AS label, CAST(40 + ((vec_id % 25) * 7) % 45 AS DOUBLE) AS age, CASE WHEN (vec_id % 25) % 3 = 0 THEN 'M' ELSE 'F' END AS sex FROM embeddings",
    "seq": "SELECT user_id AS patient_id, event_id AS slice_index, CAST($HOURS(ts) AS DOUBLE) / CAST(3600000000 AS DOUBLE) AS pos, value, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS cluster_id FROM events",
    "seq_cohort": "SELECT user_id AS patient_id, CASE WHEN avg(value) > 50 THEN 1 ELSE 0 END AS label FROM events GROUP BY user_id",
    "scores": "SELECT l.doc_id AS patient_id, l.quality AS label, l.toxic, CAST(d.n_chars AS DOUBLE) AS score_a, CAST(length(d.source) AS DOUBLE) + CAST(d.doc_id % 13 AS DOUBLE) AS score_b, d.lang AS site FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "draws": "SELECT doc_id AS patient_id, quality AS label, r AS repeat_id, row_number() OVER (PARTITION BY r, quality ORDER BY md5(concat(CAST(doc_id AS $TEXT), '|', CAST(r AS $TEXT), '|42')), doc_id) AS rn, count(*) OVER (PARTITION BY r, quality) AS n_class FROM labels CROSS JOIN $GRID",
    "preds": "SELECT patient_id, label, repeat_id, CAST(0.25 AS DOUBLE) * label + CAST(0.75 AS DOUBLE) * $U(concat(CAST(patient_id AS $TEXT), '|', CAST(repeat_id AS $TEXT), '|a')) AS prob_a, CAST(0.15 AS DOUBLE) * label + CAST(0.85 AS DOUBLE) * $U(concat(CAST(patient_id AS $TEXT), '|', CAST(repeat_id AS $TEXT), '|b')) AS prob_b FROM draws WHERE rn <= CAST(0.2 AS DOUBLE) * n_class",
    "big": "SELECT l_suppkey AS patient_id, l_orderkey * 10 + l_linenumber AS slice_index, CAST($HOURS(l_shipdate) AS DOUBLE) / CAST(86400000000 AS DOUBLE) AS pos, l_extendedprice AS value, CAST(l_partkey % 64 AS BIGINT) AS cluster_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount AS score_a, l_quantity AS score_b FROM lineitem",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _dialect(text: str, hours: str, u: str, grid: str, kind: str) -> str:
    out, at = "", 0
    while (i := text.find("$U(", at)) >= 0:
        depth, j = 1, i + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        out, at = out + text[at:i] + u.replace("$X", text[i + 3 : j - 1]), j
    return (out + text[at:]).replace("$HOURS", hours).replace("$GRID", grid).replace("$TEXT", kind)


def spark_sql(text: str) -> str:
    return _dialect(text.replace("$HOURS(", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "), "", "(CAST(conv(substr(md5($X), 1, 8), 16, 10) AS DOUBLE) / CAST(4294967295 AS DOUBLE))", "(SELECT CAST(id AS INT) AS r FROM range(100)) g", "STRING")


def duck_sql(text: str) -> str:
    return _dialect(text, "epoch_us", "(CAST(('0x' || substr(md5($X), 1, 8))::BIGINT AS DOUBLE) / CAST(4294967295 AS DOUBLE))", "(SELECT CAST(range AS INT) AS r FROM range(100)) g", "VARCHAR")


class Data:
    """Tables and views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        needs = {n: getattr(self, n) for n in (*TABLES, *VIEWS) if n != name and f" {n} " in f" {VIEWS[name]} "}
        text = spark_sql(VIEWS[name])
        for n in needs:  # {name} parameters keep the views out of the session's catalog
            text = f" {text} ".replace(f" FROM {n} ", f" FROM {{{n}}} ").replace(f" JOIN {n} ", f" JOIN {{{n}}} ")
        return self.spark.sql(text.strip(), **needs)
