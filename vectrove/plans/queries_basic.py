"""Queries of sources, cleaning, vector functions, joins and sets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import clean as C
from ..operators import joins as J
from ..operators.ranks import numbered
from ..sources import tables as S
from .registry import query
from .views import Data


def scratch(d: Data, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, which only a session on one machine may leave unset."""
    root = d.spark.conf.get("spark.checkpoint.dir", None) or d.spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not d.spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = root or f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01_read_table(d: Data) -> DataFrame:
    return S.read_table(d.spark, f"{d.sf_dir}/nation.parquet")


@query("SELECT CAST(patient_id AS VARCHAR) AS patient_id, count(*) AS n, CAST(sum(slice_index) AS BIGINT) AS slices, sum(z_mm) AS z, CAST(sum(mask) AS BIGINT) AS inside, CAST(sum(cluster_id) AS BIGINT) AS clusters, sum(list_sum(CAST(embedding AS DOUBLE[]))) AS total FROM tokens GROUP BY 1", "z total")
def s02_scan_archives(d: Data) -> DataFrame:
    folder = scratch(d, "archives")

    def save(rows):
        import pandas as pd

        from pyarrow import fs

        for frame in rows:
            for name, content in zip(frame["patient_id"], frame["content"]):
                system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                system.create_dir(path, recursive=True)
                with system.open_output_stream(f"{path}/{name}.npz") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(frame)]})

    S.pack_archives(d.tokens).mapInPandas(save, "n long").agg(F.sum("n")).collect()
    tokens = S.scan_archives(d.spark, folder)
    return tokens.groupBy("patient_id").agg(F.count("*").alias("n"), F.sum("slice_index").cast("decimal(38,0)").cast("long").alias("slices"), F.sum("z_mm").alias("z"), F.sum("mask").alias("inside"), F.sum("cluster_id").alias("clusters"), F.sum(A.total(F.col("embedding"))).alias("total"))


@query("SELECT source, count(*) AS n, sum(z_mm) AS z FROM (SELECT CASE WHEN patient_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, z_mm FROM tokens) GROUP BY source", "z")
def s03_write_tokens(d: Data) -> DataFrame:
    path = scratch(d, "tokens")
    S.write_tokens(d.tokens.withColumn("source", F.when(F.col("patient_id") % 2 == 0, "a").otherwise("b")), path)
    return d.spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("z_mm").alias("z"))


@query("SELECT CAST(c_custkey AS INTEGER) AS \"ID\", c_acctbal AS age, c_mktsegment AS sex, c_nationkey AS \"case\", CAST(c_name AS VARCHAR) AS roi_key FROM customer", "age")
def s04_read_metadata(d: Data) -> DataFrame:
    path = scratch(d, "metadata")
    d.customer.select(F.col("c_custkey").alias("ID"), F.col("c_acctbal").alias("age"), F.col("c_mktsegment").alias("sex"), F.col("c_nationkey").alias("case"), F.concat(F.lit("/scans/"), "c_name", F.lit("_roi.nii.gz")).alias("roi_file")).write.csv(path, header=True)
    return S.read_metadata(d.spark, path)


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS \"index\", CASE WHEN s_suppkey % 7 = 3 THEN 0 ELSE s_acctbal END AS value FROM supplier", "value")
def s05_read_vector(d: Data) -> DataFrame:
    path = scratch(d, "vector")
    text = F.when(F.col("s_suppkey") % 7 == 3, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    d.supplier.orderBy("s_suppkey").coalesce(1).select(text).write.text(path)  # one column of a model's size
    return S.read_vector(d.spark, path)


@query("SELECT 'run_' || CAST(c_nationkey % 3 AS VARCHAR) AS run, count(*) AS n, sum(c_acctbal) AS balance FROM customer GROUP BY 1", "balance")
def s06_collect_runs(d: Data) -> DataFrame:
    root = scratch(d, "runs")
    for k in range(3):
        path = f"{root}/run_{k}/out/summary.csv"
        d.customer.where(F.col("c_nationkey") % 3 == k).select("c_custkey", "c_acctbal").write.csv(path, header=True)
    return S.collect_runs(d.spark, root, "*.csv").groupBy("run").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.auc_ci[1]') AS upper FROM events", "k")
def s07_json_fields(d: Data) -> DataFrame:
    return S.json_fields(d.events, "props", {"k": "$.k", "upper": "$.auc_ci[1]"}).select("event_id", F.col("k").cast("double"), "upper")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def s09_write_csv_atomic(d: Data) -> DataFrame:
    path = scratch(d, "summary")
    S.write_csv_atomic(d.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), path)
    return d.spark.read.csv(path, header=True, schema="o_orderpriority string, n long")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, p_size + 100 FROM part WHERE p_partkey % 5 = 0")
def s10_replace_by_key(d: Data) -> DataFrame:
    old = d.part.select("p_partkey", "p_size")
    return S.replace_by_key(old, old.where("p_partkey % 5 = 0").withColumn("p_size", F.col("p_size") + 100), "p_partkey")


@query("SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings", "value")
def s11_matrix_long(d: Data) -> DataFrame:
    return S.matrix_long(d.embeddings, "vec_id", "embedding").select("vec_id", "j", F.col("value").cast("double").alias("value"))


@query("SELECT token_id, CASE WHEN patient_id % 4 = 3 THEN 'not_in_split' WHEN mask = 0 THEN 'no_label' WHEN slice_index < 2 THEN 'too_few_slices' END AS reason FROM tokens")
def s12_with_rejects(d: Data) -> DataFrame:
    return C.with_rejects(d.tokens, [("not_in_split", F.col("patient_id") % 4 == 3), ("no_label", F.col("mask") == 0), ("too_few_slices", F.col("slice_index") < 2)]).select("token_id", "reason")


@query("SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_nationkey AS label, c_acctbal AS age, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex FROM customer", "age")
def p01_harmonise_cohort(d: Data) -> DataFrame:
    return C.harmonise_cohort(d.customer.select(F.col("c_custkey").alias("ID"), F.col("c_nationkey").alias("case"), F.col("c_acctbal").alias("age"), F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("sex")))


@query("""SELECT o_orderkey, CASE WHEN t LIKE '%tts%' OR t LIKE '%takotsubo%' THEN 1 WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS INTEGER) WHEN t IS NOT NULL THEN 0 END AS label, CASE WHEN v LIKE '%case%' THEN 1 WHEN v IS NOT NULL THEN 0 END AS other_words, CAST(trunc(x) AS INTEGER) AS from_number
FROM (SELECT o_orderkey, lower(CASE o_orderkey % 7 WHEN 0 THEN 'Takotsubo' WHEN 1 THEN CAST(o_orderkey % 9 AS VARCHAR) WHEN 2 THEN '1.0' WHEN 3 THEN 'definite TTS ' WHEN 4 THEN NULL WHEN 5 THEN 'control case' ELSE o_orderstatus END) AS t, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 3 = 1 THEN 'case' ELSE 'x' END END AS v, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS DOUBLE) / 2 END AS x FROM orders)""")
def p02_binary_label(d: Data) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, "Takotsubo").when(k % 7 == 1, (k % 9).cast("string")).when(k % 7 == 2, "1.0").when(k % 7 == 3, "definite TTS ").when(k % 7 == 4, None).when(k % 7 == 5, "control case").otherwise(F.col("o_orderstatus"))
    other = F.when(k % 3 == 1, "Case ").when(k % 3 == 2, "x")
    number = F.when(k % 4 > 0, (k % 4).cast("double") / 2)
    return d.orders.select("o_orderkey", C.binary_label(text).alias("label"), C.binary_label(other, ("case",)).alias("other_words"), C.binary_label(number, numeric=True).alias("from_number"))


@query("SELECT patient_id, CASE sex WHEN 'M' THEN 0.0 ELSE 1.0 END::DOUBLE AS m0f1, CASE sex WHEN 'M' THEN 1.0 ELSE 0.0 END::DOUBLE AS f0m1, CASE sex WHEN 'M' THEN 1.0 ELSE 0.0 END::DOUBLE AS male, CASE sex WHEN 'M' THEN 1.0 ELSE 0.0 END::DOUBLE AS half FROM cohort")
def p03_sex_code(d: Data) -> DataFrame:
    return d.cohort.select("patient_id", *(C.sex_code(F.concat(F.lit(" "), "sex"), k).alias(k) for k in ("m0f1", "f0m1", "male", "half")))


@query("SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS price FROM orders", "price")
def p04_to_number(d: Data) -> DataFrame:
    return d.orders.select("o_orderkey", C.to_number(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_totalprice").cast("string"))).alias("price"))


@query("SELECT p_partkey, p_type AS model FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def p05_filter_model(d: Data) -> DataFrame:
    want = d.part.agg(F.min("p_type")).first()[0]
    return C.filter_model(d.part.select("p_partkey", F.col("p_type").alias("model")), want)


@query("SELECT token_id FROM tokens WHERE mask = 1 AND isfinite(z_mm) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0")
def p06_valid_tokens(d: Data) -> DataFrame:
    return C.valid_tokens(d.tokens).select("token_id")


@query("SELECT patient_id, count(*) AS n FROM tokens WHERE token_id % 6 <> 0 GROUP BY 1")
def p07_finite_features(d: Data) -> DataFrame:
    broken = d.tokens.withColumn("features", F.when(F.col("token_id") % 6 == 0, F.transform("embedding", lambda x: F.lit(float("nan")))).otherwise(A.doubles(F.col("embedding"))))
    return C.finite_features(broken, ["features"]).groupBy("patient_id").agg(F.count("*").alias("n"))


@query("SELECT t.patient_id, count(*) AS n, max(c.age) AS age FROM tokens t JOIN cohort c USING (patient_id) WHERE c.age > 50 GROUP BY 1", "age")
def p08_cohort_gate(d: Data) -> DataFrame:
    cohort = d.cohort.withColumn("age", F.when(F.col("age") > 50, F.col("age")))
    return C.cohort_gate(d.tokens, cohort).groupBy("patient_id").agg(F.count("*").alias("n"), F.max("age").alias("age"))


@query("SELECT k AS key, row_number() OVER (ORDER BY TRY_CAST(k AS BIGINT) IS NULL, TRY_CAST(k AS BIGINT), k) AS place FROM (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS k FROM customer)")
def p09_coerce_split_key(d: Data) -> DataFrame:
    keys = d.customer.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")).alias("key")).distinct()
    return numbered(keys.withColumn("order", C.coerce_split_key(F.col("key"))), "order", "_i").select("key", (F.col("_i") + 1).alias("place"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || '_x' END AS id FROM customer")
def p10_strip_demographic_suffix(d: Data) -> DataFrame:
    return d.customer.select("c_custkey", C.strip_demographic_suffix(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("_"), F.col("c_nationkey").cast("string"), F.lit("f"))).otherwise("_x"))).alias("id"))


@query("""SELECT c_name || CASE WHEN c_custkey % 3 = 1 THEN '_40F' ELSE '' END AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey WHEN c_name LIKE '%0' THEN 0 END AS label,
CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 1 THEN 'stripped' ELSE 'exact' END WHEN c_custkey % 3 <> 1 AND c_name LIKE '%0' THEN 'pattern' END AS label_source
FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey % 5 <> 0""")
def p11_label_with_source(d: Data) -> DataFrame:
    ids = d.customer.where("c_custkey % 3 <> 1 or c_custkey % 5 <> 0").select(F.concat("c_name", F.when(F.col("c_custkey") % 3 == 1, "_40F").otherwise("")).alias("id"))
    labels = d.customer.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("id"), F.col("c_nationkey").alias("label"))
    return C.label_with_source(ids, labels, "0$")


@query("SELECT p_partkey, p_name AS id FROM part")
def p12_id_from_file(d: Data) -> DataFrame:
    return d.part.select("p_partkey", C.id_from_file(F.concat(F.lit("/data/roi/"), "p_name", F.lit("_roi.nii.gz"))).alias("id"))


@query("SELECT p_partkey, 'logistic_en_C' || CAST(p_size AS VARCHAR) || '_r0.5' AS name, 'logistic_en' AS kind, CAST(p_size AS DOUBLE) AS c, CAST(0.5 AS DOUBLE) AS ratio FROM part")
def p13_head_names(d: Data) -> DataFrame:
    named = d.part.select("p_partkey", C.format_head(F.lit("logistic_en"), F.col("p_size").cast("string"), F.lit("0.5")).alias("name"))
    return named.withColumn("h", C.parse_head(F.col("name"))).select("p_partkey", "name", "h.kind", "h.c", "h.ratio")


@query("""SELECT 'n_splits' AS "column", 'values differ' AS problem WHERE (SELECT count(DISTINCT repeat_id) FROM preds) <> (SELECT count(DISTINCT repeat_id) FROM preds WHERE repeat_id < 7)
UNION ALL SELECT 'repeat_id', 'several values' WHERE (SELECT count(DISTINCT repeat_id) FROM preds) > 1 UNION ALL SELECT 'test_size', 'one side only'""")
def p14_protocol_violations(d: Data) -> DataFrame:
    a, b = d.preds, d.preds.where("repeat_id < 7")
    n = lambda df: df.join(df.agg(F.count_distinct("repeat_id").alias("n_splits")))  # noqa: E731  one row
    return C.protocol_violations(n(a).withColumn("seed", F.lit(42)).withColumn("test_size", F.lit(0.2)), n(b).withColumn("seed", F.lit(42.0)), ["n_splits", "repeat_id", "seed", "test_size"])


@query("SELECT repeat_id, string_agg(CAST(patient_id AS VARCHAR), ';' ORDER BY CAST(patient_id AS VARCHAR)) AS ids FROM preds GROUP BY 1")
def p15_split_and_join_ids(d: Data) -> DataFrame:
    joined = C.join_ids(d.preds, ["repeat_id"], "patient_id").withColumn("patient_id", F.concat("patient_id", F.lit("; ;")))
    return C.join_ids(C.split_ids(joined, "patient_id"), ["repeat_id"], "patient_id").withColumnRenamed("patient_id", "ids")


@query("SELECT repeat_id, avg(CAST(0.5 AS DOUBLE) * prob_a + CAST(0.5 AS DOUBLE) * prob_b) AS value FROM preds GROUP BY 1", "value")
def p16_resolve_weight_column(d: Data) -> DataFrame:
    wide = d.preds.groupBy("repeat_id").agg(*(F.avg(w * F.col("prob_a") + (1 - w) * F.col("prob_b")).alias(f"roc_ensemble_w{w:g}") for w in (0.25, 0.5, 0.75)))
    return wide.select("repeat_id", F.col(f"`{C.resolve_weight_column(wide, 0.5000001)}`").alias("value"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def p17_order_columns(d: Data) -> DataFrame:
    return C.order_columns(d.supplier.drop("s_acctbal").withColumn("Unnamed: 0", F.lit(1)), ["s_suppkey"])


@query("SELECT patient_id, slice_index FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY pos, slice_index) - 1 AS p FROM seq) WHERE p % 5 = 0")
def p18_every_nth(d: Data) -> DataFrame:
    return C.every_nth(d.seq, 5, ["patient_id"], ["pos", "slice_index"]).select("patient_id", "slice_index")


@query("SELECT l_returnflag, CASE WHEN abs(avg(l_discount)) >= 1e-15 THEN 100 * (avg(l_tax) - avg(l_discount)) / abs(avg(l_discount)) END AS change FROM lineitem GROUP BY 1", "change")
def p19_pct_diff(d: Data) -> DataFrame:
    return d.lineitem.groupBy("l_returnflag").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b")).select("l_returnflag", C.pct_diff(F.col("a"), F.col("b")).alias("change"))


@query("SELECT patient_id, 'score_a' AS metric, score_a AS value FROM scores UNION ALL SELECT patient_id, 'score_b', score_b FROM scores", "value")
def p20_wide_to_long(d: Data) -> DataFrame:
    return C.wide_to_long(d.scores, ["patient_id"], ["score_a", "score_b"])


# Vector and grid functions

_UNIT = "SELECT token_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM tokens"


@query(f"WITH e AS ({_UNIT}), n AS (SELECT token_id, sqrt(sum(v * v)) + 1e-8 AS n FROM e GROUP BY 1) SELECT token_id, d, v / n AS v FROM e JOIN n USING (token_id)", "v")
def f01_l2_normalise(d: Data) -> DataFrame:
    return d.tokens.select("token_id", F.posexplode(A.l2_normalise(F.col("embedding"))).alias("d", "v"))


@query(f"WITH e AS ({_UNIT}) SELECT token_id, d, 2 * ((least(greatest(v * 4000, -1000), 400) + 1000) / (1400 + 1e-8)) - 1 AS v FROM e", "v")
def f02_clip_scale(d: Data) -> DataFrame:
    return d.tokens.select("token_id", F.posexplode(A.clip_scale(F.transform(A.doubles(F.col("embedding")), lambda x: x * 4000))).alias("d", "v"))


@query(f"WITH e AS ({_UNIT}) SELECT token_id, d, CASE WHEN (token_id + d) % 3 > 0 THEN v ELSE 0 END AS v FROM e", "v")
def f03_mask_array(d: Data) -> DataFrame:
    mask = F.transform(F.col("embedding"), lambda x, i: ((F.col("token_id") + i) % 3).cast("int"))
    return d.tokens.select("token_id", F.posexplode(A.mask_array(F.col("embedding"), mask)).alias("d", "v"))


@query(f"WITH e AS ({_UNIT}) SELECT token_id, d, CASE WHEN d % 9 = 0 THEN 0 ELSE v END AS v FROM e", "v")
def f04_nan_to_zero(d: Data) -> DataFrame:
    bad = F.transform(A.doubles(F.col("embedding")), lambda x, i: F.when(i % 18 == 0, F.lit(float("nan"))).when(i % 9 == 0, F.lit(float("-inf"))).otherwise(x))
    return d.tokens.select("token_id", F.posexplode(A.nan_to_zero(bad)).alias("d", "v"))


@query(f"WITH e AS ({_UNIT}) SELECT token_id, CAST(d // 8 AS INTEGER) AS slice, sum(v) AS total FROM e GROUP BY 1, 2", "total")
def f05_explode_slices(d: Data) -> DataFrame:
    return A.explode_slices(d.tokens, "embedding", 8).select("token_id", "slice", A.total(F.col("values")).alias("total"))


@query("""SELECT token_id, 'row_major' AS decode, spatial_flat_idx // grid_w AS y, spatial_flat_idx % grid_w AS x FROM grid_tokens
UNION ALL SELECT token_id, 'col_major', spatial_flat_idx % grid_h, spatial_flat_idx // grid_h FROM grid_tokens UNION ALL SELECT token_id, 'transpose', spatial_flat_idx % grid_w, spatial_flat_idx // grid_w FROM grid_tokens""")
def f06_grid_coords(d: Data) -> DataFrame:
    one = lambda k: A.grid_coords(d.grid_tokens, k).select("token_id", F.lit(k).alias("decode"), "y", "x")
    return one("row_major").unionByName(one("col_major")).unionByName(one("transpose"))


@query("SELECT token_id, grid_h - 1 - spatial_flat_idx // grid_w AS y, grid_w - 1 - spatial_flat_idx % grid_w AS x FROM grid_tokens")
def f07_flip_grid(d: Data) -> DataFrame:
    return A.flip_grid(A.grid_coords(d.grid_tokens), "lr_ud").select("token_id", "y", "x")


@query("SELECT token_id, least(1, greatest(0, 1 - abs(z_mm - 15) / 8)) AS k FROM tokens", "k")
def f08_position_kernel(d: Data) -> DataFrame:
    return d.tokens.select("token_id", A.position_kernel(F.col("z_mm"), 15.0, 8.0).alias("k"))


_COEF = "SELECT cluster_id, avg(CAST(embedding[1] AS DOUBLE)) AS coef FROM tokens GROUP BY 1"


def _coef(d: Data) -> DataFrame:
    return d.tokens.groupBy("cluster_id").agg(F.avg(F.col("embedding")[0].cast("double")).alias("coef"))


@query(f"WITH c AS ({_COEF}), r AS (SELECT *, row_number() OVER (ORDER BY coef DESC, cluster_id) AS rank FROM c) SELECT token_id, CASE WHEN rank <= 3 AND coef > 0 THEN coef ELSE 0 END AS weight FROM tokens JOIN r USING (cluster_id)", "weight")
def f09_cluster_weight(d: Data) -> DataFrame:
    return A.cluster_weight(d.tokens, _coef(d), 3).select("token_id", "weight")


@query(f"""WITH e AS (SELECT token_id, patient_id, slice_index, CAST(unnest(range(len(embedding))) AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM tokens),
n AS (SELECT token_id, sqrt(sum(v * v)) + 1e-8 AS n FROM e GROUP BY 1), u AS (SELECT token_id, patient_id, slice_index, d, v / n AS v FROM e JOIN n USING (token_id)),
m AS (SELECT patient_id, d, avg(v) AS v FROM u WHERE slice_index % 2 = 1 GROUP BY 1, 2), mn AS (SELECT patient_id, sqrt(sum(v * v)) + 1e-8 AS n FROM m GROUP BY 1)
SELECT token_id, greatest(0, sum(u.v * m.v / mn.n)) AS factor FROM u JOIN m USING (patient_id, d) JOIN mn USING (patient_id) GROUP BY 1""", "factor")
def f10_cosine_relu(d: Data) -> DataFrame:
    return A.cosine_relu(d.tokens.withColumn("w", F.col("slice_index") % 2), "patient_id", "embedding", "w").select("token_id", "factor")


@query(f"""WITH e AS ({_UNIT}), n AS (SELECT token_id, sqrt(sum(v * v)) * (1 + token_id % 3) AS n FROM e GROUP BY 1), m AS (SELECT patient_id, quantile_cont(n, 0.5) AS m FROM n JOIN tokens USING (token_id) GROUP BY 1)
SELECT token_id, sqrt(m / n) AS dampen FROM n JOIN tokens USING (token_id) JOIN m USING (patient_id)""", "dampen")
def f11_norm_dampen(d: Data) -> DataFrame:
    return A.norm_dampen(d.tokens.withColumn("e", F.transform(A.doubles(F.col("embedding")), lambda x: x * (1 + F.col("token_id") % 3))), ["patient_id"], "e").select("token_id", "dampen")


@query("""WITH h AS (SELECT patient_id, cluster_id, count(*) FILTER (WHERE slice_index % 2 = 0) + 1e-8 AS p, count(*) FILTER (WHERE slice_index % 2 = 1) + 1e-8 AS q FROM (SELECT * FROM seq) GROUP BY 1, 2),
g AS (SELECT p.patient_id, c.c, coalesce(h.p, 1e-8) AS p, coalesce(h.q, 1e-8) AS q FROM (SELECT DISTINCT patient_id FROM seq) p CROSS JOIN (SELECT unnest(range(5)) AS c) c LEFT JOIN h ON h.patient_id = p.patient_id AND h.cluster_id = c.c),
s AS (SELECT *, p / sum(p) OVER (PARTITION BY patient_id) AS a, q / sum(q) OVER (PARTITION BY patient_id) AS b FROM g)
SELECT patient_id, sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2 AS js FROM s GROUP BY 1""", "js")
def f12_js_divergence(d: Data) -> DataFrame:
    side = lambda k: F.array(*(F.sum(((F.col("cluster_id") == c) & (F.col("slice_index") % 2 == k)).cast("double")) for c in range(5)))
    return d.seq.groupBy("patient_id").agg(side(0).alias("p"), side(1).alias("q")).select("patient_id", A.js_divergence(F.col("p"), F.col("q")).alias("js"))


@query("SELECT patient_id, slice_index, sum(abs(v) * (f // 4)) / sum(abs(v)) AS cy, sum(abs(v) * (f % 4)) / sum(abs(v)) AS cx FROM (SELECT patient_id, slice_index, spatial_flat_idx AS f, CAST(embedding[1] AS DOUBLE) AS v FROM grid_tokens) GROUP BY 1, 2", "cy cx")
def f13_centre_of_mass(d: Data) -> DataFrame:
    return A.centre_of_mass(A.grid_coords(d.grid_tokens).withColumn("value", F.abs(F.col("embedding")[0].cast("double"))), ["patient_id", "slice_index"])


_PAIRED = "SELECT patient_id, slice_index, CAST(embedding AS DOUBLE[]) AS b, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY patient_id ORDER BY slice_index) AS a FROM tokens"


def _paired(d: Data) -> DataFrame:
    from pyspark.sql import Window

    return d.tokens.withColumn("before", F.lag("embedding").over(Window.partitionBy("patient_id").orderBy("slice_index"))).where("before is not null")


@query(f"""WITH x AS ({_PAIRED}), e AS (SELECT patient_id, slice_index, unnest(a) - unnest(b) AS d FROM x WHERE a IS NOT NULL), r AS (SELECT patient_id, slice_index, avg(abs(d)) AS mae, avg(d * d) AS mse FROM e GROUP BY 1, 2)
SELECT patient_id, avg(mae) AS mae, stddev_samp(mae) AS mae_std, avg(mse) AS mse, stddev_samp(mse) AS mse_std FROM r GROUP BY 1""", "mae mae_std mse mse_std")
def f14_pair_error(d: Data) -> DataFrame:
    each = _paired(d).withColumn("e", A.pair_error(F.col("before"), F.col("embedding")))
    return each.groupBy("patient_id").agg(*(x for k in ("mae", "mse") for x in (F.avg(f"e.{k}").alias(k), F.stddev_samp(f"e.{k}").alias(f"{k}_std"))))


@query(f"WITH e AS ({_UNIT}) SELECT token_id, CAST(count(*) FILTER (WHERE v > 0.05 AND d % 4 > 0) AS INTEGER) AS area FROM e GROUP BY 1")
def f15_thresholded_area(d: Data) -> DataFrame:
    mask = F.transform(F.col("embedding"), lambda x, i: i % 4)
    return d.tokens.select("token_id", A.thresholded_area(F.col("embedding"), mask, 0.05).alias("area"))


@query(f"WITH e AS ({_UNIT}) SELECT token_id, sqrt(sum(v * v)) AS l2, avg(v) AS mean, sum(abs(v)) AS l1 FROM e GROUP BY 1", "l2 mean l1")
def f16_vector_norms(d: Data) -> DataFrame:
    v = F.col("embedding")
    return d.tokens.select("token_id", A.norm(v).alias("l2"), (A.total(v) / F.size(v)).alias("mean"), A.total(F.transform(A.doubles(v), F.abs)).alias("l1"))


@query("SELECT p_partkey, CASE (p_partkey % 192) // 64 WHEN 0 THEN 'std' WHEN 1 THEN 'vol' ELSE 'p90_p10' END AS block, p_partkey % 192 % 64 AS dim FROM part")
def f17_block_meta(d: Data) -> DataFrame:
    return d.part.withColumn("m", A.block_meta(F.col("p_partkey") % 192, ["std", "vol", "p90_p10"], 64)).select("p_partkey", "m.block", "m.dim")


# Joins and sets


@query("SELECT CAST(patient_id AS VARCHAR) AS patient_id, score_a, score_b FROM scores WHERE patient_id % 3 <> 0", "score_a score_b")
def j01_join_scores(d: Data) -> DataFrame:
    text = F.when(F.col("patient_id") % 3 == 0, "missing").otherwise(F.col("score_b").cast("string"))
    return J.join_scores(d.scores.select("patient_id", "score_a"), d.scores.select("patient_id", text.alias("score_b")))


@query("SELECT repeat_id, patient_id, label, prob_a, prob_b FROM preds", "prob_a prob_b")
def j02_join_oos(d: Data) -> DataFrame:
    return J.join_oos(d.preds.select("repeat_id", "patient_id", "label", "prob_a"), d.preds.select("repeat_id", "patient_id", "label", "prob_b")).select("repeat_id", "patient_id", "label", "prob_a", "prob_b")


@query("SELECT o_orderkey, o_custkey, c_acctbal, o_totalprice, CAST(CASE WHEN c_custkey IS NULL THEN NULL ELSE c_acctbal END AS DOUBLE) AS o_totalprice_extra FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 0", "c_acctbal o_totalprice o_totalprice_extra")
def j03_left_attach(d: Data) -> DataFrame:
    extra = d.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.col("c_acctbal").alias("o_totalprice"))
    return J.left_attach(d.orders.select("o_orderkey", "o_custkey", "o_totalprice"), extra, "o_custkey")


@query("SELECT coalesce(a.k, b.k) AS k, a.x, b.y FROM (SELECT c_custkey AS k, c_acctbal AS x FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS y FROM customer WHERE c_custkey % 3 <> 1) b ON a.k = b.k", "x")
def j04_outer_merge(d: Data) -> DataFrame:
    c = d.customer
    return J.outer_merge(c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x")), c.where("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("y")), ["k"])


@query("SELECT token_id FROM tokens WHERE patient_id IN (SELECT patient_id FROM cohort WHERE label = 1)")
def j05_restrict_to(d: Data) -> DataFrame:
    return J.restrict_to(d.tokens, d.cohort.where("label = 1")).select("token_id")


@query("SELECT s.repeat_id, l.doc_id AS patient_id FROM (SELECT DISTINCT repeat_id FROM preds) s CROSS JOIN labels l ANTI JOIN preds p ON p.repeat_id = s.repeat_id AND p.patient_id = l.doc_id")
def j06_train_rows(d: Data) -> DataFrame:
    return J.train_rows(d.labels.select(F.col("doc_id").alias("patient_id")), d.preds).select("repeat_id", "patient_id")


def id_variants(customers: DataFrame) -> DataFrame:
    """Names as they are, in capitals, or without their last character."""
    k = F.col("c_custkey") % 3
    return customers.select(F.when(k == 0, F.col("c_name")).when(k == 1, F.upper("c_name")).otherwise(F.substring("c_name", 1, 17)).alias("id"))


@query("""WITH l AS (SELECT CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN upper(c_name) ELSE substr(c_name, 1, 17) END AS id FROM customer), r AS (SELECT c_name AS id FROM customer), sizes AS (SELECT DISTINCT length(id) AS n FROM l),
m AS (SELECT l.id, r.id AS match, 1 AS tier FROM l JOIN r ON l.id = r.id UNION ALL SELECT l.id, r.id, 2 FROM l JOIN r ON lower(l.id) = lower(r.id) UNION ALL SELECT l.id, p.id, 3 FROM (SELECT r.id, substr(r.id, 1, n) AS part FROM r JOIN sizes ON length(r.id) >= n) p JOIN l ON l.id = p.part)
SELECT id, match, tier FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, match) = 1""")
def j07_resolve_ids(d: Data) -> DataFrame:
    return J.resolve_ids(id_variants(d.customer), d.customer.select(F.col("c_name").alias("id")))


@query("SELECT DISTINCT o_custkey AS patient_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey IN (SELECT user_id FROM events)")
def j08_align_sources(d: Data) -> DataFrame:
    return J.align_sources([d.orders.select(F.col("o_custkey").alias("patient_id")), d.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("patient_id")), d.events.select(F.col("user_id").alias("patient_id"))])


_WEIGHTS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


@query("SELECT repeat_id, w, avg(w * prob_a + (1 - w) * prob_b) AS blend FROM preds CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS w) GROUP BY 1, 2", "w blend")
def j09_scan_weights(d: Data) -> DataFrame:
    return J.scan_weights(d.preds, _WEIGHTS).groupBy("repeat_id", "w").agg(F.avg(F.expr("w * prob_a + (1 - w) * prob_b")).alias("blend"))


CENTROIDS = "e AS (SELECT patient_id, cluster_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM tokens), k AS (SELECT patient_id, cluster_id FROM tokens GROUP BY 1, 2 HAVING count(*) >= 2), c AS (SELECT patient_id, cluster_id, d, avg(v) AS v FROM e JOIN k USING (patient_id, cluster_id) GROUP BY 1, 2, 3)"
PAIRS = f"{CENTROIDS}, pairs AS (SELECT a.patient_id, a.cluster_id AS i, b.cluster_id AS j, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS distance FROM c a JOIN c b ON a.patient_id = b.patient_id AND a.d = b.d AND a.cluster_id < b.cluster_id GROUP BY 1, 2, 3)"


@query(f"WITH {PAIRS} SELECT * FROM pairs", "distance")
def j10_centroid_pairs(d: Data) -> DataFrame:
    return J.centroid_pairs(d.tokens, 2)


@query("SELECT repeat_id, patient_id, coalesce((sum(prob_a) OVER w - prob_a) / nullif(count(*) OVER w - 1, 0), avg(prob_a) OVER ()) AS loo FROM preds WINDOW w AS (PARTITION BY patient_id)", "loo")
def j11_leave_one_split_out(d: Data) -> DataFrame:
    return J.leave_one_split_out(d.preds, "prob_a").select("repeat_id", "patient_id", "loo")


PROTOS = "SELECT CAST(label AS INTEGER) AS k, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1"


def prototypes(d: Data) -> DataFrame:
    """The first vector of each label."""
    return d.embeddings.groupBy(F.col("label").cast("int").alias("k")).agg(A.doubles(F.min_by("embedding", "vec_id")).alias("centroid"))


@query(f"""WITH p AS ({PROTOS}), s AS (SELECT t.vec_id AS token_id, p.k, list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings t CROSS JOIN p JOIN embeddings q ON q.vec_id = p.vec_id)
SELECT token_id, k AS proto, s AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY s DESC, k) = 1""", "similarity")
def j12_assign_prototypes(d: Data) -> DataFrame:
    return J.assign_prototypes(d.embeddings.select(F.col("vec_id").alias("token_id"), "embedding"), prototypes(d)).select("token_id", "proto", "similarity")


RESAMPLED = """r AS (SELECT patient_id, value, row_number() OVER (PARTITION BY patient_id ORDER BY pos, slice_index) - 1 AS i, count(*) OVER (PARTITION BY patient_id) AS k FROM seq),
g AS (SELECT p.patient_id, p.k, t.g, CASE WHEN p.k = 1 THEN 0 ELSE least((t.g * (p.k - 1)) // 20, p.k - 1) END AS i FROM (SELECT DISTINCT patient_id, k FROM r) p CROSS JOIN (SELECT unnest(range(21)) AS g) t),
grid AS (SELECT g.patient_id, g.g, g.g / 20.0::DOUBLE AS t, a.value + (g.g * (g.k - 1) / 20.0::DOUBLE - g.i) * coalesce(b.value - a.value, 0) AS value FROM g JOIN r a ON a.patient_id = g.patient_id AND a.i = g.i LEFT JOIN r b ON b.patient_id = g.patient_id AND b.i = g.i + 1)"""


@query(f"WITH {RESAMPLED} SELECT * FROM grid", "t value")
def j13_resample_grid(d: Data) -> DataFrame:
    return J.resample_grid(d.seq, 21)


@query("SELECT token_id, avg(CAST(slice_index AS DOUBLE) * 2.5) OVER (PARTITION BY patient_id, slice_index) AS z FROM grid_tokens", "z")
def j14_lookup_slice_position(d: Data) -> DataFrame:
    slices = d.grid_tokens.select("patient_id", "slice_index").distinct().withColumn("z", F.col("slice_index") * F.lit(2.5))
    return J.lookup_slice_position(d.grid_tokens, slices).select("token_id", "z")


@query(f"SELECT token_id, CAST(d AS INTEGER) AS d, v FROM ({_UNIT}) UNION ALL SELECT token_id, 64, z_mm FROM tokens", "v")
def j15_concat_blocks(d: Data) -> DataFrame:
    t = d.tokens
    return J.concat_blocks(t.select("token_id", A.doubles(F.col("embedding")).alias("features")), t.select("token_id", F.array("z_mm").alias("features")), "token_id").select("token_id", F.posexplode("features").alias("d", "v"))


@query("""SELECT 'train' AS "left", 'val' AS "right", count(DISTINCT o_custkey) AS overlap, (SELECT count(*) - count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 3 = 0) AS duplicates FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)
UNION ALL SELECT 'train', 'test', count(DISTINCT o_custkey), (SELECT count(*) - count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 3 = 0) FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 2)
UNION ALL SELECT 'val', 'test', count(DISTINCT o_custkey), (SELECT count(*) - count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 3 = 1) FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 2)""")
def j16_check_disjoint(d: Data) -> DataFrame:
    part = lambda k: d.orders.where(f"o_orderkey % 3 = {k}").select(F.col("o_custkey").alias("patient_id"))
    return J.check_disjoint({"train": part(0), "val": part(1), "test": part(2)})


@query("SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS label FROM customer")
def u01_union_sources(d: Data) -> DataFrame:
    c = d.customer.select(F.col("c_custkey").alias("patient_id"))
    return J.union_sources([c.withColumn("label", F.lit(1)), c.where("patient_id % 2 = 0").withColumn("label", F.lit(2))])


@query("SELECT c_custkey AS patient_id FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events")
def u02_intersect_ids(d: Data) -> DataFrame:
    return J.intersect_ids([d.customer.select(F.col("c_custkey").alias("patient_id")), d.orders.select(F.col("o_custkey").alias("patient_id")), d.events.select(F.col("user_id").alias("patient_id"))])


@query("SELECT c_custkey AS patient_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u03_except_ids(d: Data) -> DataFrame:
    return J.except_ids(d.customer.select(F.col("c_custkey").alias("patient_id")), d.orders.select(F.col("o_custkey").alias("patient_id")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_custkey % 4 IN (0, 1) AS fit FROM customer")
def u04_fit_and_assign_ids(d: Data) -> DataFrame:
    part = lambda w: d.customer.where(w).select(F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("patient_id"))
    return J.fit_and_assign_ids(part("c_custkey % 4 = 0"), part("c_custkey % 4 = 1"), part("true"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def a44_dedupe_last(d: Data) -> DataFrame:
    rows = d.orders.withColumn("age", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")))
    return C.dedupe_last(rows, "o_custkey", "o_orderkey", ["age"], drop_first=True).select("o_custkey", "o_orderkey")
