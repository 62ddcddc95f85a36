"""Cleaning of cohort tables: ids, labels, sex codes, numbers, gates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

#: Aliases of the id and label columns, words of positive labels, words of the male indicator.
ID_NAMES, LABEL_NAMES = ("patient_id", "ID", "id"), ("label", "case", "Label", "TTS")
POSITIVE_WORDS = ("tts", "takotsubo")
MALE_WORDS, FEMALE_WORDS = ("m", "male", "man", "1"), ("f", "female", "woman", "0")


def harmonise_cohort(df: DataFrame) -> DataFrame:
    """(patient_id, label, age, sex) by the first alias present; a missing column is an error."""

    def first(names: tuple[str, ...]) -> Column:
        found = next((n for n in names if n in df.columns), None)
        if found is None:
            raise ValueError(f"none of the columns {names} is present")
        return F.col(found)

    label = first(LABEL_NAMES)
    numbers = df.select(label).schema[0].dataType
    return df.select(
        F.trim(first(ID_NAMES).cast("string")).alias("patient_id"), binary_label(label, numeric=isinstance(numbers, (NumericType, BooleanType))).alias("label"),
        first(("age",)).try_cast("double").alias("age"), F.upper(F.trim(first(("sex",)).cast("string"))).alias("sex"),
    )


def binary_label(c: Column, words: tuple[str, ...] = POSITIVE_WORDS, numeric: bool = False) -> Column:
    """Text that holds a positive word is 1, text of digits its number, any other text 0 (so '1.0' is 0); of a numeric column the
    integer part, null where it has none. Null stays null."""
    if numeric:
        return c.try_cast("int")
    text = F.lower(F.trim(c.cast("string")))
    held = reduce(or_, [F.contains(text, F.lit(w)) for w in words])
    return F.when(text.isNull(), None).when(held, F.lit(1)).when(text.rlike("^[0-9]+$"), text.try_cast("int")).otherwise(F.lit(0))


def label_by_words(c: Column, table: dict[str, int]) -> Column:
    """The dictionary variant: a known word, else the integer part of a number, else 0."""
    text = F.lower(F.trim(c.cast("string")))
    out = F.coalesce(text.try_cast("double").cast("int"), F.lit(0))
    for word, value in table.items():
        out = F.when(text == word, F.lit(value)).otherwise(out)
    return out


def sex_code(c: Column, convention: str) -> Column:
    """m0f1: starts with M is 0, F is 1, else null; f0m1: F is 0, M is 1, else an error; male: word lists, else null; half: M is 1, F is 0, else 0.5."""
    text = F.upper(F.trim(c.cast("string")))
    m, f = text.startswith("M"), text.startswith("F")
    if convention == "m0f1":
        return F.when(m, 0.0).when(f, 1.0)
    if convention == "f0m1":
        return F.when(text == "F", 0.0).when(text == "M", 1.0).otherwise(F.raise_error(F.concat(F.lit("unknown sex: "), F.coalesce(text, F.lit("null")))).cast("double"))
    if convention == "male":
        return F.when(F.lower(text).isin(*MALE_WORDS), 1.0).when(F.lower(text).isin(*FEMALE_WORDS), 0.0)
    if convention == "half":
        return F.when(text == "M", 1.0).when(text == "F", 0.0).otherwise(0.5)
    raise ValueError(f"unknown convention: {convention}")


def to_number(c: Column) -> Column:
    """A double, or null where the text is none or not a number."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def filter_model(df: DataFrame, want: str | None) -> DataFrame:
    """Rows of one model; no wish keeps all; none found is an error."""
    if not want:
        return df
    out = df.where(F.col("model") == want)
    if out.isEmpty():
        raise ValueError(f"no rows of model {want!r}")
    return out


def finite(vector: str) -> Column:
    """Whether every element of an array column is a finite number."""
    return F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def valid_tokens(df: DataFrame, position: str = "z_mm") -> DataFrame:
    """Tokens inside the mask with a finite position and a finite embedding; without a mask column all are inside."""
    inside = F.col("mask") == 1 if "mask" in df.columns else F.lit(True)
    return df.where(inside & F.col(position).isNotNull() & ~F.isnan(position) & (F.abs(position) < float("inf")) & finite("embedding"))


def finite_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Groups whose feature arrays are all finite."""
    for c in columns:
        df = df.where(finite(c))
    return df


def cohort_gate(tokens: DataFrame, cohort: DataFrame, least: int = 5) -> DataFrame:
    """Tokens of cohort members with an age and a known sex; fewer than `least` groups is an error."""
    members = cohort.withColumn("sex_code", sex_code(F.col("sex"), "m0f1")).where("age is not null and not isnan(age) and sex_code is not null")
    out = tokens.join(members, "patient_id")
    if out.select("patient_id").distinct().limit(least).count() < least:
        raise ValueError(f"fewer than {least} groups are left")
    return out


def coerce_split_key(c: Column) -> Column:
    """A struct that sorts numeric keys, as integers, before others, as strings."""
    number = c.cast("string").try_cast("bigint")
    return F.struct(number.isNull().alias("is_text"), number.alias("number"), F.when(number.isNull(), c.cast("string")).alias("text"))


def strip_demographic_suffix(c: Column) -> Column:
    """The id without a trailing underscore, age and sex letter."""
    return F.regexp_replace(c, "(?i)_[0-9]+[FM]$", "")


def label_with_source(ids: DataFrame, labels: DataFrame, control_pattern: str) -> DataFrame:
    """(id, label, label_source): by the exact id, the stripped id, or 0 where the id matches the pattern of controls."""
    exact = labels.select(F.col("id"), F.col("label").alias("exact"))
    stripped = labels.select(F.col("id").alias("bare"), F.col("label").alias("by_bare"))
    out = ids.withColumn("bare", strip_demographic_suffix(F.col("id"))).join(exact, "id", "left").join(stripped, "bare", "left")
    pattern = F.when(F.col("id").rlike(control_pattern), F.lit(0))
    source = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_bare").isNotNull(), "stripped").when(pattern.isNotNull(), "pattern")
    return out.select("id", F.coalesce("exact", "by_bare", pattern).alias("label"), source.alias("label_source"))


def id_from_file(c: Column, suffix: str = "_roi.nii.gz") -> Column:
    """The file's name without folder and suffix."""
    name = F.regexp_extract(c, r"([^/]*)$", 1)
    return F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "")


def format_head(kind: Column, c: Column, ratio: Column) -> Column:
    """Name of a model head from its kind and parameters; absent parameters are left out."""
    return F.concat_ws("_", kind, F.when(c.isNotNull(), F.concat(F.lit("C"), c)), F.when(ratio.isNotNull(), F.concat(F.lit("r"), ratio)))


def parse_head(name: Column) -> Column:
    """struct(kind, c, ratio) of a head's name; an unknown kind is an error."""
    kind = F.regexp_extract(name, r"^(logistic_en|logistic_l1|logistic_l2|linear_svc|rbf_svc)(?:_|$)", 1)
    number = lambda letter: F.nullif(F.regexp_extract(name, rf"_{letter}([0-9.]+)", 1), F.lit("")).cast("double")
    return F.struct(F.when(kind == "", F.raise_error(F.concat(F.lit("unknown head: "), name))).otherwise(kind).alias("kind"), number("C").alias("c"), number("r").alias("ratio"))


def protocol_violations(a: DataFrame, b: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(column, problem) for each protocol column that is not single-valued on a side, differs, or is on one side only."""
    spark, parts = a.sparkSession, []
    for c in columns:
        if c not in a.columns and c not in b.columns:
            continue
        if c not in a.columns or c not in b.columns:
            parts.append(spark.range(1).select(F.lit(c).alias("column"), F.lit("one side only").alias("problem")))
            continue
        side = lambda df, s: df.agg(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("NaN"))).alias(f"n_{s}"), F.max(F.coalesce(F.col(c).cast("string"), F.lit("NaN"))).alias(f"v_{s}"))  # noqa: E731,B023
        near = F.coalesce(F.abs(F.col("v_a").try_cast("double") - F.col("v_b").try_cast("double")) <= tolerance, F.lit(False)) | (F.col("v_a") == F.col("v_b"))
        problem = F.when((F.col("n_a") > 1) | (F.col("n_b") > 1), "several values").when(~near, "values differ")
        parts.append(side(a, "a").join(side(b, "b")).select(F.lit(c).alias("column"), problem.alias("problem")).where("problem is not null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_ids(df: DataFrame, column: str) -> DataFrame:
    """A row per id of a list joined by semicolons; blanks are dropped."""
    return df.withColumn(column, F.explode(F.split(column, ";"))).withColumn(column, F.trim(column)).where(F.col(column) != "")


def join_ids(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The sorted ids of each group in one text."""
    return df.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(F.col(column).cast("string"))), ";").alias(column))


def resolve_weight_column(df: DataFrame, weight: float, prefix: str = "roc_ensemble_w") -> str:
    """The column of a blend weight, by its shortest text or else by its number within 1e-6."""
    exact = f"{prefix}{weight:g}"
    if exact in df.columns:
        return exact
    for c in df.columns:
        if c.startswith(prefix):
            try:
                if abs(float(c[len(prefix) :]) - weight) <= 1e-6:
                    return c
            except ValueError:
                continue
    raise ValueError(f"no column of weight {weight:g}")


def order_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """Key columns first, unnamed columns dropped."""
    rest = [c for c in df.columns if c not in first and not c.startswith("Unnamed")]
    return df.select(*(c for c in first if c in df.columns), *rest)


def every_nth(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """Positions 0, n, 2n, ... of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("place", place).where(F.col("place") % n == 0)


def pct_diff(a: Column, b: Column) -> Column:
    """100 (b - a) / |a|; null where a is about 0 or one is missing."""
    return F.when(F.abs(a) >= 1e-15, 100.0 * (b - a) / F.abs(a))


def wide_to_long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, metric, value) rows."""
    return df.unpivot(keys, columns, "metric", "value")


def dedupe_last(df: DataFrame, key: str, order: str, drop_missing: list[str] | None = None, drop_first: bool = True) -> DataFrame:
    """The last row of each key in input order; rows with missing values go before (drop_first) or after that."""
    if drop_missing and drop_first:
        df = df.dropna(subset=drop_missing)
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    out = df.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")
    return out.dropna(subset=drop_missing) if drop_missing and not drop_first else out


def with_rejects(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds `reason`: the first rule whose condition holds, null for rows that stay."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)
