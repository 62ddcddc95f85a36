"""Running sums, row numbers and tie groups over an order, without one task for all rows.

Rows are cut into ranges of the order by approximate percentiles; sums run within a range, and the sums of the ranges before
it, a row for each range and group, are added. Any cuts give the same result, so they may be approximate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Ranges of an order.
RANGES = 64


def running(df: DataFrame, order: str, by: list[str], sums: dict[str, Column], then: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows of the group that come before in `order` (a number), `then`."""
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"))
    rows = df.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col(order)))).drop("_cuts")  # one row
    rows = rows.withColumns({f"_v_{n}": c for n, c in sums.items()})
    inside = Window.partitionBy(*by, "_range").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*by, "_range").agg(*(F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums))
    if not by:  # RANGES rows, so one task is enough
        each = each.coalesce(1)
    each = each.select(*(F.col(c).alias(f"_k_{c}") for c in (*by, "_range")), *(F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    same = F.lit(True)
    for c in (*by, "_range"):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}).join(each, same)
    return out.select(*df.columns, *((F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def numbered(df: DataFrame, key: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the row's number from 0 in the order of a key, nulls first. Rows of equal keys are numbered in any order."""
    if df.schema[key].dataType.typeName() not in ("string", "binary", "struct", "array", "boolean"):
        return running(df, key, list(by), {name: F.lit(1).cast("long")})
    # keys without percentiles: Spark's own ranges, stored so that each row keeps its range
    rows = stored(df.repartitionByRange(RANGES, *by, key).withColumn("_range", F.spark_partition_id()), "ranges")
    each = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    if not by:  # RANGES rows, so one task is enough
        each = each.coalesce(1)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*(F.col(c).alias(f"_k_{c}") for c in (*by, "_range")), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for c in (*by, "_range"):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(key)) - 1
    return rows.withColumn("_place", place).join(each, same).select(*df.columns, (F.col("_place") + F.col("_before")).cast("long").alias(name))


def ties(df: DataFrame, value: str, by: list[str], **sums: Column) -> DataFrame:
    """(by, value, n, rank, sums): each distinct value of a group with its mean rank from 1; nulls and NaN are left out."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = stored(good.groupBy(*by, value).agg(F.count("*").alias("n"), *(c.alias(n) for n, c in sums.items())), "ties")  # read several times
    return running(rows, value, by, {"_below": F.col("n")}).withColumn("rank", F.col("_below") + (F.col("n") + 1) / 2.0).drop("_below")
