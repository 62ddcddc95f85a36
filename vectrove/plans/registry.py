"""Registration of queries together with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import VIEWS, Data, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS decimals, minus zero as zero: sums may be added up in any order."""
    return df.select(*((F.round(F.col(c), DIGITS) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def used_views(text: str) -> list[str]:
    found, todo = [], [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN|from|join)\s+{v}\b", text)]
    for v in todo:
        for w in used_views(VIEWS[v]):
            if w not in found:
                found.append(w)
        if v not in found:
            found.append(v)
    return found


def oracle(text: str, doubles: str) -> str:
    """A complete statement: views first, then the query's own common tables, doubles rounded as in rounded()."""
    ctes = [f"{v} AS ({duck_sql(VIEWS[v])})" for v in used_views(text)]
    body = duck_sql(text.strip())
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if body.upper().startswith("WITH "):
        body = body[15:] if recursive else body[5:]
        whole = f"WITH {'RECURSIVE ' * recursive}{', '.join([*ctes, body])}"
    else:
        whole = f"WITH {', '.join(ctes)} {body}" if ctes else body
    if doubles:
        each = ", ".join(f"CASE WHEN isfinite({c}) THEN round({c}, {DIGITS}) + 0.0 ELSE {c} END AS {c}" for c in doubles.split())
        whole = f"SELECT * REPLACE ({each}) FROM ({whole})"
    return whole


def query(sql: str | None = None, doubles: str = ""):
    """Register the decorated function of a Data object under its own name."""

    def add(f: Callable[[Data], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Data(spark, sf_dir)))
        if sql:
            SQL[f.__name__] = oracle(sql, doubles)
        return f

    return add
