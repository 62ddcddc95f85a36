"""Registered queries of the cohort operators."""

from __future__ import annotations

from . import queries_basic, queries_metrics, queries_models, queries_pooling  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
