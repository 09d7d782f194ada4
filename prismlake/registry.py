"""Queries and their SQL, collected from modules that define QUERIES and SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def collect(modules: list[str]) -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in modules:
        m = importlib.import_module(name)
        clash = queries.keys() & m.QUERIES.keys()
        if clash:
            raise ValueError(f"{name} defines again: {sorted(clash)}")
        queries.update(m.QUERIES)
        sql.update(m.SQL)
    return queries, sql
