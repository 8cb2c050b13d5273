"""Registry of the reference operators' queries: name -> (DataFrame builder, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("text_queries", "derive_queries", "join_queries", "agg_queries", "window_queries", "feature_queries", "stat_queries", "kernel_queries", "io_queries")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _name in MODULES:
    for _key, (_run, _sql) in import_module(f"folia.plans.{_name}").QUERIES.items():
        if _key in QUERIES:
            raise ValueError(f"two queries named {_key}")
        QUERIES[_key] = _run
        if _sql:
            ORACLE_SQL[_key] = _sql
