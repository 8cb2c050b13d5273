"""Helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col_query(name: str, source: str, keys: str, out: Callable[[], dict], sql: str) -> Query:
    """A projection: ``keys`` and computed columns of a table, with its SQL; columns are built when the query runs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(*keys.split(), *[c.alias(k) for k, c in out().items()])

    return run, sql


def literal_query(lit, out: Callable[[], dict], sql: str, keys: str = "id") -> Query:
    """A projection of a literal table ``f``; ``sql`` reads the table ``f``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lit.df(spark, sf_dir).select(*keys.split(), *[c.alias(k) for k, c in out().items()])

    return run, f"WITH {lit.cte('f')} {sql}"


__all__ = ["F", "Query", "col_query", "literal_query", "table"]
