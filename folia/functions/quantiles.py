"""The quantile rules in use, kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear(x: Column, q: float, digits: int | None = None) -> Column:
    """Linear interpolation; NaN is left out."""
    v = F.percentile(F.when(~F.isnan(x.cast("double")), x), F.lit(q))
    return v if digits is None else F.bround(v, digits)


def at_rank(df: DataFrame, key: str, value: str, place: Callable[[Column], Column]) -> DataFrame:
    """(key, value): the value at 0-based ``place`` (of the number of values) in each group's sorted values, from counts per value: no group's values are gathered."""
    c = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    upto, total = F.sum("n").over(Window.partitionBy(key).orderBy(value)), F.sum("n").over(Window.partitionBy(key))
    c = c.withColumn("upto", upto).withColumn("at", place(total))
    return c.where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at"))).select(key, value)


def with_ranks(df: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]], aggs: list[Column]) -> DataFrame:
    """Aggregates by ``key`` beside values ``at_rank`` of one column, by name."""
    out = df.groupBy(F.col(key).alias("_k")).agg(*aggs)
    for name, place in places.items():
        at = at_rank(df.select(F.col(key).alias("_r"), F.col(value).alias(name)), "_r", name, place)
        out = out.join(at, F.col("_k").eqNullSafe(F.col("_r")), "left").drop("_r")
    return out.withColumnRenamed("_k", key)


def nearest(p: float) -> Callable[[Column], Column]:
    """min(n - 1, int(p * n))."""
    return lambda n: F.least(n - 1, F.floor(n * F.lit(p)))


def below(p: float) -> Callable[[Column], Column]:
    """int(p * (n - 1))."""
    return lambda n: F.floor((n - 1) * F.lit(p))


def upper_middle(n: Column) -> Column:
    """n // 2."""
    return F.floor(n / 2)


def mode_first(x: Column) -> Column:
    """Most frequent value, the smallest of several: of a column of structs (count, value)."""
    return F.max_by(x["value"], F.struct(x["count"], -x["value"]))
