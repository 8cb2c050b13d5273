"""Report aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster_census(pages: DataFrame, *, exact: str, coarse: str, top: int = 10) -> DataFrame:
    """One row: pages, distinct signatures, singletons, share of the ``top`` largest coarse clusters."""
    sizes = pages.groupBy(coarse).agg(F.count("*").alias("n"), F.count_distinct(exact).alias("e"))
    # only the largest clusters are ranked; their number is fixed
    best = sizes.orderBy(F.desc("n"), coarse).limit(top).agg(F.sum("n").alias("top"))
    whole = sizes.agg(F.sum("n").alias("pages"), F.count("*").alias("coarse"), F.count_if(F.col("n") == 1).alias("singletons"))
    kinds = pages.agg(F.count_distinct(exact).alias("exact"))
    return whole.crossJoin(best).crossJoin(kinds).select("pages", "exact", "coarse", "singletons", F.round(F.col("top") / F.col("pages"), 6).alias("top_share"))


def mean_ci(x: Column, digits: int = 6) -> list[Column]:
    """n, mean and half width 1.96 * sqrt(sample variance / n) (0 for one value), rounded."""
    half = F.coalesce(1.96 * F.sqrt(F.var_samp(x) / F.count(x)), F.lit(0.0))
    return [F.count(x).alias("n"), F.round(F.avg(x), digits).alias("mean"), F.round(half, digits).alias("half")]


def with_total(df: DataFrame, keys: list[str], aggs: list[Column], label: str = "all") -> DataFrame:
    """The aggregates by each of ``keys`` alone and over all rows: (axis, key, ...)."""
    sets = [[k] for k in keys] + [[]]
    out = df.groupingSets(sets, *keys).agg(*aggs, F.grouping_id().alias("_g"))
    axis, key = F.lit(label), F.lit(label)
    for i, k in enumerate(keys):
        here = F.col("_g") == sum(1 << (len(keys) - 1 - j) for j in range(len(keys)) if j != i)
        axis, key = F.when(here, F.lit(k)).otherwise(axis), F.when(here, F.col(k)).otherwise(key)
    return out.select(axis.alias("axis"), key.alias("key"), *[c for c in out.columns if c not in keys + ["_g"]])


def confusion(a: Column, b: Column) -> list[Column]:
    """Counts of pass/fail pairs, net change and both pass rates (one digit)."""
    n = lambda x, y: F.count_if((a == x) & (b == y))
    rate = lambda x: F.round(100.0 * F.avg(x.cast("double")), 1)
    return [n(True, True).alias("pp"), n(True, False).alias("pf"), n(False, True).alias("fp"), n(False, False).alias("ff"), (n(False, True) - n(True, False)).alias("net"), rate(a).alias("pass_a"), rate(b).alias("pass_b")]


def classification(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: accuracy and macro F1 over all labels of either column (a label never predicted or never true scores 0)."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("t"), F.lit(0).alias("p"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("k"), F.lit(0).alias("t"), F.col("n").alias("p"), F.lit(0).alias("tp")))).alias("x"))
    by = sides.groupBy("x.k").agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"), F.sum("x.tp").alias("tp"))
    return by.agg(F.round(F.sum("tp") / F.sum("t"), 9).alias("accuracy"), F.round(F.avg(F.when(F.col("t") + F.col("p") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)), 9).alias("macro_f1"))


def regression(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: R2 (1 - residual over total sum of squares) and mean absolute error."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    s = df.agg(F.sum((y - p) ** 2).alias("res"), (F.var_pop(y) * F.count(y)).alias("tot"), F.avg(F.abs(y - p)).alias("mae"))
    return s.select(F.round(1 - F.col("res") / F.col("tot"), 6).alias("r2"), F.round("mae", 6).alias("mae"))


def most_frequent(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): each group's most frequent value, the smallest of several."""
    c = df.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
