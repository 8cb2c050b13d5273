"""Functions, metrics and report readers by name."""

import pytest
from pyspark.sql import functions as F

from folia.functions import registry


def test_columns_by_name(spark):
    assert registry.options(["k=3", "x=0.5", "on=true", "name=a=b"]) == {"k": 3, "x": 0.5, "on": True, "name": "a=b"}
    with pytest.raises(ValueError):
        registry.options(["k"])
    with pytest.raises(KeyError, match="known are"):
        registry.apply("nothing", F.lit("x"))
    with pytest.raises(ValueError):
        registry.COLUMNS.add("norm")
        registry.COLUMNS.add("norm")(lambda: None)
    r = spark.range(1).select(registry.apply("norm", F.lit("  A  b ")).alias("a"), registry.apply("shingles", F.lit("abcd"), ["k=3"]).alias("b")).first()
    assert (r.a, sorted(r.b)) == ("a b", ["abc", "bcd"])


def test_metrics_by_task(spark):
    df = spark.createDataFrame([("a", "a", 1.0, 1.5, [0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 1.0]), ("b", "a", 2.0, 2.0, [0.0, 0.0, 1.0, 1.0], [0.5, 0.0, 1.0, 1.0])], "t string, p string, y double, z double, g array<double>, h array<double>")
    assert registry.metrics("classification", df, "t", "p").first().accuracy == 0.5
    r = registry.metrics("regression", df, "y", "z").first()
    assert (r.r2, r.mae) == (0.5, 0.25)
    r = registry.metrics("bbox", df, "g", "h").first()
    assert (r.mean_iou, r.iou_at_50) == (round((1 + 1 / 3) / 2, 6), 0.5)
    with pytest.raises(KeyError):
        registry.metrics("other", df, "t", "p")


def test_udfs_in_sql(spark):
    assert registry.register_udfs(spark) == ["partial_ratio"]
    assert spark.sql("SELECT partial_ratio('abc', 'xxabcxx') AS r").first().r == 100.0
