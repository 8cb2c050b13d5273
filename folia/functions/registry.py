"""Functions by name: scalar functions with options, metrics by task type and report readers, for callers that pick them by a string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import geometry as G
from folia.functions import text as X
from folia.operators import aggregates as A
from folia.sources import readers as R


class Registry:
    """Named factories: ``make`` calls one with options; an unknown name is an error that lists the known ones."""

    def __init__(self, kind: str):
        self.kind, self.known = kind, {}

    def add(self, name: str) -> Callable:
        def put(make: Callable) -> Callable:
            if name in self.known:
                raise ValueError(f"{self.kind} {name} is there already")
            self.known[name] = make
            return make

        return put

    def make(self, name: str, **options):
        if name not in self.known:
            raise KeyError(f"unknown {self.kind} {name}; known are {', '.join(sorted(self.known))}")
        return self.known[name](**options)


def options(items: list[str]) -> dict:
    """``key=value`` words as options: whole numbers, numbers, true and false are read as such."""
    out = {}
    for item in items:
        key, sep, value = item.partition("=")
        if not sep or not key:
            raise ValueError(f"{item!r} is not key=value")
        for read in (int, float):
            try:
                out[key] = read(value)
                break
            except ValueError:
                out[key] = {"true": True, "false": False}.get(value.lower(), value)
    return out


#: factories of Column -> Column
COLUMNS = Registry("column function")
#: by task type: (rows, truth, prediction) -> one row of metrics, the first of them the primary one
METRICS = Registry("metric set")
#: by report kind: text -> parsed Column
REPORTS = Registry("report reader")

COLUMNS.add("norm")(lambda: X.norm_simple)
COLUMNS.add("light_norm")(lambda: X.light_norm)
COLUMNS.add("content_norm")(lambda: X.content_norm)
COLUMNS.add("shingles")(lambda k=12: lambda t: X.char_shingles(t, k))
COLUMNS.add("word_shingles")(lambda k=8: lambda t: X.word_shingles(t, k))
COLUMNS.add("bilinear")(lambda x=0.5, y=0.5, grid=4: lambda v: G.bilinear(v, F.lit(x), F.lit(y), grid))
REPORTS.add("summary")(lambda: R.report_files)


@METRICS.add("classification")
def _classes():
    return A.classification


@METRICS.add("regression")
def _numbers():
    return A.regression


@METRICS.add("bbox")
def _boxes():
    def run(df: DataFrame, truth: str, pred: str) -> DataFrame:
        box = lambda c: tuple(F.get(F.col(c), k) for k in range(4))
        iou = G.iou(box(truth), box(pred))
        return df.agg(F.round(F.avg(iou), 6).alias("mean_iou"), F.round(F.avg((iou >= 0.5).cast("double")), 6).alias("iou_at_50"))

    return run


def metrics(task: str, df: DataFrame, truth: str, pred: str) -> DataFrame:
    """The metrics of a task type."""
    return METRICS.make(task)(df, truth, pred)


def apply(name: str, value: Column, items: list[str] | None = None) -> Column:
    """A named column function with ``key=value`` options."""
    return COLUMNS.make(name, **options(items or []))(value)


def register_udfs(spark: SparkSession) -> list[str]:
    """Python scalar functions for SQL by name; what Spark has built in is not registered."""
    spark.udf.register("partial_ratio", X.partial_ratio_value, "double")
    return ["partial_ratio"]
