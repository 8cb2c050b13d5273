"""Sinks: JSON lines, reports, tables of text, upserts and split outputs. Spark's commit keeps partial output from readers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def place(spark: SparkSession, name: str = "io") -> str:
    """A new folder among those that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_folia"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to such a folder and read again: computed once, safe from lost executors."""
    at = place(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def split(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def _versions(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    return fs, sorted(int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit())


def atomic(df: DataFrame, path: str) -> None:
    """Write a new version of a table: complete under another name, then renamed, so that ``latest`` never sees a part. One writer at a time."""
    spark = df.sparkSession
    part = f"{path}/_writing-{uuid.uuid4().hex}"
    df.write.parquet(part)
    fs, known = _versions(spark, path)
    to = f"{path}/v-{(known or [0])[-1] + 1:06d}"
    if not fs.rename(*[spark._jvm.org.apache.hadoop.fs.Path(x) for x in (part, to)]):
        raise OSError(f"{part} could not be renamed to {to}")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version that ``atomic`` wrote."""
    _, known = _versions(spark, path)
    if not known:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v-{known[-1]:06d}")


def report_json(df: DataFrame, limit: int = 10_000) -> str:
    """A report table (of a checked size) as indented, key-sorted JSON."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a report has more rows than a document should")
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=2, sort_keys=True, default=str)


def markdown(df: DataFrame, limit: int = 1_000) -> str:
    """A report table (of a checked size) as a Markdown table; null is a dash."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("a table has more rows than a page should")
    line = lambda cells: "| " + " | ".join("-" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the fields that ``new`` gives for a key; other fields and keys stay."""
    cols = [c for c in old.columns if c != key]
    j = old.alias("o").join(new.alias("n"), key, "full")
    return j.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in cols])


def with_errors(df: DataFrame, ok: Column, most: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows); more than a share of bad rows is an error."""
    marked = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    n = marked.agg(F.count("*").alias("n"), F.count_if(~F.col("_ok")).alias("bad")).first()
    if n.n and n.bad / n.n > most:
        raise ValueError(f"{n.bad} of {n.n} rows are bad")
    return marked.where("_ok").drop("_ok"), marked.where("NOT _ok").drop("_ok")


def chunks(payload: Column, size: int = 3000) -> Column:
    """array<struct<seq, part>> of a payload's base64 text."""
    b = F.regexp_replace(F.base64(payload.cast("binary")), r"\s", "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(b) / size) - 1).cast("int")), lambda i: F.struct(i.alias("seq"), F.substring(b, i * size + 1, F.lit(size)).alias("part")))
