"""Sources: line and array JSON, gold texts, reports, whole-text trees, listings and binary headers."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions import derive


def jsonl(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """Line-delimited JSON by schema (blank lines fall out); a row without a required key is an error that names its file."""
    df = spark.read.schema(schema).json(path)
    for k in required or []:
        df = df.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.concat(F.lit(f"no {k} in "), F.input_file_name())).cast(df.schema[k].dataType)).otherwise(F.col(k)))
    return df


def jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Line-delimited JSON without its malformed lines."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Rows of one JSON array, or of the ``data`` or ``samples`` array of an object."""
    t = spark.read.text(path, wholetext=True).select(F.col("value"))
    kind = f"array<{element}>"
    rows = F.when(F.rlike("value", F.lit(r"^\s*\[")), F.from_json("value", kind)).otherwise(F.coalesce(F.from_json(F.get_json_object("value", "$.data"), kind), F.from_json(F.get_json_object("value", "$.samples"), kind)))
    return t.select(F.explode(rows).alias("r")).select("r.*")


def rule_gold(spark: SparkSession, path: str) -> DataFrame:
    """(pdf, text): text fragments of a tree of rule files by page, rules of absence left out, in file and line order."""
    r = spark.read.schema("pdf string, type string, text string, before string, after string, cell string").option("recursiveFileLookup", True).json(path)
    r = r.where("type <> 'absent'").select("pdf", F.concat_ws(" ", "text", "before", "after", "cell").alias("t"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("k"))
    return r.groupBy("pdf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "k", "t"))), lambda x: x["t"]), " ").alias("text"))


TASKS = ("bbox", "classification", "regression")
_PROBE = "probe string, image_id string, label string, point_xy array<double>, doc_id string, task_type string, site string, meta map<string,string>"


def probes(spark: SparkSession, path: str) -> DataFrame:
    """Probe rows of JSON lines (labels as their JSON text), with ``pooled`` and each one's document.

    A missing probe, image or label, a site row without a point and an unknown task type are errors that name the file.
    """
    p = spark.read.schema(_PROBE).json(path)
    pooled = F.coalesce(F.col("site") == "pooled", F.lit(False)) | F.startswith("probe", F.lit("pl3"))
    fault = F.lit(None).cast("string")
    for k in ("label", "image_id", "probe"):
        fault = F.when(F.col(k).isNull(), F.lit(f"a probe row needs {k}")).otherwise(fault)
    fault = F.coalesce(fault, F.when(~pooled & F.col("point_xy").isNull(), "a site probe needs point_xy"), F.when(~F.col("task_type").isin(*TASKS), "unknown task_type"))
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(" in "), F.input_file_name())).cast("string")).otherwise(F.col("probe"))
    p = p.withColumn("probe", checked).withColumn("pooled", pooled)
    return p.withColumn("doc_id", F.coalesce(F.nullif("doc_id", F.lit("")), derive.doc_id(F.col("image_id"))))


def text_layers(pages: DataFrame) -> DataFrame:
    """(file, text, pages): the text layers of a file's pages (file, page, text), in order; pages without one are left out."""
    t = pages.where("text IS NOT NULL").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return t.select("file", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.size("p").cast("bigint").alias("pages"))


def texts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, text) of whole files of a tree whose name ends with a suffix."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, bytes) of files of a tree; their content is not read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return b.select("path", F.col("length").alias("bytes")).orderBy("path")


def is_manifest(text: Column) -> Column:
    """Whether a whole text is one JSON object (a manifest) and not JSON lines."""
    return F.try_parse_json(text).isNotNull() & F.rlike(text, F.lit(r"^\s*\{")) & ~F.rlike(text, F.lit(r"\}\s*\n\s*\{"))


def tensor_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, begin, end, sha256) of the tensors of files with a length-prefixed JSON header."""

    def run(batches):
        import hashlib

        for t in batches:
            rows = []
            for p, content in zip(t["path"], t["content"], strict=True):
                (n,) = struct.unpack("<Q", content[:8])
                for name, x in sorted(json.loads(content[8 : 8 + n]).items()):
                    if name != "__metadata__":
                        a, b = x["data_offsets"]
                        rows.append((p, name, a, b, hashlib.sha256(content[8 + n + a : 8 + n + b]).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "name", "begin", "end", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, begin bigint, end bigint, sha256 string")


# The lines of a scorer's report.
FILE_LINE = r"(?m)^\s+(\S+)\s+: ([\d.]+)% \((\d+)/(\d+) tests\)"
FAIL_LINE = r"\[FAIL\] Test (\S+) .*?Ex: (.*)"


def report_files(text: Column) -> Column:
    """array<struct<name, score, passed, total>> of the last summary of a report."""
    last = F.substring_index(text, "Final Summary", -1)
    part = lambda k: F.regexp_extract_all(last, F.lit(FILE_LINE), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")), lambda z: F.struct(z["a"].alias("name"), z["b"].cast("double").alias("score"), z["c"].cast("bigint").alias("passed"), z["d"].cast("bigint").alias("total")))
