"""Session, path and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step looks at; a longer single document is taken alone.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one under the warehouse where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_folia"
    return at.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string column without copying the text; nulls are empty."""
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
        if not pa.types.is_string(col.type):
            col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def row_steps(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``step`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def release() -> None:
    """Give freed memory back to the system: Python workers are reused by later tasks and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` (of mapInArrow), releasing memory at the end of a task."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def append_columns(df: DataFrame, inputs: list[str], make: Callable, added: T.StructType, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with columns computed batch-wise; ``make()`` gives, once a task, a function from the input columns (Arrow arrays) to a list of arrays.

    A column of ``df`` that has the name of an added one is replaced; other columns ride along untouched.
    """
    names = [c for c in df.columns if c not in {f.name for f in added.fields} and c not in drop]
    need = [F.col(f"`{c}`").alias(f"i{k}") for k, c in enumerate(inputs)]
    ride = [F.col(f"`{c}`").alias(f"r{k}") for k, c in enumerate(names)]
    inner = df.select(*need, *ride)
    out = T.StructType([T.StructField(f"r{k}", df.schema[c].dataType) for k, c in enumerate(names)] + list(added.fields))
    n_in, n_ride = len(inputs), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            cols = step(*batch.columns[:n_in])
            yield pa.RecordBatch.from_arrays(list(batch.columns[n_in : n_in + n_ride]) + list(cols), names=[f.name for f in out.fields])

    res = inner.mapInArrow(lean(run), out)
    return res.select(*[F.col(f"r{k}").alias(c) for k, c in enumerate(names)], *[F.col(f.name) for f in added.fields])


def riding(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` as (r: all columns but the text, text), so that no column can clash with added ones."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("none")]
    return docs.select(F.struct(*others).alias("r"), F.col(f"`{text_col}`").cast("string").alias("text"))


def unpacked(docs: DataFrame, text_col: str, text: Column, drop: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``docs`` out of ``r``, with another text."""
    return [(text if c == text_col else F.col(f"r.`{c}`")).alias(c) for c in docs.columns if c not in drop]


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where a lambda in ``use`` refers to it for every element."""
    return F.get(F.transform(F.array(value), use), 0)
