"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Features of a text are the hashed words (runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased), their
first five and seven bytes (so that forms of one stem are learned together), pairs of neighbours and pairs with one word
between, each counted once. Per-coordinate rates and L1 leave few weights, which
are broadcast. Training takes at most ``max_rows`` labelled rows of at most ``max_bytes`` of text in all, in the order of a
hash of their id, and drops features seen in fewer than ``min_docs`` of them; scoring covers every whole text. The default
rates and penalties come from ``choose`` and ``picked``: cross-validation inside the learning rows.

Defined results: a null or wordless text has the score of the intercept; a null id is not held out and is not learned from;
rows with a null label are ignored, of repeated labels the larger counts; without labels of both kinds every score is
the share of label 1, 0 without any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, lean, row_steps, string_parts, table
from .textvec import ALNUM, Words, find_words, gram_hashes, inside, mix, word_hashes

BITS = 20
STEMS = (5, 7)
MAX_ROWS = 10_000
MAX_BYTES = 32 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature, repeats included."""
    w = find_words(data, offsets, ALNUM)
    n = len(w)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = word_hashes(w, lower=True)
    doc = w.doc()
    parts, docs = [mix(h + np.uint64(1))], [doc]
    for stem in STEMS:
        long = np.flatnonzero(w.end - w.start > stem)
        cut = Words(data, w.start[long], w.start[long] + stem, w.count, w.first)
        parts.append(mix(word_hashes(cut, lower=True) + np.uint64(4)))
        docs.append(doc[long])
    for span, salt in ((2, 2), (3, 3)):
        ok = inside(w.first, w.count, n, span)
        g = gram_hashes(h, 2, salt) if span == 2 else mix(h[: max(0, n - 2)] * np.uint64(0x9E3779B97F4A7C15) + h[2:])
        parts.append(g[: len(ok)][ok])
        docs.append(doc[: len(ok)][ok])
    return np.concatenate(docs), (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]], *, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 3, min_docs: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, intercept). ``rows``: distinct feature buckets and label."""
    share = float(np.mean([y for _, y in rows])) if rows else 0.0
    if share in (0.0, 1.0):
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 30.0 if share else -30.0
    seen = np.bincount(np.concatenate([b for b, _ in rows]), minlength=1 << BITS)
    place = np.full(1 << BITS, -1, np.int64)
    known = np.flatnonzero(seen >= min_docs)
    place[known] = np.arange(len(known))
    xs = [(at[at >= 0], y) for b, y in rows for at in [place[b]]]
    z, n, w = np.zeros(len(known)), np.zeros(len(known)), np.zeros(len(known))
    bias, nb = float(np.log(share / (1 - share))), 1.0
    for e in range(epochs):
        for k in np.random.default_rng(e).permutation(len(xs)).tolist():
            x, y = xs[k]
            g = 1 / (1 + np.exp(-np.clip(bias + w[x].sum(), -35, 35))) - y
            root = np.sqrt(n[x])
            n[x] += g * g
            new = np.sqrt(n[x])
            zx = z[x] + g - (new - root) / alpha * w[x]
            z[x] = zx
            w[x] = np.where(np.abs(zx) > l1, -(zx - np.sign(zx) * l1) / ((beta + new) / alpha + l2), 0.0)
            nb += g * g
            bias -= alpha / np.sqrt(nb) * g
    on = np.flatnonzero(w)
    return known[on], w[on].astype(np.float32), bias


def sampled_ids(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows, those with the smallest hash of ``key``: a bounded table."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(max_rows)


def labelled_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[tuple[np.ndarray, int]]:
    """Feature buckets and label of a bounded number of rows of ``labels`` (id, label); ``docs`` gives their texts."""
    some = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    some = sampled_ids(some, "id", max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sized = texts.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(some), "id").groupBy("id", "y").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.orderBy(F.xxhash64(F.col("id").cast("string")), "id")) - F.col("size")  # of max_rows rows at most
    some = sized.withColumn("before", before).where(F.col("before") < max_bytes).select("id", "y")
    joined = texts.join(F.broadcast(some), "id").select("y", "text")

    def run(batches):
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            out = []
            for i, j in row_steps(offsets):
                doc, b = features(data, offsets[i : j + 1])
                both = np.unique((doc << BITS) | b)
                cut = np.searchsorted(both, np.arange(1, j - i) << BITS)
                out += [x & ((1 << BITS) - 1) for x in np.split(both, cut)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([x.astype(np.int32) for x in out], pa.list_(pa.int32()))], names=["y", "b"])

    got = joined.mapInArrow(lean(run), "y int, b array<int>").toArrow()
    rows = []
    for chunk in got.to_batches():
        flat, size = chunk.column("b").flatten().to_numpy(), chunk.column("b").value_lengths().to_numpy(zero_copy_only=False)
        rows += list(zip(np.split(flat, np.cumsum(size)[:-1]), chunk.column("y").to_pylist(), strict=True))
    rows.sort(key=lambda r: (len(r[0]), r[1], r[0].tobytes()))  # not in the order in which tasks end
    return rows


def fit(docs: DataFrame, labels: DataFrame, *, settings: dict | None = None, **how) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learned from ``labels`` (id, label); ``docs`` gives their texts. ``settings``: of ``train``."""
    return train(labelled_rows(docs, labels, **how), **(settings or {}))


def choose(rows: list[tuple[np.ndarray, int]], grid: list[dict], folds: int = 4) -> list[tuple[float, dict]]:
    """(mean log loss on left-out rows, settings) by cross-validation, best first."""
    part = np.array([int(x.sum(dtype=np.uint64) % np.uint64(folds)) for x, _ in rows])
    out = []
    for settings in grid:
        loss = 0.0
        for k in range(folds):
            at, w, bias = train([r for r, p in zip(rows, part, strict=True) if p != k], **settings)
            weights = np.zeros(1 << BITS)
            weights[at] = w
            for (x, y), p in zip(rows, part, strict=True):
                if p == k:
                    z = np.clip(bias + weights[x].sum(), -35, 35)
                    loss += float(np.log1p(np.exp(-z if y else z)))
        out.append((loss / max(1, len(rows)), settings))
    return sorted(out, key=lambda x: x[0])


def picked(results: list[tuple[float, dict]], slack: float = 0.02) -> dict:
    """Of the settings whose loss is within ``slack`` of the best, those with the smallest rate (and then the larger penalty)."""
    near = [s for loss, s in results if loss <= results[0][0] * (1 + slack)]
    return min(near, key=lambda s: (s["alpha"], -s["l1"]))


_ADDED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], *, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted (replacing columns of these names)."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        at, w, bias = known.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = w

        def step(text):
            data, offsets = string_parts(text)
            out = np.full(len(text), bias)
            for i, j in row_steps(offsets):
                doc, b = features(data, offsets[i : j + 1])
                on = weights[b] != 0
                both = np.unique((doc[on] << BITS) | b[on])
                np.add.at(out, i + (both >> BITS), weights[both & ((1 << BITS) - 1)])
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

        return step

    return append_columns(docs, [text_col], make, _ADDED)


def held_out(key: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
