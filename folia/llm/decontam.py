"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams against every token window.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window is ``n`` consecutive words
of a benchmark item (an item of fewer words, but not none, is one window). Every window of every document is looked
up by its 64-bit hash, first in a bit table, then in the sorted hashes, and a hit is verified on the words themselves.

The benchmark comes to the driver one block at a time, of at most about ``block_bytes`` of text (measured before); each
block is one pass over the documents, and between passes the state is written to the shared folder. What is broadcast of a
block are its words, the sorted hashes of its windows and their places: some six bytes for one of text, at most 25 MB.

Defined results: a null or wordless document has no hits; benchmark rows without an id or without words are ignored;
repeated item rows count once per item id; repeated document rows are each judged alone; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, riding, row_steps, stored, string_parts, table, unpacked
from .textvec import ALNUM, LOWER, Words, find_words, gram_hashes, inside, word_hashes

BLOCK_BYTES = 4 << 20
_BITS = 22
_STATE = T.StructType([T.StructField("_hits", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType()))])


def _same(a: Words, at: np.ndarray, b: Words, bt: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words of ``a`` from each of ``at`` are those of ``b`` from ``bt``, A-Z lower-cased."""
    out = np.ones(len(at), bool)
    for k in range(m):
        on = np.flatnonzero(out)
        x, y = a.start[at[on] + k], b.start[bt[on] + k]
        size = a.end[at[on] + k] - x
        out[on] = size == b.end[bt[on] + k] - y
        keep = out[on]
        on, x, y, size = on[keep], x[keep], y[keep], size[keep]
        if len(on):
            stop = np.cumsum(size)
            step = np.arange(stop[-1]) - np.repeat(stop - size, size)
            out[on] = np.logical_and.reduceat(LOWER[a.data[np.repeat(x, size) + step]] == LOWER[b.data[np.repeat(y, size) + step]], stop - size)
    return out


class Windows:
    """Hash set of the windows of some benchmark items."""

    def __init__(self, rows: list[tuple[str, str]], n: int):
        self.ids = [i for i, _ in rows]
        data, offsets = string_parts(pa.array([t for _, t in rows], pa.large_string()))
        self.words = w = find_words(data, offsets, ALNUM)
        h = word_hashes(w, lower=True)
        size = np.minimum(w.count, n)
        self.sets: dict[int, tuple] = {}
        for m in np.unique(size[size > 0]).tolist():
            item = np.flatnonzero(size == m)
            many = w.count[item] - m + 1
            at = np.repeat(w.first[item] - np.cumsum(many) + many, many) + np.arange(many.sum())
            for salt in range(64):
                g = gram_hashes(h, m, salt)[at]
                order = np.argsort(g, kind="stable")
                known, first, count = np.unique(g[order], return_index=True, return_counts=True)
                lead = np.repeat(at[order][first], count)
                if _same(w, at[order], w, lead, m).all():  # else two windows share a hash
                    break
            bits = np.zeros(1 << _BITS, bool)
            bits[known >> np.uint64(64 - _BITS)] = True
            self.sets[m] = (salt, bits, known, np.append(first, len(order)), at[order][first], np.repeat(item, many)[order].astype(np.int32))

    def find(self, w: Words) -> tuple[np.ndarray, list[set[str]]]:
        """(hit flag per word, item ids per document)."""
        mark = np.zeros(len(w) + 1, np.int32)
        items: list[set[str]] = [set() for _ in w.count]
        if not len(w) or not self.sets:
            return mark[:-1] > 0, items
        h = word_hashes(w, lower=True)
        for m, (salt, bits, known, first, lead, item) in self.sets.items():
            g = gram_hashes(h, m, salt)
            at = np.flatnonzero(bits[g >> np.uint64(64 - _BITS)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(known, g[at]), len(known) - 1)
            ok = (known[place] == g[at]) & inside(w.first, w.count, len(w), m)[at]
            at, place = at[ok], place[ok]
            ok = _same(w, at, self.words, lead[place], m)
            at, place = at[ok], place[ok]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + m, -1)
            docs = np.searchsorted(w.first, at, "right") - 1
            for d, k in np.unique(np.stack([docs, place], axis=1), axis=0).tolist():
                items[d].update(self.ids[x] for x in set(item[first[k] : first[k + 1]].tolist()))
        return np.cumsum(mark)[:-1] > 0, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, list[tuple[str, str]]]]:
    """(whether it is the only one, rows) of each block, collected when it is asked for."""
    b = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    total = b.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    k = max(1, -(-total * 5 // (4 * block_bytes)))  # a quarter of room for uneven blocks
    for j in range(k):
        yield k == 1, [tuple(r) for r in (b if k == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(k)) == j)).collect()]


_COUNTS = ("n_words", "n_hit", "n_items", "items_sha256")


def _overlap(docs: DataFrame, benchmark: DataFrame, text_col: str, item_id: str, item_text: str, n: int, block_bytes: int, keep_cleaned: bool) -> DataFrame:
    """(r, text, counts, and if asked ``cleaned``: the text of those with hits), see ``riding``."""
    spark = docs.sparkSession
    df = None
    for only, rows in _blocks(benchmark, item_id, item_text, block_bytes):
        known = spark.sparkContext.broadcast(Windows(rows, n))
        first = df is None
        df = riding(docs, text_col) if first else df

        def make(known=known, first=first):
            def step(text, *state):
                data, offsets = string_parts(text)
                hits, ids = [], []
                for i, j in row_steps(offsets):
                    w = find_words(data, offsets[i : j + 1], ALNUM)
                    flag, items = known.value.find(w)
                    hits += [np.packbits(flag[a:b]).tobytes() if items[k] else None for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True))]
                    ids += [sorted(x) for x in items]
                if not first:
                    hits = [_either(a, b) for a, b in zip(hits, state[0].to_pylist(), strict=True)]
                    ids = [sorted({*a, *(b or ())}) for a, b in zip(ids, state[1].to_pylist(), strict=True)]
                return [pa.array(hits, pa.binary()), pa.array(ids, pa.list_(pa.string()))]

            return step

        df = append_columns(df, ["text"] if first else ["text", "_hits", "_items"], make, _STATE)
        if not only:
            df = stored(df, "overlap")
    added = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS[:3]] + [T.StructField(_COUNTS[3], T.StringType())] + [T.StructField("cleaned", T.StringType())] * keep_cleaned)

    def finish():
        def step(text, hits, items):
            data, offsets = string_parts(text)
            hits, items = hits.to_pylist(), items.to_pylist()
            words, hit, cleaned = [], [], []
            for i, j in row_steps(offsets):
                w = find_words(data, offsets[i : j + 1], ALNUM)
                words += w.count.tolist()
                for k in range(i, j):
                    packed = hits[k]
                    flag = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(w.count[k - i])).astype(bool) if packed else None
                    hit.append(int(flag.sum()) if packed else 0)
                    if keep_cleaned:
                        cleaned.append(_without(data[offsets[k] : offsets[k + 1]].tobytes(), flag, w, k - i, int(offsets[k])) if packed else None)
            shas = [hashlib.sha256(",".join(x or ()).encode()).hexdigest() for x in items]
            out = [pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x or ()) for x in items], pa.int64()), pa.array(shas)]
            return out + ([pa.array(cleaned, pa.string())] if keep_cleaned else [])

        return step

    return append_columns(df, ["text", "_hits", "_items"], finish, added, drop=("_hits", "_items"))


def overlap(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined item ids), replacing columns of these names."""
    seen = _overlap(docs, benchmark, text_col, item_id, item_text, n, block_bytes, False)
    return seen.select(*unpacked(docs, text_col, F.col("text"), _COUNTS), *_COUNTS)


def _either(a: bytes | None, b: bytes | None) -> bytes | None:
    if a is None or b is None:
        return a or b
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def _without(whole: bytes, flag: np.ndarray, w: Words, k: int, base: int) -> str:
    """The document without the bytes of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    first, parts, last = int(w.first[k]), [], 0
    for a, b in edge.reshape(-1, 2).tolist():
        parts.append(whole[last : int(w.start[first + a]) - base])
        last = int(w.end[first + b - 1]) - base
    return b"".join([*parts, whole[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 8, min_items: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Drop documents with windows of ``min_items`` items or more; cut the hit runs out of the others. Columns of ``docs``, in order, all but the text as they are."""
    seen = _overlap(docs, benchmark, text_col, item_id, item_text, n, block_bytes, True).where(F.col("n_items") < min_items)
    return seen.select(*unpacked(docs, text_col, F.when(F.col("n_items") > 0, F.col("cleaned")).otherwise(F.col("text"))))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = overlap(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= 2).alias("contaminated"))


_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP6_SQL = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, {_AZ}), {_WORD}) AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), wins AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS m, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g
  FROM items, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT m FROM wins
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM documents
), grams AS (
  SELECT rid, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM d, lens, unnest(range(1, len(w) - m + 2)) AS t(i) WHERE len(w) >= m
), found AS (
  SELECT rid, i, wins.m, item_id FROM grams JOIN wins ON grams.m = wins.m AND grams.g = wins.g
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + m)) AS t(p) GROUP BY rid
), its AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY rid
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
