"""Windows of characters found again in other texts: hashes of all windows, looked up in those of a bounded table of gold texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions import text as X
from folia.operators.joins import spread

#: characters of gold text up to which its window hashes (8 bytes each) are broadcast; beyond, windows are joined by a shuffle
GOLD_CHARS = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def _points(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the window from each code point, which of them lie within one text, first code point of each text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    m = max(0, len(points) - k + 1)
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = (h ^ points[j : j + m]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    inside = np.repeat(first[1:] - k, sizes)[:m] >= np.arange(m)
    return h, inside, first


def hits(docs: DataFrame, text: Column, gold: DataFrame, gold_text: Column, k: int) -> DataFrame:
    """``docs`` (doc) with every distinct window of ``k`` characters (g) of their text that a gold text has, and by the hash perhaps another one."""
    size = gold.agg(F.coalesce(F.sum(F.length(gold_text)), F.lit(0))).first()[0]
    docs = spread(docs)
    if size > GOLD_CHARS:
        return docs.select("doc", F.explode(X.char_windows(text, k)).alias("g"))
    h, inside, _ = _points([r[0] for r in gold.select(gold_text).where(gold_text.isNotNull()).collect()], k)
    known = docs.sparkSession.sparkContext.broadcast(np.unique(h[inside]))

    def run(batches):
        table = known.value
        bits = np.zeros(1 << _BITS, bool)
        bits[table >> np.uint64(64 - _BITS)] = True
        for batch in batches:
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= 1 << 20):
                    chars += len(texts[end])
                    end += 1
                h, inside, first = _points(texts[at:end], k)
                found = np.flatnonzero(bits[h >> np.uint64(64 - _BITS)] & inside)
                if len(found):
                    found = found[table[np.minimum(np.searchsorted(table, h[found]), len(table) - 1)] == h[found]]
                of = np.searchsorted(first, found, "right") - 1
                pairs = {(d, texts[at + d][p : p + k]) for d, p in zip(of.tolist(), (found - first[of]).tolist(), strict=True)}
                rows = [at + d for d, _ in pairs]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(rows, pa.int64())), pa.array([g for _, g in pairs], pa.string())], names=["doc", "g"])
                at = end

    return docs.select("doc", text.alias("t")).mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, g string")


def counts(docs: DataFrame, text: Column, chars: int = 12, words: int = 8) -> DataFrame:
    """``docs`` (doc) with the numbers of distinct ``X.char_shingles`` and ``X.word_shingles`` of their text, exactly and without a column of windows."""

    def of(t: str | None) -> tuple[int, int]:
        if not t:
            return 0, int(t is not None)
        w = t.split(" ")
        n = len({t[i : i + chars] for i in range(len(t) - chars + 1)}) if len(t) >= chars else 1
        return n, len(set(zip(*(w[j:] for j in range(words)), strict=False))) if len(w) >= words else 1

    def run(batches):
        for batch in batches:
            found = [of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))], names=["doc", "n", "n_words"])

    return spread(docs).select("doc", text.alias("t")).mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, n bigint, n_words bigint")
