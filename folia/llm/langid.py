"""Language of words and texts in code-switched corpora: a linear-chain conditional random field.

Words are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A word's features are its first and last one to
three bytes (affixes), its three-byte grams and the word itself (the learned lexicon), hashed into one weight table;
transitions and start weights are learned along. Sequences to learn from are drawn from at most ``per_lang`` labelled
texts of each language (those with the smallest hash of their id), of each of which ``segments`` runs of 20 words, evenly
spaced from its first word to its last, are taken: some of one text, some switching between texts of several languages, so
that the transitions see switches. Only this bounded training table is a sample; labelling covers every whole text.

Every word of a text is labelled by forward-backward over the whole text (exact: block products of the chain, then the
messages in the blocks). A text gets the label with the largest sum of word posteriors; its score is that sum's share.

Defined results: ``und`` with score 0 for null, empty or letterless texts and where nothing could be learned; ties go to
the label that sorts first; a null id is not held out and not learned from; a null label is not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, lean, row_steps, string_parts, table
from .textvec import LOWER, Words, find_words, mix, word_hashes
from .toxicity import held_out

ALPHA = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_ASCII_LETTER = np.array([b < 0x80 and chr(b).isalpha() for b in range(256)])
BITS = 17
BLOCK = 128
PER_LANG = 200
#: of a text; a training sequence has up to four segments and so fits a block
SEGMENTS, SEGMENT_WORDS = 6, 20


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, 7) buckets of affixes and the word; flat buckets of three-byte grams and their number per word."""
    lo, hi = (int(w.start[0]), int(w.end[-1])) if len(w) else (0, 0)
    b = LOWER[w.data[lo:hi]].astype(np.uint32)
    begin, end = w.start - lo, w.end - lo
    size = end - begin
    ids = np.empty((len(w), 7), np.int64)
    ids[:, 0] = mix(word_hashes(w, lower=True) + np.uint64(7)) >> np.uint64(64 - BITS)
    head, tail = np.zeros(len(w), np.uint32), np.zeros(len(w), np.uint32)
    for k in range(3):
        long = size > k
        head = (head << np.uint32(8)) | np.where(long, b[np.minimum(begin + k, end - 1)], np.uint32(0))
        tail = tail | (np.where(long, b[np.maximum(end - 1 - k, begin)], np.uint32(0)) << np.uint32(8 * k))
        for side, x in enumerate((head, tail)):
            ids[:, 1 + 2 * k + side] = ((x + np.uint32((2 * k + side + 1) << 24)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int64)
    if len(b) >= 3:
        tri = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        tri = (tri * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    else:
        tri = np.zeros(0, np.uint32)
    n = np.maximum(size - 2, 0)
    on = np.zeros(len(b) + 1, np.int8)
    on[begin[n > 0]] = 1
    on[end[n > 0] - 2] -= 1
    return ids, tri[np.cumsum(on, dtype=np.int8)[: len(tri)] > 0], n


def emissions(weights: np.ndarray, feats: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, labels) scores."""
    ids, tri, n = feats
    out = weights[ids[:, 0]].astype(np.float64)
    for k in range(1, ids.shape[1]):
        out += weights[ids[:, k]]
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        out[some] += np.add.reduceat(np.take(weights, tri, axis=0), at, axis=0)
    return out


def posteriors(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """(n, labels) word posteriors by forward-backward. ``first``: n_docs + 1 word offsets; ``trans``, ``start``: log weights.

    ``pairs``: gets the expected transitions within blocks added.
    """
    n, k = e.shape
    if not n:
        return e
    size = np.diff(first)
    docs = np.flatnonzero(size)
    blocks = -(-size[docs] // BLOCK)
    base = np.concatenate([[0], np.cumsum(blocks)])
    m = int(base[-1])
    doc_of = np.repeat(np.arange(len(docs)), blocks)
    order = np.arange(m) - base[doc_of]
    at = first[docs][doc_of] + order * BLOCK
    length = np.minimum(BLOCK, first[docs + 1][doc_of] - at)
    a = np.exp(trans - trans.max())
    p = np.exp(e - e.max(axis=1, keepdims=True))
    grid = np.ones((BLOCK, m, k))
    pos = np.arange(n) - np.repeat(at, length)
    blk = np.repeat(np.arange(m), length)
    grid[pos, blk] = p
    steps = int(length.max())
    live = np.arange(BLOCK)[:, None] < length[None, :]
    # products of a block's factors
    q = np.empty((m, k, k))
    q[:] = a[None] * grid[0][:, None, :]
    head = order == 0
    q[head] = np.eye(k)[None] * grid[0][head][:, None, :]
    many = np.flatnonzero(blocks[doc_of] > 1)
    if len(many):
        qm, gm, lm = q[many], grid[:, many], live[:, many]
        for t in range(1, steps):
            new = (qm.reshape(-1, k) @ a).reshape(-1, k, k) * gm[t][:, None, :]
            new /= new.sum(axis=(1, 2), keepdims=True)
            qm = np.where(lm[t][:, None, None], new, qm)
        q[many] = qm
    # messages between blocks
    inbound, outbound = np.empty((m, k)), np.ones((m, k))
    inbound[base[:-1]] = np.exp(start - start.max())
    for b in range(1, int(blocks.max())):
        x = base[:-1][blocks > b] + b
        v = np.einsum("ij,ijk->ik", inbound[x - 1], q[x - 1])
        inbound[x] = v / v.sum(axis=1, keepdims=True)
    for b in range(int(blocks.max()) - 2, -1, -1):
        x = base[:-1][blocks > b + 1] + b
        v = np.einsum("ijk,ik->ij", q[x + 1], outbound[x + 1])
        outbound[x] = v / v.sum(axis=1, keepdims=True)
    # messages in blocks
    alpha = np.empty((steps, m, k))
    v = np.where(head[:, None], inbound, inbound @ a) * grid[0]
    alpha[0] = v / v.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        v = (alpha[t - 1] @ a) * grid[t]
        alpha[t] = v / v.sum(axis=1, keepdims=True)
    v = outbound
    for t in range(steps - 1, -1, -1):
        if pairs is not None and t:
            both = alpha[t - 1][:, :, None] * a[None] * (grid[t] * v)[:, None, :]
            both /= both.sum(axis=(1, 2), keepdims=True)
            pairs += both[live[t]].sum(axis=0)
        alpha[t] *= v
        back = (grid[t] * v) @ a.T
        v = np.where(live[t][:, None], back / back.sum(axis=1, keepdims=True), v)
    post = alpha[pos, blk]
    return post / post.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, str]], *, sequences: int = 1600, rounds: int = 30, seed: int = 7) -> dict:
    """Weights from (label, piece of text) samples."""
    labels = sorted({x for x, _ in samples})
    k = len(labels)
    by = {x: sorted(t for y, t in samples if y == x) for x in labels}
    rng = np.random.default_rng(seed)
    texts, tags, cut = [], [], [0]
    for _ in range(sequences if k else 0):
        for _ in range(int(rng.integers(1, 5))):
            x = int(rng.integers(k))
            texts.append(by[labels[x]][int(rng.integers(len(by[labels[x]])))])
            tags.append(x)
        cut.append(len(texts))
    data, offsets = string_parts(pa.array(texts, pa.large_string()))
    w = find_words(data, offsets, ALPHA)
    y = np.repeat(tags, w.count).astype(np.int64) if texts else np.zeros(0, np.int64)
    first = w.first[cut]
    weights, trans, start = np.zeros((1 << BITS, max(1, k))), np.zeros((k, k)), np.zeros(k)
    if len(w) and k > 1:
        ids, tri, n = feats = features(w)
        used, flat = np.unique(np.concatenate([ids.ravel(), tri]), return_inverse=True)
        who = np.concatenate([np.repeat(np.arange(len(w)), ids.shape[1]), np.repeat(np.arange(len(w)), n)])
        begin = first[:-1][np.diff(first) > 0]
        inner = np.ones(len(w), bool)
        inner[begin] = False
        real = np.zeros((k, k))
        np.add.at(real, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
        wu, gu = np.zeros((len(used), k)), np.full((len(used), k), 1e-8)
        gt, gs = np.full((k, k), 1e-8), np.full(k, 1e-8)
        for _ in range(rounds):
            weights[used] = wu
            e = emissions(weights, feats)
            expected = np.zeros((k, k))
            post = posteriors(e, first, trans, start, expected)
            miss = post.copy()
            miss[np.arange(len(y)), y] -= 1
            g = np.stack([np.bincount(flat, miss[who, c], len(used)) for c in range(k)], axis=1) + 0.5 * wu
            dt, ds = expected - real + 0.5 * trans, miss[begin].sum(axis=0) + 0.5 * start
            for value, grad, seen, rate in ((wu, g, gu, 0.3), (trans, dt, gt, 0.3), (start, ds, gs, 0.1)):
                seen += grad * grad
                value -= rate * grad / np.sqrt(seen)
        weights[used] = wu
    return {"labels": labels, "weights": weights.astype(np.float32), "trans": trans, "start": start}


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, segments: int = SEGMENTS, **how) -> dict:
    """Learn from the rows of ``docs`` that have a label; at most ``per_lang`` texts of each and ``segments`` runs of words of a text are looked at."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where("id is not null and lang is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.col("id").cast("string")), "id"))
    some = rows.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("id", "lang")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(some), ["id", "lang"])

    def run(batches):
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            lang, out, tags = batch.column("lang").to_pylist(), [], []
            for i, j in row_steps(offsets):
                w = find_words(data, offsets[i : j + 1], ALPHA)
                for d in range(j - i):
                    a, c = int(w.first[d]), int(w.count[d])
                    for s in sorted({x * max(0, c - SEGMENT_WORDS) // max(1, segments - 1) for x in range(segments)} if c else ()):
                        out.append(w.bytes(a + s, a + min(c, s + SEGMENT_WORDS)).decode())
                        tags.append(lang[i + d])
            yield pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), pa.array(out, pa.string())], names=["lang", "text"])

    got = texts.select("lang", "text").mapInArrow(lean(run), "lang string, text string").toArrow()
    return train(list(zip(got.column("lang").to_pylist(), got.column("text").to_pylist(), strict=True)), **how)


def has_letter(data: np.ndarray, a: int, b: int) -> bool:
    part = data[a:b]
    return bool(_ASCII_LETTER[part].any()) or (bool((part >= 0x80).any()) and any(c.isalpha() for c in part.tobytes().decode()))


_ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
_RUNS = T.StructField("runs", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())])))


def identify(docs: DataFrame, model: dict, *, text_col: str = "text", runs: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score, and if asked the runs of words by their own labels (replacing columns of these names)."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = known.value
        names, k = m["labels"], len(m["labels"])

        def step(text):
            data, offsets = string_parts(text)
            preds, scores, found = [], [], []
            for i, j in row_steps(offsets):
                w = find_words(data, offsets[i : j + 1], ALPHA)
                post = posteriors(emissions(m["weights"], features(w)), w.first, m["trans"], m["start"]) if len(w) and k else np.zeros((len(w), max(1, k)))
                s = np.zeros((len(w) + 1, post.shape[1]))
                np.cumsum(post, axis=0, out=s[1:])
                total = s[w.first[1:]] - s[w.first[:-1]]
                best = total.argmax(axis=1)
                for d in range(j - i):
                    ok = k and w.count[d] and has_letter(data, offsets[i + d], offsets[i + d + 1])
                    preds.append(names[best[d]] if ok else "und")
                    scores.append(min(1.0, float(total[d, best[d]] / w.count[d])) if ok else 0.0)
                    if runs:
                        tag = post[w.first[d] : w.first[d + 1]].argmax(axis=1) if ok else np.zeros(0, int)
                        cut = np.concatenate([[0], np.flatnonzero(np.diff(tag)) + 1, [len(tag)]]) if len(tag) else np.zeros(1, int)
                        found.append([{"lang": names[tag[x]], "words": int(y - x)} for x, y in zip(cut[:-1], cut[1:], strict=True)])
            return [pa.array(preds, pa.string()), pa.array(scores, pa.float64())] + ([pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())])))] if runs else [])

        return step

    return append_columns(docs, [text_col], make, T.StructType(_ADDED + [_RUNS] * runs))


def learned(docs: DataFrame) -> dict:
    """The model of the queries: from all rows of ``documents`` that are not held out."""
    return fit(docs.where(~held_out("doc_id", 4, 2)))


def op1_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), learned(docs)).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
