"""Repeated passages by relative Lempel-Ziv parsing: every document is factored against indexed reference blocks of the whole corpus.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``window`` consecutive words of one document. A word is removed
if a window that covers it has its word sequence start earlier too: in a smaller ``doc_id``, or earlier in the same one.

1. Index. Of the 6-word grams in a window the one with the smallest hash is its anchor, so that equal windows have equal
   anchors at equal places and one window in eight or so opens a new anchor; the windows that share an anchor form its
   neighbourhood. Reference blocks are ranges of anchor hashes of a bounded size (``BLOCK_BYTES`` of text each); a block
   indexes, for each of its anchors, the places in the corpus by neighbourhood.
2. Lookup. Each neighbourhood of each document is looked up in the block of its anchor. If it as a whole stands earlier
   anywhere, it gets its earliest place there as source. If only its anchor does, its windows are at the boundary of
   factors and each is looked up by itself, in blocks of window hashes.
3. Parse. From left to right, a factor (start, length, source document, source start) takes all windows whose source
   goes on along the same diagonal; the next one begins at the first window that it doesn't hold (so factors may share
   words). A factor has ``window`` words or more; words outside of factors are literals. Words in factors are removed.

Each task passes on only its first place of a neighbourhood or window (what comes later in the task repeats for certain,
with the first one as source) and at most 16 neighbourhoods of an anchor (beyond that it looks the windows up at once), so
that a passage in a third of all documents puts a few rows per task in a block. Neighbourhoods and windows are compared by
112 bits of hashes. Rows are packed by block before they are shuffled, and texts are compressed.

Defined results: null text has no words; documents with fewer words than a window lose nothing; a null ``doc_id`` counts
as larger than all (as a source it is null); rows with equal ``doc_id`` and the same start are not earlier than each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, release, row_steps, splitmix, stored, string_parts, table
from .textvec import NON_SPACE, find_words, gram_hashes, inside, mix, word_hashes

GRAM = 6
CONTEXTS = 16
FLUSH = 1_000_000
#: of the texts that one reference block indexes
BLOCK_BYTES = 4 << 20
_LAST = (1 << 63) - 1
_Q, _IQ = 0xA24BAED4963EE407, pow(0xA24BAED4963EE407, -1, 1 << 64)
_SECOND = np.uint64(splitmix(77))
_BLOB = "bucket int, blob binary"
_FOUND = "d bigint, key bigint, p bigint, kind int, sd bigint, sp bigint"
_KEY = (1 << 29) - 1
_CHECK = np.uint64((1 << 48) - 1)
#: of a row: to be resolved in its group; repeats; windows to be looked up; only tells that its anchor has many neighbourhoods
OPEN, REPEATS, BOUNDARY, MANY = range(4)


def _place(lo: np.ndarray, span: np.ndarray, text_key: np.ndarray) -> np.ndarray:
    """28 bits of start, 6 of further windows, 29 of the text's key, so that order is by start."""
    return (lo << 35) | (span << 29) | text_key


def neighbourhoods(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, neighbourhood hash, document, first window, further windows) of some documents."""
    w = find_words(data, offsets, NON_SPACE)
    n = len(w)
    if n < window:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z
    h = word_hashes(w)
    gram = min(GRAM, window)
    g = gram_hashes(h, gram)
    width = window - gram + 1
    low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    have = 1
    while have < width:
        by = min(have, width - have)
        low = np.minimum(low[: len(low) - by], low[by:])
        have += by
    at = np.flatnonzero(inside(w.first, w.count, n, window))
    if not len(at):
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    lo, hi, a = at[begin], at[end], anchor[begin]
    one = np.uint64(1)
    pq = np.cumprod(np.concatenate([[one], np.full(n, _Q, np.uint64)]))
    iq = np.cumprod(np.concatenate([[one], np.full(n, _IQ, np.uint64)]))
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(h ^ _SECOND) * pq[:n], out=s[1:])
    c = (s[hi + window] - s[lo]) * iq[lo] + (a - lo).astype(np.uint64) * np.uint64(splitmix(5)) + (hi - lo).astype(np.uint64) * np.uint64(splitmix(6))
    doc = np.searchsorted(w.first, lo, "right") - 1
    return g[a], mix(c), doc, lo - w.first[doc], hi - lo


def _firsts(h: np.ndarray, c: np.ndarray, d: np.ndarray, p: np.ndarray, contexts: int | None) -> tuple[np.ndarray, ...]:
    """(h, c, d, p, kind, source d, source p) that a task passes on of what it has gathered."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(h)))
    alone = np.repeat(size == 1, size)
    kind = np.zeros(len(h), np.int32)
    sd, sp = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    drop = np.zeros(len(h), bool)
    many = np.zeros(0, np.uint64)
    rest = order[~alone]
    if len(rest):
        rest = rest[np.lexsort((p[rest], d[rest], c[rest], h[rest]))]
        hh, cc, dd, pp = h[rest], c[rest], d[rest], p[rest]
        newh = np.ones(len(rest), bool)
        newh[1:] = hh[1:] != hh[:-1]
        newc = newh.copy()
        newc[1:] |= cc[1:] != cc[:-1]
        lead = np.flatnonzero(newc)[np.cumsum(newc) - 1]
        later = (dd > dd[lead]) | ((dd == dd[lead]) & ((pp >> 35) > (pp[lead] >> 35)))
        kind[rest[later]], sd[rest[later]], sp[rest[later]] = REPEATS, dd[lead[later]], pp[lead[later]]
        drop[rest[~later & ~newc & (pp == pp[lead])]] = True
        if contexts:
            group = np.cumsum(newh) - 1
            count = np.bincount(group, newc)
            over = count[group] > contexts
            kind[rest[over & ~later]] = BOUNDARY
            many = hh[newh & over]
    keep = ~drop
    h, c, d, p, kind, sd, sp = h.copy()[keep], c[keep], d[keep], p[keep], kind[keep], sd[keep], sp[keep]
    told = kind > OPEN
    h[told] = mix(c[told] ^ d[told].view(np.uint64) ^ (p[told].view(np.uint64) * np.uint64(splitmix(9))))
    z = np.zeros(len(many), np.int64)
    return tuple(np.concatenate(x) for x in ((h, many), (c, z.view(np.uint64)), (d, z), (p, z), (kind, np.full(len(many), MANY, np.int32)), (sd, z), (sp, z)))


def _planes(x: np.ndarray, width: int) -> bytes:
    """Values as byte planes, so that what is alike in them compresses."""
    return x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _values(raw: memoryview, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    x = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return np.ascontiguousarray(x).view(f"<u{width}").ravel(), at + n * width


def zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unzipped(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(blob[8:], size, asbytes=True) if size else b""


def _encoded(h: np.ndarray, c: np.ndarray, d: np.ndarray, p: np.ndarray, kind: np.ndarray, sd: np.ndarray, sp: np.ndarray) -> bytes:
    """Rows of one block: sorted hashes as differences, documents by their place in a table; what repeats has its source in place of its check."""
    told = (kind == REPEATS) | (kind == BOUNDARY)
    h = np.where(told, h.min(), h)
    order = np.argsort(h, kind="stable")
    h, c, d, p, kind, sd, sp = (x[order] for x in (h, np.where(told, np.uint64(0), c & _CHECK), d, p, kind, sd, sp))
    repeats = np.flatnonzero(kind == REPEATS)
    pair = np.stack([np.concatenate([d, sd[repeats]]), np.concatenate([p, sp[repeats]]) & _KEY], axis=1)
    by = np.lexsort((pair[:, 1], pair[:, 0]))
    new = np.ones(len(by), bool)
    new[1:] = (pair[by][1:] != pair[by][:-1]).any(axis=1)
    docs = pair[by][new]
    doc = np.empty(len(by), np.int64)
    doc[by] = np.cumsum(new) - 1
    c[repeats] = (doc[len(d) :].astype(np.uint64) << np.uint64(32)) | (sp[repeats] >> 35).astype(np.uint64)
    parts = [len(h).to_bytes(8, "little"), len(docs).to_bytes(8, "little"), docs.tobytes(), _planes(np.diff(h, prepend=np.uint64(0)), 8), _planes(c, 8), _planes(doc[: len(d)], 4), _planes(p >> 35, 4), _planes((p >> 29) & 63, 1), _planes(kind, 1)]
    return zipped(b"".join(parts))


def _decoded(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = memoryview(unzipped(blob))
    n, m = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    docs = np.frombuffer(raw, np.int64, 2 * m, 16).reshape(m, 2)
    at = 16 + 16 * m
    cols = []
    for width in (8, 8, 4, 4, 1, 1):
        x, at = _values(raw, at, n, width)
        cols.append(x)
    h, c, doc, lo, span, kind = cols
    d, key = docs[doc].T
    source = docs[np.where(kind == REPEATS, c >> np.uint64(32), np.uint64(0)).astype(np.int64)]
    sp = ((c & np.uint64(0xFFFFFFFF)).astype(np.int64) << 35) | source[:, 1]
    return np.cumsum(h), c, d, (lo.astype(np.int64) << 35) | (span.astype(np.int64) << 29) | key, kind.astype(np.int32), source[:, 0], sp


class _Gather:
    """Rows of a task, passed on a million at a time, packed by bucket of their hash."""

    def __init__(self, contexts: int | None, buckets: int):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n, self.contexts, self.buckets = 0, contexts, buckets

    def add(self, *cols: np.ndarray):
        self.parts.append(cols)
        self.n += len(cols[0])
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self):
        if self.n:
            out = _firsts(*[np.concatenate(x) for x in zip(*self.parts, strict=True)], self.contexts)
            self.parts, self.n = [], 0
            bucket = ((out[0] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            groups = np.split(order, cut)
            yield pa.RecordBatch.from_arrays([pa.array([bucket[g[0]] for g in groups], pa.int32()), pa.array([_encoded(*[x[g] for x in out]) for g in groups], pa.binary())], names=["bucket", "blob"])


def _long(col: pa.Array) -> np.ndarray:
    return col.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _index(src: DataFrame, window: int, buckets: int) -> DataFrame:
    def run(batches):
        rows = _Gather(CONTEXTS, buckets)
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            d, key = _long(batch.column("d")), _long(batch.column("key"))
            for i, j in row_steps(offsets):
                h, c, doc, lo, span = neighbourhoods(data, offsets[i : j + 1], window)
                yield from rows.add(h, c, d[i + doc], _place(lo, span, key[i + doc]))
        yield from rows.flush()

    return src.select("d", "key", "text").mapInArrow(lean(run), _BLOB)


def _resolved(blobs: DataFrame) -> DataFrame:
    """(d, key, p, kind) of what repeats or has windows to be looked up; a group holds the rows of a range of hashes."""

    def run(group: pa.Table) -> pa.Table:
        h, c, d, p, kind, sd, sp = (np.concatenate(x) for x in zip(*[_decoded(b) for b in group.column("blob").to_pylist()], strict=True))
        told = (kind == REPEATS) | (kind == BOUNDARY)
        order = np.flatnonzero(~told)
        order = order[np.argsort(h[order], kind="stable")]
        alone = np.ones(len(order), bool)
        same = h[order][1:] == h[order][:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        rest = order[~alone]
        rest = rest[np.lexsort((p[rest], d[rest], c[rest], kind[rest], h[rest]))]
        kind, sd, sp = kind.copy(), sd.copy(), sp.copy()
        if len(rest):
            hh, cc, dd, pp, is_open = h[rest], c[rest], d[rest], p[rest], kind[rest] == OPEN
            newh = np.ones(len(rest), bool)
            newh[1:] = hh[1:] != hh[:-1]
            newc = newh.copy()
            newc[1:] |= (cc[1:] != cc[:-1]) | (is_open[1:] != is_open[:-1])
            lead = np.flatnonzero(newc)[np.cumsum(newc) - 1]
            later = (dd > dd[lead]) | ((dd == dd[lead]) & ((pp >> 35) > (pp[lead] >> 35)))
            group_of = np.cumsum(newh) - 1
            many = (np.bincount(group_of, newc) > 1)[group_of]
            late = is_open & later
            kind[rest[late]], sd[rest[late]], sp[rest[late]] = REPEATS, dd[lead[late]], pp[lead[late]]
            kind[rest[is_open & ~later & many]] = BOUNDARY
        out = (kind == REPEATS) | (kind == BOUNDARY)
        found = pa.table({"d": d[out], "key": p[out] & _KEY, "p": p[out], "kind": kind[out], "sd": sd[out], "sp": sp[out]})
        release()
        return found

    return blobs.groupBy("bucket").applyInArrow(run, _FOUND)


_SEEDS = "array<struct<f:bigint,s:bigint,t:bigint>>"


def _by_doc(found: DataFrame) -> DataFrame:
    """(d, key, f): of each document the windows found, as structs of place and kind, source document, source place."""
    packed = F.col("p").bitwiseAND(~_KEY).bitwiseOR(F.col("kind").cast("bigint"))
    return found.select("d", "key", F.struct(packed.alias("f"), F.col("sd").alias("s"), F.col("sp").alias("t")).alias("f")).groupBy("d", "key").agg(F.collect_list("f").alias("f"))


def _flat(col: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(offsets of n + 1, [f, s, t]) of a column of seeds; nulls are empty."""
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64), [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat.flatten()]


def parse(f: np.ndarray, s: np.ndarray, t: np.ndarray, window: int) -> np.ndarray:
    """(k, 5) factors of a document from what repeats in it: first word, words, source document, its text's key, first word there."""
    order = np.lexsort((t, s, f))
    f, s, t = f[order], s[order], t[order]
    lo = f >> 35
    once = np.ones(len(lo), bool)
    once[1:] = lo[1:] != lo[:-1]  # of repeated rows
    lo, s, t, end = lo[once], s[once], t[once], (lo + ((f >> 29) & 63) + 1)[once]
    at, key = t >> 35, t & _KEY
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != end[:-1]) | (s[1:] != s[:-1]) | (key[1:] != key[:-1]) | (at[1:] - lo[1:] != at[:-1] - lo[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return np.stack([lo[first], end[last] - lo[first] + window - 1, s[first], key[first], at[first]], axis=1)


def covered(n: int, factors: np.ndarray) -> np.ndarray:
    """Word flags from factors."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, factors[:, 0], 1)
    np.add.at(mark, factors[:, 0] + factors[:, 1], -1)
    return np.cumsum(mark)[:-1] > 0


_FACTOR = "start:bigint,length:bigint,source:bigint,source_start:bigint"
_DOC = f"doc_id bigint, d bigint, key bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start:bigint,length:bigint>>, factors array<struct<{_FACTOR}>>, body binary, packed {_SEEDS}"


def _lists(rows: list[np.ndarray], names: list[str], null: int | None = None) -> pa.Array:
    """A column of lists of structs from a (k, fields) array each; ``null``: a value that stands for null."""
    flat = np.concatenate([*rows, np.zeros((0, len(names)), np.int64)])
    cols = [pa.array(flat[:, k], pa.int64(), mask=None if null is None else flat[:, k] == null) for k in range(len(names))]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.StructArray.from_arrays(cols, names))


def _texts(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = [unzipped(x) for x in bodies.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts])


def _small(batch: pa.RecordBatch):
    """Parts of a batch whose texts are a few steps long."""
    size = batch.column("body").fill_null(b"").cast(pa.large_binary())
    size = np.diff(np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1])
    for i, j in row_steps(np.concatenate([[0], np.cumsum(size)])):
        yield batch.slice(i, j - i)


def _compressed(src: DataFrame) -> DataFrame:
    """The texts as compressed bodies: they are shuffled once or twice."""

    def run(batches):
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            body = [zipped(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(body, pa.binary())], names=["doc_id", "d", "key", "body"])

    return src.select("doc_id", "d", "key", "text").mapInArrow(lean(run), "doc_id bigint, d bigint, key bigint, body binary")


def _open_windows(f: np.ndarray) -> np.ndarray:
    f = f[f & 3 == BOUNDARY]
    return np.unique(np.concatenate([np.arange(x, x + y + 1) for x, y in zip((f >> 35).tolist(), ((f >> 29) & 63).tolist(), strict=True)])) if len(f) else f


def _applied(docs: DataFrame, window: int, last: bool) -> DataFrame:
    """Documents (doc_id, d, key, body, f: seeds) parsed, as rows of ``_DOC``; unless it is the ``last`` time, those with windows to be looked up are passed on as they are."""

    def run(batches):
        for batch in (x for b in batches for x in _small(b)):
            data, offsets = _texts(batch.column("body"))
            cut, (f, s, t) = _flat(batch.column("f"))
            kind = f & 3
            n_open = np.concatenate([[0], np.cumsum(kind == BOUNDARY)])
            wait = np.zeros(len(batch), bool) if last else n_open[cut[1:]] > n_open[cut[:-1]]
            w = find_words(data, offsets, NON_SPACE)
            removed, shas, spans, parts = [], [], [], []
            none, no_factor = np.zeros((0, 2), np.int64), np.zeros((0, 4), np.int64)
            for k, (a, n) in enumerate(zip(w.first.tolist(), w.count.tolist(), strict=False)):
                on = np.flatnonzero(kind[cut[k] : cut[k + 1]] == REPEATS) + cut[k] if cut[k + 1] > cut[k] and not wait[k] else none
                if len(on):
                    found = parse(f[on], s[on], t[on], window)
                    gone = covered(n, found)
                    keep = np.flatnonzero(~gone) + a
                    text = b" ".join([data[x:y].tobytes() for x, y in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                    row = (int(gone.sum()), hashlib.sha256(text).hexdigest(), np.stack([edge[:, 0], edge[:, 1] - edge[:, 0]], axis=1), found[:, [0, 1, 2, 4]])
                elif wait[k]:
                    row = (None, None, none, no_factor)
                else:
                    text = b" ".join(data[offsets[k] : offsets[k + 1]].tobytes().split())  # bytes.split: the same six separators
                    row = (0, hashlib.sha256(text).hexdigest(), none, no_factor)
                for col, x in zip((removed, shas, spans, parts), row, strict=True):
                    col.append(x)
            rest = np.repeat(wait, np.diff(cut))
            left = _lists([np.stack([f[rest], s[rest], t[rest]], axis=1)], ["f", "s", "t"]).values
            packed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(wait, np.diff(cut), 0))]), pa.int32()), left)
            body = batch.column("body").filter(pa.array(wait)).to_pylist()
            bodies = iter(body)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(w.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), _lists(spans, ["start", "length"]), _lists(parts, ["start", "length", "source", "source_start"], _LAST), pa.array([next(bodies) if x else None for x in wait.tolist()], pa.binary()), packed],
                names=["doc_id", "d", "key", "n_words", "n_removed", "kept_sha256", "spans", "factors", "body", "packed"],
            )

    return docs.select("doc_id", "d", "key", "body", "f").mapInArrow(lean(run), _DOC)


def _windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """The single windows to be looked up, packed by bucket."""

    def run(batches):
        rows = _Gather(None, buckets)
        for batch in (x for b in batches for x in _small(b)):
            data, offsets = _texts(batch.column("body"))
            w = find_words(data, offsets, NON_SPACE)
            h = word_hashes(w)
            cut, (f, _, _) = _flat(batch.column("packed"))
            s = [_open_windows(f[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            n = np.array([len(x) for x in s])
            s = np.concatenate(s)
            at = s + np.repeat(w.first[:-1], n)
            d, key = (np.repeat(_long(batch.column(c)), n) for c in ("d", "key"))
            yield from rows.add(gram_hashes(h, window)[at], gram_hashes(mix(h ^ _SECOND), window, 1)[at], d, _place(s, np.zeros_like(s), key))
        yield from rows.flush()

    return docs.select("d", "key", "body", "packed").mapInArrow(lean(run), _BLOB)


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans: removed word runs, factors) per row of ``docs``. ``window``: 1 to 60 words."""
    if not 1 <= window <= 60:
        raise ValueError("window must be 1 to 60 words")
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.xxhash64("text").bitwiseAND(_KEY).alias("key"), "text")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))  # several a task even out
    marks = _by_doc(_resolved(_index(src, window, buckets)))
    whole = stored(_applied(_compressed(src).join(marks, ["d", "key"], "left"), window, False), "factored")
    left = whole.where("body is not null")
    looked = _resolved(_windows(left, window, buckets)).where(F.col("kind") == REPEATS)
    late = left.select("doc_id", "d", "key", "body", "packed").join(_by_doc(looked), ["d", "key"], "left")
    late = late.select("doc_id", "d", "key", "body", F.concat("packed", F.coalesce("f", F.array().cast(_SEEDS))).alias("f"))
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "factors"]
    return whole.where("body is null").select(*cols).unionByName(_applied(late, window, True).select(*cols))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT rid, doc_id, i, hash(array_to_string(w[i : i + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS t(i) WHERE len(w) >= 20
), f AS (SELECT *, min(struct_pack(a := doc_id, b := i)) OVER (PARTITION BY h) AS o FROM g
), x AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS p FROM f WHERE struct_pack(a := doc_id, b := i) > o
), r AS (SELECT rid, list(p) AS ps FROM x GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda y, k: NOT list_contains(ps, k)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid)
"""
