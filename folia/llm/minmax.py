"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct ``words``-word shingles (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; with fewer
words the whole sequence is one shingle). Under each of 64 hash functions both the smallest and the largest value are
kept: 128 signature values from 64 evaluations. They form 32 bands of four (16 of minima, 16 of maxima); sets of
similarity 0.75 share no band with probability (1 - 0.75 ** 4) ** 32 = 5e-6.

1. One row per distinct set (a "node"): exact copies collapse before anything is compared.
2. In each band bucket every node is tied to the smallest one. Connected components of these ties ("candidates") hold
   every pair that shares a bucket; only they are looked at again.
3. Candidate components are verified on full sets in bounded groups (``group_shingles``: shingles and signature values of
   their members): small ones share a group, pairs that already hang together are skipped. A larger one is dealt out in
   bounded blocks: within blocks, then between one member of each part found, then every member outside the largest part
   against all blocks, so that no link is lost.

Defined results: null or wordless text has no shingles and is linked with nothing; rows with the same ``doc_id`` but
other texts are judged apart; a null ``doc_id`` gets the smallest id of its group, or null if none has one, and is kept
only then.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, release, row_steps, splitmix, stored, string_parts, table
from .components import components
from .textvec import NON_SPACE, find_words, gram_hashes, mix, word_hashes

PERMUTATIONS = 64
ROWS = 4
GROUP_SHINGLES = 2_000_000
_A = np.array([splitmix(1000 + i) | 1 for i in range(PERMUTATIONS)], np.uint64)
_S = np.array([splitmix(2000 + i) for i in range(PERMUTATIONS)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    w = find_words(data, offsets, NON_SPACE)
    h = word_hashes(w, lower=True)
    g = gram_hashes(h, words)
    out = []
    for a, c in zip(w.first.tolist(), w.count.tolist(), strict=False):
        if c >= words:
            out.append(np.unique(g[a : a + c - words + 1]))
        else:
            out.append(gram_hashes(h[a : a + c], c) if c else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(n, 128): the minima and maxima of non-empty sets under each function."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    v = np.empty_like(flat)
    for j in range(PERMUTATIONS):
        np.bitwise_xor(flat, _S[j], out=v)
        v *= _A[j]
        out[:, j] = np.minimum.reduceat(v, at)
        out[:, PERMUTATIONS + j] = np.maximum.reduceat(v, at)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """(n, 32) bucket hashes."""
    parts = sig.reshape(len(sig), -1, ROWS)
    h = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _ODD, parts.shape[:2]).copy()
    for k in range(ROWS):
        h = mix((h ^ parts[:, :, k]) * _ODD)
    return h


def node_key(s: np.ndarray) -> bytes:
    return b"".join(int(x).to_bytes(8, "big") for x in (mix(s ^ _ODD).sum(dtype=np.uint64), mix(s + _ODD).sum(dtype=np.uint64) + np.uint64(len(s))))


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n_shingles, node, bands): bands only for the first row of a node in a task."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            sizes, nodes, keys = [], [], []
            for i, j in row_steps(offsets):
                sets = shingle_sets(data, offsets[i : j + 1], words)
                names = [node_key(s) if len(s) else None for s in sets]
                fresh = []
                for k, name in enumerate(names):
                    if name is not None and name not in seen:
                        seen.add(name)
                        fresh.append(k)
                here = [None] * len(sets)
                if fresh:
                    for k, row in zip(fresh, bands(signatures([sets[k] for k in fresh])).view(np.int64), strict=True):
                        here[k] = row
                sizes += [len(s) for s in sets]
                nodes += names
                keys += here
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "key", "n_shingles", "node", "bands"])

    return docs.select("doc_id", "key", "text").mapInArrow(lean(run), "doc_id bigint, key bigint, n_shingles bigint, node binary, bands array<bigint>")


#: groups of up to this many members are compared pair by pair, without bands
SMALL = 48
_STEP = 1 << 21


class Parts:
    """Members of a group and the parts they hang together in; sets are kept as runs of one array of small codes."""

    def __init__(self, sets: list[np.ndarray], labels: list, asks: np.ndarray, similarity: int):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.asks, self.similarity = asks, similarity
        known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes, self.mark = codes.astype(np.int32), np.zeros(len(known), bool)
        first: dict = {}
        self.part = np.array([first.setdefault(x, i) for i, x in enumerate(labels)])

    def test(self, x: int, others: np.ndarray) -> None:
        """Join x with those of ``others`` (of other parts) that are similar enough on full sets."""
        size = self.sizes[x]
        if not self.asks[x]:
            others = others[self.asks[others]]
        others = others[np.minimum(self.sizes[others], size) * 100 >= self.similarity * np.maximum(self.sizes[others], size)]
        own = self.codes[self.at[x] : self.at[x + 1]]
        self.mark[own] = True
        while len(others):
            n = self.sizes[others]
            end = np.cumsum(n)
            k = max(1, int(np.searchsorted(end, _STEP)))
            some, n, end = others[:k], n[:k], end[:k]
            flat = np.arange(end[-1]) + np.repeat(self.at[some] - end + n, n)
            common = np.add.reduceat(self.mark[self.codes[flat]], end - n, dtype=np.int64)
            for y in some[100 * common >= self.similarity * (size + n - common)].tolist():
                a, b = self.part[x], self.part[y]
                if a != b:
                    self.part[self.part == max(a, b)] = min(a, b)
            others = others[k:]
            others = others[self.part[others] != self.part[x]]
        self.mark[own] = False


def link(sets: list[np.ndarray], labels: list, asks: np.ndarray, similarity: int) -> np.ndarray:
    """The part of each member: members that share a bucket and whose similarity is ``similarity`` percent or more hang together, and those of one label.

    ``asks``: a pair is looked at if one of its members asks. Pairs that hang together already are skipped; those whose
    128 signature values agree in fewer than half are 6 deviations below the threshold and are skipped too. Only members
    outside the largest part of a bucket are compared with its others, a few hundred at a time, so that memory stays in
    proportion to the group; no pair is remembered.
    """
    n = len(sets)
    p = Parts(sets, labels, asks, similarity)
    if n <= SMALL:
        for x in range(n - 1):
            rest = np.arange(x + 1, n)
            p.test(x, rest[p.part[rest] != p.part[x]])
        return p.part
    whole = signatures(sets)
    keys = bands(whole)
    sig = (whole >> np.uint64(16)).astype(np.uint16)
    del whole
    buckets, known = [], np.zeros(n, np.int64)
    for j, col in enumerate(keys.T):
        order = np.argsort(col, kind="stable")
        cut = np.flatnonzero(np.diff(col[order])) + 1
        for b in np.split(order, cut):
            if len(b) > 1:
                buckets.append((j, b))
                known[b] += len(b)
    floor = 0.5 * (similarity / 75) * sig.shape[1]
    for _, b in buckets:  # what most texts are copies of links most of them at once
        x = int(b[known[b].argmax()])
        rest = b[p.part[b] != p.part[x]]
        if len(rest):
            p.test(x, rest[(sig[rest] == sig[x]).sum(axis=1) >= floor])
    for j, b in buckets:
        ids, which, count = np.unique(p.part[b], return_inverse=True, return_counts=True)
        if len(ids) == 1:
            continue
        in_top = which == count.argmax()
        xs, ys = b[~in_top], np.concatenate([b[~in_top], b[in_top]])
        step = max(1, _STEP // len(ys))
        for i in range(0, len(xs), step):
            some = xs[i : i + step]
            rest = ys[i:]
            agree = np.zeros((len(some), len(rest)), np.uint8)
            for c in range(sig.shape[1]):
                agree += sig[some, c][:, None] == sig[rest, c][None]
            near = agree >= floor
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                x = some[k]
                y = rest[k + 1 :][near[k, k + 1 :]]
                y = y[p.part[y] != p.part[x]]
                if len(y):
                    y = y[~(keys[y, :j] == keys[x, :j]).any(axis=1)]  # those that share an earlier bucket were tested there
                    p.test(int(x), y)
    return p.part


def _verify(members: DataFrame, words: int, similarity: int) -> DataFrame:
    """(node, label, root): for each member of a group (pack, comp, block), the smallest label it is linked to within the group."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("comp", "block", "node")]).combine_chunks()
        keys = list(zip(*[group.column(c).to_pylist() for c in ("comp", "block", "node")], strict=True))
        once = np.array([k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))])
        group, keys = group.filter(pa.array(once)).combine_chunks(), [x for x, on in zip(keys, once.tolist(), strict=True) if on]
        data, offsets = string_parts(group.column("text").combine_chunks() if len(keys) > 1 else group.column("text").chunk(0))
        sets = [s for i, j in row_steps(offsets) for s in shingle_sets(data, offsets[i : j + 1], words)]
        labels, asks = group.column("label").to_pylist(), np.array(group.column("asks").to_pylist(), bool)
        roots: list = []
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b][:2] == keys[a][:2]:
                b += 1
            part = link(sets[a:b], labels[a:b], asks[a:b], similarity).tolist()
            least: dict[int, bytes] = {}
            for r, x in zip(part, labels[a:b], strict=True):
                least[r] = min(x, least.get(r, x))
            roots += [least[r] for r in part]
            a = b
        out = pa.table({"node": pa.array([k[2] for k in keys], pa.binary()), "label": pa.array(labels, pa.binary()), "root": pa.array(roots, pa.binary())})
        del group, data, sets
        release()
        return out

    dealt = members.select("pack", "wide", "comp", "block", "node", "label", "asks", "text").repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pack", "wide")
    return dealt.groupBy("pack", "wide").applyInArrow(run, "node binary, label binary, root binary")


def _alone(members: DataFrame) -> DataFrame:
    """Each (comp, block) as a group by itself."""
    return members.withColumn("pack", F.col("block")).withColumn("wide", F.col("comp"))


def _relabel(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after the merges (label, root) found."""
    roots = components(merged.select(F.col("label").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("label"), "root")
    return stored(labels.join(roots, "label", "left").select("comp", "node", "size", "text", F.coalesce("root", "label").alias("label")), "labels")


def _sources(docs: DataFrame, id_col: str, text_col: str) -> list:
    doc, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("string")
    return [doc.alias("doc_id"), F.xxhash64(doc, text).alias("key"), text.alias("text")]


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: int = 75, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(doc_id, key: hash of the row, n_shingles, label: of the group, component_id), one row per row of ``docs``; without shingles the label is null."""
    src = docs.select(*_sources(docs, id_col, text_col))
    rows = stored(_profile(src, words), "profile")
    lone = rows.where("node is null").select("doc_id", "key", "n_shingles", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("component_id"))
    has = rows.where("node is not null")
    ids = has.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n_shingles").alias("size"))

    reps = has.where("bands is not null").dropDuplicates(["node"]).select("node", F.explode("bands").alias("bucket"))
    least = reps.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).where("pivot != most").select("bucket", "pivot")
    ties = reps.join(least, "bucket").where("node != pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    comps = stored(components(ties).select("node", F.col("root").alias("comp")), "candidates")

    one = has.where("bands is not null").groupBy("node").agg(F.min("doc_id").alias("at"), (F.max("n_shingles") + 2 * PERMUTATIONS).alias("size"))
    sized = comps.join(one, "node")
    totals = sized.groupBy("comp").agg(F.sum("size").alias("total"))
    sized = sized.join(totals, "comp").withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(group_shingles))).cast("int"))
    # the text of one row of each candidate node; rows that share the id but not the set are told apart by the set again
    members = sized.join(src, F.col("at").eqNullSafe(F.col("doc_id")))
    members = members.select("comp", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("block"), "node", F.col("node").alias("label"), F.lit(True).alias("asks"), "text", "size", "total", "parts")
    same = stored(_checked(members, words), "members")
    small = F.col("total") <= F.lit(group_shingles // 8)
    packs = -(-2 * (same.where(small).agg(F.sum("size")).first()[0] or 0) // group_shingles) or 1
    groups = same.withColumn("pack", F.when(small, F.pmod(F.xxhash64("comp"), F.lit(packs)).cast("int")).otherwise(F.col("block"))).withColumn("wide", F.when(~small, F.col("comp")))
    linked = stored(_verify(groups, words, similarity), "linked")
    parts = linked.select("node", F.col("root").alias("label"))

    big = same.where("parts > 1").select("comp", "node", "size", "text")
    if big.limit(1).count():
        large = stored(big.dropDuplicates(["node"]).join(parts, "node"), "labels")
        # one member of each part, in bounded groups
        heads = large.where("node = label")
        counts = heads.groupBy("comp").agg(F.ceil(F.sum("size") / F.lit(group_shingles)).cast("int").alias("parts"))
        heads = heads.join(counts, "comp").select("comp", F.pmod(F.xxhash64("label"), F.col("parts")).cast("int").alias("block"), "node", "label", F.lit(True).alias("asks"), "text")
        large = _relabel(large, _verify(_alone(heads), words, similarity))
        # each member outside the largest part against all
        weight = large.groupBy("comp", "label").agg(F.sum("size").alias("w"))
        top = weight.groupBy("comp").agg(F.max_by("label", F.struct("w", "label")).alias("top"), F.sum("w").alias("total"), (F.sum("w") - F.max("w")).alias("rest"))
        half = group_shingles / 2
        dealt = large.join(top.withColumn("mb", F.ceil(F.col("total") / half).cast("int")).withColumn("ub", F.greatest(F.lit(1), F.ceil(F.col("rest") / half)).cast("int")), "comp").where("rest > 0")
        own = F.pmod(F.xxhash64("node"), F.col("mb")).cast("int")
        other = F.pmod(F.xxhash64("node", F.lit(1)), F.col("ub")).cast("int")
        left = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("ub") - 1))).select("comp", (F.col("u") * F.col("mb") + own).alias("block"), "node", "label", F.lit(False).alias("asks"), "text")
        right = dealt.where("label != top").withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).select("comp", (other * F.col("mb") + F.col("m")).alias("block"), "node", "label", F.lit(True).alias("asks"), "text")
        both = left.unionByName(right).groupBy("comp", "block", "node").agg(F.first("label").alias("label"), F.max("asks").alias("asks"), F.first("text").alias("text"))
        large = _relabel(large, _verify(_alone(both), words, similarity))
        parts = parts.join(large.select("node"), "node", "left_anti").unionByName(large.select("node", "label"))

    named = ids.join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_of = named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("copies").alias("n")).where("n > 1")
    of_node = named.join(least_of, "label").select("node", "label", "component_id")
    some = has.select("doc_id", "key", "n_shingles", "node").join(of_node, "node", "left")
    known = F.col("label").isNotNull()
    some = some.select("doc_id", "key", "n_shingles", F.coalesce("label", "node").alias("label"), F.when(known, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return some.unionByName(lone)


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    return grouped(docs, **how).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (of several, the one with the smallest row hash). A repeated row counts once."""
    rows = grouped(docs, id_col=id_col, text_col=text_col, **how).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = rows.groupBy(F.coalesce("label", F.xxhash64("key").cast("string").cast("binary")).alias("label")).agg(F.min(F.struct("key", "doc_id")).alias("x"))
    kept = first.select(F.col("x.key").alias("k"), F.coalesce("x.doc_id", F.lit(-1)).alias("i"))
    doc, key, _ = _sources(docs, id_col, text_col)
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), key.alias("k"), F.coalesce(doc, F.lit(-1)).alias("i"))
    return df.join(kept, ["k", "i"], "left_semi").dropDuplicates(["k", "i"]).select("r.*")


def _checked(members: DataFrame, words: int) -> DataFrame:
    """Rows whose text has the node's set."""

    def run(batches):
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            names = [node_key(s) if len(s) else None for i, j in row_steps(offsets) for s in shingle_sets(data, offsets[i : j + 1], words)]
            yield batch.filter(pa.array([a == b for a, b in zip(names, batch.column("node").to_pylist(), strict=True)], pa.bool_()))

    return members.mapInArrow(lean(run), members.schema)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g, least(5, len(w)) AS m FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (SELECT rid, count(*) AS k FROM s GROUP BY rid
), p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.m = b.m AND a.rid < b.rid GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 75 * (a.k + b.k - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), c AS (SELECT r.x AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY r.x)
SELECT doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
