"""Packing of token streams into fixed windows with a controlled mixture of sources.

Deficit round robin over one queue per source: each window of ``length`` tokens grants every queue its share, parts of a
token are carried to the next window as the queue's deficit, and documents are cut where a grant ends. The deficits have a
closed form: with cumulative weights ``c_j`` of ``s`` in all, the queues up to j have got ``floor(w * length * c_j / s)`` tokens
after w windows. So each partition knows, from where its documents stand in their queues, which windows they fall into,
and carries the deficits of all partitions before it without waiting for them. Every window but the last is full. When a
queue runs dry the round robin goes on among the others (a new phase); the few windows around that are dealt one by one.

The weights default to the sources' token counts, so that all queues end together. Sources whose share is less than two
tokens a window are put together, in groups of like weights that have such a share; the order of tokens in a group comes from
a round robin of its own by the same rule, so their proportions hold too, over correspondingly more windows. A group that is
still too small, alone of its kind, gets two tokens a window.

Defined results: null text is empty; every document ends with ``end_id``, so an empty one is one token; a null source is a
queue of its own; repeated rows are packed each. The plan is in proportion to the sources (with explicit weights, and so many
ends of queues, up to half the square of those with a share of their own). Beyond ``MAX_QUEUES`` sources, those with a weight
and the largest others keep queues of their own; the remainder shares ``SHARED_QUEUES`` by hash, each with the sum of its
sources' targets, so that only the proportions of the smallest sources among themselves are left to the order of the partitions.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, row_steps, stored, string_parts, table
from .textvec import NON_SPACE, Words, word_hashes

LENGTH = 4096
MAX_QUEUES = 100_000
SHARED_QUEUES = 4096
CACHE_WORDS = 500_000
#: rows of the (partition, queue) offsets up to which they are broadcast; beyond, they are joined by a shuffle
BROADCAST_ROWS = 200_000
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")


_LETTER, _DIGIT, _MARK, _WIDE = 1, 2, 3, 4
_CLASS = np.array([0 if not NON_SPACE[b] else _WIDE if b >= 0x80 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK for b in range(256)], np.uint8)
_SLOTS, _PROBES = 20, 8


def find_units(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Parts of words that the vocabulary's splitting rule treats apart: cut between ASCII letters, digits and marks, but not behind an apostrophe, which may open a contraction."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    kind = np.zeros(hi - lo + 2, np.uint8)
    kind[1:-1] = _CLASS[data[lo:hi]]
    here, before = kind[1:-1], kind[:-2]
    cut = (here != before) & (here != _WIDE) & (before != _WIDE)
    cut[1:] &= ~((data[lo : hi - 1] == 0x27) & (here[1:] == _LETTER))
    inner = offsets[1:-1] - lo
    cut[inner[(inner > 0) & (inner < hi - lo)]] = True
    cut = np.append(cut, True)
    cut[:-1] |= (before == 0) != (here == 0)
    start = np.flatnonzero(cut[:-1] & (here > 0))
    edges = np.flatnonzero(cut)
    end = edges[np.searchsorted(edges, start, "right")]
    start, end = start + lo, end + lo
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, np.diff(first), first)


class WordTokenizer:
    """Token ids of texts by way of a bounded cache of the parts of words.

    Parts of letters alone are one piece of the vocabulary's splitting rule; their merges are done by a rank-based encoder
    over the same vocabulary, in which an extra byte stands for the end of a word. Other parts go through the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.sep = self.tok.token_to_id(_SPECIAL[1])
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {}
        for token, k in self.tok.get_vocab(with_added_tokens=False).items():
            if token not in _SPECIAL:
                ends = token.endswith("</w>") and token != "</w>"
                ranks[bytes(byte[c] for c in (token[:-4] if ends else token)) + b"\xff" * ends] = k
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._clear()

    def _clear(self):
        self.keys, self.place = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
        self.known = 0
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _ids(self, word: str) -> list[int]:
        low = word if word.isascii() else unicodedata.normalize("NFC", word)
        low = low.lower()
        if low.isalpha() and "\u03c2" not in low:
            return self.merge(low.encode() + b"\xff")
        return self.tok.encode(word, add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, words: list[str]) -> np.ndarray:
        """Slots of new parts."""
        many = [self._ids(x) for x in words]
        size = np.array([len(x) for x in many])
        ids = np.array([i for x in many for i in x], np.uint32)
        slots = np.arange(self.known, self.known + len(words))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while slots[-1] >= len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[slots], self.size[slots] = self.used + np.cumsum(size) - size, size
        self.used += len(ids)
        self.known += len(words)
        rest = np.arange(len(words))
        for k in range(_PROBES):  # what finds no place is learned again when it is met again
            at = ((hashes[rest] >> np.uint64(64 - _SLOTS)).astype(np.int64) + k) & ((1 << _SLOTS) - 1)
            _, lead = np.unique(at, return_index=True)
            lead = lead[self.place[at[lead]] < 0]
            self.keys[at[lead]], self.place[at[lead]] = hashes[rest[lead]], slots[rest[lead]]
            rest = np.delete(rest, lead)
            if not len(rest):
                break
        return slots

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, number per document)."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = data[lo:hi].tobytes()
        if any(x.encode() in raw for x in _SPECIAL):  # they are tokens of their own
            ids = [self.tok.encode(raw[a - lo : b - lo].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids])
        w = find_units(data, offsets)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(w.count), np.int64)
        if self.known > CACHE_WORDS:
            self._clear()
        h = word_hashes(w, lower=True)
        slot = np.full(len(h), -1, np.int32)
        rest, at = np.arange(len(h)), (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        for k in range(_PROBES):
            where = (at[rest] + k) & ((1 << _SLOTS) - 1)
            place = self.place[where]
            hit = (self.keys[where] == h[rest]) & (place >= 0)
            slot[rest[hit]] = place[hit]
            rest = rest[~hit & (place >= 0)]
            if not len(rest):
                break
        new = np.flatnonzero(slot < 0)
        if len(new):
            names, first, inv = np.unique(h[new], return_index=True, return_inverse=True)
            s, e = w.start[new[first]].tolist(), w.end[new[first]].tolist()
            slot[new] = self._learn(names, [data[x:y].tobytes().decode() for x, y in zip(s, e, strict=True)])[inv]
        n = self.size[slot]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.begin[slot] - (upto - n), n) + np.arange(upto[-1])]
        total = np.concatenate([[0], upto])
        return ids, total[w.first[1:]] - total[w.first[:-1]]


def tokenized(docs: DataFrame, path: str, *, end_id: int = 2, wide: bool = True) -> DataFrame:
    """(doc_id, queue, part, off, n, ids), a queue a source: ``off`` is the number of the queue's ids before it in its partition; ``ids`` little-endian."""
    kind = "<u4" if wide else "<u2"

    def run(batches):
        tok, part = WordTokenizer(path), TaskContext.get().partitionId()
        before: dict[str, int] = {}
        for batch in batches:
            data, offsets = string_parts(batch.column("text"))
            queue = batch.column("queue").to_pylist()
            offs, counts, blobs = [], [], []
            for i, j in row_steps(offsets):
                ids, n = tok.encode(data, offsets[i : j + 1])
                cut = np.concatenate([[0], np.cumsum(n)])
                for d in range(j - i):
                    q, size = queue[i + d], int(n[d]) + 1
                    offs.append(before.get(q, 0))
                    before[q] = offs[-1] + size
                    counts.append(size)
                    blobs.append(np.append(ids[cut[d] : cut[d + 1]], np.uint32(end_id)).astype(kind).tobytes())
            m = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("queue"), pa.array([part] * m, pa.int32()), pa.array(offs, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "queue", "part", "off", "n", "ids"])

    return docs.select("doc_id", "queue", "text").mapInArrow(lean(run), "doc_id bigint, queue string, part int, off bigint, n bigint, ids binary")


class Plan:
    """Which window and offset each place of each queue falls to."""

    def __init__(self, totals: dict[str, int], length: int, weights: dict[str, int] | None = None):
        self.length = length
        totals = {q: n for q, n in totals.items() if n}
        want = {q: max(1, int((weights or totals).get(q, 1))) for q in totals}
        self.groups: dict[str, tuple[str, Plan]] = {}
        self._join_small(totals, want)
        self.queues = sorted(totals)
        self.spans: dict[str, list[tuple]] = {q: [] for q in self.queues}  # (first place, first window, windows, cumulative weights, their sum) or an own window's offset
        left, took = dict(totals), dict.fromkeys(self.queues, 0)
        window = 0
        while live := [q for q in self.queues if left[q]]:
            w = {q: want[q] for q in live}
            s = sum(w.values())
            cum = [0]
            for q in live:
                cum.append(cum[-1] + w[q])
            m = min(left[q] * s // (length * w[q]) for q in live)
            if m > 0:
                for r, q in enumerate(live):
                    self.spans[q].append((took[q], window, m, cum[r], cum[r + 1], s))
                    got = m * length * cum[r + 1] // s - m * length * cum[r] // s
                    took[q] += got
                    left[q] -= got
                window += m
                continue
            # one window by itself: shares, then what is still free goes round
            grant = {q: min(left[q], length * cum[r + 1] // s - length * cum[r] // s) for r, q in enumerate(live)}
            free = length - sum(grant.values())
            while free and (able := [q for q in live if left[q] > grant[q]]):
                for q in able:
                    more = min(left[q] - grant[q], free, max(1, free * w[q] // sum(w[x] for x in able)))
                    grant[q] += more
                    free -= more
            at = 0
            for q in live:
                if grant[q]:
                    self.spans[q].append((took[q], window, 0, at, grant[q], 0))
                    took[q] += grant[q]
                    left[q] -= grant[q]
                    at += grant[q]
            window += 1
        self.windows = window
        self.starts = {q: [x[0] for x in v] for q, v in self.spans.items()}

    def _join_small(self, totals: dict[str, int], want: dict[str, int]) -> None:
        """Put queues with less than two tokens a window into groups, each a plan of its own, in place of them."""
        s = sum(want.values())
        low = sorted((q for q in totals if want[q] * self.length < 2 * s), key=lambda q: (-want[q], q))
        if not low or len(totals) == 1:
            return
        parts, at = [[]], 0
        for q in low:
            if at * self.length >= 2 * s:
                parts.append([])
                at = 0
            parts[-1].append(q)
            at += want[q]
        if at * self.length < 2 * s and len(parts) > 1:
            rest = parts.pop()
            parts[-1] += rest
        for k, part in enumerate(parts):
            name = f"\0{k}"
            weight = sum(want[q] for q in part)
            turn = min(self.length, max(16, -(-2 * weight // min(want[q] for q in part))))  # tokens in which each gets its share
            plan = Plan({q: totals[q] for q in part}, turn, {q: want.pop(q) for q in part})
            self.groups |= {q: (name, plan) for q in part}
            totals[name], want[name] = sum(totals.pop(q) for q in part), max(weight, -(-2 * (s - weight) // max(1, self.length - 2)))

    def pieces(self, queue: str, place: int, n: int):
        """(start in the document, length, window, offset) of the n ids that stand at ``place`` in the queue."""
        if queue not in self.groups:
            yield from self._pieces(queue, place, n)
            return
        name, plan = self.groups[queue]
        for start, size, window, offset in plan.pieces(queue, place, n):
            for inner, some, w, at in self._pieces(name, window * plan.length + offset, size):
                yield start + inner, some, w, at

    def _pieces(self, queue: str, place: int, n: int):
        done, spans, starts = 0, self.spans[queue], self.starts[queue]
        k = bisect_right(starts, place) - 1
        while done < n:
            x = place + done
            while k + 1 < len(starts) and starts[k + 1] <= x:
                k += 1
            first, window, m, lo, hi, s = spans[k]
            if not m:
                take = min(n - done, first + hi - x)
                yield done, take, window, lo + x - first
                done += take
                continue
            ln = self.length
            w = min(m - 1, (x - first) * s // (ln * (hi - lo)))
            while w and first + w * ln * hi // s - w * ln * lo // s > x:
                w -= 1
            while True:
                a, b = w * ln * lo // s, (w + 1) * ln * lo // s
                begin, end = first + w * ln * hi // s - a, first + (w + 1) * ln * hi // s - b
                if end > x:
                    break
                w += 1
            while done < n and w < m:
                take = min(n - done, end - x)
                if take:
                    yield done, take, window + w, (b - a) + x - begin
                done += take
                x += take
                w += 1
                a, b = b, (w + 1) * ln * lo // s
                begin, end = end, first + (w + 1) * ln * hi // s - b


_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def packed(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, end_id: int = 2, weights: dict[str, int] | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents (``_PIECE``; with ``keep_ids`` also their ids). ``weights``: target shares by source."""
    if length < 16:
        raise ValueError("length must be 16 or more")
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), name.alias("queue"), F.col(text_col).cast("string").alias("text"))
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(path).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    tokens = stored(tokenized(src, path, end_id=end_id, wide=wide), "tokens")
    sums = tokens.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    wanted = weights and {f"={k}": v for k, v in weights.items()}
    sources = stored(sums.groupBy("queue").agg(F.sum("n").alias("n")), "sources")
    line = F.col("queue")
    if sources.count() > MAX_QUEUES:
        named = sorted(wanted or ())
        large = sources.where(~F.col("queue").isin(named)).orderBy(F.desc("n"), "queue").limit(max(0, MAX_QUEUES - SHARED_QUEUES - len(named)))
        own = named + [r.queue for r in large.collect()]
        line = F.when(line.isin(own), line).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64(line), F.lit(SHARED_QUEUES)).cast("string")))
    bases = stored(sums.withColumn("line", line).withColumn("base", F.sum("n").over(Window.partitionBy("line").orderBy("part", "queue")) - F.col("n")), "bases")
    totals = sources.groupBy(line.alias("line")).agg(F.sum("n").alias("n"), F.count("*").alias("sources")).collect()
    # a source without a weight counts 1, also in a shared queue
    plan = Plan({r.line: r.n for r in totals}, length, wanted and {r.line: wanted.get(r.line, r.sources) for r in totals})
    known = docs.sparkSession.sparkContext.broadcast(plan)
    base = bases.select("part", "queue", "line", "base")
    if bases.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    kind = "<u4" if wide else "<u2"

    def run(batches):
        p = known.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + keep_ids)]
            for doc, queue, off, n, ids, first in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "line", "off", "n", "ids", "base")], strict=True):
                raw = memoryview(np.frombuffer(ids, kind).astype("<u4").tobytes())
                for start, size, window, at in p.pieces(queue, first + off, n):
                    part = raw[4 * start : 4 * (start + size)]
                    row = (doc, start, size, zlib.crc32(part), n, window, at) + ((part.tobytes(),) if keep_ids else ())
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
            names = [x.split()[0] for x in _PIECE.split(", ")] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 7 else pa.binary()) for k, x in enumerate(out)], names=names)

    return tokens.join(base, ["part", "queue"]).select("doc_id", "line", "off", "n", "ids", "base").mapInArrow(lean(run), _PIECE + ", ids binary" * keep_ids)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary())
