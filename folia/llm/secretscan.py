"""Secrets in texts: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Only DataFrame functions. Patterns (assign, access, hex) are found leftmost and non-overlapping per kind; matches that are
too short are dropped. The models add ``markov`` spans: runs of 16 or more of ``A-Za-z0-9_+/=-`` with a letter and a digit,
for which first-order character models of random strings and of ordinary identifiers differ by ``threshold`` nats a
character or more. Both are trained by counting character pairs of labelled samples (any table of text and is_random; the
default one is composed from hashes and from common programming words). A markov span that overlaps a pattern's is left out.

Positions come from the pieces between matches: a match ends behind all pieces and matches up to its own. Sums and extremes
along the matches of a text run in nested blocks, so that its time is in proportion to their number.

Defined results: null text is empty; positions are code points, ends exclusive; spans are ordered by start, then kind
(assign, access, hex, markov); without samples nothing is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: a run counts as a whole
CANDIDATE = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/=-"
THRESHOLD = 0.6
_WORDS = (
    "get set user name id list map file path data index count value key node tree graph batch size max min total line page doc text word token model layer test case run build config option param input output "
    "read write open close start stop send load save parse format print error warn info debug time date year month day hour second left right top bottom width height color image table row column cell block item "
    "type class method field object array string number float bool null true false public private static final abstract base main util helper manager service client server request response session cache queue "
    "worker thread process event handler listener callback filter sort group join merge split update delete insert create remove add copy move find search match replace update version release branch commit report"
).split()


def samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(text, is_random): the default labelled samples, the same every time."""
    i = F.col("id")
    h = lambda k: F.xxhash64(i, F.lit(k))
    words = F.array(*[F.lit(w) for w in _WORDS])
    word = lambda k: F.element_at(words, (F.pmod(h(k), F.lit(len(_WORDS))) + 1).cast("int"))
    number = F.when(F.pmod(h(9), F.lit(2)) == 0, F.pmod(h(10), F.lit(1000)).cast("string")).otherwise(F.lit(""))
    style = F.pmod(h(8), F.lit(5))
    parts = [word(k) for k in range(4)]
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *parts, number))
        .when(style == 1, F.concat(parts[0], *[F.initcap(p) for p in parts[1:]], number))
        .when(style == 2, F.concat_ws("-", *parts, number))
        .when(style == 3, F.upper(F.concat_ws("_", *parts, number)))
        .otherwise(F.concat_ws("/", *parts, F.concat(parts[1], number)))
    )
    raw = F.unhex(F.sha2(F.concat(F.lit("folia"), i.cast("string")), 256))
    random = F.when(style < 3, F.substring(F.base64(raw), 1, 36)).when(style == 3, F.substring(F.upper(F.conv(F.substring(F.hex(raw), 1, 15), 16, 36)), 1, 12)).otherwise(F.substring(F.lower(F.hex(raw)), 1, 40))
    return spark.range(n).select(F.when(i % 2 == 0, random).otherwise(ordinary).alias("text"), (i % 2 == 0).alias("is_random"))


def _pairs(text: Column) -> Column:
    """Index of each pair of neighbouring characters (a character's code is its place in the alphabet, 0 for others)."""
    codes = F.transform(F.split(text, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    return bind(codes, lambda k: F.transform(F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0))), lambda x, i: x * (len(ALPHABET) + 1) + F.get(k, i + 1)))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each character pair, by index; counts are smoothed."""
    k = len(ALPHABET) + 1
    rows = labelled.where("text is not null and is_random is not null").select("is_random", F.explode(_pairs(F.col("text"))).alias("pair")).groupBy("is_random", "pair").count().collect()
    counts = {True: [0.2] * (k * k), False: [0.2] * (k * k)}
    for r in rows:
        counts[r.is_random][r.pair] += r["count"]
    if not rows:
        return [0.0] * (k * k)
    logs = {}
    for kind, c in counts.items():
        logs[kind] = [math.log(c[a * k + b] / sum(c[a * k : a * k + k])) for a in range(k) for b in range(k)]
    return [x - y for x, y in zip(logs[True], logs[False], strict=True)]


def _weights(values: list[float]) -> Column:
    """A table of numbers as one constant."""
    return F.split(F.lit(" ".join(f"{v:.4f}" for v in values)), " ").cast("array<double>")


def running(values: Column, op: Callable[[Column, Column], Column], zero: int, block: int = 64) -> Column:
    """``op`` over the values of an array<int> up to each, in nested blocks; ``zero`` is neutral."""

    def plain(v: Column, init: Column) -> Column:
        start = F.struct(init.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(v, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], op(acc["at"], x)).alias("out")), lambda acc: acc["out"])

    def level(v: Column, depth: int) -> Column:
        if not depth:
            return plain(v, F.lit(zero))
        blocks = F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda i: F.slice(v, i * block + 1, block))).otherwise(F.array().cast("array<array<int>>"))
        whole = lambda cs: F.transform(cs, lambda c: F.aggregate(c, F.lit(zero), lambda a, b: op(a, b)))
        return bind(blocks, lambda cs: bind(bind(whole(cs), lambda w: level(w, depth - 1)), lambda before: F.flatten(F.transform(cs, lambda c, i: plain(c, F.coalesce(F.get(before, i - 1), F.lit(zero)))))))

    return bind(values, lambda v: level(v, 2))


def _found(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans (start, rank, end, text) of the matches of a pattern in a text, those whose group has ``least`` characters or more."""
    read = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    ends = lambda r: running(F.transform(r, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["whole"]), F.lit(0))), lambda a, b: a + b, 0)
    span = lambda x, end: F.struct((end - F.length(x["whole"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["whole"].alias("text"), F.length(x["part"]).alias("size"))
    every = bind(read, lambda r: bind(ends(r), lambda e: F.transform(r, lambda x, i: span(x, F.get(e, i)))))
    return F.filter(every, lambda x: x["size"] >= least)  # the piece behind the last match has none


_NONE = "array<struct<start:int,rank:int,end:int>>"
_FAR = (1 << 31) - 1


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], x["rank"], x["end"]))


def _free(spans: Column, rank: int) -> Column:
    """Of spans in order, those of lower ranks and those of ``rank`` that overlap none of them."""
    tops = running(F.transform(spans, lambda x: F.when(x["rank"] < rank, x["end"]).otherwise(F.lit(0))), F.greatest, 0)
    nexts = F.reverse(running(F.reverse(F.transform(spans, lambda x: F.when(x["rank"] < rank, x["start"]).otherwise(F.lit(_FAR)))), F.least, _FAR))
    clear = lambda x, i, t, n: (x["rank"] < rank) | (F.get(t, i) <= x["start"]) & (F.get(n, i) >= x["end"])
    return bind(tops, lambda t: bind(nexts, lambda n: F.filter(spans, lambda x, i: clear(x, i, t, n))))


def scan(docs: DataFrame, *, text_col: str = "text", labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans (replacing columns of these names)."""
    model = train(samples(docs.sparkSession) if labelled is None else labelled)
    none = F.array().cast(_NONE)
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    ride = [c for c in docs.columns if c not in added]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in ride]).alias("r"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    df = df.withColumn("low", F.lower("t"))
    has = F.lit(False)
    for word in KEYWORDS:
        has = has | F.contains("low", F.lit(word))
    t = F.col("t")
    assign = F.when(has, _bare(_found(t, ASSIGN, 0, 1, 6))).otherwise(none)
    access = F.when(F.contains("t", F.lit("AKIA")), _bare(_found(t, ACCESS, 1))).otherwise(none)
    hexes = F.when(F.rlike("t", F.lit(HEX)), _bare(_found(t, HEX, 2))).otherwise(none)
    df = df.select("r", "t", F.array_sort(F.concat(assign, access, hexes)).alias("base"))

    table_ = _weights(model)
    score = lambda w: F.aggregate(_pairs(w), F.lit(0.0), lambda acc, p: acc + F.get(table_, p)) / F.length(w)
    likely = lambda x: F.rlike(x["text"], F.lit("[0-9]")) & F.rlike(x["text"], F.lit("[A-Za-z]")) & (score(x["text"]) >= threshold)
    more = F.when(F.rlike("t", F.lit("[0-9]")) & F.rlike("t", F.lit(CANDIDATE)), _bare(F.filter(_found(t, CANDIDATE, 3), likely))).otherwise(none)
    df = df.select("r", "base", more.alias("more"))
    every = bind(F.array_sort(F.concat("base", "more")), lambda e: _free(e, 3))
    df = df.select("r", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(every).alias("every"))
    names = F.array(*[F.lit(k) for k in (*KINDS, "markov")])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["rank"] == k)).cast("bigint")
    return df.select("r.*", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.col("every")).alias("spans"))


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
