"""Text quality: fixed counts, and the log-likelihood ratio of hashed n-grams between trusted and raw texts.

Only DataFrame functions. The n-grams of a text are its words, pairs of neighbouring words, the marks of each word that has
any (what is left of it without ASCII letters, digits and non-ASCII characters) and neighbouring pairs of these marks,
hashed into ``buckets`` bins (word pairs into one half of them, the others into the other). The raw multinomial counts all
documents, the trusted one all that labels call good. A document's score is the mean log ratio of its n-grams; it fails below
a threshold that is taken from the scores of all good rows: ``margin`` nats under the largest one that keeps ``keep`` of them.

Defined results: null text is empty and has score 0; a document fails (``kept`` false) on the fixed counts alone, or on its
score; without labels of good rows all scores are 0 and none fails on them; labels of unknown ids are ignored, of repeated
labels the smaller counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, stored, table

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 15
KEEP = 0.998
MARGIN = 0.25
GRID = 4096
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
_SPACES = " \t\n\x0b\f\r"
_PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def rest(text: Column) -> Column:
    """A text without its ASCII letters and digits."""
    return F.translate(text, _PLAIN, "")


def joined(h: Column, apart: int) -> Column:
    """Hashes of each element with the one ``apart`` places on."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - apart, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + apart)))


def _low(half: int) -> Callable[[Column], Column]:
    """A hash's bin in one half of the bins."""
    if half & (half - 1):
        return lambda x: F.pmod(x, F.lit(half)).cast("int")
    return lambda x: x.bitwiseAND(F.lit(half - 1).cast("bigint")).cast("int")


def marks(other: Column) -> Column:
    """Hashes of the marks of the words that have any, from ``rest``, and of neighbouring ones (the last with nothing)."""
    alone = F.transform(F.array_remove(F.split(F.regexp_replace(other, r"[^\x00-\x7F]+", ""), SPACE), ""), lambda x: F.xxhash64(x, F.lit(2)))
    return bind(alone, lambda m: F.concat(m, F.transform(m, lambda x, i: F.xxhash64(x, F.get(m, i + 1)))))


def bins(h: Column, pairs: Column, other: Column, buckets: int) -> Column:
    """Bins of all n-grams of a text, from the hashes of its words and their pairs and ``rest``."""
    low = _low(buckets // 2)
    return F.concat(F.transform(h, low), F.transform(pairs, lambda x: low(x) + buckets // 2), F.transform(marks(other), low))


def of_text(t: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the hashes of a text's words and of their pairs."""
    return bind(hashes(t), lambda h: bind(joined(h, 1), lambda g: use(h, g)))


def _repeated(pairs: Column) -> Column:
    """Words in windows of 8 that occur twice or more, from the hashes of pairs: no window repeats where no four words do."""
    count = lambda g: F.when(F.size(g) > F.size(F.array_distinct(g)), bind(joined(g, 4), lambda w: _covered(w, 8))).otherwise(F.lit(0))
    return bind(joined(pairs, 2), count)


def _covered(g: Column, window: int) -> Column:
    """Words in windows (hashes g, by start) that occur twice or more."""
    pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    same = lambda s, x, i: F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))
    starts = bind(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["i"])))
    count = F.aggregate(starts, F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")), lambda a: a["n"])
    return F.when(F.size(g) > F.size(F.array_distinct(g)), count).otherwise(F.lit(0))


def _measured(df: DataFrame, score) -> DataFrame:
    """(r, t) with the counts and the score that ``score`` gives for hashes of words and pairs and ``rest``."""
    t, o = F.col("t"), F.col("_o")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    repeated = F.when(F.contains(t, F.lit("\n")), bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(F.lit(0))
    of_words = of_text(t, lambda h, g: F.struct(F.size(h).alias("n"), _repeated(g).alias("repeated"), score(h, g, o).alias("score")))
    df = df.withColumn("_o", rest(t)).withColumn("_b", of_words)
    size = lambda x: x.cast("bigint")
    return df.select(
        "r",
        size(F.col("_b.n")).alias("n_words"),
        size(F.length(t) - F.length(o) + F.length(F.translate(o, _SPACES, ""))).alias("word_chars"),
        size(F.length(o) - F.length(F.translate(o, "#*$%&|<>", ""))).alias("n_symbols"),
        size(repeated).alias("n_dup_lines"),
        size(F.col("_b.repeated")).alias("n_repeat_words"),
        F.col("_b.score").alias("score"),
    )


def _table(values: list[float]) -> Column:
    return F.split(F.lit(" ".join(f"{v:.3f}" for v in values)), " ").cast("array<double>")


def _score(h: Column, pairs: Column, other: Column, model: list[float]) -> Column:
    """Mean log ratio of the n-grams of a text."""
    half = len(model) // 2
    low = _low(half)
    words_, pairs_ = _table(model[:half]), _table(model[half:])
    total = lambda x, start, weights: F.aggregate(x, start, lambda a, y: a + F.get(weights, low(y)))
    mean = lambda m: total(m, total(pairs, total(h, F.lit(0.0), words_), pairs_), words_) / (F.size(h) + F.size(pairs) + F.size(m))
    return F.when(F.size(h) > 0, bind(marks(other), mean)).otherwise(F.lit(0.0))


def good_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, good = 1): every id that labels call good, once; never broadcast, so that any number of them can be joined."""
    some = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null")
    return some.groupBy("id").agg(F.min("y").alias("y")).where("y = 1").select("id", F.lit(1).alias("good")).hint("merge")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))


def log_ratios(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS) -> list[float]:
    """Log ratio by bin from all texts and all labelled ids; none (an empty list) without texts of good ids."""
    df = _texts(docs, id_col, text_col).join(good_ids(labels, id_col, label_col), "id", "left")
    rows = df.select("good", F.explode(of_text(F.col("t"), lambda h, g: bins(h, g, rest(F.col("t")), buckets))).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count("good").alias("target")).collect()
    raw, target = [1.0] * buckets, [0.0] * buckets
    for r in rows:
        raw[r.b] += r.raw
        target[r.b] += r.target
    n, m = sum(raw), sum(target)
    if not m:
        return []
    smooth = 0.02 * m / n  # so that a bin unseen in the target gets a fiftieth of its raw share
    return [math.log((target[k] + smooth * raw[k]) / (m * 1.02) / (raw[k] / n)) for k in range(buckets)]


def of_rank(values: DataFrame, rank: Callable[[int], int]) -> float | None:
    """The value of column ``s`` at ``rank`` (of the number of rows; 0: smallest), None without rows.

    Rows are counted on a grid between the smallest and the largest value, then on one inside the cell of that rank, until it
    holds one value: exact, and no more than a grid comes to the driver.
    """
    low, high, n = values.agg(F.min("s"), F.max("s"), F.count("s")).first()
    k = rank(n) if n else 0
    while n and low != high:
        cell = F.floor((F.col("s") - F.lit(low)) / F.lit(high - low) * GRID)
        counts = values.where(F.col("s").between(low, high)).groupBy(cell.alias("c")).agg(F.min("s"), F.max("s"), F.count("s"))
        for _, low, high, n in sorted(counts.collect()):  # noqa: B007
            if k < n:
                break
            k -= n
    return low


def threshold(scores: DataFrame, keep: float = KEEP, margin: float = MARGIN) -> float:
    """``margin`` under the largest value that keeps ``keep`` of column ``s``, the scores of all good rows."""
    least = of_rank(scores, lambda n: int((1 - keep) * n))
    return -math.inf if least is None else least - margin


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, keep: float = KEEP, margin: float = MARGIN) -> tuple[list[float], float]:
    """(log ratio by bin, threshold) from all texts and all labelled ids."""
    model = log_ratios(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, buckets=buckets)
    if not model:
        return [0.0] * buckets, -math.inf
    good = _texts(docs, id_col, text_col).join(good_ids(labels, id_col, label_col), "id")
    scored = good.select(of_text(F.col("t"), lambda h, g: _score(h, g, rest(F.col("t")), model)).alias("s"))
    return model, threshold(stored(scored, "quality"), keep, margin)


def measured(docs: DataFrame, model: list[float], *, text_col: str = "text", min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """``docs`` with the counts, base_failed and score (replacing columns of these names, and kept)."""
    ride = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    df = docs.select(F.struct(*ride).alias("r"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    df = _measured(df, lambda h, g, o: _score(h, g, o, model))
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
    return df.select("r.*", *ADDED[:7])


def _kept(least: float) -> Column:
    return (~F.col("base_failed") & (F.col("score") >= F.lit(least))).alias("kept")


def judge(docs: DataFrame, model: tuple[list[float], float], *, text_col: str = "text", min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """``docs`` with the counts, base_failed, score and kept (replacing columns of these names)."""
    weights, least = model
    return measured(docs, weights, text_col=text_col, min_words=min_words, max_repeat=max_repeat).select("*", _kept(least))


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, keep: float = KEEP, margin: float = MARGIN, **limits: int) -> DataFrame:
    """What ``judge`` gives by the model of ``fit`` on the same ``docs``, without the text: each text is scored once, and the threshold read from the stored scores."""
    model = log_ratios(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, buckets=buckets)
    scored = stored(measured(docs, model or [0.0] * buckets, text_col=text_col, **limits).drop(text_col), "quality")
    least = -math.inf
    if model:
        good = scored.select(F.col(f"`{id_col}`").alias("id"), F.col("score").alias("s")).join(good_ids(labels, id_col, label_col), "id")
        least = threshold(stored(good.select("s"), "quality"), keep, margin)
    return scored.select("*", _kept(least))


def op9_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
