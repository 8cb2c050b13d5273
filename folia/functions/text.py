"""Text functions: Column in, Column out; Arrow UDFs only where Spark has no such function."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.core import let

# Tags, marks and patterns that define the normalisations.
HTML_EMPHASIS = r"(?i)</?(?:b|i|u|s|em|strong|del|ins|mark|sub|sup)\s*>"
MD_EMPHASIS = r"\*\*|__|\*|`+"
FENCE_LINE = r"(?m)^[ \t]*(?:`{3,}|~{3,})[^\n]*$"
ANY_TAG = r"<[^<>]*>"
LATEX = r"\\(?:[a-zA-Z]+\*?|[^a-zA-Z\s])"
NUMBER = r"[-+]?[$]?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?%?"
PIPE_ROW = r"(?m)^\s*\|.*\|\s*$"
EMPHASIS_RUN = r"[*_~`]+"
BEST_RATIO = r"best match ratio was ([\d.]+)"
THRESHOLD = r"with threshold ([\d.]+)"
VALUE = r"[0-9][0-9,.\-$%()]*|[A-Z]{2,}[0-9A-Z\-]*"
REFUSAL = r"(?i)^\s*(i'?m sorry|i am sorry|i cannot|i can'?t|sorry,|as an ai)"
#: Han, kana, hangul
CJK = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\uac00-\ud7af]"
CJK_WEIGHT = 2.5


def norm_simple(t: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def _nfkc(t: pd.Series) -> pd.Series:
    return t.map(lambda s: None if s is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s)).strip().lower())


def light_norm(t: Column) -> Column:
    t = F.regexp_replace(F.coalesce(t, F.lit("")), HTML_EMPHASIS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, MD_EMPHASIS, ""), r"\s+", " "))


def norm_nfkc(t: Column) -> Column:
    """NFKC, white space collapsed and trimmed, lower case; null stays null."""
    return F.pandas_udf(_nfkc, "string")(t)


def _content(t: pd.Series) -> pd.Series:
    return t.map(lambda s: re.sub(r"[\W_]+", "", re.sub(LATEX, " ", unicodedata.normalize("NFKC", html.unescape(s))).casefold()))


def content_norm(t: Column) -> Column:
    """Fence lines and tags go, entities and compatibility forms resolve, commands go, case folds, letters and digits stay."""
    return F.pandas_udf(_content, "string")(F.regexp_replace(F.regexp_replace(F.coalesce(t, F.lit("")), FENCE_LINE, " "), ANY_TAG, " "))


def effective_length(t: Column) -> Column:
    """Code points, CJK ones counted 2.5."""
    return F.length(t) + (CJK_WEIGHT - 1) * F.regexp_count(t, F.lit(CJK))


def char_shingles(t: Column, k: int = 12) -> Column:
    """Distinct windows of k code points; the whole text if it is shorter; none of an empty one."""
    return F.array_distinct(char_windows(t, k))


def char_windows(t: Column, k: int = 12) -> Column:
    """``char_shingles`` with repeats."""
    # by blocks: finding a place in a text takes time in proportion to it
    inner = lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - (k - 1)), lambda i: F.substring(b, i, F.lit(k)))
    blocks = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - (k - 1), F.lit(128)), lambda i: F.substring(x, i, F.lit(128 + k - 1)))
    windows = lambda x: F.flatten(F.transform(blocks(x), inner))
    return let(t, lambda x: F.when(F.length(x) >= k, windows(x)).when(F.length(x) > 0, F.array(x)).otherwise(F.array().cast("array<string>")))


def char_shingle_hashes(t: Column, k: int = 12) -> Column:
    return F.array_distinct(F.transform(char_shingles(t, k), lambda s: F.crc32(s.cast("binary"))))


def word_shingles(t: Column, k: int = 8) -> Column:
    """Distinct windows of k words, at least one."""
    return let(F.split(t, " "), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))))


def word_shingle_hashes(t: Column, k: int = 8) -> Column:
    """64-bit hashes of ``word_shingles``, from words and never joined."""
    return let(F.split(t, " "), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)))))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def edit_sim(a: Column, b: Column) -> Column:
    return similarity(light_norm(a), light_norm(b))


def content_sim(a: Column, b: Column) -> Column:
    return similarity(content_norm(a), content_norm(b))


def partial_ratio_value(needle: str, hay: str) -> float:
    """Best similarity 0-100 (twice the common subsequence over both lengths) of the shorter text with any window of its length in the longer."""
    short, long = sorted((needle, hay), key=len)
    if not short:
        return 0.0
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    bits = {c: sum(1 << i for i, x in enumerate(short) if x == c) for c in set(short)}
    full = (1 << n) - 1
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        row = full
        for c in window:
            u = row & bits.get(c, 0)
            row = ((row + u) | (row - u)) & full
        best = max(best, 200.0 * (n - row.bit_count()) / (n + len(window)))
    return best


def _partial_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else partial_ratio_value(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def partial_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_partial_ratios, "double")(a, b)


def _units(t: Column, n: int) -> tuple[Column, Column]:
    w = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    chars = F.filter(F.split(t, ""), lambda x: x != "")
    by_chars = (F.size(w) < 4 * n) & (F.length(t) >= 4 * n)
    return F.when(by_chars, chars).otherwise(w), F.when(by_chars, F.lit(3 * n)).otherwise(F.lit(n))


def repetition(t: Column, n: int = 10) -> Column:
    """(share of repeated n-grams, share of the most frequent one) of words; of characters, three times as long, where there are few words."""
    units, k = _units(t, n)

    def shares(u: Column) -> Column:
        total = F.size(u["u"]) - u["k"] + 1
        grams = F.array_sort(F.transform(F.sequence(F.lit(1), total), lambda i: F.array_join(F.slice(u["u"], i, u["k"]), "\u0001")))
        start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("distinct"), F.lit(0).alias("most"))

        def step(a: Column, g: Column) -> Column:
            same = g.eqNullSafe(a["last"])
            run = F.when(same, a["run"] + 1).otherwise(F.lit(1))
            return F.struct(g.alias("last"), run.alias("run"), (a["distinct"] + F.when(same, 0).otherwise(1)).alias("distinct"), F.greatest(a["most"], run).alias("most"))

        seen = F.aggregate(grams, start, step, lambda a: F.struct((1.0 - a["distinct"] / total).alias("repeated"), (a["most"] / total).alias("top")))
        return F.when(total >= 1, seen).otherwise(F.struct(F.lit(0.0).alias("repeated"), F.lit(0.0).alias("top")))

    return F.get(F.transform(F.array(F.struct(units.alias("u"), k.alias("k"))), shares), 0)


def has_table(t: Column) -> Column:
    return F.contains(F.lower(t), F.lit("<table")) | F.rlike(t, F.lit(PIPE_ROW))


def strip_emphasis(t: Column) -> Column:
    return F.regexp_replace(t, EMPHASIS_RUN, "")


def emphasis_rate(t: Column) -> Column:
    """Runs of emphasis marks per 1,000 characters."""
    return F.when(F.length(t) > 0, 1000.0 * F.regexp_count(t, F.lit(EMPHASIS_RUN)) / F.length(t)).otherwise(F.lit(0.0))


def scorer_ratio(reason: Column) -> tuple[Column, Column]:
    """(threshold, best ratio) from a scorer's reason; null unless both are there."""
    a = F.nullif(F.regexp_extract(reason, THRESHOLD, 1), F.lit("")).try_cast("double")
    b = F.nullif(F.regexp_extract(reason, BEST_RATIO, 1), F.lit("")).try_cast("double")
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def strip_fence(t: Column) -> Column:
    """A fence around the whole text (plain, markdown or md) goes; one that lost its end goes only with a tag."""
    s = F.regexp_replace(t, r"^\s+|\s+$", "")
    tag = F.lower(F.trim(F.regexp_extract(s, r"^```([^\n]*)\n", 1)))
    body = F.regexp_replace(s, r"^```[^\n]*\n", "")
    open_ = F.rlike(s, F.lit(r"^```[^\n]*\n")) & tag.isin("", "markdown", "md")
    shut = F.rlike(body, F.lit(r"```$"))
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(open_ & shut, trimmed(F.regexp_replace(body, r"```$", ""))).when(open_ & (tag != ""), trimmed(body)).otherwise(s)


def numbers_in(t: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, "[$%, ]", "").try_cast("double")), lambda x: x.isNotNull())


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-6 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def pipe_cells(line: Column) -> Column:
    """Cells of a pipe row."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def strip_tags(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " "))


def md_inline(t: Column) -> Column:
    """Inline HTML as Markdown: links, strong, emphasis, code, breaks, the five usual entities; other tags go."""
    t = F.regexp_replace(t, r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    t = F.regexp_replace(t, r"(?i)</?(?:b|strong)>", "**")
    t = F.regexp_replace(t, r"(?i)</?(?:i|em)>", "*")
    t = F.regexp_replace(t, r"(?i)</?code>", "`")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def sentences(t: Column) -> Column:
    """Pieces behind sentence ends, of 12 characters or more, with a letter."""
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: (F.length(s) >= 12) & F.rlike(s, F.lit("[A-Za-z]")))


def plain_words(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(r"[a-z][a-z'-]*[a-z]|[a-z]"), F.lit(0))


def value_tokens(t: Column) -> Column:
    """Numeric and code tokens of two characters or more."""
    return F.filter(F.regexp_extract_all(t, F.lit(VALUE), F.lit(0)), lambda x: F.length(x) > 1)


def clip(t: Column, head: int = 900, tail: int = 300, mark: str = " [...] ") -> Column:
    return F.when(F.length(t) <= head + tail, t).otherwise(F.concat(F.left(t, F.lit(head)), F.lit(mark), F.right(t, F.lit(tail))))


def clean_label(name: Column) -> Column:
    """A form field's name as a label: last path part without index, separators and camel case opened, trailing digits and filler words dropped, first letter upper."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*\.", ""), r"\[\d+\]", ""), r"[#_]+", " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, "(?<=[a-z])(?=[A-Z])", " "), r"\d+$", ""))
    words = F.filter(F.split(x, r"\s+"), lambda w: ~F.lower(w).isin("subform", "form", "field", "topmostsubform"))
    x = F.trim(F.array_join(words, " "))
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 100000))
