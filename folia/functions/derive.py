"""Derived attributes of pages, tables, charts, boxes and identifiers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folia.functions.core import let

# Fixed values.
SIZE_EDGES = (0, 6, 7.5, 9, 10.5, 12, 14)
MIN_CHARS, MIN_TEXT_AREA = 120, 0.02
ELIGIBLE_KINDS = ("digital",)
SKIP_ARCHETYPES = ("scanned", "empty", "error", "sparse")
TABLE_HARD_RC, TABLE_HARD_EMPTY, TABLE_HARD_SPAN, TABLE_HARD_HEADER, TABLE_MEDIUM_EMPTY = 10, 0.2, 4, 2, 0.05
WEIRD_FAMILIES = ("snaking", "mirrored", "line_printer", "continuation_fragment")
SCRIPTS = {
    "han": "一-鿿㐀-䶿豈-﫿",
    "kana": "぀-ヿㇰ-ㇿ",
    "hangul": "가-힯ᄀ-ᇿ",
    "arabic": "؀-ۿݐ-ݿ",
    "hebrew": "֐-׿",
    "cyrillic": "Ѐ-ӿ",
    "devanagari": "ऀ-ॿ",
    "thai": "฀-๿",
    "greek": "Ͱ-Ͽ",
    "latin_ext": "À-ɏ",
}
FAILURE_NEEDLES = (
    ("No tables found", "table_dropped"),
    ("No cell matching", "table_cell_missing"),
    ("but relationships were not satisfied", "table_structure"),
    ("Expected absence of", "absent_violation"),
    ("not found with max_l_dist", "order_anchor_missing"),
    ("Could not find a location where", "order_anchor_missing"),
    ("No match found for", "math_not_found"),
    ("Text contains disallowed characters", "disallowed_characters"),
    ("repeating", "repetition"),
)
LEVELS = ("easy", "medium", "hard")


def size_bucket(pt: Column) -> Column:
    """Number of size edges at or below a font size."""
    return sum((F.when(pt >= e, 1).otherwise(0) for e in SIZE_EDGES), F.lit(0)).cast("int")


def coarse_signature(w: Column, h: Column, p50: Column, cols: Column, rules: Column, image: Column, density: Column) -> Column:
    whole = lambda x: F.floor(x).cast("bigint").cast("string")
    flag = lambda c: F.when(c, "1").otherwise("0")
    text = F.concat(whole(w / 16), F.lit("x"), whole(h / 16), F.lit("|b"), size_bucket(p50).cast("string"), F.lit("|c"), F.greatest(cols, F.lit(1)).cast("string"), F.lit("|r"), F.least(F.lit(3), F.floor(rules / 12)).cast("string"), F.lit("|i"), flag(image > 0.05), F.lit("|d"), F.least(F.lit(4), F.floor(density * 10)).cast("string"))
    return F.substring(F.sha1(text), 1, 12)


def exact_signature(w: Column, h: Column, left: Column, top: Column, p50: Column, cols: Column, rules: Column, image: Column, fonts: Column) -> Column:
    n = lambda x: x.cast("bigint").cast("string")
    text = F.concat_ws("|", F.concat(n(F.floor(w / 8)), F.lit("x"), n(F.floor(h / 8))), F.concat(n(F.bround(left * 20, 0)), F.lit(","), n(F.bround(top * 20, 0))), n(F.bround(p50, 0)), F.concat(F.lit("c"), cols.cast("string")), F.concat(F.lit("r"), F.when(rules > 12, "1").otherwise("0")), F.concat(F.lit("i"), F.when(image > 0.05, "1").otherwise("0")), F.array_join(F.array_sort(F.slice(fonts, 1, 4)), ","))
    return F.substring(F.sha1(text), 1, 16)


def archetype(kind: Column, image: Column, rules: Column, area: Column, cols: Column, chars: Column) -> Column:
    return (
        F.when(kind.isin("empty", "error"), kind)
        .when(kind == "scanned", "scanned")
        .when(kind == "sparse", F.when(image > 0.2, "cover").otherwise("sparse"))
        .when((rules >= 24) & (area > 0.08), "table_heavy")
        .when(rules >= 12, "table_light")
        .when(image > 0.35, "figure_heavy")
        .when(cols >= 2, "multi_column")
        .when((chars >= 2500) | (area > 0.42), "dense_text")
        .otherwise("prose")
    )


def page_kind(chars: Column, images: Column) -> Column:
    """From non-space characters and images."""
    return F.when(chars >= 40, "digital").when(chars > 0, "sparse").when(images > 0, "scanned").otherwise("empty")


def eligible(kind: Column, arch: Column, chars: Column, area: Column, w: Column, h: Column) -> Column:
    return reject_reason(kind, arch, chars, area, w, h).isNull()


def reject_reason(kind: Column, arch: Column, chars: Column, area: Column, w: Column, h: Column) -> Column:
    """The first gate a page fails; null for eligible pages."""
    return F.when(~kind.isin(*ELIGIBLE_KINDS), "kind").when(arch.isin(*SKIP_ARCHETYPES), "archetype").when(chars < MIN_CHARS, "too_short").when((area < MIN_TEXT_AREA) | (w <= 0) | (h <= 0), "too_empty")


def script_counts(t: Column) -> Column:
    """map(script, characters) of a text; ``ascii`` and ``other`` (neither space) included."""
    pairs = [F.lit("ascii"), F.regexp_count(t, F.lit(r"[!-~]")).cast("bigint")]
    for name, chars in SCRIPTS.items():
        pairs += [F.lit(name), F.regexp_count(t, F.lit(f"[{chars}]")).cast("bigint")]
    return F.create_map(*pairs)


def dominant_script(counts: Column, floor: float = 0.1) -> Column:
    """latin if ASCII holds more than 85 %; else the largest other script with ``floor`` of all or more, else latin; null without characters. Ties: the first name."""

    def pick(m: Column) -> Column:
        total = F.aggregate(F.map_values(m), F.lit(0).cast("bigint"), lambda a, x: a + x)
        rest = F.filter(F.map_entries(m), lambda e: (e["key"] != "ascii") & (e["value"] > 0))
        top = F.get(F.array_sort(rest, lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1)).when(a["key"] < b["key"], -1).otherwise(1)), 0)
        return F.when(total == 0, F.lit(None).cast("string")).when(F.element_at(m, "ascii") > 0.85 * total, "latin").when(top["value"] >= floor * total, top["key"]).otherwise("latin")

    return let(counts, pick)


def base_font(name: Column) -> Column:
    """A font's name without its subset tag."""
    return F.when(F.length(name) > 7, F.regexp_replace(name, r"^[A-Z]{6}\+", "")).otherwise(name)


def estimated_columns(spans: Column, bins: int = 48) -> Column:
    """Text columns from line extents (array of struct<x0, x1> in 0..1): runs of covered bins, gaps under two bins closed, 1 to 6; 1 under eight lines."""
    on = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.exists(spans, lambda s: (F.floor(s["x0"] * bins) <= b) & (F.ceil(s["x1"] * bins) > b)))
    start = F.struct(F.lit(0).alias("runs"), F.lit(99).alias("gap"))
    runs = F.aggregate(on, start, lambda a, x: F.when(x, F.struct((a["runs"] + F.when(a["gap"] >= 2, 1).otherwise(0)).alias("runs"), F.lit(0).alias("gap"))).otherwise(F.struct(a["runs"].alias("runs"), (a["gap"] + 1).alias("gap"))), lambda a: a["runs"])
    return F.when(F.size(spans) < 8, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(6), runs)))


def doc_id(image_id: Column) -> Column:
    """An image's document: severity, page and shard suffixes cut, in this order."""
    for suffix in (r"__sev\d+b?$", r"__p\d+$", r"_s\d+$"):
        image_id = F.regexp_replace(image_id, suffix, "")
    return image_id


def severity(x: Column) -> tuple[Column, Column]:
    """(key, level) of a severity such as null, 2, 2.0 or 2b; raises for anything else."""
    s = F.coalesce(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("0"))
    ok = F.rlike(s, F.lit(r"^\d+b?$"))
    key = F.when(ok, s).otherwise(F.raise_error(F.concat(F.lit("severity: "), s)).cast("string"))
    return key, F.regexp_extract(key, r"^(\d+)", 1).cast("int")


def meta_filter(meta: Column, key: str, op: str, value: str) -> Column:
    """Whether ``meta[key] op value``: as numbers if both are, else as text; a missing key fails every operator."""
    ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    x, want = F.get(F.filter(F.array(F.element_at(meta, key)), lambda v: v.isNotNull()), 0), F.lit(value)
    a, b = x.try_cast("double"), want.try_cast("double")
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), ops[op](a, b)).otherwise(ops[op](x, want)), F.lit(False))


def parse_meta_filter(text: str) -> tuple[str, str, str]:
    parts = text.split()
    if len(parts) != 3 or parts[1] not in ("==", "!=", ">", "<", ">=", "<="):
        raise ValueError(f"not KEY OP VALUE: {text!r}")
    return parts[0], parts[1], parts[2]


def table_level(rows: Column, cols: Column, empty: Column, span: Column, depth: Column, merged: Column, family: Column) -> Column:
    weird = F.lit(False)
    for token in WEIRD_FAMILIES:
        weird = weird | F.contains(F.regexp_replace(F.lower(family), "[- ]", "_"), F.lit(token))
    hard = (F.greatest(rows, cols) >= TABLE_HARD_RC) | (empty >= TABLE_HARD_EMPTY) | (span >= TABLE_HARD_SPAN) | (depth >= TABLE_HARD_HEADER) | weird
    return F.when(hard, "hard").when(merged | (empty >= TABLE_MEDIUM_EMPTY), "medium").otherwise("easy")


def chart_level(series: Column, dual: Column, hard_type: Column, stacked: Column, medium_type: Column) -> Column:
    return F.when((series >= 4) | dual | hard_type, "hard").when((series >= 2) | stacked | medium_type, "medium").otherwise("easy")


def box_level(n: Column) -> Column:
    return F.when(n <= 4, "easy").when(n <= 8, "medium").otherwise("hard")


def text_level(equations: Column, depth: Column, styled: Column, heavy: Column, median_pt: Column, hard_equations: int = 4, hard_depth: int = 2, hard_pt: float = 7.0) -> Column:
    return F.when((equations >= hard_equations) | (depth >= hard_depth) | heavy | F.coalesce(median_pt < hard_pt, F.lit(False)), "hard").when((equations >= 1) | styled, "medium").otherwise("easy")


def rank_of(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def safe_id(x: Column) -> Column:
    return F.regexp_replace(x, r"[/\\]", "__")


def arm_parts(name: Column) -> dict[str, Column]:
    """Parts of ``<site>_<readout>@<budget>__<variant>``; null where the name has another form."""
    pattern = r"^([^_@]+)_([^@]+)@(\d+)__(.+)$"
    ok = F.rlike(name, F.lit(pattern))
    part = lambda k: F.when(ok, F.regexp_extract(name, pattern, k))
    return {"site": part(1), "readout": part(2), "budget": part(3).cast("int"), "variant": part(4)}


def arm_label(tower: Column, budget: Column, site: Column, readout: Column, coords: Column) -> Column:
    return F.concat(tower, F.lit("@"), budget.cast("string"), F.lit("#"), site, F.lit("/"), readout, F.when(coords == "add", "+coords").when(coords == "only", "coordsonly").otherwise(""))


def grounding_bucket(box: Column, page_ok: Column, iou: Column) -> Column:
    return F.when(~box, "no-box").when(~page_ok, "wrong-page").when(iou >= 0.5, "grounded").when(iou == 0, "displaced").otherwise("partial")


def geometry_tags(rw: Column, rh: Column, dx: Column, dy: Column) -> Column:
    """Tags of a predicted box against the true one: width and height ratio, shift in box sizes."""
    width = F.when(rw > 6, "FULL-ROW-BAND").when(rw > 3, "wide").when(rw < 0.4, "narrow")
    height = F.when(rh > 1.6, "tall").when((rh > 0.4) & (rh < 0.6), "HALF-HEIGHT").when(rh < 0.7, "short")
    return F.concat_ws(",", width, height, F.when(F.abs(dx) > 0.5, "dx"), F.when(F.abs(dy) > 0.5, "dy"))


def text_shape(t: Column) -> Column:
    return F.when(F.contains(t, F.lit("<br/>")), "br-blob").when(F.startswith(F.ltrim(t), F.lit("|")), "md-row").otherwise("prose")


def failure_kind(reason: Column, pred: Column, repeated: Column, at_cap: Column) -> Column:
    from folia.functions.text import BEST_RATIO, REFUSAL

    r = F.coalesce(reason, F.lit(""))
    ratio = F.nullif(F.regexp_extract(r, BEST_RATIO, 1), F.lit("")).try_cast("double")
    out = F.when(F.trim(pred) == "", "empty_output").when(repeated >= 0.10, "repetition").when(at_cap, "truncated_at_cap").when(F.rlike(pred, F.lit(REFUSAL)), "refusal").when(ratio.isNotNull(), F.when(ratio >= 0.60, "text_partial").otherwise("text_not_found"))
    for needle, kind in FAILURE_NEEDLES:
        out = out.when(F.contains(r, F.lit(needle)), kind)
    return out.otherwise("other")


def canonical_class(tag: Column, css: Column) -> Column:
    """Layout class of an HTML element by tag, then by words of its class attribute."""
    c = F.lower(css)
    has = lambda w: F.contains(c, F.lit(w))
    return (
        F.when(tag.isin("h1", "h2", "h3", "h4"), "heading").when(tag == "table", "table").when(tag.isin("ul", "ol"), "list").when(tag.isin("img", "svg", "figure"), "picture").when(has("caption"), "caption").when(has("footnote"), "footnote")
        .when(has("header"), "page-header").when(has("footer"), "page-footer").when(has("formula") | has("equation"), "formula").when(has("title"), "title").when(tag == "p", "text").otherwise("other")
    )


def budget_knob(encoder: Column, budget: Column, pixels_per_token: int = 784) -> Column:
    """Knob setting that gives an encoder a token budget; null where none does."""
    base = F.create_map(*[F.lit(x) for x in (64, 512, 100, 640, 256, 1024, 400, 1280)])
    text = lambda x: x.cast("string")
    return F.when(budget <= 0, F.lit(None).cast("string")).when(encoder == "siglip2_naflex", F.concat(F.lit("max_num_patches="), text(budget))).when(encoder.isin("qwen35_vit", "qwen3_vl_vit"), F.concat(F.lit("max_pixels="), text(budget * pixels_per_token))).when((encoder == "deepseek_ocr") & F.array_contains(F.map_keys(base), budget), F.concat(F.lit("base_size="), text(F.element_at(base, budget))))


def target_grid(h: Column, w: Column, budget: Column) -> Column:
    """struct(th, tw): the largest grid within a token budget, shaped like h x w; null above the native size."""
    side = F.floor(F.sqrt(budget.cast("double"))).cast("int")
    scale = F.sqrt(budget / (h * w))
    th, tw = (F.greatest(F.lit(1), F.floor(x * scale + 1e-9).cast("int")) for x in (h, w))
    trim = lambda p: F.when(p["th"] * p["tw"] <= budget, p).when(p["th"] >= p["tw"], F.struct((p["th"] - 1).alias("th"), p["tw"].alias("tw"))).otherwise(F.struct(p["th"].alias("th"), (p["tw"] - 1).alias("tw")))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.struct(th.alias("th"), tw.alias("tw")), lambda a, _: trim(a))
    return F.when(budget > h * w, None).when(budget == h * w, F.struct(h.alias("th"), w.alias("tw"))).when((h == w) & (side * side == budget), F.struct(side.alias("th"), side.alias("tw"))).otherwise(fitted)


def hash_fraction(key: Column, seed: int = 0) -> Column:
    """First 64 bits of sha1("seed:key") as a fraction of 2**64."""
    digest = F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def is_train(key: Column, fraction: float = 0.8, seed: int = 0) -> Column:
    return hash_fraction(key, seed) < fraction


def md5_mod(key: Column, parts: int = 5) -> Column:
    """The 128-bit md5 of a key modulo a small number, folded 16 bits at a time."""
    h = F.md5(key.cast("string").cast("binary"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(29), F.lit(4)), F.lit(0).cast("bigint"), lambda a, i: (a * 65536 + F.conv(F.substring(h, i, F.lit(4)), 16, 10).cast("bigint")) % parts)


def _blake(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big", signed=True))


def blake_seed(key: Column) -> Column:
    """64-bit seed of a key (blake2b, as a signed number)."""
    return F.pandas_udf(_blake, "bigint")(key)


def scramble_seed(base: Column, i: Column) -> Column:
    """(base xor (i + 1) * 2654435761) in 32 bits, unsigned."""
    mask = (1 << 32) - 1
    return base.cast("bigint").bitwiseXOR(((i.cast("bigint") + 1) * 2654435761).bitwiseAND(mask)).bitwiseAND(mask)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
