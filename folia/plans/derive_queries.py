"""Queries of derived columns, filters and predicates."""

from __future__ import annotations

from folia.functions import derive as D
from folia.plans.base import F, col_query, literal_query, table
from folia.sources.literal import Literal

C = F.col

PAGES = Literal(
    "id bigint, sha string, page bigint, kind string, n_chars bigint, width double, height double, p50 double, area double, image double, rules bigint, columns bigint, mleft double, mtop double, fonts array<string>",
    [
        (1, "a", 1, "digital", 2600, 612.0, 792.0, 10.0, 0.45, 0.0, 0, 1, 0.1, 0.08, ["Arial", "Times"]),
        (2, "a", 2, "digital", 800, 612.0, 792.0, 10.0, 0.30, 0.4, 2, 1, 0.1, 0.08, ["Times", "Arial", "Code", "Mono", "Zed"]),
        (3, "a", 3, "scanned", 0, 612.0, 792.0, 0.0, 0.0, 0.95, 0, 0, 0.0, 0.0, []),
        (4, "b", 1, "sparse", 20, 595.0, 842.0, 20.0, 0.01, 0.3, 0, 1, 0.2, 0.2, ["Big"]),
        (5, "b", 2, "digital", 1500, 595.0, 842.0, 8.5, 0.20, 0.0, 30, 3, 0.05, 0.05, ["Arial"]),
        (6, "b", 3, "digital", 1500, 595.0, 842.0, 8.5, 0.05, 0.0, 14, 3, 0.05, 0.05, ["Arial"]),
        (7, "c", 1, "digital", 1000, 595.0, 842.0, 12.0, 0.25, 0.06, 0, 2, 0.12, 0.1, ["Helv"]),
        (8, "c", 2, "digital", 10, 595.0, 842.0, 12.0, 0.25, 0.0, 0, 1, 0.12, 0.1, ["Helv"]),
        (9, "c", 3, "digital", 500, 0.0, 0.0, 12.0, 0.25, 0.0, 0, 1, 0.12, 0.1, ["Helv"]),
        (10, "d", 1, "empty", 0, 595.0, 842.0, 0.0, 0.0, 0.0, 0, 0, 0.0, 0.0, []),
        (11, "d", 2, "sparse", 12, 595.0, 842.0, 9.0, 0.01, 0.0, 0, 1, 0.1, 0.1, ["Helv"]),
        (12, "e", 1, "digital", 700, 612.0, 792.0, 10.0, 0.30, 0.0, 2, 1, 0.1, 0.08, ["Arial", "Times"]),
    ],
).over("orders", "o_orderkey + 1000; 's' || CAST(floor(o_orderkey / 5) AS BIGINT); o_orderkey % 5; CASE o_orderstatus WHEN 'O' THEN 'digital' WHEN 'F' THEN 'scanned' ELSE 'sparse' END; o_custkey * 10; 612; 792; (o_custkey % 40) / 4; (o_custkey % 10) / 20; (o_custkey % 7) / 10; o_custkey % 20; o_orderkey % 4; (o_custkey % 8) / 64; (o_custkey % 16) / 128; split(CASE WHEN o_orderkey % 3 = 0 THEN 'Arial,Times' ELSE 'Times,Code,Arial' END, ',')")
def arch():
    return D.archetype(C("kind"), C("image"), C("rules"), C("area"), C("columns"), C("n_chars"))


def coarse():
    return D.coarse_signature(C("width"), C("height"), C("p50"), C("columns"), C("rules"), C("image"), C("area"))


def exact():
    return D.exact_signature(C("width"), C("height"), C("mleft"), C("mtop"), C("p50"), C("columns"), C("rules"), C("image"), C("fonts"))


BUCKET_SQL = "(CASE WHEN p50 >= 0 THEN 1 ELSE 0 END + CASE WHEN p50 >= 6 THEN 1 ELSE 0 END + CASE WHEN p50 >= 7.5 THEN 1 ELSE 0 END + CASE WHEN p50 >= 9 THEN 1 ELSE 0 END + CASE WHEN p50 >= 10.5 THEN 1 ELSE 0 END + CASE WHEN p50 >= 12 THEN 1 ELSE 0 END + CASE WHEN p50 >= 14 THEN 1 ELSE 0 END)"
ARCH_SQL = "CASE WHEN kind IN ('empty', 'error') THEN kind WHEN kind = 'scanned' THEN 'scanned' WHEN kind = 'sparse' THEN CASE WHEN image > 0.2 THEN 'cover' ELSE 'sparse' END WHEN rules >= 24 AND area > 0.08 THEN 'table_heavy' WHEN rules >= 12 THEN 'table_light' WHEN image > 0.35 THEN 'figure_heavy' WHEN columns >= 2 THEN 'multi_column' WHEN n_chars >= 2500 OR area > 0.42 THEN 'dense_text' ELSE 'prose' END"
COARSE_SQL = f"substr(sha1(CAST(floor(width / 16) AS BIGINT) || 'x' || CAST(floor(height / 16) AS BIGINT) || '|b' || {BUCKET_SQL} || '|c' || greatest(columns, 1) || '|r' || least(3, CAST(floor(rules / 12) AS BIGINT)) || '|i' || CASE WHEN image > 0.05 THEN '1' ELSE '0' END || '|d' || least(4, CAST(floor(area * 10) AS BIGINT))), 1, 12)"
REJECT_SQL = f"CASE WHEN kind NOT IN ('digital') THEN 'kind' WHEN {ARCH_SQL} IN ('scanned', 'empty', 'error', 'sparse') THEN 'archetype' WHEN n_chars < 120 THEN 'too_short' WHEN area < 0.02 OR width <= 0 OR height <= 0 THEN 'too_empty' END"
def reject():
    return D.reject_reason(C("kind"), arch(), C("n_chars"), C("area"), C("width"), C("height"))



SCRIPT_TEXTS = Literal("id bigint, t string", [(1, "plain ascii text"), (2, "日本語のテキスト mixed"), (3, "Привет, мир"), (4, ""), (5, "ascii mostly é"), (6, "ελληνικά και abc"), (7, "한국어 문장 테스트"), (8, "aaaa éé éé éé ãã")]).over("documents", "doc_id + 1000; text")
IDS = Literal("id bigint, image string", [(1, "charts/doc1__p3_s12__sev2"), (2, "text/doc3__sev4b"), (3, "doc_s1"), (4, "a\\b/c__p10"), (5, "plain")]).over("part", "p_partkey + 1000; 'docs/' || p_name || '__p' || p_size || '_s' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '__sev2b' ELSE '' END")
SEVERITIES = Literal("id bigint, x string", [(1, None), (2, "2"), (3, "3.0"), (4, "2b"), (5, "0")]).over("part", "p_partkey + 1000; (p_size % 5) || CASE p_partkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN '' ELSE '.0' END")
FONTS = Literal("id bigint, font string", [(1, "ABCDEF+Arial"), (2, "Arial"), (3, "ABCDE+Short"), (4, "abcdef+Lower"), (5, "ABCDEF+")]).over("part", "p_partkey + 1000; CASE WHEN p_partkey % 2 = 0 THEN 'ABCDEF+' ELSE '' END || p_brand")
TABLES = Literal("id bigint, r bigint, c bigint, empty double, span bigint, depth bigint, merged boolean, family string", [(1, 4, 3, 0.0, 1, 1, False, "plain"), (2, 12, 3, 0.0, 1, 1, False, "plain"), (3, 4, 3, 0.3, 1, 1, False, "x"), (4, 4, 3, 0.1, 1, 1, False, "x"), (5, 4, 3, 0.0, 2, 1, True, "x"), (6, 4, 3, 0.0, 5, 1, True, "x"), (7, 4, 3, 0.0, 1, 2, False, "x"), (8, 4, 3, 0.0, 1, 1, False, "Line-Printer 3")]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_quantity; l_linenumber; l_discount * 5; 1 + l_partkey % 3; 1 + l_suppkey % 3; l_returnflag = 'R'; 'plain'")
CHARTS = Literal("id bigint, series bigint, dual boolean, hard boolean, stacked boolean, medium boolean", [(1, 1, False, False, False, False), (2, 2, False, False, False, False), (3, 5, False, False, False, False), (4, 1, True, False, False, False), (5, 1, False, False, True, False), (6, 1, False, True, False, False), (7, 1, False, False, False, True)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_linenumber; l_returnflag = 'R'; l_returnflag = 'A'; l_linestatus = 'O'; l_tax > 0.04")
TEXTS = Literal("id bigint, eq bigint, depth bigint, styled boolean, heavy boolean, pt double", [(1, 0, 0, False, False, 10.0), (2, 2, 0, False, False, None), (3, 5, 0, False, False, 10.0), (4, 0, 3, False, False, 10.0), (5, 0, 0, True, False, 10.0), (6, 0, 0, False, True, 10.0), (7, 0, 0, False, False, 6.5)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_linenumber; l_partkey % 4; l_returnflag = 'R'; l_returnflag = 'A'; CASE WHEN l_linestatus = 'O' THEN l_quantity END")
OBJECTS = Literal("page bigint, family string, level string", [(1, "table", "easy"), (1, "table", "hard"), (1, "chart", "easy"), (2, "text", "medium"), (2, "chart", "easy"), (3, "layout", "easy")]).over("lineitem", "l_orderkey + 1000; CASE l_linenumber % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'chart' WHEN 2 THEN 'text' ELSE 'layout' END; CASE l_partkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END")
SPANS = Literal("id bigint, x0 array<double>, x1 array<double>", [(1, [0.1] * 9, [0.9] * 9), (2, [0.05, 0.55] * 5, [0.45, 0.95] * 5), (3, [0.1, 0.5], [0.3, 0.9]), (4, [0.02, 0.36, 0.70] * 4, [0.30, 0.64, 0.98] * 4)]).over("part", "p_partkey + 1000; split(CASE WHEN p_partkey % 2 = 0 THEN '0.1,0.1,0.1,0.1,0.1,0.1,0.1,0.1,0.1' ELSE '0.05,0.55,0.05,0.55,0.05,0.55,0.05,0.55,0.05,0.55' END, ','); split(CASE WHEN p_partkey % 2 = 0 THEN '0.9,0.9,0.9,0.9,0.9,0.9,0.9,0.9,0.9' ELSE '0.45,0.95,0.45,0.95,0.45,0.95,0.45,0.95,0.45,0.95' END, ',')")
CELLS = Literal("id bigint, x double, y double, w double, h double, corners array<double>, span bigint, span2 bigint", [(1, 0.1, 0.2, 0.3, 0.1, None, 2, None), (2, None, None, None, None, [0.1, 0.2, 0.4, 0.3], None, 3), (3, 0.0, 0.0, 0.5, 0.5, None, None, None)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_discount; l_tax; l_quantity / 64; 0.25; NULL; CASE WHEN l_linenumber > 2 THEN l_linenumber END; NULL")
BOXES = Literal("id bigint, coords string, keys array<string>, vals array<double>", [(1, "xywh", [], [1.0, 2.0, 3.0, 4.0]), (2, None, ["grid_rows"], [1.0, 2.0, 3.0, 4.0]), (3, None, ["n_rows"], [1.0, 2.0, 3.0, 4.0]), (4, None, [], [5.0, 5.0, 2.0, 3.0]), (5, None, [], [0.1, 0.1, 0.9, 0.9])]).over("part", "p_partkey + 1000; CASE WHEN p_partkey % 4 = 0 THEN 'xywh' END; split(CASE p_partkey % 3 WHEN 0 THEN 'grid_rows' WHEN 1 THEN 'n_rows' ELSE 'other' END, ','); split(p_size || ',' || (p_partkey % 9) || ',' || (p_partkey % 50) || ',' || (p_size + 3), ',')")
ARMS = Literal("id bigint, name string, tower string, budget bigint, site string, readout string, coords string", [(1, "S1_mean4@256__linear", "qwen", 256, "S1", "mean4", None), (2, "bad name", "clip", 64, "S2", "pool", "add"), (3, "S3_concat@1024__mlp_v2", "sam", 1024, "S3", "concat", "only")]).over("part", "p_partkey + 1000; 'S' || (p_partkey % 3 + 1) || '_mean4@' || p_size || '__linear'; p_brand; p_size; 'S1'; 'mean4'; CASE WHEN p_partkey % 2 = 0 THEN 'add' END")
LABELS = Literal("id bigint, explicit string, probe string, kind string", [(1, None, "pl2_extent", "array"), (2, None, "point_value", "float"), (3, "classification", "glyph_id", "string"), (4, None, "series_id", "int"), (5, "regression", "pl1", "string"), (6, None, "x", "dict")]).over("part", "p_partkey + 1000; NULL; 'pl' || (p_partkey % 4); CASE p_partkey % 4 WHEN 0 THEN 'array' WHEN 1 THEN 'float' WHEN 2 THEN 'string' ELSE 'int' END")
BOUND = Literal("id bigint, box boolean, page_ok boolean, iou double, rw double, rh double, dx double, dy double, t string", [(1, False, True, 0.0, 1.0, 1.0, 0.0, 0.0, "a"), (2, True, False, 0.9, 7.0, 1.0, 0.0, 0.0, "| a |"), (3, True, True, 0.6, 4.0, 2.0, 0.7, 0.0, "x<br/>y"), (4, True, True, 0.0, 0.3, 0.5, 0.0, -0.9, " |b"), (5, True, True, 0.2, 1.0, 0.65, 0.0, 0.0, "p")]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_linenumber > 1; l_linenumber > 2; l_discount * 10; l_quantity / 8; l_tax * 20; l_discount * 8; l_tax * 8; l_returnflag || ' | ' || l_linestatus")
FAILS = Literal("id bigint, reason string, pred string, rep double, cap boolean", [(1, "x", "  ", 0.9, True), (2, "x", "y", 0.5, True), (3, "x", "y", 0.0, True), (4, "x", "I'm sorry, no", 0.0, False), (5, "best match ratio was 0.7", "y", 0.0, False), (6, "best match ratio was 0.2", "y", 0.0, False), (7, "No tables found in page", "y", 0.0, False), (8, "odd", "y", 0.0, False), (9, None, "y", 0.0, False), (10, "is repeating", "y", 0.0, False)]).over("documents", "doc_id + 1000; CASE WHEN doc_id % 3 = 0 THEN 'best match ratio was 0.' || (doc_id % 10) ELSE 'x' END; CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE text END; (doc_id % 10) / 10; doc_id % 7 = 0")
ELEMENTS = Literal("id bigint, tag string, css string", [(1, "h2", ""), (2, "table", "x"), (3, "div", "Figure-Caption"), (4, "p", "body"), (5, "ul", ""), (6, "div", "page-header"), (7, "span", "equation"), (8, "div", "zzz"), (9, "figure", "")]).over("part", "p_partkey + 1000; CASE p_partkey % 5 WHEN 0 THEN 'div' WHEN 1 THEN 'p' WHEN 2 THEN 'table' WHEN 3 THEN 'h2' ELSE 'span' END; CASE WHEN p_partkey % 3 = 0 THEN 'Figure-Caption ' ELSE '' END || p_name")
ITEMS = Literal("image bigint, item bigint, class string, x double, y double, w double, h double", [(1, 0, "page", 0.0, 0.0, 1.0, 1.0), (1, 1, "table", 0.1, 0.1, 0.5, 0.5), (1, 2, "cell", 0.2, 0.2, 0.1, 0.1), (2, 0, "text", 0.0, 0.0, 0.4, 0.4), (2, 1, "dup", 0.0, 0.0, 0.4, 0.4)]).over("part", "CAST(floor(p_partkey / 2) AS BIGINT) + 1000; p_partkey % 2; CASE WHEN p_partkey % 3 = 0 THEN 'table' ELSE 'text' END; 0.125; p_size / 128; 0.5; 0.25")
POINTS = Literal("image bigint, point bigint, px double, py double", [(1, 1, 0.25, 0.25), (1, 2, 0.15, 0.5), (1, 3, 0.95, 0.95), (2, 1, 0.2, 0.2), (2, 2, 0.9, 0.9)]).over("part", "CAST(floor(p_partkey / 2) AS BIGINT) + 1000; p_partkey; 0.25; p_size / 100")
KNOBS = Literal("id bigint, encoder string, budget int", [(1, "siglip2_naflex", 256), (2, "qwen35_vit", 256), (3, "deepseek_ocr", 256), (4, "deepseek_ocr", 99), (5, "clip", 64), (6, "qwen3_vl_vit", 0)]).over("part", "p_partkey + 1000; CASE p_partkey % 3 WHEN 0 THEN 'clip' WHEN 1 THEN 'qwen35_vit' ELSE 'siglip2_naflex' END; p_size * 8")
GRIDS = Literal("id bigint, h int, w int, budget int", [(1, 24, 24, 144), (2, 24, 24, 576), (3, 24, 24, 1000), (4, 30, 20, 150), (5, 17, 11, 50), (6, 8, 8, 10), (7, 40, 3, 7)]).over("part", "p_partkey + 1000; p_size; p_size + p_partkey % 5; p_size * 5")
ROUNDS = Literal("id bigint, x double", [(1, 0.5), (2, 1.5), (3, 2.5), (4, -0.5), (5, 2.25), (6, 1234.565)]).over("orders", "o_orderkey + 1000; o_totalprice / 7")

_SCRIPT_SQL = "[{'k': 'ascii', 'v': length(regexp_replace(t, '[^!-~]', '', 'g'))}, " + ", ".join(f"{{'k': '{k}', 'v': length(regexp_replace(t, '[^{v}]', '', 'g'))}}" for k, v in D.SCRIPTS.items()) + "]"


def script_sql(floor: float) -> str:
    return f"""WITH {SCRIPT_TEXTS.cte('f')}, m AS (SELECT id, unnest({_SCRIPT_SQL}) AS e FROM f), s AS (SELECT id, sum(e.v) AS total, max(CASE WHEN e.k = 'ascii' THEN e.v END) AS ascii FROM m GROUP BY id),
      r AS (SELECT id, e.k AS k, e.v AS v, row_number() OVER (PARTITION BY id ORDER BY e.v DESC, e.k) AS n FROM m WHERE e.k <> 'ascii' AND e.v > 0)
      SELECT s.id, CASE WHEN total = 0 THEN NULL WHEN ascii > 0.85 * total THEN 'latin' WHEN v >= {floor} * total THEN k ELSE 'latin' END AS script FROM s LEFT JOIN r ON r.id = s.id AND r.n = 1"""


def _script(floor):
    return lambda s, d: SCRIPT_TEXTS.df(s, d).select("id", D.dominant_script(D.script_counts(C("t")), floor).alias("script"))


def _meta(s, d):
    e = table(s, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"), F.col("value").cast("string").alias("value"), "event_type").withColumn("m", F.map_concat(F.coalesce("m", F.create_map().cast("map<string,string>")), F.create_map(F.lit("value_"), C("value"), F.lit("type_"), C("event_type"))))
    tests = [D.parse_meta_filter(x) for x in ("value_ >= 10", "type_ != click", "missing_ != 1")]
    return e.select("event_id", *[D.meta_filter(C("m"), *t).alias(f"p{k}") for k, t in enumerate(tests)])


def _probe_page(s, d):
    """Page statistics from its elements: here lines of a document stand for spans."""
    lines = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    n = F.length(F.regexp_replace("line", r"\s", "")).cast("bigint")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(n).alias("n_chars"), F.max(n).alias("longest")).withColumn("kind", D.page_kind(C("n_chars"), F.lit(0)))


def _columns(s, d):
    f = SPANS.df(s, d).withColumn("spans", F.transform(F.arrays_zip("x0", "x1"), lambda z: F.struct(z["x0"].alias("x0"), z["x1"].alias("x1"))))
    return f.select("id", D.estimated_columns(C("spans")).cast("bigint").alias("columns"))


def class_at_point(points, items):
    """Smallest item that holds each point (borders count; of equal areas the first), else background."""
    inside = (points.image == items.image) & (points.px >= items.x) & (points.px <= items.x + items.w) & (points.py >= items.y) & (points.py <= items.y + items.h)
    j = points.join(items, inside, "left")
    best = F.min_by("class", F.struct(C("w") * C("h"), C("item")))
    return j.groupBy(points.image.alias("image"), "point").agg(F.coalesce(best, F.lit("background")).alias("class"))


def class_of(px, py, boxes):
    """The same for a point beside the array of its image's items, without a row for each pair."""
    inside = F.filter(boxes, lambda b: (px >= b["x"]) & (px <= b["x"] + b["w"]) & (py >= b["y"]) & (py <= b["y"] + b["h"]))
    best = F.array_min(F.transform(inside, lambda b: F.struct((b["w"] * b["h"]).alias("area"), b["item"].alias("item"), b["class"].alias("class"))))
    return F.coalesce(best["class"], F.lit("background"))


def _slice_axes(s, d):
    o = table(s, d, "documents").select("doc_id", "lang", "source")
    return o.selectExpr("doc_id", "stack(2, 'lang', lang, 'source', source) AS (axis, key)").where("key IS NOT NULL")


def _bbox_conv():
    v = lambda k: F.get("vals", k)
    has = lambda k: F.array_contains("keys", k)
    conv = F.when(C("coords").isNotNull(), C("coords")).when(has("grid_rows"), "xywh").when(has("n_rows"), "corners").when((v(2) > v(0)) & (v(3) > v(1)), "corners").when((v(2) <= v(0)) | (v(3) <= v(1)), "xywh").otherwise(F.raise_error(F.lit("box convention")).cast("string"))
    return {"conv": conv}


def _task():
    return F.when(C("explicit").isNotNull(), C("explicit")).when(C("probe").startswith("pl2"), "bbox").when(C("kind").isin("array", "float"), "regression").when(C("kind").isin("int", "string", "bool"), "classification").otherwise("error")



QUERIES = {
    "filter_meta": (_meta, "SELECT event_id, CASE WHEN value IS NULL THEN false ELSE value >= 10 END AS p0, CASE WHEN event_type IS NULL THEN false ELSE event_type <> 'click' END AS p1, false AS p2 FROM events"),
    "filter_eligible": (lambda s, d: PAGES.df(s, d).where(D.eligible(C("kind"), arch(), C("n_chars"), C("area"), C("width"), C("height"))).select("id"), f"WITH {PAGES.cte('f')} SELECT id FROM f WHERE {REJECT_SQL} IS NULL"),
    "reject_reason": (lambda s, d: PAGES.df(s, d).select(reject().alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")), f"WITH {PAGES.cte('f')} SELECT reason, count(*) AS n FROM (SELECT {REJECT_SQL} AS reason FROM f) WHERE reason IS NOT NULL GROUP BY reason"),
    "filter_multi_series": (lambda s, d: CHARTS.df(s, d).where("series > 1").select("id"), f"WITH {CHARTS.cte('f')} SELECT id FROM f WHERE series > 1"),
    "filter_top_prefilter": (lambda s, d: table(s, d, "events").where(F.contains("props", F.lit('"'))).select("event_id", F.size(F.json_object_keys("props")).cast("bigint").alias("n")), """SELECT event_id, len(json_keys(props))::BIGINT AS n FROM events WHERE contains(props, '"')"""),
    "derive_doc_id": literal_query(IDS, lambda: {"doc": D.doc_id(C("image"))}, r"SELECT id, regexp_replace(regexp_replace(regexp_replace(image, '__sev\d+b?$', ''), '__p\d+$', ''), '_s\d+$', '') AS doc FROM f"),
    "derive_size_bucket": literal_query(PAGES, lambda: {"bucket": D.size_bucket(C("p50"))}, f"SELECT id, {BUCKET_SQL}::INTEGER AS bucket FROM f"),
    "derive_coarse_sig": literal_query(PAGES, lambda: {"sig": coarse()}, f"SELECT id, {COARSE_SQL} AS sig FROM f"),
    "derive_exact_sig": literal_query(PAGES, lambda: {"sig": exact()}, "SELECT id, substr(sha1(CAST(floor(width / 8) AS BIGINT) || 'x' || CAST(floor(height / 8) AS BIGINT) || '|' || CAST(round_even(mleft * 20, 0) AS BIGINT) || ',' || CAST(round_even(mtop * 20, 0) AS BIGINT) || '|' || CAST(round_even(p50, 0) AS BIGINT) || '|c' || columns || '|r' || CASE WHEN rules > 12 THEN '1' ELSE '0' END || '|i' || CASE WHEN image > 0.05 THEN '1' ELSE '0' END || '|' || coalesce(array_to_string(list_sort(fonts[1:4]), ','), '')), 1, 16) AS sig FROM f"),
    "derive_archetype": literal_query(PAGES, lambda: {"archetype": arch()}, f"SELECT id, {ARCH_SQL} AS archetype FROM f"),
    "derive_script_page": (_script(0.1), script_sql(0.1)),
    "derive_script_doc": (_script(0.0), script_sql(0.0)),
    "script_of_char": (lambda s, d: table(s, d, "documents").select("doc_id", *[D.script_counts(C("text"))[k].alias(k) for k in ("ascii", "latin_ext", "han")]), "SELECT doc_id, length(regexp_replace(text, '[^!-~]', '', 'g'))::BIGINT AS ascii, length(regexp_replace(text, '[^À-ɏ]', '', 'g'))::BIGINT AS latin_ext, length(regexp_replace(text, '[^一-鿿㐀-䶿豈-﫿]', '', 'g'))::BIGINT AS han FROM documents"),
    "page_kind": literal_query(PAGES, lambda: {"k": D.page_kind(C("n_chars"), F.when(C("image") > 0, 1).otherwise(0))}, "SELECT id, CASE WHEN n_chars >= 40 THEN 'digital' WHEN n_chars > 0 THEN 'sparse' WHEN image > 0 THEN 'scanned' ELSE 'empty' END AS k FROM f"),
    "strip_subset_tag": literal_query(FONTS, lambda: {"base": D.base_font(C("font"))}, r"SELECT id, CASE WHEN length(font) > 7 THEN regexp_replace(font, '^[A-Z]{6}\+', '') ELSE font END AS base FROM f"),
    "est_columns": (_columns, f"""WITH {SPANS.cte('f')}, b AS (SELECT id, b, len(x0) AS n, len(list_filter(range(1, len(x0) + 1), lambda i: floor(x0[i] * 48) <= b AND ceil(x1[i] * 48) > b)) > 0 AS o FROM f, unnest(range(0, 48)) AS t(b)),
      o AS (SELECT id, b, n, b - lag(b) OVER (PARTITION BY id ORDER BY b) AS gap FROM b WHERE o) SELECT id, CASE WHEN any_value(n) < 8 THEN 1 ELSE greatest(1, least(6, count(*) FILTER (WHERE gap IS NULL OR gap > 2))) END::BIGINT AS columns FROM o GROUP BY id"""),
    "probe_page": (_probe_page, r"SELECT doc_id, count(*) AS n_lines, sum(n)::BIGINT AS n_chars, max(n)::BIGINT AS longest, CASE WHEN sum(n) >= 40 THEN 'digital' WHEN sum(n) > 0 THEN 'sparse' ELSE 'empty' END AS kind FROM (SELECT doc_id, length(regexp_replace(unnest(string_split(text, chr(10))), '\s', '', 'g')) AS n FROM documents) GROUP BY doc_id"),
    "normalize_severity": literal_query(SEVERITIES, lambda: {"key": D.severity(C("x"))[0], "level": D.severity(C("x"))[1]}, r"SELECT id, coalesce(regexp_replace(x, '\.0$', ''), '0') AS key, CAST(regexp_extract(coalesce(x, '0'), '^(\d+)', 1) AS INTEGER) AS level FROM f"),
    "tag_table": literal_query(TABLES, lambda: {"level": D.table_level(C("r"), C("c"), C("empty"), C("span"), C("depth"), C("merged"), C("family"))}, "SELECT id, CASE WHEN greatest(r, c) >= 10 OR empty >= 0.2 OR span >= 4 OR depth >= 2 OR regexp_matches(regexp_replace(lower(family), '[- ]', '_', 'g'), 'snaking|mirrored|line_printer|continuation_fragment') THEN 'hard' WHEN merged OR empty >= 0.05 THEN 'medium' ELSE 'easy' END AS level FROM f"),
    "tag_chart": literal_query(CHARTS, lambda: {"level": D.chart_level(C("series"), C("dual"), C("hard"), C("stacked"), C("medium"))}, "SELECT id, CASE WHEN series >= 4 OR dual OR hard THEN 'hard' WHEN series >= 2 OR stacked OR medium THEN 'medium' ELSE 'easy' END AS level FROM f"),
    "tag_bboxes": (lambda s, d: ITEMS.df(s, d).groupBy("image").agg(F.count("*").alias("n"), F.min(F.round(C("w") * C("h"), 9)).alias("least")).withColumn("level", D.box_level(C("n"))), f"WITH {ITEMS.cte('f')} SELECT image, count(*) AS n, min(round(w * h, 9)) AS least, CASE WHEN count(*) <= 4 THEN 'easy' WHEN count(*) <= 8 THEN 'medium' ELSE 'hard' END AS level FROM f GROUP BY image"),
    "tag_text": literal_query(TEXTS, lambda: {"level": D.text_level(C("eq"), C("depth"), C("styled"), C("heavy"), C("pt"))}, "SELECT id, CASE WHEN eq >= 4 OR depth >= 2 OR heavy OR coalesce(pt < 7.0, false) THEN 'hard' WHEN eq >= 1 OR styled THEN 'medium' ELSE 'easy' END AS level FROM f"),
    "tag_page": (lambda s, d: OBJECTS.df(s, d).groupBy("page").agg(F.element_at(F.array(*[F.lit(x) for x in D.LEVELS]), F.max(D.rank_of(C("level"))).cast("int")).alias("level")), f"WITH {OBJECTS.cte('f')} SELECT page, (['easy', 'medium', 'hard'])[max(list_position(['easy', 'medium', 'hard'], level))] AS level FROM f GROUP BY page"),
    "normalize_table": literal_query(CELLS, lambda: {"x0": F.coalesce(C("x"), F.get("corners", 0)), "x1": F.round(F.coalesce(C("x") + C("w"), F.get("corners", 2)), 9), "y1": F.round(F.coalesce(C("y") + C("h"), F.get("corners", 3)), 9), "spans": F.coalesce(C("span"), C("span2"), F.lit(1).cast("bigint"))}, "SELECT id, coalesce(x, corners[1]) AS x0, round(coalesce(x + w, corners[3]), 9) AS x1, round(coalesce(y + h, corners[4]), 9) AS y1, coalesce(span, span2, 1)::BIGINT AS spans FROM f"),
    "detect_bbox_conv": literal_query(BOXES, _bbox_conv, "SELECT id, CASE WHEN coords IS NOT NULL THEN coords WHEN list_contains(keys, 'grid_rows') THEN 'xywh' WHEN list_contains(keys, 'n_rows') THEN 'corners' WHEN vals[3] > vals[1] AND vals[4] > vals[2] THEN 'corners' ELSE 'xywh' END AS conv FROM f"),
    "safe_id": literal_query(IDS, lambda: {"safe": D.safe_id(C("image"))}, r"SELECT id, regexp_replace(image, '[/\\]', '__', 'g') AS safe FROM f"),
    "arm_label": literal_query(ARMS, lambda: D.arm_parts(C("name")) | {"label": D.arm_label(C("tower"), C("budget"), C("site"), C("readout"), C("coords"))}, "SELECT id, nullif(regexp_extract(name, '^([^_@]+)_([^@]+)@(\\d+)__(.+)$', 1), '') AS site, nullif(regexp_extract(name, '^([^_@]+)_([^@]+)@(\\d+)__(.+)$', 2), '') AS readout, TRY_CAST(regexp_extract(name, '^([^_@]+)_([^@]+)@(\\d+)__(.+)$', 3) AS INTEGER) AS budget, nullif(regexp_extract(name, '^([^_@]+)_([^@]+)@(\\d+)__(.+)$', 4), '') AS variant, tower || '@' || f.budget || '#' || f.site || '/' || f.readout || CASE coords WHEN 'add' THEN '+coords' WHEN 'only' THEN 'coordsonly' ELSE '' END AS label FROM f"),
    "infer_task_type": literal_query(LABELS, lambda: {"task": _task()}, "SELECT id, CASE WHEN explicit IS NOT NULL THEN explicit WHEN probe LIKE 'pl2%' THEN 'bbox' WHEN kind IN ('array', 'float') THEN 'regression' WHEN kind IN ('int', 'string', 'bool') THEN 'classification' ELSE 'error' END AS task FROM f"),
    "slice_axes": (_slice_axes, "SELECT doc_id, axis, key FROM (SELECT doc_id, 'lang' AS axis, lang AS key FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents) WHERE key IS NOT NULL"),
    "bucket_grounding": literal_query(BOUND, lambda: {"bucket": D.grounding_bucket(C("box"), C("page_ok"), C("iou"))}, "SELECT id, CASE WHEN NOT box THEN 'no-box' WHEN NOT page_ok THEN 'wrong-page' WHEN iou >= 0.5 THEN 'grounded' WHEN iou = 0 THEN 'displaced' ELSE 'partial' END AS bucket FROM f"),
    "geom_signature": literal_query(BOUND, lambda: {"tags": D.geometry_tags(C("rw"), C("rh"), C("dx"), C("dy"))}, "SELECT id, concat_ws(',', CASE WHEN rw > 6 THEN 'FULL-ROW-BAND' WHEN rw > 3 THEN 'wide' WHEN rw < 0.4 THEN 'narrow' END, CASE WHEN rh > 1.6 THEN 'tall' WHEN rh > 0.4 AND rh < 0.6 THEN 'HALF-HEIGHT' WHEN rh < 0.7 THEN 'short' END, CASE WHEN abs(dx) > 0.5 THEN 'dx' END, CASE WHEN abs(dy) > 0.5 THEN 'dy' END) AS tags FROM f"),
    "text_shape": literal_query(BOUND, lambda: {"shape": D.text_shape(C("t"))}, "SELECT id, CASE WHEN contains(t, '<br/>') THEN 'br-blob' WHEN starts_with(ltrim(t), '|') THEN 'md-row' ELSE 'prose' END AS shape FROM f"),
    "failure_kind": literal_query(FAILS, lambda: {"kind": D.failure_kind(C("reason"), C("pred"), C("rep"), C("cap"))}, "SELECT id, CASE WHEN trim(pred) = '' THEN 'empty_output' WHEN rep >= 0.1 THEN 'repetition' WHEN cap THEN 'truncated_at_cap' WHEN regexp_matches(pred, '(?i)^\\s*(i''?m sorry|i am sorry|i cannot|i can''?t|sorry,|as an ai)') THEN 'refusal' WHEN TRY_CAST(regexp_extract(reason, 'best match ratio was ([\\d.]+)', 1) AS DOUBLE) IS NOT NULL THEN CASE WHEN TRY_CAST(regexp_extract(reason, 'best match ratio was ([\\d.]+)', 1) AS DOUBLE) >= 0.6 THEN 'text_partial' ELSE 'text_not_found' END " + " ".join(f"WHEN contains(coalesce(reason, ''), '{n}') THEN '{k}'" for n, k in D.FAILURE_NEEDLES) + " ELSE 'other' END AS kind FROM f"),
    "canonical_class": literal_query(ELEMENTS, lambda: {"class": D.canonical_class(C("tag"), C("css"))}, "SELECT id, CASE WHEN tag IN ('h1', 'h2', 'h3', 'h4') THEN 'heading' WHEN tag = 'table' THEN 'table' WHEN tag IN ('ul', 'ol') THEN 'list' WHEN tag IN ('img', 'svg', 'figure') THEN 'picture' WHEN lower(css) LIKE '%caption%' THEN 'caption' WHEN lower(css) LIKE '%footnote%' THEN 'footnote' WHEN lower(css) LIKE '%header%' THEN 'page-header' WHEN lower(css) LIKE '%footer%' THEN 'page-footer' WHEN lower(css) LIKE '%formula%' OR lower(css) LIKE '%equation%' THEN 'formula' WHEN lower(css) LIKE '%title%' THEN 'title' WHEN tag = 'p' THEN 'text' ELSE 'other' END AS class FROM f"),
    "class_at_point": (lambda s, d: class_at_point(POINTS.df(s, d), ITEMS.df(s, d)), f"WITH {POINTS.cte('p')}, {ITEMS.cte('i')} SELECT p.image, p.point, coalesce(min_by(i.class, i.w * i.h * 1000 + i.item * 1e-6), 'background') AS class FROM p LEFT JOIN i ON p.image = i.image AND px BETWEEN x AND x + w AND py BETWEEN y AND y + h GROUP BY ALL"),
    "token_budget_knob": literal_query(KNOBS, lambda: {"knob": D.budget_knob(C("encoder"), C("budget"))}, "SELECT id, CASE WHEN budget <= 0 THEN NULL WHEN encoder = 'siglip2_naflex' THEN 'max_num_patches=' || budget WHEN encoder IN ('qwen35_vit', 'qwen3_vl_vit') THEN 'max_pixels=' || (budget * 784) WHEN encoder = 'deepseek_ocr' AND budget IN (64, 100, 256, 400) THEN 'base_size=' || CASE budget WHEN 64 THEN 512 WHEN 100 THEN 640 WHEN 256 THEN 1024 ELSE 1280 END END AS knob FROM f"),
    "target_grid": literal_query(GRIDS, lambda: {"th": D.target_grid(C("h"), C("w"), C("budget"))["th"], "tw": D.target_grid(C("h"), C("w"), C("budget"))["tw"]}, """SELECT id, CASE WHEN th >= tw THEN least(th, budget // tw) ELSE th END AS th, CASE WHEN th < tw THEN least(tw, budget // th) ELSE tw END AS tw FROM (SELECT id, budget,
      CASE WHEN budget > h * w THEN NULL WHEN budget = h * w THEN h WHEN h = w AND CAST(floor(sqrt(budget)) AS INTEGER) ** 2 = budget THEN CAST(floor(sqrt(budget)) AS INTEGER) ELSE greatest(1, CAST(floor(h * sqrt(budget / (h * w)) + 1e-9) AS INTEGER)) END AS th, CASE WHEN budget > h * w THEN NULL WHEN budget = h * w THEN w WHEN h = w AND CAST(floor(sqrt(budget)) AS INTEGER) ** 2 = budget THEN CAST(floor(sqrt(budget)) AS INTEGER) ELSE greatest(1, CAST(floor(w * sqrt(budget / (h * w)) + 1e-9) AS INTEGER)) END AS tw FROM f)"""),
    "hash_split": col_query("", "documents", "doc_id", lambda: {"train": D.is_train(C("doc_id"), 0.8, 7)}, "SELECT doc_id, CAST(('0x' || substr(sha1('7:' || doc_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.8 AS train FROM documents"),
    "hash_split_md5": col_query("", "documents", "doc_id", lambda: {"m": D.md5_mod(C("doc_id"))}, "SELECT doc_id, CAST((('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT % 5 * 1 + ('0x' || substr(md5(doc_id::VARCHAR), 17, 16))::UBIGINT % 5) % 5 AS BIGINT) AS m FROM documents"),
    "hash_seed_blake2b": (lambda s, d: IDS.df(s, d).select("id", D.blake_seed(C("image")).alias("seed")), None),
    "hash_seed_js": col_query("", "documents", "doc_id", lambda: {"seed": D.scramble_seed(F.lit(12345), C("doc_id"))}, "SELECT doc_id, xor(12345::BIGINT, ((doc_id + 1) * 2654435761) & 4294967295) & 4294967295 AS seed FROM documents"),
    "num_round": literal_query(ROUNDS, lambda: {"even": D.half_even(C("x")), "up": D.half_up(C("x"))}, "SELECT id, round_even(x, 0) + 0.0 AS even, CAST(floor(x + 0.5) AS BIGINT) AS up FROM f"),
    "num_percentile": (lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.percentile("n_chars", F.lit(0.9)).alias("p90")), "SELECT lang, quantile_cont(n_chars, 0.9) AS p90 FROM documents GROUP BY lang"),
}
