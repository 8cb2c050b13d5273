"""Queries of the remaining tabular kernels."""

from __future__ import annotations

from pyspark.sql import Window

from folia.functions import geometry as G
from folia.operators.selection import ranked
from folia.plans.base import F, literal_query, table
from folia.sources.literal import Literal

C = F.col
CHART = Literal("chart bigint, kind string, series string, cat string, v double", [(1, "bar", "a", "x", 10.0), (1, "bar", "a", "y", 5.5), (2, "pie", "p", "x", 1.0), (2, "pie", "p", "y", 3.0), (3, "stack100", "a", "x", 2.0), (3, "stack100", "b", "x", 2.0), (3, "stack100", "a", None, 1.0), (4, "pie", "z", "x", 0.0)]).over("lineitem", "l_orderkey + 1000; CASE l_orderkey % 3 WHEN 0 THEN 'bar' WHEN 1 THEN 'pie' ELSE 'stack100' END; 's' || (l_linenumber % 2); 'c' || l_linenumber; l_quantity")
TABLE = Literal("t bigint, col bigint, r bigint, cell string", [(1, 0, 0, "Alpha"), (1, 0, 1, "Beta"), (1, 0, 2, "12"), (1, 1, 0, "$1,200"), (1, 1, 1, "(30)"), (1, 1, 2, ""), (1, 2, 0, "5%"), (1, 2, 1, "<b>7</b>"), (1, 2, 2, "n/a"), (2, 0, 0, "x"), (2, 0, 1, "y")]).over("lineitem", "l_orderkey + 1000; l_linenumber % 3; l_linenumber; CASE WHEN l_returnflag = 'N' THEN '' || l_partkey ELSE 'n/a' END")
MONEY = Literal("id bigint, x string", [(1, "(1,234)"), (2, "1,234.5"), (3, "abc"), (4, "-7"), (5, "1234567.25"), (6, "(2)")]).over("orders", "o_orderkey + 1000; CASE o_orderkey % 3 WHEN 0 THEN '(' || o_orderkey || ')' WHEN 1 THEN '' || o_custkey ELSE o_orderpriority END")
SHAPES = Literal("id bigint, groups bigint, rowspan boolean, cols bigint, r bigint, title boolean", [(1, 0, False, 3, 4, False), (2, 2, False, 3, 4, False), (3, 0, True, 3, 4, False), (4, 0, False, 8, 4, False), (5, 0, False, 6, 4, False), (6, 0, False, 3, 12, False), (7, 0, False, 3, 4, True)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_linenumber % 3; l_returnflag = 'R'; l_suppkey % 12; l_partkey % 20; l_linestatus = 'O'")
HEIGHTS = Literal("page bigint, body double, hs array<double>", [(1, 10.0, [10.0, 14.0, 13.5, 20.0, 12.0, 30.0, 16.0]), (2, 12.0, [12.0, 12.0])]).over("part", "p_partkey + 1000; 10 + p_partkey % 3; split(p_size || ',' || (p_size + 4) || ',' || (p_partkey % 37) || ',12', ',')")
SIZES = Literal("id bigint, w double, h double", [(1, 612.0, 792.0), (2, 595.0, 842.0), (3, 610.0, 1000.0), (4, 842.0, 595.0)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_quantity * 20; l_linenumber * 150")
PRESETS = Literal("name string, pw double, ph double", [("letter", 612.0, 792.0), ("a4", 595.0, 842.0), ("legal", 612.0, 1008.0)])
WORDS = Literal("page bigint, x0 double, y0 double, x1 double, y1 double", [(1, 72.0, 80.0, 100.0, 92.0), (1, 300.0, 700.0, 540.0, 712.0), (2, 10.0, 10.0, 600.0, 30.0)]).over("lineitem", "l_orderkey + 1000; l_quantity; l_linenumber * 10; l_quantity * 10; l_linenumber * 10 + 8 + l_linenumber % 5 + CASE WHEN l_quantity > 45 THEN l_linenumber * 2 ELSE 0 END")
RULES = Literal("page bigint, ord bigint, share double", [(1, 1, 0.5), (1, 2, 0.01), (1, 3, 0.2), (1, 4, 0.03), (2, 1, 0.0), (2, 2, 0.3)]).over("lineitem", "l_orderkey + 1000; l_linenumber; l_discount")
LENGTHS = Literal("k bigint, n bigint", [(1, 3), (2, 5), (3, 2), (4, 40)])
RANGES = Literal("id bigint, lo double, hi double", [(1, 0.0, 10.0), (2, 0.0, 97.0), (3, -5.0, 1234.0), (4, 0.1, 0.5), (5, 3.0, 3.0)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_quantity; l_quantity + l_linenumber * 7")
CACHE_A = Literal("id bigint, v array<double>", [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])]).over("embeddings", "vec_id + 1000; split(vec_id || ',' || label, ',')")
CACHE_B = Literal("id bigint, v array<double>", [(1, [1.0, 2.0]), (2, [3.0, 4.5]), (3, [5.0, 6.0])]).over("embeddings", "vec_id + 1000; split(vec_id || ',' || (label + vec_id % 2), ',')", "vec_id % 5 > 0")
GROUNDING = Literal("id bigint, field string, bucket string, matched boolean", [(1, "a", "grounded", True), (2, "a", "partial", False), (3, "b", "partial", True), (4, "b", "displaced", False), (5, "b", "no-box", False), (6, "c", "grounded", False)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_returnflag; CASE l_linenumber % 4 WHEN 0 THEN 'grounded' WHEN 1 THEN 'partial' WHEN 2 THEN 'displaced' ELSE 'no-box' END; l_discount > 0.05")
NUMERIC = r"^[($-]*\d[\d,]*(\.\d+)?[)%]*$"


def _clean(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(?i)<sup>.*?</sup>", ""), "<[^>]+>", ""))


_CLEAN = "trim(regexp_replace(regexp_replace(cell, '(?i)<sup>.*?</sup>', '', 'g'), '<[^>]+>', '', 'g'))"


def _chart_rules(s, d):
    f = CHART.df(s, d)
    share = C("kind").isin("pie", "stack100")
    key = F.when(C("kind") == "stack100", F.coalesce("cat", F.lit("#"))).otherwise(F.lit("*"))
    f = f.withColumn("total", F.sum("v").over(Window.partitionBy("chart", key)))
    pct = F.floor(100 * C("v") / F.when(C("total") == 0, 1.0).otherwise(C("total")) + 0.5)
    return f.select("chart", "series", F.coalesce("cat", F.lit("#1")).alias("label"), F.when(share, F.concat(pct.cast("string"), F.lit("%"))).otherwise(F.format_string("%.2f", C("v"))).alias("value"))


def _accounting(x):
    body = F.regexp_replace(x, r"[(),$]", "").try_cast("double")
    return F.coalesce(F.when(F.rlike(x, F.lit(r"^\(.*\)$")), -body).otherwise(body), F.lit(0.0))


def heading_tops(heights, body):
    """Heights above 1.25 body sizes, descending, gathered within 1 point of the first of a group; the three largest."""
    high = F.reverse(F.array_sort(F.filter(heights, lambda h: h > 1.25 * body)))
    groups = F.aggregate(high, F.array().cast("array<double>"), lambda a, h: F.when((F.size(a) > 0) & (F.element_at(a, -1) - h <= 1.0), a).otherwise(F.array_append(a, h)))
    return F.slice(F.when(F.size(high) > 0, groups).otherwise(F.array().cast("array<double>")), 1, 3)


def _heading_clusters(s, d):
    return HEIGHTS.df(s, d).select("page", heading_tops(C("hs"), C("body")).alias("tops"))


_TOPS = """g AS (SELECT page, h FROM u WHERE h > 1.25 * body), t1 AS (SELECT page, max(h) AS a FROM g GROUP BY page), t2 AS (SELECT t1.page, a, (SELECT max(h) FROM g WHERE g.page = t1.page AND a - h > 1.0) AS b FROM t1), tops AS (SELECT t2.page, a, b, (SELECT max(h) FROM g WHERE g.page = t2.page AND b - h > 1.0) AS c FROM t2)"""


def _pixels(points):
    return F.floor(points * 96 / 72 + 0.5).cast("bigint")


def _page_facts(s, d):
    """Margin, body, table and heading sizes of pages of 612 x 792 points from their word boxes; odd heights are left out of the sizes."""
    h = C("y1") - C("y0")
    margin = F.round(F.least(F.lit(1.2), F.greatest(F.lit(0.3), (F.min("x0") + F.min("y0") + (612 - F.max("x1")) + (792 - F.max("y1"))) / 4 / 72)), 6)
    fit = F.when((h > 1) & (h < 792 / 4), h)
    # by distinct heights and their counts would do for the tops; the median is exact over all
    f = WORDS.df(s, d).groupBy("page").agg(margin.alias("margin"), F.coalesce(F.percentile(fit, F.lit(0.5)), F.lit(10.0)).alias("body"), F.collect_set(fit).alias("hs"))
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    tops = F.array_join(F.transform(heading_tops(C("hs"), C("body")), lambda x: _pixels(x).cast("string")), " ")
    return f.select("page", "margin", "body", clamp(_pixels(C("body")), 9, 15).alias("body_px"), clamp(_pixels(C("body") * 0.92), 8, 13).alias("table_px"), tops.alias("heading_px"))


_FACTS_SQL = f"""WITH {WORDS.cte('f')}, m AS (SELECT page, round(least(1.2, greatest(0.3, (min(x0) + min(y0) + (612 - max(x1)) + (792 - max(y1))) / 4 / 72)), 6)::DOUBLE AS margin, coalesce(quantile_cont(y1 - y0, 0.5) FILTER (WHERE y1 - y0 > 1 AND y1 - y0 < 198), 10.0) AS body FROM f GROUP BY page),
  u AS (SELECT page, body, y1 - y0 AS h FROM f JOIN m USING (page) WHERE y1 - y0 > 1 AND y1 - y0 < 198), {_TOPS}
  SELECT m.page, margin, body, greatest(9, least(15, CAST(floor(body * 96 / 72 + 0.5) AS BIGINT))) AS body_px, greatest(8, least(13, CAST(floor(body * 0.92 * 96 / 72 + 0.5) AS BIGINT))) AS table_px,
  array_to_string(list_transform(list_filter([a, b, c], lambda x: x IS NOT NULL), lambda x: CAST(floor(x * 96 / 72 + 0.5) AS BIGINT)), ' ') AS heading_px FROM m LEFT JOIN tops USING (page)"""


def _nearest_preset(s, d):
    j = SIZES.df(s, d).crossJoin(F.broadcast(PRESETS.df(s, d)))
    return j.groupBy("id").agg(F.min_by("name", F.struct(F.abs(C("w") - C("pw")) + F.abs(C("h") - C("ph")), "name")).alias("preset"))


def _rule_validate(s, d):
    f = RULES.df(s, d).withColumn("keep", C("share") >= 0.02).withColumn("ok", F.avg((C("share") < 0.02).cast("double")).over(Window.partitionBy("page")) <= 0.3)
    return ranked(f.where("keep"), ["page"], ["ord"], "new_ord").select("page", "ord", "new_ord", "ok")


def _package(s, d):
    ends = LENGTHS.df(s, d).withColumn("hi", F.sum("n").over(Window.orderBy("k")))
    ids = s.range(30).select(C("id").alias("page"))
    j = ids.join(F.broadcast(ends), (C("page") >= C("hi") - C("n")) & (C("page") < C("hi")))
    return ranked(j, ["k"], ["page"], "ord").select("page", "k", "ord")


def _nice(s, d):
    raw = F.greatest(C("hi") - C("lo"), F.lit(1e-9)) / 4
    k = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(raw / k <= 1, 1.0).when(raw / k <= 2, 2.0).when(raw / k <= 2.5, 2.5).when(raw / k <= 5, 5.0).otherwise(10.0) * k
    return RANGES.df(s, d).select("id", F.round(step, 9).alias("step"), F.round(F.floor(C("lo") / step) * step, 6).alias("first"))


_NICE = "SELECT id, round(step, 9) AS step, round(floor(lo / step) * step, 6) AS first FROM (SELECT id, lo, k * CASE WHEN raw / k <= 1 THEN 1.0 WHEN raw / k <= 2 THEN 2.0 WHEN raw / k <= 2.5 THEN 2.5 WHEN raw / k <= 5 THEN 5.0 ELSE 10.0 END::DOUBLE AS step FROM (SELECT *, pow(10.0, floor(log10(raw))) AS k FROM (SELECT *, greatest(hi - lo, 1e-9) / 4 AS raw FROM f)))"


def _parity(s, d):
    j = CACHE_A.df(s, d).alias("a").join(CACHE_B.df(s, d).alias("b"), "id")
    return j.agg(F.count_if(F.size("a.v") == F.size("b.v")).alias("shapes"), F.count_if(C("a.v") == C("b.v")).alias("same"), F.max(F.array_max(F.zip_with("a.v", "b.v", lambda x, y: F.abs(x - y)))).alias("most"))


def _identical(s, d):
    """Identical pairs among the four children (16 numbers each, rounded) of each vector."""
    e = table(s, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform(F.slice("embedding", k * 16 + 1, 16), lambda x: F.bround(x.cast("double"), 1) + 0.0))).alias("k", "v"))
    j = e.alias("a").join(e.alias("b"), (C("a.vec_id") == C("b.vec_id")) & (C("a.k") < C("b.k")) & (C("a.v") == C("b.v")))
    return j.groupBy("a.vec_id").agg(F.count("*").alias("pairs"))


def _cosine_near(s, d):
    """Mean cosine of neighbouring cells and of cells beyond L1 distance 5, over 8 x 8 grids of 64 consecutive vectors each."""
    cell = F.pmod("vec_id", F.lit(64))
    e = table(s, d, "embeddings").select("vec_id", "embedding", F.floor(C("vec_id") / 64).alias("grid"), F.floor(cell / 8).alias("y"), (cell % 8).alias("x"))
    a, b = e.alias("a"), e.alias("b")
    dist = F.abs(C("a.x") - C("b.x")) + F.abs(C("a.y") - C("b.y"))
    j = a.join(b, (C("a.grid") == C("b.grid")) & (C("a.vec_id") < C("b.vec_id"))).select(dist.alias("d"), G.cosine(C("a.embedding"), C("b.embedding")).alias("c"))
    return j.agg(F.round(F.avg(F.when(C("d") == 1, C("c"))), 6).alias("near"), F.round(F.avg(F.when(C("d") > 5, C("c"))), 6).alias("far"))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"


#: Cells that look like times or dates.
DATE_LIKE = r"^(\d{1,2}[:h]\d{2}([:.]\d{2})?|\d{1,2}/\d{1,2}(/\d{2,4})?|\d{1,4}[.\-]\d{1,2}[.\-]\d{2,4}|\d{4}-\d{2}(-\d{2})?)$"
CHARTS = Literal("t bigint, r bigint, col bigint, cell string", [(t, r, c, x) for t, rows in [
    (1, [("Alpha", "2021-09-17", "$1,200"), ("Beta", "12.05.2001", "(30)"), ("", "06:33", "n/a"), ("Gamma", "02/04", "7.5%")]),
    (2, [("x", "y"), ("z", "1")]),
    (3, [(str(2 * i), f"{i}.5") for i in range(15)]),
    (4, [("1", "a")]),
    (5, [("a", "5"), ("b", "-"), ("c", "6 units"), ("d", "1-2")]),
] for r, row in enumerate(rows) for c, x in enumerate(row)])


def parse_number(cell):
    """A cell's number: brackets mean below zero, signs behind the first character and other marks are dropped; null without one."""
    t = F.trim(cell)
    n = F.regexp_replace(F.regexp_replace(t, r"[^0-9.\-]", ""), "(?<!^)-", "").try_cast("double")
    return F.when(F.rlike(t, F.lit(r"^\(.*\)$")), -F.abs(n)).otherwise(n)


def _derive_chart(s, d):
    """The value column is the one with most numbers that are no dates (two at least, the first of several), the label column the first with numbers in under 40 %; twelve points at most, none if there are fewer than two."""
    t = CHARTS.df(s, d).withColumn("num", parse_number(C("cell")))
    cols = t.groupBy("t", "col").agg(F.count_if(C("num").isNotNull() & ~F.rlike(F.trim("cell"), F.lit(DATE_LIKE))).alias("score"), F.count("*").alias("rows"))
    best = cols.groupBy("t").agg(F.max_by("col", F.struct("score", -C("col"))).alias("value_col"), F.max("score").alias("best"), F.max("rows").alias("rows"), F.min(F.when(C("score") < C("rows") * 0.4, C("col"))).alias("label_col"))
    best = best.where("rows >= 2 AND best >= 2")
    values = t.join(best, "t").where((C("col") == C("value_col")) & C("num").isNotNull()).select("t", "r", "label_col", "num")
    names = t.select("t", "r", C("col").alias("label_col"), C("cell").alias("label"))
    rank = F.row_number().over(Window.partitionBy("t").orderBy("r"))
    points = values.withColumn("k", rank).where("k <= 12").join(names, ["t", "r", "label_col"], "left")
    points = points.select("t", "r", F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("#"), (C("r") + 1).cast("string"))).alias("label"), "num")
    drawn = points.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("r", "label", "num"))).alias("p")).where(F.size("p") >= 2)
    drawn = drawn.select("t", F.array_join(F.transform("p", lambda x: x["label"]), "|").alias("labels"), F.array_join(F.transform("p", lambda x: F.format_string("%.2f", x["num"])), "|").alias("values"))
    return t.select("t").distinct().join(drawn, "t", "left")


_PARSE = r"CASE WHEN regexp_matches(trim(cell), '^\(.*\)$') THEN -abs({0}) ELSE {0} END".format(r"TRY_CAST(substr(regexp_replace(trim(cell), '[^0-9.\-]', '', 'g'), 1, 1) || replace(substr(regexp_replace(trim(cell), '[^0-9.\-]', '', 'g'), 2), '-', '') AS DOUBLE)")
_CHART_SQL = f"""WITH {CHARTS.cte('f')}, n AS (SELECT *, {_PARSE} AS num FROM f), c AS (SELECT t, col, count(*) FILTER (WHERE num IS NOT NULL AND NOT regexp_matches(trim(cell), '{DATE_LIKE}')) AS score, count(*) AS rows FROM n GROUP BY t, col),
  v AS (SELECT t, col AS value_col, (SELECT min(x.col) FROM c x WHERE x.t = b.t AND x.score < x.rows * 0.4) AS label_col FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, col) AS k FROM c) b WHERE k = 1 AND score >= 2 AND rows >= 2),
  p AS (SELECT n.t, n.r, n.num, coalesce(nullif(l.cell, ''), '#' || (n.r + 1)) AS label, row_number() OVER (PARTITION BY n.t ORDER BY n.r) AS k FROM n JOIN v ON n.t = v.t AND n.col = v.value_col LEFT JOIN f l ON l.t = n.t AND l.r = n.r AND l.col = v.label_col WHERE num IS NOT NULL),
  g AS (SELECT t, string_agg(label, '|' ORDER BY r) AS labels, string_agg(printf('%.2f', num), '|' ORDER BY r) AS values FROM p WHERE k <= 12 GROUP BY t HAVING count(*) >= 2)
  SELECT t, labels, values FROM (SELECT DISTINCT t FROM f) LEFT JOIN g USING (t)"""


QUERIES = {
    "ker_chart_rules": (_chart_rules, f"WITH {CHART.cte('f')}, s AS (SELECT *, sum(v) OVER (PARTITION BY chart, CASE WHEN kind = 'stack100' THEN coalesce(cat, '#') ELSE '*' END) AS total FROM f) SELECT chart, series, coalesce(cat, '#1') AS label, CASE WHEN kind IN ('pie', 'stack100') THEN CAST(floor(100 * v / CASE WHEN total = 0 THEN 1.0 ELSE total END + 0.5) AS BIGINT) || '%' ELSE printf('%.2f', v) END AS value FROM s"),
    "ker_column_numeric": (lambda s, d: TABLE.df(s, d).where(_clean(C("cell")) != "").groupBy("t", "col").agg((F.avg(F.rlike(_clean(C("cell")), F.lit(NUMERIC)).cast("double")) >= 0.6).alias("numeric")), f"WITH {TABLE.cte('f')} SELECT t, col, avg(CASE WHEN regexp_matches({_CLEAN}, '{NUMERIC}') THEN 1.0 ELSE 0.0 END) >= 0.6 AS numeric FROM f WHERE {_CLEAN} <> '' GROUP BY t, col"),
    "ker_parse_accounting": literal_query(MONEY, lambda: {"v": _accounting(C("x"))}, r"SELECT id, coalesce(CASE WHEN regexp_matches(x, '^\(.*\)$') THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(x, '[(),$]', '', 'g') AS DOUBLE), 0.0) AS v FROM f"),
    "ker_thousands": (lambda s, d: MONEY.df(s, d).select("id", F.when(F.rlike("x", F.lit(r"^-?\d+\.\d+$")), F.format_number(C("x").try_cast("double"), 2)).when(F.rlike("x", F.lit(r"^-?\d+$")), F.format_number(C("x").try_cast("double"), 0)).otherwise(C("x")).alias("v")), None),
    "ker_difficulty_js": literal_query(SHAPES, lambda: {"level": F.when((C("groups") > 0) | C("rowspan") | (C("cols") >= 8), "hard").when(C("title") | (C("cols") >= 6) | (C("r") >= 12), "medium").otherwise("easy")}, "SELECT id, CASE WHEN groups > 0 OR rowspan OR cols >= 8 THEN 'hard' WHEN title OR cols >= 6 OR r >= 12 THEN 'medium' ELSE 'easy' END AS level FROM f"),
    "ker_heading_clusters": (_heading_clusters, f"WITH {HEIGHTS.cte('f')}, u AS (SELECT page, body, unnest(hs) AS h FROM f), {_TOPS} SELECT f.page, list_filter([a, b, c], lambda x: x IS NOT NULL) AS tops FROM f LEFT JOIN tops USING (page)"),
    "ker_nearest_preset": (_nearest_preset, f"WITH {SIZES.cte('f')}, {PRESETS.cte('p')} SELECT id, name AS preset FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY abs(w - pw) + abs(h - ph), name) AS r FROM f, p) WHERE r = 1"),
    "ker_page_facts": (_page_facts, _FACTS_SQL),
    "ker_rule_validate": (_rule_validate, f"WITH {RULES.cte('f')}, k AS (SELECT *, avg(CASE WHEN share < 0.02 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY page) <= 0.3 AS ok FROM f) SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY ord) AS new_ord, ok FROM k WHERE share >= 0.02"),
    "ker_package_chunk": (_package, f"WITH {LENGTHS.cte('f')}, e AS (SELECT *, sum(n) OVER (ORDER BY k) AS hi FROM f) SELECT page, k, row_number() OVER (PARTITION BY k ORDER BY page) AS ord FROM range(0, 30) AS r(page) JOIN e ON page >= hi - n AND page < hi"),
    "ker_nice_axis": (_nice, f"WITH {RANGES.cte('f')} {_NICE}"),
    "ker_cache_parity": (_parity, f"WITH {CACHE_A.cte('a')}, {CACHE_B.cte('b')} SELECT count(*) FILTER (WHERE len(a.v) = len(b.v)) AS shapes, count(*) FILTER (WHERE a.v = b.v) AS same, max(greatest(abs(a.v[1] - b.v[1]), abs(a.v[2] - b.v[2]))) AS most FROM a JOIN b USING (id)"),
    "ker_identical_children": (_identical, "WITH e AS (SELECT vec_id, k, list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda x: round_even(x::DOUBLE, 1) + 0.0) AS v FROM embeddings, unnest(range(0, 4)) AS t(k)) SELECT a.vec_id, count(*) AS pairs FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.k < b.k AND a.v = b.v GROUP BY a.vec_id"),
    "ker_neighbor_cosine": (_cosine_near, f"WITH e AS (SELECT vec_id, embedding AS v, vec_id // 64 AS g, vec_id % 64 // 8 AS y, vec_id % 8 AS x FROM embeddings), j AS (SELECT abs(a.x - b.x) + abs(a.y - b.y) AS d, {_DOT.format('a.v', 'b.v')} / (sqrt({_DOT.format('a.v', 'a.v')}) * sqrt({_DOT.format('b.v', 'b.v')})) AS c FROM e a JOIN e b ON a.g = b.g AND a.vec_id < b.vec_id) SELECT round(avg(CASE WHEN d = 1 THEN c END), 6) AS near, round(avg(CASE WHEN d > 5 THEN c END), 6) AS far FROM j"),
    "ker_chart_derive": (_derive_chart, _CHART_SQL),
    "ker_cell_buckets": (lambda s, d: GROUNDING.df(s, d).groupBy("field").pivot("bucket", ["grounded", "partial", "displaced", "no-box"]).agg(F.count("id")).select("field", *[F.coalesce(F.col(f"`{b}`"), F.lit(0).cast("bigint")).alias(b.replace("-", "_")) for b in ("grounded", "partial", "displaced", "no-box")]), f"WITH {GROUNDING.cte('f')} SELECT field, count(*) FILTER (WHERE bucket = 'grounded') AS grounded, count(*) FILTER (WHERE bucket = 'partial') AS partial, count(*) FILTER (WHERE bucket = 'displaced') AS displaced, count(*) FILTER (WHERE bucket = 'no-box') AS no_box FROM f GROUP BY field"),
}
