"""Queries of the joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window

from folia.functions import geometry as G
from folia.functions import text as X
from folia.operators import joins as J
from folia.operators import shingles
from folia.plans.base import F, table
from folia.plans.derive_queries import ITEMS, POINTS, class_at_point
from folia.sources.literal import Literal

C = F.col
_NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"

PROBES = Literal("probe bigint, image string, x double, y double", [(1, "a", 0.1, 0.2), (2, "a", 0.5, 0.5), (3, "b", 0.1, 0.2), (4, "a", 0.100001, 0.2), (5, "c", 0.3, 0.3)]).over("orders", "o_orderkey + 1000; 'o' || CAST(floor(o_orderkey / 4) AS BIGINT); (o_orderkey % 4) * (o_orderkey % 4) * 0.0531; (o_custkey % 50) * 0.0137 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 0.0007 END")
FEATURES = Literal("image string, x double, y double, vec double", [("a", 0.1, 0.2, 1.5), ("a", 0.5, 0.5, 2.5), ("c", 0.9, 0.9, 3.5), ("c", 0.4, 0.3, 4.5)]).over("orders", "'o' || CAST(floor(o_orderkey / 4) AS BIGINT); (o_orderkey % 4) * (o_orderkey % 4) * 0.0531; (o_custkey % 50) * 0.0137; o_custkey", "o_orderkey % 9 > 0")
SCORES = Literal("image string, arm string, family string, score double, content double", [("a", "A", "t", 0.5, 0.6), ("a", "B", "t", 0.7, None), ("b", "A", "t", 0.4, 0.2), ("b", "B", "t", 0.1, 0.3), ("c", "A", "u", 0.9, 0.9), ("d", "B", "u", 0.2, 0.1), ("e", "A", "u", 0.3, 0.3), ("e", "B", "u", 0.6, 0.5), ("a", "C", "t", 0.1, 0.1), ("b", "C", "t", 0.2, 0.2)]).over("orders", "'o' || CAST(floor(o_orderkey / 3) AS BIGINT); CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END; CASE o_orderstatus WHEN 'O' THEN 't' ELSE 'u' END; (o_custkey % 10) / 10; (o_custkey % 7) / 8")
DIMS = Literal("id string, w bigint, h bigint", [("a", 1, 1), ("b", 1, 1), ("c", 1, 1), ("d", 2, 1), ("e", 3, 3), ("f", 3, 3)]).over("part", "'p' || p_partkey; p_size; p_partkey % 3")
TESTS = Literal("test string, type string, pdf string", [("t1", "text", "p1"), ("p1_baseline", "baseline", "p1"), ("t2", "math", "p2"), ("t3", "text", "p3"), ("t4", "text", "p3")]).over("orders", "'t' || o_orderkey; CASE WHEN o_orderkey % 4 = 0 THEN 'baseline' ELSE 'text' END; 'pdf' || o_custkey")
FAILED = Literal("test string", [("t1",), ("zz",), ("t3",)]).over("orders", "CASE WHEN o_orderkey % 3 = 0 THEN 'zz' ELSE 't' END || o_orderkey")
MANIFEST = Literal("id string, expected string", [("a", None), ("b", "B!"), ("c", None), ("d", None)]).over("customer", "'c' || c_custkey; CASE WHEN c_custkey % 5 = 0 THEN c_name END")
GOLD = Literal("id string, suffix string, body string", [("a", ".gold.md", "A1"), ("a", ".md", "A2"), ("c", ".md", "C2")]).over("customer", "'c' || c_custkey; CASE WHEN c_custkey % 4 = 0 THEN '.gold.md' ELSE '.md' END; c_name", "c_custkey % 2 = 0")
PREDS = Literal("id string, text string", [("a", "A1"), ("b", "bb")]).over("customer", "'c' || c_custkey; c_mktsegment", "c_custkey % 3 < 2")
CELLS = Literal("t bigint, cell bigint, x0 double, y0 double, x1 double, y1 double", [(1, 1, 0.0, 0.0, 0.4, 0.2), (1, 2, 0.1, 0.05, 0.3, 0.15), (1, 3, 0.5, 0.0, 0.9, 0.2), (2, 1, 0.0, 0.0, 1.0, 1.0), (2, 2, 0.9, 0.9, 1.2, 1.2)]).over("lineitem", "l_orderkey + 1000; l_linenumber; l_discount * 10; l_tax * 10; l_discount * 10 + l_quantity / 50; l_tax * 10 + 0.3")
GT = Literal("page bigint, cell bigint, x double, y double, w double, h double", [(1, 1, 0.0, 0.0, 0.2, 0.2), (1, 2, 0.5, 0.5, 0.2, 0.2), (2, 1, 0.0, 0.0, 0.1, 0.1)]).over("lineitem", "l_orderkey + 1000; l_linenumber; l_discount; l_tax; 0.25; 0.125", "l_linenumber % 2 = 1")
PRED = Literal("page bigint, seq bigint, x double, y double, w double, h double", [(1, 1, 0.05, 0.0, 0.2, 0.2), (1, 2, 0.0, 0.0, 0.2, 0.2), (1, 3, 0.45, 0.5, 0.2, 0.2), (1, 4, 0.55, 0.5, 0.2, 0.2)]).over("lineitem", "l_orderkey + 1000; l_linenumber; l_discount; l_tax; 0.25; 0.25", "l_linenumber % 2 = 0")
RUNS = Literal("doc bigint, path string, run string, bucket string", [(1, "x", "A", "grounded"), (1, "x", "B", "displaced"), (1, "y", "A", "grounded"), (1, "y", "B", "grounded"), (2, "x", "A", "partial"), (2, "x", "B", "displaced"), (3, "z", "A", "grounded"), (3, "z", "B", "displaced")]).over("lineitem", "l_orderkey + 1000; l_returnflag; CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END; CASE WHEN l_linestatus = 'O' THEN 'grounded' ELSE 'displaced' END")
SCANS = Literal("scan bigint, name string", [(1, "abcd1234_scan01"), (2, "xx_abcd1235_y"), (3, "zzzzzzzzzz"), (4, "__aaaa0001"), (5, "ef561234")])
PACKAGES = Literal("package string", [("abcd1234",), ("ef561234",), ("aaaa0000",), ("aaaa0002",)])
PAGES = Literal("package string, ord bigint, source bigint", [("p1", 2, 7), ("p1", 1, 9), ("p2", 1, 5)]).over("orders", "'k' || CAST(floor(o_orderkey / 5) AS BIGINT); o_orderkey % 5; o_custkey")
TRUTH = Literal("ord bigint, source bigint, kind string", [(2, 7, "table"), (1, 9, "text"), (1, 5, "chart"), (3, 8, "text")]).over("customer", "c_custkey % 5; c_custkey; c_mktsegment")
SCANPAGES = Literal("package string, page bigint", [("p1", 1), ("p1", 2), ("p1", 3), ("p2", 1), ("p2", 2)]).over("orders", "'k' || CAST(floor(o_orderkey / 5) AS BIGINT); o_orderkey % 5 + 1")
LEFT_DIR = Literal("path string, body string", [("a", "1"), ("b", "2"), ("c", "3"), ("e", None)]).over("customer", "'f' || c_custkey; c_name", "c_custkey % 11 > 0")
RIGHT_DIR = Literal("path string, body string", [("a", "1"), ("b", "x"), ("d", "4"), ("e", None)]).over("customer", "'f' || c_custkey; CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END", "c_custkey % 7 > 0")
RUNGS = Literal("probe string, rung bigint, mech string, head string, metric double", [("g", 64, "pooled", "lin", 0.5), ("g", 64, "res", "lin", 0.6), ("g", 64, "pooled", "mlp", 0.7), ("h", 64, "res", "lin", 0.4), ("g", 256, "pooled", "lin", 0.8)]).over("lineitem", "'o' || l_orderkey; 64 * CAST(floor((l_linenumber + 1) / 2) AS BIGINT); CASE WHEN l_linenumber % 2 = 1 THEN 'pooled' ELSE 'res' END; 'lin'; l_discount")
TREES = Literal("tree string, path string, value double", [("stock", "a.b", 1.0), ("repaired", "a.b", 1.5), ("stock", "a.c", 2.0), ("repaired", "d", 3.0), ("stock", "e", 0.123456789), ("repaired", "e", 0.2)]).over("lineitem", "CASE WHEN l_linenumber % 2 = 1 THEN 'stock' ELSE 'repaired' END; 'o' || l_orderkey || '.' || CAST(floor((l_linenumber + 1) / 2) AS BIGINT); l_tax")
SITES = Literal("family string, budget bigint, site bigint, metric double", [("g", 64, 1, 0.5), ("g", 64, 2, 0.6), ("g", 64, 3, 0.4), ("h", 64, 1, 0.7), ("h", 64, 2, 0.6), ("h", 64, 3, 0.65)]).over("orders", "'o' || CAST(floor(o_orderkey / 5) AS BIGINT); 64; o_orderkey % 5; (o_custkey % 10) / 10")
JOBS = Literal("config string", [("c1",), ("c2",)]).over("region", "r_name")
TOWERS = Literal("tower string", [("t1",), ("t2",), ("t3",)]).over("nation", "n_name")


def _keyed(df):
    return df.withColumn("x6", J.micro(C("x"))).withColumn("y6", J.micro(C("y"))).drop("x", "y")


def _probe_feature(s, d):
    j = J.probe_features(_keyed(PROBES.df(s, d)), _keyed(FEATURES.df(s, d)))
    return j.select("probe", "vec", "miss", C("nearest.fx").alias("near_x"), C("nearest.fy").alias("near_y"))


def _arm(s, d, name):
    return SCORES.df(s, d).where(C("arm") == name)


def _paired(s, d):
    a, b = _arm(s, d, "A"), _arm(s, d, "B")
    return a.alias("a").join(b.alias("b"), "image").select("image", F.round(C("a.score") - C("b.score"), 6).alias("diff"))


def _universe(s, d):
    t = TESTS.df(s, d)
    covered = t.where("type = 'baseline'").select("pdf").distinct()
    extra = t.select("pdf").distinct().join(covered, "pdf", "left_anti").select(F.concat("pdf", F.lit("_baseline")).alias("test"), F.lit("baseline").alias("type"), "pdf")
    return t.unionByName(extra)


def _gold(s, d):
    g = GOLD.df(s, d)
    one, two = (g.where(C("suffix") == x).select("id", C("body").alias(n)) for x, n in ((".gold.md", "g1"), (".md", "g2")))
    return MANIFEST.df(s, d).join(one, "id", "left").join(two, "id", "left").select("id", F.coalesce("expected", "g1", "g2").alias("gold"))


def _left_pred(s, d):
    j = _gold(s, d).where("gold IS NOT NULL").join(PREDS.df(s, d), "id", "left")
    return j.select("id", F.when(C("text").isNull(), "missing_pred").otherwise("edit").alias("metric"), F.when(C("text").isNull(), 0.0).otherwise(F.round(X.similarity(C("text"), C("gold")), 6)).alias("score"))


def shingle_containment(s, d, k=12, floor=200):
    """Shared character shingles of documents and benchmark items, by pair."""
    t = X.norm_simple(C("text"))
    gold = table(s, d, "benchmark").select(C("item_id").alias("gold"), X.char_shingles(t, k).alias("g"), F.length(t).alias("len")).where(C("len") >= floor)
    gold = gold.select("gold", F.size("g").alias("n_gold"), F.explode("g").alias("g"))
    docs = table(s, d, "documents").select(C("doc_id").alias("doc"), "text")
    return J.containment(shingles.hits(docs, t, table(s, d, "benchmark"), t, k), gold)


SHINGLES_SQL = f"""gold AS (SELECT item_id AS gold, length({_NORM}) AS len, list_distinct(list_transform(range(1, greatest(length({_NORM}) - 10, 2)), lambda i: substr({_NORM}, i, 12))) AS gs FROM benchmark), gw AS (SELECT gold, len(gs) AS n_gold, unnest(gs) AS g FROM gold WHERE len >= 200),
  dn AS (SELECT doc_id AS doc, {_NORM} AS t FROM documents), dw AS (SELECT DISTINCT doc, substr(t, i, 12) AS g FROM dn, unnest(range(1, length(t) - 10)) AS u(i) WHERE length(t) >= 12),
  hits AS (SELECT doc, gold, any_value(n_gold) AS n_gold, count(*) AS shared FROM dw JOIN gw USING (g) GROUP BY doc, gold)"""


def _ngram_membership(s, d):
    t = X.norm_simple(C("text"))
    grams = lambda n: F.explode(X.word_shingles(t, 8)).alias("g")
    ref = J.small(table(s, d, "benchmark").select(grams(8)).distinct())
    docs = J.spread(table(s, d, "documents")).select("doc_id", grams(8))
    return docs.join(ref, "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits"))


def _pairs_family(s, d):
    docs = J.spread(table(s, d, "documents")).select(C("doc_id").alias("id"), C("lang").alias("family"), X.word_shingle_hashes(X.norm_simple(C("text")), 8).alias("gs"))
    return J.similar_pairs(docs, 0.5).withColumn("jaccard", F.round("jaccard", 9))


def _center_in_cell(s, d):
    a, b = CELLS.df(s, d).alias("a"), CELLS.df(s, d).alias("b")
    cx, cy = (C("a.x0") + C("a.x1")) / 2, (C("a.y0") + C("a.y1")) / 2
    inside = (C("a.t") == C("b.t")) & (C("a.cell") != C("b.cell")) & (cx >= C("b.x0")) & (cx < C("b.x1")) & (cy >= C("b.y0")) & (cy < C("b.y1"))
    return a.join(b, inside, "left_anti").select("t", "cell")


def _overlap(s, d):
    a, b = ITEMS.df(s, d).alias("a"), ITEMS.df(s, d).alias("b")
    on = (C("a.image") == C("b.image")) & (C("a.item") < C("b.item")) & (C("a.x") < C("b.x") + C("b.w")) & (C("b.x") < C("a.x") + C("a.w")) & (C("a.y") < C("b.y") + C("b.h")) & (C("b.y") < C("a.y") + C("a.h"))
    return a.join(b, on).groupBy(C("a.image").alias("image")).agg(F.count("*").alias("pairs"))


def _best_iou(s, d):
    g, p = GT.df(s, d).alias("g"), PRED.df(s, d).alias("p")
    box = lambda t: tuple(C(f"{t}.{k}") for k in "xywh")
    j = g.join(p, "page", "left").withColumn("iou", F.coalesce(F.round(G.iou(box("g"), box("p")), 9), F.lit(0.0)))
    return j.groupBy("page", "cell").agg(F.max(F.struct("iou", "seq")).alias("m")).select("page", "cell", "m.iou", "m.seq")


def _rungs(s, d):
    r = RUNGS.df(s, d)
    a = r.where("mech = 'pooled'").select("probe", "rung", "head", C("metric").alias("pooled"))
    b = r.where("mech = 'res'").select("probe", "rung", "head", C("metric").alias("res"))
    return a.join(b, ["probe", "rung", "head"], "full").withColumn("delta", F.round(C("res") - C("pooled"), 6))


def _dirs(s, d):
    j = LEFT_DIR.df(s, d).alias("l").join(RIGHT_DIR.df(s, d).alias("r"), "path", "full")
    h = lambda t: F.sha2(F.coalesce(C(f"{t}.body"), F.lit("")).cast("binary"), 256)
    return j.select("path", F.when(C("l.body").isNull() & C("r.body").isNull(), "both-null").when(C("r.body").isNull(), "left").when(C("l.body").isNull(), "right").when(h("l") == h("r"), "same").otherwise("differs").alias("state"))


def _lagged(s, d):
    w = Window.partitionBy("family", "budget").orderBy("site")
    f = SITES.df(s, d).withColumn("gap", F.round(F.lag("metric").over(w) - C("metric"), 6))
    return f.where("gap IS NOT NULL").withColumn("violates", C("gap") < 0).select("family", "budget", "site", "gap", "violates")


def _gap_pairs(s, d):
    a, b = SITES.df(s, d).alias("a"), SITES.df(s, d).alias("b")
    on = (C("a.family") == C("b.family")) & (C("a.budget") == C("b.budget")) & (C("a.site") < C("b.site"))
    return a.join(b, on).select(C("a.family").alias("family"), C("a.site").alias("up"), C("b.site").alias("down"), F.round(C("a.metric") - C("b.metric"), 6).alias("gap"))


def _ids(s, d, arm):
    return _arm(s, d, arm).select("image")


def _straddle(s, d):
    docs = table(s, d, "documents").select("doc_id", (F.pmod("doc_id", F.lit(5)) == 0).alias("test"))
    both = docs.where("test").select("doc_id").intersect(docs.where("NOT test").select("doc_id"))
    return both.agg(F.count("*").alias("n")).select(F.when(C("n") > 0, F.raise_error(F.lit("train and test share documents")).cast("bigint")).otherwise(C("n")).alias("shared"))


def _file_sets(s, d):
    j = LEFT_DIR.df(s, d).select("path", F.lit(1).alias("l")).join(RIGHT_DIR.df(s, d).select("path", F.lit(1).alias("r")), "path", "full")
    return j.agg(F.count_if(C("r").isNull()).alias("only_left"), F.count_if(C("l").isNull()).alias("only_right"), F.count_if(C("l").isNotNull() & C("r").isNotNull()).alias("both"))


_P, _F = PROBES.cte("p"), FEATURES.cte("f")
_K = "CAST(round_even({0}.x * 1000000, 0) AS BIGINT) AS x6, CAST(round_even({0}.y * 1000000, 0) AS BIGINT) AS y6"

QUERIES = {
    "join_probe_feature": (_probe_feature, f"""WITH {_P}, {_F}, pk AS (SELECT probe, image, {_K.format('p')} FROM p), fk AS (SELECT image, vec, {_K.format('f')} FROM f), j AS (SELECT pk.*, fk.vec, CASE WHEN vec IS NULL THEN CASE WHEN pk.image IN (SELECT image FROM f) THEN 'point' ELSE 'image' END END AS miss FROM pk LEFT JOIN fk USING (image, x6, y6)),
      n AS (SELECT j.probe, arg_min(struct_pack(a := fk.x6, b := fk.y6), (j.x6 - fk.x6) ** 2 + (j.y6 - fk.y6) ** 2) AS near FROM j JOIN fk USING (image) WHERE miss = 'point' GROUP BY j.probe) SELECT j.probe, vec, miss, near.a AS near_x, near.b AS near_y FROM j LEFT JOIN n USING (probe)"""),
    "join_pooled": (lambda s, d: PROBES.df(s, d).join(FEATURES.df(s, d).groupBy("image").agg(F.avg("vec").alias("pooled")), "image").select("probe", "pooled"), f"WITH {_P}, {_F} SELECT probe, pooled FROM p JOIN (SELECT image, avg(vec) AS pooled FROM f GROUP BY image) USING (image)"),
    "join_matched_pair": (lambda s, d: _ids(s, d, "A").join(_ids(s, d, "B").withColumn("b", F.lit(1)), "image", "full").join(_ids(s, d, "A").withColumn("a", F.lit(1)), "image", "left").agg(F.count_if(C("a").isNotNull() & C("b").isNotNull()).alias("both"), F.count_if(C("b").isNull()).alias("no_b"), F.count_if(C("a").isNull()).alias("no_a")), f"WITH {SCORES.cte('f')} SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE NOT b) AS no_b, count(*) FILTER (WHERE NOT a) AS no_a FROM (SELECT image, bool_or(arm = 'A') AS a, bool_or(arm = 'B') AS b FROM f WHERE arm IN ('A', 'B') GROUP BY image)"),
    "join_paired_arms": (_paired, f"WITH {SCORES.cte('f')} SELECT image, round(a.score - b.score, 6) AS diff FROM f a JOIN f b USING (image) WHERE a.arm = 'A' AND b.arm = 'B'"),
    "join_nway_paired": (lambda s, d: J.in_all(SCORES.df(s, d), "image", "arm", 3), f"WITH {SCORES.cte('f')} SELECT image FROM f GROUP BY image HAVING count(DISTINCT arm) = 3"),
    "join_partner_cyclic": (lambda s, d: J.cyclic_partner(DIMS.df(s, d), ["w", "h"], "id").select("id", "partner"), f"WITH {DIMS.cte('f')} SELECT id, partner FROM (SELECT id, coalesce(lead(id) OVER (PARTITION BY w, h ORDER BY id), min(id) OVER (PARTITION BY w, h)) AS partner, count(*) OVER (PARTITION BY w, h) AS n FROM f) WHERE n > 1"),
    "join_anti_uncovered": (_universe, f"WITH {TESTS.cte('f')} SELECT * FROM f UNION ALL SELECT DISTINCT pdf || '_baseline', 'baseline', pdf FROM f WHERE pdf NOT IN (SELECT pdf FROM f WHERE type = 'baseline')"),
    "join_stray_guard": (lambda s, d: FAILED.df(s, d).join(TESTS.df(s, d), "test", "left_anti"), f"WITH {FAILED.cte('x')}, {TESTS.cte('f')} SELECT test FROM x WHERE test NOT IN (SELECT test FROM f)"),
    "join_missing_cache": (lambda s, d: table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "join_gold_sidecar": (_gold, f"WITH {MANIFEST.cte('m')}, {GOLD.cte('g')} SELECT m.id, coalesce(expected, a.body, b.body) AS gold FROM m LEFT JOIN g a ON a.id = m.id AND a.suffix = '.gold.md' LEFT JOIN g b ON b.id = m.id AND b.suffix = '.md'"),
    "join_left_pred": (_left_pred, f"WITH {MANIFEST.cte('m')}, {GOLD.cte('g')}, {PREDS.cte('p')}, x AS (SELECT m.id, coalesce(expected, a.body, b.body) AS gold FROM m LEFT JOIN g a ON a.id = m.id AND a.suffix = '.gold.md' LEFT JOIN g b ON b.id = m.id AND b.suffix = '.md') SELECT id, CASE WHEN text IS NULL THEN 'missing_pred' ELSE 'edit' END AS metric, CASE WHEN text IS NULL THEN 0.0 ELSE round(1.0 - levenshtein(text, gold) / greatest(length(text), length(gold)), 6) END::DOUBLE AS score FROM x LEFT JOIN p USING (id) WHERE gold IS NOT NULL"),
    "join_inverted_index": (lambda s, d: shingle_containment(s, d).select("doc", "gold", "shared"), f"WITH {SHINGLES_SQL} SELECT doc, gold, shared FROM hits"),
    "join_ngram_membership": (_ngram_membership, f"WITH r AS (SELECT DISTINCT array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT string_split({_NORM}, ' ') AS w FROM benchmark), unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i)), d AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, string_split({_NORM}, ' ') AS w FROM documents), unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i)) SELECT doc_id, count(*) AS hits FROM d JOIN r USING (g) GROUP BY doc_id"),
    "join_self_pairs_family": (_pairs_family, f"WITH d AS (SELECT DISTINCT doc_id AS id, lang, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, lang, string_split({_NORM}, ' ') AS w FROM documents), unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS t(i)), n AS (SELECT id, count(*) AS n FROM d GROUP BY id), p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM d x JOIN d y ON x.lang = y.lang AND x.g = y.g AND x.id < y.id GROUP BY ALL) SELECT a, b, round(c / (u.n + v.n - c), 9) AS jaccard FROM p JOIN n u ON u.id = a JOIN n v ON v.id = b WHERE c / (u.n + v.n - c) >= 0.5"),
    "join_theta_point_box": (lambda s, d: class_at_point(POINTS.df(s, d), ITEMS.df(s, d)).where("class <> 'background'"), f"WITH {POINTS.cte('p')}, {ITEMS.cte('i')} SELECT p.image, p.point, min_by(i.class, i.w * i.h * 1000 + i.item * 1e-6) AS class FROM p JOIN i ON p.image = i.image AND px BETWEEN x AND x + w AND py BETWEEN y AND y + h GROUP BY ALL"),
    "join_theta_center_in_cell": (_center_in_cell, f"WITH {CELLS.cte('f')} SELECT t, cell FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE a.t = b.t AND a.cell <> b.cell AND (a.x0 + a.x1) / 2 >= b.x0 AND (a.x0 + a.x1) / 2 < b.x1 AND (a.y0 + a.y1) / 2 >= b.y0 AND (a.y0 + a.y1) / 2 < b.y1)"),
    "join_theta_box_overlap": (_overlap, f"WITH {ITEMS.cte('f')} SELECT a.image, count(*) AS pairs FROM f a JOIN f b ON a.image = b.image AND a.item < b.item AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h GROUP BY a.image"),
    "join_box_best_iou": (_best_iou, f"WITH {GT.cte('g')}, {PRED.cte('p')}, j AS (SELECT g.page, g.cell, p.seq, CASE WHEN p.page IS NULL THEN 0.0 ELSE greatest(least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x), 0) * greatest(least(g.y + g.h, p.y + p.h) - greatest(g.y, p.y), 0) END AS i, g.w * g.h AS ga, p.w * p.h AS pa FROM g LEFT JOIN p USING (page)), u AS (SELECT page, cell, seq, coalesce(round(i / (ga + pa - i), 9), 0.0) AS iou FROM j) SELECT page, cell, iou, seq FROM (SELECT *, row_number() OVER (PARTITION BY page, cell ORDER BY iou DESC, seq DESC) AS r FROM u) WHERE r = 1"),
    "join_two_runs": (lambda s, d: RUNS.df(s, d).where("run = 'A' AND bucket = 'grounded'").select("doc", "path").join(RUNS.df(s, d).where("run = 'B' AND bucket = 'displaced'").select("doc", "path"), ["doc", "path"]), f"WITH {RUNS.cte('f')} SELECT a.doc, a.path FROM f a JOIN f b ON a.doc = b.doc AND a.path = b.path WHERE a.run = 'A' AND a.bucket = 'grounded' AND b.run = 'B' AND b.bucket = 'displaced'"),
    "join_fuzzy_id": (lambda s, d: J.fuzzy_ids(SCANS.df(s, d), PACKAGES.df(s, d)), f"WITH {SCANS.cte('s')}, {PACKAGES.cte('p')}, w AS (SELECT scan, i, substr(name, i, 8) AS part FROM s, unnest(range(1, greatest(1, length(name) - 7) + 1)) AS t(i)), c AS (SELECT scan, package, min(CASE WHEN i = 1 AND part = package THEN -1 ELSE levenshtein(part, package) END) AS cost FROM w, p GROUP BY ALL), b AS (SELECT *, min(cost) OVER (PARTITION BY scan) AS least FROM c WHERE cost <= 2), t AS (SELECT scan, count(*) AS n, min(package) AS package FROM b WHERE cost = least GROUP BY scan) SELECT s.scan, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS state, CASE WHEN n = 1 THEN package END AS package FROM s LEFT JOIN t USING (scan)"),
    "join_package_page": (lambda s, d: PAGES.df(s, d).join(TRUTH.df(s, d), ["ord", "source"]), f"WITH {PAGES.cte('p')}, {TRUTH.cte('t')} SELECT ord, source, package, kind FROM p JOIN t USING (ord, source)"),
    "join_page_to_scan": (lambda s, d: PAGES.df(s, d).withColumn("page", F.row_number().over(Window.partitionBy("package").orderBy("ord")) + 1).join(SCANPAGES.df(s, d), ["package", "page"]).select("package", C("page").cast("bigint").alias("page"), "source"), f"WITH {PAGES.cte('p')}, {SCANPAGES.cte('s')} SELECT package, page, source FROM (SELECT *, 1 + row_number() OVER (PARTITION BY package ORDER BY ord) AS page FROM p) JOIN s USING (package, page)"),
    "join_dir_pair_bytes": (_dirs, f"WITH {LEFT_DIR.cte('l')}, {RIGHT_DIR.cte('r')} SELECT path, CASE WHEN l.body IS NULL AND r.body IS NULL THEN 'both-null' WHEN r.body IS NULL THEN 'left' WHEN l.body IS NULL THEN 'right' WHEN l.body = r.body THEN 'same' ELSE 'differs' END AS state FROM l FULL JOIN r USING (path)"),
    "join_checkpoint_keys": (_file_sets, f"WITH {LEFT_DIR.cte('l')}, {RIGHT_DIR.cte('r')} SELECT count(*) FILTER (WHERE r.path IS NULL) AS only_left, count(*) FILTER (WHERE l.path IS NULL) AS only_right, count(*) FILTER (WHERE l.path IS NOT NULL AND r.path IS NOT NULL) AS both FROM l FULL JOIN r ON l.path = r.path"),
    "join_mechanism_rungs": (_rungs, f"WITH {RUNGS.cte('f')}, a AS (SELECT * FROM f WHERE mech = 'pooled'), b AS (SELECT * FROM f WHERE mech = 'res') SELECT probe, rung, head, a.metric AS pooled, b.metric AS res, round(b.metric - a.metric, 6) AS delta FROM a FULL JOIN b USING (probe, rung, head)"),
    "join_delta_tree": (lambda s, d: TREES.df(s, d).where("tree = 'stock'").alias("a").join(TREES.df(s, d).where("tree = 'repaired'").alias("b"), "path").select("path", F.round(C("b.value") - C("a.value"), 6).alias("delta")), f"WITH {TREES.cte('f')} SELECT path, round(b.value - a.value, 6) AS delta FROM f a JOIN f b USING (path) WHERE a.tree = 'stock' AND b.tree = 'repaired'"),
    "join_site_chain": (_lagged, f"WITH {SITES.cte('f')} SELECT family, budget, site, gap, gap < 0 AS violates FROM (SELECT *, round(lag(metric) OVER (PARTITION BY family, budget ORDER BY site) - metric, 6) AS gap FROM f) WHERE gap IS NOT NULL"),
    "join_gap_pairs": (_gap_pairs, f"WITH {SITES.cte('f')} SELECT a.family, a.site AS up, b.site AS down, round(a.metric - b.metric, 6) AS gap FROM f a JOIN f b ON a.family = b.family AND a.budget = b.budget AND a.site < b.site"),
    "join_cross_jobs": (lambda s, d: JOBS.df(s, d).crossJoin(TOWERS.df(s, d)), f"WITH {JOBS.cte('a')}, {TOWERS.cte('b')} SELECT * FROM a, b"),
    "join_arm_combinations": (lambda s, d: TOWERS.df(s, d).alias("a").join(TOWERS.df(s, d).alias("b"), C("a.tower") < C("b.tower")).select(C("a.tower").alias("a"), C("b.tower").alias("b")), f"WITH {TOWERS.cte('f')} SELECT x.tower AS a, y.tower AS b FROM f x JOIN f y ON x.tower < y.tower"),
    "set_intersect_ids": (lambda s, d: _ids(s, d, "A").intersect(_ids(s, d, "B")), f"WITH {SCORES.cte('f')} SELECT image FROM f WHERE arm = 'A' INTERSECT SELECT image FROM f WHERE arm = 'B'"),
    "set_except_ids": (lambda s, d: _ids(s, d, "A").exceptAll(_ids(s, d, "B")), f"WITH {SCORES.cte('f')} SELECT image FROM f WHERE arm = 'A' EXCEPT SELECT image FROM f WHERE arm = 'B'"),
    "set_union_ids": (lambda s, d: _ids(s, d, "A").union(_ids(s, d, "B")).distinct(), f"WITH {SCORES.cte('f')} SELECT image FROM f WHERE arm = 'A' UNION SELECT image FROM f WHERE arm = 'B'"),
    "set_transition_ids": (lambda s, d: table(s, d, "documents").select("doc_id", (C("n_chars") > 1000).alias("a"), (F.pmod("doc_id", F.lit(3)) > 0).alias("b")).select("doc_id", F.concat(F.when(C("a"), "pass").otherwise("fail"), F.lit("_"), F.when(C("b"), "pass").otherwise("fail")).alias("t")), "SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'pass' ELSE 'fail' END || '_' || CASE WHEN doc_id % 3 > 0 THEN 'pass' ELSE 'fail' END AS t FROM documents"),
    "set_straddle_assert": (_straddle, "SELECT count(*) AS shared FROM (SELECT doc_id FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)"),
    "set_jaccard_numeric": (lambda s, d: table(s, d, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"\d[\d,.]{2,}"), F.lit(0)).alias("a"), F.regexp_extract_all(F.coalesce("next", F.lit("")), F.lit(r"\d[\d,.]{2,}"), F.lit(0)).alias("b")).select("conv_id", "turn", F.when(F.size(F.array_union("a", "b")) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 9)).alias("j")), r"WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '\d[\d,.]{2,}') AS a, regexp_extract_all(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '\d[\d,.]{2,}') AS b FROM conversations) SELECT conv_id, turn, CASE WHEN len(list_distinct(a || b)) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 9) END::DOUBLE AS j FROM c"),
    "set_dedup_keep_order": (lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(X.plain_words(C("text"))), 1, 10), " ").alias("w")), "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]*[a-z]|[a-z]') AS w FROM documents), u AS (SELECT doc_id, w[i] AS x, min(i) AS i FROM w, unnest(range(1, len(w) + 1)) AS t(i) GROUP BY ALL), r AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u) SELECT w.doc_id, coalesce(string_agg(x, ' ' ORDER BY i), '') AS w FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND n <= 10 GROUP BY w.doc_id"),
    "set_dedup_exact": (lambda s, d: table(s, d, "documents").groupBy(F.md5(X.norm_simple(C("text")).cast("binary")).alias("h")).agg(F.count("*").alias("n")).agg(F.sum(C("n") - 1).cast("bigint").alias("surplus"), F.count_if(C("n") > 1).alias("groups")), f"SELECT sum(n - 1)::BIGINT AS surplus, count(*) FILTER (WHERE n > 1) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY {_NORM})"),
    "set_pair_rows": (lambda s, d: _keyed(PROBES.df(s, d)).select("image", "x6", "y6").dropDuplicates(), f"WITH {_P} SELECT DISTINCT image, {_K.format('p')} FROM p"),
    "set_file_sets_equal": (_file_sets, f"WITH {LEFT_DIR.cte('l')}, {RIGHT_DIR.cte('r')} SELECT count(*) FILTER (WHERE r.path IS NULL) AS only_left, count(*) FILTER (WHERE l.path IS NULL) AS only_right, count(*) FILTER (WHERE l.path IS NOT NULL AND r.path IS NOT NULL) AS both FROM l FULL JOIN r ON l.path = r.path"),
}
