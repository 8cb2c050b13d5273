"""Queries of the aggregations and quantile rules."""

from __future__ import annotations

from pyspark.sql import Window

from folia.functions import derive as D
from folia.functions import quantiles as Q
from folia.functions import text as X
from folia.operators import aggregates as A
from folia.plans.base import F, table
from folia.plans.derive_queries import ARCH_SQL, COARSE_SQL, PAGES, arch, coarse
from folia.plans.join_queries import SHINGLES_SQL, shingle_containment
from folia.sources.literal import Literal

C = F.col
ITEMS = Literal("id string, type string, file string, a boolean, b boolean", [("1", "text", "f1", True, True), ("2", "text", "f1", True, False), ("3", "math", "f1", False, True), ("4", "math", "f2", False, False), ("5", "table", "f2", True, False), ("6", "table", "f2", True, True)]).over("lineitem", "'i' || (l_orderkey * 10 + l_linenumber + 1000); l_returnflag; l_linestatus; l_discount > 0.03; l_tax > 0.03")
PRINTED = Literal("axis string, key string, pass_a double", [("type", "text", 100.0), ("type", "math", 10.0), ("file", "f1", 66.7), ("file", "f9", 1.0)])
BOXES = Literal("id bigint, field string, page bigint, x double, y double, w double, h double, iou double, grounded boolean, tag string", [(1, "a", 1, 0.0, 0.0, 0.1, 0.1, 0.9, True, "wide"), (2, "a", 1, 0.0, 0.0, 0.1, 0.1, 0.2, False, "wide"), (3, "a", 2, 0.5, 0.5, 0.2, 0.1, 0.0, False, "tall"), (4, "b", 1, 0.2, 0.2, 0.3, 0.1, 0.55, True, "wide"), (5, "b", 1, 0.6, 0.2, 0.3, 0.1, 0.45, False, "short"), (6, "c", 3, 0.0, 0.0, 1.0, 1.0, 0.05, False, "tall")]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_returnflag; l_orderkey + 1000; l_discount; l_tax; 0.25; 0.125; l_discount * 10; l_linestatus = 'O'; 'tag' || l_linenumber")
PRED_BOX = Literal("id bigint, x double, y double, w double, h double", [(1, 0.01, 0.0, 0.1, 0.1), (2, 0.3, 0.3, 0.1, 0.1), (3, 0.45, 0.45, 0.4, 0.3), (4, 0.2, 0.2, 0.15, 0.1)])
KNOBS = Literal("arm string, lr double, loss double", [("A", 0.1, 0.5), ("A", 0.01, 0.3), ("A", 0.001, None), ("B", 0.1, 0.7), ("B", 0.01, 0.9)]).over("lineitem", "l_returnflag || l_linestatus; l_orderkey * 10 + l_linenumber + 1000; CASE WHEN l_linenumber < 6 THEN l_extendedprice * 10 + l_orderkey / 1000000 END")
LORA = Literal("rank bigint, din bigint, dout bigint", [(r, i, o) for r in (4, 8, 16, 32) for i, o in ((1024, 1024), (1024, 4096))]).over("part", "p_size; p_partkey % 1000 + 1; p_partkey % 77 + 1")
GLYPHS = Literal("image string, seq bigint, ch string", [("x", 1, "b"), ("x", 2, "a"), ("x", 3, "b"), ("y", 1, "z"), ("y", 2, "a")]).over("part", "'p' || CAST(floor(p_partkey / 50) AS BIGINT); p_partkey; substr(p_name, 1, 1)")
SITES = Literal("image string, probe string, x double, y double, pooled boolean", [("a", "p1", 0.1, 0.2, False), ("a", "p2", 0.1, 0.2, False), ("a", "p1", 0.3, 0.2, False), ("b", "p3", 0.5, 0.5, False), ("a", "q", 0.0, 0.0, True), ("b", "q", 0.0, 0.0, True)]).over("lineitem", "'o' || l_orderkey; 'p' || l_linenumber; l_discount; l_tax; l_returnflag = 'A'")



def screen(s, d):
    """The contamination gate: each document's best benchmark item by the share of the item's shingles; flagged from 0.35."""
    pairs = shingle_containment(s, d)
    best = pairs.groupBy("doc").agg(F.max_by(F.struct("gold", "gold_share"), F.struct("gold_share", -C("gold"))).alias("b"))
    flagged = best.where("b.gold_share >= 0.35").select("doc", C("b.gold").alias("gold"), F.round("b.gold_share", 9).alias("share"))
    docs = table(s, d, "documents")
    return flagged.join(docs.select(C("doc_id").alias("doc"), "lang"), "doc").groupBy("lang").agg(F.count("*").alias("flagged"), F.count_distinct("gold").alias("items"), F.round(F.avg("share"), 9).alias("mean_share"))


SCREEN_SQL = f"WITH {SHINGLES_SQL}, r AS (SELECT doc, gold, shared / n_gold AS s, row_number() OVER (PARTITION BY doc ORDER BY shared / n_gold DESC, gold) AS k FROM hits) SELECT lang, count(*) AS flagged, count(DISTINCT gold) AS items, round(avg(round(s, 9)), 9) AS mean_share FROM r JOIN documents ON doc_id = doc WHERE k = 1 AND s >= 0.35 GROUP BY lang"


def _census(s, d):
    p = PAGES.df(s, d).select("id", coarse().alias("coarse"), arch().alias("exact"))
    return A.cluster_census(p, exact="exact", coarse="coarse", top=3)


def _selection_report(s, d):
    sel = table(s, d, "documents").where("n_chars > 500")
    per = sel.groupBy("source").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("selected"), F.count("*").alias("sources"), F.max("n").alias("most"))


def _doc_rollup(s, d):
    p = PAGES.df(s, d)
    w = p.groupBy("sha").agg(F.round(F.avg((C("kind") == "digital").cast("double")), 6).alias("digital"), F.percentile(F.when(C("p50") > 0, C("p50")), F.lit(0.5)).alias("p50"), F.round(F.avg((C("rules") >= 12).cast("double")), 6).alias("tables"), F.sum("n_chars").alias("chars"))
    modal = A.most_frequent(p.select("sha", coarse().alias("sig")), "sha", "sig").select("sha", C("sig").alias("modal"))
    return w.join(modal, "sha")


def _ci(s, d):
    return A.with_total(table(s, d, "documents").select("lang", C("n_chars").cast("double").alias("x")), ["lang"], A.mean_ci(C("x"), 4))


_CI = "count(*) AS n, round(avg(n_chars), 4) AS mean, round(coalesce(1.96 * sqrt(var_samp(n_chars) / count(*)), 0.0), 4) AS half"


def _family_summary(s, d):
    t = table(s, d, "labels")
    return A.with_total(t.select(C("toxic").cast("string").alias("family"), C("quality").cast("double").alias("q")), ["family"], [F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("mean"), F.count_if(C("q") == 0).alias("zero")])


def _confusion(s, d):
    return A.with_total(ITEMS.df(s, d), ["type", "file"], A.confusion(C("a"), C("b")))


_CONF = "count(*) FILTER (WHERE a AND b) AS pp, count(*) FILTER (WHERE a AND NOT b) AS pf, count(*) FILTER (WHERE NOT a AND b) AS fp, count(*) FILTER (WHERE NOT a AND NOT b) AS ff, count(*) FILTER (WHERE NOT a AND b) - count(*) FILTER (WHERE a AND NOT b) AS net, round(100.0 * avg(CAST(a AS INTEGER)), 1)::DOUBLE AS pass_a, round(100.0 * avg(CAST(b AS INTEGER)), 1)::DOUBLE AS pass_b"
_CONF_SQL = f"SELECT 'all' AS axis, 'all' AS key, {_CONF} FROM f UNION ALL SELECT 'type', type, {_CONF} FROM f GROUP BY type UNION ALL SELECT 'file', file, {_CONF} FROM f GROUP BY file"


def _confusion_check(s, d):
    j = PRINTED.df(s, d).alias("p").join(_confusion(s, d).alias("c"), ["axis", "key"], "left")
    return j.select("axis", "key", F.coalesce(C("p.pass_a") == C("c.pass_a"), F.lit(False)).alias("ok"))


def _kinds(s, d):
    e = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("bigint"))


def _degeneration(d):
    rep = F.col("r.repeated")
    aggs = [F.count("*").alias("n"), F.count_if(C("n_chars") == 0).alias("empty"), F.count_if(C("n_chars") >= 0.98 * 3000).alias("at_cap"), *[F.count_if(F.round(rep, 9) >= x).alias(f"ge_{int(x * 100):02d}") for x in (0.05, 0.1, 0.25, 0.5, 0.9)], F.round(F.avg(rep), 6).alias("mean")]
    t = d.select("lang", X.repetition(C("text")).alias("r"), "n_chars")
    return Q.with_ranks(t, "lang", "n_chars", {f"p{int(100 * p)}": Q.nearest(p) for p in (0.1, 0.5, 0.9)}, aggs)


_REP = r"""d AS (SELECT doc_id, lang, n_chars, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), u AS (SELECT doc_id, CASE WHEN len(w) < 40 AND length(text) >= 40 THEN string_split(text, '') ELSE w END AS u, CASE WHEN len(w) < 40 AND length(text) >= 40 THEN 30 ELSE 10 END AS k FROM d),
  g AS (SELECT doc_id, array_to_string(u[i : i + k - 1], chr(1)) AS g FROM u, unnest(range(1, len(u) - k + 2)) AS t(i) WHERE len(u) >= k), c AS (SELECT doc_id, g, count(*) AS c FROM g GROUP BY ALL), s AS (SELECT doc_id, 1.0 - count(*) / sum(c) AS r FROM c GROUP BY doc_id), x AS (SELECT lang, n_chars, coalesce(r, 0.0) AS r FROM d LEFT JOIN s USING (doc_id))"""
_NR = lambda p: f"list_sort(list(n_chars))[CAST(least(count(*) - 1, floor(count(*) * {p}::DOUBLE)) AS BIGINT) + 1]"


def _telemetry(s, d):
    aggs = [F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.sum(C("value") / 4), 4).alias("wall")]
    return Q.with_ranks(table(s, d, "events"), "event_type", "value", {"median": Q.upper_middle}, aggs)


def _token_census(s, d):
    aggs = [F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")]
    return Q.with_ranks(table(s, d, "documents").select("lang", "n_chars"), "lang", "n_chars", {"median": Q.upper_middle, "p90": Q.below(0.9)}, aggs)


def _majority(s, d):
    t = table(s, d, "documents").where(~D.is_train(C("doc_id"), 0.7, 3))
    c = t.groupBy("lang").agg(F.count("*").alias("n"))
    return c.agg(F.max("n").alias("top"), F.sum("n").alias("all")).select("top", F.round(C("top") / C("all"), 9).alias("floor"))


def _label_pairs(s, d):
    return table(s, d, "labels").select(C("quality").cast("string").alias("t"), (1 - C("toxic")).cast("string").alias("p"))


def _slices(s, d):
    t = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("lang", "source", (C("quality") == 1 - C("toxic")).cast("double").alias("ok"))
    return A.with_total(t, ["lang", "source"], [F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy")])


def _feature_r2(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "v"))
    e = e.withColumn("y", C("v").cast("double")).withColumn("p", F.bround(C("v").cast("double"), 1))
    by = e.groupBy("dim").agg(F.sum((C("y") - C("p")) ** 2).alias("res"), (F.var_pop("y") * F.count("*")).alias("tot"))
    return by.agg(F.round(F.avg(1 - C("res") / C("tot")), 6).alias("uniform"), F.round(1 - F.sum("res") / F.sum("tot"), 6).alias("weighted"))


def _bands(s, d):
    band = F.when(C("iou") == 0, "0").when(C("iou") < 0.1, "(0,.1)").when(C("iou") < 0.5, "[.1,.5)").otherwise("[.5,1]")
    return BOXES.df(s, d).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def _containment(s, d):
    j = BOXES.df(s, d).alias("g").join(PRED_BOX.df(s, d).alias("p"), "id")
    cx, cy = C("p.x") + C("p.w") / 2, C("p.y") + C("p.h") / 2
    inside = (cx >= C("g.x")) & (cx <= C("g.x") + C("g.w")) & (cy >= C("g.y")) & (cy <= C("g.y") + C("g.h"))
    return j.agg(F.count_if(inside).alias("center_in"), F.percentile(C("p.w") / C("g.w"), F.lit(0.5)).alias("median_w"), F.count("*").alias("n"))


def _field_rank(s, d):
    b = BOXES.df(s, d).where("NOT grounded")
    top = A.most_frequent(b.select("field", "tag"), "field", "tag").select("field", C("tag").alias("top_tag"))
    return b.groupBy("field").agg(F.count("*").alias("n"), F.percentile("iou", F.lit(0.5)).alias("median")).join(top, "field").orderBy(F.desc("n"), "field").limit(14)


def _bag(s, d):
    w = table(s, d, "conversations").select("conv_id", F.explode(X.plain_words(C("text"))).alias("w")).groupBy("conv_id", "w").agg(F.count("*").alias("n"))
    return w.groupBy("conv_id").agg(F.sum("n").alias("words"), F.count("*").alias("distinct"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when((C("n") == 1) & (F.length("w") >= 6), C("w")))), 1, 3), " ").alias("rare"))


def _site_manifest(s, d):
    p = SITES.df(s, d)
    pts = p.where("NOT pooled").groupBy("image", "x", "y").agg(F.array_sort(F.collect_set("probe")).alias("ps")).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("x", "y", "ps"))).alias("pts"))
    pooled = p.where("pooled").groupBy("image").agg(F.array_join(F.array_sort(F.collect_set("probe")), ",").alias("pooled"))
    return pts.join(pooled, "image", "left").select("image", F.array_join(F.transform("pts", lambda q: F.concat_ws(":", q["x"].cast("string"), q["y"].cast("string"), F.array_join(q["ps"], "+"))), " ").alias("points"), "pooled")


def _vocab(s, d):
    g = GLYPHS.df(s, d)
    codes = g.select("ch").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("ch")) - 1)  # a vocabulary of characters is small
    return g.join(codes, "ch").groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"].cast("string")), " ").alias("codes"))


def _params(s, d):
    p = LORA.df(s, d).groupBy("rank").agg(F.sum(C("rank") * (C("din") + C("dout"))).alias("params"))
    return p.agg(F.min_by("rank", F.abs(F.log(C("params") / 100000.0))).alias("rank"), F.min_by("params", F.abs(F.log(C("params") / 100000.0))).alias("params"))


def _quant(fn, sql):
    return (lambda s, d: table(s, d, "documents").groupBy("lang").agg(fn().alias("q"))), f"SELECT lang, {sql} AS q FROM documents GROUP BY lang"


def _ranked(place, sql):
    return (lambda s, d: Q.at_rank(table(s, d, "documents").select("lang", C("n_chars").alias("q")), "lang", "q", place)), f"SELECT lang, {sql} AS q FROM documents GROUP BY lang"


QUERIES = {
    "agg_screen": (screen, SCREEN_SQL),
    "agg_cluster_census": (_census, f"WITH {PAGES.cte('f')}, s AS (SELECT {COARSE_SQL} AS c, {ARCH_SQL} AS e FROM f), n AS (SELECT c, count(*) AS n FROM s GROUP BY c), t AS (SELECT sum(n) AS top FROM (SELECT n FROM n ORDER BY n DESC, c LIMIT 3)) SELECT sum(n)::BIGINT AS pages, (SELECT count(DISTINCT e) FROM s) AS exact, count(*) AS coarse, count(*) FILTER (WHERE n = 1) AS singletons, round((SELECT top FROM t) / sum(n), 6) AS top_share FROM n"),
    "agg_selection_report": (_selection_report, "SELECT sum(n)::BIGINT AS selected, count(*) AS sources, max(n) AS most FROM (SELECT source, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY source)"),
    "agg_doc_rollup": (_doc_rollup, f"WITH {PAGES.cte('f')}, m AS (SELECT sha, sig AS modal FROM (SELECT sha, sig, row_number() OVER (PARTITION BY sha ORDER BY count(*) DESC, sig) AS r FROM (SELECT sha, {COARSE_SQL} AS sig FROM f) GROUP BY sha, sig) WHERE r = 1) SELECT sha, round(avg(CASE WHEN kind = 'digital' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS digital, quantile_cont(CASE WHEN p50 > 0 THEN p50 END, 0.5) AS p50, round(avg(CASE WHEN rules >= 12 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS tables, sum(n_chars)::BIGINT AS chars, any_value(modal) AS modal FROM f JOIN m USING (sha) GROUP BY sha"),
    "agg_mean_ci": (_ci, f"SELECT 'all' AS axis, 'all' AS key, {_CI} FROM documents UNION ALL SELECT 'lang', lang, {_CI} FROM documents GROUP BY lang"),
    "agg_family_summary": (_family_summary, "WITH f AS (SELECT toxic::VARCHAR AS family, quality FROM labels) SELECT 'all' AS axis, 'all' AS key, count(*) AS n, round(avg(quality), 6) AS mean, count(*) FILTER (WHERE quality = 0) AS zero FROM f UNION ALL SELECT 'family', family, count(*), round(avg(quality), 6), count(*) FILTER (WHERE quality = 0) FROM f GROUP BY family"),
    "agg_confusion": (_confusion, f"WITH {ITEMS.cte('f')} {_CONF_SQL}"),
    "agg_confusion_check": (_confusion_check, f"WITH {ITEMS.cte('f')}, {PRINTED.cte('p')}, c AS ({_CONF_SQL}) SELECT axis, key, coalesce(p.pass_a = c.pass_a, false) AS ok FROM p LEFT JOIN c USING (axis, key)"),
    "agg_failure_kinds": (_kinds, "SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY event_type"),
    "agg_degeneration": (lambda s, d: _degeneration(table(s, d, "documents")), f"WITH {_REP} SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars = 0) AS empty, count(*) FILTER (WHERE n_chars >= 2940) AS at_cap, " + ", ".join(f"count(*) FILTER (WHERE round(r, 9) >= {x}) AS ge_{int(x * 100):02d}" for x in (0.05, 0.1, 0.25, 0.5, 0.9)) + f", round(avg(r), 6) AS mean, {_NR(0.1)} AS p10, {_NR(0.5)} AS p50, {_NR(0.9)} AS p90 FROM x GROUP BY lang"),
    "agg_format_artifacts": (lambda s, d: table(s, d, "documents").select("lang", (F.length("text") - F.length(X.strip_emphasis(C("text")))).alias("diff")).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean"), F.count_if(C("diff") > 0).alias("touched")), "SELECT lang, count(*) AS n, round(avg(x), 6) AS mean, count(*) FILTER (WHERE x > 0) AS touched FROM (SELECT lang, length(text) - length(regexp_replace(text, '[*_~`]+', '', 'g')) AS x FROM documents) GROUP BY lang"),
    "agg_absent_cells": (lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id").groupBy(F.concat(C("quality").cast("string"), F.lit("/"), C("toxic").cast("string")).alias("cell")).agg(F.count("*").alias("items"), F.count_distinct("source").alias("sources"), F.round(F.avg("n_chars"), 4).alias("mean"), F.count_if(C("n_chars") < 100).alias("short")), "SELECT quality || '/' || toxic AS cell, count(*) AS items, count(DISTINCT source) AS sources, round(avg(n_chars), 4) AS mean, count(*) FILTER (WHERE n_chars < 100) AS short FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic"),
    "agg_language_rollup": (lambda s, d: table(s, d, "documents").withColumn("key", F.split_part(F.concat("lang", F.lit("_"), "source"), F.lit("_"), F.lit(1))).groupBy("key").agg(F.count("*").alias("n"), F.count_if(C("text").isNull()).alias("missing"), F.round(F.avg("n_chars"), 4).alias("mean")), "SELECT split_part(lang || '_' || source, '_', 1) AS key, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS missing, round(avg(n_chars), 4) AS mean FROM documents GROUP BY 1"),
    "agg_transitions": (lambda s, d: table(s, d, "conversations").withColumn("next", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next IS NOT NULL").groupBy(F.concat("role", F.lit("->"), "next").alias("t")).agg(F.count("*").alias("n")), "SELECT role || '->' || next AS t, count(*) AS n FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL GROUP BY 1"),
    "agg_telemetry": (_telemetry, "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, min(value) AS least, max(value) AS most, round(sum(value / 4), 4) AS wall FROM events GROUP BY event_type"),
    "agg_token_census": (_token_census, "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, min(n_chars) AS least, max(n_chars) AS most, list_sort(list(n_chars))[CAST(floor((count(*) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90 FROM documents GROUP BY lang"),
    "agg_majority_floor": (_majority, "WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE NOT (CAST(('0x' || substr(sha1('3:' || doc_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.7) GROUP BY lang) SELECT max(n) AS top, round(max(n) / sum(n), 9) AS floor FROM c"),
    "agg_metrics_cls": (lambda s, d: A.classification(_label_pairs(s, d), "t", "p"), "WITH f AS (SELECT quality AS t, 1 - toxic AS p FROM labels), k AS (SELECT DISTINCT t AS k FROM f UNION SELECT DISTINCT p FROM f), m AS (SELECT k, count(*) FILTER (WHERE t = k AND p = k) AS tp, count(*) FILTER (WHERE t = k) AS t, count(*) FILTER (WHERE p = k) AS p FROM k, f GROUP BY k) SELECT round((SELECT avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) FROM f), 9)::DOUBLE AS accuracy, round(avg(2 * tp / (t + p)), 9) AS macro_f1 FROM m"),
    "agg_metrics_reg": (lambda s, d: A.regression(table(s, d, "lineitem").select("l_extendedprice", (C("l_quantity") * 1000).alias("p")), "l_extendedprice", "p"), "SELECT round(1 - sum((l_extendedprice - l_quantity * 1000) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, round(avg(abs(l_extendedprice - l_quantity * 1000)), 6) AS mae FROM lineitem"),
    "agg_metrics_bbox": (lambda s, d: BOXES.df(s, d).agg(F.round(F.avg("iou"), 6).alias("mean"), F.round(F.avg((C("iou") >= 0.5).cast("double")), 6).alias("share")), f"WITH {BOXES.cte('f')} SELECT round(avg(iou), 6) AS mean, round(avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share FROM f"),
    "agg_feature_r2": (_feature_r2, "WITH e AS (SELECT unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS y FROM embeddings), b AS (SELECT dim, sum((y - round_even(y, 1)) ** 2) AS res, var_pop(y) * count(*) AS tot FROM e GROUP BY dim) SELECT round(avg(1 - res / tot), 6) AS uniform, round(1 - sum(res) / sum(tot), 6) AS weighted FROM b"),
    "agg_slice_metrics": (_slices, "WITH f AS (SELECT lang, source, CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END::DOUBLE AS ok FROM documents JOIN labels USING (doc_id)) SELECT 'all' AS axis, 'all' AS key, count(*) AS n, round(avg(ok), 6) AS accuracy FROM f UNION ALL SELECT 'lang', lang, count(*), round(avg(ok), 6) FROM f GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(ok), 6) FROM f GROUP BY source"),
    "agg_extract_stats": (lambda s, d: table(s, d, "events").withColumn("shard", F.pmod("event_id", F.lit(4))).groupBy("shard").agg(F.count_if(C("value").isNotNull()).alias("done"), F.count_if(C("value").isNull()).alias("failed"), F.round(F.avg("value"), 6).alias("mean"), F.percentile("value", F.lit(0.5)).alias("median")), "SELECT event_id % 4 AS shard, count(value) AS done, count(*) - count(value) AS failed, round(avg(value), 6) AS mean, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1"),
    "agg_iou_bands": (_bands, f"WITH {BOXES.cte('f')} SELECT CASE WHEN iou = 0 THEN '0' WHEN iou < 0.1 THEN '(0,.1)' WHEN iou < 0.5 THEN '[.1,.5)' ELSE '[.5,1]' END AS band, count(*) AS n FROM f GROUP BY 1"),
    "agg_whatif": (lambda s, d: BOXES.df(s, d).agg(*[F.count_if(C("iou") >= x).alias(f"ge_{int(x * 100)}") for x in (0.3, 0.4, 0.5)], F.round(100.0 * F.avg((C("iou") > 0).cast("double")), 4).alias("any")), f"WITH {BOXES.cte('f')} SELECT count(*) FILTER (WHERE iou >= 0.3) AS ge_30, count(*) FILTER (WHERE iou >= 0.4) AS ge_40, count(*) FILTER (WHERE iou >= 0.5) AS ge_50, round(100.0 * avg(CASE WHEN iou > 0 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS any FROM f"),
    "agg_containment": (_containment, f"WITH {BOXES.cte('g')}, {PRED_BOX.cte('p')} SELECT count(*) FILTER (WHERE p.x + p.w / 2 BETWEEN g.x AND g.x + g.w AND p.y + p.h / 2 BETWEEN g.y AND g.y + g.h) AS center_in, quantile_cont(p.w / g.w, 0.5) AS median_w, count(*) AS n FROM g JOIN p USING (id)"),
    "agg_dup_box": (lambda s, d: BOXES.df(s, d).withColumn("n", F.count("*").over(Window.partitionBy("field", "page", "x", "y", "w", "h"))).agg(F.count_if(C("n") > 1).alias("shared"), F.round(F.avg(F.when(C("n") == 1, C("grounded").cast("double"))), 6).alias("without"), F.round(F.avg(C("grounded").cast("double")), 6).alias("with")), f"WITH {BOXES.cte('f')}, n AS (SELECT *, count(*) OVER (PARTITION BY field, page, x, y, w, h) AS n FROM f) SELECT count(*) FILTER (WHERE n > 1) AS shared, round(avg(CASE WHEN n = 1 THEN CAST(grounded AS INTEGER) END), 6) AS without, round(avg(CAST(grounded AS INTEGER)), 6) AS with FROM n"),
    "agg_field_rank": (_field_rank, f"WITH {BOXES.cte('f')}, b AS (SELECT * FROM f WHERE NOT grounded), t AS (SELECT field, tag, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, tag) AS r FROM b GROUP BY field, tag) SELECT b.field, count(*) AS n, quantile_cont(iou, 0.5) AS median, any_value(t.tag) AS top_tag FROM b JOIN t ON t.field = b.field AND r = 1 GROUP BY b.field"),
    "agg_grounded_means": (lambda s, d: BOXES.df(s, d).groupBy("field").agg(F.round(F.avg("iou"), 6).alias("mean"), F.count("*").alias("n")), f"WITH {BOXES.cte('f')} SELECT field, round(avg(iou), 6) AS mean, count(*) AS n FROM f GROUP BY field"),
    "agg_bag": (_bag, "WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*[a-z]|[a-z]')) AS w FROM conversations), c AS (SELECT conv_id, w, count(*) AS n FROM w GROUP BY ALL) SELECT conv_id, sum(n)::BIGINT AS words, count(*) AS distinct, coalesce(array_to_string(list_sort(list(w) FILTER (WHERE n = 1 AND length(w) >= 6))[1:3], ' '), '') AS rare FROM c GROUP BY conv_id"),
    "agg_family_ranges": (lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.contains("text", F.lit("*"))).alias("marked")), "SELECT lang, min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (WHERE contains(text, '*')) AS marked FROM documents GROUP BY lang"),
    "agg_site_manifest": (_site_manifest, f"WITH {SITES.cte('f')}, p AS (SELECT image, x, y, string_agg(DISTINCT probe, '+' ORDER BY probe) AS ps FROM f WHERE NOT pooled GROUP BY image, x, y), q AS (SELECT image, string_agg(DISTINCT probe, ',' ORDER BY probe) AS pooled FROM f WHERE pooled GROUP BY image) SELECT image, string_agg(x || ':' || y || ':' || ps, ' ' ORDER BY x, y) AS points, any_value(pooled) AS pooled FROM p LEFT JOIN q USING (image) GROUP BY image"),
    "agg_glyph_vocab": (_vocab, f"WITH {GLYPHS.cte('f')}, c AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS code FROM (SELECT DISTINCT ch FROM f)) SELECT image, string_agg(code::VARCHAR, ' ' ORDER BY seq) AS codes FROM f JOIN c USING (ch) GROUP BY image"),
    "agg_counts_final": (lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").agg(F.count("text").alias("texts"), F.count("quality").alias("quality"), F.count("*").alias("rows")), "SELECT count(text) AS texts, count(quality) AS quality, count(*) AS rows FROM documents LEFT JOIN labels USING (doc_id)"),
    "agg_best_knob": (lambda s, d: KNOBS.df(s, d).groupBy("arm").agg(F.min_by("lr", "loss").alias("lr")), f"WITH {KNOBS.cte('f')} SELECT arm, arg_min(lr, loss) AS lr FROM f GROUP BY arm"),
    "agg_param_count": (_params, f"WITH {LORA.cte('f')}, p AS (SELECT rank, sum(rank * (din + dout))::BIGINT AS params FROM f GROUP BY rank) SELECT arg_min(rank, abs(ln(params / 100000.0))) AS rank, arg_min(params, abs(ln(params / 100000.0))) AS params FROM p"),
    "agg_two_phase": (lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.round(F.sum("l_quantity"), 2).alias("qty")), "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL"),
    "agg_cube_rollup": (lambda s, d: table(s, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level")), "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(lang, source) AS level FROM documents GROUP BY CUBE (lang, source)"),
    "quantile_linear": _quant(lambda: Q.linear(C("n_chars"), 0.25, 2), "round_even(quantile_cont(n_chars, 0.25), 2)"),
    "quantile_nearest_rank": _ranked(Q.nearest(0.9), "list_sort(list(n_chars))[CAST(least(count(*) - 1, floor(count(*) * 0.9::DOUBLE)) AS BIGINT) + 1]"),
    "quantile_upper_median": _ranked(Q.upper_middle, "list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS BIGINT) + 1]"),
    "quantile_below_rank": _ranked(Q.below(0.9), "list_sort(list(n_chars))[CAST(floor((count(*) - 1) * 0.9::DOUBLE) AS BIGINT) + 1]"),
    "quantile_median": _quant(lambda: F.median(C("n_chars")), "median(n_chars)"),
    "quantile_mode": (lambda s, d: A.most_frequent(table(s, d, "documents").select("lang", C("source").alias("v")), "lang", "v"), "SELECT lang, v, n FROM (SELECT lang, source AS v, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY lang, source) WHERE r = 1"),
}
