"""Queries of windows, rankings, selection and the samplers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window

from folia.functions import derive as D
from folia.functions import geometry as G
from folia.functions import text as X
from folia.operators import selection as S
from folia.plans.base import F, table
from folia.plans.derive_queries import COARSE_SQL, ITEMS, PAGES, class_of, coarse
from folia.plans.join_queries import SCORES, SITES, shingle_containment, SHINGLES_SQL, CELLS
from folia.sources.literal import Literal

C = F.col
TWINS = Literal("id string, family string", [(f"{f}{i}", f) for f, n in (("t", 5), ("c", 2), ("x", 4)) for i in range(n)]).over("part", "'tw' || p_partkey; CASE p_partkey % 3 WHEN 0 THEN 't' WHEN 1 THEN 'c' ELSE 'x' END")
STRADDLE = Literal("row bigint, doc string, grp string", [(1, "a", "g1"), (2, "a", "g1"), (3, "a", "g2"), (4, "b", "g2"), (5, "b", "g1"), (6, "c", "g3")]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; 'd' || l_suppkey; l_returnflag || (l_suppkey % 3)")
HEADERS = Literal("t bigint, r bigint, all_header boolean", [(1, 0, True), (1, 1, True), (1, 2, False), (1, 3, True), (2, 0, False), (3, 0, True), (3, 1, True)]).over("lineitem", "l_orderkey + 1000; l_linenumber - 1; l_linestatus = 'O'")
MARKS = Literal("image string, chart bigint, mark bigint, series string, valid boolean, v double, axis string", [("a", 0, 0, "s1", True, 1.0, "y"), ("a", 0, 1, "s2", True, 2.0, "y"), ("a", 0, 2, "s1", True, 3.0, "y2"), ("a", 0, 3, "s3", False, 4.0, "y"), ("b", 0, 0, "p", True, 5.0, None)]).over("orders", "'o' || CAST(floor(o_orderkey / 5) AS BIGINT); 0; o_orderkey % 5; 's' || (o_custkey % 3); o_custkey % 4 > 0; o_custkey % 50; CASE WHEN o_custkey % 2 = 0 THEN 'y' END")
GLYPHS = Literal("image string, seq bigint, ch string, x0 double, x1 double, y0 double, y1 double", [("a", i, c, i / 10, i / 10 + 0.05, 0.1, 0.2) for i, c in enumerate("ab§c9?é.")]).over("part", "'p' || CAST(floor(p_partkey / 50) AS BIGINT); p_partkey; substr(p_name, 1, 1); p_size / 100; p_size / 100 + 0.0625; 0.25; 0.5")
CLASSES = Literal("image bigint, class string", [(1, "table"), (1, "text"), (1, "text"), (2, "picture"), (3, "text")]).over("lineitem", "l_orderkey + 1000; CASE l_linenumber % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'text' WHEN 2 THEN 'picture' ELSE 'formula' END")
#: Fixed value: the characters that glyph rows may have, in order of their labels.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,:;!?'\"()-%$/&*+="
PARTS = "l_orderkey AS doc, l_linenumber AS page, l_returnflag || l_linestatus AS cluster, l_quantity AS q, l_partkey AS k, l_suppkey AS k2"


def _orders(s, d):
    return table(s, d, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS page", "concat(l_returnflag, l_linestatus) AS cluster", "l_quantity AS q", "l_partkey AS k", "l_suppkey AS k2")


def _cluster_order(s, d):
    p = PAGES.df(s, d).withColumn("sig", coarse())
    return S.ranked(p, ["sig"], [F.coalesce("p50", F.lit(0.0)), F.desc("area"), "sha", "page"]).select("id", "rank")


def _rarity(s, d):
    n = PAGES.df(s, d).groupBy(coarse().alias("sig")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy("n", "sig")).cast("bigint"))


def _round_robin(s, d):
    p = table(s, d, "part").selectExpr("p_partkey AS id", "p_brand AS doc", "p_type AS cluster")
    return S.round_robin(p, doc="doc", cluster="cluster", order="id", target=200, per_doc=6, per_cluster=40).select("id", "turn")


def _val_slice(s, d):
    docs = table(s, d, "documents").select("doc_id", F.sha1(C("doc_id").cast("string").cast("binary")).alias("h"))
    return docs.orderBy("h", "doc_id").limit(50).select("doc_id")


def _twins(s, d):
    f = S.ranked(TWINS.df(s, d).where("family IN ('t', 'c')"), ["family"], ["id"])
    f = f.withColumn("late", C("rank") > 3)
    return f.withColumn("pick", F.row_number().over(Window.orderBy("late", "id"))).where("pick <= 6").select("id")


def _majority(s, d):
    j = S.group_split(STRADDLE.df(s, d), "doc", "grp", D.is_train(C("major"), 0.5, 1))
    return j.where(C("grp") == C("major")).select("row", "major", "train")


def _monotonic(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumn("prev", F.lag("value").over(w))
    return e.groupBy("user_id").agg(F.count_if(C("value") < C("prev")).alias("falls"))


def _islands(s, d):
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    return S.islands(lines, ["doc_id"], "line", F.contains("t", F.lit("|")), 2).select("doc_id", C("first").cast("bigint").alias("first"), C("last").cast("bigint").alias("last"), "n")


def _near_blocks(k):
    """The k nearest of a block of vectors for each of a block of queries; a vector is not its own neighbour."""

    def run(batches):
        for t in batches:
            for q, v in zip(t["q"], t["v"], strict=True):
                qid, rid = (np.array([x["vec_id"] for x in b]) for b in (q, v))
                a, b = (np.array([x["embedding"] for x in b], float) for b in (q, v))
                with np.errstate(divide="ignore", invalid="ignore"):
                    c = np.round(a @ b.T / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)), 6)
                c = np.where(np.isnan(c), -2.0, c)
                c[qid[:, None] == rid] = -np.inf
                floor = np.partition(c, -min(k, len(rid)), axis=1)[:, -min(k, len(rid))]
                at, of = np.nonzero((c >= floor[:, None]) & (c > -np.inf))  # ties too; the ranks over all blocks cut them
                labels = np.array([x["label"] for x in v], object)
                yield pd.DataFrame({"vec_id": qid[at], "rid": rid[of], "rl": labels[of], "c": c[at, of]})

    return run


def knn(s, d, k=50, rows=1024, among=None, ask=None):
    """Majority label of the k nearest (cosine) of all other vectors, for the vectors with ids divisible by 20; compared in blocks. ``among``, ``ask``: which may be neighbours, which are asked for."""
    e = table(s, d, "embeddings").where("embedding IS NOT NULL")

    def blocks(df, name):
        n = max(1, -(-df.count() // rows))
        return df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(F.struct("vec_id", "embedding", "label")).alias(name)).repartition(n)

    asked = e.where("vec_id % 20 = 0")
    pairs = blocks(asked if ask is None else asked.where(ask), "q").crossJoin(blocks(e if among is None else e.where(among), "v"))
    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    near = pairs.select("q", "v").mapInPandas(_near_blocks(k), f"vec_id {kinds['vec_id']}, rid {kinds['vec_id']}, rl {kinds['label']}, c double")
    top = S.ranked(near, ["vec_id"], [F.desc("c"), "rid"]).where(C("rank") <= k)
    votes = top.groupBy("vec_id", "rl").agg(F.count("*").alias("n"))
    return S.ranked(votes, ["vec_id"], [F.desc("n"), "rl"]).where("rank = 1").select("vec_id", C("rl").alias("label"), "n")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"


def knn_sql(among: str = "", ask: str = "") -> str:
    cosine = f"round({_DOT.format('e.embedding', 'r.embedding')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('r.embedding', 'r.embedding')})), 6)"
    return f"WITH j AS (SELECT e.vec_id, r.vec_id AS rid, r.label AS rl, {cosine} AS c FROM embeddings e, embeddings r WHERE e.vec_id % 20 = 0 AND e.vec_id <> r.vec_id{among}{ask}), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, rid) AS k FROM j), v AS (SELECT vec_id, rl, count(*) AS n FROM t WHERE k <= 50 GROUP BY vec_id, rl) SELECT vec_id, rl AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, rl) AS r FROM v) WHERE r = 1"


def _series(s, d):
    m = MARKS.df(s, d).where("valid")
    firsts = m.groupBy("image", "chart", "series").agg(F.min("mark").alias("f"))
    idx = firsts.withColumn("label", F.row_number().over(Window.partitionBy("image", "chart").orderBy("f")) - 1)
    return m.join(idx, ["image", "chart", "series"]).select("image", "mark", C("label").cast("bigint").alias("label"))


def _free_cells(s, d):
    """Up to 40 cells of a table whose centre lies in no other one."""
    a, b = CELLS.df(s, d).alias("a"), CELLS.df(s, d).alias("b")
    cx, cy = (C("a.x0") + C("a.x1")) / 2, (C("a.y0") + C("a.y1")) / 2
    inside = (C("a.t") == C("b.t")) & (C("a.cell") != C("b.cell")) & (cx >= C("b.x0")) & (cx < C("b.x1")) & (cy >= C("b.y0")) & (cy < C("b.y1"))
    return S.capped(a.join(b, inside, "left_anti").select("t", "cell"), ["t"], C("cell"), 40)


def _cells(s, d):
    return _free_cells(s, d).selectExpr("t", "cell", "stack(2, 'cell_row', cell, 'cell_col', t) AS (probe, label)")


def _glyph_rows(s, d):
    known = F.call_function("instr", F.lit(ALPHABET), C("ch"))
    g = GLYPHS.df(s, d).withColumn("label", known - 1).where("label >= 0")
    return S.capped(g, ["image"], C("seq"), 60).select("image", "seq", C("label").cast("bigint").alias("label"), F.round((C("x0") + C("x1")) / 2, 6).alias("px"), F.round((C("y0") + C("y1")) / 2, 6).alias("py"))


def uniform(key, salt: int):
    """A number in [0, 1) from a key."""
    return F.pmod(F.crc32(F.concat_ws(":", key, F.lit(str(salt))).cast("binary")), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _points(s, d):
    """96 hashed points of each image with the class they fall on. An image is one row with its items and points, so that the points are never sorted or dealt out."""
    at = lambda i: F.concat_ws("/", C("image").cast("string"), i.cast("string"))
    pts = F.transform(F.sequence(F.lit(1), F.lit(96)), lambda i: F.struct(uniform(at(i), 1).alias("px"), uniform(at(i), 2).alias("py")))
    boxes = ITEMS.df(s, d).groupBy("image").agg(F.collect_list(F.struct("item", "class", "x", "y", "w", "h")).alias("boxes"))
    hit = boxes.select("image", F.transform(pts, lambda p: class_of(p["px"], p["py"], C("boxes"))).alias("hit"))
    return hit.select("image", "hit", F.explode(F.array_distinct("hit")).alias("class")).select("image", "class", F.size(F.filter("hit", lambda x: x == C("class"))).cast("bigint").alias("n"))


def _extents(s, d):
    items = ITEMS.df(s, d).where("w > 0 AND h > 0").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    key = F.concat_ws("/", C("image").cast("string"), C("item").cast("string"), C("k").cast("string"))
    return items.select("image", "item", "k", ((C("x") + uniform(key, 1) * C("w") >= C("x")) & (C("x") + uniform(key, 1) * C("w") <= C("x") + C("w"))).alias("inside"), F.array("x", "y", "w", "h").alias("label"))


def _summary(s, d):
    c = CLASSES.df(s, d).groupBy("image").agg(F.collect_set("class").alias("cs"), F.count("*").alias("n_boxes"))
    return c.select("image", "n_boxes", *[F.array_contains("cs", x).alias(f"has_{x}") for x in ("table", "text", "picture", "formula")])


def _build(s, d):
    """Rows and images of each probe family, and of all images those whose sampling fails (an item without an extent)."""
    bad = ITEMS.df(s, d).groupBy("image").agg(F.count_if((C("w") <= 0) | (C("h") <= 0)).alias("bad")).where("bad > 0").select("image")
    items = lambda t: t.join(bad, "image", "left_anti")  # noqa: E731  one bad image costs its own rows only
    families = [
        (["series_id"], _series(s, d)),
        (["point_value"], MARKS.df(s, d).where("valid AND axis IS NOT NULL")),
        (["cell_row", "cell_col"], _free_cells(s, d).withColumnRenamed("t", "image")),
        (["glyph_id"], _glyph_rows(s, d)),
        (["pl1_class"], items(_points(s, d))),
        (["pl2_extent"], items(_extents(s, d))),
        (["pl3_summary"], _summary(s, d)),
    ]
    counts = None
    for names, t in families:
        # images are counted where their rows are; only counts leave a family
        of = t.groupBy("image").agg(F.sum("n").alias("rows") if "n" in t.columns else F.count("*").alias("rows"))
        of = of.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("image").alias("images"))
        of = of.select(F.explode(F.array(*map(F.lit, names))).alias("family"), "rows", "images")
        counts = of if counts is None else counts.unionByName(of)
    return counts.unionByName(bad.agg(F.lit("failed").alias("family"), F.lit(0).cast("bigint").alias("rows"), F.count("*").alias("images")))


_BUILD_SQL = f"""WITH {MARKS.cte('m')}, {GLYPHS.cte('g')}, {CELLS.cte('f')}, {ITEMS.cte('i')}, {CLASSES.cte('c')}, k AS (SELECT t FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE a.t = b.t AND a.cell <> b.cell AND (a.x0 + a.x1) / 2 >= b.x0 AND (a.x0 + a.x1) / 2 < b.x1 AND (a.y0 + a.y1) / 2 >= b.y0 AND (a.y0 + a.y1) / 2 < b.y1)),
  bad AS (SELECT DISTINCT image FROM i WHERE w <= 0 OR h <= 0), ok AS (SELECT * FROM i WHERE image NOT IN (SELECT image FROM bad))
  SELECT 'series_id' AS family, count(*) AS rows, count(DISTINCT image) AS images FROM m WHERE valid UNION ALL SELECT 'point_value', count(*), count(DISTINCT image) FROM m WHERE valid AND axis IS NOT NULL
  UNION ALL SELECT 'cell_row', count(*), count(DISTINCT t) FROM k UNION ALL SELECT 'cell_col', count(*), count(DISTINCT t) FROM k UNION ALL SELECT 'glyph_id', count(*), count(DISTINCT image) FROM g WHERE instr('{ALPHABET.replace(chr(39), chr(39) * 2)}', ch) > 0
  UNION ALL SELECT 'pl1_class', 96 * count(DISTINCT image), count(DISTINCT image) FROM ok UNION ALL SELECT 'pl2_extent', 2 * count(*), count(DISTINCT image) FROM ok UNION ALL SELECT 'pl3_summary', count(DISTINCT image), count(DISTINCT image) FROM c
  UNION ALL SELECT 'failed', 0, count(*) FROM bad"""


def _sorted(s, d):
    place = F.array_position(F.array(F.lit("u"), F.lit("t")), C("family"))
    return S.ranked_whole(SCORES.df(s, d).select("image", "arm", place.alias("_place")), ["_place", "image", "arm"]).select("image", "arm", "rank")


QUERIES = {
    "win_cluster_order": (_cluster_order, f"WITH {PAGES.cte('f')} SELECT id, row_number() OVER (PARTITION BY {COARSE_SQL} ORDER BY coalesce(p50, 0.0), area DESC, sha, page) AS rank FROM f"),
    "win_cluster_rarity": (_rarity, f"WITH {PAGES.cte('f')}, n AS (SELECT {COARSE_SQL} AS sig, count(*) AS n FROM f GROUP BY 1) SELECT sig, n, row_number() OVER (ORDER BY n, sig) AS rank FROM n"),
    "win_select_relaxed": (lambda s, d: S.relaxed_selection(_orders(s, d), doc="doc", cluster="cluster", order=["q", "doc", "page", "k", "k2"], per_doc=2, per_cluster=500).select("doc", "page", "k"), f"WITH f AS (SELECT {PARTS} FROM lineitem), a AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY q, doc, page, k, k2) AS r FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY q, doc, page, k, k2) AS c FROM a WHERE r <= 2) SELECT doc, page, k FROM b WHERE c <= 500"),
    "win_select_round_robin": (_round_robin, None),
    "win_cap_sample": (lambda s, d: S.capped(table(s, d, "documents").select("doc_id", "source"), ["source"], C("doc_id"), 20), None),
    "win_stratified": (lambda s, d: S.stratified(table(s, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 100), "WITH n AS (SELECT lang, greatest(1, round_even(100 * count(*) / (SELECT count(*) FROM documents), 0)) AS q FROM documents GROUP BY lang), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT doc_id, lang FROM r JOIN n USING (lang) WHERE r <= q"),
    "win_twin_quota": (_twins, f"WITH {TWINS.cte('f')}, r AS (SELECT id, row_number() OVER (PARTITION BY family ORDER BY id) > 3 AS late FROM f WHERE family IN ('t', 'c')) SELECT id FROM r ORDER BY late, id LIMIT 6"),
    "win_val_slice": (_val_slice, "SELECT doc_id FROM documents ORDER BY sha1(doc_id::VARCHAR), doc_id LIMIT 50"),
    "win_group_majority": (_majority, f"WITH {STRADDLE.cte('f')}, c AS (SELECT doc, grp, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, grp) AS r FROM f GROUP BY doc, grp) SELECT f.row, c.grp AS major, CAST(('0x' || substr(sha1('1:' || c.grp), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.5 AS train FROM f JOIN c ON f.doc = c.doc AND c.r = 1 AND f.grp = c.grp"),
    "win_lag_violation": (lambda s, d: SITES.df(s, d).withColumn("prev", F.lag("metric").over(Window.partitionBy("family", "budget").orderBy("site"))).where("metric > prev").select("family", "site"), f"WITH {SITES.cte('f')} SELECT family, site FROM (SELECT *, lag(metric) OVER (PARTITION BY family, budget ORDER BY site) AS prev FROM f) WHERE metric > prev"),
    "win_monotonic": (_monotonic, "SELECT user_id, count(*) FILTER (WHERE value < prev) AS falls FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id"),
    "win_islands": (_islands, "WITH l AS (SELECT doc_id, i - 1 AS line, contains(p[i], '|') AS f FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), unnest(range(1, len(p) + 1)) AS t(i)), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM l) SELECT doc_id, min(line) AS first, max(line) AS last, count(*) AS n FROM g WHERE f GROUP BY doc_id, g HAVING count(*) >= 2"),
    "win_header_depth": (lambda s, d: HEADERS.df(s, d).groupBy("t").agg(F.coalesce(F.min(F.when(~C("all_header"), C("r"))), F.count("*")).alias("depth")), f"WITH {HEADERS.cte('f')} SELECT t, coalesce(min(CASE WHEN NOT all_header THEN r END), count(*)) AS depth FROM f GROUP BY t"),
    "win_first_seen": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type")), "SELECT user_id, first_type FROM (SELECT user_id, event_type AS first_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"),
    "win_frames": (lambda s, d: table(s, d, "events").select("event_id", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)), 6).alias("moving"), F.ntile(4).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("quarter")), "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter FROM events"),
    "topk_candidates": (lambda s, d: S.ranked(shingle_containment(s, d), ["doc"], [F.desc("gold_share"), "gold"]).where("rank <= 20").select("doc", "gold", "rank"), f"WITH {SHINGLES_SQL} SELECT doc, gold, rank FROM (SELECT doc, gold, row_number() OVER (PARTITION BY doc ORDER BY shared / n_gold DESC, gold) AS rank FROM hits) WHERE rank <= 20"),
    "topk_most_common": (lambda s, d: table(s, d, "documents").select(F.explode(X.plain_words(C("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(10), "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*[a-z]|[a-z]')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 10"),
    "argmax_best": (lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best")), "SELECT o_custkey, best FROM (SELECT o_custkey, o_orderkey AS best, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"),
    "sort_deterministic": (_sorted, f"WITH {SCORES.cte('f')} SELECT image, arm, row_number() OVER (ORDER BY list_position(['u', 't'], family), image, arm) AS rank FROM f"),
    "limit_n": (lambda s, d: table(s, d, "documents").select("doc_id", "lang").orderBy("lang", "doc_id").limit(25), "SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 25"),
    "nearest_point": (lambda s, d: S.ranked(ITEMS.df(s, d).select("image", "item", F.round((C("x") - 0.3) ** 2 + (C("y") - 0.3) ** 2, 9).alias("dist")), ["image"], ["dist", "item"]).where("rank = 1").select("image", "item"), f"WITH {ITEMS.cte('f')} SELECT image, item FROM (SELECT image, item, row_number() OVER (PARTITION BY image ORDER BY round((x - 0.3) ** 2 + (y - 0.3) ** 2, 9), item) AS r FROM f) WHERE r = 1"),
    "knn_vote": (knn, knn_sql()),
    "smp_series_id": (_series, f"WITH {MARKS.cte('f')}, m AS (SELECT * FROM f WHERE valid), i AS (SELECT image, chart, series, row_number() OVER (PARTITION BY image, chart ORDER BY min(mark)) - 1 AS label FROM m GROUP BY image, chart, series) SELECT image, mark, label FROM m JOIN i USING (image, chart, series)"),
    "smp_point_value": (lambda s, d: MARKS.df(s, d).where("valid AND axis IS NOT NULL").select("image", "mark", F.when(C("axis") == "y2", C("v") * 10).otherwise(C("v")).alias("label")), f"WITH {MARKS.cte('f')} SELECT image, mark, CASE WHEN axis = 'y2' THEN v * 10 ELSE v END AS label FROM f WHERE valid AND axis IS NOT NULL"),
    "smp_cell_row": (_cells, f"WITH {CELLS.cte('f')}, k AS (SELECT t, cell FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE a.t = b.t AND a.cell <> b.cell AND (a.x0 + a.x1) / 2 >= b.x0 AND (a.x0 + a.x1) / 2 < b.x1 AND (a.y0 + a.y1) / 2 >= b.y0 AND (a.y0 + a.y1) / 2 < b.y1)) SELECT t, cell, 'cell_row' AS probe, cell AS label FROM k UNION ALL SELECT t, cell, 'cell_col', t FROM k"),
    "smp_glyph_id": (_glyph_rows, f"WITH {GLYPHS.cte('f')} SELECT image, seq, instr('{ALPHABET.replace(chr(39), chr(39) * 2)}', ch) - 1 AS label, round((x0 + x1) / 2, 6) AS px, round((y0 + y1) / 2, 6) AS py FROM f WHERE instr('{ALPHABET.replace(chr(39), chr(39) * 2)}', ch) > 0"),
    "smp_pl1_class": (_points, None),
    "smp_pl2_extent": (_extents, f"WITH {ITEMS.cte('f')} SELECT image, item, k::INTEGER AS k, true AS inside, [x, y, w, h] AS label FROM f, unnest([1, 2]) AS t(k) WHERE w > 0 AND h > 0"),
    "smp_pl3_summary": (_summary, f"WITH {CLASSES.cte('f')} SELECT image, count(*) AS n_boxes, bool_or(class = 'table') AS has_table, bool_or(class = 'text') AS has_text, bool_or(class = 'picture') AS has_picture, bool_or(class = 'formula') AS has_formula FROM f GROUP BY image"),
    "smp_build": (_build, _BUILD_SQL),
}
