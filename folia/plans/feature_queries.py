"""Queries of geometry, vectors and features. An embedding of 64 numbers stands for a grid of 8 x 8 tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd

from folia.functions import geometry as G
from folia.functions.core import let
from folia.operators import resampling as R
from folia.plans.base import F, literal_query, table
from folia.plans.join_queries import GT, PRED
from folia.sources.literal import Literal

C = F.col
M = [0.9, -0.1, 0.05, 0.1, 0.9, 0.02]
BOXES = Literal("id bigint, x double, y double, w double, h double", [(1, 0.1, 0.2, 0.3, 0.4), (2, 0.0, 0.0, 1.0, 1.0), (3, 0.9995, 0.5, 0.0001, 0.2), (4, -0.1, 0.99, 0.5, 0.5)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_discount + 0.0113; l_tax + 0.3019; l_quantity / 61; l_linenumber / 7")
ANGLES = Literal("id bigint, angle double, shear double, scale double", [(1, 0.0, 0.0, 1.0), (2, 2.0, 0.01, 0.98), (3, -5.0, 0.0, 1.1)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_quantity; l_tax; 1 + l_discount")
VECS = Literal("id bigint, v array<double>", [(1, [1.0, 2.0]), (2, [70000.0, -1.0]), (3, [0.0, -3.5]), (4, [float(10**6), 65504.0])]).over("embeddings", "vec_id + 1000; embedding")


def _affine(s, d):
    x, y, w, h = G.affine_box(M, *(C(k) for k in "xywh"))
    px, py = G.affine_point(M, C("x"), C("y"))
    return BOXES.df(s, d).select("id", x.alias("bx"), y.alias("by"), w.alias("bw"), h.alias("bh"), F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


_PT = "(0.9 * {0} - 0.1 * {1} + 0.05)", "(0.1 * {0} + 0.9 * {1} + 0.02)"
_XS = ["[" + ", ".join(_PT[k].format(a, b) for a in ("x", "(x + w)") for b in ("y", "(y + h)")) + "]" for k in (0, 1)]
_AFFINE_SQL = f"SELECT id, round(list_min({_XS[0]}), 6) AS bx, round(list_min({_XS[1]}), 6) AS by, round(list_max({_XS[0]}) - list_min({_XS[0]}), 6) AS bw, round(list_max({_XS[1]}) - list_min({_XS[1]}), 6) AS bh, round({_PT[0].format('x', 'y')}, 6) AS px, round({_PT[1].format('x', 'y')}, 6) AS py FROM f"


#: ids that one part of a page's sidecar spans, so that no part grows with its page
SIDECAR_IDS = 1_000


def sidecars(s, d):
    """Boxes by page, nested; a page lies in parts by id."""
    page = (C("id") > 2).cast("bigint").alias("page")
    return BOXES.df(s, d).groupBy(page, F.floor(C("id") / SIDECAR_IDS).alias("part")).agg(F.collect_list(F.struct("id", "x", "y", "w", "h")).alias("items"))


def _sidecar(s, d):
    """Boxes of nested items mapped in place, other fields untouched."""
    out = sidecars(s, d).select("page", F.transform("items", lambda i: F.struct(i["id"].alias("id"), F.array(*G.affine_box(M, i["x"], i["y"], i["w"], i["h"])).alias("box"))).alias("items"))
    return out.select("page", F.explode("items").alias("i")).select("page", "i.id", C("i.box").getItem(0).alias("bx"), C("i.box").getItem(2).alias("bw"))


def _tokens(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", C("i").cast("int").alias("i"), C("v").cast("double").alias("v"))


def _pool(s, d, to=3, grid=8):
    """Adaptive average pooling of the grid to ``to`` x ``to``: bins may overlap."""
    bins = s.range(to).select(C("id").cast("int").alias("b"), F.floor(C("id") * grid / to).cast("int").alias("lo"), F.ceil((C("id") + 1) * grid / to).cast("int").alias("hi"))
    t = _tokens(s, d).withColumn("y", (C("i") / grid).cast("int")).withColumn("x", C("i") % grid)
    by, bx = (F.broadcast(bins.toDF(f"b{k}", f"lo{k}", f"hi{k}")) for k in "yx")
    j = t.join(by, (C("y") >= C("loy")) & (C("y") < C("hiy"))).join(bx, (C("x") >= C("lox")) & (C("x") < C("hix")))
    return j.groupBy("vec_id", "by", "bx").agg(F.round(F.avg("v"), 6).alias("v"))


def _standardize(s, d):
    t = _tokens(s, d)
    st = t.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    z = t.join(F.broadcast(st), "i").withColumn("z", (C("v") - C("m")) / F.when(C("sd") < 1e-8, 1.0).otherwise(C("sd")))
    return z.groupBy("vec_id").agg(F.round(F.sum(F.abs("z")), 5).alias("z"))


def _nmse(s, d):
    t = _tokens(s, d).withColumn("p", F.bround("v", 1))
    st = t.groupBy("i").agg(F.stddev_pop("v").alias("sd"), F.avg((C("v") - C("p")) ** 2).alias("mse"))
    m = st.agg(F.avg("sd").alias("mean_sd"))
    return st.crossJoin(m).agg(F.round(F.avg(C("mse") / F.pow(F.greatest("sd", 0.05 * C("mean_sd")), F.lit(2))), 8).alias("nmse"))


def _project(s, d):
    """Vectors under a seeded projection: the ratio of squared lengths."""
    p = R.projection(64, 16, 3)

    def run(batches):
        for t in batches:
            x = np.stack(t["embedding"].to_numpy()).astype(float)
            yield pd.DataFrame({"vec_id": t["vec_id"], "ratio": np.round(((x @ p) ** 2).sum(axis=1) / (x**2).sum(axis=1), 6)})

    return table(s, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, ratio double")


def _occupancy(s, d):
    """Logical columns of spanned cells: an occupancy walk per table."""
    cells = Literal("t bigint, r bigint, k bigint, rs bigint, cs bigint", [(1, 0, 0, 2, 1), (1, 0, 1, 1, 2), (1, 1, 0, 1, 1), (1, 1, 1, 1, 1), (2, 0, 0, 1, 3), (2, 1, 0, 1, 1)]).df(s, d)

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for c in t.sort_values(["r", "k"]).itertuples():
            col = 0
            while (c.r, col) in used:
                col += 1
            used.update((c.r + i, col + j) for i in range(c.rs) for j in range(c.cs))
            rows.append((c.t, c.r, c.k, col))
        return pd.DataFrame(rows, columns=["t", "r", "k", "col"])

    return cells.groupBy("t").applyInPandas(walk, "t bigint, r bigint, k bigint, col bigint")


_TOK = "t AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"

QUERIES = {
    "geo_iou": (lambda s, d: GT.df(s, d).alias("g").join(PRED.df(s, d).alias("p"), "page").select("page", "cell", "seq", F.round(G.iou(tuple(C(f"g.{k}") for k in "xywh"), tuple(C(f"p.{k}") for k in "xywh")), 9).alias("iou")), f"WITH {GT.cte('g')}, {PRED.cte('p')}, j AS (SELECT page, cell, seq, greatest(least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x), 0) * greatest(least(g.y + g.h, p.y + p.h) - greatest(g.y, p.y), 0) AS i, g.w * g.h + p.w * p.h AS u FROM g JOIN p USING (page)) SELECT page, cell, seq, round(i / (u - i), 9) AS iou FROM j"),
    "geo_affine_point": (_affine, f"WITH {BOXES.cte('f')} {_AFFINE_SQL}"),
    "geo_affine_sidecar": (_sidecar, f"WITH {BOXES.cte('f')}, a AS ({_AFFINE_SQL}) SELECT CAST(id > 2 AS BIGINT) AS page, id, bx, bw FROM a"),
    "geo_int_bbox": literal_query(BOXES, lambda: dict(zip(("ix", "iy", "iw", "ih"), G.int_box(*(C(k) for k in "xywh")), strict=True)), "SELECT id, least(least(1000, greatest(0, floor(x * 1000 + 0.5)))::BIGINT, 1000 - greatest(1, least(1000, greatest(0, floor(w * 1000 + 0.5))))::BIGINT) AS ix, least(least(1000, greatest(0, floor(y * 1000 + 0.5)))::BIGINT, 1000 - greatest(1, least(1000, greatest(0, floor(h * 1000 + 0.5))))::BIGINT) AS iy, greatest(1, least(1000, greatest(0, floor(w * 1000 + 0.5))))::BIGINT AS iw, greatest(1, least(1000, greatest(0, floor(h * 1000 + 0.5))))::BIGINT AS ih FROM f"),
    "geo_build_affine": literal_query(ANGLES, lambda: {f"m{k}": F.round(v, 9) + 0.0 for k, v in enumerate(G.build_affine(C("angle"), C("shear"), C("scale")))}, "SELECT id, round(c, 9) + 0.0 AS m0, round(c * shear - s, 9) + 0.0 AS m1, round(0.5 - (c + c * shear - s) * 0.5, 9) + 0.0 AS m2, round(s, 9) + 0.0 AS m3, round(s * shear + c, 9) + 0.0 AS m4, round(0.5 - (s + s * shear + c) * 0.5, 9) + 0.0 AS m5 FROM (SELECT *, cos(radians(angle)) * scale AS c, sin(radians(angle)) * scale AS s FROM f)"),
    "geo_norm_bbox": literal_query(BOXES, lambda: {"nx": F.least(F.lit(1.0), F.greatest(F.lit(0.0), C("x") * 2 / 1.5)), "nw": F.least(F.lit(1.0), F.greatest(F.lit(0.0), C("w") * 2 / 1.5))}, "SELECT id, least(1.0, greatest(0.0, x * 2 / 1.5::DOUBLE)) AS nx, least(1.0, greatest(0.0, w * 2 / 1.5::DOUBLE)) AS nw FROM f"),
    "geo_grid_occupancy": (_occupancy, None),
    "vec_tokens_to_grid": (lambda s, d: _tokens(s, d).select("vec_id", (C("i") / 8).cast("int").alias("y"), (C("i") % 8).alias("x"), "v"), f"WITH {_TOK} SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, v FROM t"),
    "vec_bilinear": (lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(G.bilinear(C("embedding"), F.lit(0.3), F.lit(0.62), 8), 6).alias("v"), F.round(G.bilinear(C("embedding"), F.lit(0.01), F.lit(0.5), 8), 6).alias("edge")), "SELECT vec_id, round((1 - 0.9) * (1 - 0.46) * e[34] + 0.9 * (1 - 0.46) * e[35] + (1 - 0.9) * 0.46 * e[42] + 0.9 * 0.46 * e[43], 6) AS v, round(0.58 * 0.5 * e[25] + 0.58 * 0.5 * e[33], 6) AS edge FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"),
    "vec_children": (lambda s, d: _tokens(s, d).where(((C("i") / 8).cast("int") / 2).cast("int") == G.cell_of(F.lit(0.6), 4)).where(((C("i") % 8) / 2).cast("int") == G.cell_of(F.lit(0.1), 4)).select("vec_id", "i", "v"), f"WITH {_TOK} SELECT vec_id, i::INTEGER AS i, v FROM t WHERE (i // 8) // 2 = 2 AND (i % 8) // 2 = 0"),
    "vec_combine": (lambda s, d: table(s, d, "embeddings").select("vec_id", let(C("embedding"), lambda e: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.round((F.get(e, j).cast("double") + F.get(e, j + 16) + F.get(e, j + 32) + F.get(e, j + 48)) / 4, 5))).alias("mean4")).select("vec_id", F.posexplode("mean4").alias("j", "v")), "SELECT vec_id, j::INTEGER AS j, round((e[j + 1] + e[j + 17] + e[j + 33] + e[j + 49]) / 4, 5) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), unnest(range(0, 16)) AS t(j)"),
    "vec_pool_grid": (_pool, f"WITH {_TOK}, b AS (SELECT b, floor(b * 8 / 3) AS lo, ceil((b + 1) * 8 / 3) AS hi FROM range(0, 3) AS r(b)) SELECT vec_id, y.b::INTEGER AS by, x.b::INTEGER AS bx, round(avg(v), 6) AS v FROM t JOIN b y ON i // 8 >= y.lo AND i // 8 < y.hi JOIN b x ON i % 8 >= x.lo AND i % 8 < x.hi GROUP BY ALL"),
    "vec_row_major": (lambda s, d: _tokens(s, d).select("vec_id", ((C("i") / 32).cast("int") * 32 + ((C("i") % 32) / 8).cast("int") * 2 + ((C("i") % 8) / 4).cast("int") * 16 + (C("i") % 4)).alias("j"), "v"), f"WITH {_TOK} SELECT vec_id, CAST((i // 32) * 32 + ((i % 32) // 8) * 2 + ((i % 8) // 4) * 16 + (i % 4) AS INTEGER) AS j, v FROM t"),
    "vec_project": (_project, None),
    "vec_standardize": (_standardize, f"WITH {_TOK}, s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM t GROUP BY i) SELECT vec_id, round(sum(abs((v - m) / CASE WHEN sd < 1e-8 THEN 1.0 ELSE sd END)), 5) AS z FROM t JOIN s USING (i) GROUP BY vec_id"),
    "vec_nmse": (_nmse, f"WITH {_TOK}, s AS (SELECT i, stddev_pop(v) AS sd, avg((v - round_even(v, 1)) ** 2) AS mse FROM t GROUP BY i) SELECT round(avg(mse / greatest(sd, 0.05 * (SELECT avg(sd) FROM s)) ** 2), 8) AS nmse FROM s"),
    "vec_percell": (lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.flatten(F.array(F.slice("embedding", k * 16 + 1, 8), F.slice("embedding", k * 16 + 9, 8))))).alias("cell", "v")).select("vec_id", "cell", F.size("v").alias("n"), C("v").getItem(0).cast("double").alias("first")), "SELECT vec_id, k::INTEGER AS cell, 16 AS n, e[k * 16 + 1] AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), unnest(range(0, 4)) AS t(k)"),
    "vec_finite_guard": (lambda s, d: VECS.df(s, d).select("id", G.finite_report(C("v")).alias("r")).select("id", "r.nan", "r.inf", "r.over", "r.absmax", "r.ok"), f"WITH {VECS.cte('f')} SELECT id, 0::BIGINT AS nan, 0::BIGINT AS inf, len(list_filter(v, lambda x: abs(x) > 65504))::BIGINT AS over, list_max(list_transform(v, lambda x: abs(x))) AS absmax, len(list_filter(v, lambda x: abs(x) > 65504)) = 0 AS ok FROM f"),
    "vec_rel_frobenius": (lambda s, d: table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).select("vec_id", F.round(G.norm(F.transform("e", lambda x: x - F.bround(x, 1))) / G.norm(C("e")), 6).alias("rel"), F.round(F.array_max(F.transform("e", lambda x: F.abs(x - F.bround(x, 1)))), 6).alias("most")), f"WITH {_TOK} SELECT vec_id, round(sqrt(sum((v - round_even(v, 1)) ** 2)) / sqrt(sum(v * v)), 6) AS rel, round(max(abs(v - round_even(v, 1))), 6) AS most FROM t GROUP BY vec_id"),
}
