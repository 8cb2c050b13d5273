"""Queries of resampling statistics and model fits."""

from __future__ import annotations

import numpy as np
import pandas as pd

from folia.functions import derive as D
from folia.operators import fits as B
from folia.operators import resampling as R
from folia.plans.base import F, literal_query, table
from folia.plans.join_queries import SCORES
from folia.plans.window_queries import knn_sql
from folia.sources.literal import Literal

C = F.col
_TRAIN = "CAST(('0x' || substr(sha1('0:' || {0}), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.8"
GAPS = Literal("id bigint, gap double, ha double, hb double, head double", [(1, 0.3, 0.1, 0.2, 0.05), (2, 0.15, 0.1, 0.2, 0.0), (3, 0.3, 0.1, 0.1, 0.3), (4, 0.3, 0.1, 0.1, -0.5)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_discount; l_tax; l_tax / 2; l_discount - 0.05")
ARMS = Literal("doc string, patched double, low double, intact double", [("a", 0.5, 0.2, 0.8), ("b", 0.6, 0.4, 0.8), ("c", 0.3, 0.0, 1.0)]).over("supplier", "'s' || s_suppkey; s_suppkey % 7; s_suppkey % 3; s_suppkey % 3 + 4")
CONTRASTS = Literal("id bigint, ab_lo double, ab_hi double, ac_lo double, ac_hi double, bc_lo double, bc_hi double", [(1, 0.1, 0.2, 0.1, 0.3, -0.1, 0.1), (2, -0.1, 0.1, 0.2, 0.3, 0.2, 0.3), (3, -0.1, 0.1, -0.2, 0.2, -0.1, 0.1), (4, -0.3, -0.1, -0.1, 0.1, 0.1, 0.2)]).over("lineitem", "l_orderkey * 10 + l_linenumber + 1000; l_discount - 0.05; l_discount; l_tax - 0.04; l_tax; l_discount - l_tax; l_discount")


def _docs(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("lang", "source", (C("quality") - C("toxic")).cast("double").alias("x"), C("quality").cast("double").alias("a"), C("toxic").cast("double").alias("b"))


def _points(df, keys):
    from folia.operators.aggregates import with_total

    return with_total(df, keys, [F.count("*").alias("n"), F.round(F.avg("diff"), 6).alias("mean")])


def _paired(s, d):
    a, b = (SCORES.df(s, d).where(C("arm") == x).select("image", "family", C("score").alias(f"s{x}")) for x in "AB")
    return a.join(b.drop("family"), "image").select("family", (C("sA") - C("sB")).alias("diff"))


def _restoration(s, d):
    return ARMS.df(s, d).agg(F.round(R.restoration(F.avg("patched"), F.avg("low"), F.avg("intact")), 9).alias("fraction"), F.count("*").alias("n"))


def _xy(s, d):
    return table(s, d, "embeddings").select("vec_id", "embedding", "label")


def _ridge(s, d):
    """Fit on the hash's train side, mean absolute error on the other."""
    e = _xy(s, d)
    w = R.linear_fit(e.where(D.is_train(C("vec_id"))), "embedding", C("label"), 64)
    pred = F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in w[:-1]]), lambda a, b: a.cast("double") * b), F.lit(float(w[-1])), lambda a, x: a + x)
    return e.where(~D.is_train(C("vec_id"))).select("vec_id", F.round(pred, 6).alias("pred"), "label")


def _logistic(s, d):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    e = _xy(s, d).select("vec_id", array_to_vector("embedding").alias("features"), C("label").cast("double").alias("label"))
    train = e.where(D.is_train(C("vec_id")))
    model = LogisticRegression(family="multinomial", regParam=1.0 / max(1, train.count()), standardization=False, maxIter=100).fit(train)
    return model.transform(e.where(~D.is_train(C("vec_id")))).select("vec_id", C("prediction").cast("bigint").alias("pred"))


def _mlp(s, d):
    """A classifier that needs all its rows at once: at most 5,000 labelled ones, those with the smallest hash; prediction is distributed."""
    e = _xy(s, d).where("embedding IS NOT NULL")
    t = e.where(D.is_train(C("vec_id"))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(5000).toPandas()
    f = R.mlp_fit(np.stack(t["embedding"].to_numpy()).astype(float), t["label"].to_numpy(float)[:, None])

    def predict(batches):
        for b in batches:
            p = f(np.stack(b["embedding"].to_numpy()).astype(float))
            yield pd.DataFrame({"vec_id": b["vec_id"], "error": np.round(np.abs(p[:, 0] - b["label"].to_numpy(float)), 6)})

    return e.where(~D.is_train(C("vec_id"))).mapInPandas(predict, "vec_id bigint, error double")


def _halves(s, d):
    """Vectors as two sites: the first half, and the second half."""
    e = _xy(s, d).where("embedding IS NOT NULL")
    return e.select("vec_id", F.slice("embedding", 33, 32).alias("vec"), F.slice("embedding", 1, 32).alias("target"))


def _inverse(s, d):
    """Mean squared error of the first half of each test vector as a ridge map of its second half; all training rows."""
    e = _halves(s, d).withColumn("family", F.lit("all"))
    out = B.predicted(e.where(~D.is_train(C("vec_id"))), B.heads(e.where(D.is_train(C("vec_id")))))
    return out.select("vec_id", F.round(F.aggregate(F.zip_with("out", "target", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / 32, 6).alias("error"))


def _labels(s, d):
    return [r.label for r in table(s, d, "embeddings").select("label").where("label IS NOT NULL").distinct().orderBy("label").limit(1000).collect()]


def _families(s, d):
    """Vectors as probe rows: three families, four vectors a document."""
    e = _xy(s, d).where("embedding IS NOT NULL")
    return e.select(F.concat(F.lit("probe"), F.pmod("vec_id", F.lit(3)).cast("string")).alias("family"), C("vec_id").alias("id"), F.floor(C("vec_id") / 4).alias("doc"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def _run_pair(s, d):
    """Families of vectors fitted end to end; every seventh row is filtered out by its id."""
    return B.run_pair(_families(s, d), _labels(s, d), keep=F.pmod("id", F.lit(7)) != 0, dims=16)


def _recon(s, d):
    rows = _families(s, d).withColumn("second", F.slice("vec", 33, 32)).withColumn("vec", F.slice("vec", 1, 32))
    return B.reconstruction(rows, _labels(s, d))


def _shuffled(s, d):
    """Labels dealt anew among the rows by hash orders."""
    return B.dealt(table(s, d, "labels").select("doc_id", C("quality").alias("control")), [], "doc_id", "control")


def _knn_probe(s, d):
    """Labels of test vectors (of ids divisible by 20) by the 50 nearest of all training vectors."""
    from folia.plans.window_queries import knn

    return knn(s, d, among=D.is_train(C("vec_id")), ask=~D.is_train(C("vec_id")))


QUERIES = {
    "boot_metric_doc": (lambda s, d: R.bootstrap(_docs(s, d), "lang", "source", "a"), None),
    "boot_paired_gap": (lambda s, d: R.contrast(_docs(s, d), "lang", "source", "a", "b"), None),
    "boot_contrast": (lambda s, d: R.contrast(_docs(s, d), "lang", "source", "a", "b", n=2000), None),
    "boot_mean": (lambda s, d: R.bootstrap(_docs(s, d), "lang", "source", "x", n=500, seed=1), None),
    "boot_contrast_mean": (lambda s, d: _docs(s, d).groupBy("lang").agg(F.round(F.avg("x"), 9).alias("mean")), "SELECT lang, round(avg(quality - toxic), 9) AS mean FROM documents JOIN labels USING (doc_id) GROUP BY lang"),
    "boot_restoration_ci": (lambda s, d: R.restoration_bootstrap(ARMS.df(s, d), "doc", "patched", "low", "intact"), None),
    "boot_restoration": (_restoration, f"WITH {ARMS.cte('f')} SELECT round((avg(patched) - avg(low)) / (avg(intact) - avg(low)), 9) AS fraction, count(*) AS n FROM f"),
    "contrast_block": (lambda s, d: _points(_paired(s, d), ["family"]), f"WITH {SCORES.cte('f')}, p AS (SELECT a.family, a.score - b.score AS diff FROM f a JOIN f b USING (image) WHERE a.arm = 'A' AND b.arm = 'B') SELECT 'all' AS axis, 'all' AS key, count(*) AS n, round(avg(diff), 6) AS mean FROM p UNION ALL SELECT 'family', family, count(*), round(avg(diff), 6) FROM p GROUP BY family"),
    "gap_rule": literal_query(GAPS, lambda: {"counts": R.gap_counts(C("gap"), C("ha"), C("hb"), C("head"))}, "SELECT id, gap > greatest(ha, hb) AND gap > greatest(0.0, head) AS counts FROM f"),
    "shuffled_control": (_shuffled, None),
    "ml_linear_cls": (_logistic, None),
    "ml_ridge": (_ridge, None),
    "ml_mlp": (_mlp, None),
    "ml_inverse": (_inverse, None),
    "ml_knn": (_knn_probe, knn_sql(f" AND {_TRAIN.format('r.vec_id')}", f" AND NOT {_TRAIN.format('e.vec_id')}")),
    "ml_run_pair": (_run_pair, None),
    "ml_recon_family": (_recon, None),
    "ker_decision_table": literal_query(CONTRASTS, lambda: {"row": F.when((C("ab_lo") > 0), "A>B").when(C("ab_hi") < 0, "B>A").when((C("ac_lo") > 0) & (C("bc_lo") > 0), "A~B>C").otherwise("A~C")}, "SELECT id, CASE WHEN ab_lo > 0 THEN 'A>B' WHEN ab_hi < 0 THEN 'B>A' WHEN ac_lo > 0 AND bc_lo > 0 THEN 'A~B>C' ELSE 'A~C' END AS row FROM f"),
}
