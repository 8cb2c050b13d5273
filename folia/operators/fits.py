"""Probe fits over whole tables: every family is fitted from summed Gram matrices, so that no rows are gathered.

A family (``family``) is a set of rows (id, doc, vec, target, ...) with vectors and targets of one length; classes are
one-hot targets. What reaches one task is of the size of the dimensions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.functions import derive as D
from folia.operators import resampling as R
from folia.operators.joins import small
from folia.sources.sinks import stored

_BUCKETS = 4096


def one_hot(label: Column, classes: list) -> Column:
    return F.array(*[F.when(label == c, 1.0).otherwise(0.0) for c in classes])


def heads(df: DataFrame, *, alpha: float = 1.0) -> DataFrame:
    """(family, w): ridge weights, for each target those of the vector and an intercept (not penalised)."""

    def part(batches):
        sums: dict = {}
        for t in batches:
            for name, g in t.groupby("family"):
                x = np.hstack([np.stack(g["vec"].to_numpy()).astype(float), np.ones((len(g), 1))])
                y = np.stack(g["target"].to_numpy()).astype(float)
                both = np.concatenate([(x.T @ x).ravel(), (x.T @ y).ravel()])
                sums[name] = sums.get(name, 0) + np.append(both, x.shape[1])
                sums[name][-1] = x.shape[1]
        for name, v in sums.items():
            yield pd.DataFrame({"family": [name], "v": [v[:-1]], "dims": [int(v[-1])]})

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        d = int(t["dims"].iloc[0])
        v = t.sort_values("i")["x"].to_numpy()
        a = v[: d * d].reshape(d, d) + alpha * np.diag(np.append(np.ones(d - 1), 0.0))
        return pd.DataFrame({"family": [t["family"].iloc[0]], "w": [np.linalg.solve(a, v[d * d :].reshape(d, -1)).T.ravel()]})

    sums = df.select("family", "vec", "target").mapInPandas(part, "family string, v array<double>, dims int")
    sums = sums.select("family", "dims", F.posexplode("v").alias("i", "x")).groupBy("family", "dims", "i").agg(F.sum("x").alias("x"))
    return stored(sums.groupBy("family").applyInPandas(solve, "family string, w array<double>"), "heads")  # read more than once


def outputs(vec: Column, w: Column) -> Column:
    """Values of all targets."""
    d = F.size(vec)
    one = lambda k: F.aggregate(F.zip_with(vec, F.slice(w, k * (d + 1) + 1, d), lambda a, b: a.cast("double") * b), F.get(w, k * (d + 1) + d), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), (F.size(w) / (d + 1)).cast("int") - 1), one)


def predicted(df: DataFrame, weights: DataFrame, vec: str = "vec", name: str = "out") -> DataFrame:
    """``df`` with the outputs of its family's weights."""
    return df.join(small(weights), "family").withColumn(name, outputs(F.col(vec), F.col("w"))).drop("w")


def best(out: Column) -> Column:
    """Place of the largest output (the first of several)."""
    return F.array_position(out, F.array_max(out)) - 1


def dealt(df: DataFrame, keys: list[str], row: str, value: str, seed: int = 0) -> DataFrame:
    """(keys, row, value): the values of each group dealt anew among its rows, by two hash orders; every order is ranked in hash ranges, never in one task."""

    def ranked(salt: int, *cols: str) -> DataFrame:
        h = F.xxhash64(F.lit(salt), F.lit(seed), F.col(row))
        t = df.select(*keys, *cols, F.pmod(h, F.lit(_BUCKETS)).cast("int").alias("bucket"), h.alias("h"))
        from pyspark.sql import Window

        counts = t.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy(*keys, F.lit(0)).orderBy("bucket")) - F.col("n")
        counts = counts.withColumn("before", before).drop("n")
        k = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("h", *cols[:1]))
        return t.withColumn("k", k).join(counts, [*keys, "bucket"]).select(*keys, *cols, (F.col("k") + F.col("before")).alias("k"))

    return ranked(1, row).join(ranked(2, value), [*keys, "k"]).drop("k")


def accuracy(df: DataFrame, ok: str, *, n: int = 200, seed: int = 0) -> DataFrame:
    """(family, mean, lo, hi) of a 0/1 column, with its interval over documents."""
    return R.bootstrap(df, "family", "doc", ok, n=n, seed=seed)


def run_pair(rows: DataFrame, classes: list, *, keep: Column | None = None, least: int = 40, dims: int | None = None, width: int = 64, fraction: float = 0.8, seed: int = 0, boots: int = 200) -> DataFrame:
    """(family, n_train, n_test, accuracy, lo, hi, control, n_docs): one linear head a family, end to end.

    Rows (family, id, doc, vec, label): those that pass ``keep``; families of fewer than ``least`` are left out; vectors are
    projected to ``dims`` by one seeded matrix (so that all heads have the same capacity); documents are split by hash; the
    head is fitted on the training side and judged on the other, with an interval over documents; the control is fitted to
    training labels dealt anew within the family. A family with an empty side is left out.
    """
    rows = rows.where(F.col("vec").isNotNull() & F.col("label").isNotNull())
    if keep is not None:
        rows = rows.where(keep)
    sizes = rows.groupBy("family").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("family")
    rows = rows.join(small(sizes), "family", "left_semi")
    if dims:
        m = R.projection(width, dims, seed)
        rows = rows.withColumn("vec", F.array(*[F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(x)) for x in col]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x) for col in m.T]))
    on = D.is_train(F.col("doc"), fraction, seed)
    train, test = rows.where(on), rows.where(~on)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    shuffled = train.select("family", "id", "vec").join(dealt(train, ["family"], "id", "label", seed), ["family", "id"])
    fits = [heads(t.select("family", "vec", one_hot(F.col("label"), classes).alias("target"))) for t in (train, shuffled)]
    judged = test.withColumn("place", place)
    judged = predicted(judged, fits[0], name="real")
    judged = predicted(judged, fits[1], name="dealt")
    judged = judged.select("family", "doc", (best(F.col("real")) == F.col("place")).cast("double").alias("ok"), (best(F.col("dealt")) == F.col("place")).cast("double").alias("control"))
    control = judged.groupBy("family").agg(F.avg("control").alias("control"), F.count("*").alias("n_test"))
    counts = rows.groupBy("family").agg(F.count_if(on).alias("n_train"), F.count_distinct("doc").alias("n_docs")).where("n_train > 0")
    return accuracy(judged, "ok", n=boots, seed=seed).withColumnRenamed("mean", "accuracy").join(control, "family").join(counts, "family")


def reconstruction(rows: DataFrame, classes: list, *, fraction: float = 0.8, seed: int = 0, boots: int = 200) -> DataFrame:
    """(family, true, recon, gap, lo, hi, n_test): what a head loses on vectors reconstructed from a second site.

    Rows (family, id, doc, vec: first site, second: second site, label). The inverse map from the second site to the first
    is fitted on all training documents; each family's head on its true training vectors. It is judged on true and on
    reconstructed test vectors; the gap has an interval over documents.
    """
    on = D.is_train(F.col("doc"), fraction, seed)
    train, test = rows.where(on), rows.where(~on)
    inverse = heads(train.select(F.lit("inverse").alias("family"), F.col("second").alias("vec"), F.col("vec").alias("target"))).select("w")
    head = heads(train.select("family", "vec", one_hot(F.col("label"), classes).alias("target")))
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    t = test.withColumn("place", place).crossJoin(F.broadcast(inverse)).withColumn("recon", outputs(F.col("second"), F.col("w"))).drop("w")  # one row of weights
    t = predicted(predicted(t, head, "vec", "a"), head, "recon", "b")
    t = t.select("family", "doc", (best(F.col("a")) == F.col("place")).cast("double").alias("a"), (best(F.col("b")) == F.col("place")).cast("double").alias("b"))
    means = t.groupBy("family").agg(F.avg("a").alias("true"), F.avg("b").alias("recon"), F.count("*").alias("n_test"))
    return means.join(R.contrast(t, "family", "doc", "a", "b", n=boots, seed=seed).withColumnRenamed("mean", "gap"), "family")
