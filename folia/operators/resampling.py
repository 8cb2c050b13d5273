"""Document-level resampling and small model fits, one group a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bootstrap(df: DataFrame, group: str, doc: str, value: str, *, n: int = 1000, seed: int = 0) -> DataFrame:
    """(group, mean, lo, hi): mean of ``value`` with its 95 % interval over resampled documents.

    Only each document's sum and count reach the group's task, so its size is that of the documents, not of the rows.
    """
    per = df.groupBy(group, doc).agg(F.sum(value).alias("s"), F.count(value).alias("c"))

    def draw(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(doc)
        rng = np.random.default_rng(seed)
        s, c, k = t["s"].to_numpy(float), t["c"].to_numpy(float), len(t)
        means = np.empty(n)
        for i in range(n):
            times = np.bincount(rng.integers(0, k, k), minlength=k)
            means[i] = (s @ times) / max(c @ times, 1)
        lo, hi = np.nanpercentile(means, [2.5, 97.5])
        return pd.DataFrame({group: [t[group].iloc[0]], "mean": [s.sum() / max(c.sum(), 1)], "lo": [lo], "hi": [hi]})

    kind = df.schema[group].dataType.simpleString()
    return per.groupBy(group).applyInPandas(draw, f"{group} {kind}, mean double, lo double, hi double")


def contrast(df: DataFrame, group: str, doc: str, a: str, b: str, **how) -> DataFrame:
    """``bootstrap`` of the paired difference a - b."""
    return bootstrap(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b)), group, doc, "_d", **how)


def restoration(patched: Column, floor: Column, intact: Column) -> Column:
    """(patched - floor) / (intact - floor) of means; null where there is nothing to restore."""
    whole = intact - floor
    return F.when(F.abs(whole) >= 1e-9, (patched - floor) / whole)


def restoration_bootstrap(df: DataFrame, doc: str, patched: str, floor: str, intact: str, *, n: int = 2000, seed: int = 0) -> DataFrame:
    """(n_docs, fraction, lo, hi, n_boot, n_degenerate): restoration with its 95 % interval over resampled documents, the three scores kept together.

    Resamples with nothing to restore are dropped and counted; no interval for fewer than two documents or no fraction.
    """
    per = df.groupBy(F.col(doc).alias("doc")).agg(F.avg(patched).alias("p"), F.avg(floor).alias("f"), F.avg(intact).alias("a"))

    def draw(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("doc")
        p, f, a = (t[x].to_numpy(float) for x in "pfa")
        k, found, dropped = len(t), [], 0
        whole = a.mean() - f.mean()
        fraction = (p.mean() - f.mean()) / whole if abs(whole) >= 1e-9 else None
        if fraction is not None and k > 1:
            rng = np.random.default_rng(seed)
            for _ in range(n):
                at = rng.integers(0, k, k)
                whole = a[at].mean() - f[at].mean()
                if abs(whole) < 1e-9:
                    dropped += 1
                else:
                    found.append((p[at].mean() - f[at].mean()) / whole)
        lo, hi = np.percentile(found, [2.5, 97.5]) if found else (None, None)
        return pd.DataFrame({"n_docs": [k], "fraction": [fraction], "lo": [lo], "hi": [hi], "n_boot": [n], "n_degenerate": [dropped]})

    return per.where("p IS NOT NULL AND f IS NOT NULL AND a IS NOT NULL").groupBy().applyInPandas(draw, "n_docs bigint, fraction double, lo double, hi double, n_boot bigint, n_degenerate bigint")


def gap_counts(gap: Column, half_a: Column, half_b: Column, mlp_minus_linear: Column) -> Column:
    """A gap counts if it is wider than both half intervals and than what the better head gains (strict)."""
    return (gap > F.greatest(half_a, half_b)) & (gap > F.greatest(F.lit(0.0), mlp_minus_linear))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Weights (with the intercept last) of ridge regression on standardised columns."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-8] = 1.0
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean(axis=0)))
    w = w / sd[:, None]
    return np.vstack([w, y.mean(axis=0) - mean @ w])


def gram(df: DataFrame, vec: str, target: Column, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(X'X, X'y, n) with an intercept column, summed partition by partition: of the size of the dimensions, whatever the rows."""

    def part(batches):
        xtx, xty, n = np.zeros((dims + 1, dims + 1)), np.zeros(dims + 1), 0
        for t in batches:
            if len(t):
                x = np.hstack([np.stack(t["v"].to_numpy()).astype(float), np.ones((len(t), 1))])
                xtx += x.T @ x
                xty += x.T @ t["y"].to_numpy(float)
                n += len(t)
        yield pd.DataFrame({"xtx": [xtx.ravel()], "xty": [xty], "n": [n]})

    rows = df.select(F.col(vec).alias("v"), target.cast("double").alias("y")).mapInPandas(part, "xtx array<double>, xty array<double>, n bigint")
    flat = rows.select(F.posexplode(F.concat("xtx", "xty", F.array(F.col("n").cast("double")))).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    v = np.array([r.x for r in flat])
    k = dims + 1
    return v[: k * k].reshape(k, k), v[k * k : k * k + k], int(v[-1])


def linear_fit(df: DataFrame, vec: str, target: Column, dims: int, alpha: float = 1.0) -> np.ndarray:
    """Ridge weights (intercept last, not penalised) from the summed Gram matrix."""
    xtx, xty, _ = gram(df, vec, target, dims)
    penalty = alpha * np.eye(dims + 1)
    penalty[-1, -1] = 0
    return np.linalg.solve(xtx + penalty, xty)


def mlp_fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 200, rate: float = 0.01, seed: int = 0):
    """Prediction function of a Linear-ReLU-Linear net fitted by Adam on a bounded sample."""
    rng = np.random.default_rng(seed)
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-8)
    z = (x - mean) / sd
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, y.shape[1])), np.zeros(y.shape[1])]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, epochs + 1):
        h = np.maximum(z @ p[0] + p[1], 0)
        e = (h @ p[2] + p[3] - y) / len(z)
        back = (e @ p[2].T) * (h > 0)
        for i, g in enumerate((z.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return lambda q: np.maximum((q - mean) / sd @ p[0] + p[1], 0) @ p[2] + p[3]


def projection(dims: int, to: int, seed: int = 0) -> np.ndarray:
    """Orthonormal Gaussian projection (signs pinned), scaled to keep squared lengths; widening is an error."""
    if to > dims:
        raise ValueError("a projection may not widen")
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, to)))
    return q * np.sign(np.diag(r)) * np.sqrt(dims / to)
