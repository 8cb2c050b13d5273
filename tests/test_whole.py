"""Queries over whole tables against brute force."""

import hashlib
import html
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from folia.plans import catalog

DATA = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


def repetition(text):
    units, k = [w for w in re.split(r"\s+", text, flags=re.ASCII) if w], 10
    if len(units) < 40 and len(text) >= 40:
        units, k = list(text), 30
    grams = Counter(tuple(units[i : i + k]) for i in range(len(units) - k + 1))
    total = sum(grams.values())
    return (1 - len(grams) / total, max(grams.values()) / total) if total else (0.0, 0.0)


def test_repetition_whole_texts(spark):
    want = {r.doc_id: repetition(r.text or "") for r in rows(spark, "documents")}
    got = {r.doc_id: r for r in catalog.QUERIES["str_repetition"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    for k, (repeated, top) in want.items():
        assert abs(got[k].repeated - repeated) < 2e-9 and abs(got[k].top - top) < 2e-9


def test_degeneration_whole_texts(spark):
    docs = rows(spark, "documents")
    assert any(r.n_chars > 3000 for r in docs)
    for g in catalog.QUERIES["agg_degeneration"](spark, DATA).collect():
        of = [r for r in docs if r.lang == g.lang]
        shares, sizes = [repetition(r.text or "")[0] for r in of], sorted(r.n_chars for r in of if r.n_chars is not None)
        assert (g.n, g.empty, g.at_cap) == (len(of), sizes.count(0), sum(x >= 2940 for x in sizes))
        assert [g.ge_05, g.ge_10, g.ge_25, g.ge_50, g.ge_90] == [sum(round(x, 9) >= y for x in shares) for y in (0.05, 0.1, 0.25, 0.5, 0.9)]
        assert abs(g["mean"] - sum(shares) / len(shares)) < 1e-6
        assert [g.p10, g.p50, g.p90] == [sizes[min(len(sizes) - 1, int(len(sizes) * p))] for p in (0.1, 0.5, 0.9)]


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _light(t):
    t = re.sub(r"(?i)</?(?:b|i|u|s|em|strong|del|ins|mark|sub|sup)\s*>", "", t or "")
    return re.sub(r"\s+", " ", re.sub(r"\*\*|__|\*|`+", "", t), flags=re.ASCII).strip(" ")


def _content(t):
    t = re.sub(r"<[^<>]*>", " ", re.sub(r"(?m)^[ \t]*(?:`{3,}|~{3,})[^\n]*$", " ", t or ""))
    t = unicodedata.normalize("NFKC", html.unescape(t))
    return re.sub(r"[\W_]+", "", re.sub(r"\\(?:[a-zA-Z]+\*?|[^a-zA-Z\s])", " ", t)).casefold()


def _md5(t):
    return hashlib.md5(t.encode()).hexdigest()


TEXTS = ["Stra\u00dfe  \ufb01ne &amp; caf\u00e9", "STRASSE fine caf\u00e9", "\u2460\u2461 \uff21\uff22\uff23", "<b>x</b> \\alpha &#233;t\u00e9", "\u65e5\u672c\u8a9e **bold**", "", None]


def test_norms_whole_texts(spark, tmp_path):
    docs = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    for at, want in ((str(tmp_path), {r[0]: r[1] for r in docs}), (DATA, {r.doc_id: r.text for r in rows(spark, "documents")})):
        nfkc = {r.doc_id: r.h for r in catalog.QUERIES["str_normalize_nfkc"](spark, at).collect()}
        assert nfkc == {k: t if t is None else _md5(re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip().lower()) for k, t in want.items()}
        content = {r.doc_id: r.h for r in catalog.QUERIES["str_content_norm"](spark, at).collect()}
        assert content == {k: _md5(_content(t)) for k, t in want.items()}


def test_similarities_of_all_pairs(spark, tmp_path):
    turns = [(0, i, "user", t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name, norm in (("str_edit_sim", _light), ("str_content_sim", _content)):
        got = {r.turn: r.sim for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        want = {}
        for i in range(len(TEXTS) - 2):
            a, b = norm(TEXTS[i]), norm(TEXTS[i + 1])
            want[i] = round(1 - _edit(a, b) / max(len(a), len(b)), 9) if a or b else 1.0
        assert got == want


def test_knn_over_all_vectors(spark):
    from folia.plans import window_queries

    e = {r.vec_id: (np.array(r.embedding, float), r.label) for r in rows(spark, "embeddings")}
    want = {}
    for q in (i for i in e if i % 20 == 0):
        cos = lambda i: round(float(e[q][0] @ e[i][0] / np.linalg.norm(e[q][0]) / np.linalg.norm(e[i][0])), 6)
        votes = Counter(e[i][1] for i in sorted((i for i in e if i != q), key=lambda i: (-cos(i), i))[:50])
        want[q] = min(votes.items(), key=lambda x: (-x[1], x[0]))
    for df in (catalog.QUERIES["knn_vote"](spark, DATA), window_queries.knn(spark, DATA, rows=64)):
        assert {r.vec_id: (r.label, r.n) for r in df.collect()} == want


def test_neighbor_cosine_over_all_grids(spark):
    e = {r.vec_id: np.array(r.embedding, float) for r in rows(spark, "embeddings")}
    near, far = [], []
    for i in e:
        for j in range(i + 1, i - i % 64 + 64):
            if j in e:
                dist = abs(i % 8 - j % 8) + abs(i % 64 // 8 - j % 64 // 8)
                c = e[i] @ e[j] / np.linalg.norm(e[i]) / np.linalg.norm(e[j])
                near += [c] * (dist == 1)
                far += [c] * (dist > 5)
    (got,) = catalog.QUERIES["ker_neighbor_cosine"](spark, DATA).collect()
    assert abs(got.near - np.mean(near)) < 2e-6 and abs(got.far - np.mean(far)) < 2e-6


def test_identical_children_by_all_numbers(spark, tmp_path):
    base = [float(i % 7) for i in range(16)]
    other = base[:15] + [9.0]
    vectors = [(0, base * 4), (1, base + other + base + other), (2, base + other + [8.0, *base[1:]] + [x + 1 for x in base]), (3, [x + k for k in range(4) for x in base])]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.pairs for r in catalog.QUERIES["ker_identical_children"](spark, str(tmp_path)).collect()}
    assert got == {0: 6, 1: 2}


def test_restoration_interval(spark):
    from folia.operators import resampling

    names = "doc bigint, patched double, low double, intact double"
    for docs in ([(i, 0.4 + 0.01 * (i % 5), 0.2, 0.5 + 0.05 * i) for i in range(12)], [(0, 0.5, 0.2, 0.2), (1, 0.6, 0.2, 0.8), (2, 0.1, 0.2, 0.2)], [(0, 0.5, 0.2, 0.8)], [(0, 0.5, 0.2, 0.2), (1, 0.5, 0.2, 0.2)]):
        (r,) = resampling.restoration_bootstrap(spark.createDataFrame(docs, names).repartition(3), "doc", "patched", "low", "intact").collect()
        p, f, a = np.array(docs)[:, 1:].T
        rng, found = np.random.default_rng(0), []
        whole = abs(a.mean() - f.mean()) >= 1e-9
        for _ in range(2000 if whole and len(docs) > 1 else 0):
            at = rng.integers(0, len(docs), len(docs))
            if abs(gap := a[at].mean() - f[at].mean()) >= 1e-9:
                found.append((p[at].mean() - f[at].mean()) / gap)
        assert r.n_docs == len(docs) and r.n_boot == 2000
        assert abs(r.fraction - (p.mean() - f.mean()) / (a.mean() - f.mean())) < 1e-9 if whole else r.fraction is None
        if found:
            assert np.allclose([r.lo, r.hi], np.percentile(found, [2.5, 97.5])) and r.n_degenerate == 2000 - len(found)
            assert (r.n_degenerate > 0) == (len(docs) == 3)
        else:
            assert r.lo is None and r.hi is None and r.n_degenerate == 0


def _train(doc, seed=0):
    return int(hashlib.sha1(f"{seed}:{doc}".encode()).hexdigest()[:16], 16) / 2**64 < 0.8


def _ridge(x, y):
    x = np.hstack([x, np.ones((len(x), 1))])
    return np.linalg.solve(x.T @ x + np.diag([1.0] * (x.shape[1] - 1) + [0.0]), x.T @ y)


def _apply(x, w):
    return np.hstack([x, np.ones((len(x), 1))]) @ w


def test_fits_against_numpy(spark):
    """Heads from summed Gram matrices, the inverse map and the gap of reconstructed vectors, and the fit of a family end to end."""
    from folia.operators import resampling

    e = sorted((r.vec_id, np.array(r.embedding, float), r.label) for r in rows(spark, "embeddings"))
    ids, x, y = np.array([i for i, _, _ in e]), np.stack([v for _, v, _ in e]), np.array([k for _, _, k in e])
    on = np.array([_train(i) for i in ids])
    error = ((_apply(x[:, 32:], _ridge(x[on, 32:], x[on, :32])) - x[:, :32]) ** 2).mean(axis=1)
    got = {r.vec_id: r.error for r in catalog.QUERIES["ml_inverse"](spark, DATA).collect()}
    assert got.keys() == set(ids[~on].tolist()) and all(abs(got[i] - error[k]) < 2e-6 for k, i in enumerate(ids.tolist()) if not on[k])

    doc_on, classes = np.array([_train(i // 4) for i in ids]), sorted(set(y.tolist()))
    hot = np.array([[float(k == c) for c in classes] for k in y])
    truth = np.array([classes.index(k) for k in y])
    inverse = _ridge(x[doc_on, 32:], x[doc_on, :32])
    family = ids % 3
    for r in catalog.QUERIES["ml_recon_family"](spark, DATA).collect():
        f = family == int(r.family[-1])
        w = _ridge(x[f & doc_on, :32], hot[f & doc_on])
        t = f & ~doc_on
        a, b = (_apply(v, w).argmax(axis=1) == truth[t] for v in (x[t, :32], _apply(x[t, 32:], inverse)))
        assert (r.n_test, round(r.true, 9), round(r.recon, 9)) == (t.sum(), round(a.mean(), 9), round(b.mean(), 9))
        assert abs(r.gap - (a.mean() - b.mean())) < 1e-9 and r.lo <= r.gap <= r.hi
    z = x @ resampling.projection(64, 16, 0)
    for r in catalog.QUERIES["ml_run_pair"](spark, DATA).collect():
        f = (family == int(r.family[-1])) & (ids % 7 != 0)
        t = f & ~doc_on
        ok = _apply(z[t], _ridge(z[f & doc_on], hot[f & doc_on])).argmax(axis=1) == truth[t]
        assert (r.n_train, r.n_test, r.n_docs) == ((f & doc_on).sum(), t.sum(), len(set((ids[f] // 4).tolist())))
        assert abs(r.accuracy - ok.mean()) < 1e-9 and r.lo <= r.accuracy <= r.hi and 0 <= r.control <= 1


def test_dealt_labels(spark):
    from folia.operators import fits

    df = spark.createDataFrame([(i % 3, i, float(i * i)) for i in range(500)], "f bigint, id bigint, v double").repartition(7)
    got = fits.dealt(df, ["f"], "id", "v").collect()
    assert sorted(r.id for r in got) == list(range(500)) and sum(r.v == r.id**2 for r in got) < 50
    for f in range(3):
        assert sorted(r.v for r in got if r.f == f) == [float(i * i) for i in range(f, 500, 3)]
    assert sorted(map(tuple, fits.dealt(df.repartition(2), ["f"], "id", "v").collect())) == sorted(map(tuple, got))


def test_similar_pairs_against_all(spark):
    import random

    from folia.operators import joins

    r = random.Random(1)
    common = [f"c{i}" for i in range(6)]
    sets = [set(r.sample(range(40), r.randint(1, 12))) | set(common if r.random() < 0.6 else []) for _ in range(120)]
    sets += [sets[0], sets[0], sets[5], set()]
    df = spark.createDataFrame([(i, i % 2, [str(x) for x in s]) for i, s in enumerate(sets)], "id bigint, family bigint, gs array<string>")
    for t in (0.5, 0.8):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets)) if a % 2 == b % 2 and sets[a] and sets[b]}
        got = {(x.a, x.b): x.jaccard for x in joins.similar_pairs(df, t).collect()}
        assert got == {k: v for k, v in want.items() if v >= t}


def test_probe_faults(spark, tmp_path):
    import json

    from folia.operators import joins
    from folia.sources import readers

    good = {"probe": "pl1_a", "image_id": "d/x_s001__p2", "label": [1, 2], "point_xy": [0.1, 0.2], "meta": {"k": "v"}}
    for k, bad in enumerate([{}, {"label": None}, {"probe": None}, {"point_xy": None}, {"task_type": "other"}]):
        (tmp_path / f"{k}.jsonl").write_text(json.dumps(good | bad) + "\n\n")
        df = readers.probes(spark, str(tmp_path / f"{k}.jsonl"))
        if bad:
            with pytest.raises(Exception, match="needs|task_type"):
                df.collect()
        else:
            (r,) = df.collect()
            assert (r.label.replace(" ", ""), r.doc_id, r.pooled, r.meta) == ("[1,2]", "d/x", False, {"k": "v"})
    feats = spark.createDataFrame([("a", None, [(0.5, 0.5, [1.0])], [9.0])], "image_id string, tokens array<array<double>>, sites array<struct<x:double,y:double,vec:array<double>>>, pooled array<double>")
    ask = lambda x: joins.assembled(spark.createDataFrame([("a", False, [x, 0.5]), ("b", True, None)], "image_id string, pooled boolean, point_xy array<double>"), feats, grid=4).collect()
    assert [(r.vec, r.layout) for r in sorted(ask(0.5))] == [([1.0], "sites"), (None, None)]
    with pytest.raises(Exception, match="no stored site"):
        ask(0.25)


def test_sidecars_in_parts(spark, tmp_path):
    from folia.plans import feature_queries as Q

    n = 5000
    lines = spark.range(n).selectExpr("id AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber", "id % 11 / 100D AS l_discount", "id % 9 / 100D AS l_tax", "CAST(id % 50 AS DOUBLE) AS l_quantity")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    nested = Q.sidecars(spark, str(tmp_path))
    assert max(len(r["items"]) for r in nested.collect()) <= Q.SIDECAR_IDS
    got = {r.id: r for r in catalog.QUERIES["geo_affine_sidecar"](spark, str(tmp_path)).collect()}
    boxes = {r.id: r for r in Q.BOXES.df(spark, str(tmp_path)).collect()}
    assert len(got) == n + 4 and got.keys() == boxes.keys()
    for k, b in boxes.items():
        xs = [0.9 * x - 0.1 * y + 0.05 for x in (b.x, b.x + b.w) for y in (b.y, b.y + b.h)]
        assert got[k].page == int(k > 2) and abs(got[k].bx - min(xs)) < 2e-6 and abs(got[k].bw - (max(xs) - min(xs))) < 2e-6


def test_points_of_images(spark):
    """Against points joined with items row by row; neither sorts nor deals out points."""
    from pyspark.sql import functions as F

    from folia.plans import derive_queries, window_queries as W

    items = W.ITEMS.df(spark, DATA)
    pts = items.select("image").distinct().select("image", F.explode(F.sequence(F.lit(1), F.lit(96)).cast("array<bigint>")).alias("point"))
    key = F.concat_ws("/", F.col("image").cast("string"), F.col("point").cast("string"))
    pts = pts.withColumn("px", W.uniform(key, 1)).withColumn("py", W.uniform(key, 2))
    want = derive_queries.class_at_point(pts, items).groupBy("image", "class").agg(F.count("*").alias("n"))
    got = catalog.QUERIES["smp_pl1_class"](spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in catalog.QUERIES["smp_build"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_ranked_whole(spark):
    from folia.operators import selection

    df = spark.range(0, 6000, 1, 6).selectExpr("id", "id * 7919 % 600 AS a", "concat('k', id * 31 % 40) AS b")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = selection.ranked_whole(df, ["a", "b"]).collect()
        # the only window left counts ranges, never rows
        plan = catalog.QUERIES["sort_deterministic"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["rank"] for r in got) == list(range(1, 6001)) and len({r.id for r in got}) == 6000
    keys = [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])]
    assert keys == sorted(keys)


def test_similar_pairs_deal_elements_once(spark):
    """Bytes shuffled for each element, where nearly all lie in one set alone; pairs of sets and copies are found."""
    from folia.operators import joins

    size, n = 200, 400
    sets = [list(range(size * i, size * (i + 1))) for i in range(n)]
    sets += [sets[0], sets[1][:150] + [-1] * 1, []]
    df = spark.createDataFrame([(i, "x" if i != 7 else None, x) for i, x in enumerate(sets)], "id bigint, family string, gs array<bigint>")
    jsc = spark.sparkContext._jsc.sc()

    def shuffled():
        jsc.listenerBus().waitUntilEmpty(30_000)
        return sum(jsc.statusStore().executorList(True).apply(i).totalShuffleWrite() for i in range(jsc.statusStore().executorList(True).size()))

    at = shuffled()
    got = sorted((r.a, r.b, r.jaccard) for r in joins.similar_pairs(df, 0.5).collect())
    assert got == [(0, n, 1.0), (1, n + 1, 150 / 201)]
    assert 8 < (shuffled() - at) / (size * n) < 25


def test_shingle_counts(spark, tmp_path):
    texts = ["", "   ", None, "abc", "a b c d e f g h i a b c d e f g h", "hello world, hello world, hello world", "Ä日本 \U0001f600 x  y z\n", "ab " * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES["str_char_shingles"](spark, str(tmp_path))
    got = {r.doc_id: (r.n, r.n_words) for r in df.collect()}
    for i, t in enumerate(texts):
        t = None if t is None else re.sub(r"\s+", " ", t).strip(" ").lower()
        w = (t or "").split(" ")
        n = len({t[k : k + 12] for k in range(len(t) - 11)}) if t and len(t) >= 12 else int(bool(t))
        assert got[i] == (n, len({tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))}) if t is not None else 0)
    # no column of windows
    assert "array_distinct" not in df._jdf.queryExecution().optimizedPlan().toString()
