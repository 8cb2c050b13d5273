"""Join operators. Equality keys carry every join; points and boxes meet within their image or page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions.geometry import bilinear
from folia.sources.sinks import stored

#: rows and bytes up to which a lookup side is broadcast; larger ones are joined by a shuffle
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have few rows and few bytes (of its rows as text)."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])))
    n, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= limit and size <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions; large inputs are left as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def micro(c: Column) -> Column:
    """A coordinate as a key: its millionths (coordinates are equal at six places)."""
    return F.bround(c * 1e6, 0).cast("bigint")


def probe_features(probes: DataFrame, features: DataFrame, *, nearest: bool = True) -> DataFrame:
    """Probes (image, x6, y6) with the vector of their point; ``miss`` tells a missing image from a missing point, with the nearest one there."""
    images = features.select("image").distinct().withColumn("_has", F.lit(True))
    j = probes.join(features, ["image", "x6", "y6"], "left").join(images, "image", "left")
    j = j.withColumn("miss", F.when(F.col("vec").isNotNull(), F.lit(None)).when(F.col("_has"), "point").otherwise("image").cast("string")).drop("_has")
    if not nearest:
        return j
    lost = j.where("miss = 'point'").select("probe", "image", "x6", "y6")
    f = features.select("image", F.col("x6").alias("fx"), F.col("y6").alias("fy"))
    dist = (F.col("x6") - F.col("fx")) ** 2 + (F.col("y6") - F.col("fy")) ** 2
    near = lost.join(f, "image").groupBy("probe").agg(F.min_by(F.struct("fx", "fy"), F.struct(dist.alias("d"), "fx", "fy")).alias("nearest"))
    return j.join(near, "probe", "left")


def assembled(probes: DataFrame, features: DataFrame, *, grid: int) -> DataFrame:
    """``probes`` (image_id, pooled, point_xy) with ``vec`` and ``layout`` from ``features`` (image_id, tokens, sites, pooled).

    Pooled rows read the pooled vector. Others read the whole grid where an image has one (bilinear between the cells of
    ``grid`` x ``grid`` tokens), else the site stored at exactly their point (six places); a point that isn't stored is an
    error. Images without features have null in both.
    """
    f = features.select("image_id", "tokens", "sites", F.col("pooled").alias("_pooled"), F.lit(True).alias("_known"))
    j = probes.join(f, "image_id", "left")
    x, y = F.get("point_xy", 0), F.get("point_xy", 1)
    channels = F.sequence(F.lit(0), F.size(F.get("tokens", 0)) - 1)
    sampled = F.transform(channels, lambda c: bilinear(F.transform("tokens", lambda t: F.get(t, c)), x, y, grid))
    at = F.filter("sites", lambda s: (micro(s["x"]) == micro(x)) & (micro(s["y"]) == micro(y)))
    stored = F.coalesce(F.get(at, 0)["vec"], F.raise_error(F.concat(F.lit("no stored site at the point of a probe of "), F.col("image_id"))).cast("array<double>"))
    vec = F.when(F.col("_known").isNull(), F.lit(None)).when(F.col("pooled"), F.col("_pooled")).when(F.col("tokens").isNotNull(), sampled).otherwise(stored)
    layout = F.when(F.col("_known").isNull(), F.lit(None)).when(F.col("pooled"), "pooled").when(F.col("tokens").isNotNull(), "grid").otherwise("sites")
    return j.withColumn("vec", vec).withColumn("layout", layout).select(*probes.columns, "vec", "layout")


def with_sidecar(manifest: DataFrame, path_col: str, files: DataFrame, root: str, schema: str) -> DataFrame:
    """``manifest`` with ``sidecar``, the nested content of the file (path, content) that a whole path or one from ``root`` names; null where there is none."""
    path = F.when(F.startswith(path_col, F.lit("/")), F.col(path_col)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path_col))
    side = files.select(F.col("path").alias("_path"), F.from_json("content", schema).alias("sidecar"))
    return manifest.withColumn("_path", path).join(side, "_path", "left").drop("_path")


def missing(manifest: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Rows of ``manifest`` whose key is not in a listing."""
    return manifest.join(small(listing.select(key)), key, "left_anti")


def in_all(df: DataFrame, key: str, by: str, k: int) -> DataFrame:
    """Keys that occur with k values of ``by``."""
    return df.groupBy(key).agg(F.count_distinct(by).alias("n")).where(F.col("n") == k).select(key)


def cyclic_partner(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Each id beside the next one of its group, the last beside the first; groups of one are left out."""
    w = Window.partitionBy(*group)
    df = df.withColumn("n", F.count("*").over(w)).withColumn("partner", F.coalesce(F.lead(order).over(w.orderBy(order)), F.min(order).over(w)))
    return df.where("n > 1").drop("n")


def containment(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """Shared distinct shingles of (doc, g), repeats allowed, and (gold, g, n_gold), with their share of the gold's.

    Document shingles are cut down to those of any gold text before anything is grouped or made distinct.
    """
    postings = small(gold.select("gold", "g", "n_gold"))
    hits = docs.join(postings, "g").groupBy("doc", "gold", "n_gold").agg(F.count_distinct("g").alias("shared"))
    return hits.withColumn("gold_share", F.col("shared") / F.col("n_gold"))


def similar_pairs(df: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, jaccard) of ids of one family whose sets (id, family, gs: distinct elements) are ``threshold`` alike or more.

    Equal sets are compared once. Only sets that share one of their rarest elements can be alike (of n elements the first
    n - ceil(threshold * n) + 1 by frequency), so that what many sets have in common puts nothing together. Elements, as
    64-bit hashes, are dealt out once; those of one set alone only count from there on, since two sets have in common
    what each of them shares with others, and candidates of fitting sizes are compared on that.
    """
    # sets are computed once, hashed and told apart when they are read again; those of no family have no partners
    hashed = df.where("family IS NOT NULL").select("id", "family", F.sort_array(F.transform("gs", lambda g: F.xxhash64(g))).alias("hs"))
    rows = stored(hashed, "sets").where(F.size("hs") > 0).select("id", F.xxhash64("family", "hs").alias("set"), F.size("hs").alias("n"), "family", "hs")
    members = stored(rows.select("id", "set"), "sets")
    # the same set and size row after row costs a shuffle little; a family's elements are its own
    dealt = rows.select("set", "n", "family", F.explode("hs").alias("h")).select("set", "n", F.xxhash64("family", "h").alias("k")).repartition("k")
    of_element = Window.partitionBy("k").orderBy("set")
    once = dealt.withColumn("last", F.lag("set").over(of_element)).where("last IS NULL OR last <> set").drop("last")
    often = once.withColumn("often", F.count("*").over(Window.partitionBy("k"))).where("often > 1")
    by_set = often.groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("often", "k"))).alias("ks"))
    sets = stored(by_set.select("set", "n", F.transform("ks", lambda x: x["k"]).alias("ks")), "sets")
    # elements of one set alone come first and can't be shared
    first = F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1 - (F.col("n") - F.size("ks"))
    prefix = sets.select("set", "n", F.explode(F.slice("ks", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("k"))
    a, b = (prefix.select("k", F.col("set").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    near = a.join(b, "k").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold)))
    near = near.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    # what two sets have in common lies in both prefixes or behind that prefix which ends first
    behind = F.greatest(*(F.ceil(F.col(n) * F.lit(threshold)) - 1 for n in ("na", "nb")))
    near = near.where(F.col("both") + behind >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6).drop("both")
    for x in "ab":
        near = near.join(sets.select(F.col("set").alias(x), F.col("ks").alias(f"k{x}")), x)
    shared = F.size(F.array_intersect("ka", "kb"))
    pairs = near.select("a", "b", (shared / (F.col("na") + F.col("nb") - shared)).alias("jaccard")).where(F.col("jaccard") >= threshold)
    same = members.groupBy("set").agg(F.count("*").alias("n")).where("n > 1").select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("jaccard"))
    pairs = pairs.unionByName(same)
    for x in "ab":
        pairs = pairs.join(members.select(F.col("set").alias(x), F.col("id").alias(f"id_{x}")), x)
    inside = F.col("a") == F.col("b")
    pairs = pairs.where(~inside | (F.col("id_a") < F.col("id_b")))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "jaccard")


def fuzzy_ids(scans: DataFrame, packages: DataFrame, width: int = 8, limit: int = 2) -> DataFrame:
    """Scans (scan, name) with the package (package) whose ``width``-character id begins the name, or is nearest to a part of it within ``limit`` edits; ``state`` tells ambiguous and unmatched ones."""
    windows = scans.select("scan", "name", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name") - (width - 1))), lambda i: F.struct(i.alias("at"), F.substring("name", i, F.lit(width)).alias("part")))).alias("w"))
    cost = F.when((F.col("w.at") == 1) & (F.col("w.part") == F.col("package")), F.lit(-1)).otherwise(F.levenshtein("w.part", "package"))
    # the list of packages is small by nature; each scan looks at all of them once
    best = windows.join(small(packages), F.abs(F.length("w.part") - F.length("package")) <= limit).withColumn("cost", cost).groupBy("scan", "package").agg(F.min("cost").alias("cost")).where(F.col("cost") <= limit)
    w = Window.partitionBy("scan")
    top = best.withColumn("least", F.min("cost").over(w)).where("cost = least").groupBy("scan").agg(F.count("*").alias("n"), F.min("package").alias("package"))
    j = scans.join(top, "scan", "left")
    state = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return j.select("scan", state.alias("state"), F.when(state == "ok", F.col("package")).alias("package"))
