"""Connected components of an edge table by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: a node with more than this share of all edges is joined by a broadcast of such nodes, of which there can be a few times HOT at most
HOT = 500


def _star(edges: DataFrame, both: bool, n: int) -> DataFrame:
    """Large star (``both``: neighbours on either side, larger ones are moved) or small star (smaller neighbours and the node are moved) of ``n`` edges."""
    e = edges.select("u", "v")
    if both:
        e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n")
    hot = F.col("n") > n // HOT + 8
    # the edges of hot nodes get their minimum from the broadcast and are spread by their other end
    j = e.join(F.broadcast(m.where(hot).select(F.col("k").alias("u"), F.col("m").alias("h"))), "u", "left").withColumn("at", F.when(F.col("h").isNull(), F.col("u")).otherwise(F.col("v")))
    j = j.join(m.select("k", "m"), F.col("at") == F.col("k"), "left").select("u", "v", F.coalesce("h", "m").alias("m"))
    if both:
        out = j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node of its component. Each round is stored in the shared folder."""
    e = stored(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").distinct(), "edges")
    sign = None
    while True:
        row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == tuple(row) or not row[0]:
            break
        sign = tuple(row)
        e = stored(_star(_star(e, True, row[0]), False, row[0]), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
