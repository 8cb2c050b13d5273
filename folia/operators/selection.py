"""Windowed selection and sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.sources.sinks import stored


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))


def ranked_whole(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """The place of every row among all, by columns in ascending order.

    Ranges of the order are sorted apart and written once with each row's place in its range; the rows of the ranges
    before are then added, so that no task holds more than a range.
    """
    bits = 33  # of the id within a task
    at = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    at = at.withColumn("_range", F.shiftright("_at", bits))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = at.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    return at.join(F.broadcast(ranges), "_range").withColumn(name, place).drop("_at", "_range", "_before")


def relaxed_selection(pages: DataFrame, *, doc: str, cluster: str, order: list, per_doc: int, per_cluster: int) -> DataFrame:
    """At most ``per_doc`` pages of a document and then ``per_cluster`` of a cluster, by rank: the set form of round-robin selection, in two shuffles."""
    kept = ranked(pages, [doc], order, "_d").where(F.col("_d") <= per_doc)
    return ranked(kept, [cluster], order, "_c").where(F.col("_c") <= per_cluster).drop("_d", "_c")


def round_robin(pages: DataFrame, *, doc: str, cluster: str, order: str, target: int, per_doc: int, per_cluster: int) -> DataFrame:
    """Breadth before depth, exactly: pass q lets each document reach q pages; in a pass the clusters, rarest first, give one page in turn.

    The order of turns makes this one sequential walk; its input is cut to the pages that any walk can reach first
    (``per_doc`` of a document), and grouped as one table.
    """
    sizes = pages.groupBy(cluster).agg(F.count("*").alias("_n"))
    cut = ranked(pages, [doc, cluster], [order], "_k").where(F.col("_k") <= per_doc).drop("_k").join(sizes, cluster)
    schema = cut.drop("_n").withColumn("turn", F.lit(0).cast("bigint")).schema

    def walk(table: pd.DataFrame) -> pd.DataFrame:
        queues = {c: list(g.sort_values(order).index) for c, g in table.groupby(cluster)}
        rarity = sorted(queues, key=lambda c: (table.loc[queues[c][0], "_n"], c))
        docs, taken, out = {}, dict.fromkeys(queues, 0), []
        for q in range(1, per_doc + 1):
            moved = True
            while moved and len(out) < target:
                moved = False
                for c in rarity:
                    if len(out) >= target:
                        break
                    if taken[c] >= per_cluster:
                        continue
                    pick = next((i for i in queues[c] if docs.get(table.at[i, doc], 0) < q), None)
                    if pick is not None:
                        queues[c].remove(pick)
                        docs[table.at[pick, doc]] = docs.get(table.at[pick, doc], 0) + 1
                        taken[c] += 1
                        out.append(pick)
                        moved = True
        got = table.loc[out].drop(columns="_n")
        got["turn"] = range(len(got))
        return got

    return cut.groupBy().applyInPandas(walk, schema)


def capped(df: DataFrame, by: list[str], key: Column, cap: int) -> DataFrame:
    """At most ``cap`` rows of a group, those with the smallest hash."""
    return ranked(df, by, [F.xxhash64(key), key], "_r").where(F.col("_r") <= cap).drop("_r")


def stratified(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """About ``k`` rows in proportion to the groups, one of each at least."""
    n = df.groupBy(by).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"))
    quota = n.crossJoin(total).withColumn("_q", F.greatest(F.lit(1), F.bround(F.lit(k) * F.col("_n") / F.col("_t"), 0))).select(by, "_q")
    return ranked(df.join(F.broadcast(quota) if quota.limit(10_001).count() <= 10_000 else quota, by), [by], order, "_r").where("_r <= _q").drop("_r", "_q")


def group_split(df: DataFrame, doc: str, group: str, train: Column) -> DataFrame:
    """Rows of each document's majority group (ties: the first), with the side that the group falls on."""
    c = df.groupBy(doc, group).agg(F.count("*").alias("_n"))
    major = ranked(c, [doc], [F.desc("_n"), group], "_r").where("_r = 1").select(doc, F.col(group).alias("major"))
    j = df.join(major, doc).withColumn("train", train)
    return j


def islands(df: DataFrame, by: list[str], order: str, flag: Column, least: int = 2) -> DataFrame:
    """Runs of ``least`` neighbouring flagged rows or more: (by, first, last, n)."""
    w = Window.partitionBy(*by).orderBy(order)
    f = df.withColumn("_f", flag).withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    return f.where("_f").groupBy(*by, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_g")
