"""Connected components of an edge table, by hooking and contraction.

Each round every label hooks to the smallest label it has an edge to, the
chains of hooks are shortened, and the edges are rewritten to the new labels;
edges inside a label vanish. Rounds grow with the logarithm of the number of
nodes. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A key of more rows than this, and than a millionth of all, is split over several tasks.
HEAVY = 1 << 16


def heavy_keys(counts: DataFrame, key: str, total: int, heavy: int = HEAVY) -> DataFrame | None:
    """counts(key, n) -> key and into how many it is split; None if there is none. At most a million rows, as n sums to total."""
    least = max(heavy, -(-total // 1_000_000))
    if (counts.agg(F.max("n")).first()[0] or 0) < least:
        return None
    return F.broadcast(saved(counts.where(F.col("n") >= least).select(key, F.ceil(F.col("n") / least).cast("int").alias("_salts"))))


def split_join(big: DataFrame, one: DataFrame, key: str, spread: str, heavy: DataFrame | None) -> DataFrame:
    """big joined with `one` (a row a key). Rows of a heavy key go to several tasks by their `spread`, and so do copies of its row."""
    if heavy is None:
        return big.join(one, key)
    salts = F.coalesce("_salts", F.lit(1))
    b = big.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    o = one.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return b.join(o, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", heavy: int = HEAVY) -> DataFrame:
    """edges(a, b: bigint) -> node, label: the smallest node of its component, for every node of an edge between two nodes."""
    live = saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    labels = None
    while n := live.count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        hubs = heavy_keys(least.select("a", "n"), "a", 2 * n, heavy)
        hook = least.select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
        for _ in range(2):
            # many nodes may hang on one label: those are the hubs
            up = hook.select(F.col("node").alias("label"), F.col("label").alias("top"))
            hook = split_join(hook, up, "label", "node", None if hubs is None else hubs.withColumnRenamed("a", "label")).select("node", F.col("top").alias("label"))
        hook = saved(hook)
        if labels is None:
            labels = hook
        else:
            up = hook.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = saved(labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        ha = hook.select(F.col("node").alias("a"), F.col("label").alias("x"))
        hb = hook.select(F.col("node").alias("b"), F.col("label").alias("y"))
        moved = split_join(live, ha, "a", "b", hubs)
        moved = split_join(moved, hb, "b", "a", None if hubs is None else hubs.withColumnRenamed("a", "b"))
        live = saved(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
