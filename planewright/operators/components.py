"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Nodes with more than the HOT-th part of all edges (there are fewer than 2 * HOT of them) are broadcast with their new neighbour, so that their edges stay where they are.
HOT, HOT_EDGES = 4096, 8192


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    bound = max(HOT_EDGES, total // HOT)
    if total > bound:
        hot, cold = F.broadcast(least.filter(F.col("n") > bound).drop("n")), least.filter(F.col("n") <= bound).drop("n")
        hung = both.join(hot, "a").unionByName(both.join(hot, "a", "left_anti").join(cold, "a"))
    else:
        hung = both.join(least.drop("n"), "a")
    if large:
        return hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once: checkpointed to the shared folder in ``spark.checkpoint.dir``, or persisted where none is set."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): large-star and small-star steps until nothing changes; roots have no row.

    Each round is checkpointed to the shared folder in ``spark.checkpoint.dir`` where one is set.
    """
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = cut(edges.filter("a <> b").distinct())
    now = mark(edges)
    while True:
        edges, before = cut(_star(_star(edges, True, now[0]), False, now[0])), edges
        after = mark(edges)
        before.unpersist()
        if after == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after
