"""The k nearest points or boxes of every query, on tiles with like numbers of items.

A query looks in its own tile first; the k-th distance found there, or at worst the far side of a
tile known to hold k items, bounds the other tiles that it must visit. So a query meets the items of
a few tiles, however many there are in all and however they are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planewright.functions import geometry as G
from planewright.operators.components import cut
from planewright.operators.tiles import Tree, cuts

#: Items in a tile, queries that one task takes to a tile at a time, and items below which a task compares all.
TILE, LOT, LEAF = 2000, 20_000, 64
#: Powers of two of box sizes below the largest that have tiles of their own.
CLASSES = 10


def _gaps(boxes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of queries (rows) to boxes (columns)."""
    dx = np.maximum(0, np.maximum(boxes[None, :, 0] - q[:, None, 0], q[:, None, 0] - boxes[None, :, 2]))
    dy = np.maximum(0, np.maximum(boxes[None, :, 1] - q[:, None, 1], q[:, None, 1] - boxes[None, :, 3]))
    return np.sqrt(dx * dx + dy * dy)


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)


def k_nearest(boxes: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, ids and distances of at most k boxes within each query's bound, nearest first, ties by id."""
    centre = (boxes[:, :2] + boxes[:, 2:]) / 2
    tree = Tree(centre, max(1, -(-len(boxes) // max(LEAF, 2 * k))))
    leaf = tree.leaf_of(*centre.T)
    own = np.argsort(leaf, kind="stable")
    border = np.searchsorted(leaf[own], np.arange(len(tree.rects) + 1))
    members = [own[border[t] : border[t + 1]] for t in range(len(tree.rects))]
    nodes = tree.around(np.array([[*boxes[m, :2].min(0), *boxes[m, 2:].max(0)] if len(m) else [np.nan] * 4 for m in members]))
    home = tree.leaf_of(*q.T)
    bound = bound.copy()
    for t in np.unique(home):
        rows = np.flatnonzero(home == t)
        bound[rows] = np.minimum(bound[rows], _kth(_gaps(boxes[members[t]], q[rows]), k))
    row, tile = tree.within(nodes, *q.T, bound)
    out_q, out_i, out_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    order = np.argsort(tile, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1) if len(order) else []:
        m, rows = members[tile[part[0]]], row[part]
        d = _gaps(boxes[m], q[rows])
        a, b = np.nonzero(d <= np.minimum(bound[rows], _kth(d, k))[:, None] * (1 + 1e-12))
        out_q.append(rows[a])
        out_i.append(m[b])
        out_d.append(d[a, b])
    n, i, d = map(np.concatenate, (out_q, out_i, out_d))
    order = np.lexsort((ids[i], d, n))
    n, i, d = n[order], i[order], d[order]
    first = np.searchsorted(n, n)
    kept = np.arange(len(n)) - first < k
    return n[kept], ids[i[kept]], d[kept]


def nearest_boxes(queries: DataFrame, boxes: DataFrame, k: int, qid: str = "qid", qp: str = "q", bid: str = "id", b: str = "b", tile: int = TILE, lot: int = LOT) -> DataFrame:
    """(qid, id, distance, rank): the k nearest boxes of each query point, ties by the smaller id; all of them if there are fewer.

    Boxes of unlike sizes have tiles of their own, so that few large ones don't widen those of many
    small. Of equal boxes those with the k smallest ids count. Queries of a crowded tile are dealt to
    several tasks. Rows without an id or a coordinate are left out.
    """
    spark = queries.sparkSession
    edges = ("min_x", "min_y", "max_x", "max_y")
    rows = boxes.select(F.col(bid).cast("long").alias("id"), *(F.col(f"{b}.{e}").cast("double").alias(e) for e in edges)).dropna()
    equal = Window.partitionBy(*edges).orderBy("id")
    rows = rows.withColumn("__r", F.row_number().over(equal)).filter(F.col("__r") <= k).drop("__r")
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    top = rows.agg(F.max(F.when(side > 0, F.ceil(F.log2(side))))).first()[0]
    size = F.lit(0) if top is None else F.coalesce(F.greatest(F.when(side > 0, F.ceil(F.log2(side))), F.lit(top - CLASSES)), F.lit(top - CLASSES)).cast("int")
    rows = cut(rows.select("*", size.alias("size"), ((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("y")))
    classes = [r[0] for r in rows.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()]
    empty = "qid {q}, id long, distance double, rank int".format(q=queries.schema[qid].dataType.simpleString())
    if not classes:
        return spark.createDataFrame([], empty).withColumnRenamed("qid", qid)
    found = cuts(rows, "size", max(tile, 2 * k))
    trees = [found[c][0] if c in found else Tree(np.zeros((0, 2)), 1) for c in classes]
    first = np.cumsum([0] + [len(t.rects) for t in trees])
    held = spark.sparkContext.broadcast((classes, trees, first))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, trees, first = held.value
        for f in frames:
            for c, part in f.groupby("size"):
                n = names.index(c)
                yield part[["id", *edges]].assign(tile=first[n] + trees[n].leaf_of(part["x"].to_numpy(), part["y"].to_numpy()))

    items = cut(rows.mapInPandas(placed, "id long, min_x double, min_y double, max_x double, max_y double, tile long"))
    stats = items.groupBy("tile").agg(F.count("*"), *(f(e) for f, e in zip((F.min, F.min, F.max, F.max), edges, strict=True))).collect()
    counts, around = np.zeros(first[-1], np.int64), np.full((first[-1], 4), np.nan)
    for r in stats:
        counts[r[0]], around[r[0]] = r[1], r[2:6]
    nodes = [t.around(around[a:z]) for t, a, z in zip(trees, first[:-1], first[1:], strict=True)]
    #: per node of the most common class how many items lie below it
    below = np.zeros(len(trees[0].axis), np.int64)
    for n in range(len(below) - 1, -1, -1):
        below[n] = counts[trees[0].leaf[n]] if trees[0].leaf[n] >= 0 else below[trees[0].left[n]] + below[trees[0].right[n]]
    known = spark.sparkContext.broadcast((nodes, below))
    kind = queries.schema[qid].dataType.simpleString()

    def at_home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query's own tile, and a bound: the far corner of the smallest part of the tree round it that holds k items."""
        (_, trees, first), (nodes, below) = held.value, known.value
        tree = trees[0]
        for f in frames:
            x, y = f["x"].to_numpy(), f["y"].to_numpy()
            bound = np.full(len(f), np.inf)
            todo = [(0, np.arange(len(f)))]
            while todo:
                n, rows = todo.pop()
                if below[n] < k or not len(rows):
                    continue
                u, v, w, z = nodes[0][n]
                far = np.hypot(np.maximum(np.abs(x[rows] - u), np.abs(x[rows] - w)), np.maximum(np.abs(y[rows] - v), np.abs(y[rows] - z)))
                bound[rows] = np.minimum(bound[rows], far)
                if tree.leaf[n] < 0:
                    low = (y if tree.axis[n] else x)[rows] < tree.value[n]
                    todo += [(tree.left[n], rows[low]), (tree.right[n], rows[~low])]
            yield f.assign(bound=bound, tile=first[0] + tree.leaf_of(x, y))

    def abroad(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for every other tile within its bound."""
        (_, trees, first), (nodes, _) = held.value, known.value
        for f in frames:
            x, y = f["x"].to_numpy(), f["y"].to_numpy()
            reach, home = np.minimum(f["bound"].to_numpy(), f["kth"].to_numpy()), f["tile"].to_numpy()
            for n, tree in enumerate(trees):
                row, leaf = tree.within(nodes[n], x, y, reach)
                other = first[n] + leaf != home[row]
                yield f.iloc[row[other]][["qid", "x", "y"]].assign(bound=reach[row[other]], tile=first[n] + leaf[other])

    listed = f"qid {kind}, x double, y double, bound double, tile long, kth double, ids array<long>, distances array<double>"

    def probed(asked: DataFrame) -> DataFrame:
        """The nearest items of each query in its tile; a crowded tile's queries go to several tasks with the tile's items each."""
        sizes = {r[0]: -(-r[1] // lot) for r in asked.groupBy("tile").agg(F.count("*")).collect()}
        many = F.broadcast(spark.createDataFrame([(int(t), n) for t, n in sizes.items()], "tile long, lots int"))
        q = asked.join(many, "tile").withColumn("lot", F.pmod(F.xxhash64("qid"), F.col("lots"))).drop("lots")
        i = items.join(many, "tile").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots").cast("long") - 1))).drop("lots")

        def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            n, ids, d = k_nearest(c[list(edges)].to_numpy(), c["id"].to_numpy(), a[["x", "y"]].to_numpy(), k, a["bound"].to_numpy()) if len(a) and len(c) else (np.zeros(0, np.int64),) * 3
            border = np.searchsorted(n, np.arange(len(a) + 1))
            a = a[["qid", "x", "y", "bound", "tile"]].reset_index(drop=True)
            a["kth"] = [d[z - 1] if z - s == k else np.inf for s, z in zip(border[:-1], border[1:], strict=True)]
            a["ids"] = [ids[s:z] for s, z in zip(border[:-1], border[1:], strict=True)]
            a["distances"] = [d[s:z] for s, z in zip(border[:-1], border[1:], strict=True)]
            return a

        return q.groupBy("tile", "lot").cogroup(i.groupBy("tile", "lot")).applyInPandas(run, listed)

    asked = queries.select(F.col(qid).alias("qid"), F.col(f"{qp}.x").cast("double").alias("x"), F.col(f"{qp}.y").cast("double").alias("y")).dropna()
    asked = cut(asked.mapInPandas(at_home, f"qid {kind}, x double, y double, bound double, tile long"))
    here = cut(probed(asked))
    there = probed(cut(here.mapInPandas(abroad, f"qid {kind}, x double, y double, bound double, tile long")))
    every = here.unionByName(there).select("qid", F.explode(F.arrays_zip("ids", "distances")).alias("n")).select("qid", F.col("n.ids").alias("id"), F.col("n.distances").alias("distance"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("qid", qid)


def nearest(queries: DataFrame, points: DataFrame, k: int, qid: str = "qid", qp: str = "q", pid: str = "id", pp: str = "p", **options: int) -> DataFrame:
    """(qid, id, distance, rank): the k nearest points of each query, ties by the smaller id."""
    p = F.col(pp)
    flat = points.select(F.col(pid).alias("id"), G.box(p.x, p.y, p.x, p.y).alias("b"))
    return nearest_boxes(queries, flat, k, qid, qp, **options)
