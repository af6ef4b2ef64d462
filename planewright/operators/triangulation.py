"""Delaunay triangles and Voronoi cells of groups of points of any size, tile by tile.

A tile's task triangulates the points in it and in a halo. A triangle is final if the circle round it
lies in what the task has seen. Points all round which triangles are final are done; the others, a
thin skeleton along the hull and wherever circles were wide, go to the next round on wider tiles. A
triangulation of these alone holds all triangles that are still missing, and in place of the final
ones others that a look at one corner tells: they lie where a final triangle of that corner lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewright.functions.delaunay_kernel import delaunay, turn
from planewright.operators.components import cut
from planewright.operators.tiles import cuts

#: Points in a tile of the first round; four times as many in each later one.
TILE = 4000
#: Width of the first round's halo as a share of its tile; twice as wide in each later one.
HALO = 0.2

CORNERS = "a long, b long, c long, ax double, ay double, bx double, by double, cx double, cy double"


def circles(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Centres and safe radii of circles round triangles: infinite where a triangle is too flat to tell."""
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    error = 16 * 2.0**-53 * (np.abs(u[:, 0] * v[:, 1]) + np.abs(u[:, 1] * v[:, 0]))
    flat = np.abs(d) <= 4 * error
    d = np.where(flat, 1.0, d)
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    x, y = (v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d
    r = np.hypot(x, y) * (1 + 8 * error / np.abs(d) + 1e-12) + 1e-15 * np.abs(a).max(1, initial=0)
    return np.stack([a[:, 0] + x, a[:, 1] + y, np.where(flat, np.inf, r)], 1)


def final(ids: np.ndarray, p: np.ndarray, own: np.ndarray, wedges: list, rect: np.ndarray | None) -> np.ndarray:
    """Index triples of a tile's final triangles with an own corner; without ``rect`` all has been seen."""
    t = np.array(delaunay(p), np.int64).reshape(-1, 3)
    if rect is not None:
        c = circles(*(p[t[:, k]] for k in range(3)))
        r = c[:, 2]
        seen = np.ones(len(t), bool)
        for k, (edge, sign) in enumerate(((rect[0], -1), (rect[1], -1), (rect[2], 1), (rect[3], 1))):
            if np.isfinite(edge):
                with np.errstate(invalid="ignore"):
                    seen &= np.isfinite(r) & (sign * (c[:, k % 2] - edge) + r < 0)
        t = t[seen & own[t].any(1)]
    if any(w is not None and len(w) for w in wedges):
        point = [tuple(x) for x in p.tolist()]

        def covered(a: int, b: int) -> bool:
            """Whether a final triangle of corner a lies just to the left of the edge from a to b."""
            corner, towards = point[a], point[b]
            return any(turn(corner, (w["px"], w["py"]), towards) >= 0 and turn(corner, towards, (w["qx"], w["qy"])) > 0 for w in (wedges[a] if wedges[a] is not None else ()))

        t = t[[not covered(a, b) for a, b, _ in t.tolist()]] if len(t) else t
    # the corner with the least id comes first
    turned = np.argmin(ids[t], axis=1)[:, None] if len(t) else np.zeros((0, 1), np.int64)
    return np.take_along_axis(t, (turned + np.arange(3)) % 3, axis=1)


def _round(rows: DataFrame, trees: dict, halo: float) -> DataFrame:
    """Final triangles of one round over (grp, id, x, y, wedges)."""
    kind = rows.schema["grp"].dataType.simpleString()
    grown = {g: tree.grown(p, halo) for g, (tree, p) in trees.items()}
    held = rows.sparkSession.sparkContext.broadcast({g: (tree, grown[g], tree.around(grown[g])) for g, (tree, _) in trees.items()})
    wedge = "array<struct<px: double, py: double, qx: double, qy: double>>"

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, part in frame.groupby("grp", sort=False):
                if g not in held.value:
                    yield part.assign(tile=-1, own=True)
                    continue
                tree, _, nodes = held.value[g]
                x, y = part["x"].to_numpy(), part["y"].to_numpy()
                row, tile = tree.within(nodes, x, y, np.zeros(len(x)))
                yield part.iloc[row].assign(tile=tile, own=tree.leaf_of(x, y)[row] == tile)

    def made(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        g, tile = key
        ids, p = frame["id"].to_numpy(), frame[["x", "y"]].to_numpy(float)
        t = final(ids, p, frame["own"].to_numpy(), list(frame["wedges"]), None if tile < 0 else held.value[g][1][tile])
        out = pd.DataFrame({"grp": [g] * len(t)} | {n: ids[t[:, k]] for k, n in enumerate("abc")})
        for k, n in enumerate("abc"):
            out[f"{n}x"], out[f"{n}y"] = p[t[:, k]].T
        return out

    tiles = rows.mapInPandas(dealt, f"grp {kind}, id long, x double, y double, wedges {wedge}, tile long, own boolean")
    found = tiles.groupBy("grp", "tile").applyInPandas(made, f"grp {kind}, {CORNERS}")
    return found.distinct() if trees else found


def _corners(triangles: DataFrame) -> DataFrame:
    """(grp, id, wedge, p, q): for each corner of a triangle the two others, in turn."""
    turns = [("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")]
    each = F.array(*(F.struct(F.col(u).alias("id"), F.col(v).alias("p"), F.col(w).alias("q"), F.col(f"{v}x").alias("px"), F.col(f"{v}y").alias("py"), F.col(f"{w}x").alias("qx"), F.col(f"{w}y").alias("qy")) for u, v, w in turns))
    return triangles.select("grp", F.explode(each).alias("k")).select("grp", "k.id", "k.p", "k.q", F.struct("k.px", "k.py", "k.qx", "k.qy").alias("wedge"))


def delaunay_triangles(points: DataFrame, group: str, pid: str = "id", p: str = "p", tile: int = TILE, halo: float = HALO) -> DataFrame:
    """(group, a, b, c, ax, ay, bx, by, cx, cy): each group's triangles, counter-clockwise from the corner with the least id.

    Points in one place count as that with the smallest id; points on a line have no triangle, and of
    four on one circle the diagonal is settled by their order, so a group has one triangulation.
    Rows without a group, an id or a coordinate are left out. A group of at most ``tile`` points is
    one task's; of larger ones no task ever holds more than some tiles' worth.
    """
    rows = points.select(F.col(group).alias("grp"), F.col(pid).cast("long").alias("id"), F.col(f"{p}.x").cast("double").alias("x"), F.col(f"{p}.y").cast("double").alias("y")).dropna()
    rows = cut(rows.groupBy("grp", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(F.min("id").alias("id")).select("grp", "id", "x", "y"))
    left, found = rows.withColumn("wedges", F.lit(None).cast("array<struct<px: double, py: double, qx: double, qy: double>>")), []
    while True:
        trees = cuts(left, "grp", tile)
        fresh = cut(_round(left, trees, halo))
        found.append(fresh)
        if not trees:
            break
        large = F.broadcast(points.sparkSession.createDataFrame([(g,) for g in trees], left.select("grp").schema))
        corners = _corners(reduce(DataFrame.unionByName, found).join(large, "grp"))
        balance = F.sum(F.xxhash64("p").cast("decimal(20,0)") - F.xxhash64("q").cast("decimal(20,0)"))
        # a point is done when its triangles close up: their edges lead in and out alike
        done = corners.groupBy("grp", "id").agg(balance.alias("balance"), F.count("*").alias("n")).filter("balance = 0 AND n > 2")
        open_ = left.join(large, "grp").drop("wedges").join(done, ["grp", "id"], "left_anti")
        taken = corners.join(open_.select("grp", "id"), ["grp", "id"], "left_semi").groupBy("grp", "id").agg(F.collect_list("wedge").alias("wedges"))
        left = cut(open_.join(taken, ["grp", "id"], "left").select("grp", "id", "x", "y", "wedges"))
        tile, halo = tile * 4, halo * 2
    return reduce(DataFrame.unionByName, found).withColumnRenamed("grp", group)


def edges_of(triangles: DataFrame, group: str) -> DataFrame:
    """(group, a, b): the edges of triangles once each, a below b."""
    pair = lambda u, v: F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    return triangles.select(group, F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("a", "c"))).alias("e")).select(group, "e.a", "e.b").distinct()


def has_corner(pid: object) -> Column:
    """Whether a triangle has a point as a corner."""
    return F.lit(pid).isin(F.col("a"), F.col("b"), F.col("c")) if not isinstance(pid, Column) else (F.col("a") == pid) | (F.col("b") == pid) | (F.col("c") == pid)


def voronoi_cells(points: DataFrame, group: str, low: tuple[float, float], high: tuple[float, float], pid: str = "id", p: str = "p", **options: object) -> DataFrame:
    """(group, id, ring): the part of a box that is nearer to a point than to any other of its group.

    Each cell is cut out by the bisectors towards the points that share a Delaunay edge with its own.
    A group without triangles (on a line) has bisectors towards the neighbours on it.
    """
    from planewright.functions.polygon_kernels import voronoi_cell
    from planewright.operators.per_geometry import POINTS, _points

    sites = points.select(F.col(group).alias("grp"), F.col(pid).cast("long").alias("id"), F.col(f"{p}.x").cast("double").alias("x"), F.col(f"{p}.y").cast("double").alias("y")).dropna()
    sites = cut(sites.groupBy("grp", "x", "y").agg(F.min("id").alias("id")))
    triangles = cut(delaunay_triangles(sites.select("grp", "id", F.struct("x", "y").alias("p")), "grp", **options))
    pairs = _corners(triangles)
    near = pairs.select("grp", "id", F.col("wedge.px").alias("x"), F.col("wedge.py").alias("y")).unionByName(pairs.select("grp", "id", F.col("wedge.qx").alias("x"), F.col("wedge.qy").alias("y")))
    # points on a line are neighbours in its order
    from pyspark.sql import Window

    row = Window.partitionBy("grp").orderBy("x", "y")
    line = sites.join(triangles.select("grp").distinct(), "grp", "left_anti")
    beside = [line.select("grp", "id", step("x").over(row).alias("x"), step("y").over(row).alias("y")) for step in (F.lag, F.lead)]
    near = reduce(DataFrame.unionByName, [near, *beside]).dropna()
    sides = near.groupBy("grp", "id").agg(F.collect_set(F.struct("x", "y")).alias("near"))

    def cell(x: pd.Series, y: pd.Series, near: pd.Series) -> pd.Series:
        one = lambda a, b, n: _points(voronoi_cell(np.array([a, b]), np.array([[q["x"], q["y"]] for q in n] if n is not None else []).reshape(-1, 2), low, high))
        return pd.Series([one(*r) for r in zip(x, y, near, strict=True)], dtype=object)

    ring = F.pandas_udf(cell, POINTS)
    return sites.join(sides, ["grp", "id"], "left").select(F.col("grp").alias(group), "id", ring("x", "y", "near").alias("ring"))
