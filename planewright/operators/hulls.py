"""Convex hulls of groups of any size, and what follows from them: hulls of partitions' hulls, so that no task holds a group's points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewright.functions import geometry as G
from planewright.functions import kernels as K

#: Partial hulls of so many lots of partitions are put together before the last step.
LOTS = 64


def _hulled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hulls of runs of rows with one key (rows come sorted by key): one hull in memory at a time."""
    key, held = None, None

    def out() -> pd.DataFrame:
        return pd.DataFrame({"key": key, "id": held["id"], "x": held["x"], "y": held["y"]})

    for frame in frames:
        for k, part in frame.groupby("key", sort=False):
            if held is not None and k != key:
                yield out()
                held = None
            both = part if held is None else pd.concat([held, part])
            # of points in one place the one with the least id
            both = both.sort_values(["x", "y", "id"]).drop_duplicates(["x", "y"])
            key, held = k, both.iloc[K.convex_hull(both[["x", "y"]].to_numpy())]
    if held is not None:
        yield out()


def hulls(points: DataFrame, key: str, p: str = "p", pid: str | None = None) -> DataFrame:
    """(key, ring) or, with ``pid``, (key, ring, ids): each group's hull, counter-clockwise, as an array of points, and their ids.

    Every partition keeps the hulls of what it has read; those of a lot of partitions are put
    together, and then those of the lots. Rows without a key or a coordinate are left out.
    """
    kind = points.schema[key].dataType.simpleString()
    number = F.col(pid).cast("long") if pid else F.lit(0).cast("long")
    rows = points.select(F.col(key).alias("key"), number.alias("id"), F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y")).dropna(subset=["key", "x", "y"])

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _hulled(frames):
            yield pd.DataFrame({"key": frame["key"][:1].tolist(), "ring": [[{"x": x, "y": y} for x, y in zip(frame["x"], frame["y"], strict=True)]], "ids": [frame["id"].tolist()]})

    schema = f"key {kind}, id long, x double, y double"
    first = rows.sortWithinPartitions("key").mapInPandas(_hulled, schema).withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(LOTS)))
    second = first.repartition("key", "lot").sortWithinPartitions("key").select("key", "id", "x", "y").mapInPandas(_hulled, schema)
    found = second.repartition("key").sortWithinPartitions("key").mapInPandas(last, f"key {kind}, ring array<struct<x: double, y: double>>, ids array<bigint>").withColumnRenamed("key", key)
    return found if pid else found.drop("ids")


def in_hull(ring: str, p: str) -> Column:
    """Whether a point lies in a hull (counter-clockwise) or on its border: left of all edges, or on them."""
    a, b = f"{ring}[i]", f"{ring}[(i + 1) % size({ring})]"
    left = f"forall(sequence(0, size({ring}) - 1), i -> ({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x) >= 0)"
    return F.when(F.size(ring) > 2, F.expr(left)).otherwise(F.lit(False))


def principal_frames(points: DataFrame, key: str, p: str = "p") -> DataFrame:
    """(key, center, angle, ring): each group's mean, the direction in which it spreads most, and its hull.

    Mean and direction are sums over all rows; extents along any direction are those of the hull.
    """
    x, y = F.col(f"{p}.x"), F.col(f"{p}.y")
    cxy, sxx, syy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
    straight = F.when(sxx >= syy, F.lit(0.0)).otherwise(F.lit(np.pi / 2))
    most = (sxx + syy + F.sqrt(F.pow(sxx - syy, F.lit(2.0)) + 4 * cxy * cxy)) / 2
    angle = F.when(F.abs(cxy * F.count(x)) < 1e-10, straight).otherwise(F.atan2(cxy, most - syy))
    frames = points.filter(x.isNotNull() & y.isNotNull()).groupBy(key).agg(G.point(F.avg(x), F.avg(y)).alias("center"), angle.alias("angle"))
    return frames.join(hulls(points, key, p), key)


def _turned(frames: DataFrame) -> DataFrame:
    """The hull's corners in the frame: along the direction (u) and across it (v)."""
    to = lambda q: F.struct(
        ((q.x - F.col("center.x")) * F.cos("angle") + (q.y - F.col("center.y")) * F.sin("angle")).alias("u"),
        ((q.y - F.col("center.y")) * F.cos("angle") - (q.x - F.col("center.x")) * F.sin("angle")).alias("v"),
    )
    t = frames.withColumn("t", F.transform("ring", to))
    low, high = (lambda f: F.array_min(F.transform("t", lambda q: q[f]))), (lambda f: F.array_max(F.transform("t", lambda q: q[f])))
    return t.withColumns({"u0": low("u"), "u1": high("u"), "v0": low("v"), "v1": high("v")})


def _at(u: Column, v: Column) -> Column:
    return G.point(F.col("center.x") + u * F.cos("angle") - v * F.sin("angle"), F.col("center.y") + u * F.sin("angle") + v * F.cos("angle"))


def principal_boxes(points: DataFrame, key: str, p: str = "p") -> DataFrame:
    """(key, center, half_width, half_height, angle): the box round each group along its principal direction."""
    t = _turned(principal_frames(points, key, p))
    u0, u1, v0, v1 = map(F.col, ("u0", "u1", "v0", "v1"))
    return t.select(key, _at((u0 + u1) / 2, (v0 + v1) / 2).alias("center"), ((u1 - u0) / 2).alias("half_width"), ((v1 - v0) / 2).alias("half_height"), "angle")


def principal_capsules(points: DataFrame, key: str, p: str = "p") -> DataFrame:
    """(key, start, end, radius): a capsule round each group whose spine runs through its mean along its principal direction."""
    t = _turned(principal_frames(points, key, p))
    zero = F.lit(0.0)
    return t.select(key, _at(F.col("u0"), zero).alias("start"), _at(F.col("u1"), zero).alias("end"), F.greatest(F.abs("v0"), F.abs("v1")).alias("radius"))


def diameter_capsules(points: DataFrame, key: str, p: str = "p") -> DataFrame:
    """(key, start, end, radius): a capsule whose spine is each group's farthest pair; the radius reaches the corner farthest from it."""
    h = hulls(points, key, p)
    far = F.expr("array_max(flatten(transform(ring, (a, i) -> transform(ring, (b, j) -> struct(power(a.x - b.x, 2) + power(a.y - b.y, 2) AS d, -i AS i, -j AS j)))))")
    t = h.withColumn("f", far).select(key, "ring", F.expr("ring[-f.i]").alias("start"), F.expr("ring[-f.j]").alias("end"))
    away = F.array_max(F.transform("ring", lambda q: G.segment_point_distance(G.segment(F.col("start"), F.col("end")), q)))
    return t.select(key, "start", "end", away.alias("radius"))
