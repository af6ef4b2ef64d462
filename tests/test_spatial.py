"""Joins of boxes, nearest items, welding and distance transforms against brute force, with crowded and far-flung rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewright.functions import geometry as G
from planewright.operators import raster
from planewright.operators import spatial as S
from planewright.operators.neighbours import k_nearest, nearest, nearest_boxes

R = np.random.default_rng(5)


def boxes_of(spark, b, name, column):
    rows = [(i, *map(float, x)) for i, x in enumerate(b)] + [(9000, None, 0.0, 1.0, 1.0), (9001, 3.0, 3.0, 2.0, 2.0)]
    return spark.createDataFrame(rows, f"{name} long, x0 double, y0 double, x1 double, y1 double").select(name, G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias(column))


def points_of(spark, p, name, column):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(9002, None, 1.0)], f"{name} long, x double, y double").select(name, G.point(F.col("x"), F.col("y")).alias(column))


def mixed(n):
    """Boxes from points to one over everything, with shared borders."""
    side = np.where(R.random((n, 1)) < 0.2, 0, 10 ** R.uniform(-7, 1.5, (n, 1))) * R.uniform(0.1, 1, (n, 2))
    low = np.round(R.uniform(-20, 20, (n, 2)), R.integers(0, 4))
    out = np.concatenate([low, low + side], 1)
    out[:3] = [[-1e3, -1e3, 1e3, 1e3], [0, 0, 8, 8], [-8, -8, 0, 0]]
    return out


def test_points_in_boxes(spark, monkeypatch):
    b, p = mixed(250), np.concatenate([R.uniform(-20, 20, (300, 2)), [[0, 0], [8, 8], [8, 3]]])
    inside = (b[:, None, 0] <= p[:, 0]) & (p[:, 0] <= b[:, None, 2]) & (b[:, None, 1] <= p[:, 1]) & (p[:, 1] <= b[:, None, 3])
    for few in (S.FEW, 3):
        monkeypatch.setattr(S, "FEW", few)
        got = S.in_boxes(boxes_of(spark, b, "i", "b"), points_of(spark, p, "j", "p")).select("i", "j").collect()
        assert sorted(map(tuple, got)) == list(zip(*(k.tolist() for k in np.nonzero(inside)), strict=True))
    assert S.in_boxes(boxes_of(spark, b[:0], "i", "b").limit(0), points_of(spark, p, "j", "p")).collect() == []


def test_boxes_meet(spark):
    a, b = mixed(200), mixed(150)
    meet = ((a[:, None, :2] <= b[:, 2:]) & (b[:, :2] <= a[:, None, 2:])).all(2)
    left, right = boxes_of(spark, a, "i", "b"), boxes_of(spark, b, "j", "o")
    got = S.boxes_meeting(left, right).select("i", "j").collect()
    assert sorted(map(tuple, got)) == list(zip(*(k.tolist() for k in np.nonzero(meet)), strict=True))
    assert S.boxes_meeting(left.limit(0), right).collect() == []


def test_a_box_has_four_cells_at_most(spark):
    held, _ = S._levels(boxes_of(spark, mixed(200), "i", "b"), "b")
    assert S._own_cells(held, "b", "__l").groupBy("i").count().agg(F.max("count")).first()[0] <= 4


def gaps(b, q):
    d = np.maximum(0, np.maximum(b[None, :, :2] - q[:, None], q[:, None] - b[None, :, 2:]))
    return np.sqrt((d * d).sum(2))


@pytest.mark.parametrize("k", [1, 4, 2000])
def test_nearest_boxes(spark, k):
    b = np.concatenate([mixed(300), np.repeat([[1.0, 1, 2, 2]], 30, axis=0), *(R.normal(c, s, (200, 1, 2)).repeat(2, 1).reshape(-1, 4) for c, s in ((0, 1e-3), (15, 0.1)))])
    q = np.concatenate([R.uniform(-30, 30, (60, 2)), R.normal(0, 1e-3, (60, 2)), np.zeros((40, 2)), [[1.5, 1.5], [1e6, -1e6]]])
    got = nearest_boxes(points_of(spark, q, "qid", "q"), boxes_of(spark, b, "id", "b").filter("id < 9000"), k, tile=40, lot=30).collect()
    d = gaps(b, q)
    want = [(i, int(j), d[i, j], r + 1) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(b)), d[i]))[:k])]
    if k > len(b):  # equal boxes beyond the k smallest ids aside, all of them
        assert len(got) == len(q) * len(b)
    assert [(r[0], r[1], r[3]) for r in sorted(got, key=lambda r: (r[0], r[3]))] == [(a, b, r) for a, b, _, r in want]
    assert np.allclose([r[2] for r in sorted(got, key=lambda r: (r[0], r[3]))], [w[2] for w in want])


def test_candidates_do_not_grow(spark, monkeypatch):
    """A query meets as many points at ten times the rows."""
    from planewright.operators import neighbours as B

    met = {}
    for n in (2000, 20000):
        p = R.random((n, 2))
        seen = spark.sparkContext.accumulator(0)

        def counted(boxes, ids, q, k, bound, seen=seen):
            seen.add(len(boxes) * len(q))
            return k_nearest(boxes, ids, q, k, bound)

        monkeypatch.setattr(B, "k_nearest", counted)
        q = points_of(spark, R.random((400, 2)), "qid", "q")
        assert nearest(q, points_of(spark, p, "id", "p"), 5, tile=100).count() == 2000
        met[n] = seen.value / 400
    assert met[20000] < 2 * met[2000] + 200


def test_nearest_kernel():
    b = np.repeat(np.concatenate([R.random((700, 2)), np.round(R.random((300, 2)), 1)]), 2, axis=0).reshape(-1, 4)
    ids, q = R.permutation(1000), R.random((200, 2)) * 2
    n, i, d = k_nearest(b, ids, q, 7, np.full(200, np.inf))
    want = gaps(b, q)
    for row in range(200):
        assert i[n == row].tolist() == ids[np.lexsort((ids, want[row]))[:7]].tolist()
    assert np.allclose(d.reshape(200, 7), np.sort(want, 1)[:, :7])


def clusters(p, eps):
    d = np.sqrt(((p[:, None] - p) ** 2).sum(2)) <= eps
    root = np.arange(len(p))
    while True:
        new = np.array([root[r].min() for r in d])
        if (new == root).all():
            return root
        root = new


@pytest.mark.parametrize("name,p,eps", [
    ("uniform", R.random((400, 2)), 0.03),
    ("chain", np.stack([np.arange(60) * 0.1, np.zeros(60)], 1), 0.1),
    ("just apart", np.concatenate([R.random((40, 2)) * [0.01, 1], R.random((40, 2)) * [0.01, 1] + [0.0350001, 0]]), 0.025),
    ("lattice", np.array([(x, y) for x in range(15) for y in range(15)], float), 1.0),
    ("one place", np.repeat([[0.1, 0.2]], 50, axis=0), 0.5),
    ("no reach", np.round(R.random((100, 2)), 1), 0.0),
])
def test_welding(spark, name, p, eps):
    got = {r[0]: r[1] for r in S.welded(points_of(spark, p, "id", "p"), eps).collect()}
    assert got == {**dict(enumerate(clusters(p, eps).tolist())), 9002: 9002}


def test_welding_a_crowd(spark):
    """A hundred thousand points in one spot are never paired."""
    began = time.time()
    p = spark.range(100000).select("id", G.point(F.rand(1) * 1e-3, F.rand(2) * 1e-3).alias("p"))
    assert S.welded(p, 0.01).agg(F.count("*"), F.countDistinct("cluster")).first() == (100000, 1)
    assert S.welded(p, 0.0005).agg(F.count("*"), F.countDistinct("cluster")).first() == (100000, 1)
    assert time.time() - began < 120


def test_rows_of_a_distance_transform():
    for n in (1, 2, 5, 40, 300):
        for share in (0, 0.1, 0.5, 1):
            xs = np.sort(R.choice(3 * n, n, replace=False))
            vs = np.where(R.random(n) < share, R.integers(0, n + 2, n), -1)
            x = np.abs(xs[:, None] - xs[vs >= 0])
            v = vs[vs >= 0]
            for kernel, force in ((raster.euclidean_row, np.sqrt(x * x + v * v)), (raster.chamfer_row, (3 * np.maximum(x, v) + np.minimum(x, v)) / 3)):
                got = kernel(xs, vs)
                assert np.allclose(got, force.min(1)) if len(v) else np.isnan(got).all()


def test_a_long_row_is_linear(spark):
    took = {}
    for n in (100_000, 400_000):
        vs = R.integers(0, 1000, n)
        began = time.time()
        raster.euclidean_row(np.arange(n), vs)
        raster.chamfer_row(np.arange(n), vs)
        took[n] = time.time() - began
    assert took[400_000] < 12 * took[100_000]
    cells = spark.range(100_000).select(F.lit(1).alias("grid_id"), F.col("id").alias("gx"), F.lit(0).cast("long").alias("gy"), (F.col("id") % 1000 == 0).alias("feature"))
    far = raster.distance_transform(cells).agg(F.count("*"), F.max("distance")).first()
    assert far == (100_000, 999.0 if far[1] == 999.0 else 500.0)
