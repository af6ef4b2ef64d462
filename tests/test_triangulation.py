"""Delaunay triangulation: exact kernel against the definition, tiles against the kernel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewright.functions import delaunay_kernel as D
from planewright.functions import geometry as G
from planewright.functions import kernels as K
from planewright.operators.tiles import Tree, cuts
from planewright.operators.triangulation import delaunay_triangles, voronoi_cells

R = np.random.default_rng(11)


def by_definition(p):
    pts, n, out = [tuple(map(float, x)) for x in p], len(p), []
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                if t := D.turn(pts[i], pts[j], pts[k]):
                    a, b, c = (i, j, k) if t > 0 else (i, k, j)
                    if not any(D.in_circle(pts[a], pts[b], pts[c], pts[m]) for m in range(n) if m not in (i, j, k)):
                        out.append((a, b, c))
    return sorted(out)


def sets():
    yield from (R.random((R.integers(3, 15), 2)) for _ in range(15))
    for _ in range(15):  # grids: many on one circle or line
        p = np.unique(R.integers(0, 4, (R.integers(3, 15), 2)), axis=0).astype(float)
        yield p[R.permutation(len(p))]
    for k in range(2, 16):  # six points just inside the lowest hull edge
        p = R.random((16, 2))
        p[:2] = [[0, 0], [1, 0]]
        p[2:8, 1] = R.random(6) * 10.0**-k
        yield p
    yield np.array([(np.cos(t), np.sin(t)) for t in np.arange(10)])


@pytest.mark.parametrize("p", list(sets()), ids=str)
def test_kernel(p):
    got = D.delaunay(p)
    assert got == by_definition(p)
    hull = p[K.convex_hull(p)]
    if len(hull) > 2:
        area = sum(K.signed_area(p[list(t)]) for t in got)
        assert area == pytest.approx(abs(K.signed_area(hull)), rel=1e-9)


def test_subsets_agree_on_circles():
    """Triangles of the whole whose corners a subset holds are in the subset's triangulation, ties too."""
    p = np.array([(x, y) for x in range(6) for y in range(6)], float)
    whole = {tuple(map(tuple, p[list(t)])) for t in D.delaunay(p)}
    for _ in range(20):
        part = p[R.random(len(p)) < 0.7]
        turned = lambda t: {t, t[1:] + t[:1], t[2:] + t[:2]}
        found = set().union(*(turned(tuple(map(tuple, part[list(t)]))) for t in D.delaunay(part)))
        inside = set(map(tuple, part))
        assert {t for t in whole if set(t) <= inside} <= found


def test_no_triangles():
    assert D.delaunay(np.zeros((0, 2))) == D.delaunay(np.zeros((5, 2))) == D.delaunay(np.array([(0.1 * k, 0.3 * k) for k in (1, 2, 4, 8)])) == []
    assert D.delaunay(np.array([(0, 0), (1, 0), (0, 0), (0, 1), (1, 0)], float)) == [(0, 1, 3)]


def clouds():
    yield "uniform", R.random((900, 2))
    yield "grid", np.array([(x, y) for x in range(30) for y in range(30)], float)
    yield "clusters", np.concatenate([R.normal(c, s, (200, 2)) for c, s in (((0, 0), 1e-4), ((5, 5), 1), ((5, -90), 3), ((1e4, 0), 1e-2))])
    yield "circle", np.stack([np.cos(t := np.linspace(0, 2 * np.pi, 500, endpoint=False)), np.sin(t)], 1)
    yield "flat", np.stack([R.random(700), R.random(700) * 1e-9], 1)
    yield "parabola", np.stack([(x := np.linspace(-3, 3, 400)), x * x], 1)


@pytest.mark.parametrize("name,p", list(clouds()), ids=lambda x: x if isinstance(x, str) else "")
def test_tiles(spark, name, p):
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(p)]
    rows += [(2, i, float(x), float(y)) for i, (x, y) in enumerate(p[:40])] + [(1, 5000, *map(float, p[0])), (None, 1, 0.0, 0.0), (3, 1, None, 1.0), (3, 2, 1.0, 1.0), (3, 3, 2.0, 2.0), (3, 4, 3.0, 3.0)]
    points = spark.createDataFrame(rows, "g int, id long, x double, y double").select("g", "id", G.point(F.col("x"), F.col("y")).alias("p"))
    got = delaunay_triangles(points, "g", tile=60)
    assert sorted(tuple(r) for r in got.select("g", "a", "b", "c").collect()) == sorted([(1, *t) for t in D.delaunay(p)] + [(2, *t) for t in D.delaunay(p[:40])])


def test_voronoi_over_tiles(spark):
    p = R.random((400, 2))
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(2, i, float(i), 0.0) for i in range(3)] + [(3, 7, 0.5, 0.5)]
    points = spark.createDataFrame(rows, "g int, id long, x double, y double").select("g", "id", G.point(F.col("x"), F.col("y")).alias("p"))
    got = voronoi_cells(points, "g", (0.0, 0.0), (1.0, 1.0), tile=60).select("g", "id", G.ring_area("ring").alias("area"), G.ring_centroid("ring").alias("c")).collect()
    one = {r["id"]: r for r in got if r["g"] == 1}
    assert len(one) == 400 and sum(r["area"] for r in one.values()) == pytest.approx(1)
    for i, r in one.items():
        assert ((p - [r["c"]["x"], r["c"]["y"]]) ** 2).sum(1).argmin() == i
    assert {r["id"]: round(r["area"], 9) for r in got if r["g"] == 2 and r["area"]} == {0: 0.5, 1: 0.5}
    assert [r["area"] for r in got if r["g"] == 3] == [1.0]


def test_tiles_hold_like_numbers(spark):
    p = np.concatenate([R.normal(0, 1e-3, (5000, 2)), R.random((1000, 2)) * 100])
    points = spark.createDataFrame([(0, *map(float, q)) for q in p], "g int, x double, y double")
    tree, _ = cuts(points, "g", 300)[0]
    sizes = np.bincount(tree.leaf_of(*p.T), minlength=len(tree.rects))
    assert len(sizes) == 20 and sizes.max() < 700 and sizes.min() > 100
    assert cuts(points, "g", 10000) == {}
    assert len(Tree(np.zeros((50, 2)), 8).rects) == 1
