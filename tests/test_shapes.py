"""Outlines, skeletons, sight, spline pieces and cleaning, each against its definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planewright.functions import curve_kernels as C
from planewright.functions import geometry as G
from planewright.functions import kernels as K
from planewright.functions import overlay as O
from planewright.functions import polygon_kernels as N
from planewright.functions import sight as V
from planewright.functions import skeletons as S
from planewright.functions import spline_pieces as B

R = np.random.default_rng(21)
SQUARE = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
ELL = np.array([(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)], float)
CUP = np.array([(0, 0), (5, 0), (5, 4), (4, 4), (4, 1), (1, 1), (1, 4), (0, 4)], float)
CROSS = np.array([(1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (2, 2), (2, 3), (1, 3), (1, 2), (0, 2), (0, 1), (1, 1)], float)


def star(n, low=0.3, seed=0):
    r = np.random.default_rng(seed)
    while True:
        t = np.sort(r.random(n)) * 2 * np.pi
        if np.diff(np.append(t, t[0] + 2 * np.pi)).max() < 2.9:
            s = r.uniform(low, 1, n)
            return np.stack([s * np.cos(t), s * np.sin(t)], 1)


def winding(rings, q):
    out = np.zeros(len(q))
    for a in rings:
        b = np.roll(a, -1, 0)
        x, y = q[:, :1], q[:, 1:]
        side = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        out += ((a[:, 1] <= y) & (b[:, 1] > y) & (side > 0)).sum(1) - ((a[:, 1] > y) & (b[:, 1] <= y) & (side < 0)).sum(1)
    return out


def tangles():
    for k in range(40):
        r = np.random.default_rng(k)
        box = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
        yield [[r.random((r.integers(3, 9), 2)) * 5 for _ in range(r.integers(1, 4))], [r.integers(0, 5, (r.integers(3, 8), 2)).astype(float) for _ in range(2)], [box(*v) for v in r.integers(1, 4, (5, 4))], [box(*v)[:: r.choice([-1, 1])] for v in r.integers(1, 4, (5, 4))]][k % 4]


@pytest.mark.parametrize("rings", list(tangles()), ids=lambda r: f"{len(r)} rings")
def test_outlines(rings):
    q = R.uniform(-0.5, 7, (1500, 2)) + 1e-7
    for rule in (lambda w: w > 0, lambda w: w != 0, lambda w: w % 2 == 1):
        got = winding(O.outline(rings, rule), q)
        assert np.isin(got, (0, 1)).all() and ((got == 1) == rule(winding(rings, q))).all()


def test_offsets():
    assert O.area(O.offset(SQUARE, -0.7)) == 0 and O.area(O.offset(SQUARE, -0.3)) == pytest.approx(0.16) and O.area(O.offset(SQUARE, 0.5)) == pytest.approx(4)
    assert O.area(O.offset(CUP, -0.4)) == pytest.approx(4.2 * 0.2 + 2 * 3.0 * 0.2) and O.offset(CUP, -0.6) == [] and O.area(O.offset(CUP, 1.6)) == pytest.approx(8.2 * 7.2)
    dumbbell = np.array([(0, 0), (3, 0), (3, 1.4), (5, 1.4), (5, 0), (8, 0), (8, 3), (5, 3), (5, 1.6), (3, 1.6), (3, 3), (0, 3)], float)
    assert len(O.offset(dumbbell, -0.2)) == 2  # parted
    frame = O.offset(np.concatenate([CUP[:4], CUP[4:]]), 0.5)
    assert len(frame) == 1 and O.offset(SQUARE[:2], 1) == [] and O.area(O.offset(SQUARE[::-1], 0)) == pytest.approx(1)
    for d in (0.05, 0.3):  # points within the distance of a ring, for a round join
        p, q = star(14, seed=3), R.uniform(-2, 2, (1500, 2))
        near = np.min([K.segment_distances(q, a, b) for a, b in zip(p, np.roll(p, -1, 0), strict=True)], axis=0)
        inside = N.contains(p, q)
        sure = np.abs(near - d) > 1e-3
        assert ((winding(O.offset(p, d, "round", tolerance=1e-4), q) == 1) == (inside | (near <= d)))[sure].all()
        assert ((winding(O.offset(p, -d, "round", tolerance=1e-4), q) == 1) == (inside & (near > d)))[sure].all()


def test_repair_unions_and_sums():
    t = np.arange(5) * 4 * np.pi / 5
    pentagram = np.stack([np.cos(t), np.sin(t)], 1)
    parts = O.repaired(pentagram)
    assert len(parts) == 1 and O.area(parts) == pytest.approx(1.12257, abs=1e-4)
    assert O.area(O.union([SQUARE, SQUARE + 0.5, SQUARE[::-1] + [0.5, 0]])) == pytest.approx(1.5 + 0.5)
    assert O.area(O.minkowski(ELL, ELL)) == pytest.approx(13) and O.area(O.minkowski(ELL, SQUARE)) == pytest.approx(8) and O.minkowski(ELL, SQUARE[:2]) == []
    assert len(O.minkowski(np.array([(0, 0), (5, 0), (5, 5), (2, 5), (2, 4), (4, 4), (4, 1), (1, 1), (1, 5), (0, 5)], float), SQUARE * 1.0)) == 2  # closes round a hole
    p, q = star(9, seed=1), star(7, seed=2) * 0.5
    s = O.minkowski(p, q)
    x = np.concatenate([a[None] + b[:, None] for a in (p,) for b in (q,)]).reshape(-1, 2)
    assert (winding(s, x * (1 - 1e-9)) >= 0).all()
    some = R.uniform(-1.6, 1.6, (400, 2))
    # a point is in the sum if the mirrored second ring, moved there, meets the first
    meets = [bool(N.boolean(p, N.ccw(z - q), "intersection")) for z in some]
    assert np.mean((winding(s, some) == 1) == np.array(meets)) > 0.995


RINGS = [SQUARE, np.array([(0, 0), (3, 0), (3, 1), (0, 1)], float), ELL, ELL[::-1], CUP, CROSS, np.array([(0, 0), (2, 0), (1, 2)], float), np.array([(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1)], float), *(star(n, seed=n) for n in range(3, 40, 3))]


@pytest.mark.parametrize("p", RINGS, ids=len)
def test_straight_skeleton(p):
    s, q = S.straight_skeleton(p), N.ccw(p)
    d = np.roll(q, -1, 0) - q
    along = d / np.hypot(*d.T)[:, None]
    normal = np.stack([-along[:, 1], along[:, 0]], 1)
    assert np.allclose(s.nodes[: len(q), :2], q) and len(s.arcs) == len(s.nodes) - 1 and len(np.unique(s.arcs)) == len(s.nodes)
    away = lambda e, v: normal[e] @ (s.nodes[v, :2] - q[e])
    for arc, edges in zip(s.arcs, s.edges, strict=True):
        for v in arc:  # as far from the lines of both edges as it is high
            assert away(edges[0], v) == pytest.approx(s.nodes[v, 2], abs=1e-7) and away(edges[1], v) == pytest.approx(s.nodes[v, 2], abs=1e-7)
    faces = S.face_areas(q, s)
    assert faces.min() > 0 and faces.sum() == pytest.approx(K.signed_area(q))
    assert N.contains(q, s.nodes[len(q) :, :2]).all()


def test_skeleton_of_the_shrunk_ring():
    """The skeleton of a ring moved in is what is left of the ring's own above that height."""
    for seed in range(12):
        p = star(12, low=0.75, seed=seed)
        s = S.straight_skeleton(p)
        t = 0.1 * s.nodes[:, 2].max()
        inner = O.offset(p, -t, miter=1e9)
        assert max(S.straight_skeleton(r).nodes[:, 2].max() for r in inner) == pytest.approx(s.nodes[:, 2].max() - t, abs=1e-6)


def test_skeleton_parts():
    box = S.straight_skeleton(np.array([(0, 0), (3, 0), (3, 1), (0, 1)], float))
    assert box.length() == pytest.approx(2 + 2 * 2**0.5) and len(box.segments()) == 5 and box.pruned(0.8).length() == 2 and len(box.pruned(9).nodes) == 0
    for few in (SQUARE[:0], SQUARE[:2], np.zeros((4, 2)), np.array([(0, 0), (1, 1), (2, 2)], float)):
        assert len(S.straight_skeleton(few).nodes) == 0
    assert len(S.straight_skeleton(np.concatenate([SQUARE, SQUARE[:1]])).nodes) == 5


@pytest.mark.parametrize("p", [SQUARE, ELL, CUP, star(9, seed=5), star(20, seed=6)], ids=len)
def test_medial_axis(p):
    step = 0.02
    s = S.medial_axis(p, step)
    edges = list(zip(p, np.roll(p, -1, 0), strict=True))
    d = np.min([K.segment_distances(s.nodes[:, :2], a, b) for a, b in edges], axis=0)
    assert N.contains(p, s.nodes[:, :2]).all() and (s.nodes[:, 2] >= d - 1e-9).all() and (s.nodes[:, 2] - d).max() <= step
    q = S.sampled(p, step)
    near = np.hypot(*(q[None] - s.nodes[:, None, :2]).transpose(2, 0, 1))
    assert ((near - s.nodes[:, 2:]) > -1e-7).all() and ((np.abs(near - s.nodes[:, 2:]) < 1e-7).sum(1) >= 2).all()
    assert len(s.pruned(0.05).arcs) < len(s.arcs) or len(p) > 8
    assert len(S.medial_axis(p[:2], step).nodes) == 0


@pytest.mark.parametrize("seed", range(25))
def test_sight(seed):
    r = np.random.default_rng(seed)
    ring = star(r.integers(5, 30), seed=seed) * 5
    obstacles = [r.uniform(-3, 3, 2) + star(r.integers(3, 7), 0.9, seed=seed + 100 + k) * r.uniform(0.2, 1.2) for k in range(r.integers(0, 4))]
    eye = r.uniform(-1.5, 1.5, 2)
    if not N.contains(ring, eye[None])[0] or any(N.contains(o, eye[None])[0] for o in obstacles):
        eye = np.zeros(2)
    q, seen = r.uniform(-5, 5, (1500, 2)), np.ones(1500, bool)
    for p in [ring, *obstacles]:
        for a, b in zip(p, np.roll(p, -1, 0), strict=True):
            d, f, w = q - eye, b - a, a - eye
            k = d[:, 0] * f[1] - d[:, 1] * f[0]
            t, u = (w[0] * f[1] - w[1] * f[0]) / k, (w[0] * d[:, 1] - w[1] * d[:, 0]) / k
            seen &= ~((t > 0) & (t < 1) & (u >= 0) & (u <= 1))
    assert (N.contains(V.visible([ring, *obstacles], tuple(eye)), q) == seen).all()


def test_sight_in_closed_form():
    assert V.visible_area([SQUARE * 2 - 1], (0, 0)) == pytest.approx(4)
    assert V.visible_area([SQUARE * 8 - 4, np.array([(1, -1), (2, -1), (2, 1), (1, 1)], float)], (0, 0)) == pytest.approx(64 - 15)
    assert len(V.visible([], (0, 0))) == 0 and V.visible_area([ELL], (0.5, 0.5)) == pytest.approx(3)


@pytest.mark.parametrize("degree", [1, 2, 3, 4])
def test_spline_pieces(degree):
    p, w = R.random((9, 2)), R.uniform(0.5, 2, 9)
    for knots in (C.open_knots(9, degree), C.uniform_knots(9, degree), np.sort(np.concatenate([R.integers(0, 5, 8 - degree), np.full(degree + 1, -1.0), np.full(degree + 1, 6.0)]))):
        for weights in (None, w):
            chain, breaks = B.pieces(p, degree, knots, weights)
            lo, hi = C.domain(knots, degree)
            t = np.linspace(lo, hi, 101)[:-1] + 1e-9
            assert np.allclose(C.spline_points(p, t, degree, knots, weights), [B.try_at(chain, breaks, x) for x in t])
            assert B.try_at(chain, breaks, lo - 0.1) is None and B.tangent_at(chain, breaks, hi + 0.1) is None
            fine = [B.at(c, np.linspace(0, 1, 4001)) for c in chain]
            assert B.arc_length(chain) == pytest.approx(sum(np.hypot(*np.diff(f, axis=0).T).sum() for f in fine), rel=1e-5)
            every, tight, loose = np.concatenate(fine), np.array(B.tight_bounds(chain)), np.array(B.bounds(chain))
            assert np.allclose(tight, [*every.min(0), *every.max(0)], atol=1e-6) and (loose[:2] <= tight[:2] + 1e-12).all() and (loose[2:] >= tight[2:] - 1e-12).all()
            x = (breaks[0] + breaks[1]) / 2
            slope = (B.try_at(chain, breaks, x + 1e-6) - B.try_at(chain, breaks, x - 1e-6)) / 2e-6
            assert np.allclose(B.tangent_at(chain, breaks, x), slope, atol=1e-5)
    assert B.is_polynomial(np.full(4, 2.0)) and not B.is_polynomial(w) and np.allclose(B.scaled_weights(w, 2), 2 * w)


def test_interpolating_splines():
    p = R.random((9, 2))
    for alpha in (0.0, 0.5, 1.0):
        chain = B.catmull_rom(p, alpha)
        assert np.allclose(np.concatenate([*(B.at(c, np.arange(10) / 10) for c in chain), p[-1:]]), C.catmull_rom_line(p, 10, alpha))
    chain = B.from_tangents(p, C.cardinal_tangents(p, 0.3))
    assert np.allclose(np.concatenate([*(B.at(c, np.arange(10) / 10) for c in chain), p[-1:]]), C.cardinal_line(p, 10, 0.3))
    assert len(B.catmull_rom(p[:1])) == 0


def test_small_forms():
    assert B.spans(5) == (4, (0.0, 4.0)) and B.spans(0) == (0, (0.0, 0.0)) and B.is_polynomial(B.unweighted(4))
    p, w, k = R.random((6, 2)), B.unweighted(6), C.open_knots(6, 3)
    assert np.allclose(C.spline_points(p, [0.7], 3, k, w), C.spline_points(p, [0.7], 3, k))
    m = C.cardinal_tangents(p)
    assert np.allclose(C.hermite_line(p, B.scaled_tangents(m, 0), 5), C.still_line(p, 5))


def test_cleaning():
    for _ in range(30):
        p = np.cumsum(R.normal(0, 0.2, (R.integers(0, 20), 2)), 0)
        first = K.drop_repeats(p, 0.2)
        assert K.cleaned(p, 0.2, 0.1) == [first[k] for k in K.drop_collinear(p[first], 0.1)]
        ring = K.drop_repeats_in_ring(p, 0.2)
        if 3 < len(ring) < len(p):
            assert np.hypot(*(p[ring] - np.roll(p[ring], 1, 0)).T).min() > 0.2


def test_hulls_of_equal_and_few_points(spark):
    from planewright.operators.hulls import hulls

    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0), (0.5, 0.5), (0.5, 0)])] + [(2, 9, 3.0, 3.0), (None, 1, 0.0, 0.0), (3, 1, None, 0.0)]
    points = spark.createDataFrame(rows, "g int, id long, x double, y double").select("g", "id", G.point(F.col("x"), F.col("y")).alias("p")).repartition(5)
    got = {r["g"]: r["ids"] for r in hulls(points, "g", pid="id").collect()}
    assert set(got) == {1, 2} and sorted(got[1]) == [0, 1, 2, 3] and got[2] == [9]


def test_sobol_points(spark):
    row = spark.range(4).selectExpr("id AS i").select("i", G.sobol_point("i", 4).alias("s"), G.sobol_scrambled("i", 0).alias("t")).orderBy("i").collect()
    assert [(r["s"][0], r["s"][1]) for r in row] == [(0, 0), (0.5, 0.5), (0.25, 0.75), (0.75, 0.25)] and all((r["t"]["x"], r["t"]["y"]) == (r["s"][0], r["s"][1]) for r in row)
    for d in range(1, 5):  # each dimension is a permutation of the cells of any power of two
        n = spark.range(64).selectExpr("id AS i").select(F.floor(G.sobol("i", d) * 64).alias("c")).distinct().count()
        assert n == 64
