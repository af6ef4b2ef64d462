"""Spline, curve and polygon kernels against their definitions and against dense samples."""

import math

import numpy as np
import pytest

from planewright.functions import curve_kernels as C
from planewright.functions import kernels as K
from planewright.functions import overlay as O
from planewright.functions import polygon_kernels as P

R = np.random.default_rng(4)
SQUARE = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
ELL = np.array([[0, 0], [2, 0], [2, 1], [1, 1], [1, 2], [0, 2]], float)


def star(n=10, at=(0.0, 0.0), r=1.0):
    k = np.arange(n)
    return np.array(at) + r * np.where(k % 2, 0.4, 1.0)[:, None] * np.stack([np.cos(2 * np.pi * k / n), np.sin(2 * np.pi * k / n)], 1)


def basis(i, d, t, u):
    if d == 0:
        return float(u[i] <= t < u[i + 1])
    left = (t - u[i]) / (u[i + d] - u[i]) * basis(i, d - 1, t, u) if u[i + d] > u[i] else 0
    right = (u[i + d + 1] - t) / (u[i + d + 1] - u[i + 1]) * basis(i + 1, d - 1, t, u) if u[i + d + 1] > u[i + 1] else 0
    return left + right


@pytest.mark.parametrize("degree", [1, 2, 3, 4])
def test_splines_equal_their_basis(degree):
    p, w = R.random((7, 2)), R.random(7) + 0.5
    for knots in (C.uniform_knots(7, degree), C.open_knots(7, degree)):
        lo, hi = C.domain(knots, degree)
        for t in np.linspace(lo, hi - 1e-9, 17):
            b = np.array([basis(i, degree, t, knots) for i in range(7)])
            assert np.allclose(C.spline_points(p, [t], degree, knots)[0], b @ p)
            assert np.allclose(C.spline_points(p, [t], degree, knots, w)[0], (b * w) @ p / (b @ w))
        at = np.linspace(lo, hi, 23)
        for u in (lo, lo + 0.37 * (hi - lo), lo + 0.5 * (hi - lo)):
            for weights in (None, w):
                q, more, v = C.insert_knot(p, degree, knots, u, weights)
                assert len(q) == 8 and np.allclose(C.spline_points(q, at, degree, more, v), C.spline_points(p, at, degree, knots, weights))
        if degree > 1:
            d = C.spline_derivative(p, degree, knots)
            step = 1e-6
            inner = at[1:-1] + 1e-4
            slope = (C.spline_points(p, inner + step, degree, knots) - C.spline_points(p, inner - step, degree, knots)) / (2 * step)
            assert np.allclose(C.spline_points(d[0], inner, d[1], d[2]), slope, atol=1e-4)


def test_rational_arcs_are_round():
    for a, b in ((0, math.pi / 2), (0.3, 2.9), (0, 2 * math.pi), (1, -2)):
        line = C.rational_arc_line(a, b, 50, radius=3.0)
        assert np.allclose(np.hypot(*line.T), 3) and np.allclose(line[0], [3 * math.cos(a), 3 * math.sin(a)]) and np.allclose(line[-1], [3 * math.cos(b), 3 * math.sin(b)])
    e = C.rational_arc_line(0, 2 * math.pi, 40, radius=2.0, stretch=0.5)
    assert np.allclose((e[:, 0] / 2) ** 2 + e[:, 1] ** 2, 1)


def test_curves_through_points():
    p = R.random((6, 2))
    for line in (C.catmull_rom_line(p, 8), C.cardinal_line(p, 8, 0.3), C.still_line(p, 8)):
        assert len(line) == 41 and np.allclose(line[::8], p)
    assert np.allclose(C.catmull_rom_line(p, 4, alpha=0.0)[4:17], C.cardinal_line(p, 4)[4:17])


def test_crossings_of_curves():
    arch, other = np.array([[0, 0], [1, 2], [3, 2], [4, 0]], float), np.array([[2, -1], [2, 0.5], [2, 1.5], [2, 3]], float)
    hit = C.bezier_crossings(arch, other)
    assert len(hit) == 1 and abs(hit[0, 2] - 2) < 1e-6
    for _ in range(20):
        p, q = R.random((4, 2)), R.random((R.integers(2, 5), 2))
        t = np.linspace(0, 1, 1501)
        a, b = C.bezier_points(p, t), C.bezier_points(q, t)
        turn = lambda x, y, z: (y - x)[..., 0] * (z - x)[..., 1] - (y - x)[..., 1] * (z - x)[..., 0]
        n = 0
        for lo in range(0, 1500, 100):
            s, e = a[lo : lo + 100, None], a[lo + 1 : lo + 101, None]
            c, d = b[None, :-1], b[None, 1:]
            n += int(((turn(s, e, c) * turn(s, e, d) < 0) & (turn(c, d, s) * turn(c, d, e) < 0)).sum())
        found = C.bezier_crossings(p, q)
        assert len(found) == n
        assert np.allclose(C.bezier_points(p, found[:, 0]), C.bezier_points(q, found[:, 1]), atol=1e-6)


def test_offsets_and_fits():
    p = np.array([[0, 0], [1, 2], [3, 2], [4, 0]], float)
    base = C.bezier_points(p, np.linspace(0, 1, 4001))
    for x in C.offset_line(p, 0.3, 1e-4):
        assert abs(np.hypot(*(base - x).T).min() - 0.3) < 2e-3
    assert np.allclose(C.bezier_points(C.fit_cubic_refined(C.bezier_points(p, np.linspace(0, 1, 30))), np.linspace(0, 1, 9)), C.bezier_points(p, np.linspace(0, 1, 9)), atol=0.02)
    assert abs(C.bezier_length(p) - C.length(base)) < 1e-4


def area_by_grid(p, q, kind, n=700):
    every = np.concatenate([p, q])
    lo, hi = every.min(0), every.max(0)
    x, y = (lo[k] + (hi[k] - lo[k]) * (np.arange(n) + 0.5) / n for k in (0, 1))
    g = np.stack(np.meshgrid(x, y), -1).reshape(-1, 2)
    a, b = P.contains(p, g), P.contains(q, g)
    hit = {"union": a | b, "intersection": a & b, "difference": a & ~b, "xor": a ^ b}[kind]
    return hit.mean() * np.prod(hi - lo)


@pytest.mark.parametrize("kind", ["union", "intersection", "difference", "xor"])
def test_booleans(kind):
    pairs = [(star(10), star(12, (0.3, 0.1), 0.9)), (ELL, SQUARE + 0.5), (SQUARE * 3, star(8, (1.5, 1.5))), (star(10, (5, 5)), SQUARE), (SQUARE, star(10, (0.5, 0.5), 3.0))]
    for p, q in pairs:
        assert P.boolean_area(p, q, kind) == pytest.approx(area_by_grid(p, q, kind), abs=0.02)
        assert P.boolean_area(p[::-1], q, kind) == pytest.approx(P.boolean_area(p, q, kind))
    assert P.boolean_area(SQUARE, SQUARE, kind) == pytest.approx({"union": 1, "intersection": 1}.get(kind, 0))
    beside = SQUARE + [1, 0]  # a shared edge
    assert P.boolean_area(SQUARE, beside, kind) == pytest.approx({"union": 2, "intersection": 0, "difference": 1, "xor": 2}[kind])
    if kind == "union":
        assert len(P.boolean(SQUARE, beside, kind)) == 1
    assert len(P.boolean(SQUARE * 4, SQUARE + 1, "difference")) == 2


def test_repair_and_faults():
    eight = np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float)
    assert P.self_intersections(eight).tolist() == [[1, 1]]
    parts = O.repaired(eight)
    assert len(parts) == 2 and all(K.signed_area(r) == pytest.approx(1) and not len(P.self_intersections(r)) for r in parts)
    assert P.faults(eight)["crossing"] and not any(P.faults(ELL).values()) and P.faults(ELL[:2])["too_few"]
    assert P.reflex_vertices(ELL) == [3] and len(P.reflex_vertices(star())) == 5


def test_collisions_and_sight():
    for shift in (0.3, 0.99, 1.01, 5.0):
        assert P.collide(SQUARE, SQUARE + [shift, 0.2]) == (shift < 1)
    eye = lambda *v: np.array(v, float)
    assert P.sees(ELL, eye(0.5, 0.5), eye(1.9, 0.5)) and not P.sees(ELL, eye(1.9, 0.5), eye(0.5, 1.9))
    assert not P.sees(SQUARE * 10, eye(1, 5), eye(9, 5), [SQUARE + 4.5]) and P.sees(SQUARE * 10, eye(1, 1), eye(9, 1), [SQUARE + 4.5])


def test_strokes():
    line = np.array([[0, 0], [4, 0]], float)
    assert abs(K.signed_area(P.stroked(line, 2))) == pytest.approx(8)
    assert abs(K.signed_area(P.stroked(line, 2, cap="square"))) == pytest.approx(12)
    assert abs(K.signed_area(P.stroked(line, 2, cap="round", tolerance=1e-4))) == pytest.approx(8 + math.pi, abs=0.01)
    corner = np.array([[0, 0], [4, 0], [4, 4]], float)
    inner = abs(K.signed_area(P.stroked(corner, 1, join="miter"))) - abs(K.signed_area(P.stroked(corner, 1, join="bevel")))
    assert inner == pytest.approx(0.125)
    assert sum(K.signed_area(r) for r in O.stroked_ring(SQUARE * 4, 1)) == pytest.approx(25 - 9)


def test_voronoi_cells():
    p = R.random((30, 2))
    cells = P.voronoi_cells(p, (0, 0), (1, 1))
    assert sum(abs(K.signed_area(c)) for c in cells) == pytest.approx(1)
    for q in R.random((300, 2)):
        assert P.contains(cells[int(np.hypot(*(p - q).T).argmin())], q[None])[0]


def test_frechet_forms():
    for _ in range(50):
        p, q = R.random((R.integers(1, 8), 2)), R.random((R.integers(1, 8), 2))
        d = K.frechet(p, q)
        assert K.frechet_within(p, q, d + 1e-9) and not K.frechet_within(p, q, d - 1e-9)
        assert K.frechet_resampled(p, q, 1) == pytest.approx(d)


def test_svg_paths_are_drawn():
    from planewright.sources.svg import drawn

    one = drawn([("M", [0, 0]), ("C", [1, 2, 3, 2, 4, 0]), ("s", [3, 2, 4, 0]), ("Z", [])], 1e-4)
    assert len(one) == 1 and np.allclose(one[0][[0, -1]], 0) and any(np.allclose(x, [8, 0]) for x in one[0])
    mirrored = C.bezier_points(np.array([[4, 0], [5, -2], [7, 2], [8, 0]], float), [0.5])[0]
    assert np.hypot(*(one[0] - mirrored).T).min() < 0.01
    for large in (0, 1):
        for sweep in (0, 1):
            arc = drawn([("M", [0, 0]), ("A", [5, 3, 30, large, sweep, 4, 2])], 1e-4)[0]
            t = np.radians(30)
            local = arc @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
            # all points on one ellipse of these radii: the distance to a centre in its frame is one
            a = np.stack([local[:, 0] / 25, local[:, 1] / 9, np.ones(len(arc))], 1)
            fit, *_ = np.linalg.lstsq(2 * a, (local[:, 0] / 5) ** 2 + (local[:, 1] / 3) ** 2, rcond=None)
            assert np.allclose(2 * a @ fit, (local[:, 0] / 5) ** 2 + (local[:, 1] / 3) ** 2)
    assert drawn([("L", [1, 1])], 0.1)[0].tolist() == [[0, 0], [1, 1]] and drawn([("M", [1, 1])], 0.1) == []
