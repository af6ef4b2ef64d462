"""Delaunay triangulation of one set of points, with exact sign tests.

The outside of the hull is covered by triangles with a ghost corner, one on each hull edge, so no
far point stands in for it. Signs are computed in floating point where its error bound decides them
and in whole numbers where it doesn't. Points on one circle are told apart as if each were lifted a
little above the paraboloid, the more the later it is in the order of x and y: so a set has one
triangulation, and that of a subset agrees with it wherever circles are empty.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

#: Error bounds of the two determinants in double precision, relative to the sums of their terms' sizes.
_TURN, _CIRCLE = (3 + 16 * 2**-53) * 2**-53, (10 + 96 * 2**-53) * 2**-53
GHOST = -1


def turn(a: tuple, b: tuple, c: tuple) -> int:
    """1 if a, b, c turn left, -1 if right, 0 on a line; exact."""
    l, r = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    d = l - r
    if abs(d) > _TURN * (abs(l) + abs(r)):
        return 1 if d > 0 else -1
    (ax, ay), (bx, by), (cx, cy) = (map(Fraction, p) for p in (a, b, c))
    d = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (d > 0) - (d < 0)


def in_circle(a: tuple, b: tuple, c: tuple, d: tuple) -> bool:
    """Whether d lies inside the circle round a, b, c, which turn left; exact, ties by the lifted order."""
    ax, ay, bx, by, cx, cy = a[0] - d[0], a[1] - d[1], b[0] - d[0], b[1] - d[1], c[0] - d[0], c[1] - d[1]
    bc, cb, ca, ac, ab, ba = bx * cy, by * cx, cx * ay, cy * ax, ax * by, ay * bx
    la, lb, lc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    det = la * (bc - cb) + lb * (ca - ac) + lc * (ab - ba)
    if abs(det) > _CIRCLE * (la * (abs(bc) + abs(cb)) + lb * (abs(ca) + abs(ac)) + lc * (abs(ab) + abs(ba))):
        return det > 0
    (px, py), (qx, qy), (rx, ry), (sx, sy) = (map(Fraction, p) for p in (a, b, c, d))
    px, py, qx, qy, rx, ry = px - sx, py - sy, qx - sx, qy - sy, rx - sx, ry - sy
    det = (px * px + py * py) * (qx * ry - qy * rx) + (qx * qx + qy * qy) * (rx * py - ry * px) + (rx * rx + ry * ry) * (px * qy - py * qx)
    if det:
        return det > 0
    top = max(a, b, c, d)  # the point lifted most decides: how the lifted height of each enters the determinant
    return {a: turn(d, b, c), b: turn(d, c, a), c: turn(d, a, b), d: -turn(a, b, c)}[top] > 0


def _order(p: np.ndarray) -> np.ndarray:
    """Indexes along a Hilbert curve of 2**10 cells a side, so that a point's triangle is near the last one's."""
    low, size = p.min(0), np.ptp(p, axis=0).max()
    if not size > 0:
        return np.arange(len(p))
    n = 10
    x, y = np.minimum((p - low) / size * (1 << n), (1 << n) - 1).astype(np.int64).T
    key = np.zeros(len(p), np.int64)
    for k in range(n - 1, -1, -1):
        rx, ry = (x >> k) & 1, (y >> k) & 1
        key = key * 4 + ((3 * rx) ^ ry)
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, (1 << n) - 1 - x, x), np.where(flip, (1 << n) - 1 - y, y)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
    return np.argsort(key, kind="stable")


def delaunay(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Counter-clockwise triangles, as index triples that begin with their least index, in ascending order.

    Of points in one place the first counts; there are no triangles if all lie on a line.
    """
    pts = [(float(x), float(y)) for x, y in p]
    first: dict[tuple, int] = {}
    for i, q in enumerate(pts):
        first.setdefault(q, i)
    ids = np.array(sorted(first.values()), np.int64)
    if len(ids) < 3:
        return []
    todo = ids[_order(np.asarray(p, float)[ids])].tolist()
    a, b = todo[0], todo[1]
    third = next((k for k in range(2, len(todo)) if turn(pts[a], pts[b], pts[todo[k]])), None)
    if third is None:
        return []
    c = todo.pop(third)
    if turn(pts[a], pts[b], pts[c]) < 0:
        a, b = b, a
    apex: dict[tuple[int, int], int] = {}  # directed edge -> third corner of the triangle to its left

    def put(i: int, j: int, k: int) -> None:
        apex[i, j], apex[j, k], apex[k, i] = k, i, j

    put(a, b, c)
    for i, j in ((b, a), (c, b), (a, c)):
        put(i, j, GHOST)
    last = (a, b)

    def holds(i: int, j: int, k: int, q: tuple) -> bool:
        """Whether q lies in the open disc of a triangle; a ghost's disc is the open half plane outside its edge, and the edge."""
        while GHOST in (i, j):
            i, j, k = j, k, i
        if k != GHOST:
            return in_circle(pts[i], pts[j], pts[k], q)
        s, t = pts[i], pts[j]
        side = turn(s, t, q)
        return side > 0 or (side == 0 and min(s, t) < q < max(s, t))

    for n in todo[2:]:
        q = pts[n]
        i, j = last
        if GHOST in (i, j) or apex[i, j] == GHOST:
            i, j = next((e for e in ((i, j), (j, apex[i, j]), (apex[i, j], i)) if GHOST not in e))
            if apex[i, j] == GHOST:
                i, j = j, i
        if turn(pts[i], pts[j], q) < 0:
            i, j = j, i
        # walk: the point is to the left of (i, j); leave through an edge that it is beyond
        while (k := apex[i, j]) != GHOST:
            if turn(pts[k], pts[j], q) > 0:
                i = k
            elif turn(pts[i], pts[k], q) > 0:
                j = k
            else:
                break
        # every triangle whose disc holds the point goes; they hang together
        hole, rim = [(i, j, k)], []
        seen = {(i, j), (j, k), (k, i)}
        while hole:
            i, j, k = hole.pop()
            for e in ((i, j), (j, k), (k, i)):
                back = (e[1], e[0])
                if back in seen:
                    continue
                far = apex[back]
                if holds(back[0], back[1], far, q):
                    seen |= {back, (back[1], far), (far, back[0])}
                    hole.append((back[0], back[1], far))
                else:
                    rim.append(e)
        for e in seen:
            apex.pop(e, None)
        for i, j in rim:
            if (j, i) not in seen:
                put(i, j, n)
                if GHOST not in (i, j):
                    last = (i, j)
    return sorted((i, j, k) for (i, j), k in apex.items() if i >= 0 and i < j and i < k)


def circle(a: tuple, b: tuple, c: tuple) -> tuple[float, float, float]:
    """Centre of the circle round a triangle, and a radius that surely reaches its corners; infinite if too flat to tell."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    error = 8 * 2**-53 * 2 * (abs(bx * cy) + abs(by * cx))
    if abs(d) <= 4 * error:
        return 0.0, 0.0, math.inf
    x, y = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    r = math.hypot(x, y)
    return a[0] + x, a[1] + y, r * (1 + 8 * error / abs(d) + 1e-12) + 1e-15 * max(abs(a[0]), abs(a[1]))
