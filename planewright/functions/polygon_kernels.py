"""Rings against rings, one pair at a time: general booleans, repair, strokes, visibility, Minkowski differences, Voronoi cells."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from planewright.functions import kernels as K

#: Points nearer than this share of the extent are one.
SNAP = 1e-9


def ccw(p: np.ndarray) -> np.ndarray:
    return p if K.signed_area(p) >= 0 else p[::-1]


def contains(ring: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Even-odd rule for many points."""
    a, b = ring[None], np.roll(ring, -1, 0)[None]
    x, y = q[:, None, 0], q[:, None, 1]
    above = (a[:, :, 1] > y) != (b[:, :, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = x < (b[:, :, 0] - a[:, :, 0]) * (y - a[:, :, 1]) / (b[:, :, 1] - a[:, :, 1]) + a[:, :, 0]
    return (above & left).sum(1) % 2 == 1


def _cuts(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges a-b (rows) against edges c-d: pairs and parameters on a-b of crossings, and of ends of c-d on a-b.

    Only pairs whose boxes are within a step of the grid are looked at closely.
    """
    low, high, least, most = np.minimum(a, b), np.maximum(a, b), np.minimum(c, d), np.maximum(c, d)
    if not len(a) or not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    far = SNAP * max(np.maximum(high.max(0), most.max(0)) - np.minimum(low.min(0), least.min(0))) + 1e-15
    low, high = low - far, high + far
    i, j = np.nonzero((low[:, None, 0] <= most[:, 0]) & (high[:, None, 0] >= least[:, 0]) & (low[:, None, 1] <= most[:, 1]) & (high[:, None, 1] >= least[:, 1]))
    (ex, ey), (fx, fy), (wx, wy) = (b - a)[i].T, (d - c)[j].T, (c[j] - a[i]).T
    k = ex * fy - ey * fx
    size = np.maximum(np.hypot(ex, ey) * np.hypot(fx, fy), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (wx * fy - wy * fx) / k
        u = (wx * ey - wy * ex) / k
    steep = np.abs(k) > 1e-14 * size
    ok = steep & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
    out_i, out_j, out_t = [i[ok]], [j[ok]], [t[ok]]
    flat = np.flatnonzero(~steep)
    i, j, ex, ey = i[flat], j[flat], ex[flat], ey[flat]
    ee = np.maximum(ex * ex + ey * ey, 1e-300)
    for end in (c, d) if len(flat) else ():  # overlapping parallel edges: ends that lie on the other edge
        vx, vy = (end[j] - a[i]).T
        s = (vx * ex + vy * ey) / ee
        off = np.abs(vx * ey - vy * ex) / np.sqrt(ee)
        on = (off < 1e-12 * np.sqrt(ee) + 1e-15) & (s >= 0) & (s <= 1)
        out_i.append(i[on])
        out_j.append(j[on])
        out_t.append(s[on])
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_t)


def _fragments(p: np.ndarray, others: list[np.ndarray], grid: float, itself: bool = False) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """p's edges cut wherever they meet others, on a fine grid so that equal points are the same."""
    a, b = p, np.roll(p, -1, 0)
    where: list[list[float]] = [[0.0, 1.0] for _ in a]
    for q in others:
        i, j, t = _cuts(a, b, q, np.roll(q, -1, 0))
        for k, m, s in zip(i.tolist(), j.tolist(), t.tolist(), strict=True):
            if not itself or k != m:
                where[k].append(min(1.0, max(0.0, s)))
    out = []
    for k, cuts in enumerate(where):
        points = [tuple(int(v) for v in np.round((a[k] + (b[k] - a[k]) * s) / grid)) for s in sorted(set(cuts))]
        out += [(x, y) for x, y in zip(points, points[1:], strict=False) if x != y]
    return out


def _chained(edges: list[tuple[tuple[int, int], tuple[int, int]]], grid: float) -> list[np.ndarray]:
    """Rings from directed edges; where several go on, the sharpest turn to the right is taken, so that rings stay simple."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for x, y in edges:
        after[x].append(y)
    rings = []
    for first in list(after):
        while after[first]:
            path, place = [first], {first: 0}
            while True:
                at = path[-1]
                if len(path) > 1 and len(after[at]) > 1:
                    come = np.arctan2(path[-2][1] - at[1], path[-2][0] - at[0])
                    turn = [(np.arctan2(n[1] - at[1], n[0] - at[0]) - come) % (2 * np.pi) or 2 * np.pi for n in after[at]]
                    nxt = after[at].pop(int(np.argmax(turn)))
                else:
                    nxt = after[at].pop() if after[at] else None
                if nxt is None:
                    break
                if nxt in place:  # a loop is closed: it is a ring of its own
                    loop = path[place[nxt] :]
                    if len(loop) > 2:
                        rings.append(np.array(loop, float) * grid)
                    for x in loop[1:]:
                        del place[x]
                    path = path[: place[nxt] + 1]
                    if len(path) == 1 and not after[nxt]:
                        break
                else:
                    place[nxt] = len(path)
                    path.append(nxt)
    return rings


def boolean(p: np.ndarray, q: np.ndarray, kind: str) -> list[np.ndarray]:
    """Rings of ``union``, ``intersection``, ``difference`` or ``xor`` of two simple rings; holes run clockwise.

    Edges are cut at all meetings, kept by where their middles lie (inside, outside or on the other
    ring, along or against it) and chained again.
    """
    if kind == "xor":
        return boolean(p, q, "difference") + boolean(q, p, "difference")
    if len(p) < 3 or len(q) < 3:
        one, two = [ccw(p)] if len(p) > 2 else [], [ccw(q)] if len(q) > 2 else []
        return {"union": one + two, "intersection": [], "difference": one}[kind]
    p, q = ccw(p), ccw(q)
    grid = float(max(np.ptp(np.concatenate([p, q]), axis=0).max(), 1e-300)) * SNAP
    fp, fq = _fragments(p, [q], grid), _fragments(q, [p], grid)
    in_p, in_q = set(fp), set(fq)
    middle = lambda f: np.array([((x[0] + y[0]) / 2 * grid, (x[1] + y[1]) / 2 * grid) for x, y in f]).reshape(-1, 2)
    inside_q, inside_p = contains(q, middle(fp)), contains(p, middle(fq))
    shared = lambda f, other: f in other or (f[1], f[0]) in other
    want = kind == "intersection"
    edges = [f for f, i in zip(fp, inside_q, strict=True) if not shared(f, in_q) and i == want]
    if kind == "difference":
        edges += [(y, x) for (x, y), i in zip(fq, inside_p, strict=True) if not shared((x, y), in_p) and i]
        edges += [f for f in fp if (f[1], f[0]) in in_q]
    else:
        edges += [f for f, i in zip(fq, inside_p, strict=True) if not shared(f, in_p) and i == want]
        edges += [f for f in fp if f in in_q]
    return _chained(edges, grid)


def boolean_area(p: np.ndarray, q: np.ndarray, kind: str) -> float:
    return float(sum(K.signed_area(r) for r in boolean(p, q, kind)))


def self_intersections(p: np.ndarray) -> np.ndarray:
    """Points (sorted) in which edges that aren't neighbours meet."""
    if len(p) < 4:
        return np.zeros((0, 2))
    a, b = p, np.roll(p, -1, 0)
    i, j, t = _cuts(a, b, a, b)
    n = len(p)
    far = (i != j) & ((i + 1) % n != j) & ((j + 1) % n != i)
    return np.unique(np.round(a[i[far]] + (b - a)[i[far]] * t[far][:, None], 9), axis=0).reshape(-1, 2)


def faults(p: np.ndarray) -> dict[str, bool]:
    """What keeps a ring from being valid."""
    step = np.hypot(*(np.roll(p, -1, 0) - p).T) if len(p) else np.zeros(0)
    return {"too_few": len(p) < 3, "repeated": bool((step == 0).any()), "no_area": len(p) < 3 or abs(K.signed_area(p)) < 1e-15, "crossing": bool(len(self_intersections(p)))}


def reflex_vertices(p: np.ndarray) -> list[int]:
    """Vertices whose inner angle is above a half turn."""
    if len(p) < 4:
        return []
    a, b, c = np.roll(p, 1, 0), p, np.roll(p, -1, 0)
    turn = (b - a)[:, 0] * (c - b)[:, 1] - (b - a)[:, 1] * (c - b)[:, 0]
    return np.flatnonzero(turn * (1 if K.signed_area(p) >= 0 else -1) < 0).tolist()


def minkowski_difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """All differences of points of two convex rings: the sum with the mirrored second."""
    return K.minkowski_convex(ccw(p), ccw(-q))


def collide(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two convex rings share a point: their difference holds the origin."""
    if len(p) < 3 or len(q) < 3:
        return False
    r = minkowski_difference(p, q)
    e = np.roll(r, -1, 0) - r
    return bool((e[:, 0] * -r[:, 1] + e[:, 1] * r[:, 0] >= -1e-12).all())


def sees(ring: np.ndarray, a: np.ndarray, b: np.ndarray, obstacles: list[np.ndarray] = ()) -> bool:
    """Whether the segment from a to b stays inside the ring and outside the obstacles."""
    for r, inside in ((ring, True), *((o, False) for o in obstacles)):
        _, _, t = _cuts(a[None], b[None], r, np.roll(r, -1, 0))
        at = np.unique(np.concatenate([[0.0, 1.0], np.clip(t, 0, 1)]))
        long = np.diff(at) > 1e-9  # meetings in one place, told apart by rounding only, have nothing between them
        middle = a + (b - a) * ((at[1:] + at[:-1]) / 2)[long, None]
        if len(middle) and (contains(r, middle) != inside).any():
            return False
    return True


def stroked(p: np.ndarray, width: float, join: str = "miter", cap: str = "butt", miter_limit: float = 4.0, tolerance: float = 0.01) -> np.ndarray:
    """The outline of a line drawn with a width; joins are miter, bevel or round, caps butt, square or round."""
    p = p[K.drop_repeats(p, 0.0)] if len(p) else p
    if len(p) < 2:
        return np.zeros((0, 2))
    h = width / 2

    def arc(center: np.ndarray, a: float, b: float) -> list[np.ndarray]:
        n = max(1, int(np.ceil(abs(b - a) / (2 * np.arccos(max(-1.0, 1 - tolerance / h))))))
        return [center + h * np.array([np.cos(x), np.sin(x)]) for x in np.linspace(a, b, n + 1)]

    def side(q: np.ndarray) -> list[np.ndarray]:
        d = np.diff(q, axis=0)
        u = d / np.hypot(*d.T)[:, None]
        n = np.stack([-u[:, 1], u[:, 0]], 1)
        out = [q[0] + n[0] * h]
        for k in range(1, len(q) - 1):
            turn = u[k - 1][0] * u[k][1] - u[k - 1][1] * u[k][0]
            bend = 1 + float(n[k - 1] @ n[k])
            if turn >= 0 or join == "bevel":  # the inner side, or a cut corner
                out += [q[k] + n[k - 1] * h, q[k] + n[k] * h]
            elif join == "round":
                a = np.arctan2(n[k - 1][1], n[k - 1][0])
                out += arc(q[k], a, a - np.arccos(np.clip(n[k - 1] @ n[k], -1, 1)))
            elif bend > 1e-12 and 2 / bend <= miter_limit**2:
                out.append(q[k] + (n[k - 1] + n[k]) * (h / bend))
            else:
                out += [q[k] + n[k - 1] * h, q[k] + n[k] * h]
        last = [q[-1] + n[-1] * h]
        if cap == "square":
            last += [q[-1] + (n[-1] + u[-1]) * h, q[-1] + (u[-1] - n[-1]) * h]
        elif cap == "round":
            a = np.arctan2(n[-1][1], n[-1][0])
            last += arc(q[-1], a, a - np.pi)[1:-1]
        return out + last

    return np.array(side(p) + side(p[::-1]))[::-1]


def voronoi_cell(site: np.ndarray, near: np.ndarray, low: tuple[float, float], high: tuple[float, float]) -> np.ndarray:
    """The part of a box that is nearer to a site than to any of its neighbours."""
    cell = np.array([low, (high[0], low[1]), high, (low[0], high[1])], float)
    for other in near:
        d, m = other - site, (other + site) / 2
        side = (cell - m) @ d
        out = []
        for k in range(len(cell)):
            a, b, x, y = cell[k], cell[(k + 1) % len(cell)], side[k], side[(k + 1) % len(cell)]
            if x <= 0:
                out.append(a)
            if x * y < 0:
                out.append(a + (b - a) * (x / (x - y)))
        cell = np.array(out).reshape(-1, 2)
        if not len(cell):
            break
    return cell


def voronoi_cells(p: np.ndarray, low: tuple[float, float], high: tuple[float, float]) -> list[np.ndarray]:
    """Each site's cell inside a box, cut out by the bisectors towards the sites that touch it in the Delaunay triangulation."""
    near: list[set[int]] = [set() for _ in p]
    for t in K.delaunay(p):
        for a in t:
            near[a].update(b for b in t if b != a)
    every = set(range(len(p)))
    return [voronoi_cell(site, p[sorted(near[i] or every - {i})], low, high) for i, site in enumerate(p)]
