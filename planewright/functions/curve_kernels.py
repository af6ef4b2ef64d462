"""Whole splines and Bezier curves of any degree, one curve at a time, in numpy: control points (n, 2) in, points out."""

from __future__ import annotations

import math

import numpy as np

# ------------------------------------------------------------------ Bezier


def bezier_points(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Points at parameters t, by repeated interpolation."""
    t = np.asarray(t, float)[:, None, None]
    row = np.broadcast_to(p, (len(t), *p.shape))
    while row.shape[1] > 1:
        row = row[:, :-1] * (1 - t) + row[:, 1:] * t
    return row[:, 0]


def halves(p: np.ndarray, t: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Control points of both parts."""
    left, right, row = [p[0]], [p[-1]], p
    while len(row) > 1:
        row = row[:-1] * (1 - t) + row[1:] * t
        left.append(row[0])
        right.append(row[-1])
    return np.array(left), np.array(right[::-1])


def _flat(p: np.ndarray) -> float:
    a, d = p[0], p[-1] - p[0]
    k = float(d @ d)
    t = np.clip((p[1:-1] - a) @ d / k, 0, 1) if k > 0 else np.zeros(len(p) - 2)
    return float(np.hypot(*(a + t[:, None] * d - p[1:-1]).T).max(initial=0))


def flattened(p: np.ndarray, tolerance: float, deepest: int = 24) -> np.ndarray:
    """A line within the tolerance of the curve; null-safe for fewer than two points."""
    if len(p) < 2:
        return p
    out, todo = [p[0]], [(p, 0)]
    while todo:
        q, depth = todo.pop()
        if depth >= deepest or _flat(q) <= tolerance:
            out.append(q[-1])
        else:
            a, b = halves(q)
            todo += [(b, depth + 1), (a, depth + 1)]
    return np.array(out)


def length(p: np.ndarray) -> float:
    return float(np.hypot(*np.diff(p, axis=0).T).sum()) if len(p) > 1 else 0.0


def bezier_length(p: np.ndarray, tolerance: float = 1e-6) -> float:
    return length(flattened(p, tolerance))


def _zeros(b: list[float], near: float) -> list[float]:
    """Where a polynomial on 0 to 1, given by its Bernstein coefficients, is zero: between zeros of its derivative it is so once at the most; within ``near`` of zero at one of those or at an end counts."""
    n = len(b) - 1
    if n < 1:
        return []
    rows = [b]
    while len(rows[-1]) > 1:
        rows.append([y - x for x, y in zip(rows[-1], rows[-1][1:], strict=False)])
    power = [math.comb(n, k) * r[0] for k, r in enumerate(rows)][::-1]

    def at(t: float) -> float:
        v = 0.0
        for c in power:
            v = v * t + c
        return v

    cuts = sorted({0.0, *_zeros(rows[1], 0.0), 1.0})
    values = [b[0], *map(at, cuts[1:-1]), b[-1]]
    out = {t for t, v in zip(cuts, values, strict=True) if abs(v) <= near}
    for low, high, v, w in zip(cuts, cuts[1:], values, values[1:], strict=False):
        if v * w < 0 and low not in out and high not in out:
            while low < (mid := (low + high) / 2) < high:
                low, high = (mid, high) if (at(mid) < 0) == (v < 0) else (low, mid)
            out.add(mid)
    return sorted(out)


def _on_line(p: np.ndarray, q: np.ndarray, eps: float) -> bool:
    """Whether a curve lies on a segment's line, with which it may share a stretch."""
    d = q[1] - q[0]
    return bool((np.abs((p - q[0]) @ np.array([-d[1], d[0]])) <= eps * np.hypot(*d)).all())


def _line_crossings(p: np.ndarray, q: np.ndarray, eps: float) -> list[tuple[float, float]]:
    """Parameters (t, u) where a curve meets a segment: zeros of its distance from the segment's line that lie on the segment."""
    d = q[1] - q[0]
    length = float(np.hypot(*d))
    side = ((p - q[0]) @ np.array([-d[1], d[0]]) / length).tolist()
    found = np.array(_zeros(side, eps))
    along = (bezier_points(p, found) - q[0]) @ d / length**2 if len(found) else found
    return [(float(t), float(min(1.0, max(0.0, u)))) for t, u in zip(found, along, strict=True) if -eps <= u * length <= length + eps]


def bezier_crossings(p: np.ndarray, q: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """Rows (t, u, x, y) where two curves of any degree (segments too) meet: boxes that overlap are halved; near results are one.

    A segment meets a curve where its line does; boxes would give a flat crossing several times.
    """
    found: list[tuple[float, float]] = []
    todo = [(p, 0.0, 1.0, q, 0.0, 1.0)]
    line = next((k for k, (r, o) in enumerate(((q, p), (p, q))) if len(r) == 2 and (r[0] != r[1]).any() and not _on_line(o, r, eps)), None)
    if line is not None:
        found, todo = (_line_crossings(p, q, eps) if line == 0 else [(t, u) for u, t in _line_crossings(q, p, eps)]), []
    while todo:
        a, a0, a1, b, b0, b1 = todo.pop()
        if (a.min(0) > b.max(0) + eps).any() or (b.min(0) > a.max(0) + eps).any():
            continue
        wide_a, wide_b = float(np.ptp(a, axis=0).max()), float(np.ptp(b, axis=0).max())
        if max(wide_a, wide_b) < eps * 8 or max(a1 - a0, b1 - b0) < 1e-12:
            found.append(((a0 + a1) / 2, (b0 + b1) / 2))
            if len(found) > 4096:  # the curves share a stretch
                break
            continue
        if wide_a >= wide_b:
            m, (x, y) = (a0 + a1) / 2, halves(a)
            todo += [(x, a0, m, b, b0, b1), (y, m, a1, b, b0, b1)]
        else:
            m, (x, y) = (b0 + b1) / 2, halves(b)
            todo += [(a, a0, a1, x, b0, m), (a, a0, a1, y, m, b1)]
    out: list[tuple[float, float, float, float]] = []
    for t, u in sorted(found):
        x, y = bezier_points(p, np.array([t]))[0]
        if not any(np.hypot(x - o[2], y - o[3]) < 1e-6 for o in out):
            out.append((t, u, float(x), float(y)))
    return np.array(out).reshape(-1, 4)


def bezier_crossing_points(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return bezier_crossings(p, q)[:, 2:]


def offset_curves(p: np.ndarray, by: float, tolerance: float = 1e-3, deepest: int = 12) -> list[np.ndarray]:
    """Curves of the same degree that follow the offset: control polygons are moved out, parts too far off are halved."""

    def moved(q: np.ndarray) -> np.ndarray:
        d = np.diff(q, axis=0)
        n = np.hypot(*d.T)
        keep = n > 1e-12
        if not keep.any():
            return q
        u = np.stack([-d[:, 1], d[:, 0]], 1)[keep] / n[keep][:, None]
        lines = [(a + v * by, e) for a, v, e in zip(q[:-1][keep], u, d[keep], strict=True)]
        out = [q[0] + u[0] * by]
        for k in range(1, len(q) - 1):
            (a, e), (b, f) = lines[min(k - 1, len(lines) - 1)], lines[min(k, len(lines) - 1)]
            c = e[0] * f[1] - e[1] * f[0]
            out.append(b if abs(c) < 1e-12 else a + e * (((b - a)[0] * f[1] - (b - a)[1] * f[0]) / c))
        return np.array([*out, q[-1] + u[-1] * by])

    def wrong(q: np.ndarray, r: np.ndarray) -> float:
        t = np.array([0.25, 0.5, 0.75])
        return float(np.abs(np.hypot(*(bezier_points(r, t) - bezier_points(q, t)).T) - abs(by)).max())

    out, todo = [], [(p, 0)]
    while todo:
        q, depth = todo.pop()
        r = moved(q)
        if depth >= deepest or wrong(q, r) <= tolerance:
            out.append(r)
        else:
            a, b = halves(q)
            todo += [(b, depth + 1), (a, depth + 1)]
    return out


def offset_line(p: np.ndarray, by: float, tolerance: float = 1e-3) -> np.ndarray:
    """The offset as one line."""
    lines = [flattened(c, tolerance) for c in offset_curves(p, by, tolerance)]
    return np.concatenate([lines[0], *(x[1:] for x in lines[1:])])


def fit_cubic_refined(p: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A cubic by least squares, its parameters improved by Newton steps in between."""
    if len(p) < 2:
        return p
    step = np.append(0, np.cumsum(np.hypot(*np.diff(p, axis=0).T)))
    t = step / step[-1] if step[-1] > 0 else np.linspace(0, 1, len(p))
    c = np.array([p[0], p[0], p[-1], p[-1]], float)
    for _ in range(rounds):
        b = np.stack([(1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t**2, t**3], 1)
        c[1:3] = np.linalg.lstsq(b[:, 1:3], p - b[:, [0, 3]] @ c[[0, 3]], rcond=None)[0]
        d1, d2 = 3 * np.diff(c, axis=0), 6 * np.diff(c, 2, axis=0)
        r, v, a = bezier_points(c, t) - p, bezier_points(d1, t), bezier_points(d2, t)
        under = (v * v).sum(1) + (r * a).sum(1)
        t = np.clip(np.where(np.abs(under) > 1e-12, t - (r * v).sum(1) / np.where(under == 0, 1, under), t), 0, 1)
        t[0], t[-1] = 0, 1
    return c


# ------------------------------------------------------------------ B-splines, rational or not


def uniform_knots(n: int, degree: int) -> np.ndarray:
    return np.arange(n + degree + 1, dtype=float)


def open_knots(n: int, degree: int) -> np.ndarray:
    """Ends repeated, so that the curve starts and ends in its control points."""
    inner = np.arange(n - degree + 1, dtype=float)
    return np.concatenate([np.full(degree, inner[0]), inner, np.full(degree, inner[-1])])


def domain(knots: np.ndarray, degree: int) -> tuple[float, float]:
    return float(knots[degree]), float(knots[-degree - 1])


def spline_points(p: np.ndarray, t: np.ndarray, degree: int, knots: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Points at parameters t (held inside the domain), by de Boor's interpolation; weights make it rational."""
    h = np.concatenate([p * weights[:, None], weights[:, None]], 1) if weights is not None else p
    lo, hi = domain(knots, degree)
    t = np.clip(np.asarray(t, float), lo, hi)
    k = np.clip(np.searchsorted(knots, t, "right") - 1, degree, len(p) - 1)
    d = h[k[:, None] - degree + np.arange(degree + 1)]
    for r in range(1, degree + 1):
        i = k[:, None] - degree + np.arange(r, degree + 1)
        wide = knots[i + degree - r + 1] - knots[i]
        a = np.where(wide > 0, (t[:, None] - knots[i]) / np.where(wide > 0, wide, 1), 0)[:, :, None]
        d = d[:, :-1] * (1 - a) + d[:, 1:] * a
    out = d[:, 0]
    return out[:, :2] / out[:, 2:] if weights is not None else out


def spline_derivative(p: np.ndarray, degree: int, knots: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Control points, degree and knots of the derivative."""
    wide = (knots[degree + 1 : degree + len(p)] - knots[1 : len(p)])[:, None]
    return degree * np.diff(p, axis=0) / np.where(wide > 0, wide, 1), degree - 1, knots[1:-1]


def insert_knot(p: np.ndarray, degree: int, knots: np.ndarray, u: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Control points, knots and weights of the same curve with one knot more."""
    h = np.concatenate([p * weights[:, None], weights[:, None]], 1) if weights is not None else p
    k = int(np.clip(np.searchsorted(knots, u, "right") - 1, degree, len(p) - 1))
    out = []
    for i in range(len(p) + 1):
        wide = knots[i + degree] - knots[i] if i + degree < len(knots) else 0
        a = 1.0 if i <= k - degree else 0.0 if i > k else (u - knots[i]) / wide if wide > 0 else 0.0
        out.append(h[min(i, len(p) - 1)] * a + h[max(i - 1, 0)] * (1 - a))
    out = np.array(out)
    more = np.insert(knots, k + 1, u)
    return (out[:, :2] / out[:, 2:], more, out[:, 2]) if weights is not None else (out, more, None)


def _spaced(knots: np.ndarray, degree: int, n: int) -> np.ndarray:
    return np.linspace(*domain(knots, degree), n + 1)


def open_spline_line(p: np.ndarray, degree: int, n: int) -> np.ndarray:
    """n + 1 points of the open uniform spline; the degree is lowered for few control points."""
    if len(p) < 2:
        return p
    degree = min(degree, len(p) - 1)
    knots = open_knots(len(p), degree)
    return spline_points(p, _spaced(knots, degree, n), degree, knots)


def uniform_spline_line(p: np.ndarray, degree: int, n: int) -> np.ndarray:
    if len(p) <= degree:
        return p[:0]
    knots = uniform_knots(len(p), degree)
    return spline_points(p, _spaced(knots, degree, n), degree, knots)


def refined_spline_line(p: np.ndarray, degree: int, n: int, u: float) -> np.ndarray:
    """The open spline's points after a knot at the given share of its domain; the same as before."""
    degree = min(degree, len(p) - 1)
    knots = open_knots(len(p), degree)
    lo, hi = domain(knots, degree)
    q, more, _ = insert_knot(p, degree, knots, lo + (hi - lo) * u)
    return spline_points(q, _spaced(knots, degree, n), degree, more)


def spline_tangents(p: np.ndarray, degree: int, n: int) -> np.ndarray:
    """The open spline's derivative at n + 1 parameters."""
    degree = min(degree, len(p) - 1)
    knots = open_knots(len(p), degree)
    return spline_points(*(lambda q, d, k: (q, _spaced(knots, degree, n), d, k))(*spline_derivative(p, degree, knots)))


def rational_arc(start: float, end: float, radius: float = 1.0, center: tuple[float, float] = (0.0, 0.0), stretch: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control points, knots and weights of an arc of a circle (or, with ``stretch``, of an ellipse) as a rational quadratic spline."""
    parts = max(1, int(np.ceil(abs(end - start) / (np.pi / 2) - 1e-9)))
    step = (end - start) / parts
    angle = start + step * np.arange(2 * parts + 1) / 2
    w = np.where(np.arange(2 * parts + 1) % 2, np.cos(step / 2), 1.0)
    p = np.stack([np.cos(angle), np.sin(angle)], 1) / w[:, None] * radius * np.array([1.0, stretch]) + np.array(center)
    inner = np.repeat(np.arange(parts + 1, dtype=float), 2)
    return p, np.concatenate([[0.0], inner, [float(parts)]]), w


def rational_arc_line(start: float, end: float, n: int, radius: float = 1.0, stretch: float = 1.0) -> np.ndarray:
    p, knots, w = rational_arc(start, end, radius, stretch=stretch)
    return spline_points(p, _spaced(knots, 2, n), 2, knots, w)


# ------------------------------------------------------------------ Catmull-Rom and Hermite


def hermite_line(p: np.ndarray, tangents: np.ndarray, per_span: int) -> np.ndarray:
    """A spline through all points with the given tangents."""
    if len(p) < 2:
        return p
    t = (np.arange(per_span) / per_span)[None, :, None]
    w = (2 * t**3 - 3 * t**2 + 1, t**3 - 2 * t**2 + t, -2 * t**3 + 3 * t**2, t**3 - t**2)
    a, b, m, n = p[:-1, None], p[1:, None], tangents[:-1, None], tangents[1:, None]
    return np.concatenate([(w[0] * a + w[1] * m + w[2] * b + w[3] * n).reshape(-1, 2), p[-1:]])


def cardinal_tangents(p: np.ndarray, tension: float = 0.0) -> np.ndarray:
    """Half the way between neighbours; to the only neighbour at the ends."""
    out = np.zeros_like(p)
    if len(p) > 1:
        out[1:-1] = (p[2:] - p[:-2]) / 2
        out[0], out[-1] = p[1] - p[0], p[-1] - p[-2]
    return out * (1 - tension)


def cardinal_line(p: np.ndarray, per_span: int, tension: float = 0.0) -> np.ndarray:
    return hermite_line(p, cardinal_tangents(p, tension), per_span)


def still_line(p: np.ndarray, per_span: int) -> np.ndarray:
    """A spline that stands still in each of its points."""
    return hermite_line(p, np.zeros_like(p), per_span)


def catmull_rom_line(p: np.ndarray, per_span: int, alpha: float = 0.5) -> np.ndarray:
    """A spline through all points; end points are mirrored to get their outer neighbours."""
    if len(p) < 2:
        return p
    q = np.concatenate([[2 * p[0] - p[1]], p, [2 * p[-1] - p[-2]]])
    out = []
    for k in range(len(p) - 1):
        a, b, c, d = q[k : k + 4]
        steps = [max(float(np.hypot(*(y - x))), 1e-12) ** alpha for x, y in ((a, b), (b, c), (c, d))]
        k0, k1, k2, k3 = 0.0, *np.cumsum(steps)
        u = (k1 + (k2 - k1) * np.arange(per_span) / per_span)[:, None]
        mixed = lambda x, y, lo, hi: x + (y - x) * (u - lo) / (hi - lo)  # noqa: B023, E731
        ab, bc, cd = mixed(a, b, k0, k1), mixed(b, c, k1, k2), mixed(c, d, k2, k3)
        out.append(mixed(mixed(ab, bc, k0, k2), mixed(bc, cd, k1, k3), k1, k2))
    return np.concatenate([*out, p[-1:]])
