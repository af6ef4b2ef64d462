"""Bezier curves, arcs and spline spans as Column expressions; control points are struct<x, y> columns.

Arcs are struct<center, radius, start_angle, end_angle>. Whole splines over arrays of control points
are in ``curve_kernels``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from planewright.functions.geometry import EPS, add, bezier, bezier_derivative, box, circumcircle, cross, distance, let, midpoint, point, scale, segment, segment_point_distance, sub


def _v(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def control_bounds(*p: Column) -> Column:
    return box(F.least(*(q.x for q in p)), F.least(*(q.y for q in p)), F.greatest(*(q.x for q in p)), F.greatest(*(q.y for q in p)))


def flatness(*p: Column) -> Column:
    """The largest distance of an inner control point from the chord."""
    far = [segment_point_distance(segment(p[0], p[-1]), q) for q in p[1:-1]]
    return far[0] if len(far) == 1 else F.greatest(*far)


def turning_parameters(axis: str, *p: Column) -> Column:
    """Parameters inside (0, 1) at which one coordinate turns, as an array."""
    v = [q[axis] for q in p]
    if len(p) == 3:
        t = F.try_divide(v[0] - v[1], v[0] - 2 * v[1] + v[2])
        return F.filter(F.array(t), lambda t: (t > 0) & (t < 1))
    terms = F.struct((v[3] - 3 * v[2] + 3 * v[1] - v[0]).alias("a"), (v[2] - 2 * v[1] + v[0]).alias("b"), (v[1] - v[0]).alias("c"))

    def roots(k: Column) -> Column:
        root = F.sqrt(F.greatest(F.lit(0.0), k.b * k.b - k.a * k.c))
        # the stable pair: one root from the larger numerator, the other from the product of both
        big = F.when(k.b < 0, -k.b + root).otherwise(-k.b - root)
        return F.when(k.b * k.b - k.a * k.c >= 0, F.array(F.try_divide(big, k.a), F.try_divide(k.c, big))).otherwise(F.array().cast("array<double>"))

    return F.filter(let(terms, roots), lambda t: (t > 0) & (t < 1))


def tight_bounds(*p: Column) -> Column:
    """The least box around the curve itself."""

    def values(axis: str) -> Column:
        ends = F.array(p[0][axis], p[-1][axis])
        return F.concat(ends, F.transform(turning_parameters(axis, *p), lambda t: bezier(t, *p)[axis]))

    both = F.struct(values("x").alias("x"), values("y").alias("y"))
    return let(both, lambda v: box(F.array_min(v.x), F.array_min(v.y), F.array_max(v.x), F.array_max(v.y)))


#: Nodes and weights of Gauss-Legendre quadrature of order 5 on (-1, 1).
NODES = ((0.0, 128 / 225), *((s * math.sqrt(5 - k * 2 * math.sqrt(10 / 7)) / 3, (322 + k * 13 * math.sqrt(70)) / 900) for k in (1, -1) for s in (1, -1)))


def curve_length(*p: Column, parts: int = 48) -> Column:
    """Arc length by quadrature of the speed over equal parts of the parameter."""
    speeds = F.array(*(F.struct(F.lit((i + (1 + x) / 2) / parts).alias("t"), F.lit(w / (2 * parts)).alias("w")) for i in range(parts) for x, w in NODES))

    def add_up(total: Column, n: Column) -> Column:
        return total + n.w * let(bezier_derivative(n.t, *p), lambda d: F.sqrt(d.x * d.x + d.y * d.y))

    return F.aggregate(speeds, F.lit(0.0), add_up)


def curve_nearest(q: Column, *p: Column, samples: int = 32, rounds: int = 40) -> Column:
    """struct<t, d>: where the curve is nearest to a point; the best sample's neighbourhood is narrowed down by thirds."""
    gap = lambda t: let(bezier(t, *p), lambda b: (b.x - q.x) * (b.x - q.x) + (b.y - q.y) * (b.y - q.y))
    tried = F.transform(F.sequence(F.lit(0), F.lit(samples)), lambda i: F.struct(gap(i / samples).alias("d"), (i / samples).alias("t")))

    def narrowed(best: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            a, b = (s.lo * 2 + s.hi) / 3, (s.lo + s.hi * 2) / 3
            return F.when(gap(a) < gap(b), F.struct(s.lo.alias("lo"), b.alias("hi"))).otherwise(F.struct(a.alias("lo"), s.hi.alias("hi")))

        start = F.struct(F.greatest(F.lit(0.0), best.t - 1 / samples).alias("lo"), F.least(F.lit(1.0), best.t + 1 / samples).alias("hi"))
        found = F.aggregate(F.array_repeat(F.lit(0), rounds), start, step, lambda s: (s.lo + s.hi) / 2)
        return let(found, lambda t: F.struct(t.alias("t"), F.sqrt(gap(t)).alias("d")))

    return let(F.array_min(tried), narrowed)


def sampled(n: int, *p: Column) -> Column:
    """The curve's points at n + 1 even parameters, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: bezier(i / n, *p))


def unit_normal(t: Column | float, *p: Column) -> Column:
    """To the left of the direction; null where the curve stands still."""
    d = bezier_derivative(t, *p)
    k = F.nullif(F.sqrt(d.x * d.x + d.y * d.y), F.lit(0.0))
    return F.when(k.isNotNull(), point(-d.y / k, d.x / k))


def offset_point(t: Column | float, by: Column | float, *p: Column) -> Column:
    return add(bezier(t, *p), scale(unit_normal(t, *p), by))


def offset_line(n: int, by: float, *p: Column) -> Column:
    """n + 1 points of the curve's offset, to the left for a positive distance."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: offset_point(i / n, by, *p)), lambda q: q.x.isNotNull())


def self_crossing(*p: Column) -> Column:
    """struct<t, u, p>: the two parameters at which a cubic meets itself, null if it doesn't.

    With B(t) = a t^3 + b t^2 + c t + d, equal points give two linear equations for t + u and
    t^2 + t u + u^2.
    """
    a = point(*(p[3][k] - 3 * p[2][k] + 3 * p[1][k] - p[0][k] for k in "xy"))
    b = point(*(3 * (p[2][k] - 2 * p[1][k] + p[0][k]) for k in "xy"))
    c = point(*(3 * (p[1][k] - p[0][k]) for k in "xy"))

    def solved(v: Column) -> Column:
        k = cross(v.a, v.b)
        s, q = F.try_divide(cross(v.c, v.a), k), F.try_divide(cross(v.b, v.c), k)

        def pair(w: Column) -> Column:
            root = F.sqrt(F.greatest(F.lit(0.0), 4 * w.q - 3 * w.s * w.s))
            t, u = (w.s - root) / 2, (w.s + root) / 2
            return F.when((F.abs(w.k) > EPS) & (4 * w.q - 3 * w.s * w.s > 0) & (t >= 0) & (u <= 1), F.struct(t.alias("t"), u.alias("u")))

        return let(F.struct(s.alias("s"), q.alias("q"), k.alias("k")), pair)

    found = let(F.struct(a.alias("a"), b.alias("b"), c.alias("c")), solved)
    return let(found, lambda f: F.when(f.isNotNull(), F.struct(f.t.alias("t"), f.u.alias("u"), bezier(f.t, *p).alias("p"))))


def curve_line_parameters(s: Column, *p: Column) -> Column:
    """Ascending parameters at which a quadratic curve meets a segment."""
    d = sub(s.end, s.start)
    w = [cross(d, sub(q, s.start)) for q in p]  # the curve's height above the segment's line, as a polynomial
    terms = F.struct((w[0] - 2 * w[1] + w[2]).alias("a"), (w[1] - w[0]).alias("b"), w[0].alias("c"))

    def roots(k: Column) -> Column:
        root = F.sqrt(F.greatest(F.lit(0.0), k.b * k.b - k.a * k.c))
        big = F.when(k.b < 0, -k.b + root).otherwise(-k.b - root)
        return F.when(k.b * k.b - k.a * k.c >= 0, F.array_sort(F.array(F.try_divide(big, k.a), F.try_divide(k.c, big)))).otherwise(F.array().cast("array<double>"))

    def on(t: Column) -> Column:
        q = bezier(t, *p)
        along = F.try_divide((q.x - s.start.x) * d.x + (q.y - s.start.y) * d.y, d.x * d.x + d.y * d.y)
        return t.between(0, 1) & along.between(0, 1)

    return F.filter(let(terms, roots), on)


# ------------------------------------------------------------------ arcs


def arc(center: Column, radius: Column | float, start: Column | float, end: Column | float) -> Column:
    return F.struct(center.alias("center"), _v(radius).alias("radius"), _v(start).alias("start_angle"), _v(end).alias("end_angle"))


def arc_at_angle(o: Column, angle: Column | float) -> Column:
    return point(o.center.x + o.radius * F.cos(_v(angle)), o.center.y + o.radius * F.sin(_v(angle)))


def arc_start(o: Column) -> Column:
    return arc_at_angle(o, o.start_angle)


def arc_end(o: Column) -> Column:
    return arc_at_angle(o, o.end_angle)


def sweep(o: Column) -> Column:
    return o.end_angle - o.start_angle


def arc_at(o: Column, t: Column | float) -> Column:
    return arc_at_angle(o, o.start_angle + sweep(o) * t)


def arc_length(o: Column) -> Column:
    return o.radius * F.abs(sweep(o))


def is_full_circle(o: Column) -> Column:
    return F.abs(sweep(o)) >= 2 * math.pi - EPS


def _angle(p: Column, c: Column) -> Column:
    return F.atan2(p.y - c.y, p.x - c.x)


def arc_through(a: Column, b: Column, c: Column) -> Column:
    """From a to c on the circle through b; null on a line. The angles are those of the ends."""
    return let(circumcircle(a, b, c), lambda o: F.when(o.isNotNull(), arc(o.center, o.radius, _angle(a, o.center), _angle(c, o.center))))


def arc_of_bulge(a: Column, b: Column, bulge: Column) -> Column:
    """From a to b with the given ratio of height to half the chord; null without height or chord."""
    d = sub(b, a)
    n = distance(a, b)
    high = bulge * n / 2
    radius = F.try_divide(n * n / 4 + high * high, 2 * F.abs(high))
    off = F.try_divide((radius - F.abs(high)) * F.signum(bulge), n)
    center = add(midpoint(a, b), point(-d.y * off, d.x * off))
    made = let(F.struct(center.alias("c"), radius.alias("r")), lambda v: arc(v.c, v.r, _angle(a, v.c), _angle(b, v.c)))
    return F.when((F.abs(bulge) > EPS) & (n > EPS), made)


def arc_segments(o: Column, tolerance: float) -> Column:
    """How many chords keep within the tolerance."""
    widest = 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.try_divide(F.lit(tolerance), o.radius))))
    many = F.greatest(F.lit(1), F.ceil(F.try_divide(F.abs(sweep(o)), widest)).cast("int"))
    return F.when((o.radius <= EPS) | (F.abs(sweep(o)) <= EPS) | (F.lit(tolerance) >= o.radius), F.lit(1)).otherwise(F.coalesce(many, F.lit(1)))


def arc_line(o: Column, tolerance: float) -> Column:
    """Points of the arc, ends included, with chords within the tolerance."""
    return let(arc_segments(o, tolerance), lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: arc_at(o, i / n)))


# ------------------------------------------------------------------ spline spans


def catmull_rom_span(t: Column | float, p0: Column, p1: Column, p2: Column, p3: Column, alpha: float) -> Column:
    """The spline between p1 and p2, t from 0 to 1; alpha 0 is uniform, 0.5 centripetal, 1 chordal (repeated interpolation)."""
    steps = F.struct(*(F.pow(distance(a, b), F.lit(alpha)).alias(n) for n, a, b in (("a", p0, p1), ("b", p1, p2), ("c", p2, p3))))

    def made(k: Column) -> Column:
        at = [F.lit(0.0), k.a, k.a + k.b, k.a + k.b + k.c]
        u = k.a + k.b * t

        def mixed(p: Column, q: Column, lo: Column, hi: Column) -> Column:
            r = F.try_divide(u - lo, hi - lo)
            return point(p.x + (q.x - p.x) * r, p.y + (q.y - p.y) * r)

        first = F.struct(*(mixed(p, q, at[i], at[i + 1]).alias(f"q{i}") for i, (p, q) in enumerate(((p0, p1), (p1, p2), (p2, p3)))))
        second = lambda v: F.struct(mixed(v.q0, v.q1, at[0], at[2]).alias("q0"), mixed(v.q1, v.q2, at[1], at[3]).alias("q1"))
        return let(first, lambda v: let(second(v), lambda w: mixed(w.q0, w.q1, at[1], at[2])))

    return let(steps, made)


def cardinal_tangent(before: Column, after: Column, tension: float) -> Column:
    return scale(sub(after, before), (1 - tension) / 2)
