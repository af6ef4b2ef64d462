"""Circles (struct<center, radius>) and ellipses (struct<center, semi_major, semi_minor, rotation>) as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from planewright.functions import lines as L
from planewright.functions.geometry import EPS, add, box, circle, distance, let, normalized, point, rotated, scale, segment_point_distance, sub


def _value(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def unit_circle() -> Column:
    return circle(point(0, 0), F.lit(1.0))


def circle_at(x: Column | float, y: Column | float, radius: Column | float) -> Column:
    return circle(point(x, y), _value(radius))


def circle_of_point(p: Column) -> Column:
    return circle(p, F.lit(0.0))


def circle_on_diameter(a: Column, b: Column) -> Column:
    return circle(point((a.x + b.x) / 2, (a.y + b.y) / 2), distance(a, b) / 2)


def diameter(c: Column) -> Column:
    return 2 * c.radius


def circle_area(c: Column) -> Column:
    return math.pi * c.radius * c.radius


def circumference(c: Column) -> Column:
    return 2 * math.pi * c.radius


def contains(c: Column, p: Column, eps: float = 0.0) -> Column:
    return distance(c.center, p) <= c.radius + eps


def contains_strict(c: Column, p: Column) -> Column:
    return distance(c.center, p) < c.radius


def circle_point(c: Column, angle: Column | float) -> Column:
    return add(c.center, scale(point(F.cos(_value(angle)), F.sin(_value(angle))), c.radius))


def circle_tangent(angle: Column | float) -> Column:
    return point(-F.sin(_value(angle)), F.cos(_value(angle)))


def circle_nearest(c: Column, p: Column) -> Column:
    """The point at angle 0 for the centre itself."""
    u = normalized(sub(p, c.center))
    return F.when(u.isNull(), point(c.center.x + c.radius, c.center.y)).otherwise(add(c.center, scale(u, c.radius)))


def circle_box(c: Column) -> Column:
    return box(c.center.x - c.radius, c.center.y - c.radius, c.center.x + c.radius, c.center.y + c.radius)


def circle_ring(c: Column, n: int) -> Column:
    """A regular ring of n (at least three) points."""
    n = max(3, n)
    return F.array(*(circle_point(c, 2 * math.pi * k / n) for k in range(n)))


def circles_meet(a: Column, b: Column) -> Column:
    """Whether the two lines of the circles share a point."""
    d = distance(a.center, b.center)
    return (d <= a.radius + b.radius) & (d >= F.abs(a.radius - b.radius))


def circle_meets_segment(c: Column, s: Column) -> Column:
    """Whether a segment has a point in the disc."""
    return segment_point_distance(s, c.center) <= c.radius


def circle_scaled(c: Column, k: Column | float) -> Column:
    return circle(c.center, c.radius * k)


def circle_moved(c: Column, offset: Column) -> Column:
    return circle(add(c.center, offset), c.radius)


# ------------------------------------------------------------------ ellipses


def ellipse(center: Column, semi_major: Column | float, semi_minor: Column | float, rotation: Column | float = 0.0) -> Column:
    return F.struct(center.alias("center"), _value(semi_major).alias("semi_major"), _value(semi_minor).alias("semi_minor"), _value(rotation).alias("rotation"))


def ellipse_of_circle(c: Column) -> Column:
    return ellipse(c.center, c.radius, c.radius)


def is_circle(e: Column) -> Column:
    return F.abs(e.semi_major - e.semi_minor) < EPS


def eccentricity(e: Column) -> Column:
    return F.sqrt(1 - F.pow(F.try_divide(e.semi_minor, e.semi_major), F.lit(2.0)))


def ellipse_area(e: Column) -> Column:
    return math.pi * e.semi_major * e.semi_minor


def ellipse_circumference(e: Column) -> Column:
    """Ramanujan's second approximation."""
    s, d = e.semi_major + e.semi_minor, e.semi_major - e.semi_minor
    h = F.try_divide(d * d, s * s)
    return math.pi * s * (1 + 3 * h / (10 + F.sqrt(4 - 3 * h)))


def major_axis(e: Column) -> Column:
    return point(F.cos(e.rotation), F.sin(e.rotation))


def minor_axis(e: Column) -> Column:
    return point(-F.sin(e.rotation), F.cos(e.rotation))


def to_local(e: Column, p: Column) -> Column:
    return rotated(sub(p, e.center), -e.rotation)


def from_local(e: Column, p: Column) -> Column:
    return add(e.center, rotated(p, e.rotation))


def _level(e: Column, p: Column) -> Column:
    q = to_local(e, p)
    u, v = F.try_divide(q.x, e.semi_major), F.try_divide(q.y, e.semi_minor)
    return u * u + v * v


def ellipse_holds(e: Column, p: Column, strict: bool = False) -> Column:
    return _level(e, p) < 1 if strict else _level(e, p) <= 1


def ellipse_point(e: Column, t: Column | float) -> Column:
    return from_local(e, point(e.semi_major * F.cos(_value(t)), e.semi_minor * F.sin(_value(t))))


def ellipse_tangent(e: Column, t: Column | float) -> Column:
    return rotated(point(-e.semi_major * F.sin(_value(t)), e.semi_minor * F.cos(_value(t))), e.rotation)


def ellipse_normal(e: Column, t: Column | float) -> Column:
    """Unit, outward; (1, 0) where there is no tangent."""
    v = ellipse_tangent(e, t)
    return F.coalesce(normalized(point(v.y, -v.x)), point(1, 0))


def ellipse_box(e: Column) -> Column:
    c, s = F.cos(e.rotation), F.sin(e.rotation)
    hx = F.sqrt(F.pow(e.semi_major * c, F.lit(2.0)) + F.pow(e.semi_minor * s, F.lit(2.0)))
    hy = F.sqrt(F.pow(e.semi_major * s, F.lit(2.0)) + F.pow(e.semi_minor * c, F.lit(2.0)))
    return box(e.center.x - hx, e.center.y - hy, e.center.x + hx, e.center.y + hy)


def ellipse_nearest(e: Column, p: Column, rounds: int = 40) -> Column:
    """The nearest point of the line of the ellipse, by halving its angle in the point's quadrant."""
    a, b = e.semi_major, e.semi_minor

    def nearest(q: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            t = (s.lo + s.hi) / 2
            # the derivative of half the squared distance; it has one zero in the quadrant
            slope = (b * b - a * a) * F.sin(t) * F.cos(t) + F.abs(q.x) * a * F.sin(t) - F.abs(q.y) * b * F.cos(t)
            return let(F.struct(t.alias("t"), slope.alias("v")), lambda m: F.struct(F.when(m.v < 0, m.t).otherwise(s.lo).alias("lo"), F.when(m.v < 0, s.hi).otherwise(m.t).alias("hi")))

        found = F.aggregate(F.array_repeat(F.lit(0), rounds), F.struct(F.lit(0.0).alias("lo"), F.lit(math.pi / 2).alias("hi")), step, lambda s: (s.lo + s.hi) / 2)
        sign = lambda v: F.when(v < 0, -1.0).otherwise(1.0)
        return let(found, lambda t: from_local(e, point(a * F.cos(t) * sign(q.x), b * F.sin(t) * sign(q.y))))

    return let(to_local(e, p), nearest)


def ellipse_distance(e: Column, p: Column) -> Column:
    """Signed: negative inside."""
    d = distance(ellipse_nearest(e, p), p)
    return F.when(ellipse_holds(e, p), -d).otherwise(d)


def ellipse_ring(e: Column, n: int) -> Column:
    n = max(3, n)
    return F.array(*(ellipse_point(e, 2 * math.pi * k / n) for k in range(n)))


def ellipse_scaled(e: Column, k: Column | float) -> Column:
    return ellipse(e.center, e.semi_major * k, e.semi_minor * k, e.rotation)


def ellipse_moved(e: Column, offset: Column) -> Column:
    return ellipse(add(e.center, offset), e.semi_major, e.semi_minor, e.rotation)


def ellipse_turned(e: Column, angle: Column | float) -> Column:
    return ellipse(e.center, e.semi_major, e.semi_minor, e.rotation + angle)


def foci(e: Column) -> Column:
    """The two foci, as an array."""
    k = scale(major_axis(e), F.sqrt(e.semi_major * e.semi_major - e.semi_minor * e.semi_minor))
    return F.array(sub(e.center, k), add(e.center, k))


def _hits(e: Column, o: Column, keep) -> Column:
    """Where a line meets an ellipse, in the frame in which the ellipse is the unit circle; parameters are the same there."""
    frame = F.struct(to_local(e, o.origin).alias("q"), rotated(o.direction, -e.rotation).alias("d"))
    stretched = lambda v: L.line(point(F.try_divide(v.q.x, e.semi_major), F.try_divide(v.q.y, e.semi_minor)), point(F.try_divide(v.d.x, e.semi_major), F.try_divide(v.d.y, e.semi_minor)))
    found = let(frame, lambda v: let(stretched(v), lambda u: L.circle_parameters(u, unit_circle())))
    return F.transform(F.filter(found, keep), lambda t: F.struct(L.at(o, t).alias("p"), t.alias("t")))


def ellipse_line(e: Column, o: Column) -> Column:
    """array<struct<p, t>>, in order of t."""
    return _hits(e, o, lambda t: t.isNotNull())


def ellipse_ray(e: Column, o: Column) -> Column:
    return _hits(e, o, lambda t: t >= 0)


def ellipse_segment(e: Column, s: Column) -> Column:
    return _hits(e, L.line_of_segment(s), lambda t: t.between(0, 1))


def ellipse_crossings(e: Column, o: Column, samples: int = 64, rounds: int = 40, close: bool = False) -> Column:
    """Points in which two ellipses cross, found along the first one.

    The level of the second ellipse changes its sign between neighbouring samples of the first; each
    change is halved down. Touches without a crossing aren't found, nor are pairs of crossings closer
    than a sample step unless ``close`` is set: then, where the level comes nearest to zero without a
    change, its turning point is looked for; if that lies beyond zero, there is a change on either
    side of it.
    """
    width = 2 * math.pi / samples
    # a point of the first ellipse in the frame of the second: sums of cosine and sine with fixed weights
    center, major, minor = to_local(o, e.center), rotated(major_axis(e), -o.rotation), rotated(minor_axis(e), -o.rotation)
    weights = [F.try_divide(v, r).alias(n) for axis, r in (("x", o.semi_major), ("y", o.semi_minor)) for n, v in ((f"{axis}0", center[axis]), (f"{axis}1", major[axis] * e.semi_major), (f"{axis}2", minor[axis] * e.semi_minor))]

    def found(k: Column) -> Column:
        level = lambda t: F.pow(k.x0 + k.x1 * F.cos(t) + k.x2 * F.sin(t), F.lit(2.0)) + F.pow(k.y0 + k.y1 * F.cos(t) + k.y2 * F.sin(t), F.lit(2.0)) - 1
        samples_ = F.transform(F.sequence(F.lit(0), F.lit(samples)), lambda i: F.struct((i * width).alias("t"), level(i * width).alias("v")))
        part = lambda lo, hi, v: F.struct(lo.alias("lo"), hi.alias("hi"), v.alias("v"))
        three = lambda s: F.transform(F.slice(s, 1, samples), lambda x, i: F.struct(x.t.alias("t"), s[F.when(i == 0, samples - 1).otherwise(i - 1)].v.alias("u"), x.v.alias("v"), s[i + 1].v.alias("w")))
        changes = lambda s: F.transform(F.filter(s, lambda x: x.v * x.w < 0), lambda x: part(x.t, x.t + width, x.v))
        turns = lambda s: F.filter(s, lambda x: (x.u * x.v > 0) & (x.v * x.w > 0) & (F.abs(x.v) <= F.abs(x.u)) & (F.abs(x.v) < F.abs(x.w)))

        def turning(x: Column) -> Column:
            """The turning point nearest to zero between the samples beside x, by thirds."""

            def step(s: Column, _: Column) -> Column:
                third = (s.hi - s.lo) / 3
                right = F.abs(level(s.lo + third) + s.v) > F.abs(level(s.hi - third) + s.v)  # v keeps the sum's sign where the level passes zero
                return F.struct(F.when(right, s.lo + third).otherwise(s.lo).alias("lo"), F.when(right, s.hi).otherwise(s.hi - third).alias("hi"), s.v.alias("v"))

            start = F.struct((x.t - width).alias("lo"), (x.t + width).alias("hi"), x.v.alias("v"))
            return F.aggregate(F.array_repeat(F.lit(0), rounds), start, step, lambda s: (s.lo + s.hi) / 2)

        def both(x: Column) -> Column:
            at = lambda m: F.when(level(m) * x.v < 0, F.array(part(x.t - width, m, x.v), part(m, x.t + width, level(m)))).otherwise(F.filter(F.array(part(m, m, x.v)), lambda _: F.lit(False)))
            return let(turning(x), at)

        starts = let(let(samples_, three), lambda s: F.concat(changes(s), F.flatten(F.transform(turns(s), both))) if close else changes(s))

        def root(x: Column) -> Column:
            def step(s: Column, _: Column) -> Column:
                m = (s.lo + s.hi) / 2
                left = s.v * level(m) <= 0  # the level at the lower end keeps its sign
                return F.struct(F.when(left, s.lo).otherwise(m).alias("lo"), F.when(left, m).otherwise(s.hi).alias("hi"), s.v.alias("v"))

            return F.aggregate(F.array_repeat(F.lit(0), rounds), x, step, lambda s: (s.lo + s.hi) / 2)

        return F.transform(F.array_sort(F.transform(starts, root)), lambda t: ellipse_point(e, t))

    return let(F.struct(*weights), found)


def ellipse_circle(e: Column, c: Column, samples: int = 64) -> Column:
    return ellipse_crossings(e, ellipse_of_circle(c), samples, close=True)


def ellipses_meet(e: Column, o: Column, samples: int = 64) -> Column:
    """Whether the areas of two ellipses share a point: a crossing, or the centre of one in the other."""
    return (F.size(ellipse_crossings(e, o, samples, close=True)) > 0) | ellipse_holds(e, o.center) | ellipse_holds(o, e.center)
