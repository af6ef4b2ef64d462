"""Infinite lines, rays and segments as Column expressions.

Lines and rays are struct<origin, direction>; a ray goes forward only. Parameters are in units of the
direction. Crossings that don't exist are null, lists of crossings empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planewright.functions.geometry import EPS, add, cross, distance, distance_squared, dot, let, magnitude, normalized, perpendicular, point, rotated, scale, segment, sub

LineOrRay = Column


def line(origin: Column, direction: Column) -> Column:
    return F.struct(origin.alias("origin"), direction.alias("direction"))


def line_through(a: Column, b: Column) -> Column:
    """Also the ray from a through b, and the line of a segment's ends."""
    return line(a, sub(b, a))


def line_of_segment(s: Column) -> Column:
    return line_through(s.start, s.end)


def horizontal(y: Column | float) -> Column:
    return line(point(0, y), point(1, 0))


def vertical(x: Column | float) -> Column:
    return line(point(x, 0), point(0, 1))


def from_implicit(a: Column, b: Column, c: Column) -> Column:
    """The line a x + b y + c = 0; null if a and b are zero."""
    origin = F.when(F.abs(a) > F.abs(b), point(F.try_divide(-c, a), 0)).otherwise(point(0, F.try_divide(-c, b)))
    return F.when(a * a + b * b > EPS, line(origin, point(-b, a)))


def implicit(o: Column) -> Column:
    """struct<a, b, c> with (a, b) the unit normal; zeros for a line without direction."""
    n = normalized(perpendicular(o.direction))
    a, b = F.coalesce(n.x, F.lit(0.0)), F.coalesce(n.y, F.lit(0.0))
    return F.struct(a.alias("a"), b.alias("b"), (-(a * o.origin.x + b * o.origin.y)).alias("c"))


def line_normal(o: Column) -> Column:
    return perpendicular(o.direction)


def at(o: LineOrRay, t: Column | float) -> Column:
    return add(o.origin, scale(o.direction, t))


def _parameter(o: Column, p: Column) -> Column:
    return F.coalesce(F.when(dot(o.direction, o.direction) > EPS, F.try_divide(dot(sub(p, o.origin), o.direction), dot(o.direction, o.direction))), F.lit(0.0))


def project(o: Column, p: Column) -> Column:
    """struct<p, t>: the closest point of a line and its parameter."""
    t = _parameter(o, p)
    return F.struct(at(o, t).alias("p"), t.alias("t"))


def ray_project(o: Column, p: Column) -> Column:
    """struct<p, t>: the closest point of a ray and its parameter."""
    t = F.greatest(F.lit(0.0), _parameter(o, p))
    return F.struct(at(o, t).alias("p"), t.alias("t"))


def signed_distance(o: Column, p: Column) -> Column:
    """Positive on the left of the direction."""
    n = implicit(o)
    return n.a * p.x + n.b * p.y + n.c


def line_contains(o: Column, p: Column, tolerance: float) -> Column:
    return F.abs(signed_distance(o, p)) <= tolerance


def ray_distance(o: Column, p: Column) -> Column:
    return distance(ray_project(o, p).p, p)


def _crossing(a: Column, b: Column) -> Column:
    """struct<t, u> of two directions' lines, null if parallel."""
    k, w = cross(a.direction, b.direction), sub(b.origin, a.origin)
    return F.when(F.abs(k) > EPS, F.struct(F.try_divide(cross(w, b.direction), k).alias("t"), F.try_divide(cross(w, a.direction), k).alias("u")))


def _hit(a: Column, c: Column, inside: Column) -> Column:
    return F.when(inside, F.struct(at(a, c.t).alias("p"), c.t.alias("t"), c.u.alias("u")))


def line_line(a: Column, b: Column) -> Column:
    """struct<p, t, u>, null if parallel."""
    c = _crossing(a, b)
    return _hit(a, c, c.isNotNull())


def line_ray(a: Column, r: Column) -> Column:
    c = _crossing(a, r)
    return _hit(a, c, c.u >= 0)


def line_segment(a: Column, s: Column) -> Column:
    c = _crossing(a, line_of_segment(s))
    return _hit(a, c, c.u.between(0, 1))


def ray_ray(a: Column, b: Column) -> Column:
    c = _crossing(a, b)
    return _hit(a, c, (c.t >= 0) & (c.u >= 0))


def ray_segment(r: Column, s: Column) -> Column:
    c = _crossing(r, line_of_segment(s))
    return _hit(r, c, (c.t >= 0) & c.u.between(0, 1))


def circle_parameters(o: LineOrRay, c: Column) -> Column:
    """Ascending parameters at which a line meets a circle: none, one at a touch, or two."""
    w = sub(o.origin, c.center)
    terms = F.struct(dot(o.direction, o.direction).alias("a"), dot(w, o.direction).alias("b"), (dot(w, w) - c.radius * c.radius).alias("c"))

    def solved(v: Column) -> Column:
        k = F.struct((v.b * v.b - v.a * v.c).alias("k"), v.a.alias("a"), v.b.alias("b"))
        return let(k, lambda v: F.when((v.k < 0) | (v.a <= EPS) | v.k.isNull(), F.array().cast("array<double>")).when(4 * v.k < EPS, F.array(F.try_divide(-v.b, v.a))).otherwise(F.array(F.try_divide(-v.b - F.sqrt(v.k), v.a), F.try_divide(-v.b + F.sqrt(v.k), v.a))))

    return let(terms, solved)


def _points_at(o: LineOrRay, parameters: Column) -> Column:
    return F.transform(parameters, lambda t: F.struct(at(o, t).alias("p"), t.alias("t")))


def line_circle(o: Column, c: Column) -> Column:
    """array<struct<p, t>>."""
    return _points_at(o, circle_parameters(o, c))


def ray_circle(o: Column, c: Column) -> Column:
    return _points_at(o, F.filter(circle_parameters(o, c), lambda t: t >= 0))


def segment_circle(s: Column, c: Column) -> Column:
    o = line_of_segment(s)
    return _points_at(o, F.filter(circle_parameters(o, c), lambda t: t.between(0, 1)))


def ray_ring(r: Column, ring: Column | str) -> Column:
    """array<struct<t, edge, p>> of all edges of a ring that a ray meets, nearest first."""
    ring = F.col(ring) if isinstance(ring, str) else ring

    def hit(p: Column, i: Column) -> Column:
        after = F.element_at(ring, F.when(i + 1 < F.size(ring), i + 2).otherwise(F.lit(1)).cast("int"))
        h = ray_segment(r, segment(p, after))
        return F.struct(h.t.alias("t"), i.alias("edge"), h.p.alias("p"))

    return F.array_sort(F.filter(F.transform(ring, hit), lambda h: h.t.isNotNull()))


def parallel(a: Column, b: Column) -> Column:
    return F.abs(cross(a.direction, b.direction)) < EPS


def perpendicular_to(a: Column, b: Column) -> Column:
    return F.abs(dot(a.direction, b.direction)) < EPS


def angle_to(a: Column, b: Column) -> Column:
    """Between 0 and a right angle; 0 if a direction is missing."""
    k = F.try_divide(F.abs(dot(a.direction, b.direction)), magnitude(a.direction) * magnitude(b.direction))
    return F.coalesce(F.acos(F.least(F.lit(1.0), k)), F.lit(0.0))


def perpendicular_at(o: Column, p: Column) -> Column:
    return line(p, line_normal(o))


def parallel_at(o: Column, d: Column | float) -> Column:
    """The parallel d to the left, null for a line without direction."""
    n = normalized(line_normal(o))
    return F.when(n.isNotNull(), line(add(o.origin, scale(n, d)), o.direction))


def moved(o: LineOrRay, offset: Column) -> Column:
    return line(add(o.origin, offset), o.direction)


def turned(o: LineOrRay, angle: Column | float) -> Column:
    return line(o.origin, rotated(o.direction, angle))


def turned_around(o: LineOrRay, angle: Column | float, pivot: Column) -> Column:
    return line(add(pivot, rotated(sub(o.origin, pivot), angle)), rotated(o.direction, angle))


def reflected(o: Column, p: Column) -> Column:
    """The mirror image of a point in a line."""
    q = project(o, p).p
    return point(2 * q.x - p.x, 2 * q.y - p.y)


def reversed_ray(o: Column) -> Column:
    return line(o.origin, scale(o.direction, -1.0))


# ------------------------------------------------------------------ segments


def segment_reversed(s: Column) -> Column:
    return segment(s.end, s.start)


def segment_length(s: Column) -> Column:
    return distance(s.start, s.end)


def segment_degenerate(s: Column, eps: float) -> Column:
    return distance_squared(s.start, s.end) <= eps * eps


def segment_gap_squared(a: Column, b: Column) -> Column:
    """Squared distance of two segments: 0 where they cross, else that of an end to the other segment."""
    from planewright.functions.geometry import closest_on_segment, segments_meet

    ends = [distance_squared(closest_on_segment(s, p), p) for s, p in ((a, b.start), (a, b.end), (b, a.start), (b, a.end))]
    return F.when(segments_meet(a, b), F.lit(0.0)).otherwise(F.least(*ends))
