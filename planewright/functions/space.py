"""Points, vectors and segments in three dimensions, as struct<x, y, z> and struct<start, end>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planewright.functions.geometry import EPS, segment

AXES = ("x", "y", "z")


def vec(x: Column | float, y: Column | float, z: Column | float) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(float(v))).alias(n) for n, v in zip(AXES, (x, y, z), strict=True)))


ZERO, UNIT_X, UNIT_Y, UNIT_Z = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))


def add(a: Column, b: Column) -> Column:
    return vec(a.x + b.x, a.y + b.y, a.z + b.z)


def sub(a: Column, b: Column) -> Column:
    return vec(a.x - b.x, a.y - b.y, a.z - b.z)


def scale(a: Column, k: Column | float) -> Column:
    return vec(a.x * k, a.y * k, a.z * k)


def dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Column, b: Column) -> Column:
    return vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit vector, null for a zero vector."""
    return F.when(magnitude(a) > EPS, scale(a, 1 / F.nullif(magnitude(a), F.lit(0.0))))


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    return add(a, scale(sub(b, a), t))


def midpoint(a: Column, b: Column) -> Column:
    return scale(add(a, b), 0.5)


def distance_squared(a: Column, b: Column) -> Column:
    return dot(sub(a, b), sub(a, b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_squared(a, b))


def direction(s: Column) -> Column:
    return sub(s.end, s.start)


def segment_length(s: Column) -> Column:
    return distance(s.start, s.end)


def segment_at(s: Column, t: Column | float) -> Column:
    return lerp(s.start, s.end, t)


def segment_reversed(s: Column) -> Column:
    return segment(s.end, s.start)


def segment_degenerate(s: Column, eps: float) -> Column:
    return distance_squared(s.start, s.end) <= eps * eps


def segment_parameter(s: Column, p: Column) -> Column:
    """Where on the segment the closest point to p lies, 0 to 1; 0 on a segment without length."""
    d = direction(s)
    t = F.try_divide(dot(sub(p, s.start), d), dot(d, d))
    return F.when(dot(d, d) == 0, 0.0).when(t.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def closest_on_segment(s: Column, p: Column) -> Column:
    return segment_at(s, segment_parameter(s, p))


def segment_distance(s: Column, p: Column) -> Column:
    return distance(closest_on_segment(s, p), p)
