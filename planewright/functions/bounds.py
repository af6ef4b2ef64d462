"""Boxes, capsules (struct<segment, radius>) and turned boxes (struct<center, half_width, half_height, angle>)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from planewright.functions import lines as L
from planewright.functions.geometry import add, box, distance, normalized, point, rotated, scale, segment, segment_point_distance, sub


def _v(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def box_of_corners(a: Column, b: Column) -> Column:
    return box(F.least(a.x, b.x), F.least(a.y, b.y), F.greatest(a.x, b.x), F.greatest(a.y, b.y))


def box_of_point(p: Column) -> Column:
    return box(p.x, p.y, p.x, p.y)


def box_of_line(line: Column) -> Column:
    """The box of an array of points; null for none."""
    xs, ys = F.transform(line, lambda p: p.x), F.transform(line, lambda p: p.y)
    return F.when(F.size(line) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def box_width(b: Column) -> Column:
    return b.max_x - b.min_x


def box_height(b: Column) -> Column:
    return b.max_y - b.min_y


def box_size(b: Column) -> Column:
    return point(box_width(b), box_height(b))


def box_center(b: Column) -> Column:
    return point((b.min_x + b.max_x) / 2, (b.min_y + b.max_y) / 2)


def box_with(b: Column, p: Column) -> Column:
    return box(F.least(b.min_x, p.x), F.least(b.min_y, p.y), F.greatest(b.max_x, p.x), F.greatest(b.max_y, p.y))


# ------------------------------------------------------------------ capsules


def capsule(s: Column, radius: Column | float) -> Column:
    return F.struct(s.alias("segment"), _v(radius).alias("radius"))


def capsule_between(a: Column, b: Column, radius: Column | float) -> Column:
    return capsule(segment(a, b), radius)


def capsule_of_circle(center: Column, radius: Column | float) -> Column:
    return capsule(segment(center, center), radius)


def capsule_around(spine: Column, line: Column) -> Column:
    """The capsule on a spine that holds an array of points."""
    return capsule(spine, F.array_max(F.transform(line, lambda p: segment_point_distance(spine, p))))


def capsule_length(c: Column) -> Column:
    return distance(c.segment.start, c.segment.end)


def capsule_total_length(c: Column) -> Column:
    return capsule_length(c) + 2 * c.radius


def capsule_area(c: Column) -> Column:
    return capsule_length(c) * 2 * c.radius + math.pi * c.radius * c.radius


def capsule_center(c: Column) -> Column:
    return scale(add(c.segment.start, c.segment.end), 0.5)


def capsule_signed_distance(c: Column, p: Column) -> Column:
    return segment_point_distance(c.segment, p) - c.radius


def capsule_distance(c: Column, p: Column) -> Column:
    return F.greatest(F.lit(0.0), capsule_signed_distance(c, p))


def capsules_meet(a: Column, b: Column) -> Column:
    r = a.radius + b.radius
    return L.segment_gap_squared(a.segment, b.segment) <= r * r


def capsule_meets_circle(c: Column, center: Column, radius: Column) -> Column:
    return segment_point_distance(c.segment, center) <= c.radius + radius


def capsule_axis(c: Column) -> Column:
    """Unit direction of the spine; (1, 0) for one without length."""
    return F.coalesce(normalized(sub(c.segment.end, c.segment.start)), point(1, 0))


def capsule_grown(c: Column, by: Column | float) -> Column:
    return capsule(c.segment, c.radius + by)


# ------------------------------------------------------------------ turned boxes


def turned_box(center: Column, half_width: Column | float, half_height: Column | float, angle: Column | float = 0.0) -> Column:
    return F.struct(center.alias("center"), _v(half_width).alias("half_width"), _v(half_height).alias("half_height"), _v(angle).alias("angle"))


def turned_area(o: Column) -> Column:
    return 4 * o.half_width * o.half_height


def turned_axis_x(o: Column) -> Column:
    return point(F.cos(o.angle), F.sin(o.angle))


def turned_axis_y(o: Column) -> Column:
    return point(-F.sin(o.angle), F.cos(o.angle))


def turned_corners(o: Column) -> Column:
    """Four corners, counter-clockwise from the lower left one."""
    return F.array(*(add(o.center, rotated(point(i * o.half_width, j * o.half_height), o.angle)) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def _local(o: Column, p: Column) -> Column:
    return rotated(sub(p, o.center), -o.angle)


def turned_contains(o: Column, p: Column) -> Column:
    q = _local(o, p)
    return (F.abs(q.x) <= o.half_width) & (F.abs(q.y) <= o.half_height)


def turned_distance_squared(o: Column, p: Column) -> Column:
    q = _local(o, p)
    dx, dy = F.greatest(F.lit(0.0), F.abs(q.x) - o.half_width), F.greatest(F.lit(0.0), F.abs(q.y) - o.half_height)
    return dx * dx + dy * dy


def turned_distance(o: Column, p: Column) -> Column:
    return F.sqrt(turned_distance_squared(o, p))


def turned_meet(a: Column, b: Column) -> Column:
    """Separating axes: two turned boxes meet unless one of their four axes parts them."""

    def reach(o: Column, axis: Column) -> Column:
        u, v = turned_axis_x(o), turned_axis_y(o)
        return o.half_width * F.abs(u.x * axis.x + u.y * axis.y) + o.half_height * F.abs(v.x * axis.x + v.y * axis.y)

    w = sub(b.center, a.center)
    apart = F.lit(False)
    for axis in (turned_axis_x(a), turned_axis_y(a), turned_axis_x(b), turned_axis_y(b)):
        apart = apart | (F.abs(w.x * axis.x + w.y * axis.y) > reach(a, axis) + reach(b, axis))
    return ~apart
