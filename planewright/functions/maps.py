"""Constructors and questions of affine maps struct<a, b, c, d, tx, ty>; applying and composing them is in ``geometry``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planewright.functions.geometry import EPS, affine, affine_apply, affine_then, normalized, point

FIELDS = ("a", "b", "c", "d", "tx", "ty")


def _v(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _map(*values: Column | float) -> Column:
    return affine(*map(_v, values))


def identity() -> Column:
    return _map(1, 0, 0, 1, 0, 0)


def translation(tx: Column | float, ty: Column | float) -> Column:
    return _map(1, 0, 0, 1, tx, ty)


def translation_by(v: Column) -> Column:
    return translation(v.x, v.y)


def rotation(angle: Column | float) -> Column:
    c, s = F.cos(_v(angle)), F.sin(_v(angle))
    return _map(c, -s, s, c, 0, 0)


def scaling(sx: Column | float, sy: Column | float | None = None) -> Column:
    return _map(sx, 0, 0, sx if sy is None else sy, 0, 0)


def shear_x(k: Column | float) -> Column:
    return _map(1, k, 0, 1, 0, 0)


def shear_y(k: Column | float) -> Column:
    return _map(1, 0, k, 1, 0, 0)


def reflect_x() -> Column:
    """In the x axis."""
    return _map(1, 0, 0, -1, 0, 0)


def reflect_y() -> Column:
    return _map(-1, 0, 0, 1, 0, 0)


def reflect_origin() -> Column:
    return _map(-1, 0, 0, -1, 0, 0)


def reflect_line(direction: Column) -> Column:
    """In the line through the origin; the identity without a direction."""
    n = normalized(direction)
    return F.when(n.isNull(), identity()).otherwise(_map(2 * n.x * n.x - 1, 2 * n.x * n.y, 2 * n.x * n.y, 2 * n.y * n.y - 1, 0, 0))


def around(m: Column, center: Column) -> Column:
    """A map about a centre instead of the origin: rotations and scalings around a point."""
    return affine_then(affine_then(translation(-center.x, -center.y), m), translation_by(center))


def apply_vector(m: Column, v: Column) -> Column:
    return point(m.a * v.x + m.b * v.y, m.c * v.x + m.d * v.y)


def apply_points(m: Column, line: Column) -> Column:
    """A map over an array of points."""
    return F.transform(line, lambda p: affine_apply(m, p))


def then_translate(m: Column, v: Column) -> Column:
    return affine_then(m, translation_by(v))


def then_rotate(m: Column, angle: Column | float) -> Column:
    return affine_then(m, rotation(angle))


def then_scale(m: Column, k: Column | float) -> Column:
    return affine_then(m, scaling(k))


def determinant(m: Column) -> Column:
    return m.a * m.d - m.b * m.c


def keeps_orientation(m: Column) -> Column:
    return determinant(m) > 0


def invertible(m: Column) -> Column:
    return F.abs(determinant(m)) > EPS


def translation_part(m: Column) -> Column:
    return point(m.tx, m.ty)


def is_translation(m: Column, eps: float) -> Column:
    return (F.abs(m.a - 1) < eps) & (F.abs(m.b) < eps) & (F.abs(m.c) < eps) & (F.abs(m.d - 1) < eps)


def is_identity(m: Column, eps: float) -> Column:
    return is_translation(m, eps) & (F.abs(m.tx) < eps) & (F.abs(m.ty) < eps)


def is_rigid(m: Column, eps: float) -> Column:
    """Lengths stay: columns of length one at right angles."""
    one = lambda v: F.abs(v - 1) < eps
    return one(m.a * m.a + m.c * m.c) & one(m.b * m.b + m.d * m.d) & (F.abs(m.a * m.b + m.c * m.d) < eps)


def is_similarity(m: Column, eps: float) -> Column:
    """A rotation with a scale, mirrored or not."""
    near = lambda u, v: F.abs(u - v) < eps
    return near(m.a, m.d) & near(m.b, -m.c) | near(m.a, -m.d) & near(m.b, m.c)


def rotation_angle(m: Column) -> Column:
    return F.atan2(m.c, m.a)


def scale_factors(m: Column) -> Column:
    return F.struct(F.sqrt(m.a * m.a + m.c * m.c).alias("sx"), F.sqrt(m.b * m.b + m.d * m.d).alias("sy"))


def to_matrix(m: Column) -> Column:
    """The nine numbers of the matrix, row by row."""
    return F.array(m.a, m.b, m.tx, m.c, m.d, m.ty, F.lit(0.0), F.lit(0.0), F.lit(1.0))


def from_matrix(v: Column) -> Column:
    return _map(v[0], v[1], v[3], v[4], v[2], v[5])


def between(m: Column, n: Column, t: Column | float) -> Column:
    return _map(*(m[k] * (1 - _v(t)) + n[k] * _v(t) for k in FIELDS))
