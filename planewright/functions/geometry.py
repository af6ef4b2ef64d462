"""Planar geometry as Column expressions over structs; everything stays inside Catalyst.

Points and vectors are struct<x, y>, segments struct<start, end>, boxes struct<min_x, min_y, max_x,
max_y>, circles struct<center, radius>, affine maps struct<a, b, c, d, tx, ty>. Where a result may
not exist it is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def point(x: Column | float, y: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).alias("x"), lit(y).alias("y"))


def segment(a: Column, b: Column) -> Column:
    return F.struct(a.alias("start"), b.alias("end"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where naming it by a column of its own isn't possible."""
    return F.transform(F.array(value), body)[0]


# ------------------------------------------------------------------ vectors and points


def add(a: Column, b: Column) -> Column:
    return point(a.x + b.x, a.y + b.y)


def sub(a: Column, b: Column) -> Column:
    return point(a.x - b.x, a.y - b.y)


def scale(a: Column, k: Column | float) -> Column:
    return point(a.x * k, a.y * k)


def dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y


def cross(a: Column, b: Column) -> Column:
    return a.x * b.y - a.y * b.x


def distance_squared(a: Column, b: Column) -> Column:
    return (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_squared(a, b))


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit vector, null for a zero vector."""
    return F.when(magnitude(a) > EPS, scale(a, 1 / F.nullif(magnitude(a), F.lit(0.0))))


def perpendicular(a: Column) -> Column:
    return point(-a.y, a.x)


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    return point(a.x + (b.x - a.x) * t, a.y + (b.y - a.y) * t)


def midpoint(a: Column, b: Column) -> Column:
    return point((a.x + b.x) / 2, (a.y + b.y) / 2)


def rotated(a: Column, angle: Column | float) -> Column:
    angle = angle if isinstance(angle, Column) else F.lit(float(angle))
    return point(a.x * F.cos(angle) - a.y * F.sin(angle), a.x * F.sin(angle) + a.y * F.cos(angle))


def angle_between(a: Column, b: Column) -> Column:
    """Signed angle from a to b."""
    return F.atan2(cross(a, b), dot(a, b))


# ------------------------------------------------------------------ predicates


def turn(a: Column, b: Column, c: Column) -> Column:
    return (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)


def orientation(a: Column, b: Column, c: Column, eps: float = 0.0) -> Column:
    t = turn(a, b, c)
    return F.when(t > eps, "ccw").when(t < -eps, "cw").otherwise("collinear")


def segment_parameter(s: Column, p: Column) -> Column:
    """Where on the segment the closest point to p lies, 0 to 1; 0 on a segment without length."""
    d = sub(s.end, s.start)
    t = F.try_divide(dot(sub(p, s.start), d), dot(d, d))
    return F.when(dot(d, d) == 0, 0.0).when(t.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def closest_on_segment(s: Column, p: Column) -> Column:
    return lerp(s.start, s.end, segment_parameter(s, p))


def segment_point_distance(s: Column, p: Column) -> Column:
    return distance(closest_on_segment(s, p), p)


def on_segment(p: Column, s: Column, eps: float) -> Column:
    return distance_squared(closest_on_segment(s, p), p) <= eps * eps


def line_crossing(s: Column, o: Column) -> Column:
    """Parameters (t, u) where the lines through two segments cross, null if they are parallel."""
    d, e, w = sub(s.end, s.start), sub(o.end, o.start), sub(o.start, s.start)
    k = cross(d, e)
    return F.when(F.abs(k) > EPS, F.struct(F.try_divide(cross(w, e), k).alias("t"), F.try_divide(cross(w, d), k).alias("u")))


def segment_crossing(s: Column, o: Column, eps: float = 0.0) -> Column:
    """Crossing point of two segments (ends included), null if there is none or they are parallel."""
    c = line_crossing(s, o)
    inside = c.t.between(-eps, 1 + eps) & c.u.between(-eps, 1 + eps)
    return F.when(inside, lerp(s.start, s.end, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.t))))


def segments_meet(s: Column, o: Column) -> Column:
    """Whether two closed segments share a point, parallel ones included."""
    opposite = (turn(s.start, s.end, o.start) * turn(s.start, s.end, o.end) < 0) & (turn(o.start, o.end, s.start) * turn(o.start, o.end, s.end) < 0)
    touch = on_segment(o.start, s, 0.0) | on_segment(o.end, s, 0.0) | on_segment(s.start, o, 0.0) | on_segment(s.end, o, 0.0)
    return opposite | touch


def ray_hit(origin: Column, direction: Column, s: Column) -> Column:
    """Distance parameter along the ray at which it meets a segment, null if it doesn't."""
    c = line_crossing(segment(origin, add(origin, direction)), s)
    return F.when((c.t >= 0) & c.u.between(0, 1), c.t)


# ------------------------------------------------------------------ boxes


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))


def box_of(points: Column | str = "p") -> Column:
    """Aggregate: the box of a group's points; partial sums are combined before the shuffle."""
    p = F.col(points) if isinstance(points, str) else points
    return box(F.min(p.x), F.min(p.y), F.max(p.x), F.max(p.y))


def box_area(b: Column) -> Column:
    return (b.max_x - b.min_x) * (b.max_y - b.min_y)


def box_union(a: Column, b: Column) -> Column:
    return box(F.least(a.min_x, b.min_x), F.least(a.min_y, b.min_y), F.greatest(a.max_x, b.max_x), F.greatest(a.max_y, b.max_y))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a.min_x <= b.max_x) & (b.min_x <= a.max_x) & (a.min_y <= b.max_y) & (b.min_y <= a.max_y)


def box_intersection(a: Column, b: Column) -> Column:
    shared = box(F.greatest(a.min_x, b.min_x), F.greatest(a.min_y, b.min_y), F.least(a.max_x, b.max_x), F.least(a.max_y, b.max_y))
    return F.when(boxes_meet(a, b), shared)


def box_contains(b: Column, p: Column) -> Column:
    return p.x.between(b.min_x, b.max_x) & p.y.between(b.min_y, b.max_y)


def box_distance(b: Column, p: Column) -> Column:
    dx = F.greatest(b.min_x - p.x, F.lit(0.0), p.x - b.max_x)
    dy = F.greatest(b.min_y - p.y, F.lit(0.0), p.y - b.max_y)
    return F.sqrt(dx * dx + dy * dy)


# ------------------------------------------------------------------ circles and ellipses


def circle(center: Column, radius: Column) -> Column:
    return F.struct(center.alias("center"), radius.alias("radius"))


def circle_contains(c: Column, p: Column) -> Column:
    return distance(c.center, p) <= c.radius


def circle_distance(c: Column, p: Column) -> Column:
    """Signed: negative inside."""
    return distance(c.center, p) - c.radius


def circles_overlap(a: Column, b: Column) -> Column:
    return distance(a.center, b.center) <= a.radius + b.radius


def circle_crossings(a: Column, b: Column) -> Column:
    """The two points in which circles cross, as an array (equal at a touch); null if they don't."""
    d = distance(a.center, b.center)
    along = F.try_divide(a.radius * a.radius - b.radius * b.radius + d * d, 2 * d)
    high = F.sqrt(F.greatest(F.lit(0.0), a.radius * a.radius - along * along))
    u = scale(sub(b.center, a.center), F.try_divide(F.lit(1.0), d))
    m, v = add(a.center, scale(u, along)), scale(perpendicular(u), high)
    crossing = (d > EPS) & (d <= a.radius + b.radius) & (d >= F.abs(a.radius - b.radius))
    return F.when(crossing, F.array(add(m, v), sub(m, v)))


def circumcircle(a: Column, b: Column, c: Column) -> Column:
    """Circle through three points, null if they lie on a line."""
    d = 2 * turn(a, b, c)
    bx, by, cx, cy = b.x - a.x, b.y - a.y, c.x - a.x, c.y - a.y
    bb, cc = bx * bx + by * by, cx * cx + cy * cy
    ux, uy = F.try_divide(cy * bb - by * cc, d), F.try_divide(bx * cc - cx * bb, d)
    return F.when(F.abs(d) > EPS, circle(point(a.x + ux, a.y + uy), F.sqrt(ux * ux + uy * uy)))


def ellipse_contains(center: Column, semi_major: Column, semi_minor: Column, rotation: Column, p: Column) -> Column:
    q = rotated(sub(p, center), -rotation)
    u, v = F.try_divide(q.x, semi_major), F.try_divide(q.y, semi_minor)
    return u * u + v * v <= 1


def capsule_contains(s: Column, radius: Column, p: Column) -> Column:
    return segment_point_distance(s, p) <= radius


# ------------------------------------------------------------------ affine maps


def affine(a: Column, b: Column, c: Column, d: Column, tx: Column, ty: Column) -> Column:
    """x' = a x + b y + tx, y' = c x + d y + ty."""
    return F.struct(*(v.alias(n) for n, v in zip(("a", "b", "c", "d", "tx", "ty"), (a, b, c, d, tx, ty), strict=True)))


def affine_apply(m: Column, p: Column) -> Column:
    return point(m.a * p.x + m.b * p.y + m.tx, m.c * p.x + m.d * p.y + m.ty)


def affine_then(m: Column, n: Column) -> Column:
    """The map that applies m, then n."""
    return affine(n.a * m.a + n.b * m.c, n.a * m.b + n.b * m.d, n.c * m.a + n.d * m.c, n.c * m.b + n.d * m.d, n.a * m.tx + n.b * m.ty + n.tx, n.c * m.tx + n.d * m.ty + n.ty)


def affine_inverse(m: Column) -> Column:
    """Null where the map can't be undone."""
    k = F.nullif(m.a * m.d - m.b * m.c, F.lit(0.0))
    return F.when(k.isNotNull(), affine(m.d / k, -m.b / k, -m.c / k, m.a / k, (m.b * m.ty - m.d * m.tx) / k, (m.c * m.tx - m.a * m.ty) / k))


# ------------------------------------------------------------------ curves


def in_circumcircle(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Whether a point lies inside the circle round a triangle of either orientation."""
    u, v, w = sub(a, p), sub(b, p), sub(c, p)
    det = dot(u, u) * cross(v, w) - dot(v, v) * cross(u, w) + dot(w, w) * cross(u, v)
    return det * F.signum(cross(sub(b, a), sub(c, a))) > 0


def triangle_centroid(a: Column, b: Column, c: Column) -> Column:
    return point((a.x + b.x + c.x) / 3, (a.y + b.y + c.y) / 3)


def ring_reversed(r: str) -> Column:
    """The same ring the other way round."""
    return F.reverse(F.col(r))


def bezier(t: Column | float, *p: Column) -> Column:
    """A quadratic or cubic Bezier curve's point, by Bernstein weights."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    u = 1 - t
    w = [u * u, 2 * u * t, t * t] if len(p) == 3 else [u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t]
    total = lambda f: sum((k * q[f] for k, q in zip(w[1:], p[1:], strict=True)), w[0] * p[0][f])
    return point(total("x"), total("y"))


def bezier_derivative(t: Column | float, *p: Column) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    u = 1 - t
    d = [sub(b, a) for a, b in zip(p, p[1:], strict=False)]
    w = [2 * u, 2 * t] if len(p) == 3 else [3 * u * u, 6 * u * t, 3 * t * t]
    total = lambda f: sum((k * q[f] for k, q in zip(w[1:], d[1:], strict=True)), w[0] * d[0][f])
    return point(total("x"), total("y"))


def bezier_split(t: Column | float, *p: Column) -> tuple[list[Column], list[Column]]:
    """Control points of both parts, by repeated interpolation."""
    left, right, row = [p[0]], [p[-1]], list(p)
    while len(row) > 1:
        row = [lerp(a, b, t) for a, b in zip(row, row[1:], strict=False)]
        left.append(row[0])
        right.insert(0, row[-1])
    return left, right


def arc_point(center: Column, radius: Column, start: Column, end: Column, t: Column | float) -> Column:
    angle = start + (end - start) * t
    return point(center.x + radius * F.cos(angle), center.y + radius * F.sin(angle))


def hermite(t: Column, p0: Column, m0: Column, p1: Column, m1: Column) -> Column:
    t2, t3 = t * t, t * t * t
    w = (2 * t3 - 3 * t2 + 1, t3 - 2 * t2 + t, -2 * t3 + 3 * t2, t3 - t2)
    total = lambda f: w[0] * p0[f] + w[1] * m0[f] + w[2] * p1[f] + w[3] * m1[f]
    return point(total("x"), total("y"))


def catmull_rom(t: Column, p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """The uniform spline between p1 and p2."""
    return hermite(t, p1, scale(sub(p2, p0), 0.5), p2, scale(sub(p3, p1), 0.5))


# ------------------------------------------------------------------ rings and polylines (array<struct<x, y>>)


def ring_area(ring: Column | str, signed: bool = False) -> Column:
    """Shoelace area of an open ring; 0 below three vertices."""
    r = ring if isinstance(ring, str) else "ring"
    total = F.expr(f"aggregate(sequence(0, size({r}) - 1), 0D, (s, i) -> s + {r}[i].x * {r}[(i + 1) % size({r})].y - {r}[(i + 1) % size({r})].x * {r}[i].y) / 2")
    return F.when(F.size(r) < 3, 0.0).otherwise(total if signed else F.abs(total))


def ring_perimeter(r: str, closed: bool = True) -> Column:
    last = "size({0}) - 1" if closed else "size({0}) - 2"
    step = f"sqrt(power({r}[(i + 1) % size({r})].x - {r}[i].x, 2) + power({r}[(i + 1) % size({r})].y - {r}[i].y, 2))"
    return F.when(F.size(r) < 2, 0.0).otherwise(F.expr(f"aggregate(sequence(0, {last.format(r)}), 0D, (s, i) -> s + {step})"))


def ring_centroid(r: str) -> Column:
    """Area centroid; null where the area vanishes."""
    k = f"({r}[i].x * {r}[(i + 1) % size({r})].y - {r}[(i + 1) % size({r})].x * {r}[i].y)"
    total = lambda f: F.expr(f"aggregate(sequence(0, size({r}) - 1), 0D, (s, i) -> s + ({r}[i].{f} + {r}[(i + 1) % size({r})].{f}) * {k})")
    area = F.nullif(ring_area(r, signed=True), F.lit(0.0))
    return F.when(area.isNotNull(), point(total("x") / (6 * area), total("y") / (6 * area)))


def ring_contains(r: str, p: str) -> Column:
    """Even-odd rule with half-open edges."""
    a, b = f"{r}[i]", f"{r}[(i + 1) % size({r})]"
    crossed = f"({a}.y > {p}.y) <> ({b}.y > {p}.y) AND {p}.x < ({b}.x - {a}.x) * ({p}.y - {a}.y) / ({b}.y - {a}.y) + {a}.x"
    return F.when(F.size(r) < 3, F.lit(False)).otherwise(F.expr(f"size(filter(sequence(0, size({r}) - 1), i -> {crossed})) % 2 = 1"))


def ring_is_convex(r: str) -> Column:
    """All turns of one sign; true below three vertices."""
    t = f"transform(sequence(0, size({r}) - 1), i -> ({r}[(i + 1) % size({r})].x - {r}[i].x) * ({r}[(i + 2) % size({r})].y - {r}[(i + 1) % size({r})].y) - ({r}[(i + 1) % size({r})].y - {r}[i].y) * ({r}[(i + 2) % size({r})].x - {r}[(i + 1) % size({r})].x))"
    return F.when(F.size(r) < 3, F.lit(True)).otherwise(F.expr(f"NOT (exists({t}, t -> t > {EPS}) AND exists({t}, t -> t < -{EPS}))"))


def line_from_rows(order: str, x: str, y: str) -> Column:
    """Aggregate: a group's points as an array in ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y"))))
    return F.transform(rows, lambda r: F.struct(r.x.alias("x"), r.y.alias("y")))


# ------------------------------------------------------------------ low-discrepancy sequences


def radical_inverse(i: Column | str, base: int) -> Column:
    """Van der Corput's sequence: the digits of i mirrored behind the point."""
    name = i if isinstance(i, str) else "i"
    digits = f"sequence(0, cast(ceil(log({base}, {name} + 1)) AS int))"
    return F.expr(f"aggregate({digits}, 0D, (s, k) -> s + (cast(floor({name} / power({base}D, k)) AS bigint) % {base}) / power({base}D, k + 1))")


def radical_inverse_mirrored(i: str, base: int) -> Column:
    """The same with the digits above 2 mirrored (digit d is base - 1 - d), leading zeros left out."""
    if base == 2:
        return radical_inverse(i, 2)
    digit = f"(cast(floor({i} / power({base}D, k)) AS bigint) % {base})"
    return F.expr(f"aggregate(filter(sequence(0, cast(ceil(log({base}, {i} + 1)) AS int)), k -> power({base}D, k) <= {i}), 0D, (s, k) -> s + (({base} - 1 - {digit}) % {base}) / power({base}D, k + 1))")


#: Bases of the Halton sequence's dimensions.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)


def halton(i: str, dimensions: int) -> Column:
    """A point of the sequence in up to ten dimensions, as an array."""
    return F.array(*(radical_inverse(i, b) for b in PRIMES[:dimensions]))


def in_rect(p: Column, b: Column) -> Column:
    """A point of the unit square moved into a box."""
    return point(b.min_x + p.x * (b.max_x - b.min_x), b.min_y + p.y * (b.max_y - b.min_y))


#: Of each Sobol dimension after the first: coefficients that the recurrence of its direction numbers takes (of its last values, nearest first), and its first values. Fixed values.
SOBOL = (((2, 1), (1, 3)), ((4, 0, 1), (1, 1, 7)), ((4, 2, 1), (1, 3, 5)))


def sobol_directions(dimension: int, bits: int = 32) -> list[int]:
    """Direction numbers of a dimension (from 1) in so many bits: powers of two, or the recurrence of a primitive polynomial."""
    if dimension == 1:
        return [1 << (bits - 1 - k) for k in range(bits)]
    factors, first = SOBOL[dimension - 2]
    m = list(first)
    while len(m) < bits:
        new = 0
        for k, f in enumerate(factors, 1):
            new ^= f * m[-k]
        m.append(new & ((2 << len(m)) - 1))
    return [v << (bits - 1 - k) for k, v in enumerate(m)]


def sobol_bits(i: str, dimension: int, bits: int = 32) -> Column:
    """The 32 bits of point i of the sequence in one dimension: direction numbers where i has a one."""
    words = ", ".join(f"{d}L" for d in sobol_directions(dimension, bits))
    return F.expr(f"aggregate(sequence(0, {bits - 1}), 0L, (s, k) -> s ^ if(shiftright({i}, k) % 2 = 1, array({words})[k], 0L))")


def sobol(i: str, dimension: int) -> Column:
    """One coordinate of point i."""
    return sobol_bits(i, dimension) / F.lit(float(1 << 32))


def sobol_point(i: str, dimensions: int) -> Column:
    """A point of the sequence in up to four dimensions, as an array."""
    return F.array(*(sobol(i, d + 1) for d in range(dimensions)))


def sobol_scrambled(i: str, seed: int) -> Column:
    """A planar point whose coordinates' bits are turned where the seed's lower and upper 32 bits are one."""
    x, y = ((sobol_bits(i, d + 1).bitwiseXOR(F.lit((seed >> (32 * d)) & 0xFFFFFFFF).cast("long"))) / F.lit(float(1 << 32)) for d in (0, 1))
    return point(x, y)


def ring_distance(r: str, p: str) -> Column:
    """Signed distance to a ring's outline, negative inside."""
    a, b = f"{r}[i]", f"{r}[(i + 1) % size({r})]"
    d2 = f"(power({b}.x - {a}.x, 2) + power({b}.y - {a}.y, 2))"
    t = f"coalesce(greatest(0D, least(1D, try_divide(({p}.x - {a}.x) * ({b}.x - {a}.x) + ({p}.y - {a}.y) * ({b}.y - {a}.y), {d2}))), 0D)"
    near = F.expr(f"array_min(transform(sequence(0, size({r}) - 1), i -> sqrt(power({a}.x + ({b}.x - {a}.x) * {t} - {p}.x, 2) + power({a}.y + ({b}.y - {a}.y) * {t} - {p}.y, 2))))")
    return F.when(F.size(r) > 2, F.when(ring_contains(r, p), -near).otherwise(near))


def self_crossings(r: str) -> Column:
    """Number of pairs of a line's segments that cross in their insides."""
    turn = lambda a, b, c: f"(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"
    a, b, c, d = (f"{r}[{k}]" for k in ("i", "i + 1", "j", "j + 1"))
    crossed = f"{turn(a, b, c)} * {turn(a, b, d)} < 0 AND {turn(c, d, a)} * {turn(c, d, b)} < 0"
    inner = f"size(filter(if(i + 2 <= size({r}) - 2, sequence(i + 2, size({r}) - 2), array()), j -> {crossed}))"
    return F.when(F.size(r) < 4, F.lit(0)).otherwise(F.expr(f"aggregate(sequence(0, size({r}) - 4), 0, (s, i) -> s + {inner})"))


def rational_quadratic(t: Column, weight: Column | float, *p: Column) -> Column:
    """A conic: a quadratic curve whose middle point has a weight."""
    u = 1 - t
    w = (u * u, 2 * u * t * weight, t * t)
    total = lambda f: (w[0] * p[0][f] + w[1] * p[1][f] + w[2] * p[2][f]) / (w[0] + w[1] + w[2])
    return point(total("x"), total("y"))


def uniform_bspline(t: Column, p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """One span of a uniform cubic B-spline."""
    t2, t3 = t * t, t * t * t
    w = ((1 - 3 * t + 3 * t2 - t3) / 6, (4 - 6 * t2 + 3 * t3) / 6, (1 + 3 * t + 3 * t2 - 3 * t3) / 6, t3 / 6)
    total = lambda f: w[0] * p0[f] + w[1] * p1[f] + w[2] * p2[f] + w[3] * p3[f]
    return point(total("x"), total("y"))


def curvature(t: Column, *p: Column) -> Column:
    """Signed curvature of a cubic Bezier curve, null where it stands still."""
    d = bezier_derivative(t, *p)
    q = [sub(b, a) for a, b in zip(p, p[1:], strict=False)]
    e = [sub(b, a) for a, b in zip(q, q[1:], strict=False)]
    u = 1 - t
    dd = point(6 * (u * e[0].x + t * e[1].x), 6 * (u * e[0].y + t * e[1].y))
    speed = F.nullif(F.sqrt(dot(d, d)), F.lit(0.0))
    return cross(d, dd) / (speed * speed * speed)
