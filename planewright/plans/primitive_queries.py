"""Lines, rays, segments, circles, ellipses, maps, boxes, capsules and three-dimensional primitives over the embeddings' points.

Each query measures one family of expressions for every row; its twin states each measure anew in
SQL. Numbers x are compared as x / (1 + |x|) to six digits, so that rows with large results (nearly
parallel lines, say) take part too. Rows without a result have null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from planewright.functions import bounds as B
from planewright.functions import conics as C
from planewright.functions import geometry as G
from planewright.functions import lines as L
from planewright.functions import maps as M
from planewright.functions import space as V
from planewright.operators.tables import SQL, points, spread
from planewright.plans.registry import query

ABCD = f"WITH {SQL}, z AS (SELECT id, e[1] AS a1, e[2] AS a2, e[3] AS b1, e[4] AS b2, e[5] AS c1, e[6] AS c2, e[7] AS d1, e[8] AS d2 FROM pts)"


def squashed(x: Column) -> Column:
    return F.round(x / (1 + F.abs(x)), 6) + F.lit(0.0)


def family(name: str, sql: dict[str, str], frames: str = "", source: str = "z", heavy: bool = False):
    """Register a query of measures by name; names with n_ and is_ are counts and truth values, all others numbers. ``heavy`` ones have their rows spread."""
    text = ", ".join(f"{x} AS {k}" if k[:2] == "n_" or k[:3] == "is_" else f"round(({x}) / (1 + abs({x})), 6) + 0.0 AS {k}" for k, x in sql.items())

    def add(measures: Callable[..., dict[str, Column]]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            e = F.col("e")
            rows = points(spark, sf_dir).select("id", "e")
            held = [(spread(rows) if heavy else rows).select("id", *(G.point(e[2 * k], e[2 * k + 1]).alias(n) for k, n in enumerate("abcd")))]

            def keep(value: Column, name: str = "") -> Column:
                """A column of its own, so that what follows names it instead of repeating it."""
                held[0] = held[0].withColumn(n := name or f"v{len(held[0].columns)}", value)
                return F.col(n)

            values = measures(keep, *map(F.col, "abcd"))
            out = held[0].select("id", *(v.alias(k) for k, v in values.items()))
            number = {f.name for f in out.schema if isinstance(f.dataType, DoubleType)}
            return out.select(*(squashed(F.col(n)).alias(n) if n in number else F.col(n) for n in out.columns))

        run.__name__, run.__doc__ = name, measures.__doc__
        query(name, f"{ABCD}{frames} SELECT id, {text} FROM {source}")(run)
        return measures

    return add


def _d2(p: str, a: str, b: str) -> str:
    """SQL: squared distance of point p to the segment from a to b, all named by a letter."""
    t = f"greatest(0.0, least(1.0, (({p}1-{a}1)*({b}1-{a}1)+({p}2-{a}2)*({b}2-{a}2))/(({b}1-{a}1)**2+({b}2-{a}2)**2)))"
    return f"(({a}1+({b}1-{a}1)*{t}-{p}1)**2+({a}2+({b}2-{a}2)*{t}-{p}2)**2)"


@family("vector_ops", {
    "sum_x": "a1+b1", "sum_y": "a2+b2", "difference_y": "a2-b2", "scaled_x": "3*a1", "square": "a1**2+a2**2", "length": "sqrt(a1**2+a2**2)", "unit_x": "a1/sqrt(a1**2+a2**2)",
    "unit_y": "a2/sqrt(a1**2+a2**2)", "left_x": "-a2", "left_y": "a1", "gap_square": "(a1-b1)**2+(a2-b2)**2", "lerp_y": "a2*0.75+b2*0.25", "mid_y": "(a2+b2)/2", "zero": "0.0::DOUBLE", "axes": "a1-a2",
})
def _(keep, a, b, c, d):
    x = G.point(1, 0), G.point(0, 1)
    return {"sum_x": G.add(a, b).x, "sum_y": G.add(a, b).y, "difference_y": G.sub(a, b).y, "scaled_x": G.scale(a, 3.0).x, "square": G.dot(a, a), "length": G.magnitude(a), "unit_x": G.normalized(a).x,
            "unit_y": G.normalized(a).y, "left_x": G.perpendicular(a).x, "left_y": G.perpendicular(a).y, "gap_square": G.distance_squared(a, b), "lerp_y": G.lerp(a, b, 0.25).y, "mid_y": G.midpoint(a, b).y,
            "zero": G.magnitude(G.point(0, 0)), "axes": G.dot(a, x[0]) - G.dot(a, x[1])}


_K = "((b1-a1)*(d2-c2)-(b2-a2)*(d1-c1))"
_CROSS = f"((b1-a1)*(c2-a2)-(b2-a2)*(c1-a1)) * ((b1-a1)*(d2-a2)-(b2-a2)*(d1-a1)) < 0 AND ((d1-c1)*(a2-c2)-(d2-c2)*(a1-c1)) * ((d1-c1)*(b2-c2)-(d2-c2)*(b1-c1)) < 0"


@family("segment_ops", {
    "direction_x": "b1-a1", "length": "sqrt((b1-a1)**2+(b2-a2)**2)", "square": "(b1-a1)**2+(b2-a2)**2", "mid_x": "(a1+b1)/2", "at_y": "a2+0.3*(b2-a2)", "back_x": "b1", "gap_square": _d2("c", "a", "b"),
    "is_degenerate": "(b1-a1)**2+(b2-a2)**2 <= 0.04", "is_on": f"{_d2('c', 'a', 'b')} <= 0.01", "is_meeting": _CROSS,
    "cross_x": f"CASE WHEN {_CROSS} THEN a1+(b1-a1)*((c1-a1)*(d2-c2)-(c2-a2)*(d1-c1))/{_K} END", "ray_t": f"CASE WHEN ((c1-a1)*(b2-a2)-(c2-a2)*(b1-a1))/{_K} BETWEEN 0 AND 1 AND ((c1-a1)*(d2-c2)-(c2-a2)*(d1-c1))/{_K} >= 0 THEN ((c1-a1)*(d2-c2)-(c2-a2)*(d1-c1))/{_K} END",
})
def _(keep, a, b, c, d):
    s, o = keep(G.segment(a, b)), keep(G.segment(c, d))
    return {"direction_x": G.sub(s.end, s.start).x, "length": L.segment_length(s), "square": G.distance_squared(s.start, s.end), "mid_x": G.midpoint(s.start, s.end).x, "at_y": G.lerp(s.start, s.end, 0.3).y,
            "back_x": L.segment_reversed(s).start.x, "gap_square": G.distance_squared(G.closest_on_segment(s, c), c), "is_degenerate": L.segment_degenerate(s, 0.2), "is_on": G.on_segment(c, s, 0.1),
            "is_meeting": G.segments_meet(s, o), "cross_x": G.segment_crossing(s, o).x, "ray_t": G.ray_hit(a, G.sub(b, a), o)}


_LEN = "sqrt(b1**2+b2**2)"
_LK = "(b1*d2-b2*d1)"
_LT, _LU = f"(((c1-a1)*d2-(c2-a2)*d1)/{_LK})", f"(((c1-a1)*b2-(c2-a2)*b1)/{_LK})"
_ST, _SU = "(((c1-a1)*(d2-c2)-(c2-a2)*(d1-c1))/(b1*(d2-c2)-b2*(d1-c1)))", "(((c1-a1)*b2-(c2-a2)*b1)/(b1*(d2-c2)-b2*(d1-c1)))"
_PT = "((c1-a1)*b1+(c2-a2)*b2)/(b1**2+b2**2)"


@family("line_ops", {
    "a": f"-b2/{_LEN}", "b": f"b1/{_LEN}", "c": f"(b2*a1-b1*a2)/{_LEN}", "normal_x": "-b2", "unit_normal_y": f"b1/{_LEN}", "unit_y": f"b2/{_LEN}", "at_x": "a1+0.7*b1", "t": _PT, "near_x": f"a1+b1*{_PT}", "near_y": f"a2+b2*{_PT}",
    "signed": f"(b1*(c2-a2)-b2*(c1-a1))/{_LEN}", "is_on": f"abs(b1*(c2-a2)-b2*(c1-a1))/{_LEN} <= 0.05", "mirror_x": f"2*(a1+b1*{_PT})-c1", "mirror_y": f"2*(a2+b2*{_PT})-c2", "cross_x": f"a1+b1*{_LT}", "cross_t": _LT, "cross_u": _LU,
    "ray_t": f"CASE WHEN {_LU} >= 0 THEN {_LT} END", "segment_t": f"CASE WHEN {_SU} BETWEEN 0 AND 1 THEN {_ST} END", "angle": f"acos(least(1.0, abs(b1*d1+b2*d2)/({_LEN}*sqrt(d1**2+d2**2))))", "is_parallel": "false", "is_self_parallel": "true", "is_square": "true",
    "beside_x": f"a1-0.5*b2/{_LEN}", "moved_y": "a2+c2", "turned_x": "b1*cos(0.7)-b2*sin(0.7)", "around_x": "c1+(a1-c1)*cos(0.7)-(a2-c2)*sin(0.7)", "around_y": "c2+(a1-c1)*sin(0.7)+(a2-c2)*cos(0.7)", "upright_x": "c1-b2*2",
    "level": "c2-0.3", "plumb": "c1-0.4", "implicit_gap": "abs(b1*c1+b2*c2+d1)/sqrt(b1**2+b2**2)", "through_y": "c2-a2",
})
def _(keep, a, b, c, d):
    o, p = keep(L.line(a, b)), keep(L.line(c, d))
    n, near, image, cross = keep(L.implicit(o)), keep(L.project(o, c)), keep(L.reflected(o, c)), keep(L.line_line(o, p))
    return {"a": n.a, "b": n.b, "c": n.c, "normal_x": L.line_normal(o).x, "unit_normal_y": G.normalized(L.line_normal(o)).y, "unit_y": G.normalized(o.direction).y, "at_x": L.at(o, 0.7).x, "t": near.t, "near_x": near.p.x,
            "near_y": near.p.y, "signed": L.signed_distance(o, c), "is_on": L.line_contains(o, c, 0.05), "mirror_x": image.x, "mirror_y": image.y, "cross_x": cross.p.x, "cross_t": cross.t,
            "cross_u": cross.u, "ray_t": L.line_ray(o, p).t, "segment_t": L.line_segment(o, G.segment(c, d)).t, "angle": L.angle_to(o, p), "is_parallel": L.parallel(o, p), "is_self_parallel": L.parallel(o, L.moved(o, c)),
            "is_square": L.perpendicular_to(o, L.perpendicular_at(o, c)), "beside_x": L.parallel_at(o, 0.5).origin.x, "moved_y": L.moved(o, c).origin.y, "turned_x": L.turned(o, 0.7).direction.x, "around_x": L.turned_around(o, 0.7, c).origin.x,
            "around_y": L.turned_around(o, 0.7, c).origin.y, "upright_x": L.at(L.perpendicular_at(o, c), 2.0).x, "level": L.signed_distance(L.horizontal(0.3), c), "plumb": -L.signed_distance(L.vertical(0.4), c),
            "implicit_gap": F.abs(L.signed_distance(L.from_implicit(b.x, b.y, d.x), c)), "through_y": L.line_through(a, c).direction.y}


_R = "(abs(d1)+0.1)"
_DISC = f"((2*((a1-c1)*b1+(a2-c2)*b2))**2-4*(b1**2+b2**2)*((a1-c1)**2+(a2-c2)**2-{_R}**2))"
_T1, _T2 = (f"((-2*((a1-c1)*b1+(a2-c2)*b2) {s} sqrt({_DISC}))/(2*(b1**2+b2**2)))" for s in "-+")
_LINE_HITS = f"CASE WHEN {_DISC} < 0 THEN 0 ELSE 2 END"
_EDGES = f""", edge AS (SELECT id, k, b1, b2, c1+0.3*cos(2*pi()*k/6)-a1 AS px, c2+0.3*sin(2*pi()*k/6)-a2 AS py, 0.3*(cos(2*pi()*(k+1)/6)-cos(2*pi()*k/6)) AS sx, 0.3*(sin(2*pi()*(k+1)/6)-sin(2*pi()*k/6)) AS sy FROM z, range(6) r(k)),
 hits AS (SELECT id, count(*) AS n, min(t) AS t FROM (SELECT id, (px*sy-py*sx)/(b1*sy-b2*sx) AS t, (px*b2-py*b1)/(b1*sy-b2*sx) AS u FROM edge) WHERE t >= 0 AND u BETWEEN 0 AND 1 GROUP BY 1), zr AS (SELECT z.*, n, t FROM z LEFT JOIN hits USING (id))"""


@family("ray_ops", {
    "at_y": "a2+0.7*b2", "t": f"greatest(0.0, {_PT})", "near_x": f"a1+b1*greatest(0.0, {_PT})", "gap": f"sqrt((a1+b1*greatest(0.0, {_PT})-c1)**2+(a2+b2*greatest(0.0, {_PT})-c2)**2)", "cross_t": f"CASE WHEN {_LT} >= 0 AND {_LU} >= 0 THEN {_LT} END",
    "segment_t": f"CASE WHEN {_ST} >= 0 AND {_SU} BETWEEN 0 AND 1 THEN {_ST} END", "is_hit": f"{_ST} >= 0 AND {_SU} BETWEEN 0 AND 1", "n_line": _LINE_HITS, "line_t": f"CASE WHEN {_DISC} >= 0 THEN {_T1} END",
    "n_circle": f"CASE WHEN {_DISC} < 0 THEN 0 ELSE ({_T1} >= 0)::INTEGER + ({_T2} >= 0)::INTEGER END", "circle_t": f"CASE WHEN {_DISC} < 0 THEN NULL WHEN {_T1} >= 0 THEN {_T1} WHEN {_T2} >= 0 THEN {_T2} END", "is_circle": f"{_DISC} >= 0 AND {_T2} >= 0",
    "back_x": "-b1", "moved_x": "a1+c1", "turned_y": "b1*sin(0.7)+b2*cos(0.7)", "unit_x": f"b1/{_LEN}", "n_ring": "coalesce(n, 0)", "ring_t": "t",
}, _EDGES, "zr")
def _(keep, a, b, c, d):
    r, q = keep(L.line(a, b)), keep(C.circle_at(c.x, c.y, F.abs(d.x) + 0.1))
    ring = keep(L.ray_ring(r, keep(C.circle_ring(C.circle_at(c.x, c.y, 0.3), 6))))
    s, near, on_line, ahead = keep(L.ray_segment(r, G.segment(c, d))), keep(L.ray_project(r, c)), keep(L.line_circle(r, q)), keep(L.ray_circle(r, q))
    return {"at_y": L.at(r, 0.7).y, "t": near.t, "near_x": near.p.x, "gap": L.ray_distance(r, c), "cross_t": L.ray_ray(r, L.line(c, d)).t, "segment_t": s.t, "is_hit": s.isNotNull(), "n_line": F.size(on_line),
            "line_t": F.get(on_line, F.lit(0)).t, "n_circle": F.size(ahead), "circle_t": F.get(ahead, F.lit(0)).t, "is_circle": F.size(ahead) > 0, "back_x": L.reversed_ray(r).direction.x,
            "moved_x": L.moved(r, c).origin.x, "turned_y": L.turned(r, 0.7).direction.y, "unit_x": G.normalized(r.direction).x, "n_ring": F.size(ring).cast("long"), "ring_t": F.get(ring, F.lit(0)).t}


_CR, _CO = "(abs(b1)+0.05)", "(abs(d1)+0.05)"
_CD = "sqrt((a1-c1)**2+(a2-c2)**2)"
_CSQ = f"(((c1-a1)*(d1-c1)+(c2-a2)*(d2-c2))**2-((d1-c1)**2+(d2-c2)**2)*((c1-a1)**2+(c2-a2)**2-{_CR}**2))"
_CS1, _CS2 = (f"((-((c1-a1)*(d1-c1)+(c2-a2)*(d2-c2)) {s} sqrt({_CSQ}))/((d1-c1)**2+(d2-c2)**2))" for s in "-+")
_MEET = f"{_CD} <= {_CR}+{_CO} AND {_CD} >= abs({_CR}-{_CO})"
_ALONG = f"(({_CR}**2-{_CO}**2+{_CD}**2)/(2*{_CD}))"


@family("circle_ops", {
    "diameter": f"2*{_CR}", "area": f"pi()*{_CR}**2", "round": f"2*pi()*{_CR}", "is_inside": f"{_CD} <= {_CR}", "is_strict": f"{_CD} < {_CR}", "is_near": f"{_CD} <= {_CR}+0.1", "gap": f"{_CD}-{_CR}", "at_x": f"a1+{_CR}*cos(0.7)", "tangent_y": "cos(0.7)",
    "near_x": f"a1+{_CR}*(c1-a1)/{_CD}", "low_x": f"a1-{_CR}", "high_y": f"a2+{_CR}", "ring_area": f"2.5*{_CR}**2*sin(2*pi()/5)", "n_ring": "5", "is_meeting": _MEET, "sum_x": f"CASE WHEN {_MEET} THEN 2*(a1+(c1-a1)*{_ALONG}/{_CD}) END",
    "chord": f"CASE WHEN {_MEET} THEN 2*sqrt(greatest(0.0, {_CR}**2-{_ALONG}**2)) END", "n_segment": f"CASE WHEN {_CSQ} < 0 THEN 0 ELSE ({_CS1} BETWEEN 0 AND 1)::INTEGER + ({_CS2} BETWEEN 0 AND 1)::INTEGER END",
    "is_segment": f"sqrt({_d2('a', 'c', 'd')}) <= {_CR}", "scaled": f"3*{_CR}", "moved_y": "a2+c2", "unit": "sqrt(c1**2+c2**2)-1", "span": "sqrt((a1-c1)**2+(a2-c2)**2)/2", "dot": "0.0::DOUBLE", "is_overlap": f"{_CD} <= {_CR}+{_CO}",
})
def _(keep, a, b, c, d):
    o, q = keep(C.circle_at(a.x, a.y, F.abs(b.x) + 0.05)), keep(G.circle(c, F.abs(d.x) + 0.05))
    x, ring = keep(G.circle_crossings(o, q)), keep(C.circle_ring(o, 5), "ring")
    return {"diameter": C.diameter(o), "area": C.circle_area(o), "round": C.circumference(o), "is_inside": C.contains(o, c), "is_strict": C.contains_strict(o, c), "is_near": C.contains(o, c, 0.1), "gap": G.circle_distance(o, c), "at_x": C.circle_point(o, 0.7).x,
            "tangent_y": C.circle_tangent(0.7).y, "near_x": C.circle_nearest(o, c).x, "low_x": C.circle_box(o).min_x, "high_y": C.circle_box(o).max_y, "ring_area": F.abs(G.ring_area("ring")), "n_ring": F.size(ring),
            "is_meeting": C.circles_meet(o, q), "sum_x": x[0].x + x[1].x, "chord": G.distance(x[0], x[1]), "n_segment": F.size(L.segment_circle(G.segment(c, d), o)), "is_segment": C.circle_meets_segment(o, G.segment(c, d)), "scaled": C.circle_scaled(o, 3.0).radius,
            "moved_y": C.circle_moved(o, c).center.y, "unit": G.circle_distance(C.unit_circle(), c), "span": C.circle_on_diameter(a, c).radius, "dot": C.circle_of_point(a).radius, "is_overlap": G.circles_overlap(o, q)}


_MA, _MI = "(abs(b1)+abs(b2)+0.3)", "(abs(b2)+0.1)"
_QX, _QY = "((c1-a1)*cos(d1)+(c2-a2)*sin(d1))", "((c2-a2)*cos(d1)-(c1-a1)*sin(d1))"
_LV = f"(({_QX}/{_MA})**2+({_QY}/{_MI})**2)"
_VX, _VY = "(d1*cos(d1)+d2*sin(d1))", "(d2*cos(d1)-d1*sin(d1))"
_QA = f"(({_VX}/{_MA})**2+({_VY}/{_MI})**2)"
_QB = f"({_QX}*{_VX}/{_MA}**2+{_QY}*{_VY}/{_MI}**2)"
_QD = f"({_QB}**2-{_QA}*({_LV}-1))"
_Q1, _Q2 = (f"((-{_QB} {s} sqrt({_QD}))/{_QA})" for s in "-+")
_H = f"(({_MA}-{_MI})**2/({_MA}+{_MI})**2)"


@family("ellipse_ops", {
    "eccentricity": f"sqrt(({_MA}**2-{_MI}**2)/{_MA}**2)", "area": f"pi()*{_MA}*{_MI}", "round": f"pi()*({_MA}+{_MI})*(1+3*{_H}/(10+sqrt(4-3*{_H})))", "is_circle": "false", "is_ball": "true", "major_x": "cos(d1)", "minor_x": "-sin(d1)", "is_inside": f"{_LV} <= 1",
    "is_strict": f"{_LV} < 1", "at_x": f"a1+{_MA}*cos(0.7)*cos(d1)-{_MI}*sin(0.7)*sin(d1)", "tangent_x": f"-{_MA}*sin(0.7)*cos(d1)-{_MI}*cos(0.7)*sin(d1)",
    "normal_x": f"({_MI}*cos(0.7)*cos(d1)-{_MA}*sin(0.7)*sin(d1))/sqrt(({_MA}*sin(0.7))**2+({_MI}*cos(0.7))**2)", "low_x": f"a1-sqrt(({_MA}*cos(d1))**2+({_MI}*sin(d1))**2)", "high_y": f"a2+sqrt(({_MA}*sin(d1))**2+({_MI}*cos(d1))**2)",
    "ring_area": f"6*{_MA}*{_MI}*sin(2*pi()/12)", "scaled": f"3*{_MI}", "moved_x": "a1+c1", "turned": "d1+0.5", "focus_x": f"a1-cos(d1)*sqrt({_MA}**2-{_MI}**2)", "n_line": f"CASE WHEN {_QD} < 0 THEN 0 ELSE 2 END", "line_t": f"CASE WHEN {_QD} >= 0 THEN {_Q1} END",
    "n_ray": f"CASE WHEN {_QD} < 0 THEN 0 ELSE ({_Q1} >= 0)::INTEGER + ({_Q2} >= 0)::INTEGER END", "n_segment": f"CASE WHEN {_QD} < 0 THEN 0 ELSE ({_Q1} BETWEEN 0 AND 1)::INTEGER + ({_Q2} BETWEEN 0 AND 1)::INTEGER END",
    "line_x": f"CASE WHEN {_QD} >= 0 THEN c1+d1*{_Q2} END",
})
def _(keep, a, b, c, d):
    e, o = keep(C.ellipse(a, F.abs(b.x) + F.abs(b.y) + 0.3, F.abs(b.y) + 0.1, d.x)), keep(L.line(c, d))
    hits, ring = keep(C.ellipse_line(e, o)), keep(C.ellipse_ring(e, 12), "ring")
    return {"eccentricity": C.eccentricity(e), "area": C.ellipse_area(e), "round": C.ellipse_circumference(e), "is_circle": C.is_circle(e), "is_ball": C.is_circle(C.ellipse_of_circle(G.circle(a, F.abs(b.x)))), "major_x": C.major_axis(e).x, "minor_x": C.minor_axis(e).x,
            "is_inside": C.ellipse_holds(e, c), "is_strict": C.ellipse_holds(e, c, strict=True), "at_x": C.ellipse_point(e, 0.7).x, "tangent_x": C.ellipse_tangent(e, 0.7).x, "normal_x": C.ellipse_normal(e, 0.7).x, "low_x": C.ellipse_box(e).min_x,
            "high_y": C.ellipse_box(e).max_y, "ring_area": F.abs(G.ring_area("ring")), "scaled": C.ellipse_scaled(e, 3.0).semi_minor, "moved_x": C.ellipse_moved(e, c).center.x, "turned": C.ellipse_turned(e, 0.5).rotation,
            "focus_x": C.foci(e)[0].x, "n_line": F.size(hits), "line_t": F.get(hits, F.lit(0)).t, "n_ray": F.size(C.ellipse_ray(e, o)), "n_segment": F.size(C.ellipse_segment(e, keep(G.segment(c, G.add(c, d))))),
            "line_x": F.get(hits, F.lit(1)).p.x}


_NEAR = f""", s AS (SELECT id, k, CAST(sqrt(({_MA}*cos(2*pi()*k/65536)-{_QX})**2+({_MI}*sin(2*pi()*k/65536)-{_QY})**2) AS DOUBLE) AS d FROM z, range(65536) r(k)), near AS (SELECT id, min(d) AS d FROM s GROUP BY 1)"""


def _abcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    return points(spark, sf_dir).select("id", *(G.point(e[2 * k], e[2 * k + 1]).alias(n) for k, n in enumerate("abcd")))


@query("ellipse_distance", f"{ABCD}{_NEAR} SELECT id, round(CASE WHEN {_LV} <= 1 THEN -d ELSE d END, 3) + 0.0 AS d FROM z JOIN near USING (id)")
def ellipse_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed distance of a point to an ellipse; the twin takes the least of 65,536 samples."""
    a, b, c, d = map(F.col, "abcd")
    t = _abcd(spark, sf_dir).withColumn("o", C.ellipse(a, F.abs(b.x) + F.abs(b.y) + 0.3, F.abs(b.y) + 0.1, d.x))
    return t.select("id", (F.round(C.ellipse_distance(F.col("o"), c), 3) + 0.0).alias("d"))


_SX, _SY = (f"(a{k}+{_MA}*cos(2*pi()*k/64)*{u}+{_MI}*sin(2*pi()*k/64)*{v})" for k, u, v in ((1, "cos(d1)", "(-sin(d1))"), (2, "sin(d1)", "cos(d1)")))
_ON = f"sign((({_SX}-c1)/(abs(d2)+0.4))**2+(({_SY}-c2)/(abs(d1)+0.2))**2-1)"


@query("ellipse_crossings", f"{ABCD}, s AS (SELECT id, k, {_ON} AS g, ((c1-a1)*cos(d1)+(c2-a2)*sin(d1))/{_MA} AS u, ((c2-a2)*cos(d1)-(c1-a1)*sin(d1))/{_MI} AS v, ((a1-c1)/(abs(d2)+0.4))**2+((a2-c2)/(abs(d1)+0.2))**2 <= 1 AS held FROM z, range(65) r(k)), x AS (SELECT *, lead(g) OVER (PARTITION BY id ORDER BY k) AS h FROM s) SELECT id, CAST(count(*) FILTER (g * h < 0) AS INTEGER) AS n, count(*) FILTER (g * h < 0) > 0 OR bool_or(u*u+v*v <= 1) OR bool_or(held) AS meet, true AS exact FROM x GROUP BY 1")
def ellipse_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of two ellipses: how many, whether the areas meet, and whether all points lie on both."""
    a, b, c, d = map(F.col, "abcd")
    t = _abcd(spark, sf_dir).select("id", C.ellipse(a, F.abs(b.x) + F.abs(b.y) + 0.3, F.abs(b.y) + 0.1, d.x).alias("e1"), C.ellipse(c, F.abs(d.y) + 0.4, F.abs(d.x) + 0.2).alias("e2"))
    e, o = F.col("e1"), F.col("e2")
    x = t.withColumn("x", C.ellipse_crossings(e, o)).withColumn("meet", (F.size("x") > 0) | C.ellipse_holds(e, o.center) | C.ellipse_holds(o, e.center))
    on = F.forall("x", lambda p: (F.abs(C._level(F.col("e1"), p) - 1) < 1e-6) & (F.abs(C._level(F.col("e2"), p) - 1) < 1e-6))
    return x.select("id", F.size("x").alias("n"), "meet", on.alias("exact"))


_DET = "(a1*b2-a2*b1)"


@family("affine_ops", {
    "vector_x": "a1*d1+a2*d2", "point_y": "b1*d1+b2*d2+c2", "determinant": _DET, "is_kept": f"{_DET} > 0", "is_invertible": "true", "is_flat": "false", "shift_x": "c1+d1", "rotate_x": "cos(0.7)*d1-sin(0.7)*d2", "scale_y": "3*d2", "scale_xy": "2*d1", "shear_x": "d1+0.4*d2",
    "shear_y": "0.4*d1+d2", "mirror_x": "-d2", "mirror_y": "-d1", "mirror_o": "-d1-d2", "mirror_line": "(2*c1*c1/(c1**2+c2**2)-1)*d1+2*c1*c2/(c1**2+c2**2)*d2", "around_x": "c1+cos(0.7)*(d1-c1)-sin(0.7)*(d2-c2)", "grown_y": "c2+3*(d2-c2)", "then_x": "a1*d1+a2*d2+c1+d1",
    "then_turn": "cos(0.7)*(a1*d1+a2*d2+c1)-sin(0.7)*(b1*d1+b2*d2+c2)", "then_scale": "3*(b1*d1+b2*d2+c2)", "back_x": "d1", "is_identity": "true", "is_moved": "true", "is_rigid": "true", "is_loose": "false", "is_similar": "true", "is_skew": "false", "angle": "atan2(b1, a1)",
    "sx": "sqrt(a1**2+b1**2)", "sy": "sqrt(a2**2+b2**2)", "matrix": "a1+2*a2+3*c1+4*b1+5*b2+6*c2+9", "from_matrix": "a1*d1+a2*d2+c1", "between_x": "0.75*(a1*d1+a2*d2+c1)+0.25*d1", "part_x": "c1", "twice_x": "a1*(a1*d1+a2*d2+c1)+a2*(b1*d1+b2*d2+c2)+c1", "line_y": "b1*a1+b2*a2+c2",
})
def _(keep, a, b, c, d):
    m = keep(G.affine(a.x, a.y, b.x, b.y, c.x, c.y))
    v = keep(M.to_matrix(m))
    return {"vector_x": M.apply_vector(m, d).x, "point_y": G.affine_apply(m, d).y, "determinant": M.determinant(m), "is_kept": M.keeps_orientation(m), "is_invertible": M.invertible(m), "is_flat": M.invertible(M.scaling(0.0)), "shift_x": G.affine_apply(M.translation_by(c), d).x,
            "rotate_x": G.affine_apply(M.rotation(0.7), d).x, "scale_y": G.affine_apply(M.scaling(3), d).y, "scale_xy": G.affine_apply(M.scaling(2, 5), d).x, "shear_x": G.affine_apply(M.shear_x(0.4), d).x, "shear_y": G.affine_apply(M.shear_y(0.4), d).y,
            "mirror_x": G.affine_apply(M.reflect_x(), d).y, "mirror_y": G.affine_apply(M.reflect_y(), d).x, "mirror_o": G.affine_apply(M.reflect_origin(), d).x + G.affine_apply(M.reflect_origin(), d).y, "mirror_line": G.affine_apply(M.reflect_line(c), d).x,
            "around_x": G.affine_apply(M.around(M.rotation(0.7), c), d).x, "grown_y": G.affine_apply(M.around(M.scaling(3), c), d).y, "then_x": G.affine_apply(M.then_translate(m, d), d).x, "then_turn": G.affine_apply(M.then_rotate(m, 0.7), d).x,
            "then_scale": G.affine_apply(M.then_scale(m, 3), d).y, "back_x": G.affine_apply(G.affine_then(M.shear_x(0.4), G.affine_inverse(M.shear_x(0.4))), d).x, "is_identity": M.is_identity(M.identity(), 1e-9), "is_moved": M.is_translation(M.translation(1, 2), 1e-9),
            "is_rigid": M.is_rigid(M.rotation(d.x), 1e-9), "is_loose": M.is_rigid(M.scaling(2), 1e-9), "is_similar": M.is_similarity(M.then_scale(M.rotation(d.x), 3), 1e-9), "is_skew": M.is_similarity(M.shear_x(1), 1e-9), "angle": M.rotation_angle(m),
            "sx": M.scale_factors(m).sx, "sy": M.scale_factors(m).sy, "matrix": v[0] + 2 * v[1] + 3 * v[2] + 4 * v[3] + 5 * v[4] + 6 * v[5] + 7 * v[6] + 8 * v[7] + 9 * v[8], "from_matrix": G.affine_apply(M.from_matrix(v), d).x,
            "between_x": G.affine_apply(M.between(m, M.identity(), 0.25), d).x, "part_x": M.translation_part(m).x, "twice_x": G.affine_apply(G.affine_then(m, m), d).x, "line_y": M.apply_points(m, F.array(d, a))[1].y}


_UV = "(a1*b2+a2*c1+b1*c2)"
_S3 = f"greatest(0.0, least(1.0, ((d1-a1)*(b2-a1)+(d2-a2)*(c1-a2)+(a1-b1)*(c2-b1))/((b2-a1)**2+(c1-a2)**2+(c2-b1)**2)))"
_S3D = f"((a1+(b2-a1)*{_S3}-d1)**2+(a2+(c1-a2)*{_S3}-d2)**2+(b1+(c2-b1)*{_S3}-a1)**2)"


@family("space_ops", {
    "sum_z": "b1+c2", "dot": _UV, "cross_x": "a2*c2-b1*c1", "cross_y": "b1*b2-a1*c2", "cross_z": "a1*c1-a2*b2", "square": "a1**2+a2**2+b1**2", "length": "sqrt(a1**2+a2**2+b1**2)", "unit_z": "b1/sqrt(a1**2+a2**2+b1**2)", "lerp_y": "a2*0.75+c1*0.25", "mid_x": "(a1+b2)/2",
    "gap_square": "(a1-b2)**2+(a2-c1)**2+(b1-c2)**2", "gap": "sqrt((a1-b2)**2+(a2-c1)**2+(b1-c2)**2)", "axes": "a1-a2+b1", "direction_z": "c2-b1", "at_x": "a1+0.3*(b2-a1)", "back_y": "c1", "t": _S3, "near_x": f"a1+(b2-a1)*{_S3}", "off_square": _S3D, "off": f"sqrt({_S3D})",
    "is_degenerate": "(a1-b2)**2+(a2-c1)**2+(b1-c2)**2 <= 0.04", "zero": "0.0::DOUBLE",
})
def _(keep, a, b, c, d):
    u, v, p = keep(V.vec(a.x, a.y, b.x)), keep(V.vec(b.y, c.x, c.y)), keep(V.vec(d.x, d.y, a.x))
    s = keep(G.segment(u, v))
    near = keep(V.closest_on_segment(s, p))
    return {"sum_z": V.add(u, v).z, "dot": V.dot(u, v), "cross_x": V.cross(u, v).x, "cross_y": V.cross(u, v).y, "cross_z": V.cross(u, v).z, "square": V.dot(u, u), "length": V.magnitude(u), "unit_z": V.normalized(u).z, "lerp_y": V.lerp(u, v, 0.25).y,
            "mid_x": V.midpoint(u, v).x, "gap_square": V.distance_squared(u, v), "gap": V.distance(u, v), "axes": V.dot(u, V.vec(*V.UNIT_X)) - V.dot(u, V.vec(*V.UNIT_Y)) + V.dot(u, V.vec(*V.UNIT_Z)), "direction_z": V.direction(s).z, "at_x": V.segment_at(s, 0.3).x,
            "back_y": V.segment_reversed(s).start.y, "t": V.segment_parameter(s, p), "near_x": near.x, "off_square": V.distance_squared(near, p), "off": V.segment_distance(s, p),
            "is_degenerate": V.segment_degenerate(s, 0.2), "zero": V.magnitude(V.vec(*V.ZERO))}


_BX = {k: f"{f}(a{i}, b{i})" for k, f, i in (("lx", "least", 1), ("ly", "least", 2), ("hx", "greatest", 1), ("hy", "greatest", 2))}
_OX = {k: f"{f}(c{i}, d{i})" for k, f, i in (("lx", "least", 1), ("ly", "least", 2), ("hx", "greatest", 1), ("hy", "greatest", 2))}
_BM = f"{_BX['lx']} <= {_OX['hx']} AND {_OX['lx']} <= {_BX['hx']} AND {_BX['ly']} <= {_OX['hy']} AND {_OX['ly']} <= {_BX['hy']}"
_BD = f"(greatest(0.0, {_BX['lx']}-c1, c1-{_BX['hx']})**2+greatest(0.0, {_BX['ly']}-c2, c2-{_BX['hy']})**2)"


@family("box_ops", {
    "width": "abs(a1-b1)", "height": "abs(a2-b2)", "size_y": "abs(a2-b2)", "center_x": "(a1+b1)/2", "area": "abs(a1-b1)*abs(a2-b2)", "with_x": "greatest(a1, b1, c1)", "union_y": "least(a2, b2, c2, d2)", "is_meeting": _BM, "shared": f"CASE WHEN {_BM} THEN (least({_BX['hx']}, {_OX['hx']})-greatest({_BX['lx']}, {_OX['lx']}))*(least({_BX['hy']}, {_OX['hy']})-greatest({_BX['ly']}, {_OX['ly']})) END",
    "is_inside": f"c1 BETWEEN {_BX['lx']} AND {_BX['hx']} AND c2 BETWEEN {_BX['ly']} AND {_BX['hy']}", "gap": f"sqrt({_BD})", "gap_square": _BD, "dot": "0.0::DOUBLE", "line_x": "greatest(a1, b1, c1, d1)",
})
def _(keep, a, b, c, d):
    x, o = keep(B.box_of_corners(a, b)), keep(B.box_of_corners(c, d))
    return {"width": B.box_width(x), "height": B.box_height(x), "size_y": B.box_size(x).y, "center_x": B.box_center(x).x, "area": G.box_area(x), "with_x": B.box_with(x, c).max_x, "union_y": G.box_union(x, o).min_y, "is_meeting": G.boxes_meet(x, o),
            "shared": G.box_area(G.box_intersection(x, o)), "is_inside": G.box_contains(x, c), "gap": G.box_distance(x, c), "gap_square": F.pow(G.box_distance(x, c), F.lit(2.0)), "dot": G.box_area(B.box_of_point(a)), "line_x": B.box_of_line(F.array(a, b, c, d)).max_x}


_KR = "(abs(c1)/4+0.02)"
_GAP = f"CASE WHEN {_CROSS} THEN 0.0 ELSE least({_d2('a', 'c', 'd')}, {_d2('b', 'c', 'd')}, {_d2('c', 'a', 'b')}, {_d2('d', 'a', 'b')}) END"


@family("capsule_ops", {
    "length": "sqrt((b1-a1)**2+(b2-a2)**2)", "total": f"sqrt((b1-a1)**2+(b2-a2)**2)+2*{_KR}", "area": f"sqrt((b1-a1)**2+(b2-a2)**2)*2*{_KR}+pi()*{_KR}**2", "center_y": "(a2+b2)/2", "is_inside": f"sqrt({_d2('d', 'a', 'b')}) <= {_KR}", "signed": f"sqrt({_d2('d', 'a', 'b')})-{_KR}",
    "gap": f"greatest(0.0, sqrt({_d2('d', 'a', 'b')})-{_KR})", "is_meeting": f"{_GAP} <= ({_KR}+0.05)**2", "is_circle": f"sqrt({_d2('d', 'a', 'b')}) <= {_KR}+0.1", "axis_x": "(b1-a1)/sqrt((b1-a1)**2+(b2-a2)**2)", "grown": f"{_KR}+0.5", "is_dot": "sqrt((a1-d1)**2+(a2-d2)**2) <= 0.3", "around": f"sqrt(greatest({_d2('c', 'a', 'b')}, {_d2('d', 'a', 'b')}))",
})
def _(keep, a, b, c, d):
    k, o = keep(B.capsule_between(a, b, F.abs(c.x) / 4 + 0.02)), keep(B.capsule(G.segment(c, d), 0.05))
    s = keep(k.segment)
    k = keep(B.capsule(s, k.radius))
    return {"length": B.capsule_length(k), "total": B.capsule_total_length(k), "area": B.capsule_area(k), "center_y": B.capsule_center(k).y, "is_inside": G.capsule_contains(k.segment, k.radius, d), "signed": B.capsule_signed_distance(k, d), "gap": B.capsule_distance(k, d),
            "is_meeting": B.capsules_meet(k, o), "is_circle": B.capsule_meets_circle(k, d, F.lit(0.1)), "axis_x": B.capsule_axis(k).x, "grown": B.capsule_grown(k, 0.5).radius,
            "is_dot": B.capsule_signed_distance(B.capsule_of_circle(a, 0.3), d) <= 0, "around": B.capsule_around(G.segment(a, b), F.array(c, d)).radius}


_OW, _OH = "(abs(b1)+0.05)", "(abs(b2)+0.05)"
_OPX, _OPY = "((d1-a1)*cos(c1)+(d2-a2)*sin(c1))", "((d2-a2)*cos(c1)-(d1-a1)*sin(c1))"
_OD = f"(greatest(0.0, abs({_OPX})-{_OW})**2+greatest(0.0, abs({_OPY})-{_OH})**2)"


def _reach(angle: str, w: str, h: str, ax: str, ay: str) -> str:
    return f"{w}*abs(cos({angle})*{ax}+sin({angle})*{ay})+{h}*abs(-sin({angle})*{ax}+cos({angle})*{ay})"


_APART = " AND ".join(f"abs((d1-a1)*{x}+(d2-a2)*{y}) <= {_reach('c1', _OW, _OH, x, y)} + {_reach('c2', '0.2', '0.1', x, y)}" for x, y in (("cos(c1)", "sin(c1)"), ("(-sin(c1))", "cos(c1)"), ("cos(c2)", "sin(c2)"), ("(-sin(c2))", "cos(c2)")))


@family("turned_box_ops", {
    "area": f"4*{_OW}*{_OH}", "axis_x": "cos(c1)", "axis_y": "cos(c1)", "corner_x": f"a1-{_OW}*cos(c1)+{_OH}*sin(c1)", "corner_y": f"a2+{_OW}*sin(c1)+{_OH}*cos(c1)", "is_inside": f"abs({_OPX}) <= {_OW} AND abs({_OPY}) <= {_OH}", "gap": f"sqrt({_OD})", "gap_square": _OD, "is_meeting": _APART,
    "level": "greatest(0.0, abs(d1-a1)-0.2)**2+greatest(0.0, abs(d2-a2)-0.1)**2",
})
def _(keep, a, b, c, d):
    o = keep(B.turned_box(a, F.abs(b.x) + 0.05, F.abs(b.y) + 0.05, c.x))
    return {"area": B.turned_area(o), "axis_x": B.turned_axis_x(o).x, "axis_y": B.turned_axis_y(o).y, "corner_x": B.turned_corners(o)[0].x, "corner_y": B.turned_corners(o)[2].y, "is_inside": B.turned_contains(o, d), "gap": B.turned_distance(o, d),
            "gap_square": B.turned_distance_squared(o, d), "is_meeting": B.turned_meet(o, B.turned_box(d, 0.2, 0.1, c.y)), "level": B.turned_distance_squared(B.turned_box(a, 0.2, 0.1), d)}


