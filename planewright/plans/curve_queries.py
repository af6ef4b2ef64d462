"""Quadratic and cubic curves, arcs and spline spans over the embeddings' points; see ``primitive_queries`` for the form."""

from __future__ import annotations

from pyspark.sql import functions as F

from planewright.functions import curves as U
from planewright.functions import geometry as G
from planewright.plans.primitive_queries import _d2, family


def _quadratic(t: str, k: int) -> str:
    return f"((1-{t})**2*a{k}+2*(1-{t})*{t}*b{k}+{t}**2*c{k})"


def _cubic(t: str, k: int) -> str:
    return f"((1-{t})**3*a{k}+3*(1-{t})**2*{t}*b{k}+3*(1-{t})*{t}**2*c{k}+{t}**3*d{k})"


def _frames(at) -> str:
    """Per row: length of 1,024 chords, least and greatest coordinates and least distance to d among 4,097 samples."""
    x, y = at("(k/4096.0::DOUBLE)", 1), at("(k/4096.0::DOUBLE)", 2)
    q = "d" if at is _quadratic else "e"
    target = "d1, d2" if q == "d" else "0.1::DOUBLE AS e1, 0.2::DOUBLE AS e2"
    return f""", s AS (SELECT id, k, {x} AS x, {y} AS y, {target} FROM z, range(4097) r(k)), w AS (SELECT *, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM s WINDOW o AS (PARTITION BY id ORDER BY k)),
 m AS (SELECT id, sum(sqrt((nx-x)**2+(ny-y)**2)) AS len, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(sqrt((x-{q}1)**2+(y-{q}2)**2)) AS near FROM w GROUP BY 1), zm AS (SELECT z.*, len, lx, hx, ly, hy, near FROM z JOIN m USING (id))"""


def _rough(x):
    """Three digits, for what the twin takes from samples."""
    return F.round(x, 3)


_QT = "((a1-b1)/(a1-2*b1+c1))"


@family("quadratic_ops", {
    "x": _quadratic("0.3", 1), "y": _quadratic("0.3", 2), "dx": "2*(0.7*(b1-a1)+0.3*(c1-b1))", "dy": "2*(0.7*(b2-a2)+0.3*(c2-b2))", "flat": f"sqrt({_d2('b', 'a', 'c')})", "control_x": "least(a1, b1, c1)", "control_y": "greatest(a2, b2, c2)", "split_x": "a1+0.3*(b1-a1)",
    "split_y": "b2+0.3*(c2-b2)", "low": f"CASE WHEN {_QT} > 0 AND {_QT} < 1 THEN least(a1, c1, {_quadratic(_QT, 1)}) ELSE least(a1, c1) END", "high": "round(hy, 3)", "length": "round(len, 2)", "near": "round(near, 3)",
    "n_line": "9", "line_x": _quadratic("0.25", 1), "offset_x": f"{_quadratic('0.5', 1)}-0.1*(c2-a2)/sqrt((c1-a1)**2+(c2-a2)**2)", "curvature": "4*((b1-a1)*(a2-2*b2+c2)-(b2-a2)*(a1-2*b1+c1))/(sqrt(4*((b1-a1)**2+(b2-a2)**2))**3)",
}, _frames(_quadratic), "zm")
def _(keep, a, b, c, d):
    p = (a, b, c)
    left, right = G.bezier_split(0.3, *p)
    bounds, line = keep(U.tight_bounds(*p)), keep(U.sampled(8, *p))
    second = keep(G.scale(G.add(G.sub(a, G.scale(b, 2.0)), c), 2.0))
    speed = keep(G.bezier_derivative(0.0, *p))
    return {"x": G.bezier(0.3, *p).x, "y": G.bezier(0.3, *p).y, "dx": G.bezier_derivative(0.3, *p).x, "dy": G.bezier_derivative(0.3, *p).y, "flat": U.flatness(*p), "control_x": U.control_bounds(*p).min_x, "control_y": U.control_bounds(*p).max_y, "split_x": left[1].x, "split_y": right[1].y,
            "low": bounds.min_x, "high": _rough(bounds.max_y), "length": F.round(U.curve_length(*p), 2), "near": _rough(U.curve_nearest(d, *p).d), "n_line": F.size(line), "line_x": line[2].x, "offset_x": U.offset_point(0.5, 0.1, *p).x,
            "curvature": F.try_divide(G.cross(speed, second), F.pow(G.magnitude(speed), F.lit(3.0)))}


_SELF = {k: f"(d{k}-3*c{k}+3*b{k}-a{k})" for k in (1, 2)}, {k: f"(3*(c{k}-2*b{k}+a{k}))" for k in (1, 2)}, {k: f"(3*(b{k}-a{k}))" for k in (1, 2)}
_det = lambda u, v: f"({u[1]}*{v[2]}-{u[2]}*{v[1]})"
_SS, _SP = f"({_det(_SELF[2], _SELF[0])}/{_det(_SELF[0], _SELF[1])})", f"({_det(_SELF[1], _SELF[2])}/{_det(_SELF[0], _SELF[1])})"
_SR = f"(4*{_SP}-3*{_SS}**2)"
_IS_LOOP = f"({_SR} > 0 AND ({_SS}-sqrt({_SR}))/2 >= 0 AND ({_SS}+sqrt({_SR}))/2 <= 1)"


@family("cubic_ops", {
    "flat": f"sqrt(greatest({_d2('b', 'a', 'd')}, {_d2('c', 'a', 'd')}))", "control_x": "greatest(a1, b1, c1, d1)", "low": "round(lx, 3)", "high": "round(hy, 3)", "length": "round(len, 2)", "near": "round(near, 3)", "line_x": _cubic("0.25", 1),
    "offset_y": f"{_cubic('0.5', 2)}+0.1*(d1+c1-b1-a1)/sqrt((d1+c1-b1-a1)**2+(d2+c2-b2-a2)**2)", "is_loop": f"coalesce({_IS_LOOP}, false)", "loop_t": f"CASE WHEN {_IS_LOOP} THEN ({_SS}-sqrt({_SR}))/2 END", "turn_x": "3*(0.49*(b1-a1)+0.42*(c1-b1)+0.09*(d1-c1))",
}, _frames(_cubic), "zm")
def _(keep, a, b, c, d):
    p = (a, b, c, d)
    bounds, loop = keep(U.tight_bounds(*p)), keep(U.self_crossing(*p))
    return {"flat": U.flatness(*p), "control_x": U.control_bounds(*p).max_x, "low": _rough(bounds.min_x), "high": _rough(bounds.max_y), "length": F.round(U.curve_length(*p), 2), "near": _rough(U.curve_nearest(G.point(0.1, 0.2), *p).d), "line_x": U.sampled(8, *p)[2].x,
            "offset_y": U.offset_line(4, 0.1, *p)[2].y, "is_loop": loop.isNotNull(), "loop_t": loop.t, "turn_x": G.bezier_derivative(0.3, *p).x}


_D = "(2*(a1*(b2-c2)+b1*(c2-a2)+c1*(a2-b2)))"
_CX = f"(((a1**2+a2**2)*(b2-c2)+(b1**2+b2**2)*(c2-a2)+(c1**2+c2**2)*(a2-b2))/{_D})"
_CY = f"(((a1**2+a2**2)*(c1-b1)+(b1**2+b2**2)*(a1-c1)+(c1**2+c2**2)*(b1-a1))/{_D})"
_CHORD = "sqrt((b1-a1)**2+(b2-a2)**2)"
_BR = f"(({_CHORD}**2/4+(d1*{_CHORD}/2)**2)/(2*abs(d1*{_CHORD}/2)))"
_BX, _BY = f"((a1+b1)/2-(b2-a2)/{_CHORD}*({_BR}-abs(d1*{_CHORD}/2))*sign(d1))", f"((a2+b2)/2+(b1-a1)/{_CHORD}*({_BR}-abs(d1*{_CHORD}/2))*sign(d1))"
_N = "greatest(1, ceil(abs(c2*3-c1)/(2*acos(1-0.01/(abs(b1)+0.05)))))::INTEGER"


@family("arc_ops", {
    "start_x": "a1+(abs(b1)+0.05)*cos(c1)", "end_y": "a2+(abs(b1)+0.05)*sin(c2*3)", "at_x": "a1+(abs(b1)+0.05)*cos(c1+(c2*3-c1)*0.4)", "angle_x": "a1+(abs(b1)+0.05)*cos(0.7)", "sweep": "c2*3-c1", "length": "(abs(b1)+0.05)*abs(c2*3-c1)", "is_full": "abs(c2*3-c1) >= 2*pi()", "is_round": "true",
    "through_x": _CX, "through_r": f"sqrt((a1-{_CX})**2+(a2-{_CY})**2)", "bulge_x": _BX, "bulge_r": _BR, "bulge_start": f"atan2(a2-{_BY}, a1-{_BX})", "n_line": f"{_N}+1", "line_x": f"a1+(abs(b1)+0.05)*cos(c1+(c2*3-c1)/{_N})",
})
def _(keep, a, b, c, d):
    o = keep(U.arc(a, F.abs(b.x) + 0.05, c.x, c.y * 3))
    through, bulge, line = keep(U.arc_through(a, b, c)), keep(U.arc_of_bulge(a, b, d.x)), keep(U.arc_line(o, 0.01))
    return {"start_x": U.arc_start(o).x, "end_y": U.arc_end(o).y, "at_x": U.arc_at(o, 0.4).x, "angle_x": U.arc_at_angle(o, 0.7).x, "sweep": U.sweep(o), "length": U.arc_length(o), "is_full": U.is_full_circle(o), "is_round": U.is_full_circle(U.arc(a, 1.0, 0.0, 6.2831853071795868)),
            "through_x": through.center.x, "through_r": through.radius, "bulge_x": bulge.center.x, "bulge_r": bulge.radius, "bulge_start": bulge.start_angle, "n_line": F.size(line), "line_x": line[1].x}


_DX, _DY = "(0.5-d1)", "(0.4-d2)"
_W = [f"({_DX}*({k}2-d2)-{_DY}*({k}1-d1))" for k in "abc"]
_RD = f"(({_W[1]}-{_W[0]})**2-({_W[0]}-2*{_W[1]}+{_W[2]})*{_W[0]})"
_RT = [f"((-({_W[1]}-{_W[0]}) {s} sqrt({_RD}))/({_W[0]}-2*{_W[1]}+{_W[2]}))" for s in "-+"]
_RON = [f"({_RD} >= 0 AND {t} BETWEEN 0 AND 1 AND (({_quadratic(t, 1)}-d1)*{_DX}+({_quadratic(t, 2)}-d2)*{_DY})/({_DX}**2+{_DY}**2) BETWEEN 0 AND 1)" for t in _RT]


@family("quadratic_segment", {"n_hits": f"CASE WHEN {_RD} >= 0 THEN ({_RON[0]})::INTEGER + ({_RON[1]})::INTEGER ELSE 0 END", "is_hit": f"CASE WHEN {_RD} >= 0 THEN {_RON[0]} OR {_RON[1]} ELSE false END", "first_t": f"CASE WHEN {_RD} < 0 THEN NULL WHEN {_RON[0]} AND {_RON[1]} THEN least({_RT[0]}, {_RT[1]}) WHEN {_RON[0]} THEN {_RT[0]} WHEN {_RON[1]} THEN {_RT[1]} END"})
def _(keep, a, b, c, d):
    hits = keep(U.curve_line_parameters(keep(G.segment(d, G.point(0.5, 0.4))), a, b, c))
    return {"n_hits": F.size(hits), "is_hit": F.size(hits) > 0, "first_t": F.get(hits, F.lit(0))}


def _barry(k: int, alpha: str) -> str:
    u, v, w = (f"(pow(sqrt(({q}1-{p}1)**2+({q}2-{p}2)**2), {alpha}))" for p, q in ("ab", "bc", "cd"))
    t = f"({u}+0.3*{v})"
    a1 = f"(a{k}+(b{k}-a{k})*{t}/{u})"
    a2 = f"(b{k}+(c{k}-b{k})*({t}-{u})/{v})"
    a3 = f"(c{k}+(d{k}-c{k})*({t}-{u}-{v})/{w})"
    b1 = f"({a1}+({a2}-{a1})*{t}/({u}+{v}))"
    b2 = f"({a2}+({a3}-{a2})*({t}-{u})/({v}+{w}))"
    return f"({b1}+({b2}-{b1})*0.3)"


@family("catmull_rom_spans", {"uniform_x": _barry(1, "0.0"), "centripetal_x": _barry(1, "0.5"), "centripetal_y": _barry(2, "0.5"), "chordal_x": _barry(1, "1.0"), "start_x": "b1", "end_y": "c2", "tangent_x": "0.35*(c1-a1)", "hermite_x": "0.784*b1+0.147*0.35*(c1-a1)+0.216*c1-0.063*0.35*(d1-b1)", "still_x": "0.784*b1+0.216*c1"})
def _(keep, a, b, c, d):
    m, n, z = keep(U.cardinal_tangent(a, c, 0.3)), keep(U.cardinal_tangent(b, d, 0.3)), keep(G.point(0, 0))
    t = F.lit(0.3)
    return {"uniform_x": U.catmull_rom_span(t, a, b, c, d, 0.0).x, "centripetal_x": U.catmull_rom_span(t, a, b, c, d, 0.5).x, "centripetal_y": U.catmull_rom_span(t, a, b, c, d, 0.5).y, "chordal_x": U.catmull_rom_span(t, a, b, c, d, 1.0).x,
            "start_x": U.catmull_rom_span(F.lit(0.0), a, b, c, d, 0.5).x, "end_y": U.catmull_rom_span(F.lit(1.0), a, b, c, d, 0.5).y, "tangent_x": m.x, "hermite_x": G.hermite(t, b, m, c, n).x, "still_x": G.hermite(t, b, z, c, z).x}
