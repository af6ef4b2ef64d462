"""Splines, curve crossings, booleans, strokes, sight and faults of rings, one geometry at a time; see ``primitive_queries`` for the form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewright.functions import curve_kernels as C
from planewright.functions import geometry as G
from planewright.functions import kernels as K
from planewright.functions import overlay as O
from planewright.functions import polygon_kernels as N
from planewright.functions import sight as V
from planewright.operators import per_geometry as P
from planewright.operators.tables import points
from planewright.plans.curve_queries import _barry, _cubic
from planewright.plans.primitive_queries import _CROSS, family
from planewright.plans.registry import query


def _second(t: str, k: int) -> str:
    """An open quadratic spline of four points on its first span, 0 to 1, which is a Bezier curve."""
    return f"((1-{t})**2*a{k}+2*(1-{t})*{t}*b{k}+{t}**2*(b{k}+c{k})/2)"


@family("spline_lines", {
    "cubic_x": _cubic("0.3", 1), "cubic_y": _cubic("0.3", 2), "square_x": _second("0.6", 1), "square_y": _second("0.6", 2), "uniform_x": "0.125*a1+0.75*b1+0.125*c1", "finer_x": _second("0.6", 1), "slope_x": "2*(b1-a1)*0.4+(c1-b1)*0.6", "n": "11::DOUBLE",
    "centripetal_x": _barry(1, "0.5"), "cardinal_y": "0.784*b2+0.147*0.35*(c2-a2)+0.216*c2-0.063*0.35*(d2-b2)", "still_x": "0.784*b1+0.216*c1", "arc_x": "(0.4**2+2*0.4*0.6*sqrt(0.5))/(0.4**2+2*0.4*0.6*sqrt(0.5)+0.6**2)", "oval_y": "0.5*(2*0.4*0.6*sqrt(0.5)+0.6**2)/(0.4**2+2*0.4*0.6*sqrt(0.5)+0.6**2)",
})
def _(keep, a, b, c, d):
    p = keep(F.array(a, b, c, d))
    line = lambda fn: keep(P.made("points", fn, p))
    cubic, square, finer = line(lambda p: C.open_spline_line(p, 3, 10)), line(lambda p: C.open_spline_line(p, 2, 10)), line(lambda p: C.refined_spline_line(p, 2, 10, 0.35))
    slope, even = line(lambda p: C.spline_tangents(p, 2, 10)), line(lambda p: C.uniform_spline_line(p, 2, 4))
    rom, cardinal, still = line(lambda p: C.catmull_rom_line(p, 10)), line(lambda p: C.cardinal_line(p, 10, 0.3)), line(lambda p: C.still_line(p, 10))
    arc, oval = line(lambda p: C.rational_arc_line(0, np.pi / 2, 10)), line(lambda p: C.rational_arc_line(0, np.pi / 2, 10, stretch=0.5))
    return {"cubic_x": cubic[3].x, "cubic_y": cubic[3].y, "square_x": square[3].x, "square_y": square[3].y, "uniform_x": even[1].x, "finer_x": finer[3].x, "slope_x": slope[3].x, "n": F.size(cubic).cast("double"),
            "centripetal_x": rom[13].x, "cardinal_y": cardinal[13].y, "still_x": still[13].x, "arc_x": arc[6].x, "oval_y": oval[6].y}


_SIDE = "(0.5-(-0.5))*(y-(-0.4))-(0.4-(-0.4))*(x-(-0.5))"
_RUN = f""", s AS (SELECT id, k, {_cubic('(k/8192.0::DOUBLE)', 1)} AS x, {_cubic('(k/8192.0::DOUBLE)', 2)} AS y FROM z, range(8193) r(k)), g AS (SELECT id, k, sign({_SIDE}) AS g, ((x+0.5)*1.0+(y+0.4)*0.8)/(1.0+0.64) AS along FROM s),
 h AS (SELECT id, g * lead(g) OVER (PARTITION BY id ORDER BY k) < 0 AND along BETWEEN 0 AND 1 AS hit FROM g), hits AS (SELECT id, count(*) FILTER (hit) AS n FROM h GROUP BY 1), zh AS (SELECT z.*, n FROM z JOIN hits USING (id))"""


@family("cubic_segment", {"n_hits": "CAST(n AS INTEGER)", "is_hit": "n > 0"}, _RUN, "zh")
def _(keep, a, b, c, d):
    n = keep(P.made("int", lambda p, q: len(C.bezier_crossings(p, q)), F.array(a, b, c, d), F.array(G.point(-0.5, -0.4), G.point(0.5, 0.4))))
    return {"n_hits": n, "is_hit": n > 0}


_LW, _LH, _RW, _RH = "(abs(b1)+0.2)", "(abs(b2)+0.2)", "(abs(d1)+0.2)", "(abs(d2)+0.2)"
_PART = lambda x, y, w, h: f"(greatest(0.0, least({x}+{w}, c1+{_RW})-greatest({x}, c1))*greatest(0.0, least({y}+{h}, c2+{_RH})-greatest({y}, c2)))"
_BOTH = f"({_PART('a1', 'a2', _LW, _LH)}-{_PART(f'(a1+{_LW}/2)', f'(a2+{_LH}/2)', f'{_LW}/2', f'{_LH}/2')})"
_ELL, _BOX = f"(0.75*{_LW}*{_LH})", f"({_RW}*{_RH})"


@family("polygon_booleans", {"shared": _BOTH, "joined": f"{_ELL}+{_BOX}-{_BOTH}", "left_over": f"{_ELL}-{_BOTH}", "either": f"{_ELL}+{_BOX}-2*{_BOTH}"})
def _(keep, a, b, c, d):
    """An L-shaped ring and a box."""
    w, h = F.abs(b.x) + 0.2, F.abs(b.y) + 0.2
    at = lambda p, x, y: G.point(p.x + x, p.y + y)
    z = F.lit(0.0)
    ell = keep(F.array(a, at(a, w, z), at(a, w, h / 2), at(a, w / 2, h / 2), at(a, w / 2, h), at(a, z, h)))
    x, y = F.abs(d.x) + 0.2, F.abs(d.y) + 0.2
    box = keep(F.array(c, at(c, x, z), at(c, x, y), at(c, z, y)))
    area = lambda kind: keep(P.made("double", lambda p, q: N.boolean_area(p, q, kind), ell, box))
    return {"shared": area("intersection"), "joined": area("union"), "left_over": area("difference"), "either": area("xor")}


def _slab(k: int, lo: str, hi: str) -> tuple[str, str]:
    u, v = f"(({lo}-c{k})/(d{k}-c{k}))", f"(({hi}-c{k})/(d{k}-c{k}))"
    return f"least({u}, {v})", f"greatest({u}, {v})"


_IN = " AND ".join(f"{p}{k} BETWEEN -0.5 AND 0.5" for p in "cd" for k in (1, 2))
_LOW, _HIGH = zip(_slab(1, "0.0", "0.5"), _slab(2, "0.0", "0.5"), strict=True)


@family("sight_in_ring", {"is_seen": f"{_IN} AND NOT greatest(0.0, {_LOW[0]}, {_LOW[1]}) < least(1.0, {_HIGH[0]}, {_HIGH[1]})", "is_clear": f"{_IN} AND NOT greatest(0.0, {_LOW[0]}, {_LOW[1]}) < least(1.0, {_HIGH[0]}, {_HIGH[1]})"})
def _(keep, a, b, c, d):
    """Inside an L, and inside a square with the missing corner as an obstacle."""
    corners = lambda *v: F.array(*(G.point(x, y) for x, y in v))
    ell = corners((-0.5, -0.5), (0.5, -0.5), (0.5, 0.0), (0.0, 0.0), (0.0, 0.5), (-0.5, 0.5))
    square, block = corners((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)), corners((0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5))
    ends = F.array(c, d)
    return {"is_seen": keep(P.made("boolean", lambda r, e: N.sees(r, *e), ell, ends)), "is_clear": keep(P.made("boolean", lambda r, o, e: N.sees(r, *e, [o]), square, block, ends))}


_SECOND = _CROSS.translate(str.maketrans("abcd", "bcda"))  # the other two edges
_TURN = {k: f"sign(({v[1]}1-{v[0]}1)*({v[2]}2-{v[1]}2)-({v[1]}2-{v[0]}2)*({v[2]}1-{v[1]}1))" for k, v in {"a": "dab", "b": "abc", "c": "bcd", "d": "cda"}.items()}
_SUM = "sign(a1*b2-b1*a2+b1*c2-c1*b2+c1*d2-d1*c2+d1*a2-a1*d2)"


@family("ring_faults", {
    "is_crossing": f"({_CROSS}) OR ({_SECOND})", "n_reflex": f"CASE WHEN ({_CROSS}) OR ({_SECOND}) THEN -1 ELSE ({' + '.join(f'({t} * {_SUM} < 0)::INTEGER' for t in _TURN.values())}) END", "n_parts": f"CASE WHEN ({_CROSS}) OR ({_SECOND}) THEN 2 ELSE 1 END",
    "is_short": "true", "area": "abs(a1*b2-b1*a2+b1*c2-c1*b2+c1*a2-a1*c2)/2", "center_x": "(a1+b1+c1)/3",
})
def _(keep, a, b, c, d):
    """Rings of four points: whether two edges cross, how many inner angles are above a half turn, and the simple rings they fall into."""
    ring = keep(F.array(a, b, c, d))
    crossing = keep(P.made("boolean", lambda p: N.faults(p)["crossing"], ring))
    keep(F.array(a, b, c), "ring")
    return {"is_crossing": crossing, "n_reflex": keep(P.made("int", lambda p: -1 if N.faults(p)["crossing"] else len(N.reflex_vertices(p)), ring)), "n_parts": keep(P.made("int", lambda p: len(O.repaired(p)), ring)),
            "is_short": keep(P.made("boolean", lambda p: N.faults(p)["too_few"], F.array(a, b))), "area": G.ring_area("ring"), "center_x": (a.x + b.x + c.x) / 3}


_HALF = [f"(abs({k})+0.05)" for k in ("b1", "b2")]


@family("collisions", {"is_hit": f"abs(a1-c1) <= {_HALF[0]}+0.2 AND abs(a2-c2) <= {_HALF[1]}+0.1", "difference": f"4*({_HALF[0]}+0.2)*({_HALF[1]}+0.1)"})
def _(keep, a, b, c, d):
    ring = lambda p, w, h: F.array(*(G.point(p.x + i * w, p.y + j * h) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))))
    one, two = keep(ring(a, F.abs(b.x) + 0.05, F.abs(b.y) + 0.05)), keep(ring(c, F.lit(0.2), F.lit(0.1)))
    return {"is_hit": keep(P.made("boolean", N.collide, one, two)), "difference": keep(P.made("double", lambda p, q: abs(K.signed_area(N.minkowski_difference(p, q))), one, two))}


_ANGLE = {k: f"(({v[1]}1-{v[0]}1)*({v[2]}2-{v[1]}2)-({v[1]}2-{v[0]}2)*({v[2]}1-{v[1]}1))" for k, v in {"a": "dab", "b": "abc", "c": "bcd", "d": "cda"}.items()}


@family("concave_rings", {
    "is_convex": f"least({', '.join(_ANGLE.values())}) > 0 OR greatest({', '.join(_ANGLE.values())}) < 0", "triangles": _ELL, "parts": _ELL, "n_triangles": "4", "seen_all": _ELL, "seen_part": f"0.65*{_LW}*{_LH}",
})
def _(keep, a, b, c, d):
    """Convexity of four-point rings; triangles, convex parts and visible areas of L-shaped rings, all or a part of which is seen."""
    keep(F.array(a, b, c, d), "ring")
    w, h = F.abs(b.x) + 0.2, F.abs(b.y) + 0.2
    at = lambda x, y: G.point(a.x + w * x, a.y + h * y)
    ell = keep(F.array(*(at(x, y) for x, y in ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)))))
    area = lambda p, t: abs(K.signed_area(p[list(t)]))
    seen = lambda x, y: keep(P.made("double", lambda p, e: V.visible_area([p], tuple(e[0])), ell, F.array(at(x, y))))
    return {"is_convex": G.ring_is_convex("ring"), "triangles": keep(P.made("double", lambda p: sum(area(p, t) for t in K.triangulate(p)), ell)), "parts": keep(P.made("double", lambda p: sum(area(p, t) for t in K.convex_parts(p)), ell)),
            "n_triangles": keep(P.made("int", lambda p: len(K.triangulate(p)), ell)), "seen_all": seen(0.25, 0.25), "seen_part": seen(0.25, 0.7)}


_AB = "sqrt((b1-a1)**2+(b2-a2)**2)"


@family("strokes", {"butt": f"0.1*{_AB}", "square": f"0.1*({_AB}+0.1)", "n_square": "8", "frame": "4*(abs(c1)+0.4+abs(c2)+0.4)*0.1"})
def _(keep, a, b, c, d):
    """Areas of thick segments, and of the frame of a box."""
    line = keep(F.array(a, b))
    area = lambda **o: keep(P.made("double", lambda p: abs(K.signed_area(N.stroked(p, 0.1, **o))), line))
    x, y = F.abs(c.x) + 0.4, F.abs(c.y) + 0.4
    box = keep(F.array(G.point(-x, -y), G.point(x, -y), G.point(x, y), G.point(-x, y)))
    return {"butt": area(), "square": area(cap="square"), "n_square": keep(P.made("int", lambda p: len(N.stroked(p, 0.1, cap="square")), line)), "frame": keep(P.made("double", lambda p: sum(K.signed_area(r) for r in O.stroked_ring(p, 0.1)), box))}


@query("voronoi_cells")  # held against the nearest site in tests
def voronoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the cells of each row's four points in the square around the origin."""
    e = F.col("e")
    sites = F.array(*(G.point(e[2 * k], e[2 * k + 1]) for k in range(4)))
    cells = points(spark, sf_dir).select("id", P.made("rings", lambda p: N.voronoi_cells(p, (-2.0, -2.0), (2.0, 2.0)), sites).alias("cells"))
    return cells.select("id", F.posexplode("cells").alias("site", "ring")).select("id", "site", F.round(G.ring_area("ring"), 6).alias("area"))
