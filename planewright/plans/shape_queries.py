"""Triangulations, skeletons, offsets, sums of concave rings, sight round obstacles, lengths of splines, hulls with ids, frames of groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewright.functions import conics as E
from planewright.functions import curve_kernels as C
from planewright.functions import decompose as D
from planewright.functions import geometry as G
from planewright.functions import kernels as K
from planewright.functions import overlay as O
from planewright.functions import polygon_kernels as N
from planewright.functions import sight as V
from planewright.functions import skeletons as S
from planewright.functions import spline_pieces as B
from planewright.operators import hulls as H
from planewright.operators import per_geometry as P
from planewright.operators.raster import field_with
from planewright.operators.tables import points, polylines, spread
from planewright.operators.triangulation import delaunay_triangles, edges_of, has_corner, voronoi_cells
from planewright.plans.kernel_queries import _LH, _LW, _SECOND, _SUM, _TURN
from planewright.plans.primitive_queries import _CROSS, family, squashed
from planewright.plans.queries import _HULL, W, r6
from planewright.plans.registry import ORACLES, query

# ------------------------------------------------------------------ triangulation

_INSIDE = "((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)) * (((a.x-d.x)**2+(a.y-d.y)**2)*((b.x-d.x)*(c.y-d.y)-(c.x-d.x)*(b.y-d.y)) - ((b.x-d.x)**2+(b.y-d.y)**2)*((a.x-d.x)*(c.y-d.y)-(c.x-d.x)*(a.y-d.y)) + ((c.x-d.x)**2+(c.y-d.y)**2)*((a.x-d.x)*(b.y-d.y)-(b.x-d.x)*(a.y-d.y))) > 0"


@query("delaunay_by_label", f"""{W} SELECT a.label, a.id AS a, CASE WHEN (b.x-a.x)*(c.y-a.y) > (b.y-a.y)*(c.x-a.x) THEN b.id ELSE c.id END AS b, CASE WHEN (b.x-a.x)*(c.y-a.y) > (b.y-a.y)*(c.x-a.x) THEN c.id ELSE b.id END AS c
 FROM pts a JOIN pts b ON a.label = b.label AND a.id < b.id JOIN pts c ON c.label = a.label AND b.id < c.id WHERE NOT EXISTS (SELECT 1 FROM pts d WHERE d.label = a.label AND d.id NOT IN (a.id, b.id, c.id) AND {_INSIDE})""")
def delaunay_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangles of each label's points."""
    return delaunay_triangles(points(spark, sf_dir), "label").select("label", "a", "b", "c")


@query("delaunay_edges", f"WITH t AS ({ORACLES['delaunay_by_label']}), e AS (SELECT DISTINCT label, unnest([{{'a': least(a, b), 'b': greatest(a, b)}}, {{'a': least(b, c), 'b': greatest(b, c)}}, {{'a': least(a, c), 'b': greatest(a, c)}}]) AS e FROM t) SELECT label, e.a AS a, e.b AS b, (SELECT count(*) FROM t WHERE t.label = e_.label AND (t.a = e.a OR t.b = e.a OR t.c = e.a)) AS n_around FROM e AS e_")
def delaunay_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each label's triangles, and how many triangles have an edge's lower end as a corner."""
    t = delaunay_triangles(points(spark, sf_dir), "label")
    e = edges_of(t, "label")
    around = e.select("label", F.col("a").alias("k")).distinct().join(t, "label").filter(has_corner(F.col("k"))).groupBy("label", "k").agg(F.count("*").alias("n_around"))
    return e.join(around.withColumnRenamed("k", "a"), ["label", "a"]).select("label", "a", "b", "n_around")


_BY = "((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x))*2"


@query("voronoi_vertices", f"""{W}, t AS (SELECT * FROM ({ORACLES['delaunay_by_label'].removeprefix(W)})),
 v AS (SELECT t.*, a.x + ((c.y-a.y)*((b.x-a.x)**2+(b.y-a.y)**2)-(b.y-a.y)*((c.x-a.x)**2+(c.y-a.y)**2))/({_BY}) AS x, a.y + ((b.x-a.x)*((c.x-a.x)**2+(c.y-a.y)**2)-(c.x-a.x)*((b.x-a.x)**2+(b.y-a.y)**2))/({_BY}) AS y FROM t JOIN pts a ON t.a = a.id JOIN pts b ON t.b = b.id JOIN pts c ON t.c = c.id)
 SELECT label, a, b, c, round(x/(1+abs(x)), 6) + 0.0 AS x, round(y/(1+abs(y)), 6) + 0.0 AS y FROM v""")
def voronoi_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the circles round each label's triangles, compared as x / (1 + |x|)."""
    t = delaunay_triangles(points(spark, sf_dir), "label")
    v = t.withColumn("v", G.circumcircle(*(G.point(F.col(f"{k}x"), F.col(f"{k}y")) for k in "abc")).center)
    return v.select("label", "a", "b", "c", squashed(F.col("v.x")).alias("x"), squashed(F.col("v.y")).alias("y"))


_ALL = _HULL.replace("SELECT a.label, a.id", "SELECT 0 AS label, a.id").replace("ON a.label = b.label AND ", "ON ").replace("WHERE c.label = a.label AND ", "WHERE ")


@query("delaunay_of_all", f"{_ALL} SELECT (SELECT 2 * count(DISTINCT (x, y)) - 2 FROM pts) - count(*) AS n_triangles, round(sum(x0*y1-x1*y0)/2, 5) AS area FROM edge")
def delaunay_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points as one group, on tiles: as many triangles as there must be, which cover the hull."""
    t = delaunay_triangles(points(spark, sf_dir).withColumn("all", F.lit(1)), "all", tile=200)
    area = ((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2
    return t.agg(F.count("*").alias("n_triangles"), F.round(F.sum(area), 5).alias("area"))


@query("voronoi_by_label", f"{W}, g AS (SELECT i, j, -0.45 + 0.1003 * i AS gx, -0.43 + 0.0997 * j AS gy FROM range(10) a(i), range(10) b(j)) SELECT label, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, arg_min(id, (x-gx)**2+(y-gy)**2) AS id FROM pts, g GROUP BY 1, 2, 3")
def voronoi_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of each label's diagram in which each of a hundred places lies: that of the nearest point."""
    cells = voronoi_cells(points(spark, sf_dir), "label", (-2.0, -2.0), (2.0, 2.0))
    x, y = -0.45 + 0.1003 * F.col("i"), -0.43 + 0.0997 * F.col("j")
    steps = F.sequence(F.lit(0), F.lit(9))
    at = cells.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).withColumn("q", G.point(x, y))
    return at.filter(G.ring_contains("ring", "q")).select("label", "i", "j", "id")


@family("circle_tests", {"is_inside": "sign((b1-a1)*(c2-a2)-(b2-a2)*(c1-a1)) * (((a1-d1)**2+(a2-d2)**2)*((b1-d1)*(c2-d2)-(c1-d1)*(b2-d2)) - ((b1-d1)**2+(b2-d2)**2)*((a1-d1)*(c2-d2)-(c1-d1)*(a2-d2)) + ((c1-d1)**2+(c2-d2)**2)*((a1-d1)*(b2-d2)-(b1-d1)*(a2-d2))) > 0", "mean_x": "(a1+b1+c1)/3", "mean_y": "(a2+b2+c2)/3"})
def _(keep, a, b, c, d):
    """Whether the fourth point lies inside the circle round the first three, and their centre of mass."""
    middle = keep(G.triangle_centroid(a, b, c))
    return {"is_inside": G.in_circumcircle(d, a, b, c), "mean_x": middle.x, "mean_y": middle.y}


# ------------------------------------------------------------------ hulls and frames of groups


@query("hull_ids", f"{_HULL} SELECT label, id FROM edge")
def hull_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of each label's points are its hull's corners."""
    return H.hulls(points(spark, sf_dir), "label", pid="id").select("label", F.explode("ids").alias("id"))


@query("points_in_hulls", f"{_HULL} SELECT e.label, p.id FROM edge e JOIN pts p ON p.label = e.label + 1 GROUP BY 1, 2 HAVING min((x1-x0)*(p.y-y0)-(y1-y0)*(p.x-x0)) >= 0")
def points_in_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the next label that lie in each label's hull."""
    h = H.hulls(points(spark, sf_dir), "label")
    p = points(spark, sf_dir).select((F.col("label") - 1).alias("label"), "id", "p")
    return h.join(p, "label").filter(H.in_hull("ring", "p")).select("label", "id")


_FRAME = f"""{W}, m AS (SELECT label, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS k, var_pop(x) AS sx, var_pop(y) AS sy FROM pts GROUP BY 1),
 f AS (SELECT label, mx, my, atan2(k, (sx+sy+sqrt((sx-sy)**2+4*k*k))/2 - sy) AS t FROM m),
 e AS (SELECT label, mx, my, t, min((x-mx)*cos(t)+(y-my)*sin(t)) AS u0, max((x-mx)*cos(t)+(y-my)*sin(t)) AS u1, min((y-my)*cos(t)-(x-mx)*sin(t)) AS v0, max((y-my)*cos(t)-(x-mx)*sin(t)) AS v1 FROM pts JOIN f USING (label) GROUP BY ALL)"""


@query("obb_principal", f"{_FRAME} SELECT label, round(mx+(u0+u1)/2*cos(t)-(v0+v1)/2*sin(t), 6) + 0.0 AS x, round(my+(u0+u1)/2*sin(t)+(v0+v1)/2*cos(t), 6) + 0.0 AS y, round((u1-u0)/2, 6) AS half_width, round((v1-v0)/2, 6) AS half_height, round(t, 6) + 0.0 AS angle FROM e")
def obb_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = H.principal_boxes(points(spark, sf_dir), "label")
    return b.select("label", r6(F.col("center.x")).alias("x"), r6(F.col("center.y")).alias("y"), r6(F.col("half_width")).alias("half_width"), r6(F.col("half_height")).alias("half_height"), r6(F.col("angle")).alias("angle"))


@query("capsule_principal", f"{_FRAME} SELECT label, round(mx+u0*cos(t), 6) + 0.0 AS x0, round(my+u0*sin(t), 6) + 0.0 AS y0, round(mx+u1*cos(t), 6) + 0.0 AS x1, round(my+u1*sin(t), 6) + 0.0 AS y1, round(greatest(abs(v0), abs(v1)), 6) AS radius FROM e")
def capsule_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = H.principal_capsules(points(spark, sf_dir), "label")
    return c.select("label", *(r6(F.col(f"{end}.{f}")).alias(f"{f}{k}") for k, end in enumerate(("start", "end")) for f in "xy"), r6(F.col("radius")).alias("radius"))


@query("capsule_diameter", f"""{W}, d AS (SELECT a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, row_number() OVER (PARTITION BY a.label ORDER BY (a.x-b.x)**2+(a.y-b.y)**2 DESC) AS r FROM pts a JOIN pts b ON a.label = b.label AND a.id < b.id),
 t AS (SELECT d.*, x, y, greatest(0.0, least(1.0, ((x-ax)*(bx-ax)+(y-ay)*(by_-ay))/((bx-ax)**2+(by_-ay)**2))) AS t FROM d JOIN pts USING (label) WHERE r = 1)
 SELECT label, round(max(sqrt((bx-ax)**2+(by_-ay)**2)), 6) AS length, round(max(sqrt((ax+(bx-ax)*t-x)**2+(ay+(by_-ay)*t-y)**2)), 6) AS radius FROM t GROUP BY 1""")
def capsule_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = H.diameter_capsules(points(spark, sf_dir), "label")
    return c.select("label", r6(G.distance(F.col("start"), F.col("end"))).alias("length"), r6(F.col("radius")).alias("radius"))


# ------------------------------------------------------------------ ellipses and circles

_GAP = "sqrt((a1-c1)**2+(a2-c2)**2)"
_ONE, _TWO = "(abs(b1)+0.1)", "(abs(d1)+0.1)"


@family("round_ellipses", {"n_crossings": f"CASE WHEN {_GAP} < {_ONE}+{_TWO} AND {_GAP} > abs({_ONE}-{_TWO}) THEN 2 ELSE 0 END", "is_met": f"{_GAP} <= {_ONE}+{_TWO}", "is_far": f"{_GAP} > {_ONE}+{_TWO}"})
def _(keep, a, b, c, d):
    """Ellipses that happen to be round against circles: crossings, and whether the areas meet."""
    e, o = keep(E.ellipse(a, F.abs(b.x) + 0.1, F.abs(b.x) + 0.1, d.y)), keep(G.circle(c, F.abs(d.x) + 0.1))
    n = keep(F.size(E.ellipse_circle(e, o, 1024)))
    met = keep(E.ellipses_meet(e, E.ellipse_of_circle(o), 1024))
    return {"n_crossings": n, "is_met": met, "is_far": ~met}


@family("edited_fields", {"changed": "b1", "other": "1.0", "outside": "1.0"})
def _(keep, a, b, c, d):
    """A field with another value in one cell, and in one that isn't there."""
    plain = F.array_repeat(F.lit(1.0), 12)
    one, none = keep(field_with(plain, 4, 1, 2, b.x)), keep(field_with(plain, 4, 7, 1, b.x))
    return {"changed": one[9], "other": one[8], "outside": F.array_max(none)}


# ------------------------------------------------------------------ rings


def _ell(a, b):
    w, h = F.abs(b.x) + 0.2, F.abs(b.y) + 0.2
    at = lambda x, y: G.point(a.x + w * x, a.y + h * y)
    return F.array(*(at(x, y) for x, y in ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))))


_IN = lambda d: f"(greatest(0, {_LW}/2-2*{d})*greatest(0, {_LH}-2*{d})+greatest(0, {_LW}-2*{d})*greatest(0, {_LH}/2-2*{d})-greatest(0, {_LW}/2-2*{d})*greatest(0, {_LH}/2-2*{d}))"
_GROWN = lambda d: f"(({_LW}+2*{d})*({_LH}+2*{d})-({_LW}*{_LH}/4))"


@family("offsets_of_ells", {"narrow": _IN("0.04"), "wide": _IN("0.12"), "gone": "0", "grown": _GROWN("0.1"), "cut": f"{_GROWN('0.1')}-0.5*0.01", "round": f"{_LW}*{_LH}*0.75+0.1*2*({_LW}+{_LH})+5*18*0.5*0.01*sin(pi()/36)-0.01", "frame": f"{_GROWN('0.04')}-{_IN('0.04')}"}, heavy=True)
def _(keep, a, b, c, d):
    """L-shaped rings moved in, past what they hold, and out with mitred, cut and round corners; and drawn with a width."""
    ell = keep(_ell(a, b))
    area = lambda fn: keep(P.made("double", fn, ell))
    return {"narrow": area(lambda p: O.area(O.offset(p, -0.04))), "wide": area(lambda p: O.area(O.offset(p, -0.12))), "gone": area(lambda p: O.area(O.offset(p, -5.0))), "grown": area(lambda p: O.area(O.offset(p, 0.1))),
            "cut": area(lambda p: O.area(O.offset(p, 0.1, "bevel")) + 0.02), "round": area(lambda p: O.area(O.offset(p, 0.1, "round", tolerance=1e-4))), "frame": area(lambda p: O.area(O.stroked_ring(p, 0.08)))}


@family("sums_of_ells", {"area": f"({_LW}+abs(c1)+0.1)*({_LH}/2+abs(c2)+0.1)+({_LW}/2+abs(c1)+0.1)*({_LH}+abs(c2)+0.1)-({_LW}/2+abs(c1)+0.1)*({_LH}/2+abs(c2)+0.1)", "doubled": f"13/4.0::DOUBLE*{_LW}*{_LH}", "n_rings": "1"}, heavy=True)
def _(keep, a, b, c, d):
    """Minkowski sums of L-shaped rings with a box and with themselves."""
    ell = keep(_ell(a, b))
    x, y, z = F.abs(c.x) + 0.1, F.abs(c.y) + 0.1, F.lit(0.0)
    box = keep(F.array(G.point(z, z), G.point(x, z), G.point(x, y), G.point(z, y)))
    return {"area": keep(P.made("double", lambda p, q: O.area(O.minkowski(p, q)), ell, box)), "doubled": keep(P.made("double", lambda p: O.area(O.minkowski(p, p)), ell)), "n_rings": keep(P.made("int", lambda p, q: len(O.minkowski(p, q)), ell, box))}


_NEAR, _SLOPE = "(0.2+0.3*abs(a1)/(1+abs(a1)))", "(abs(b1)/(1+abs(b1))+0.01)"


@family("sight_with_obstacles", {"area": f"4-{_SLOPE}*(1-{_NEAR}**2)", "twice": f"4-2*{_SLOPE}*(1-{_NEAR}**2)", "whole": "4"}, heavy=True)
def _(keep, a, b, c, d):
    """What the middle of a square sees round a block, round two of them, and round none."""
    near, slope = 0.2 + 0.3 * F.abs(a.x) / (1 + F.abs(a.x)), F.abs(b.x) / (1 + F.abs(b.x)) + 0.01
    half, far = near * slope, (1 + near) / 2
    square = keep(F.array(*(G.point(F.lit(x), F.lit(y)) for x, y in ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)))))
    block = keep(F.array(G.point(near, -half), G.point(far, -half), G.point(far, half), G.point(near, half)))
    area = lambda n: keep(P.made("double", lambda p, q: V.visible_area([p, q, -q][:n], (0.0, 0.0)), square, block))
    return {"area": area(2), "twice": area(3), "whole": area(1)}


_LONG, _SHORT = "(greatest(abs(a1), abs(b1)+0.1)+0.2)", "(least(abs(a1), abs(b1)+0.1)+0.1)"


@family("skeletons_of_boxes", {"length": f"2*sqrt(2::DOUBLE)*{_SHORT}+{_LONG}-{_SHORT}", "height": f"{_SHORT}/2", "n_nodes": "6", "ridge": f"{_LONG}-{_SHORT}", "side": f"{_SHORT}*{_SHORT}/4", "n_arcs": "1"}, heavy=True)
def _(keep, a, b, c, d):
    """Straight skeletons of boxes: a ridge and four ways to the corners; the pruned one is the ridge."""
    u, v, z = F.greatest(F.abs(a.x), F.abs(b.x) + 0.1) + 0.2, F.least(F.abs(a.x), F.abs(b.x) + 0.1) + 0.1, F.lit(0.0)
    box = keep(F.array(G.point(z, z), G.point(u, z), G.point(u, v), G.point(z, v)))
    of = lambda fn, kind="double": keep(P.made(kind, lambda p: fn(S.straight_skeleton(p)), box))
    ridge = lambda s: S.Skeleton(s.nodes, s.arcs[(s.arcs >= 4).all(1)])
    return {"length": of(lambda s: s.length()), "height": of(lambda s: s.nodes[:, 2].max()), "n_nodes": of(lambda s: len(s.nodes), "int"), "ridge": of(lambda s: ridge(s).length()), "side": keep(P.made("double", lambda p: S.face_areas(p, S.straight_skeleton(p))[1], box)), "n_arcs": of(lambda s: len(ridge(s).arcs), "int")}


_SWEPT = f"""{W}, c AS (SELECT user_id, avg(x) AS cx, avg(y) AS cy FROM traj GROUP BY 1), t AS (SELECT user_id, x, y, atan2(y-cy, x-cx) AS t, idx FROM traj JOIN c USING (user_id)),
 v AS (SELECT user_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM t WINDOW w AS (PARTITION BY user_id ORDER BY t, idx))"""


def _rings_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's points in order round their mean: concave rings that don't cross themselves."""

    def swept(p: np.ndarray) -> np.ndarray:
        c = p.mean(0)
        return p[np.argsort(np.arctan2(p[:, 1] - c[1], p[:, 0] - c[0]), kind="stable")]

    return spread(polylines(spark, sf_dir)).select("user_id", P.made("points", swept, "line").alias("ring"))


@query("skeletons_of_users", f"{_SWEPT} SELECT user_id, count(*) AS n_corners, round(sum(x*ny-nx*y)/2 / 1000, 4) AS swept, true AS is_tree FROM v GROUP BY 1")
def skeletons_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight skeletons of users' concave rings: the parts that their edges sweep make up the ring."""

    def measures(p: np.ndarray) -> tuple[float, float]:
        s = S.straight_skeleton(p)
        return S.face_areas(p, s).sum(), len(s.arcs) == len(s.nodes) - 1

    s = _rings_of_users(spark, sf_dir).select("user_id", F.size("ring").cast("long").alias("n_corners"), P.measured("ring", measures, ["swept", "tree"]).alias("m"))
    return s.select("user_id", "n_corners", F.round(F.col("m.swept") / 1000, 4).alias("swept"), (F.col("m.tree") > 0).alias("is_tree"))


@query("medial_axes_of_users")  # circles inside the ring, held against the boundary in tests
def medial_axes_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medial axes of users' rings from samples twenty units apart, without loose arcs below ten units."""


    def measures(p: np.ndarray) -> tuple[float, float, float]:
        s = S.medial_axis(p, 20.0, 10.0)
        return len(s.nodes), s.length(), float(s.nodes[:, 2].max(initial=0))

    a = _rings_of_users(spark, sf_dir).select("user_id", P.measured("ring", measures, ["n_nodes", "length", "radius"]).alias("a"))
    return a.select("user_id", F.col("a.n_nodes").cast("long").alias("n_nodes"), F.round("a.length", 3).alias("length"), F.round("a.radius", 3).alias("radius"))


@family("fewest_parts", {"n_parts": f"CASE WHEN ({_CROSS}) OR ({_SECOND}) THEN -1 WHEN {' + '.join(f'({t} * {_SUM} < 0)::INTEGER' for t in _TURN.values())} = 0 THEN 1 ELSE 2 END", "n_ell": "2", "area": f"0.75*{_LW}*{_LH}"}, heavy=True)
def _(keep, a, b, c, d):
    """Convex decompositions of four-point and L-shaped rings with the fewest parts."""
    ring, ell = keep(F.array(a, b, c, d)), keep(_ell(a, b))
    return {"n_parts": keep(P.made("int", lambda p: -1 if N.faults(p)["crossing"] else len(D.fewest_convex_parts(p)), ring)), "n_ell": keep(P.made("int", lambda p: len(D.fewest_convex_parts(p)), ell)), "area": keep(P.made("double", lambda p: sum(K.signed_area(p[x]) for x in D.fewest_convex_parts(p)), ell))}


# ------------------------------------------------------------------ splines


def _curve(p: str, q: str, r: str) -> str:
    """SQL: length of the quadratic curve of three points, each a pattern in the coordinate's number {k}, from the antiderivative of its speed."""
    u = [f"({q.format(k=k)}-({p.format(k=k)}))" for k in (1, 2)]
    v = [f"(({r.format(k=k)})-2*({q.format(k=k)})+({p.format(k=k)}))" for k in (1, 2)]
    a, b, c = f"(4*({v[0]}**2+{v[1]}**2))", f"(8*({u[0]}*{v[0]}+{u[1]}*{v[1]}))", f"(4*({u[0]}**2+{u[1]}**2))"
    at = lambda t: f"((2*{a}*{t}+{b})/(4*{a})*sqrt({a}*{t}+{b}*{t}+{c})+(4*{a}*{c}-{b}**2)/(8*{a}*sqrt({a}))*ln(abs(2*{a}*{t}+{b}+2*sqrt({a}*({a}*{t}+{b}*{t}+{c})))))"
    return f"({at(1)}-{at(0)})"


def _end(fn: str, p: str, q: str, r: str) -> str:
    """SQL: the least or greatest coordinate of such a curve."""
    t = f"greatest(0.0, least(1.0, (({p})-({q}))/nullif(({p})-2*({q})+({r}), 0)))"
    return f"{fn}({p}, {r}, (1-{t})**2*({p})+2*(1-{t})*{t}*({q})+{t}**2*({r}))"


_MID = "(b{k}+c{k})/2"
_LENGTH = f"{_curve('a{k}', 'b{k}', _MID)}+{_curve(_MID, 'c{k}', 'd{k}')}"
_LOW = f"least({_end('least', 'a1', 'b1', '(b1+c1)/2')}, {_end('least', '(b1+c1)/2', 'c1', 'd1')})"
_HIGH = f"greatest({_end('greatest', 'a2', 'b2', '(b2+c2)/2')}, {_end('greatest', '(b2+c2)/2', 'c2', 'd2')})"


@family("spline_lengths", {"length": _LENGTH, "low_x": _LOW, "high_y": _HIGH, "control_x": "least(a1, b1, c1, d1)", "n_pieces": "2", "slope_x": "2*(c1-b1)*0.7::DOUBLE+2*(d1-c1)*0.3::DOUBLE-(c1-b1)*0.7::DOUBLE", "straight": "sqrt((b1-a1)**2+(b2-a2)**2)+sqrt((c1-b1)**2+(c2-b2)**2)+sqrt((d1-c1)**2+(d2-c2)**2)", "n_out": "1", "turned": "pi()/2"}, heavy=True)
def _(keep, a, b, c, d):
    """Open quadratic splines of four points as two Bezier curves; lengths of a line's and of a quarter circle's spline."""
    p = keep(F.array(a, b, c, d))
    chain = lambda p: B.pieces(p, 2, C.open_knots(4, 2))
    of = lambda fn, kind="double": keep(P.made(kind, fn, p))
    return {"length": of(lambda p: B.arc_length(chain(p)[0])), "low_x": of(lambda p: B.tight_bounds(chain(p)[0])[0]), "high_y": of(lambda p: B.tight_bounds(chain(p)[0])[3]), "control_x": of(lambda p: B.bounds(p[None])[0]), "n_pieces": of(lambda p: len(chain(p)[0]), "int"),
            "slope_x": of(lambda p: B.tangent_at(*chain(p), 1.3)[0]), "straight": of(lambda p: B.arc_length(B.pieces(p, 1, C.open_knots(4, 1))[0])), "n_out": of(lambda p: int(B.try_at(*chain(p), 2.5) is None), "int"), "turned": of(lambda p: B.arc_length(B.pieces(*(lambda q, k, w: (q, 2, k, w))(*C.rational_arc(0, np.pi / 2)))[0]))}


@query("cleaned_lines")  # the kernel is tested against its definition
def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' lines without short steps and points nearly on a line; and as rings, whose last point isn't near the first."""
    t = polylines(spark, sf_dir).withColumn("kept", P.indexes("line", "cleaned", eps=30.0, straight=20.0)).withColumn("ring", P.indexes("line", "drop_repeats_in_ring", eps=60.0))
    return t.select("user_id", F.size("line").alias("n_points"), F.size("kept").alias("n_kept"), F.size("ring").alias("n_ring"), "kept")
