"""Geometry queries over the driver's tables, each with its DuckDB twin where SQL can state it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planewright.functions import geometry as G
from planewright.functions import overlay as O
from planewright.operators import circles as X
from planewright.operators import per_geometry as P
from planewright.operators import neighbours as B
from planewright.operators import spatial as S
from planewright.operators.hulls import hulls
from planewright.operators.tables import SQL, points, polylines, read, spread, trajectories
from planewright.operators.triangulation import delaunay_triangles
from planewright.plans.registry import query

W = f"WITH {SQL}"


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _e(*k: int) -> Column:
    return G.point(F.col("e")[k[0]], F.col("e")[k[1]])


# ------------------------------------------------------------------ flagship and primitives


@query(
    "trajectory_summary",
    f"""{W.replace('WITH', 'WITH RECURSIVE')},
 seg AS (SELECT user_id, idx, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
 base AS (SELECT user_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n, max(idx) AS last FROM traj GROUP BY 1),
 len AS (SELECT user_id, sum(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y))) AS l FROM seg WHERE nx IS NOT NULL GROUP BY 1),
 cuts AS (SELECT user_id, 0 AS a, last AS b FROM base
  UNION ALL
  SELECT k.user_id, CASE h WHEN 0 THEN k.a ELSE k.i END, CASE h WHEN 0 THEN k.i ELSE k.b END FROM (
   SELECT c.user_id, c.a, c.b, arg_max(t.idx, {{'d': d, 'i': -t.idx}}) AS i FROM cuts c
   JOIN traj p ON p.user_id = c.user_id AND p.idx = c.a JOIN traj q ON q.user_id = c.user_id AND q.idx = c.b
   JOIN traj t ON t.user_id = c.user_id AND t.idx > c.a AND t.idx < c.b,
   LATERAL (SELECT greatest(0.0, least(1.0, ((t.x - p.x) * (q.x - p.x) + (t.y - p.y) * (q.y - p.y)) / ((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)))) AS s),
   LATERAL (SELECT sqrt((t.x - p.x - s * (q.x - p.x)) * (t.x - p.x - s * (q.x - p.x)) + (t.y - p.y - s * (q.y - p.y)) * (t.y - p.y - s * (q.y - p.y))) AS d)
   GROUP BY c.user_id, c.a, c.b HAVING max(d) > 50) k, (VALUES (0), (1)) v(h)),
 kept AS (SELECT user_id, count(DISTINCT i) AS k FROM (SELECT user_id, a AS i FROM cuts UNION ALL SELECT user_id, b FROM cuts) GROUP BY 1)
 SELECT b.user_id, n AS n_points, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(max_x, 6) AS max_x, round(max_y, 6) AS max_y, round(l, 4) AS length, k AS n_kept FROM base b JOIN len USING (user_id) JOIN kept USING (user_id)""",
)
def trajectory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = polylines(spark, sf_dir).withColumn("kept", P.indexes("line", "douglas_peucker", eps=50.0))
    low = lambda f: F.array_min(F.transform("line", lambda p: p[f]))
    high = lambda f: F.array_max(F.transform("line", lambda p: p[f]))
    return t.select("user_id", F.size("line").cast("long").alias("n_points"), r6(low("x")).alias("min_x"), r6(low("y")).alias("min_y"), r6(high("x")).alias("max_x"), r6(high("y")).alias("max_y"), F.round(G.ring_perimeter("line", closed=False), 4).alias("length"), F.size("kept").cast("long").alias("n_kept"))


@query("point_measures", f"""{W} SELECT id, round(sqrt((e[1]-e[3])**2 + (e[2]-e[4])**2), 6) AS distance, round((e[1]+e[3])/2, 6) AS mid_x, round(e[1]+(e[3]-e[1])*0.25, 6) AS lerp_x,
 round(e[1]*e[4]-e[2]*e[3], 6) + 0.0 AS crossed, round(e[1]*e[3]+e[2]*e[4], 6) + 0.0 AS dotted, round(atan2(e[1]*e[4]-e[2]*e[3], e[1]*e[3]+e[2]*e[4]), 6) + 0.0 AS angle, round(e[1]*cos(0.5)-e[2]*sin(0.5), 6) + 0.0 AS turned_x FROM pts""")
def point_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _e(0, 1), _e(2, 3)
    return points(spark, sf_dir).select("id", r6(G.distance(a, b)).alias("distance"), F.round(G.midpoint(a, b).x, 6).alias("mid_x"), F.round(G.lerp(a, b, 0.25).x, 6).alias("lerp_x"), r6(G.cross(a, b)).alias("crossed"), r6(G.dot(a, b)).alias("dotted"), r6(G.angle_between(a, b)).alias("angle"), r6(G.rotated(a, 0.5).x).alias("turned_x"))


@query("segment_closest_point", f"""{W}, s AS (SELECT id, e, greatest(0.0, least(1.0, ((e[5]-e[1])*(e[3]-e[1])+(e[6]-e[2])*(e[4]-e[2]))/((e[3]-e[1])**2+(e[4]-e[2])**2))) AS t FROM pts)
 SELECT id, round(t, 6) + 0.0 AS t, round(e[1]+(e[3]-e[1])*t, 6) + 0.0 AS x, round(e[2]+(e[4]-e[2])*t, 6) + 0.0 AS y, round(sqrt((e[1]+(e[3]-e[1])*t-e[5])**2+(e[2]+(e[4]-e[2])*t-e[6])**2), 6) AS d FROM s""")
def segment_closest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = G.segment(_e(0, 1), _e(2, 3)), _e(4, 5)
    c = G.closest_on_segment(s, p)
    return points(spark, sf_dir).select("id", r6(G.segment_parameter(s, p)).alias("t"), r6(c.x).alias("x"), r6(c.y).alias("y"), r6(G.segment_point_distance(s, p)).alias("d"))


@query("line_intersections", f"""{W}, s AS (SELECT id, e, (e[3]-e[1])*(e[8]-e[6])-(e[4]-e[2])*(e[7]-e[5]) AS k FROM pts), c AS (SELECT id, ((e[5]-e[1])*(e[8]-e[6])-(e[6]-e[2])*(e[7]-e[5]))/k AS t, ((e[5]-e[1])*(e[4]-e[2])-(e[6]-e[2])*(e[3]-e[1]))/k AS u FROM s)
 SELECT id, round(t/(1+abs(t)), 6) + 0.0 AS t, round(u/(1+abs(u)), 6) + 0.0 AS u FROM c""")
def line_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row; far crossings are compared as x / (1 + |x|), parallel lines have null."""
    c = G.line_crossing(G.segment(_e(0, 1), _e(2, 3)), G.segment(_e(4, 5), _e(6, 7)))
    return points(spark, sf_dir).select("id", r6(c.t / (1 + F.abs(c.t))).alias("t"), r6(c.u / (1 + F.abs(c.u))).alias("u"))


@query("orient2d", f"""{W}, s AS (SELECT id, (e[3]-e[1])*(e[6]-e[2])-(e[4]-e[2])*(e[5]-e[1]) AS k FROM pts) SELECT CASE WHEN k > 0.01 THEN 'ccw' WHEN k < -0.01 THEN 'cw' ELSE 'collinear' END AS turn, count(*) AS n FROM s GROUP BY 1""")
def orient2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy(G.orientation(_e(0, 1), _e(2, 3), _e(4, 5), 0.01).alias("turn")).agg(F.count("*").alias("n"))


@query("circle_pairs", f"""{W}, c AS (SELECT id, x, y, abs(e[3]) + 0.05 AS r FROM pts)
 SELECT a.id AS a, b.id AS b, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2) - a.r - b.r, 6) AS gap FROM c a JOIN c b ON a.id < b.id WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2) <= a.r + b.r""")
def circle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circle_overlaps(spark, sf_dir)


@query("circle_overlaps", f"""{W}, c AS (SELECT id, x, y, abs(e[3]) + 0.05 AS r FROM pts)
 SELECT a.id AS a, b.id AS b, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2) - a.r - b.r, 6) AS gap FROM c a JOIN c b ON a.id < b.id WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2) <= a.r + b.r""")
def circle_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of circles that overlap, however far apart their centers are."""
    c = points(spark, sf_dir).select("id", G.circle(F.col("p"), F.abs(F.col("e")[2]) + 0.05).alias("c"))
    return X.overlapping(c, c, ordered=True).select("a", "b", F.round("gap", 6).alias("gap"))


@query("circumcircles", f"""{W}, s AS (SELECT id, e, 2*((e[3]-e[1])*(e[6]-e[2])-(e[4]-e[2])*(e[5]-e[1])) AS k, (e[3]-e[1])**2+(e[4]-e[2])**2 AS bb, (e[5]-e[1])**2+(e[6]-e[2])**2 AS cc FROM pts), r AS (SELECT id, sqrt((((e[6]-e[2])*bb-(e[4]-e[2])*cc)/k)**2 + (((e[3]-e[1])*cc-(e[5]-e[1])*bb)/k)**2) AS r FROM s)
 SELECT id, round(r/(1+r), 6) AS radius FROM r""")
def circumcircles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row, compared as x / (1 + x); null on a line."""
    r = G.circumcircle(_e(0, 1), _e(2, 3), _e(4, 5)).radius
    return points(spark, sf_dir).select("id", F.round(r / (1 + r), 6).alias("radius"))


@query("affine_round_trip", f"{W} SELECT id, round(2*x - 0.5*y + 1, 6) + 0.0 AS u, round(0.25*x + 1.5*y - 2, 6) + 0.0 AS v, round(x, 6) + 0.0 AS back_x, round(y, 6) + 0.0 AS back_y FROM pts")
def affine_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.affine(*(F.lit(v) for v in (2.0, -0.5, 0.25, 1.5, 1.0, -2.0)))
    moved = points(spark, sf_dir).select("id", G.affine_apply(m, F.col("p")).alias("m"))
    back = G.affine_apply(G.affine_inverse(m), F.col("m"))
    return moved.select("id", r6(F.col("m.x")).alias("u"), r6(F.col("m.y")).alias("v"), r6(back.x).alias("back_x"), r6(back.y).alias("back_y"))


@query("ellipse_contains", f"""{W}, q AS (SELECT id, label, x*cos(0.3)+y*sin(0.3) AS u, -x*sin(0.3)+y*cos(0.3) AS v FROM pts) SELECT label, count(*) FILTER ((u/0.2)**2 + (v/0.1)**2 <= 1) AS inside, count(*) AS n FROM q GROUP BY 1""")
def ellipse_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = G.ellipse_contains(G.point(0, 0), F.lit(0.2), F.lit(0.1), F.lit(0.3), F.col("p"))
    return points(spark, sf_dir).groupBy("label").agg(F.count_if(inside).alias("inside"), F.count("*").alias("n"))


# ------------------------------------------------------------------ bounds and hulls


@query("aabb_per_flag", "SELECT l_returnflag, min(l_quantity) AS min_x, min(l_extendedprice) AS min_y, max(l_quantity) AS max_x, max(l_extendedprice) AS max_y, round((max(l_quantity)-min(l_quantity))*(max(l_extendedprice)-min(l_extendedprice)), 4) AS area FROM lineitem GROUP BY 1")
def aabb_per_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", G.point(F.col("l_quantity"), F.col("l_extendedprice")).alias("p"))
    boxes = rows.groupBy("l_returnflag").agg(G.box_of("p").alias("b"))
    return boxes.select("l_returnflag", "b.*", F.round(G.box_area(F.col("b")), 4).alias("area"))


@query("principal_axis", """WITH p AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) SELECT l_returnflag, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 4) AS angle FROM p GROUP BY 1""")
def principal_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    angle = 0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y"))
    return p.groupBy("l_returnflag").agg(F.round(F.avg("x"), 4).alias("mean_x"), F.round(F.avg("y"), 4).alias("mean_y"), F.round(angle, 4).alias("angle"))


@query("point_in_box_join", f"""{W}, b AS (SELECT id AS box_id, least(e[1],e[3]) AS x0, greatest(e[1],e[3]) AS x1, least(e[2],e[4]) AS y0, greatest(e[2],e[4]) AS y1 FROM pts)
 SELECT box_id, count(*) AS n, min(id) AS first_id FROM b JOIN pts ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1""")
def point_in_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    e = lambda k: F.col("e")[k]
    b = p.select(F.col("id").alias("box_id"), G.box(F.least(e(0), e(2)), F.least(e(1), e(3)), F.greatest(e(0), e(2)), F.greatest(e(1), e(3))).alias("b"))
    return S.in_boxes(b, p.select("id", "p")).groupBy("box_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", "label", F.col("p.x").alias("x"), F.col("p.y").alias("y")).groupBy("label").agg(G.line_from_rows("id", "x", "y").alias("line"))


_HULL = f"""{W}, edge AS (SELECT a.label, a.id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM pts a JOIN pts b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)
 WHERE NOT EXISTS (SELECT 1 FROM pts c WHERE c.label = a.label AND (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) < 0))"""


@query("hull_area_perimeter", f"{_HULL} SELECT label, count(*) AS n_vertices, round(sum(x0*y1-x1*y0)/2, 5) AS area, round(sum(sqrt((x1-x0)**2+(y1-y0)**2)), 5) AS perimeter FROM edge GROUP BY 1")
def hull_area_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hull_rings(spark, sf_dir)
    return h.select("label", F.size("ring").cast("long").alias("n_vertices"), F.round(G.ring_area("ring"), 5).alias("area"), F.round(G.ring_perimeter("ring"), 5).alias("perimeter"))


@query("min_enclosing_circle", f"""{W}, two AS (SELECT a.label, (a.x+b.x)/2 AS x, (a.y+b.y)/2 AS y, ((a.x-b.x)**2+(a.y-b.y)**2)/4 AS r2 FROM edge_points a JOIN edge_points b ON a.label = b.label AND a.id < b.id),
 k AS (SELECT a.label, a.x AS ax, a.y AS ay, b.x-a.x AS bx, b.y-a.y AS by_, c.x-a.x AS cx, c.y-a.y AS cy, 2*((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)) AS d FROM edge_points a JOIN edge_points b ON a.label = b.label AND a.id < b.id JOIN edge_points c ON a.label = c.label AND b.id < c.id),
 three AS (SELECT label, ax + (cy*(bx*bx+by_*by_)-by_*(cx*cx+cy*cy))/d AS x, ay + (bx*(cx*cx+cy*cy)-cx*(bx*bx+by_*by_))/d AS y, ((cy*(bx*bx+by_*by_)-by_*(cx*cx+cy*cy))/d)**2+((bx*(cx*cx+cy*cy)-cx*(bx*bx+by_*by_))/d)**2 AS r2 FROM k WHERE d <> 0),
 every AS (SELECT * FROM two UNION ALL SELECT * FROM three), fits AS (SELECT e.label, e.x, e.y, e.r2 FROM every e WHERE NOT EXISTS (SELECT 1 FROM edge_points p WHERE p.label = e.label AND (p.x-e.x)**2+(p.y-e.y)**2 > e.r2 + 1e-12))
 SELECT label, round(min_by(x, r2), 6) + 0.0 AS x, round(min_by(y, r2), 6) + 0.0 AS y, round(sqrt(min(r2)), 6) AS radius FROM fits GROUP BY 1""".replace(", two AS", ", edge_points AS (SELECT p.* FROM pts p WHERE EXISTS (SELECT 1 FROM pts b WHERE b.label = p.label AND (b.x <> p.x OR b.y <> p.y) AND NOT EXISTS (SELECT 1 FROM pts c WHERE c.label = p.label AND (b.x-p.x)*(c.y-p.y)-(b.y-p.y)*(c.x-p.x) < 0))), two AS", 1))
def min_enclosing_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest circle round each label's points."""
    c = _hull_rings(spark, sf_dir).withColumn("c", P.numbers("ring", "enclosing_circle", ["x", "y", "radius"]))
    return c.select("label", r6(F.col("c.x")).alias("x"), r6(F.col("c.y")).alias("y"), r6(F.col("c.radius")).alias("radius"))


@query("obb_optimal", f"""{_HULL}, spun AS (SELECT e.label, e.x0, e.y0, e.x1, e.y1, ((h.x0-e.x0)*(e.x1-e.x0)+(h.y0-e.y0)*(e.y1-e.y0))/sqrt((e.x1-e.x0)**2+(e.y1-e.y0)**2) AS u, ((h.y0-e.y0)*(e.x1-e.x0)-(h.x0-e.x0)*(e.y1-e.y0))/sqrt((e.x1-e.x0)**2+(e.y1-e.y0)**2) AS v FROM edge e JOIN edge h USING (label)),
 boxes AS (SELECT label, (max(u)-min(u))*(max(v)-min(v)) AS area FROM spun GROUP BY label, x0, y0, x1, y1) SELECT label, round(min(area), 5) AS area FROM boxes GROUP BY 1""")
def obb_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _hull_rings(spark, sf_dir).withColumn("b", P.numbers("ring", "smallest_box", ["x", "y", "half_width", "half_height", "angle"]))
    return b.select("label", F.round(4 * F.col("b.half_width") * F.col("b.half_height"), 5).alias("area"))


@query("farthest_pair", f"{W} SELECT a.label, round(sqrt(max((a.x-b.x)**2+(a.y-b.y)**2)), 6) AS diameter FROM pts a JOIN pts b ON a.label = b.label GROUP BY 1")
def farthest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spine of a capsule: the farthest two points of a set lie on its hull."""
    h = _hull_rings(spark, sf_dir)
    d = F.expr("array_max(transform(ring, a -> array_max(transform(ring, b -> power(a.x - b.x, 2) + power(a.y - b.y, 2)))))")
    return h.select("label", r6(F.sqrt(d)).alias("diameter"))


# ------------------------------------------------------------------ simplification and similarity

_RADIAL = f"""{W.replace('WITH', 'WITH RECURSIVE')}, last AS (SELECT user_id, max(idx) AS n FROM traj GROUP BY 1),
 kept AS (SELECT t.user_id, idx, x, y, n FROM traj t JOIN last USING (user_id) WHERE idx = 0
 UNION ALL SELECT k.user_id, m.idx, m.x, m.y, k.n FROM kept k, LATERAL (SELECT idx, x, y FROM traj t WHERE t.user_id = k.user_id AND t.idx > k.idx AND t.idx < k.n AND (t.x-k.x)*(t.x-k.x)+(t.y-k.y)*(t.y-k.y) >= 10000 ORDER BY idx LIMIT 1) m)
 SELECT user_id, count(*) + 1 AS n_kept, sum(idx) + max(n) AS sum_idx FROM kept GROUP BY 1"""


@query("radial_indices", _RADIAL.replace("sum(idx) + max(n)", "CAST(sum(idx) + max(n) AS BIGINT)"))
def radial_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = polylines(spark, sf_dir).withColumn("kept", P.indexes("line", "radial", least=100.0))
    return t.select("user_id", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_idx"))


def _kept_sizes(spark: SparkSession, sf_dir: str, kernel: str, **options: object) -> DataFrame:
    t = polylines(spark, sf_dir).withColumn("kept", P.indexes("line", kernel, **options))
    return t.select("user_id", F.size("line").alias("n_points"), F.size("kept").alias("n_kept"), "kept")


for _name, _kernel, _options in (
    ("radial_by_count", "radial_by_count", {"count": 20}),
    ("visvalingam_by_area", "visvalingam", {"min_area": 500.0}),
    ("visvalingam_by_count", "visvalingam", {"count": 20}),
    ("topology_preserving", "visvalingam", {"min_area": 500.0, "keep_simple": 1e-10}),
    ("topology_preserving_by_count", "visvalingam", {"count": 20, "keep_simple": 1e-10}),
    ("dedupe_consecutive", "drop_repeats", {"eps": 30.0}),
    ("remove_collinear", "drop_collinear", {"eps": 20.0}),
):
    query(_name)(lambda spark, sf_dir, k=_kernel, o=_options: _kept_sizes(spark, sf_dir, k, **o))


def _kept_sums(spark: SparkSession, sf_dir: str, kernel: str, **options: object) -> DataFrame:
    """How many points of each user's line are kept, and the sum of their numbers."""
    t = polylines(spark, sf_dir).withColumn("kept", P.indexes("line", kernel, **options))
    return t.select("user_id", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_idx"))


_RECURSIVE = W.replace("WITH", "WITH RECURSIVE")
_LINE = "sqrt((n.x-k.x)**2+(n.y-k.y)**2)"
_NEXT = f"""{_RECURSIVE}, last AS (SELECT user_id, max(idx) AS n FROM traj GROUP BY 1),
 kept AS (SELECT t.user_id, idx, x, y, n FROM traj t JOIN last USING (user_id) WHERE idx = 0
 UNION ALL SELECT k.user_id, m.idx, m.x, m.y, k.n FROM kept k, LATERAL (SELECT t.idx, t.x, t.y FROM traj t JOIN traj n ON n.user_id = t.user_id AND n.idx = t.idx + {{ahead}} WHERE t.user_id = k.user_id AND t.idx > k.idx AND {{far}} ORDER BY t.idx LIMIT 1) m)
 SELECT user_id, count(*) + {{end}} AS n_kept, CAST(sum(idx) + {{end}} * max(n) AS BIGINT) AS sum_idx FROM kept GROUP BY 1"""


@query("dedupe_kept", _NEXT.format(ahead=0, far="sqrt((t.x-k.x)**2+(t.y-k.y)**2) > 30", end=0))
def dedupe_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_sums(spark, sf_dir, "drop_repeats", eps=30.0)


@query("collinear_kept", _NEXT.format(ahead=1, far=f"abs((n.x-k.x)*(t.y-k.y)-(n.y-k.y)*(t.x-k.x)) / {_LINE} > 20", end=1))
def collinear_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_sums(spark, sf_dir, "drop_collinear", eps=20.0)


_HALF = "abs(({b}.x-{a}.x)*({c}.y-{a}.y)-({b}.y-{a}.y)*({c}.x-{a}.x))/2"
_SMALLEST = f"""{_RECURSIVE}, w AS (SELECT user_id, idx, x, y, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS cx, lead(y) OVER w AS cy FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
 r AS (SELECT user_id, list({{{{'i': idx, 'x': x, 'y': y, 's': abs((x-ax)*(cy-ay)-(y-ay)*(cx-ax))/2}}}} ORDER BY idx) AS l, 0.0::DOUBLE AS f FROM w GROUP BY 1
 UNION ALL SELECT user_id, list_transform(range(1, len(k) + 1), lambda j: {{{{'i': k[j].i, 'x': k[j].x, 'y': k[j].y, 's': CASE WHEN (j = m - 1 OR j = m) AND j > 1 AND j < len(k) THEN greatest(g, {_HALF.format(a='k[j-1]', b='k[j]', c='k[j+1]')}) ELSE k[j].s END}}}}), g
 FROM (SELECT user_id, l[:m-1] || l[m+1:] AS k, m, greatest(f, l[m].s) AS g FROM (SELECT *, list_position(list_transform(l, lambda e: e.s), list_min(list_transform(l, lambda e: e.s))) AS m FROM r) WHERE {{going}})),
 u AS (SELECT user_id, arg_min(l, len(l)) AS l FROM r GROUP BY 1) SELECT user_id, len(l) AS n_kept, CAST(list_sum(list_transform(l, lambda e: e.i)) AS BIGINT) AS sum_idx FROM u"""


@query("visvalingam_area_kept", _SMALLEST.format(going="len(l) > 2 AND l[m].s < 500"))
def visvalingam_area_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_sums(spark, sf_dir, "visvalingam", min_area=500.0)


@query("visvalingam_count_kept", _SMALLEST.format(going="len(l) > 20"))
def visvalingam_count_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_sums(spark, sf_dir, "visvalingam", count=20)


def _pairs_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = polylines(spark, sf_dir)
    a, b = (t.select(F.col("user_id").alias(n), F.col("line").alias(f"l{n}")) for n in "ab")
    return a.withColumn("b", F.col("a") + 1).join(b, "b")


@query("frechet_discrete", f"""{W}, l AS (SELECT user_id, list([x, y] ORDER BY idx) AS p FROM traj GROUP BY 1), d AS (SELECT a.user_id, list_transform(a.p, lambda u: list_transform(b.p, lambda v: sqrt((u[1]-v[1])*(u[1]-v[1])+(u[2]-v[2])*(u[2]-v[2])))) AS m FROM l a JOIN l b ON b.user_id = a.user_id + 1)
 SELECT user_id, round(list_reduce(m[2:], lambda row, next: list_reduce(list_zip(next, row)[2:], lambda made, z: list_append(made, greatest(z[1], least(z[2], made[-1], row[len(made)]))), [greatest(next[1], row[1])]), list_reduce(m[1][2:], lambda made, z: list_append(made, greatest(made[-1], z)), [m[1][1]]))[-1], 6) AS distance FROM d""")
def frechet_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines of neighbouring users."""
    return _pairs_of_users(spark, sf_dir).select(F.col("a").alias("user_id"), r6(P.pair_number("la", "lb", "frechet")).alias("distance"))


@query("hausdorff_points", f"""{W}, d AS (SELECT a.user_id AS u, a.idx AS i, b.idx AS j, sqrt((a.x-b.x)**2+(a.y-b.y)**2) AS d FROM traj a JOIN traj b ON b.user_id = a.user_id + 1),
 f AS (SELECT u, max(m) AS m FROM (SELECT u, i, min(d) AS m FROM d GROUP BY 1, 2) GROUP BY 1), g AS (SELECT u, max(m) AS m FROM (SELECT u, j, min(d) AS m FROM d GROUP BY 1, 2) GROUP BY 1)
 SELECT u AS user_id, round(f.m, 6) AS directed, round(greatest(f.m, g.m), 6) AS distance FROM f JOIN g USING (u)""")
def hausdorff_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda a, b: F.expr(f"array_max(transform({a}, p -> array_min(transform({b}, q -> sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2))))))")
    return _pairs_of_users(spark, sf_dir).select(F.col("a").alias("user_id"), r6(one("la", "lb")).alias("directed"), r6(F.greatest(one("la", "lb"), one("lb", "la"))).alias("distance"))


@query("snap_to_grid", f"{W} SELECT CAST(round(x / 0.05) AS BIGINT) AS gx, CAST(round(y / 0.05) AS BIGINT) AS gy, count(*) AS n FROM pts GROUP BY 1, 2")
def snap_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = lambda v: F.round(v / 0.05).cast("long")
    return points(spark, sf_dir).groupBy(g(F.col("p.x")).alias("gx"), g(F.col("p.y")).alias("gy")).agg(F.count("*").alias("n"))


@query("weld_clusters", f"""{W.replace('WITH', 'WITH RECURSIVE')}, near AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON sqrt((a.x-b.x)**2+(a.y-b.y)**2) <= 0.01),
 r AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM r JOIN near n ON r.b = n.a) SELECT m AS cluster, count(*) AS n FROM (SELECT a, min(b) AS m FROM r GROUP BY 1) GROUP BY 1""")
def weld_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.welded(points(spark, sf_dir), 0.01).groupBy("cluster").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ spatial joins


@query("pairs_within_distance", f"{W} SELECT a.id AS a, b.id AS b, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2), 6) AS d FROM pts a JOIN pts b ON a.id < b.id WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2) <= 0.02")
def pairs_within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    a, b = (p.select(F.col("id").alias(n), F.col("p").alias(f"p{n}")) for n in "ab")
    return S.within_distance(a, b, 0.02, "pa", "pb").filter("a < b").select("a", "b", r6(G.distance(F.col("pa"), F.col("pb"))).alias("d"))


_KNN = f"""{W}, q AS (SELECT id AS qid, e[3] AS qx, e[4] AS qy FROM pts), r AS (SELECT qid, id, sqrt((x-qx)**2+(y-qy)**2) AS d, row_number() OVER (PARTITION BY qid ORDER BY sqrt((x-qx)*(x-qx)+(y-qy)*(y-qy)), id) AS rank FROM q, pts)
 SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(d, 6) AS distance FROM r WHERE rank <= {{k}}"""


def _knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    p = points(spark, sf_dir)
    q = p.select(F.col("id").alias("qid"), _e(2, 3).alias("q"))
    return B.nearest(q, p.select("id", "p"), k).select("qid", "id", "rank", r6(F.col("distance")).alias("distance"))


query("nearest", _KNN.format(k=1))(lambda spark, sf_dir: _knn(spark, sf_dir, 1))
query("k_nearest", _KNN.format(k=5))(lambda spark, sf_dir: _knn(spark, sf_dir, 5))


@query("within_radius", f"{W} SELECT q.id AS qid, count(*) AS n FROM pts q JOIN pts p ON sqrt((p.x-q.e[3])**2+(p.y-q.e[4])**2) <= 0.1 GROUP BY 1")
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    q = p.select(F.col("id").alias("qid"), _e(2, 3).alias("q"))
    return S.within_distance(q, p.select("id", "p"), 0.1, "q", "p").groupBy("qid").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ rings


@query("ring_measures", f"""{W}, v AS (SELECT user_id, idx, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx))
 SELECT user_id, round(abs(sum(x*ny-nx*y)/2), 2) AS area, round(sum(sqrt((nx-x)**2+(ny-y)**2)), 4) AS perimeter FROM v GROUP BY 1""")
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polylines(spark, sf_dir).select("user_id", F.round(G.ring_area("line"), 2).alias("area"), F.round(G.ring_perimeter("line"), 4).alias("perimeter"))


@query("point_in_ring", f"""{W}, v AS (SELECT user_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx)), q AS (SELECT unnest([100.0, 200.0, 400.0]) AS px, 120.0 AS py)
 SELECT user_id, px, sum(CASE WHEN (y > py) <> (ny > py) AND px < (nx-x)*(py-y)/(ny-y)+x THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM v, q GROUP BY 1, 2""".replace("[100.0, 200.0, 400.0]", "[100.0::DOUBLE, 200.0::DOUBLE, 400.0::DOUBLE]").replace("120.0 AS", "120.0::DOUBLE AS"))
def point_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = polylines(spark, sf_dir).withColumn("px", F.explode(F.array(*(F.lit(v) for v in (100.0, 200.0, 400.0)))))
    return t.withColumn("q", G.point(F.col("px"), F.lit(120.0))).select("user_id", "px", G.ring_contains("line", "q").alias("inside"))


@query("ear_clip_area", f"{_HULL} SELECT label, count(*) - 2 AS n_triangles, round(sum(x0*y1-x1*y0)/2, 5) AS area FROM edge GROUP BY 1")
def ear_clip_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hull_rings(spark, sf_dir).withColumn("t", P.triples("ring", "triangulate"))
    area = F.expr("aggregate(t, 0D, (s, t) -> s + abs((ring[t.b].x - ring[t.a].x) * (ring[t.c].y - ring[t.a].y) - (ring[t.b].y - ring[t.a].y) * (ring[t.c].x - ring[t.a].x)) / 2)")
    return h.select("label", F.size("t").cast("long").alias("n_triangles"), F.round(area, 5).alias("area"))


@query("delaunay_small", f"""{W}, p AS (SELECT * FROM pts)
 SELECT a.label, count(*) AS n_triangles FROM p a JOIN p b ON a.label = b.label AND a.id < b.id JOIN p c ON c.label = a.label AND b.id < c.id
 WHERE NOT EXISTS (SELECT 1 FROM p d WHERE d.label = a.label AND d.id NOT IN (a.id, b.id, c.id) AND
 ((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)) * (((a.x-d.x)**2+(a.y-d.y)**2)*((b.x-d.x)*(c.y-d.y)-(c.x-d.x)*(b.y-d.y)) - ((b.x-d.x)**2+(b.y-d.y)**2)*((a.x-d.x)*(c.y-d.y)-(c.x-d.x)*(a.y-d.y)) + ((c.x-d.x)**2+(c.y-d.y)**2)*((a.x-d.x)*(b.y-d.y)-(b.x-d.x)*(a.y-d.y))) > 0) GROUP BY 1""")
def delaunay_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delaunay_triangles(points(spark, sf_dir), "label").groupBy("label").agg(F.count("*").alias("n_triangles"))


def _hull_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's hull, from the hulls of the partitions."""
    return hulls(points(spark, sf_dir), "label")


_PAIRED = f"{_HULL}, p AS (SELECT label, x0, y0, x1, y1 FROM edge), q AS (SELECT label - 1 AS label, x0, y0, x1, y1 FROM edge)"


@query("clip_convex_area", f"""{_PAIRED}, inner_ AS (SELECT a.label, a.x0 AS x, a.y0 AS y FROM p a JOIN q b USING (label) GROUP BY a.label, a.x0, a.y0 HAVING min((b.x1-b.x0)*(a.y0-b.y0)-(b.y1-b.y0)*(a.x0-b.x0)) >= 0
  UNION ALL SELECT a.label, a.x0, a.y0 FROM q a JOIN p b USING (label) GROUP BY a.label, a.x0, a.y0 HAVING min((b.x1-b.x0)*(a.y0-b.y0)-(b.y1-b.y0)*(a.x0-b.x0)) >= 0
  UNION ALL SELECT label, px+t*ex, py+t*ey FROM (SELECT a.label, a.x0 AS px, a.y0 AS py, a.x1-a.x0 AS ex, a.y1-a.y0 AS ey, ((b.x0-a.x0)*(b.y1-b.y0)-(b.y0-a.y0)*(b.x1-b.x0))/((a.x1-a.x0)*(b.y1-b.y0)-(a.y1-a.y0)*(b.x1-b.x0)) AS t, ((b.x0-a.x0)*(a.y1-a.y0)-(b.y0-a.y0)*(a.x1-a.x0))/((a.x1-a.x0)*(b.y1-b.y0)-(a.y1-a.y0)*(b.x1-b.x0)) AS u FROM p a JOIN q b USING (label)) WHERE t > 0 AND t < 1 AND u > 0 AND u < 1),
 c AS (SELECT label, x, y, atan2(y - avg(y) OVER (PARTITION BY label), x - avg(x) OVER (PARTITION BY label)) AS t FROM inner_),
 n AS (SELECT label, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM c WINDOW w AS (PARTITION BY label ORDER BY t))
 SELECT label, round(sum(x*ny-nx*y)/2, 6) AS area FROM n GROUP BY 1""")
def clip_convex_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area that the hulls of neighbouring labels share."""
    h = _hull_rings(spark, sf_dir)
    o = h.select((F.col("label") - 1).alias("label"), F.col("ring").alias("other"))
    return h.join(o, "label").withColumn("ring", P.rings("ring", "clip_convex", "other")).select("label", r6(G.ring_area("ring")).alias("area"))


@query("minkowski_area", f"""{_PAIRED}, a AS (SELECT label, sum(x0*y1-x1*y0)/2 AS area FROM p GROUP BY 1), b AS (SELECT label, sum(x0*y1-x1*y0)/2 AS area FROM q GROUP BY 1),
 h AS (SELECT p.label, p.x0, p.y0, max((p.y1-p.y0)*q.x0-(p.x1-p.x0)*q.y0) AS reach FROM p JOIN q USING (label) GROUP BY ALL), m AS (SELECT label, sum(reach) AS mixed FROM h GROUP BY 1)
 SELECT label, round(a.area + b.area + mixed, 6) AS area FROM a JOIN b USING (label) JOIN m USING (label)""")
def minkowski_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the sum of neighbouring labels' hulls."""
    h = _hull_rings(spark, sf_dir)
    o = h.select((F.col("label") - 1).alias("label"), F.col("ring").alias("other"))
    return h.join(o, "label").withColumn("ring", P.rings("ring", "minkowski_convex", "other")).select("label", r6(G.ring_area("ring")).alias("area"))


@query("offset_area", f"""{_HULL}, t AS (SELECT a.label, sqrt((a.x1-a.x0)**2+(a.y1-a.y0)**2) AS l, a.x0*a.y1-a.x1*a.y0 AS k, atan2((a.x1-a.x0)*(b.y1-b.y0)-(a.y1-a.y0)*(b.x1-b.x0), (a.x1-a.x0)*(b.x1-b.x0)+(a.y1-a.y0)*(b.y1-b.y0)) AS turn FROM edge a JOIN edge b ON a.label = b.label AND a.x1 = b.x0 AND a.y1 = b.y0)
 SELECT label, round(sum(k)/2 + 0.1 * sum(l) + 0.01 * sum(CASE WHEN cos(turn/2) * 4 >= 1 THEN tan(turn/2) ELSE sin(turn)/2 END), 6) AS area FROM t GROUP BY 1""")
def offset_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each label's hull moved outwards by 0.1."""
    return _hull_rings(spark, sf_dir).select("label", r6(P.made("double", lambda p: O.area(O.offset(p, 0.1)), "ring")).alias("area"))


@query("ring_convexity", f"{W} SELECT label, true AS convex FROM pts GROUP BY 1")
def ring_convexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hull_rings(spark, sf_dir).select("label", G.ring_is_convex("ring").alias("convex"))


# ------------------------------------------------------------------ curves


_T = "(SELECT unnest([0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS t)"


def _at(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.explode(F.array(*(F.lit(v) for v in (0.0, 0.25, 0.5, 1.0)))))


@query("bezier_eval", f"""{W} SELECT id, t, round((1-t)**3*e[1]+3*(1-t)**2*t*e[3]+3*(1-t)*t*t*e[5]+t**3*e[7], 6) + 0.0 AS x, round((1-t)**3*e[2]+3*(1-t)**2*t*e[4]+3*(1-t)*t*t*e[6]+t**3*e[8], 6) + 0.0 AS y,
 round(3*(1-t)**2*(e[3]-e[1])+6*(1-t)*t*(e[5]-e[3])+3*t*t*(e[7]-e[5]), 6) + 0.0 AS dx FROM pts, {_T}""")
def bezier_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = (_e(0, 1), _e(2, 3), _e(4, 5), _e(6, 7))
    p, d = G.bezier(F.col("t"), *c), G.bezier_derivative(F.col("t"), *c)
    return _at(points(spark, sf_dir)).select("id", "t", r6(p.x).alias("x"), r6(p.y).alias("y"), r6(d.x).alias("dx"))


@query("bezier_split", f"{W} SELECT id, round(0.125*e[1]+0.375*e[3]+0.375*e[5]+0.125*e[7], 6) + 0.0 AS mid_x, round(0.5*e[1]+0.5*e[3], 6) + 0.0 AS left_x, round(0.5*e[5]+0.5*e[7], 6) + 0.0 AS right_x FROM pts")
def bezier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = G.bezier_split(0.5, _e(0, 1), _e(2, 3), _e(4, 5), _e(6, 7))
    return points(spark, sf_dir).select("id", r6(left[3].x).alias("mid_x"), r6(left[1].x).alias("left_x"), r6(right[2].x).alias("right_x"))


@query("hermite_catmull_rom", f"""{W} SELECT id, t, round((2*t**3-3*t*t+1)*e[1]+(t**3-2*t*t+t)*e[3]+(-2*t**3+3*t*t)*e[5]+(t**3-t*t)*e[7], 6) + 0.0 AS hermite_x,
 round((2*t**3-3*t*t+1)*e[3]+(t**3-2*t*t+t)*(e[5]-e[1])/2+(-2*t**3+3*t*t)*e[5]+(t**3-t*t)*(e[7]-e[3])/2, 6) + 0.0 AS catmull_x FROM pts, {_T}""")
def hermite_catmull_rom(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = (_e(0, 1), _e(2, 3), _e(4, 5), _e(6, 7))
    t = F.col("t")
    return _at(points(spark, sf_dir)).select("id", "t", r6(G.hermite(t, *c).x).alias("hermite_x"), r6(G.catmull_rom(t, *c).x).alias("catmull_x"))


@query("arc_points", f"{W} SELECT id, t, round(x + (abs(e[3])+0.05)*cos(e[4]+(e[5]-e[4])*t), 6) + 0.0 AS px, round(y + (abs(e[3])+0.05)*sin(e[4]+(e[5]-e[4])*t), 6) + 0.0 AS py FROM pts, {_T}")
def arc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    p = G.arc_point(F.col("p"), F.abs(e[2]) + 0.05, e[3], e[4], F.col("t"))
    return _at(points(spark, sf_dir)).select("id", "t", r6(p.x).alias("px"), r6(p.y).alias("py"))


# ------------------------------------------------------------------ sampling and fields


@query("halton_2d", """WITH RECURSIVE d AS (SELECT i, b, i AS n, 1.0::DOUBLE / b AS f, 0.0::DOUBLE AS v FROM (SELECT vec_id AS i FROM embeddings), (VALUES (2), (3)) z(b) UNION ALL SELECT i, b, n // b, f / b, v + (n % b) * f FROM d WHERE n > 0)
 SELECT i, round(max(v) FILTER (b = 2), 9) AS x, round(max(v) FILTER (b = 3), 9) AS y FROM d GROUP BY 1""")
def halton_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each row, by its id."""
    i = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"))
    return i.select("i", F.round(G.radical_inverse("i", 2), 9).alias("x"), F.round(G.radical_inverse("i", 3), 9).alias("y"))


@query("sobol_first_dimension", "SELECT vec_id AS i, list_sum([CASE WHEN (vec_id >> k) % 2 = 1 THEN 1.0::DOUBLE / (2 << k) ELSE 0.0 END FOR k IN range(28)]) AS x FROM embeddings")
def sobol_first_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number for each row, by its id: that of its mirrored bits."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i")).select("i", G.sobol("i", 1).alias("x"))


@query("poisson_disk")  # a random search; its gaps and reach are tested
def poisson_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blue-noise points in a domain of its own for each supplier, whose key is the seed."""
    import pandas as pd

    from planewright.functions import kernels as K

    def domains(batches):
        for batch in batches:
            for key, nation in zip(batch["s_suppkey"], batch["s_nationkey"], strict=True):
                p = K.poisson_disk(8.0 + nation % 5, 8.0 + nation % 3, 1.0, 30, int(key))
                yield pd.DataFrame({"s_suppkey": int(key), "k": range(len(p)), "x": p[:, 0], "y": p[:, 1]})

    return spread(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")).mapInPandas(domains, "s_suppkey long, k long, x double, y double")


@query("sdf_grid", f"""{W}, g AS (SELECT id, x, y, 0.1 + abs(e[3]) AS r FROM pts) SELECT id, round(sqrt(x*x+y*y) - r, 6) + 0.0 AS circle, round(sqrt(greatest(abs(x)-r, 0)**2+greatest(abs(y)-r, 0)**2) + least(greatest(abs(x)-r, abs(y)-r), 0), 6) + 0.0 AS square FROM g""")
def sdf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed distances of each row's point to a circle and a square of its own size."""
    r, p = 0.1 + F.abs(F.col("e")[2]), F.col("p")
    outside = G.box_distance(G.box(-r, -r, r, r), p)
    inside = F.least(F.greatest(F.abs(p.x) - r, F.abs(p.y) - r), F.lit(0.0))
    return points(spark, sf_dir).select("id", r6(G.circle_distance(G.circle(G.point(0, 0), r), p)).alias("circle"), r6(outside + inside).alias("square"))


@query("distance_transform", """WITH g AS (SELECT p_size AS gx, p_partkey % 40 AS gy, bool_or(p_retailprice > 1400) AS f FROM part GROUP BY 1, 2) SELECT a.gx, a.gy, round(sqrt(min((a.gx-b.gx)**2 + (a.gy-b.gy)**2)), 6) AS d FROM g a, g b WHERE b.f GROUP BY 1, 2""")
def distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of sizes by keys' remainders, marked where a part is dear; cells without a part are no cells."""
    from planewright.operators.raster import distance_transform as transform

    part = read(spark, sf_dir, "part")
    cells = part.groupBy(F.col("p_size").cast("long").alias("gx"), (F.col("p_partkey") % 40).alias("gy")).agg(F.bool_or(F.col("p_retailprice") > 1400).alias("feature"))
    return transform(cells.withColumn("grid_id", F.lit(0))).filter("distance IS NOT NULL").select(F.col("gx").cast("int").alias("gx"), "gy", r6(F.col("distance")).alias("d"))


# ------------------------------------------------------------------ text in and out


@query("svg_write_polyline", "SELECT p_size AS size, 'M ' || p_size || ' 0 L ' || (p_size + 1) || ' ' || (p_size * 2) || ' L 0 ' || p_size || ' Z' AS path FROM (SELECT DISTINCT p_size FROM part)")
def svg_write_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planewright.sources import svg

    s = read(spark, sf_dir, "part").select(F.col("p_size").alias("size")).distinct()
    ring = F.array(*(G.point(a.cast("double"), b.cast("double")) for a, b in ((F.col("size"), F.lit(0)), (F.col("size") + 1, F.col("size") * 2), (F.lit(0), F.col("size")))))
    return s.withColumn("ring", ring).select("size", svg.path_of("ring", closed=True).alias("path"))


@query("svg_parse_roundtrip", "SELECT p_size AS size, 4::BIGINT AS n_commands, true AS same FROM (SELECT DISTINCT p_size FROM part)")
def svg_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from planewright.sources import svg

    made = svg_write_polyline(spark, sf_dir)
    return made.withColumn("c", svg.parse("path")).select("size", F.size("c").cast("long").alias("n_commands"), (svg.write("c") == F.col("path")).alias("same"))


@query("svg_lines", "SELECT p_size AS size, 2 AS n_lines, round(4.0::DOUBLE * p_size, 2) AS square, round(5 * pi() + 10, 2) AS rest, NULL::VARCHAR AS fault, 'wrong number of arguments' AS broken FROM (SELECT DISTINCT p_size FROM part)")
def svg_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square in relative and absolute steps, then an arc (flags without gaps) with a straight curve after it."""
    from planewright.sources import svg

    s = read(spark, sf_dir, "part").select(F.col("p_size").alias("size")).distinct()
    text = F.format_string("M %1$d 0h%1$dv%1$dH%1$dz m.5-3a5 5 0 0110 0q5,0 10,0", F.col("size").cast("int"))
    t = s.withColumn("path", text).withColumn("bad", F.concat("path", F.lit(" L 3"))).withColumn("lines", svg.lines_of("path", 1e-5))
    t = t.select("size", svg.fault("path").alias("fault"), svg.fault("bad").alias("broken"), F.size("lines").alias("n_lines"), F.col("lines")[0].alias("one"), F.col("lines")[1].alias("two"))
    length = lambda v: F.round(G.ring_perimeter(v, closed=False), 2)
    return t.select("size", "n_lines", length("one").alias("square"), length("two").alias("rest"), "fault", "broken")


@query("f32_distances", f"{W} SELECT label, count(*) FILTER (x*x + y*y <= 0.01) AS n FROM pts GROUP BY 1")
def f32_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-precision batch: points within a radius of the origin."""
    e = read(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    return e.groupBy("label").agg(F.count_if(F.col("x") * F.col("x") + F.col("y") * F.col("y") <= F.lit(0.01).cast("float")).alias("n"))


@query("time_ordered_steps", f"{W} SELECT user_id, count(*) AS n_steps, round(max(d), 4) AS longest FROM (SELECT user_id, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) AS d FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY idx)) WHERE d IS NOT NULL GROUP BY 1")
def time_ordered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("idx")
    d = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    return trajectories(spark, sf_dir).withColumn("d", d).filter("d IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n_steps"), F.round(F.max("d"), 4).alias("longest"))
