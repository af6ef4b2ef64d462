import functools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from planewright.functions import geometry as G
from planewright.functions import kernels as K
from planewright.functions import overlay as O
from planewright.operators import components as C
from planewright.operators import spatial as S
from planewright.operators.components import components
from planewright.operators.neighbours import nearest
from planewright.operators.tables import trajectories
from planewright.plans import catalog
from planewright.streaming.radial import radial_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(spark, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_missing_results_are_null(spark):
    row = spark.range(1).select(
        G.normalized(G.point(0, 0)).alias("unit"),
        G.line_crossing(G.segment(G.point(0, 0), G.point(1, 0)), G.segment(G.point(0, 1), G.point(1, 1))).alias("parallel"),
        G.circumcircle(G.point(0, 0), G.point(1, 1), G.point(2, 2)).alias("line"),
        G.affine_inverse(G.affine(*(F.lit(v) for v in (1.0, 2.0, 2.0, 4.0, 0.0, 0.0)))).alias("flat"),
        G.box_intersection(G.box(*(F.lit(v) for v in (0.0, 0.0, 1.0, 1.0))), G.box(*(F.lit(v) for v in (2.0, 2.0, 3.0, 3.0)))).alias("apart"),
        G.segment_parameter(G.segment(G.point(1, 1), G.point(1, 1)), G.point(5, 5)).alias("t"),
        G.distance(G.point(F.lit(None).cast("double"), F.lit(1.0)), G.point(0, 0)).alias("d"),
    ).first()
    assert row[:5] == (None,) * 5 and row["t"] == 0 and row["d"] is None


def test_kernels_on_small_inputs():
    for n in (0, 1, 2):
        p = np.arange(2 * n, dtype=float).reshape(n, 2)
        assert K.douglas_peucker(p, 1) == K.radial(p, 1) == K.convex_hull(p) == list(range(n))
    bump = np.array([[i, 3.0 if 5 <= i <= 7 else 0.0] for i in range(11)])
    kept = K.douglas_peucker(bump, 0.5)
    assert kept[0] == 0 and kept[-1] == 10 and len(kept) < 11 and bump[kept][:, 1].max() == 3
    assert K.radial(np.array([[0, 0], [0.5, 0], [0.9, 0], [1.5, 0], [2, 0], [3, 0.0]]), 1) == [0, 3, 5]
    assert K.frechet(np.array([[0, 0], [1, 2], [2, 0.0]]), np.array([[0, 0], [1, 0], [2, 0.0]])) == 2
    square, triangle = np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]), np.array([[0, 0], [1, 0], [0.5, 1]])
    assert K.signed_area(K.minkowski_convex(square, triangle)) == pytest.approx(3.5)
    assert O.area(O.offset(square, 0.5)) == pytest.approx(4)
    ell = np.array([[0, 0], [2, 0], [2, 1], [1, 1], [1, 2], [0, 2.0]])
    assert sum(abs(K.signed_area(ell[list(t)])) for t in K.triangulate(ell)) == pytest.approx(3)
    assert sum(K.signed_area(ell[t]) for t in K.convex_parts(ell)) == pytest.approx(3)
    r = np.random.default_rng(1).random((60, 2))
    x, y, radius = K.enclosing_circle(r)
    d = np.hypot(r[:, 0] - x, r[:, 1] - y)
    assert d.max() <= radius * (1 + 1e-9) and (d > radius * (1 - 1e-9)).sum() >= 2
    disk = K.poisson_disk(20, 20, 1.5, 30, 7)
    gap = np.hypot(*(disk[:, None] - disk[None]).transpose(2, 0, 1)) + np.eye(len(disk)) * 99
    assert gap.min() >= 1.5 and math.prod(disk.shape) > 100


def test_nearest_with_few_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 0.0)], "id long, x double, y double").select("id", F.struct("x", "y").alias("p"))
    q = spark.createDataFrame([(7, 100.0, 100.0), (8, 1.0, 0.0)], "qid long, x double, y double").select("qid", F.struct("x", "y").alias("q"))
    got = nearest(q, p, 5)
    assert sorted((r["qid"], r["rank"], r["id"]) for r in got.collect()) == [(7, 1, 2), (7, 2, 1), (8, 1, 1), (8, 2, 2)]
    assert nearest(q, p.limit(0), 5).count() == 0


def test_circles_of_unlike_radii_overlap(spark):
    r = np.random.default_rng(7)
    n = 300
    x, y, radius = r.uniform(-50, 50, n), r.uniform(-50, 50, n), 10 ** r.uniform(-5, 1.3, n)
    radius[:3], x[3:5], y[3:5], radius[3:5] = 0, [0, 8], 0, 4  # points, and a pair that touches
    c = spark.createDataFrame([*((i, float(x[i]), float(y[i]), float(radius[i])) for i in range(n)), (n, 0.0, 0.0, None), (n + 1, 0.0, 0.0, -1.0)], "i int, x double, y double, r double").select("i", G.circle(G.point(F.col("x"), F.col("y")), F.col("r")).alias("c"))
    got = S.overlapping_circles(c, c.select(F.col("i").alias("j"), F.col("c").alias("d"))).select("i", "j").collect()
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    assert sorted(map(tuple, got)) == list(zip(*(k.tolist() for k in np.nonzero(d <= radius[:, None] + radius)), strict=True))
    assert S.overlapping_circles(c.limit(0), c.select(F.col("c").alias("d"))).count() == 0


@pytest.mark.parametrize("hot", [None, 3])
def test_components(spark, monkeypatch, hot):
    if hot:  # nodes of more than three edges count as crowded
        monkeypatch.setattr(C, "HOT_EDGES", hot)
        monkeypatch.setattr(C, "HOT", 10**9)
    edges = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 32), (40, 40)] + [(100, k) for k in range(101, 140)] + [(50, 100)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(2, 21)}, 31: 30, 32: 30, **{k: 50 for k in range(100, 140)}}


def test_stream_equals_batch(spark, tmp_path):
    rows = trajectories(spark, SF).withColumn("idx", F.col("idx").cast("long"))
    for k in range(3):  # three micro-batches, each a later stretch
        rows.filter((F.col("idx") >= 30 * k) & (F.col("idx") < (30 * (k + 1) if k < 2 else 10**9))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = radial_stream(stream, 100.0).writeStream.format("memory").queryName("passed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r["user_id"], r["idx"]) for r in spark.table("passed").collect())
    want = []
    for user, frame in rows.toPandas().sort_values("idx").groupby("user_id"):
        last = None
        for r in frame.itertuples():
            if last is None or (r.x - last[0]) ** 2 + (r.y - last[1]) ** 2 >= 10000:
                last = (r.x, r.y)
                want.append((user, r.idx))
    assert got == sorted(want)


def test_radial_stream_begins_anew(spark, tmp_path):
    rows = [(1, k, float(k), 0.0, k == 5) for k in range(9)] + [(2, 0, 0.0, 0.0, None), (2, 1, 1.0, 0.0, None)]
    spark.createDataFrame(rows, "user_id long, idx long, x double, y double, again boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, idx long, x double, y double, again boolean").parquet(str(tmp_path / "in"))
    run = radial_stream(stream, 4.0, reset="again").writeStream.format("memory").queryName("anew").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["user_id"], r["idx"]) for r in spark.table("anew").collect()) == [(1, 0), (1, 4), (1, 5), (2, 0)]


def test_frechet_equals_its_definition():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (1, 6), (7, 4), (12, 12)):
        p, q = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))

        @functools.cache
        def reach(i, j):
            before = [reach(a, b) for a, b in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if a >= 0 and b >= 0]
            return max(math.dist(p[i], q[j]), min(before)) if before else math.dist(p[i], q[j])

        assert K.frechet(p, q) == pytest.approx(reach(n - 1, m - 1))
