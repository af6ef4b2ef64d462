"""What must not grow with the tables, and rows that only larger tables hold."""

import numpy as np
import pyarrow as pa
import pytest

from planewright.functions import kernels as K
from planewright.functions import similarity as Y
from planewright.operators import per_geometry as P

LINE = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def test_lines_stay_flat_in_a_worker():
    """A row's points are a part of the batch's numbers, not objects of their own."""
    rows = [[{"x": float(k), "y": 1.0}] * k for k in range(5)]
    parts = list(P.arrays_of(pa.array(rows, LINE)))
    assert [p.tolist() for p in parts] == [[[float(k), 1.0]] * k for k in range(5)]
    assert all(np.shares_memory(p, parts[4].base) for p in parts[1:])
    gaps = [[{"x": 1.0, "y": 2.0}, None, {"x": None, "y": 3.0}, {"x": 4.0, "y": 5.0}], None, [], [{"x": 6.0, "y": None}], [{"x": 7.0, "y": 8.0}]]
    batch = pa.array([[{"x": 9.0, "y": 9.0}], *gaps], LINE)[1:]
    assert [p.tolist() for p in P.arrays_of(batch)] == [P.as_array(r).tolist() for r in gaps]


def test_kernels_over_batches(spark):
    rows = [(0, [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0)]), (1, []), (2, None), (3, [(5.0, 5.0)])]
    df = spark.createDataFrame(rows, "id int, line array<struct<x: double, y: double>>")
    made = df.select("id", P.made("points", lambda p: p * 2, "line").alias("p"), P.made("rings", lambda p: [p, p[:1]], "line").alias("r"), P.made("double", lambda p: float(len(p)) if len(p) else float("nan"), "line").alias("n"), P.indexes("line", "douglas_peucker", eps=0.5).alias("i"))
    got = {r.id: r for r in made.collect()}
    assert [tuple(p) for p in got[0].p] == [(0.0, 0.0), (2.0, 0.2), (4.0, 0.0)] and got[2].p == []
    assert [len(r) for r in got[0].r] == [3, 1] and [len(r) for r in got[1].r] == [0, 0]
    assert [got[k].n for k in range(4)] == [3.0, None, None, 1.0] and got[0].i == [0, 2] and got[3].i == [0]


def test_hausdorff_of_arrays():
    """By their definition, point by point and segment by segment, with segments of no length."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.random((rng.integers(1, 9), 2)), rng.random((rng.integers(1, 9), 2))
        b = np.repeat(b, rng.integers(1, 3, len(b)), axis=0)
        ends = list(zip(b[:-1], b[1:], strict=True)) or [(b[0], b[0])]
        want = max(min(float(K.segment_distances(p[None], s, e)[0]) for s, e in ends) for p in a)
        assert Y.directed_hausdorff_line(a, b) == pytest.approx(want)
    assert Y.densified(np.array([[0.0, 0.0], [3.0, 0.0]]), 1.0).tolist() == [[0, 0], [1, 0], [2, 0], [3, 0]]
    assert np.isnan(Y.directed_hausdorff_line(np.zeros((0, 2)), a)) and np.isnan(Y.directed_hausdorff_line(a, np.zeros((0, 2))))


def test_flat_crossings_count_once():
    """A cubic meets a line three times at the most, however flat it lies along it; the order of the two doesn't matter."""
    from planewright.functions import curve_kernels as C

    segment = np.array([[-1.0, 0.0], [2.0, 0.0]])
    # y = (t - 0.5)**3 and (t - 0.5)**2 (t - 0.2), in Bernstein form
    for y, want in (([-0.125, 0.125, -0.125, 0.125], [0.5]), ([-0.05, 0.1, -0.15, 0.2], [0.2, 0.5])):
        curve = np.stack([np.linspace(0, 1, 4), y], 1)
        for found in (C.bezier_crossings(curve, segment)[:, 0], C.bezier_crossings(segment, curve)[:, 1]):
            assert np.allclose(found, want, atol=1e-4)
    assert len(C.bezier_crossings(np.array([[0, 0], [0.3, 1], [0.6, -1], [1, 0]], float), segment)) == 3


def test_circles_that_hardly_cross(spark):
    """Crossings closer together than a sample step, and none where the gap is as small."""
    from pyspark.sql import functions as F

    from planewright.functions import conics as E
    from planewright.functions import geometry as G

    rows = [(0, 2 - 1e-9, 1.0), (1, 2 + 1e-9, 1.0), (2, 0.5 + 1e-9, 1.5), (3, 0.5 - 1e-9, 1.5), (4, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, r double")
    e, o = E.ellipse(G.point(0.3, 0.2), 1.0, 1.0, 0.4), G.circle(G.point(F.col("x") + 0.3, F.lit(0.2)), F.col("r"))
    df = df.withColumn("e", e).withColumn("o", o)
    got = {r.id: (r.n, r.met) for r in df.select("id", F.size(E.ellipse_circle(F.col("e"), F.col("o"), 256)).alias("n"), E.ellipses_meet(F.col("e"), E.ellipse_of_circle(F.col("o")), 256).alias("met")).collect()}
    assert got == {0: (2, True), 1: (0, False), 2: (2, True), 3: (0, True), 4: (2, True)}


def test_sobol_queries_take_31_bits(spark, tmp_path):
    """As their SQL does: rows above id 2047, whose index is larger, go on with its lower bits."""
    import duckdb

    from planewright.plans.catalog import ORACLES, QUERIES

    rows = [(i, [0.0] * 8, 0) for i in (0, 1, 2047, 2048, 4100, 1 << 20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name in ("sobol_2d", "sobol_four"):
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(c.execute(ORACLES[name]).fetchall())


def test_signed_transform_in_two_shuffles(spark):
    """Both distances at once, on rasters with marks that are null, by their definition."""
    from planewright.operators import raster as R

    rng = np.random.default_rng(3)
    cells = [(g, x, y, [True, False, None][rng.integers(3)] if g < 3 else False) for g in range(4) for x in range(7) for y in range(5)]
    out = R.signed_transform(spark.createDataFrame(cells, "grid_id int, gx long, gy long, feature boolean"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    near = lambda g, x, y, f: min((np.hypot(x - a, y - b) for h, a, b, v in cells if h == g and v is f), default=None)
    got = {(r.grid_id, r.gx, r.gy): r.distance for r in out.collect()}
    assert len(got) == len(cells)
    for g, x, y, _ in cells:
        o, i = near(g, x, y, True), near(g, x, y, False)
        assert got[g, x, y] is None if o is None or i is None else got[g, x, y] == pytest.approx(o - i)


def test_circles_on_tiles(spark, monkeypatch):
    """Pairs by their definition over several tiles and lots, and a shuffle with few copies of a row."""
    from planewright.operators import circles as X

    for name, value in (("SMALLEST", 40), ("VISITORS", 50), ("LEAF", 16), ("PAIRS", 200)):
        monkeypatch.setattr(X, name, value)
    rng = np.random.default_rng(8)
    rows = [(int(k), float(x), float(y), float(r)) for k, (x, y, r) in enumerate(zip(rng.normal(size=400), rng.normal(size=400), rng.gamma(1, 0.2, 400), strict=True))]
    rows += [(400, 0.0, 0.0, 9.0), (401, 20.0, 0.0, 1.0), (402, 22.0, 0.0, 1.0), (403, 20.0, 0.0, 0.0)]
    df = spark.createDataFrame([*rows, (404, 0.0, 0.0, -1.0), (405, None, 0.0, 1.0), (406, 0.0, 0.0, None)], "id long, x double, y double, r double")
    c = df.selectExpr("id", "struct(struct(x, y) AS center, r AS radius) AS c")
    want = {(a, b): np.hypot(x - u, y - v) - r - s for a, x, y, r in rows for b, u, v, s in rows if np.sqrt((x - u) ** 2 + (y - v) ** 2) <= r + s}
    got = X.overlapping(c, c)
    assert {(g.a, g.b): pytest.approx(g.gap, abs=1e-12) for g in got.collect()} == want and got.count() == len(want)
    one = X.overlapping(c, c, ordered=True)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((g.a, g.b) for g in one.collect()) == sorted(k for k in want if k[0] < k[1])
    assert X.overlapping(c.limit(0), c).count() == X.overlapping(c, c.limit(0)).count() == 0


def test_circle_pairs_take_little_room(spark, tmp_path):
    """Pairs with equal gaps are written together: under five bytes a pair (more than six before), and none is lost."""
    from pyspark.sql import functions as F

    from planewright.operators import circles as X

    rng = np.random.default_rng(5)
    x, y, r = rng.normal(size=2500), rng.normal(size=2500), rng.gamma(4, 0.5, 2500)
    df = spark.createDataFrame([(k, float(x[k]), float(y[k]), float(r[k])) for k in range(2500)], "id long, x double, y double, r double")
    c = df.selectExpr("id", "struct(struct(x, y) AS center, r AS radius) AS c")
    X.overlapping(c, c, ordered=True).select("a", "b", F.round("gap", 4).alias("gap")).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    a, b = np.triu_indices(2500, 1)
    gap = np.hypot(x[a] - x[b], y[a] - y[b]) - r[a] - r[b]
    n, *ids, total = got.agg(F.count("*"), F.sum("a"), F.sum("b"), F.sum("gap")).first()
    assert n == (gap <= 0).sum() and ids == [a[gap <= 0].sum(), b[gap <= 0].sum()] and total == pytest.approx(gap[gap <= 0].sum(), abs=1)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 5 * n


def test_circle_pairs_in_lots(monkeypatch):
    """Pairs by their definition and in order, whatever waits together: few, a leaf of one place, more seen circles than one number holds."""
    from planewright.operators import circles as X

    rng = np.random.default_rng(6)
    some = lambda n, r: (rng.permutation(n), *np.round(rng.normal(size=(2, n)), 2), np.full(n, r))
    for sorted_, pairs, held, seen in ((1 << 24, 1 << 18, some(300, 0.4), some(200, 0.3)), (500, 100, some(300, 0.4), some(200, 0.3)), (64, 7, (np.arange(90), np.zeros(90), np.zeros(90), np.ones(90)), some(50, 0.5))):
        monkeypatch.setattr(X, "SORTED", sorted_)
        monkeypatch.setattr(X, "PAIRS", pairs)
        monkeypatch.setattr(X, "LEAF", 16 if len(held[0]) > 90 else 512)
        for ordered in (False, True):
            d = np.sqrt((seen[1][:, None] - held[1]) ** 2 + (seen[2][:, None] - held[2]) ** 2)
            n, m = np.nonzero((d <= seen[3][:, None] + held[3]) & (~np.bool_(ordered) | (seen[0][:, None] < held[0])))
            want = set(zip(seen[0][n], held[0][m], d[n, m] - seen[3][n] - held[3][m], strict=True))
            a, b, gap = map(np.concatenate, zip(*X.overlaps(held, seen, ordered), strict=True))
            assert len(a) == len(want) and set(zip(a, b, gap, strict=True)) == want
            assert sorted_ < len(a) or (np.diff(gap.astype(np.float32)) <= 0).all()
    monkeypatch.undo()
    monkeypatch.setattr(X, "LEAF", 1 << 13)
    grid = np.arange(1 << 20)
    held = (grid, (grid % 1024).astype(float), (grid // 1024).astype(float), np.full(1 << 20, 0.1))
    rows = np.arange(0, 1 << 20, 251)
    a, b, gap = map(np.concatenate, zip(*X.overlaps(held, tuple(h[rows] for h in held), False), strict=True))
    assert len(rows) > 1 << 12 and sorted(a) == sorted(b) == rows.tolist() and np.allclose(gap, -0.2)


def test_batches_are_worked_on_by_rows(monkeypatch):
    """However many rows a batch has, a kernel's results are held for ROWS of them at a time."""
    rows = [[{"x": float(k), "y": 1.0}] * (k % 4) if k % 5 else None for k in range(50)]
    monkeypatch.setattr(P, "ROWS", 7)
    seen = []

    def run(lines):
        seen.append(len(lines))
        return P._values("points", (p * 2 for p in P.arrays_of(lines)))

    for batch in (pa.array(rows, LINE), pa.array(rows, LINE)[3:], pa.array([], LINE)):
        assert P.by_rows(run, batch).equals(run(batch))
    assert max(seen[:8]) == 7 and sum(seen[:8]) == 50
    packed = pa.StructArray.from_arrays([pa.array(rows, LINE)] * 2, ["c0", "c1"])
    both = lambda rows: P._values("double", (float(len(a) + b.sum()) for a, b in zip(*map(P.arrays_of, rows.flatten()), strict=True)))
    assert P.by_rows(both, packed[2:]).equals(both(packed[2:]))


def test_far_edges_are_not_compared_closely():
    """Edges meet only where their boxes do; all others cost a comparison, not the arithmetic of a crossing."""
    import tracemalloc

    from planewright.functions import overlay as O
    from planewright.functions import polygon_kernels as N

    t = np.linspace(0, 2 * np.pi, 4001)
    ring = np.stack([np.cos(t), np.sin(t)], 1)
    a, b = ring[:256], ring[1:257]
    tracemalloc.start()
    i, j, at = N._cuts(a, b, ring[:-1], ring[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    assert {(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if x != y} == {(k, n % 4000) for k in range(256) for n in (k - 1, k + 1)} and set(np.round(at, 9)) == {0.0, 1.0}
    assert all(len(x) == 0 for x in N._cuts(a[:0], b[:0], a, b))
    with pytest.raises(ValueError):
        O.outline([np.array([[0.0, 0.0], [np.inf, 0.0], [1.0, 1.0]])])


def test_first_hits_without_all_pairs(spark, monkeypatch, tmp_path):
    """By their definition over several rounds, with boxes that lack hits; and close boxes' pairs aren't made."""
    from planewright.operators import spatial as S
    from planewright.plans.catalog import QUERIES

    rng = np.random.default_rng(11)
    lows = np.concatenate([rng.random((300, 2)) * 3, rng.random((100, 2)) * 100, rng.random((9, 2)) * 3])
    size = np.concatenate([rng.random((400, 2)), np.full((9, 2), 50.0)])
    ids = [*rng.permutation(400).tolist(), *([7] * 9)]
    rows = [(i, *map(float, (*p, *(p + w)))) for i, p, w in zip(ids, lows, size, strict=True)]
    df = spark.createDataFrame([*rows, (500, None, 0.0, 1.0, 1.0), (501, 2.0, 0.0, 1.0, 1.0)], "i long, min_x double, min_y double, max_x double, max_y double")
    a, b = (df.selectExpr(f"i AS {n}_id", f"struct(min_x, min_y, max_x, max_y) AS {n}") for n in "ab")
    meet = lambda p, q: p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
    want = sorted((i, j) for i in set(ids) for j in sorted(q[0] for p in rows for q in rows if i == p[0] != q[0] and meet(p, q))[:3])
    for first in (1 << 15, 16, 5):
        monkeypatch.setattr(S, "FIRST", first)
        monkeypatch.setattr(S, "GROWTH", 3)
        assert sorted(map(tuple, S.first_meeting(a, b, 3).collect())) == want
    assert S.first_meeting(a, b.limit(0), 3).count() == S.first_meeting(a.limit(0), b, 3).count() == 0
    monkeypatch.setattr(S, "FIRST", 64)
    spark.createDataFrame([(k, [0.1 * (k % 3)] * 8, 0) for k in range(900)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    close = QUERIES["box_first_hits"](spark, str(tmp_path))
    assert "Join" not in close._jdf.queryExecution().executedPlan().toString() and close.count() == 1800
