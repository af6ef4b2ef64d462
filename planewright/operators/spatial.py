"""Spatial joins over grid cells: the theta condition gets an equality key, so that Spark can shuffle or hash it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planewright.functions import geometry as G
from planewright.operators.components import components, cut


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _around(df: DataFrame, p: str, size: float | str) -> DataFrame:
    """Each row in its cell and the eight next to it; ``size`` is a number or an SQL expression of one."""
    near = F.explode(F.expr(f"flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(cast(floor({p}.x / ({size})) AS bigint) + i AS cx, cast(floor({p}.y / ({size})) AS bigint) + j AS cy))))"))
    return df.withColumn("__c", near).withColumns({"cx": F.col("__c.cx"), "cy": F.col("__c.cy")}).drop("__c")


def within_distance(left: DataFrame, right: DataFrame, radius: float, lp: str = "p", rp: str = "q") -> DataFrame:
    """Pairs of rows whose points are at most ``radius`` apart.

    Cells have the radius as their side; the left rows go to the nine cells round theirs and meet
    the right rows in exactly one of them. Column names must not clash.
    """
    l = _around(left, lp, radius)
    r = right.withColumns({"cx": cell(F.col(f"{rp}.x"), radius), "cy": cell(F.col(f"{rp}.y"), radius)})
    return l.join(r, ["cx", "cy"]).filter(G.distance(F.col(lp), F.col(rp)) <= radius).drop("cx", "cy")


def overlapping_circles(left: DataFrame, right: DataFrame, l: str = "c", r: str = "d") -> DataFrame:
    """Pairs of rows whose circles (struct<center, radius>) overlap or touch, however unlike their radii are.

    Circles are classed by the power of two that holds their radius (all below a 1024th of the
    largest are one class), and any two classes meet on cells a little wider than the sum of their
    largest radii: a right row has a cell for each class of the left, a left row nine for each of
    the right. Null and negative radii have no pair. Column names must not clash.
    """
    lefts, rights = left.filter(F.col(f"{l}.radius") >= 0), right.filter(F.col(f"{r}.radius") >= 0)
    most = max((df.agg(F.max(f"{c}.radius")).first()[0] or 0.0 for df, c in ((lefts, l), (rights, r))), default=0.0)
    top = math.ceil(math.log2(most)) if most > 0 else 0
    power = lambda c: F.least(F.greatest(F.ceil(F.log2(F.col(f"{c}.radius"))), F.lit(top - 10)), F.lit(top)).cast("int")
    lefts, rights = lefts.withColumn("__k", power(l)), rights.withColumn("__m", power(r))
    classes = lambda df, k: F.array(*(F.lit(x[0]) for x in sorted(df.select(k).distinct().collect()))).cast("array<int>")
    lefts, rights = lefts.withColumn("__m", F.explode(classes(rights, "__m"))), rights.withColumn("__k", F.explode(classes(lefts, "__k")))
    side = "(pow(2D, __k) + pow(2D, __m)) * 1.000001D"
    lefts = _around(lefts.withColumn("__p", F.col(f"{l}.center")), "__p", side).drop("__p")
    rights = rights.withColumns({f"c{x}": F.expr(f"cast(floor({r}.center.{x} / ({side})) AS bigint)") for x in "xy"})
    return lefts.join(rights, ["__k", "__m", "cx", "cy"]).filter(G.circles_overlap(F.col(l), F.col(r))).drop("__k", "__m", "cx", "cy")


#: Levels of box sizes below the largest that are told apart, and boxes of a level that are broadcast at most.
LEVELS, FEW = 20, 8192


def _level(b: str) -> Column:
    """The power of two that holds a box's longer side; null for a point."""
    side = F.greatest(F.col(f"{b}.max_x") - F.col(f"{b}.min_x"), F.col(f"{b}.max_y") - F.col(f"{b}.min_y"))
    return F.when(side > 0, F.ceil(F.log2(side)).cast("int"))


def _levels(boxes: DataFrame, b: str) -> tuple[DataFrame, dict[int, int]]:
    """Boxes with ``__l``, their level, and how many there are of each; boxes below LEVELS levels count with the lowest."""
    boxes = boxes.filter(F.col(f"{b}.min_x") <= F.col(f"{b}.max_x")).filter(F.col(f"{b}.min_y") <= F.col(f"{b}.max_y"))
    top = boxes.agg(F.max(_level(b))).first()[0]
    level = F.lit(0) if top is None else F.coalesce(F.greatest(_level(b), F.lit(top - LEVELS)), F.lit(top - LEVELS))
    boxes = boxes.withColumn("__l", level)
    return boxes, {r[0]: r[1] for r in boxes.groupBy("__l").agg(F.count("*")).collect()}


def _at_level(v: str, level: str) -> str:
    return f"cast(floor({v} / pow(2D, {level})) AS bigint)"


def _own_cells(boxes: DataFrame, b: str, level: str) -> DataFrame:
    """Each box in the cells of a level that it touches: four at the most, as no box is wider than a cell."""
    along = lambda x: f"sequence({_at_level(f'{b}.min_{x}', level)}, {_at_level(f'{b}.max_{x}', level)})"
    return boxes.withColumn("__c", F.expr(f"explode(flatten(transform({along('x')}, i -> transform({along('y')}, j -> struct(i AS cx, j AS cy)))))")).withColumns({"cx": F.col("__c.cx"), "cy": F.col("__c.cy")}).drop("__c")


def _levels_of(known: dict[int, int]) -> Column:
    return F.explode(F.array(*(F.lit(k) for k in sorted(known))))


def in_boxes(boxes: DataFrame, points: DataFrame, b: str = "b", p: str = "p") -> DataFrame:
    """(box, point) rows with the point in the closed box. Column names must not clash.

    A box lies in at most four cells of a grid as coarse as the box, whatever its size; a point is
    looked up once on each level that has boxes. Levels of few boxes, such as the largest, which
    hold a large share of all points in a cell, are broadcast, so that the points stay where they are.
    """
    boxes, known = _levels(boxes, b)
    points = points.filter(F.col(f"{p}.x").isNotNull() & F.col(f"{p}.y").isNotNull())
    few = {k for k, n in known.items() if n <= FEW}
    out = []
    for levels, small in ((few, True), (set(known) - few, False)):
        if levels:
            held = _own_cells(boxes.filter(F.col("__l").isin(list(levels))), b, "__l")
            at = points.withColumn("__l", _levels_of(dict.fromkeys(levels, 0))).withColumns({f"c{x}": F.expr(_at_level(f"{p}.{x}", "__l")) for x in "xy"})
            out.append((F.broadcast(held) if small else held).join(at, ["__l", "cx", "cy"]).filter(G.box_contains(F.col(b), F.col(p))).drop("__l", "cx", "cy"))
    if not out:
        return boxes.drop("__l").limit(0).join(points.limit(0), F.lit(False))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def boxes_meeting(left: DataFrame, right: DataFrame, l: str = "b", r: str = "o") -> DataFrame:
    """Pairs of rows whose closed boxes share a point. Column names must not clash.

    Any two levels of boxes meet on the coarser one's cells, where each box has four at the most; a
    pair counts in the cell of its shared part's lower left corner only.
    """
    (left, lefts), (right, rights) = _levels(left, l), _levels(right, r)
    if not lefts or not rights:
        return left.drop("__l").limit(0).join(right.drop("__l").limit(0), F.lit(False))
    both = F.greatest("__l", "__m")
    a = _own_cells(left.withColumn("__m", _levels_of(rights)).withColumn("__g", both), l, "__g")
    b = _own_cells(right.withColumnRenamed("__l", "__m").withColumn("__l", _levels_of(lefts)).withColumn("__g", both), r, "__g").drop("__g")
    corner = [F.expr(f"c{x} = {_at_level(f'greatest({l}.min_{x}, {r}.min_{x})', '__g')}") for x in "xy"]
    return a.join(b, ["__l", "__m", "cx", "cy"]).filter(corner[0] & corner[1] & G.boxes_meet(F.col(l), F.col(r))).drop("__l", "__m", "__g", "cx", "cy")


def first_hits(hits: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """At most n rows a query, the smallest of ``order``: a report, not a cap on what is searched."""
    ranked = hits.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return ranked.filter(F.col("__r") <= n).drop("__r")


#: Boxes with the smallest ids that every query is held against at once, how many times more the next ones are, and comparisons made together.
FIRST, GROWTH, TOGETHER = 1 << 15, 8, 1 << 18


def _first_of(asked: tuple[np.ndarray, ...], held: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """For boxes (id, low x, low y, high x, high y) the ids of the first n held ones of another id that meet them, row by row, and how many those are."""
    asked, held = ((b[0], *(np.where(np.isnan(v), np.inf, v) for v in b[1:])) for b in (asked, held))
    found, count = np.zeros((len(asked[0]), n), np.int64), np.zeros(len(asked[0]), np.int64)
    todo, at, width = np.arange(len(count)), 0, 64
    while len(todo) and at < len(held[0]):
        i, lx, ly, hx, hy = (v[at : at + width] for v in held)
        step = max(1, TOGETHER // len(i))
        for k in range(0, len(todo), step):
            rows = todo[k : k + step]
            j, u, v, w, z = (c[rows, None] for c in asked)
            met = (lx <= w) & (u <= hx) & (ly <= z) & (v <= hy) & (i != j)
            place = met.cumsum(1) + count[rows, None]
            a, b = np.nonzero(met & (place <= n))
            found[rows[a], place[a, b] - 1] = i[b]
            count[rows] = np.minimum(place[:, -1], n)
        todo, at, width = todo[count[todo] < n], at + width, min(4096, width * GROWTH)
    return found[np.arange(n) < count[:, None]], count


def first_meeting(left: DataFrame, right: DataFrame, n: int, lid: str = "a_id", rid: str = "b_id", l: str = "a", r: str = "b") -> DataFrame:
    """(lid, rid): for each left id the n smallest ids of right boxes that meet its box and have another id; all of them if there are fewer.

    Where boxes lie close the pairs grow as the square of the rows, so they aren't made: all are held
    against the boxes with the smallest ids, and those that lack hits go on to the next ones, each
    time GROWTH times as many, so that a box meets a few times n in a round.
    """
    edges = ("min_x", "min_y", "max_x", "max_y")

    def plain(df: DataFrame, i: str, b: str) -> DataFrame:
        rows = df.select(F.col(i).cast("long").alias("id"), *(F.col(f"{b}.{e}").cast("double").alias(e) for e in edges)).dropna()
        return rows.filter("min_x <= max_x AND min_y <= max_y")

    there = plain(right, rid, r)
    lowest = there.orderBy("id").limit(FIRST + 1).toPandas()
    whole, border = len(lowest) <= FIRST, int(lowest["id"].max()) if len(lowest) else 0
    lowest = lowest if whole else lowest[lowest["id"] < border]  # rows of one id stay together
    held = left.sparkSession.sparkContext.broadcast(tuple(lowest[c].to_numpy() for c in ("id", *edges)))

    def met(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, count = _first_of(tuple(c.to_numpy() for c in batch.columns), held.value, n)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", *edges, "ids"])

    found = plain(left, lid, l).mapInArrow(met, f"id long, {', '.join(f'{e} double' for e in edges)}, ids array<long>")
    out = [found]
    if not whole:
        todo, total = cut(found.withColumn("row", F.monotonically_increasing_id())), there.count()
        shares = [FIRST * GROWTH**k / total for k in range(1, 64) if FIRST * GROWTH**k < total]
        later = {int(x) for x in there.approxQuantile("id", shares, FIRST / total / 4)} if shares else set()
        borders = [border, *sorted(x for x in later if x > border), None]
        out = []
        for low, high in zip(borders, borders[1:], strict=False):
            out.append(todo.filter(F.size("ids") >= n))
            todo = todo.filter(F.size("ids") < n)
            if todo.isEmpty():
                break
            box = F.struct(*edges)
            some = there.filter(F.col("id") >= low if high is None else (F.col("id") >= low) & (F.col("id") < high))
            pairs = boxes_meeting(todo.select("row", F.col("id").alias("i"), box.alias("b")), some.select(F.col("id").alias("j"), box.alias("o"))).filter("i <> j")
            more = first_hits(pairs.select("row", "j"), "row", "j", n).groupBy("row").agg(F.sort_array(F.collect_list("j")).alias("more"))
            ids = F.slice(F.concat("ids", F.coalesce("more", F.array().cast("array<long>"))), 1, n)
            todo = cut(todo.join(more, "row", "left").select("id", *edges, ids.alias("ids"), "row"))
        out.append(todo)
    every = reduce(DataFrame.unionByName, out).select(F.col("id").alias(lid), F.explode("ids").alias(rid))
    return first_hits(every, lid, rid, n)  # rows of one id share their hits


#: Pairs of points that two boxes may have for all of them to be looked at; and the step of a grid on which points in different places have boxes of their own.
PAIRS, APART = 256, 26


def _refined(placed: DataFrame, todo: DataFrame, side: float, step: int, finer: int) -> DataFrame:
    """Pairs of boxes of points on the grid of step ``finer`` in place of ``todo``, the pairs still open on that of ``step``."""
    grid = lambda n, names: {c: F.floor(F.col(v) / side * 4.0**n).cast("decimal(38,0)") for c, v in zip(names, "xy", strict=True)}
    own = todo.select(F.explode(F.array(*(F.struct(*(F.col(f"{n}_{c}").alias(c) for c in ("cx", "cy", "bx", "by"))) for n in "ab"))).alias("k")).select("k.*").distinct()
    parts = placed.withColumns(grid(finer, ("nx", "ny"))).withColumns(grid(step, ("bx", "by"))).join(own, ["cx", "cy", "bx", "by"], "left_semi")
    boxes = parts.groupBy("cx", "cy", "bx", "by", "nx", "ny").agg(*_extent())
    for n in "ab":
        todo = todo.join(boxes.select(*(F.col(c).alias(f"{n}_{c}") for c in boxes.columns)), [f"{n}_{c}" for c in ("cx", "cy", "bx", "by")])
    return todo.drop("a_bx", "a_by", "b_bx", "b_by").withColumnsRenamed({f"{n}_n{v}": f"{n}_b{v}" for n in "ab" for v in "xy"})


def _extent() -> list[Column]:
    return [F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("hx"), F.max("y").alias("hy"), F.count("*").alias("n")]


def _judged(pairs: DataFrame, eps: float) -> DataFrame:
    """Pairs of boxes (a_lx .. b_hy) that may hold points within eps, and in ``sure`` whether all of theirs are."""
    gap = "sqrt(pow(greatest(0D, a_lx - b_hx, b_lx - a_hx), 2) + pow(greatest(0D, a_ly - b_hy, b_ly - a_hy), 2))"
    span = "sqrt(pow(greatest(a_hx - b_lx, b_hx - a_lx), 2) + pow(greatest(a_hy - b_ly, b_hy - a_ly), 2))"
    kept = ["a_root", "b_root", "sure", (F.col("a_n") * F.col("b_n") <= PAIRS).alias("few"), *(f"{n}_{c}" for n in "ab" for c in ("cx", "cy", "bx", "by"))]
    return cut(pairs.filter(F.expr(gap) <= eps).withColumn("sure", F.expr(span) <= eps).select(*kept))


def welded(points: DataFrame, eps: float, pid: str = "id", p: str = "p") -> DataFrame:
    """(id, cluster): points at most ``eps`` apart are one cluster, over any number of steps; its name is the smallest id.

    The points of a cell whose diagonal is eps are one cluster to begin with, so only cells are
    linked, with the twenty cells within reach of each. The boxes round the points of two cells tell
    most links: they are near enough throughout, or too far throughout. What they leave open goes to
    a grid four times finer, until a link is found or none can be; only boxes of a few points have
    all their pairs looked at.
    Points without a coordinate stay alone.
    """
    rows = points.select(F.col(pid).alias("id"), F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y"))
    placed = rows.dropna(subset=["x", "y"])
    if eps <= 0:
        found = placed.join(placed.groupBy("x", "y").agg(F.min("id").alias("cluster")), ["x", "y"]).select("id", "cluster")
        return found.unionByName(rows.filter("x IS NULL OR y IS NULL").select("id", F.col("id").alias("cluster")))
    side = eps / 2**0.5 * (1 - 1e-12)
    placed = placed.withColumns({f"c{v}": F.floor(F.col(v) / side).cast("long") for v in "xy"})
    cells = cut(placed.groupBy("cx", "cy").agg(F.min("id").alias("root"), *_extent()))
    # of the cells within reach those on one side, so that two cells meet once
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0) and abs(i) + abs(j) < 4]
    offset = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    a, b = (cells.select(*(F.col(c).alias(f"{n}_{c}") for c in cells.columns)) for n in "ab")
    a = a.withColumn("o", offset).withColumns({"b_cx": F.col("a_cx") + F.col("o.i"), "b_cy": F.col("a_cy") + F.col("o.j")}).drop("o")
    pairs = _judged(a.join(b, ["b_cx", "b_cy"]).withColumns({f"{n}_b{v}": F.col(f"{n}_c{v}").cast("decimal(38,0)") for n in "ab" for v in "xy"}), eps)
    links, pending = [], {0: pairs}
    while pending:
        step = min(pending)
        pairs = pending.pop(step)
        links.append(pairs.filter("sure").select("a_root", "b_root").distinct())
        todo = cut(pairs.filter("NOT sure").join(reduce(DataFrame.unionByName, links).distinct(), ["a_root", "b_root"], "left_anti").drop("sure"))
        for part, finer in ((todo.filter("few"), max(APART, step + 1)), (todo.filter("NOT few"), step + 1)):
            if not part.isEmpty():
                more = _judged(_refined(placed, part.drop("few"), side, step, finer), eps)
                pending[finer] = pending[finer].unionByName(more) if finer in pending else more
    label = components(reduce(DataFrame.unionByName, links).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    roots = cells.join(label, cells["root"] == label["node"], "left").select("cx", "cy", F.coalesce(label["root"], cells["root"]).alias("cluster"))
    found = placed.join(roots, ["cx", "cy"]).select("id", "cluster")
    return found.unionByName(rows.filter("x IS NULL OR y IS NULL").select("id", F.col("id").alias("cluster")))


def welded_points(points: DataFrame, eps: float, pid: str = "id", p: str = "p", keep_first: bool = False) -> DataFrame:
    """(cluster, n, x, y): each cluster's mean point, or the point of its smallest id."""
    rows = welded(points, eps, pid, p).join(points.select(F.col(pid).alias("id"), F.col(p).alias("__p")), "id")
    at = (lambda f: F.min_by(f"__p.{f}", "id")) if keep_first else (lambda f: F.avg(f"__p.{f}"))
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), at("x").alias("x"), at("y").alias("y"))


def snapped(p: Column, size: float) -> Column:
    """The nearest grid point."""
    return G.point(F.round(p.x / size) * size, F.round(p.y / size) * size)
