"""Pairs of circles that overlap, on median tiles of one side, each pair found once.

Where most circles overlap, the pairs grow as the square of the rows, so all else must stay small: a
circle of one side lies in one tile, one of the other goes to the tiles that it reaches, of which
there are about TILES unless they would hold more than LARGEST rows. A task keeps its tile's numbers,
takes the visitors in lots and gives pairs out in order of their gaps, SORTED of them at a time; no
pair is shuffled, and no more are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewright.operators.components import cut
from planewright.operators.tiles import Tree, cuts

#: Tiles, the rows that a tile holds at least and at most, tasks that share a tile's visitors at most, and visitors for which there is one.
TILES, SMALLEST, LARGEST, LOTS, VISITORS = 8, 1 << 13, 1 << 20, 8, 1 << 11
#: Circles of a tile's own parts, pairs looked at together, and pairs put in order of their gaps together (8 bytes each).
LEAF, PAIRS, SORTED = 512, 1 << 18, 1 << 24


def _extents(leaf: np.ndarray, n: int, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Boxes (low x, low y, high x, high y) round the circles of each of n leaves; NaN where there is none."""
    out = np.full((n, 4), np.nan)
    for k, (v, least) in enumerate(((x - r, True), (y - r, True), (x + r, False), (y + r, False))):
        (np.fmin if least else np.fmax).at(out[:, k], leaf, v)
    return out


def overlaps(held: tuple[np.ndarray, ...], seen: tuple[np.ndarray, ...], ordered: bool, parts: tuple | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of seen and held circles (id, x, y, r each) that overlap or touch, and their gaps, some at a time; ``ordered`` only those with the smaller id seen.

    About SORTED pairs at a time are put in order of their gaps: rows with equal gaps follow each other and take less room in files.
    """
    tree, nodes, members = parts or divided(held)
    i, x, y, r = held
    j, u, v, s = seen
    # a pair waits as the bits of its gap, its seen and its held circle, in one number
    width = max(1, len(i) - 1).bit_length()
    low, most = np.uint64((1 << width) - 1), 1 << max(0, 32 - width)

    def gaps(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt((u[n] - x[m]) ** 2 + (v[n] - y[m]) ** 2)
        return d <= s[n] + r[m], d - s[n] - r[m]

    def given(keys: np.ndarray, first: int) -> Iterator:
        keys.sort()
        for lo in range(0, len(keys), PAIRS):
            code = keys[lo : lo + PAIRS] & np.uint64(0xFFFFFFFF)
            n, m = (code >> np.uint64(width)).astype(np.int64) + first, (code & low).astype(np.int64)
            yield j[n], i[m], gaps(n, m)[1]

    for first in range(0, len(j), most):
        some = slice(first, first + most)
        row, leaf = tree.within(nodes, u[some], v[some], s[some])
        order = np.argsort(leaf, kind="stable")
        keys, filled = np.empty(SORTED + PAIRS, np.uint64), 0
        for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) if len(order) else []:
            own, rows = members[leaf[part[0]]], row[part]
            for m in np.split(own, range(PAIRS, len(own), PAIRS)):
                step = max(1, PAIRS // len(m))
                for lo in range(0, len(rows), step):
                    n = rows[lo : lo + step]
                    met, gap = gaps(n[:, None] + first, m)
                    if ordered:
                        met &= j[n + first, None] < i[m]
                    a, b = np.nonzero(met)
                    depth = np.abs(gap[a, b]).astype(np.float32).view(np.uint32).astype(np.uint64)
                    keys[filled : filled + len(a)] = depth << np.uint64(32) | n[a].astype(np.uint64) << np.uint64(width) | m[b].astype(np.uint64)
                    filled += len(a)
                    if filled >= SORTED:
                        yield from given(keys[:filled], first)
                        filled = 0
        yield from given(keys[:filled], first)


def divided(held: tuple[np.ndarray, ...]) -> tuple[Tree, np.ndarray, list[np.ndarray]]:
    """A tree over circles, the box round the circles below each node, and the circles of each leaf."""
    _, x, y, r = held
    tree = Tree(np.stack([x, y], 1), max(1, -(-len(x) // LEAF)))
    leaf = tree.leaf_of(x, y)
    own = np.argsort(leaf, kind="stable")
    border = np.searchsorted(leaf[own], np.arange(len(tree.rects) + 1))
    return tree, tree.around(_extents(leaf, len(tree.rects), x, y, r)), [own[a:b] for a, b in zip(border[:-1], border[1:], strict=True)]


def overlapping(left: DataFrame, right: DataFrame, ordered: bool = False, lid: str = "id", rid: str = "id", l: str = "c", r: str = "c") -> DataFrame:
    """(a, b, gap): ids of circles (struct<center, radius>) of the left and of the right that overlap or touch; ``ordered`` only those with a < b.

    Circles without an id or a finite number, or with a negative radius, have no pair.
    """
    spark = left.sparkSession

    def plain(df: DataFrame, i: str, c: str) -> DataFrame:
        rows = df.select(F.col(i).cast("long").alias("id"), *(F.col(f"{c}.{f}").cast("double").alias(n) for f, n in (("center.x", "x"), ("center.y", "y"), ("radius", "r"))))
        return rows.filter("r >= 0 AND r < double('inf') AND abs(x) < double('inf') AND abs(y) < double('inf')").dropna()

    there = cut(plain(right, rid, r).withColumn("__g", F.lit(0)))
    n = there.count()
    tree = cuts(there, "__g", min(LARGEST, max(SMALLEST, -(-n // TILES)))).get(0, (Tree(np.zeros((0, 2)), 1), None))[0]
    where = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            tile = where.value.leaf_of(*(batch.column(k).to_numpy() for k in (1, 2)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(tile)], ["id", "x", "y", "r", "tile"])

    there = cut(there.select("id", "x", "y", "r").mapInArrow(placed, "id long, x double, y double, r double, tile long"))
    boxes = np.full((len(tree.rects), 4), np.nan)
    for row in there.groupBy("tile").agg(F.min(F.expr("x - r")), F.min(F.expr("y - r")), F.max(F.expr("x + r")), F.max(F.expr("y + r"))).collect():
        boxes[row[0]] = row[1:]
    known = spark.sparkContext.broadcast(tree.around(boxes))

    def visiting(batches: Iterator) -> Iterator:
        """Each left circle once for every tile that it may reach."""
        import pyarrow as pa

        for batch in batches:
            row, tile = where.value.within(known.value, *(batch.column(k).to_numpy() for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(tile)], ["id", "x", "y", "r", "tile"])

    here = cut(plain(left, lid, l).mapInArrow(visiting, "id long, x double, y double, r double, tile long"))
    lots = F.least(F.lit(LOTS), F.ceil(F.count("*") / VISITORS)).cast("int")
    many = F.broadcast(spark.createDataFrame(here.groupBy("tile").agg(lots.alias("lots")).collect(), "tile long, lots int"))
    dealt = here.join(many, "tile").withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int"))
    copied = there.join(many, "tile").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    both = copied.withColumn("side", F.lit(0)).unionByName(dealt.withColumn("side", F.lit(1))).select("tile", "lot", "side", "id", "x", "y", "r")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, held, parts = None, [], None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            group = np.stack(columns[:3], 1)
            edge = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            for a, b in zip(np.append(0, edge), np.append(edge, len(group)), strict=True):
                if now != tuple(group[a, :2]):
                    now, held, parts = tuple(group[a, :2]), [], None
                piece = tuple(c[a:b] for c in columns[3:])
                if group[a, 2] == 0:
                    held.append(piece)
                elif held:
                    if parts is None:
                        held = [tuple(map(np.concatenate, zip(*held, strict=True)))]
                        parts = divided(held[0])
                    for found in overlaps(held[0], piece, ordered, parts):
                        yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], ["a", "b", "gap"])

    n_tasks = max(1, sum(x[0] for x in many.select("lots").collect()))
    return both.repartition(n_tasks, "tile", "lot").sortWithinPartitions("tile", "lot", "side").mapInArrow(run, "a long, b long, gap double")
