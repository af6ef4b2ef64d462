"""Adaptive tiles: median cuts of a bounded sample, so that tiles hold like numbers of rows wherever those lie."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that comes to the driver, and tiles at most; beyond SAMPLE / 32 tiles' worth of rows, tiles grow with the rows.
SAMPLE, TILES = 1 << 18, 1 << 13


class Tree:
    """Median cuts of sampled points, always across the longer side; leaves are the tiles, numbered from 0."""

    def __init__(self, p: np.ndarray, leaves: int):
        self.axis: list[int] = []
        self.value: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaf: list[int] = []
        #: the part of the plane that each leaf takes (low x, low y, high x, high y), outermost sides endless
        self.rects: list[tuple[float, float, float, float]] = []
        self._cut(p, leaves, (-np.inf, -np.inf, np.inf, np.inf))

    def _cut(self, p: np.ndarray, leaves: int, rect: tuple[float, float, float, float]) -> int:
        node = len(self.axis)
        for kept in (self.axis, self.value, self.left, self.right, self.leaf):
            kept.append(-1)
        size = np.ptp(p, axis=0) if len(p) else np.zeros(2)
        axis = int(size.argmax())
        value = float(np.median(p[:, axis])) if len(p) else 0.0
        below = p[:, axis] < value
        if leaves < 2 or not below.any():
            self.leaf[node] = len(self.rects)
            self.rects.append(rect)
            return node
        self.axis[node], self.value[node] = axis, value
        low, high = list(rect), list(rect)
        high[axis], low[axis + 2] = value, value
        self.left[node] = self._cut(p[below], leaves // 2, tuple(low))
        self.right[node] = self._cut(p[~below], leaves - leaves // 2, tuple(high))
        return node

    def leaf_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The tile of each point: one below its cuts, or on and above them."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            below = (y if self.axis[node] else x)[rows] < self.value[node]
            todo += [(self.left[node], rows[below]), (self.right[node], rows[~below])]
        return out

    def around(self, leaves: np.ndarray) -> np.ndarray:
        """Boxes round the leaves' boxes (low x, low y, high x, high y) for every node; NaN where there is nothing."""
        out = np.full((len(self.axis), 4), np.nan)
        for node in range(len(self.axis) - 1, -1, -1):
            if self.leaf[node] >= 0:
                out[node] = leaves[self.leaf[node]]
            else:
                both = out[[self.left[node], self.right[node]]]
                with np.errstate(invalid="ignore"):
                    out[node] = [*np.fmin(*both[:, :2]), *np.fmax(*both[:, 2:])]
        return out

    def within(self, nodes: np.ndarray, x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and tiles whose box (from ``around``) is at most ``reach`` from the row's point."""
        rows_out, leaf_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            a, b, c, d = nodes[node]
            gap = np.hypot(np.maximum(0, np.maximum(a - x[rows], x[rows] - c)), np.maximum(0, np.maximum(b - y[rows], y[rows] - d)))
            rows = rows[gap <= reach[rows] * (1 + 1e-12)]
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                rows_out.append(rows)
                leaf_out.append(np.full(len(rows), self.leaf[node]))
            else:
                todo += [(self.left[node], rows), (self.right[node], rows)]
        return np.concatenate(rows_out), np.concatenate(leaf_out)

    def grown(self, p: np.ndarray, share: float) -> np.ndarray:
        """The leaves' parts of the plane, wider by a share of their extent within the sample's box."""
        rects = np.array(self.rects)
        low, high = (p.min(0), p.max(0)) if len(p) else (np.zeros(2), np.zeros(2))
        size = np.minimum(rects[:, 2:], high) - np.maximum(rects[:, :2], low)
        return rects + np.concatenate([-size, size], axis=1) * share


def cuts(rows: DataFrame, group: str, size: int, x: str = "x", y: str = "y", most: int = TILES, sample: int = SAMPLE) -> dict[object, tuple[Tree, np.ndarray]]:
    """Trees, with their samples, of the groups with more than ``size`` rows, whose tiles hold about ``size`` rows.

    There are ``most`` such groups and about twice as many tiles at the most: where the rows exceed
    what those hold at ``size``, that grows with them. Rows in one place can't be cut apart.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = max(size, -(-total // most))
    large = {r[0]: r["n"] for r in counts.filter(F.col("n") > size).collect()}
    if not large:
        return {}
    share = min(1.0, sample / sum(large.values()))
    held = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(g,) for g in large], rows.select(group).schema)), group)
    lot = F.pmod(F.xxhash64(F.lit("tiles"), x, y), F.lit(1 << 30))
    drawn = held.filter(lot < int(share * (1 << 30))).select(group, x, y).toPandas()
    out = {}
    for g, part in drawn.groupby(group, sort=False):
        p = part[[x, y]].to_numpy(float)
        out[g] = (Tree(p, max(2, -(-large[g] // size))), p)
    return out
