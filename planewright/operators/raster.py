"""Distance transforms of rasters held as rows (grid_id, gx, gy, feature); any number of rasters at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewright.functions import geometry as G


def euclidean_row(xs: np.ndarray, vs: np.ndarray) -> np.ndarray:
    """Distances along a row of cells at ascending places whose columns' nearest features are ``vs`` steps away (-1: none); NaN without any.

    The lower envelope of the parabolas over the columns, in time proportional to the row: a parabola
    leaves the stack when the next one meets the one below it further left.
    """
    at, height = xs[vs >= 0].tolist(), (vs[vs >= 0] ** 2).tolist()
    if not at:
        return np.full(len(xs), np.nan)
    stack, starts = [0], [-np.inf]
    for k in range(1, len(at)):
        while True:
            j = stack[-1]
            meet = (height[k] + at[k] * at[k] - height[j] - at[j] * at[j]) / (2 * (at[k] - at[j]))
            if meet > starts[-1]:
                break
            stack.pop()
            starts.pop()
        stack.append(k)
        starts.append(meet)
    best = np.array(stack)[np.searchsorted(np.array(starts), xs, "right") - 1]
    return np.sqrt(((xs - np.array(at)[best]) ** 2 + np.array(height)[best]).astype(np.float64))


def chamfer_row(xs: np.ndarray, vs: np.ndarray) -> np.ndarray:
    """The same with steps of 3 and 4, in units of a straight step.

    The best column moves right with the cell, so halving the row halves what each half must look at:
    all middle cells of one depth look at little more than the row.
    """
    at, up = xs[vs >= 0], vs[vs >= 0]
    out = np.full(len(xs), np.nan)
    if not len(at):
        return out
    first, last = np.zeros(1, np.int64), np.array([len(xs) - 1])  # parts of the row, and of the columns that may serve them
    low, high = np.zeros(1, np.int64), np.array([len(at) - 1])
    while len(first):
        mid, size = (first + last) // 2, high - low + 1
        begin = np.cumsum(size) - size
        k = np.arange(size.sum()) - np.repeat(begin - low, size)
        x = np.abs(np.repeat(xs[mid], size) - at[k])
        d = 3 * np.maximum(x, up[k]) + np.minimum(x, up[k])
        least = np.minimum.reduceat(d, begin)
        hit = np.flatnonzero(d == np.repeat(least, size))
        own = np.repeat(np.arange(len(mid)), size)[hit]
        best = k[hit[np.append(True, own[1:] != own[:-1])]]
        out[mid] = least / 3.0
        first, last, low, high = (np.concatenate(x) for x in ((first, mid + 1), (mid - 1, last), (low, best), (best, high)))
        keep = first <= last
        first, last, low, high = first[keep], last[keep], low[keep], high[keep]
    return out


def _flat(rows: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of a batch of arrays of structs from end to end, and where each row begins and the last ends."""
    return [f.to_numpy(zero_copy_only=False) for f in rows.flatten().flatten()], np.append(0, np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False)))


def _lists(names: list[str], columns: list[np.ndarray], bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], names))


def _steps(ys: np.ndarray, marked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How far each cell is from the nearest marked one of its column, -1 without any; columns lie end to end, each in order."""
    n, far = len(ys), np.iinfo(np.int64).max
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(marked, at, -1)) if n else at
    after = np.minimum.accumulate(np.where(marked, at, n)[::-1])[::-1] if n else at
    down = np.where(before >= bounds[own], ys - ys[np.maximum(before, 0)], far)
    up = np.where(after < bounds[own + 1], ys[np.minimum(after, n - 1)] - ys, far)
    steps = np.minimum(down, up)
    return np.where(steps == far, -1, steps)


def _transform(cells: DataFrame, along: Callable[[np.ndarray, np.ndarray], np.ndarray], marks: list[Column]) -> DataFrame:
    """(grid_id, gx, gy, d0, ...): in two passes the nearest marked cell in each cell's column, then the best column of each row, for every mark at once.

    ``along`` gives the distances of a row's cells from their places and their columns' steps.
    Cells of a raster without a marked one have null. A task holds a batch of columns or rows of
    rasters at a time; whole columns and rows go through the shuffles.
    """
    names = [f"d{k}" for k in range(len(marks))]
    held = cells.select("grid_id", F.col("gx").cast("long").alias("gx"), F.struct(F.col("gy").cast("long").alias("at"), *(F.coalesce(m, F.lit(False)).alias(n) for m, n in zip(marks, names, strict=True))).alias("c"))

    def columns(rows: pa.Array) -> pa.Array:
        (ys, *marked), bounds = _flat(rows)
        return _lists(["at", *names], [ys, *(_steps(ys, m.astype(bool), bounds) for m in marked)], bounds)

    def lines(rows: pa.Array) -> pa.Array:
        (xs, *steps), bounds = _flat(rows)
        parts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        return _lists(["at", *names], [xs, *(np.concatenate([np.zeros(0), *(along(xs[a:b], v[a:b]) for a, b in parts)]) for v in steps)], bounds)

    kind = lambda of: f"array<struct<at: bigint, {', '.join(f'{n}: {of}' for n in names)}>>"
    gathered = lambda df, key: df.groupBy("grid_id", key).agg(F.array_sort(F.collect_list("c")).alias("c"))
    near = gathered(held, "gx").select("grid_id", "gx", F.explode(F.arrow_udf(columns, kind("bigint"))("c")).alias("k"))
    turned = near.select("grid_id", F.col("k.at").alias("gy"), F.struct(F.col("gx").alias("at"), *(f"k.{n}" for n in names)).alias("c"))
    each = gathered(turned, "gy").select("grid_id", "gy", F.explode(F.arrow_udf(lines, kind("double"))("c")).alias("k"))
    return each.select("grid_id", F.col("k.at").alias("gx"), "gy", *(F.nanvl(f"k.{n}", F.lit(None).cast("double")).alias(n) for n in names))


def distance_transform(cells: DataFrame, feature: str = "feature", out: str = "distance") -> DataFrame:
    """Exact Euclidean distance of every cell to the nearest feature cell."""
    return _transform(cells, euclidean_row, [F.col(feature)]).withColumnRenamed("d0", out)


def chamfer_transform(cells: DataFrame, feature: str = "feature", out: str = "distance") -> DataFrame:
    """Chamfer distance with steps of 3 (straight) and 4 (diagonal), in units of a straight step."""
    return _transform(cells, chamfer_row, [F.col(feature)]).withColumnRenamed("d0", out)


def signed_transform(cells: DataFrame, feature: str = "feature", out: str = "distance") -> DataFrame:
    """Distance to the nearest feature outside, minus that to the nearest other cell inside."""
    both = _transform(cells, euclidean_row, [F.col(feature), ~F.col(feature)])
    return both.select("grid_id", "gx", "gy", (F.col("d0") - F.col("d1")).alias(out))


def field_of(width: int, height: int, origin: tuple[float, float], cell: float, measure: Callable[[Column], Column]) -> Column:
    """A field's values at its cells' centres, row by row, as an array: a signed distance grid of any shape."""
    at = lambda k: G.point(origin[0] + (k % width + 0.5) * cell, origin[1] + (F.floor(k / width) + 0.5) * cell)
    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: measure(at(k)))


def field_with(values: Column, width: int, i: Column | int, j: Column | int, value: Column) -> Column:
    """The same field with another value in one cell; cells outside change nothing."""
    i, j = (x if isinstance(x, Column) else F.lit(x) for x in (i, j))
    inside = (i >= 0) & (i < width) & (j >= 0)
    return F.transform(values, lambda v, k: F.when(inside & (k == j * width + i), value).otherwise(v))


def field_at(values: Column, width: int, height: int, origin: tuple[float, float], cell: float, p: Column) -> Column:
    """Bilinear between cell centres; the border's values go on outside."""
    clamped = lambda v, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v))
    u, v = clamped((p.x - origin[0]) / cell - 0.5, width - 1), clamped((p.y - origin[1]) / cell - 0.5, height - 1)
    i, j = F.least(F.floor(u), F.lit(max(0, width - 2))), F.least(F.floor(v), F.lit(max(0, height - 2)))
    value = lambda di, dj: F.get(values, (F.least(j + dj, F.lit(height - 1)) * width + F.least(i + di, F.lit(width - 1))).cast("int"))
    fu, fv = u - i, v - j
    return (value(0, 0) * (1 - fu) + value(1, 0) * fu) * (1 - fv) + (value(0, 1) * (1 - fu) + value(1, 1) * fu) * fv
