"""Sequential algorithms applied per row: Arrow batches of point arrays in, arrays or structs out.

A batch's points are two flat arrays of numbers from end to end; a kernel sees a row's part of them,
and what it returns goes back into flat arrays. No point becomes an object of its own, so that a
worker holds little more than a batch's numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from planewright.functions import kernels as K

POINTS = "array<struct<x: double, y: double>>"
#: Rows of a batch whose numbers and results are objects of Python at a time.
ROWS = 256


def as_array(line) -> np.ndarray:
    """An (n, 2) array of a row's points; null is empty, null coordinates are left out."""
    if line is None:
        return np.zeros((0, 2))
    rows = [(p["x"], p["y"]) for p in line if p is not None and p["x"] is not None and p["y"] is not None]
    return np.array(rows, float).reshape(-1, 2)


def _points(p: np.ndarray) -> list[dict[str, float]]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


def arrays_of(lines: pa.Array) -> Iterator[np.ndarray]:
    """The same for each row of a batch."""
    sizes = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x, y = lines.flatten().flatten()[:2]
    bounds = np.append(0, np.cumsum(sizes))
    p = np.stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)], 1) if len(x) else np.zeros((0, 2))
    if x.null_count or y.null_count:
        whole = np.array(x.is_valid()) & np.array(y.is_valid())
        p, bounds = p[whole], np.append(0, np.cumsum(whole))[bounds]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield p[a:b]


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _lines(rows: Iterator[np.ndarray]) -> pa.Array:
    """Arrays of points as array<struct<x, y>>."""
    rows = [np.asarray(p, float).reshape(-1, 2) for p in rows]
    p = np.concatenate([np.zeros((0, 2)), *rows])
    fields = [pa.array(np.ascontiguousarray(p[:, k])) for k in (0, 1)]
    return _lists(pa.StructArray.from_arrays(fields, ["x", "y"]), [len(p) for p in rows])


def _rings(rows: Iterator[list[np.ndarray]]) -> pa.Array:
    rows = list(rows)
    return _lists(_lines(r for row in rows for r in row), [len(row) for row in rows])


def _structs(rows: list[tuple[float, ...] | None], names: list[str]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([None if r is None or r[k] != r[k] else float(r[k]) for r in rows], pa.float64()) for k in range(len(names))], names)


def by_rows(run: Callable[[pa.Array], pa.Array], rows: pa.Array) -> pa.Array:
    """``run`` on ROWS rows of a batch at a time: what it needs beside the batch doesn't grow with that."""
    return pa.concat_arrays([run(rows.slice(k, ROWS)) for k in range(0, max(1, len(rows)), ROWS)])


def indexes(line: Column | str, kernel: str, **options: object) -> Column:
    """Kept indexes of a line under one of the kernels, as array<int>."""

    def run(lines: pa.Array) -> pa.Array:
        kept = [np.array(getattr(K, kernel)(p, **options), np.int32) for p in arrays_of(lines)]
        return _lists(pa.array(np.concatenate([np.zeros(0, np.int32), *kept])), [len(k) for k in kept])

    return F.arrow_udf(lambda lines: by_rows(run, lines), "array<int>")(line)


def rings(line: Column | str, kernel: str, *more: Column | str, **options: object) -> Column:
    """A ring made from one or more rings."""
    return made("points", lambda *p: getattr(K, kernel)(*p, **options), line, *more)


def numbers(line: Column | str, kernel: str, names: list[str], **options: object) -> Column:
    """A struct of doubles, null where the kernel has no result."""
    return measured(line, lambda p: getattr(K, kernel)(p, **options), names)


def measured(line: Column | str, kernel: Callable[[np.ndarray], tuple[float, ...] | None], names: list[str]) -> Column:
    """A struct of several numbers that a function finds at once."""

    def run(lines: pa.Array) -> pa.Array:
        return _structs([kernel(p) for p in arrays_of(lines)], names)

    return F.arrow_udf(lambda lines: by_rows(run, lines), ", ".join(f"{n} double" for n in names))(line)


def triples(line: Column | str, kernel: str) -> Column:
    """Index triples of triangles."""

    def run(lines: pa.Array) -> pa.Array:
        found = [getattr(K, kernel)(p) for p in arrays_of(lines)]
        flat = np.array([t for row in found for t in row], np.int32).reshape(-1, 3)
        fields = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]
        return _lists(pa.StructArray.from_arrays(fields, ["a", "b", "c"]), [len(row) for row in found])

    return F.arrow_udf(lambda lines: by_rows(run, lines), "array<struct<a: int, b: int, c: int>>")(line)


def pair_number(a: Column | str, b: Column | str, kernel: str, **options: object) -> Column:
    """A number from two lines."""
    return made("double", lambda p, q: getattr(K, kernel)(p, q, **options), a, b)


def picked(line: str, kept: str) -> Column:
    """The points of a line at kept indexes."""
    return F.expr(f"transform({kept}, i -> {line}[i])")


KINDS = {"points": POINTS, "rings": f"array<{POINTS}>", "double": "double", "int": "int", "boolean": "boolean"}


def _values(kind: str, rows: Iterator[object]) -> pa.Array:
    """Kernels' results as a column of their kind; a number that is none is null."""
    if kind in ("points", "rings"):
        return (_lines if kind == "points" else _rings)(rows)
    if kind == "double":
        return pa.array([None if x != x else x for x in map(float, rows)], pa.float64())
    return pa.array([int(x) if kind == "int" else bool(x) for x in rows], pa.int32() if kind == "int" else pa.bool_())


def made(kind: str, kernel, *columns: Column | str) -> Column:
    """A kernel's result for each row: ``kind`` is points, rings, double, int or boolean; the kernel takes an array of points for each column."""

    def run(rows: pa.Array) -> pa.Array:
        return _values(kind, (kernel(*row) for row in zip(*map(arrays_of, rows.flatten()), strict=True)))

    packed = F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"c{k}") for k, c in enumerate(columns)))
    return F.arrow_udf(lambda rows: by_rows(run, rows), KINDS[kind])(packed)
