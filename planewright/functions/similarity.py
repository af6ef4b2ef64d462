"""Hausdorff distances of two lines, arrays of shape (n, 2): points against segments, a block of points at a time."""

from __future__ import annotations

import numpy as np

#: Pairs of points and segments that are looked at together.
BLOCK = 1 << 16


def line_distances(p: np.ndarray, line: np.ndarray) -> np.ndarray:
    """From each point to the nearest segment of a line of one point or more; NaN for none."""
    if not len(line):
        return np.full(len(p), np.nan)
    a = line[:-1] if len(line) > 1 else line
    d = np.diff(line, axis=0) if len(line) > 1 else np.zeros((1, 2))
    square = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
    out = np.empty(len(p))
    step = max(1, BLOCK // len(a))
    for k in range(0, len(p), step):
        x, y = p[k : k + step, 0, None], p[k : k + step, 1, None]
        dot = (x - a[:, 0]) * d[:, 0] + (y - a[:, 1]) * d[:, 1]
        t = np.clip(np.divide(dot, square, out=np.zeros_like(dot), where=square > 0), 0, 1)
        u, v = a[:, 0] + d[:, 0] * t - x, a[:, 1] + d[:, 1] * t - y
        out[k : k + step] = np.sqrt((u * u + v * v).min(1))
    return out


def directed_hausdorff_line(a: np.ndarray, b: np.ndarray) -> float:
    """The largest distance of a vertex of a from the line b; NaN if either is empty."""
    return float(line_distances(a, b).max()) if len(a) else float("nan")


def densified(line: np.ndarray, density: float) -> np.ndarray:
    """Points along the line, ends of segments included, at least ``density`` to a unit of length."""
    if len(line) < 2:
        return line
    d = np.diff(line, axis=0)
    n = np.maximum(1, np.ceil(np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) * density)).astype(np.int64)
    own = np.repeat(np.arange(len(d)), n + 1)
    j = np.arange(len(own)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    return line[own] + d[own] * (j / n[own])[:, None]


def directed_hausdorff_sampled(a: np.ndarray, b: np.ndarray, density: float) -> float:
    return directed_hausdorff_line(densified(a, density), b)
