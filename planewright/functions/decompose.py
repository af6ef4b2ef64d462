"""Convex decompositions of a simple ring with the fewest parts that diagonals can make."""

from __future__ import annotations

import numpy as np

from planewright.functions import kernels as K
from planewright.functions import polygon_kernels as N


def diagonals(p: np.ndarray) -> np.ndarray:
    """Which pairs of a counter-clockwise ring's corners see each other along its inside, its edges among them."""
    n = len(p)
    out = np.zeros((n, n), bool)
    for i in range(n):
        out[i, (i + 1) % n] = out[(i + 1) % n, i] = True
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            d = p[j] - p[i]
            side = d[0] * (p[:, 1] - p[i, 1]) - d[1] * (p[:, 0] - p[i, 0])
            along = (p - p[i]) @ d / (d @ d)
            through = (np.abs(side) <= 1e-12 * (d @ d)) & (along > 1e-12) & (along < 1 - 1e-12)
            out[i, j] = out[j, i] = not through.any() and N.sees(p, p[i], p[j])
    return out


def fewest_convex_parts(p: np.ndarray) -> list[list[int]]:
    """Corner indexes of each part, counter-clockwise; either orientation comes in.

    What a diagonal from i to j cuts off, corners i to j, needs one part along the diagonal, which
    is a convex chain from i to j, and for each step of the chain what that step cuts off. So the
    fewest parts of all pieces follow from those of shorter ones. Steps of one chain are tried in
    order, with the least cost of the chain up to each of them.
    """
    n = len(p)
    if n < 3:
        return []
    order = np.arange(n) if K.signed_area(p) >= 0 else np.arange(n)[::-1]
    q = p[order]
    sees = diagonals(q)
    turn = (q[None, :, 0] - q[:, None, 0])[:, :, None] * (q[None, None, :, 1] - q[:, None, None, 1]) - (q[None, :, 1] - q[:, None, 1])[:, :, None] * (q[None, None, :, 0] - q[:, None, None, 0])
    left = turn >= -1e-12 * max(1e-300, float(np.ptp(q, axis=0).max()) ** 2)
    cost = np.full((n, n), np.inf)
    chain: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        cost[i, i + 1] = 0
    for span in range(2, n):
        for i in range(n - span):
            j = i + span
            if not sees[i, j]:
                continue
            best: dict[tuple[int, int], float] = {}  # the last step of a chain -> what it costs so far
            came: dict[tuple[int, int], int] = {}
            for b in range(i + 1, j + 1):
                for a in range(i, b):
                    step = cost[a, b]
                    if not np.isfinite(step) or (a, b) == (i, j):
                        continue
                    if a == i:
                        if left[j, i, b]:
                            best[a, b] = step
                        continue
                    for c in range(i, a):
                        if (c, a) in best and left[c, a, b] and best[c, a] + step < best.get((a, b), np.inf):
                            best[a, b], came[a, b] = best[c, a] + step, c
            ends = [(best[a, j], a) for a in range(i + 1, j) if (a, j) in best and left[a, j, i]]
            if ends:
                cost[i, j], a = min(ends)
                cost[i, j] += 1
                path = [j, a]
                while path[-1] != i:
                    path.append(came.get((path[-1], path[-2]), i))
                chain[i, j] = path[::-1]
    if (0, n - 1) not in chain:
        return []
    parts, todo = [], [(0, n - 1)]
    while todo:
        path = chain[todo.pop()]
        parts.append([int(order[k]) for k in path])
        todo += [(a, b) for a, b in zip(path, path[1:], strict=False) if b - a > 1]
    return parts
