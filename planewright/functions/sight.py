"""What an eye sees inside a ring with obstacles: a sweep round the eye over the edges that a ray meets, nearest first."""

from __future__ import annotations

import math

import numpy as np

from planewright.functions import kernels as K
from planewright.functions import overlay as O
from planewright.functions import polygon_kernels as N


def visible(rings: list[np.ndarray], eye: tuple[float, float], apart: bool | None = None) -> np.ndarray:
    """The part that a point sees of the space between ``rings`` (an outer one and any obstacles, in any orientation), as a ring round the point.

    Edges are cut where rings cross, which takes a look at all pairs of edges; ``apart`` says that
    none do (the default for a single ring), and a sweep of n log n steps is all. Between two neighbouring directions of corners the edges that a
    ray meets, and their order, don't change; an edge enters the order at its first direction, by
    comparing distances midway to the next one, and leaves it at its last. Where nothing bounds the
    view there is no corner. An eye inside an obstacle sees the obstacle from inside; one outside all
    rings sees what faces it.
    """
    rings = [r for r in rings if len(r) > 2]
    if not rings:
        return np.zeros((0, 2))
    a = np.concatenate(rings)
    b = np.concatenate([np.roll(r, -1, 0) for r in rings])
    grid = float(max(np.ptp(a, axis=0).max(), 1e-300)) * N.SNAP
    if len(rings) == 1 if apart is None else apart:
        e = np.stack([a, b], 1) - np.array(eye)
    else:
        pieces = list(dict.fromkeys((min(x, y), max(x, y)) for x, y in zip(*(map(tuple, p.tolist()) for p in O._cut(a, b, grid)[:2]), strict=True)))
        e = np.array([[*x, *y] for x, y in pieces], float).reshape(-1, 2, 2) * grid - np.array(eye)
    cross = e[:, 0, 0] * e[:, 1, 1] - e[:, 0, 1] * e[:, 1, 0]
    e = e[np.abs(cross) > grid * grid]  # edges towards the eye hide nothing that their ends don't
    cross = e[:, 0, 0] * e[:, 1, 1] - e[:, 0, 1] * e[:, 1, 0]
    e[cross < 0] = e[cross < 0][:, ::-1]  # each runs counter-clockwise round the eye
    if not len(e):
        return np.zeros((0, 2))
    angle = np.arctan2(e[:, :, 1], e[:, :, 0])
    # corners in nearly one direction are one direction: rays between them would be no wider than rounding
    every = np.unique(angle)
    every = every[np.append(True, np.diff(every) > 1e-13)]
    number = np.searchsorted(every, angle + 1e-13, "right") - 1
    m = len(every)
    begins: list[list[int]] = [[] for _ in range(m)]
    ends: list[list[int]] = [[] for _ in range(m)]
    order: list[int] = []
    for k, (i, j) in enumerate(number.tolist()):
        if i != j:
            begins[i].append(k)
            ends[j].append(k)
    n = (e[:, 1] - e[:, 0])[:, ::-1] * np.array([1, -1])  # n . x is the same all along an edge
    c = (n * e[:, 0]).sum(1)
    towards = lambda t: (math.cos(t), math.sin(t))

    def distance(k: int, d: tuple[float, float]) -> float:
        return c[k] / (n[k, 0] * d[0] + n[k, 1] * d[1])

    def insert(k: int, d: tuple[float, float]) -> None:
        own, low, high = distance(k, d), 0, len(order)
        while low < high:
            mid = (low + high) // 2
            if distance(order[mid], d) < own:
                low = mid + 1
            else:
                high = mid
        order.insert(low, k)

    middle = [towards((every[i] + (every[i + 1] if i + 1 < m else every[0] + 2 * math.pi)) / 2) for i in range(m)]
    # edges that the ray before the first direction meets
    for k, (i, j) in enumerate(number.tolist()):
        if i > j:
            insert(k, middle[m - 1])
    out: list[np.ndarray] = []
    for i in range(m):
        for k in ends[i]:
            order.remove(k)
        for k in begins[i]:
            insert(k, middle[i])
        if order:
            k = order[0]
            for t in (every[i], every[(i + 1) % m]):
                d = towards(t)
                out.append(np.array(d) * distance(k, d) + np.array(eye))
    if not out:
        return np.zeros((0, 2))
    ring = np.array(out)
    far = np.hypot(*(ring - np.roll(ring, 1, 0)).T) > grid
    ring = ring[far] if far.any() else ring[:1]
    # corners on a straight side
    before, after = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    bent = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]) > grid * (np.abs(before).sum(1) + np.abs(after).sum(1))
    return ring[bent]


def visible_area(rings: list[np.ndarray], eye: tuple[float, float]) -> float:
    return abs(K.signed_area(visible(rings, eye)))
