"""Skeletons of simple rings: the straight one by a shrinking wavefront, the medial axis from boundary samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from planewright.functions import kernels as K
from planewright.functions import polygon_kernels as N
from planewright.functions.delaunay_kernel import delaunay


@dataclass
class Skeleton:
    """Nodes (x, y, height) and arcs between them; of a straight skeleton the arcs' edges of the ring, left and right of their way up."""

    nodes: np.ndarray
    arcs: np.ndarray
    edges: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), int))

    def length(self) -> float:
        d = self.nodes[self.arcs[:, 1], :2] - self.nodes[self.arcs[:, 0], :2] if len(self.arcs) else np.zeros((0, 2))
        return float(np.hypot(*d.T).sum())

    def segments(self) -> list[np.ndarray]:
        return [self.nodes[list(a), :2] for a in self.arcs]

    def pruned(self, least: float) -> Skeleton:
        """Without arcs that end loosely and are shorter than ``least``, again and again until there is none; nodes left alone go."""
        arcs, edges = self.arcs, self.edges if len(self.edges) == len(self.arcs) else np.zeros((len(self.arcs), 2), int)
        while len(arcs):
            degree = np.bincount(arcs.ravel(), minlength=len(self.nodes))
            d = np.hypot(*(self.nodes[arcs[:, 1], :2] - self.nodes[arcs[:, 0], :2]).T)
            loose = (degree[arcs] == 1).any(1) & (d < least)
            if not loose.any():
                break
            arcs, edges = arcs[~loose], edges[~loose]
        used = np.unique(arcs)
        number = np.zeros(len(self.nodes), int)
        number[used] = np.arange(len(used))
        return Skeleton(self.nodes[used], number[arcs].reshape(-1, 2), edges)


@dataclass(eq=False)
class _Corner:
    """A corner of the wavefront: where and when it began, and the edges before and after it."""

    node: int
    p: np.ndarray
    t: float
    before: int
    after: int
    v: np.ndarray = None


def straight_skeleton(p: np.ndarray) -> Skeleton:
    """The way of a simple ring's corners while its edges move in at one speed; the first nodes are the corners.

    An event is an edge that has shrunk to a point, or an inward corner that runs into an edge and
    parts the ring. Events are taken in order of time; each is found by a look at all corners of
    its ring, so a ring of n corners takes about n looks. Repeated points count once; either
    orientation; corners on a straight side move with it.
    """
    p = p[K.drop_repeats(p, 0.0)] if len(p) else p
    if len(p) > 1 and (p[0] == p[-1]).all():
        p = p[:-1]
    if len(p) < 3 or K.signed_area(p) == 0:
        return Skeleton(np.zeros((0, 3)), np.zeros((0, 2), int))
    p = N.ccw(p)
    n = len(p)
    size = float(np.ptp(p, axis=0).max())
    near, soon = 1e-9 * size, 1e-10 * size
    d = np.roll(p, -1, 0) - p
    along = d / np.hypot(*d.T)[:, None]
    normal = np.stack([-along[:, 1], along[:, 0]], 1)  # to the inside
    shift = (normal * p).sum(1)
    nodes: list[tuple[float, float, float]] = [(x, y, 0.0) for x, y in p]
    arcs: list[tuple[int, int]] = []
    sides: list[tuple[int, int]] = []

    def corner(node: int, at: np.ndarray, t: float, before: int, after: int) -> _Corner:
        a, b = normal[before], normal[after]
        k = a[0] * b[1] - a[1] * b[0]
        if abs(k) > 1e-9:  # both edges' distances grow with the time
            v = np.array([b[1] - a[1], a[0] - b[0]]) / k
        elif a @ b > 0:
            v = (a + b) / 2
        else:  # edges that move towards each other have met here
            v = np.zeros(2)
        return _Corner(node, at, t, before, after, v)

    def place(at: np.ndarray, t: float) -> int:
        nodes.append((float(at[0]), float(at[1]), t))
        return len(nodes) - 1

    def link(c: _Corner, node: int) -> None:
        if c.node != node:
            arcs.append((c.node, node))
            sides.append((c.before, c.after))

    def closed(ring: list[_Corner], t: float) -> bool:
        """Whether a ring has shrunk to nothing; its last corners are then joined."""
        if len(ring) > 2:
            return False
        if len(ring) == 2:
            a, b = ring
            pa, pb = a.p + a.v * (t - a.t), b.p + b.v * (t - b.t)
            if np.hypot(*(pa - pb)) <= 4 * near:
                end = a.node if a.t == t else b.node if b.t == t else place(pa, t)
            else:
                # the ridge between two edges that met along a line
                end = b.node if b.t == t else place(pb, t)
                start = a.node if a.t == t else place(pa, t)
                link(a, start)
                a = _Corner(start, pa, t, a.before, a.after)
            link(a, end)
            link(b, end)
        return True

    def flat(ring: list[_Corner], t: float) -> bool:
        """Whether a ring of three or more corners has no width left; the line that it has become is then drawn, piece by piece."""
        at = np.array([c.p + c.v * (t - c.t) for c in ring])
        d = along[ring[0].after]
        across = at @ np.array([-d[1], d[0]])
        if np.ptp(across) > near:
            return False
        u = at @ d
        order = np.argsort(u, kind="stable")
        ends: list[tuple[float, int]] = []
        for k in order.tolist():
            c = ring[k]
            if ends and u[k] - ends[-1][0] <= near:
                link(c, ends[-1][1])
            else:
                node = c.node if c.t == t else place(at[k], t)
                link(c, node)
                ends.append((float(u[k]), node))
        for (x, a), (y, b) in zip(ends, ends[1:], strict=False):
            over = {}
            for k, c in enumerate(ring):
                v, w = u[k], u[(k + 1) % len(ring)]
                if min(v, w) < (x + y) / 2 < max(v, w):
                    over[w > v] = c.after
            arcs.append((a, b))
            sides.append((over.get(False, ring[0].after), over.get(True, ring[0].after)))
        return True

    todo = [(0.0, [corner(i, p[i], 0.0, i - 1 if i else n - 1, i) for i in range(n)])]
    budget = 20 * n + 100
    while todo and budget:
        budget -= 1
        now, ring = todo.pop()
        if closed(ring, now) or flat(ring, now):
            continue
        m = len(ring)
        P, V = np.array([c.p for c in ring]), np.array([c.v for c in ring])
        T, E = np.array([c.t for c in ring]), np.array([c.after for c in ring])
        base = P - V * T[:, None]  # where each would have been at time 0
        nb, nv = np.roll(base, -1, 0), np.roll(V, -1, 0)
        # the length of each edge along its own direction is a linear function of time
        l0, l1 = ((nb - base) * along[E]).sum(1), ((nv - V) * along[E]).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gone = np.where(l1 < -1e-14, -l0 / l1, np.inf)
        gone = np.where((l0 + l1 * now <= near) & (l1 < 1e-14), now, gone)
        gone = np.where(gone < now - soon, np.where(l1 < 0, now, np.inf), gone)
        k = int(np.argmin(gone))
        best, split = float(gone[k]), None
        # corners that turn to the inside
        B, A = np.array([c.before for c in ring]), E
        reflex = np.flatnonzero(along[B][:, 0] * along[A][:, 1] - along[B][:, 1] * along[A][:, 0] < -1e-12)
        for i in reflex.tolist():
            rate = (V[i] * normal[E]).sum(1) - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                hit = (shift[E] - (base[i] * normal[E]).sum(1)) / rate
            ok = (rate < -1e-12) & (hit >= now - soon) & (hit < best - soon) & (E != ring[i].before) & (E != ring[i].after)
            for j in np.flatnonzero(ok)[np.argsort(hit[ok], kind="stable")].tolist():
                t = max(float(hit[j]), now)
                if t >= best - soon:
                    break
                x = base[i] + V[i] * t
                from_start = float((x - base[j] - V[j] * t) @ along[E[j]])
                to_end = float((nb[j] + nv[j] * t - x) @ along[E[j]])
                if from_start >= -near and to_end >= -near:
                    best, split = t, (i, j)
                    break
        if not np.isfinite(best):
            break
        t = max(best, now)
        if split is None:
            a, b = ring[k], ring[(k + 1) % m]
            at = (base[k] + V[k] * t + nb[k] + nv[k] * t) / 2
            node = a.node if a.t == t and np.hypot(*(a.p - at)) <= near else b.node if b.t == t and np.hypot(*(b.p - at)) <= near else place(at, t)
            link(a, node)
            link(b, node)
            rest = [c for c in ring if c is not a and c is not b]
            new = corner(node, np.array(nodes[node][:2]), t, a.before, b.after)
            pos = k if k + 1 < m else len(rest)
            rest.insert(min(pos, len(rest)), new)
            todo.append((t, rest))
        else:
            i, j = split
            c = ring[i]
            at = base[i] + V[i] * t
            node = c.node if c.t == t and np.hypot(*(c.p - at)) <= near else place(at, t)
            link(c, node)
            turn = ring[i + 1 :] + ring[:i]  # the others, from the next one on
            f = ring[j]
            cut = turn.index(f)
            one = [corner(node, at, t, f.after, c.after), *turn[: cut + 1]]
            two = [corner(node, at, t, c.before, f.after), *turn[cut + 1 :]]
            todo += [(t, one), (t, two)]
    return Skeleton(np.array(nodes, float).reshape(-1, 3), np.array(arcs, int).reshape(-1, 2), np.array(sides, int).reshape(-1, 2))


def face_areas(p: np.ndarray, s: Skeleton) -> np.ndarray:
    """Area of the part of the ring that each of its edges sweeps; ``p`` counter-clockwise, without repeated points."""
    x = s.nodes[:, :2]
    cross = lambda a, b: x[a, 0] * x[b, 1] - x[a, 1] * x[b, 0]
    n = len(p)
    out = cross(np.arange(n), (np.arange(n) + 1) % n)
    c = cross(s.arcs[:, 0], s.arcs[:, 1])
    np.add.at(out, s.edges[:, 0], c)
    np.subtract.at(out, s.edges[:, 1], c)
    return out / 2


def sampled(p: np.ndarray, step: float) -> np.ndarray:
    """Points along a ring, at most ``step`` apart, its corners among them."""
    out = []
    for a, b in zip(p, np.roll(p, -1, 0), strict=True):
        k = max(1, int(np.ceil(np.hypot(*(b - a)) / step)))
        out.append(a + (b - a) * (np.arange(k) / k)[:, None])
    return np.concatenate(out) if out else np.zeros((0, 2))


def medial_axis(p: np.ndarray, step: float, least: float = 0.0) -> Skeleton:
    """Centres of the largest circles inside a ring, from boundary samples ``step`` apart; the height is the radius.

    Nodes are the centres of the samples' Delaunay circles that lie inside, arcs join those of
    triangles that share an edge which is no piece of the boundary. ``least`` prunes loose arcs.
    """
    p = p[K.drop_repeats(p, 0.0)] if len(p) else p
    if len(p) < 3:
        return Skeleton(np.zeros((0, 3)), np.zeros((0, 2), int))
    q = sampled(p, step)
    t = np.array(delaunay(q), int).reshape(-1, 3)
    if not len(t):
        return Skeleton(np.zeros((0, 3)), np.zeros((0, 2), int))
    u, v = q[t[:, 1]] - q[t[:, 0]], q[t[:, 2]] - q[t[:, 0]]
    k = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.stack([(v[:, 1] * uu - u[:, 1] * vv) / k, (u[:, 0] * vv - v[:, 0] * uu) / k], 1)
    centre, radius = q[t[:, 0]] + w, np.hypot(*w.T)
    inside = np.isfinite(radius)
    inside[inside] = N.contains(p, centre[inside])
    owner, arcs, m = {}, [], len(q)
    for i in np.flatnonzero(inside).tolist():
        for a, b in ((t[i, 0], t[i, 1]), (t[i, 1], t[i, 2]), (t[i, 2], t[i, 0])):
            if (a + 1) % m == b or (b + 1) % m == a:
                continue
            if (j := owner.pop((b, a), None)) is not None:
                arcs.append((j, i))
            else:
                owner[a, b] = i
    number = np.cumsum(inside) - 1
    nodes = np.column_stack([centre, radius])[inside]
    # circles round more than three samples have equal centres
    same = np.unique(np.round(nodes[:, :2] / (1e-9 * max(float(np.ptp(p, axis=0).max()), 1e-300))), axis=0, return_index=True, return_inverse=True)
    back = same[2].ravel()
    arcs = np.array([(back[number[i]], back[number[j]]) for i, j in arcs], int).reshape(-1, 2)
    arcs = np.unique(np.sort(arcs[arcs[:, 0] != arcs[:, 1]], axis=1), axis=0) if len(arcs) else arcs
    out = Skeleton(nodes[same[1]], arcs)
    return out.pruned(least) if least > 0 else out
