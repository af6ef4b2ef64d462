"""Fewest convex parts against all sets of diagonals."""

import itertools

import numpy as np
import pytest

from planewright.functions import decompose as D
from planewright.functions import kernels as K
from planewright.functions import polygon_kernels as N
from tests.test_shapes import CROSS, CUP, ELL, SQUARE, star


def crosses(a, b):
    (i, j), (k, m) = a, b
    return i < k < j < m or k < i < m < j


def parts_of(n, cuts):
    """The pieces into which diagonals that don't cross cut corners 0 .. n - 1."""
    pieces = [list(range(n))]
    for i, j in cuts:
        k = next(x for x in pieces if i in x and j in x)
        a, b = k.index(i), k.index(j)
        pieces.remove(k)
        pieces += [k[a : b + 1], k[b:] + k[: a + 1]]
    return pieces


def convex(p, piece):
    q = p[piece]
    a, b, c = np.roll(q, 1, 0), q, np.roll(q, -1, 0)
    return ((b - a)[:, 0] * (c - b)[:, 1] - (b - a)[:, 1] * (c - b)[:, 0] >= -1e-12).all()


@pytest.mark.parametrize("p", [SQUARE, ELL, CUP, *(star(n, seed=s) for n in (4, 5, 6, 7, 8, 9) for s in range(4))], ids=len)
def test_fewest(p):
    q, n = N.ccw(p), len(p)
    sees = D.diagonals(q)
    every = [(i, j) for i in range(n) for j in range(i + 2, n - (i == 0)) if sees[i, j]]
    for least in range(len(every) + 1):
        sets = (c for c in itertools.combinations(every, least) if not any(crosses(a, b) for a, b in itertools.combinations(c, 2)))
        if any(all(convex(q, x) for x in parts_of(n, c)) for c in sets):
            break
    for ring in (p, p[::-1]):
        got = D.fewest_convex_parts(ring)
        assert len(got) == least + 1
        assert sum(K.signed_area(ring[x]) for x in got) == pytest.approx(abs(K.signed_area(ring))) and all(convex(ring, x) for x in got)


def test_larger_rings():
    assert len(D.fewest_convex_parts(CROSS)) == 3 and D.fewest_convex_parts(SQUARE[:2]) == []
    for seed in range(6):
        p = star(24, seed=seed)
        got = D.fewest_convex_parts(p)
        assert len(got) <= len(K.convex_parts(p)) and sum(K.signed_area(p[x]) for x in got) == pytest.approx(K.signed_area(p))
