"""Vector codes against Lloyd's method in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from planewright.llm import vector_codes
from tests.llm.test_operators import bag


def by_force(rows, parts=16, entries=64, rounds=2):
    """Rows (id, code, error, label_error) and codebooks for rows (id, label, vector) of one length."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, _, v in kept]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, _, v), a in zip(kept, found, strict=True) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    error = [sum(d for d, _ in a) for a in found]
    total = {}
    for (_, label, _), x in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + x
    return [(i, "".join(f"{e:02x}" for _, e in a), x, total[label]) for (i, label, _), a, x in zip(kept, found, error, strict=True)], books


def result(spark, rows, **options):
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    coded, books = vector_codes.compress(vectors, **options)
    return [(r["id"], r["codes"].hex(), r["error"], r["label_error"]) for r in vector_codes.with_label_errors(coded).collect()], books


def check(spark, rows, **options):
    got, books = result(spark, rows, **options)
    want, force = by_force(rows, **options)
    assert bag(got) == bag(want) and books.tolist() == force
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(x) for b in force for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("rounds", [0, 1, 2, 6])
def test_rounds(spark, rounds):
    r = random.Random(rounds)
    rows = [(k, r.choice([1, 2, None]), [r.gauss(k % 7, 0.2) for _ in range(12)]) for k in range(300)]
    check(spark, rows, parts=4, entries=16, rounds=rounds)


def test_edge_cases(spark):
    r = random.Random(1)
    vector = lambda: [r.choice([-2.0, -0.5, 0.0, 0.001, 3.0]) for _ in range(32)]
    same = vector()
    rows = [(k, r.choice([1, None]), vector()) for k in range(90)] + [(k, 7, same) for k in range(90, 200)]
    rows += [(5, 1, rows[5][2]), (None, 2, vector()), (300, 2, None), (301, 2, [None, *same[1:]]), (302, 2, [math.nan, *same[1:]]), (-1, 2, [math.inf, *same[1:]]), (-2, 3, [-math.inf, *same[1:]])]
    check(spark, rows)
    check(spark, rows[:20])  # fewer vectors than entries
    check(spark, rows[:1])


def test_empty_short_and_huge(spark):
    assert result(spark, [])[0] == [] and result(spark, [(1, 1, None)])[0] == []
    got, books = result(spark, [(1, 1, [1.0, 2.0]), (2, 1, [1.0]), (3, 1, []), (4, 1, [1e300, -1e300, 0.5])], parts=2)
    assert sorted(x[0] for x in got) == [1, 2, 3, 4] and books.shape == (2, 4, 2) and books.max() == 1 << 28
    assert result(spark, [(1, None, [])])[0] == [(1, "00" * 16, 0, 0)]


def test_columns_that_clash(spark):
    rows = [(1, 2, [0.5] * 16, "x", "y"), (2, None, [1.0] * 16, None, "z")]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, id string, codes string")
    assert [r["id"] for r in vector_codes.compress(vectors)[0].orderBy("id").collect()] == [1, 2]


def test_heaps_pop_what_a_new_search_would_change():
    """Whatever the heaps leave alone keeps its nearest entry."""
    r = np.random.default_rng(3)
    parts, books = r.integers(-300, 300, (2000, 3)), r.integers(-300, 300, (1, 40, 3))
    drift, sums = np.zeros((1, 40)), np.zeros((1, 40, 4), np.int64)
    codes, keys = vector_codes.rounded(parts, None, None, books, drift, sums)
    spared = 0
    for step in (1, 2, 5, 40):
        new = books + r.integers(-step, step + 1, books.shape)
        drift, books = vector_codes.moved(drift, books, new), new
        popped = vector_codes.Heaps(codes[:, 0], keys[:, 0], 40).pop(vector_codes.reached(drift[0]))
        spared += len(parts) - len(popped)
        codes, keys = vector_codes.rounded(parts, codes, keys, books, drift, sums)
        assert codes[:, 0].tolist() == vector_codes.distances(parts, books[0]).argmin(1).tolist()
        assert sums[0, :, 3].tolist() == np.bincount(codes[:, 0], minlength=40).tolist()
    assert spared > 2000
