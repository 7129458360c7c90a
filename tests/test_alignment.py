"""Alignment against a memoised recursion, and its edges."""

from functools import cache

import numpy as np
import pytest
from marginalia.operators import alignment


def best(a, b, radius, outside, slanted):
    """Cost and path by recursion from the last cell."""
    n, m = len(a), len(b)

    @cache
    def at(i, j):
        d = round(sum((x - y) ** 2 for x, y in zip(a[i], b[j], strict=True)), 9) + (outside if abs(i * m - j * n) > radius * m else 0)
        if i == j == 0:
            return d, ((0, 0),)
        steps = [(at(i - 1, j - 1), 0.0)] if i and j else []
        steps += [(at(i - 1, j), slanted)] if i else []
        steps += [(at(i, j - 1), slanted)] if j else []
        (c, path), more = min(steps, key=lambda s: s[0][0] + s[1])
        return d + (c + more), (*path, (i, j))

    return at(n - 1, m - 1)


@pytest.mark.parametrize("radius, outside, slanted", [(100, 100.0, 0.0), (1, 2.0, 0.0), (0, 0.5, 0.3)])
def test_against_recursion(spark, radius, outside, slanted, monkeypatch):
    monkeypatch.setattr(alignment, "CELLS", 300)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 4, (rng.integers(1, 12), 3)).astype(float).tolist(), rng.integers(0, 4, (rng.integers(1, 12), 3)).astype(float).tolist()) for i in range(60)]
    rows += [(100, [], [[1.0]]), (101, None, [[1.0]]), (102, [[1.0]], [[1.0]] * 500)]
    got = alignment.align(spark.createDataFrame(rows, "id int, a array<array<double>>, b array<array<double>>"), radius=radius, outside=outside, slanted=slanted, path=True).collect()
    given = {i: (a, b) for i, a, b in rows}
    assert len(got) == len(rows)
    for r in got:
        a, b = given[r.id]
        if not a:
            assert r.cost is None and r.path is None
        elif r.id < 100:
            cost, path = best(tuple(map(tuple, a)), tuple(map(tuple, b)), radius, outside, slanted)
            assert abs(r.cost - cost) < 1e-9 and [tuple(p) for p in r.path] == list(path)


def test_no_pairs(spark):
    none = spark.createDataFrame([], "id int, a array<array<double>>, b array<array<double>>")
    assert alignment.align(none).columns == ["id", "cost"] and alignment.align(none).count() == 0


def test_triples_are_those_of_the_triple_loop(spark):
    rng = np.random.default_rng(4)
    c2, c3 = rng.integers(0, 5, (6, 4)), rng.integers(0, 5, (6, 7))
    rows = [("g", i, 2, j, float(c2[i, j])) for i in range(6) for j in range(4)] + [("g", i, 3, j, float(c3[i, j])) for i in range(6) for j in range(7)]
    r = alignment.best_triple(spark.createDataFrame(rows, "g string, w1 int, other int, w2 int, cost double"), ("g",)).first()
    assert (r.cost, r.w1, r.w2, r.w3) == min((float(c2[i, j] + c3[i, k]), i, j, k) for i in range(6) for j in range(4) for k in range(7))
