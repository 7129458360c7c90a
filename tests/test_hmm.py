"""Training of hidden Markov models against a sum over all paths, likelihoods that never fall, heat maps of stretches."""

from itertools import product

import numpy as np
import pytest
from marginalia.operators import hmm
from marginalia.plans import hmm as plans
from pyspark.sql import functions as F

RNG = np.random.default_rng(2)


def density(x, mean, c):
    d = x - mean
    return np.exp(-0.5 * d @ np.linalg.inv(c) @ d) / np.sqrt((2 * np.pi) ** len(x) * np.linalg.det(c))


def model(s=2, m=2, d=2):
    square = RNG.normal(size=(s, m, d, d))
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(norm(RNG.random(s)), norm(RNG.random((s, s))), norm(RNG.random((s, m))), RNG.normal(size=(s, m, d)), square @ square.swapaxes(-1, -2) + 0.5 * np.eye(d))


def by_paths(m, xs):
    """Expected counts by adding up every path of states and components."""
    s, k = m.shares.shape
    d = m.means.shape[2]
    likelihood, first, moves, w, sums, squares = 0.0, np.zeros(s), np.zeros((s, s)), np.zeros((s, k)), np.zeros((s, k, d)), np.zeros((s, k, d, d))
    for x in xs:
        paths = {}
        for path in product(product(range(s), range(k)), repeat=len(x)):
            p = m.start[path[0][0]]
            for t, (i, j) in enumerate(path):
                p *= (m.move[path[t - 1][0], i] if t else 1) * m.shares[i, j] * density(x[t], m.means[i, j], m.covariances[i, j])
            paths[path] = p
        total = sum(paths.values())
        likelihood += np.log(total)
        for path, p in paths.items():
            p /= total
            first[path[0][0]] += p
            for t, (i, j) in enumerate(path):
                if t:
                    moves[path[t - 1][0], i] += p
                w[i, j] += p
                sums[i, j] += p * x[t]
                squares[i, j] += p * np.outer(x[t], x[t])
    return np.concatenate([[likelihood], first, moves.ravel(), w.ravel(), sums.ravel(), squares.ravel()])


def test_expected_counts_are_those_of_all_paths():
    m, xs = model(), [RNG.normal(size=(n, 2)) for n in (1, 4, 3, 4)]
    assert np.allclose(hmm.Expected(m, xs).flat(), by_paths(m, xs))
    best = max(m.start[p[0]] * np.prod([m.move[a, b] for a, b in zip(p, p[1:], strict=False)]) * np.prod([sum(m.shares[i, k] * density(x, m.means[i, k], m.covariances[i, k]) for k in range(2)) for i, x in zip(p, xs[1], strict=True)]) for p in product(range(2), repeat=4))
    assert abs(m.best_path(xs[1]) - np.log(best)) < 1e-9


def test_one_round_against_all_paths(spark, monkeypatch):
    monkeypatch.setattr(hmm, "CELLS", 20)
    m, xs = model(), [RNG.normal(size=(n, 2)) for n in (2, 4, 3, 4, 1, 3)]
    rows = spark.createDataFrame([(x.tolist(),) for x in xs] + [([],), (None,)], "seq array<array<double>>").repartition(3)
    got, likelihoods = hmm.baum_welch(rows, m, rounds=1, floor=0.0)
    sums = by_paths(m, xs)
    assert abs(likelihoods[0] - sums[0]) < 1e-8 and likelihoods[1] >= likelihoods[0]
    assert np.allclose(got.start, sums[1:3] / sums[1:3].sum())
    moves, w = sums[3:7].reshape(2, 2), sums[7:11].reshape(2, 2)
    assert np.allclose(got.move, moves / moves.sum(1, keepdims=True)) and np.allclose(got.shares, w / w.sum(1, keepdims=True))
    mean = sums[11:19].reshape(2, 2, 2) / w[..., None]
    assert np.allclose(got.means, mean)
    assert np.allclose(got.covariances, sums[19:].reshape(2, 2, 2, 2) / w[..., None, None] - mean[..., :, None] * mean[..., None, :])


def test_trained_on_events(spark, small):
    fitted, likelihoods, cut = plans.trained(spark, small)
    assert len(likelihoods) >= 3 and all(b >= a - 1e-3 * abs(a) for a, b in zip(likelihoods, likelihoods[1:], strict=False)) and likelihoods[-1] > likelihoods[0]
    assert np.allclose(fitted.move.sum(1), 1) and np.allclose(fitted.shares.sum(1), 1)
    events = spark.read.parquet(f"{small}/events.parquet")
    assert cut.select(F.sum(F.size("seq"))).first()[0] == events.count()
    given = {(r.user_id, r.stretch): np.array(r.seq) for r in cut.collect()}
    for r in plans.h02_baum_welch(spark, small).limit(20).collect():
        assert abs(r.log_p - fitted.best_path(given[(r.user_id, r.stretch)])) < 1e-6


@pytest.mark.parametrize("length, stride", [(4, 4), (5, 2), (2, 5)])
def test_segments(spark, length, stride):
    rows = [(u, i, float(i)) for u, n in (("a", 11), ("b", 3), (None, 5)) for i in range(n)]
    cut = lambda whole: {(r.u, r.stretch): [x[0] for x in r.seq] for r in hmm.segments(spark.createDataFrame(rows, "u string, i int, v double").repartition(4), "u", "i", F.array("v"), length, stride, whole=whole).collect()}
    expected = {}
    for u, n in (("a", 11), ("b", 3), (None, 5)):
        for at in range(0, (n - 1) // stride + 1):
            expected[(u, at)] = [float(i) for i in range(at * stride, min(n, at * stride + length))]
    assert cut(False) == expected and cut(True) == {k: v for k, v in expected.items() if len(v) == length}
