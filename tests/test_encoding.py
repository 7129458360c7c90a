"""Mixtures, Fisher vectors and pyramids against plain loops."""

import numpy as np
import pytest
from marginalia.operators import encoding
from marginalia.plans import encoding as plans

RNG = np.random.default_rng(11)


def density(x, m, s):
    return np.prod(np.exp(-((x - m) ** 2) / (2 * s)) / np.sqrt(2 * np.pi * s))


def test_mixtures_against_plain_rounds(spark):
    x = [RNG.normal(size=(60, 2)) + [4.0 * i, 0.0] for i in range(2)]
    rows = spark.createDataFrame([(b, v.tolist()) for b in range(2) for v in x[b]] + [(None, [1.0, 2.0]), (0, None)], "bin int, v array<double>").repartition(3)
    parts, likelihoods = encoding.fit_mixtures(rows, 2, 3, rounds=6, tolerance=0.0)
    starts, _ = encoding.fit_mixtures(rows, 2, 3, rounds=0)
    assert (np.diff(np.array(likelihoods), axis=0) >= -1e-9).all() and len(likelihoods) == 6
    for b in range(2):
        w, m, s = starts[b].priors, starts[b].means, starts[b].variances
        assert np.allclose(s, x[b].var(0)) and all(any((v == c).all() for v in x[b]) for c in m)
        for _ in range(6):
            q = np.array([[w[k] * density(v, m[k], s[k]) for k in range(3)] for v in x[b]])
            q /= q.sum(1, keepdims=True)
            n = q.sum(0)
            m = (q.T @ x[b]) / n[:, None]
            s = np.array([(q[:, k, None] * (x[b] - m[k]) ** 2).sum(0) / n[k] for k in range(3)])
            w = n / n.sum()
        assert np.allclose(parts[b].priors, w) and np.allclose(parts[b].means, m) and np.allclose(parts[b].variances, s, atol=1e-7)
    whole = encoding.Mixture.joined(parts)
    assert abs(whole.priors.sum() - 1) < 1e-12 and len(whole.means) == 6


def test_too_few_features(spark):
    with pytest.raises(ValueError, match="fewer than 2"):
        encoding.fit_mixtures(spark.createDataFrame([(0, [1.0]), (0, [1.0])], "bin int, v array<double>"), 1, 2)


def test_fisher_against_sums(spark):
    m = encoding.Mixture(np.array([0.25, 0.75]), RNG.normal(size=(2, 3)), RNG.random((2, 3)) + 0.2)
    images = [(0, RNG.normal(size=(7, 3)).tolist()), (1, []), (2, None), (3, RNG.normal(size=(1, 3)).tolist())]
    got = {r.item: r.fisher for r in encoding.fisher_vectors(spark.createDataFrame(images, "item int, features array<array<double>>"), m).collect()}
    for i, x in images:
        u, v = np.zeros((2, 3)), np.zeros((2, 3))
        for row in x or []:
            q = np.array([m.priors[k] * density(np.array(row), m.means[k], m.variances[k]) for k in range(2)])
            q /= q.sum()
            for k in range(2):
                z = (np.array(row) - m.means[k]) / np.sqrt(m.variances[k])
                u[k] += q[k] * z / (len(x) * np.sqrt(m.priors[k]))
                v[k] += q[k] * (z * z - 1) / (len(x) * np.sqrt(2 * m.priors[k]))
        raw = np.concatenate([u.ravel(), v.ravel()])
        raw = np.sign(raw) * np.sqrt(np.abs(raw))
        assert np.allclose(got[i], raw / (np.linalg.norm(raw) or 1))


def test_fisher_retrieval_beats_chance(spark, small):
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    rows = plans.e02_fisher_retrieval(spark, small).collect()
    assert {r.query for r in rows} == {i for i in labels if i % 100 == 0} and all(r.n_relevant == sum(v == labels[r.query] for v in labels.values()) - 1 and 0 < r.ap <= 1.01 for r in rows)


def test_pyramids_against_counting(spark):
    grids = [(i, RNG.integers(-1, 4, (RNG.integers(1, 9), RNG.integers(1, 7))).tolist()) for i in range(12)] + [(90, []), (91, None)]
    windows = np.array([(0, 0, 30, 20), (-9, -3, 22, 17), (11, 7, 5, 5), (100, 0, 9, 9), (-50, 0, 9, 9), (4, 4, 0, 8)])
    levels = ((1, 1), (2, 1), (4, 3))
    rows = spark.createDataFrame(grids, "item int, grid array<array<int>>")
    got = {(r.item, r.window): r.pooled for r in encoding.pyramids(rows, 3, levels, 4, lambda w, h: windows, normalised=False).collect()}
    assert len(got) == 12 * len(windows) and encoding.compensations(levels) == [1, 2, 12]
    for i, g in grids[:12]:
        for n, (x, y, w, h) in enumerate(windows):
            out = []
            for (a, d), weight in zip(levels, (1, 2, 12), strict=True):
                for p in range(a):
                    for q in range(d):
                        x0, x1 = max(0, int(int(x + p * (w / a)) / 4)), int(int(x + (p + 1) * (w / a)) / 4)
                        y0, y1 = max(0, int(int(y + q * (h / d)) / 4)), int(int(y + (q + 1) * (h / d)) / 4)
                        seen = [g[u][v] for u in range(x0, min(x1, len(g))) for v in range(y0, min(y1, len(g[0])))]
                        out += [weight * seen.count(c) for c in range(3)]
            assert got[(i, n)] == out, (i, n)
    unit = encoding.pyramids(rows, 3, levels, 4, lambda w, h: windows).collect()
    assert all(min(abs(np.linalg.norm(r.pooled) - 1), np.linalg.norm(r.pooled)) < 1e-9 for r in unit)


def test_scanned_widths():
    assert encoding.scan_widths(10, 4)(14, 9).tolist() == [[c - s // 2, 0, s, 9] for c in (2, 6, 10) for s in (12, 10, 8)]
    assert encoding.scan_widths(40, 4)(6, 9).tolist() == [[3 - s // 2, 0, s, 9] for s in (48, 40, 32)]
