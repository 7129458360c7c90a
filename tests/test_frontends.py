"""Attribute models, subspaces and front-ends against numpy on small tables with real structure."""

import numpy as np
import pytest
from marginalia.operators import attributes, frontends, ranking, subspace
from marginalia.operators.strips import unit
from pyspark.sql import functions as F

RNG = np.random.default_rng(7)
N, D, A = 150, 6, 3
Y = RNG.integers(0, 2, (N, A))
Y[:, 2] = 0
Y[0, 2] = 1  # too few to learn from
X = RNG.normal(size=(N, D)) + 2.0 * np.pad(Y[:, :2], ((0, 0), (0, D - 2)))
LABEL = Y[:, 0] * 2 + Y[:, 1]


@pytest.fixture(scope="module")
def rows(spark):
    given = [(i, X[i].tolist(), [float(v) for v in Y[i]], int(LABEL[i])) for i in range(N)] + [(900, None, [0.0] * A, 0), (901, [0.0] * D, None, 0)]
    return spark.createDataFrame(given, "item long, v array<double>, y array<double>, label int").repartition(3)


def ap(scores, relevant, ids):
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    hits, out = 0, []
    for place, i in enumerate(order, 1):
        if relevant[i]:
            hits += 1
            out.append(hits / place)
    return np.mean(out) if out else 0.0


def mid_tie(scores, relevant):
    ranks = sorted((scores > s).sum() + ((scores == s).sum() - 1) // 2 for s, r in zip(scores, relevant, strict=True) if r)
    return np.mean([(j + 1) / (rank + 1) for j, rank in enumerate(ranks)])


def test_bags(spark, rows):
    lambdas = (1e-2, 1e-3)
    ready = attributes.prepared(rows, "item", "v", "y", 2)
    w = attributes.fit(ready, 2, lambdas, rounds=80)
    part = {r.id: [int(p) for p in r.part] for r in ready.collect()}
    assert set(part) == set(range(N)) and {p for ps in part.values() for p in ps} == set(range(5))
    x, y = np.concatenate([X, np.full((N, 1), attributes.BIAS)], axis=1), 2.0 * Y - 1
    for bag in (0, 7):
        mask = np.array([part[i][bag // 5] != bag % 5 for i in range(N)])
        for a in range(2):
            for k, lam in enumerate(lambdas):
                miss = np.maximum(0, 1 - y[mask, a] * (x[mask] @ w[:, a, bag, k]))
                slope = lam * w[:, a, bag, k] + (x[mask].T @ (-2 * miss * y[mask, a])) / mask.sum()
                assert np.abs(slope).max() < 2e-3  # the minimum of a convex loss
    assert not w[:, 2].any()
    mean, choice, out = attributes.bagged(rows, "item", "v", "y", lambdas=lambdas, rounds=80)
    picked = {(r.attribute, r.bag): (r.setting, r.ap) for r in choice.collect()}
    assert len(picked) == 10 * A
    for (a, bag), (setting, value) in picked.items():
        left = [i for i in range(N) if part[i][bag // 5] == bag % 5]
        each = [round(ap(np.round(x[left] @ w[:, a, bag, k], 9), Y[left, a], left), 9) for k in range(2)]
        assert (setting, value) == (int(np.argmax(each)), max(each))
    assert np.allclose(mean, np.stack([np.mean([w[:, a, b, picked[(a, b)][0]] for b in range(10)], axis=0) for a in range(A)], 1))
    got = {(r.id, r.attribute): r.score for r in out.collect()}
    assert len(got) == N * A
    for i in range(0, N, 11):
        for a in range(A):
            bags = [part[i][s] + 5 * s for s in range(2)]
            assert abs(got[(i, a)] - np.mean([x[i] @ w[:, a, b, picked[(a, b)][0]] for b in bags])) < 1e-6
    assert np.mean([got[(i, 0)] > 0 for i in range(N) if Y[i, 0]]) > 0.8


def test_correlated_directions():
    z = RNG.normal(size=(500, 3))
    a, b = z @ RNG.normal(size=(3, 4)), z[:, :2] @ RNG.normal(size=(2, 3)) + RNG.normal(size=(500, 3))
    c = np.cov(np.concatenate([a, b], axis=1).T, bias=True)
    wx, wy, s = subspace.correlated(c[:4, :4], c[:4, 4:], c[4:, 4:], 1e-6, 2)
    p, q = a @ wx, b @ wy
    assert np.allclose([np.corrcoef(p[:, i], q[:, i])[0, 1] for i in range(2)], s, atol=1e-3) and s[0] >= s[1]
    assert np.allclose(np.cov(p.T, bias=True), np.eye(2), atol=1e-3)


def test_settings_share_their_sums(rows):
    grid = {"widths": (1.0, 2.0), "ms": (3, 5), "regs": (0.1,), "ks": (1, 2)}
    spaces = subspace.learn(rows, "v", "y", **grid)
    assert len(spaces) == 8
    for s, space in spaces.items():
        images, texts = subspace.Fourier.draw(5, D, s.width, 0), subspace.Fourier.draw(5, A, s.width, 1)
        a, b = images.of(X, s.m), texts.of(Y.astype(float), s.m)
        c = np.cov(np.concatenate([a, b], axis=1).T, bias=True)
        n = 2 * s.m
        wx, wy, _ = subspace.correlated(c[:n, :n], c[:n, n:], c[n:, n:], s.reg, 2)
        assert np.allclose(space.image(X), unit((a - a.mean(0)) @ wx[:, : s.k]), atol=1e-6) and np.allclose(space.text(Y.astype(float)), unit((b - b.mean(0)) @ wy[:, : s.k]), atol=1e-6)


def test_chosen_setting(rows):
    train, valid = rows.where("item % 2 = 0"), rows.where("item % 2 = 1")
    grid = {"widths": (1.0,), "ms": (4, 8), "regs": (0.1, 1e-3), "ks": (2,)}
    best, table = subspace.chosen(train, valid, "item", "v", "y", "label", queries=9, **grid)
    got = {(r.m, r.reg): r for r in table.collect()}
    own = np.array([i for i in range(N) if i % 2])
    asked = [int(r.item) for r in valid.where("v IS NOT NULL").orderBy(F.xxhash64(F.col("item").cast("string")), "item").limit(9).collect()]
    label = {**{i: LABEL[i] for i in range(N)}, 901: 0}
    seen = np.array([*own, 901])
    vectors = {**{i: X[i] for i in range(N)}, 901: np.zeros(D)}
    for (m, reg), r in got.items():
        space = subspace.learn(train, "v", "y", (1.0,), (4, 8), (reg,), (2,))[subspace.Setting(1.0, m, reg, 2)]
        every = space.image(np.array([vectors[i] for i in seen]))
        values = []
        for q in asked:
            at = seen != q
            s = np.round(every[at] @ space.image(vectors[q][None])[0], 6)
            rel = [label[i] == label[q] for i in seen[at]]
            if any(rel):
                values.append(mid_tie(s, rel))
        assert abs(r.by_example - np.mean(values)) < 1e-6
    assert abs(max(r.value for r in got.values()) - (lambda r: r.by_example + r.by_text)(max(got.values(), key=lambda r: r.value))) < 1e-8
    assert best.image(X[:1]).shape == (1, 2)


def test_calibration_is_where_the_gradient_vanishes(spark):
    s = RNG.normal(size=(200, 2))
    y = (RNG.random((200, 2)) < 1 / (1 + np.exp(-(s * [2, -1] + [0.5, 0])))).astype(float)
    ab = frontends.calibrations(spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(s, y, strict=True)], "s array<double>, y array<double>"), 2)
    p = 1 / (1 + np.exp(-(ab[:, 0] * s + ab[:, 1])))
    assert np.abs(((p - y) * s).sum(0)).max() < 1e-3 and np.abs((p - y).sum(0)).max() < 1e-3


def test_front_ends(spark, rows):
    grid = {"widths": (1.0,), "ms": (8,), "regs": (0.1,), "ks": (2,)}
    models = frontends.learnt(rows.where("item % 3 < 2"), rows.where("item % 3 = 1"), "item", "v", "y", "label", rounds=60, **grid)
    assert [m.name for m in models] == list(frontends.NAMES)
    test = rows.where("item % 3 = 2")
    queries = rows.where("item % 10 = 0 AND y IS NOT NULL")
    texts = spark.createDataFrame([(int(c), [float(c // 2), float(c % 2), 0.0]) for c in range(4)], "label int, y array<double>")
    got = {(r.front_end, r.kind): r for r in frontends.evaluated(test, queries, texts, models, "item", "v", "label").collect()}
    assert len(got) == 11
    own = np.array([i for i in range(N) if i % 3 == 2])
    for m in models:
        every = m.image(X[own])
        for kind, asked in ((0, [(i, LABEL[i], m.image(X[i : i + 1])[0]) for i in range(0, N, 10)]), (1, [(-1, c, m.text(np.array([[c // 2, c % 2, 0.0]]))[0]) for c in range(4)] if m.text else [])):
            values = []
            for i, c, v in asked:
                at = own != i
                values.append(mid_tie(np.round(every[at] @ v, 6), LABEL[own[at]] == c))
            if asked:
                r = got[(m.name, kind)]
                assert r.n_queries == len(asked) and abs(r.map - np.mean(values)) < 2e-6
    assert got[("linear", 1)].map > got[("direct", 1)].map > 0.4 and got[("linear", 1)].map > 0.6


def test_scores_are_no_rows(spark, rows, monkeypatch):
    """Every score of every front-end was a row, written and then sorted; the figures are those of these rows."""
    models = [frontends.FrontEnd("features", lambda v: v, None), frontends.FrontEnd("direct", lambda v: v[:, :3] * 2, lambda t: t)]
    queries = rows.where("item % 10 = 0")
    texts = spark.createDataFrame([(int(c), [float(c // 2), float(c % 2), 0.0]) for c in range(4)], "label int, y array<double>")
    by = ("front_end", "kind", "query")
    pairs = frontends.scores(rows, queries, texts, models, "item", "v", "label")
    wanted = ranking.mid_tie_ap(pairs, by).join(ranking.precision_at_1(pairs, by).select(*by, "p_at_1"), list(by)).groupBy("front_end", "kind").agg(F.count("*"), F.avg("ap"), F.avg("p_at_1")).collect()
    monkeypatch.setattr(frontends, "scores", None)
    got = {(r[0], r[1]): r[2:] for r in frontends.evaluated(rows, queries, texts, models, "item", "v", "label").collect()}
    assert len(wanted) == len(got) == 3
    for r in wanted:
        assert all(abs(a - b) < 2e-6 for a, b in zip(got[(r[0], r[1])], r[2:], strict=True)), (r, got)
