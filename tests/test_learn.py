import numpy as np
from marginalia.operators import learn
from pyspark.sql import functions as F


def frame(spark, x, **more):
    rows = [(i, r.tolist(), *(v[i] for v in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["item", "v", *more])


def test_small_solves_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = x @ rng.normal(size=(5, 2)) + rng.normal(0, 0.1, (80, 2))
    rows = frame(spark, x, y=y.tolist()).repartition(3)
    assert np.allclose(learn.ridge(rows, "v", "y", 0.5), np.linalg.solve(x.T @ x + 0.5 * np.eye(5), x.T @ y))
    wx, wy, s = learn.cca(rows, "v", "y", 2, 1e-9)
    a, b = (x - x.mean(0)) @ wx, (y - y.mean(0)) @ wy
    assert np.allclose([abs(np.corrcoef(a[:, i], b[:, i])[0, 1]) for i in range(2)], s, atol=1e-6) and s[0] > 0.99


def test_assignments(spark):
    x = np.concatenate([np.zeros((10, 3)), np.ones((10, 3))])
    rows = frame(spark, x, label=[0] * 10 + [1] * 10)
    m = learn.svm_bags(rows.withColumn("label", F.col("label").cast("int")), "v", "label", bags=1).collect()
    assert {r.attribute for r in m} == {0, 1}
    for r in m:
        assert (((x @ np.array(r.weights) + r.bias) > 0).astype(int) == (np.arange(20) // 10 == r.attribute)).all()
    nodes = learn.self_organising_map(rows, "v", 2, epochs=6)
    assert max(np.abs(nodes - c).sum(1).min() for c in (0, 1)) < 0.5
    book = spark.createDataFrame([(0, [5.0]), (1, [7.0])], "code int, center array<double>")
    got = learn.rescued(book, spark.createDataFrame([(0, [1.0]), (0, [3.0])], "code int, u array<double>"), "u").collect()
    assert {r.code: r.center for r in got} == {0: [2.0], 1: [7.0]}


def test_likeliest_path(spark):
    """Against all paths."""
    from itertools import product

    start, move, emit = np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([[0.5, 0.4, 0.1], [0.1, 0.3, 0.6]])
    seq = [0, 1, 2, 2, 0]
    rows = spark.createDataFrame([("a", i, o) for i, o in enumerate(seq)], "k string, i int, o int")
    r = learn.viterbi(rows, "k", "i", "o", start, move, emit).first()
    p = lambda z: start[z[0]] * emit[z[0], seq[0]] * np.prod([move[a, b] * emit[b, o] for a, b, o in zip(z, z[1:], seq[1:], strict=False)])
    best = max(product((0, 1), repeat=5), key=p)
    assert tuple(r.states) == best and np.isclose(r.log_p, np.log(p(best)))


def test_calibration(spark):
    rng = np.random.default_rng(1)
    s = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(3 * s - 1)))).astype(int)
    a, b = learn.platt(spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "s double, y int"), "s", "y")
    assert abs(a + 3) < 1 and abs(b - 1) < 0.6
