"""The model queries against numpy on the smallest tables."""

import numpy as np
import pytest
from marginalia import plans
from marginalia.operators import learn


@pytest.fixture(scope="module")
def vectors(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float), np.array([r.label for r in rows])


def test_projections_are_those_of_the_largest_variances(spark, small, vectors):
    ids, x, _ = vectors
    got = {r["item"]: np.array(list(r["projected"])) for r in plans.QUERIES["m02_pca"](spark, small).collect()}
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    expected = x @ vt[:8].T
    p = np.stack([got[i] for i in ids])
    signs = np.sign((p * expected).sum(0))
    assert np.allclose(p * signs, expected, atol=1e-4)


def test_every_vector_is_with_its_nearest_centre(spark, small, vectors):
    from marginalia.plans.retrieval import items

    _, x, _ = vectors
    rows = items(spark, small)
    model = learn.kmeans(rows, "v", 10)
    centres = np.array(model.clusterCenters())
    for r in model.transform(learn.with_vector(rows, "v")).select("v", "prediction").collect():
        d = ((centres - np.array(r["v"], dtype=float)) ** 2).sum(1)
        assert d[r["prediction"]] <= d.min() + 1e-6
    counts = plans.QUERIES["m01_kmeans"](spark, small).collect()
    assert sum(r["n"] for r in counts) == len(x)


def test_mixture_memberships(spark, small, vectors):
    rows = plans.QUERIES["m03_gaussian_mixture"](spark, small).collect()
    assert len(rows) == len(vectors[0]) and all(0.25 - 1e-9 <= r["sure"] <= 1 + 1e-9 and 0 <= r["prediction"] < 4 for r in rows)


def test_random_features_approach_the_kernel(spark, small, vectors):
    """The dot product of two feature vectors is about exp(-gamma * squared distance)."""
    ids, x, _ = vectors
    got = {r["item"]: np.array(r["fourier"]) for r in plans.QUERIES["m08_random_features"](spark, small).collect()}
    f = np.stack([got[i] for i in ids[:40]])
    d = ((x[:40, None] - x[None, :40]) ** 2).sum(2)
    assert np.allclose((f * f).sum(1), 1) and np.abs(f @ f.T - np.exp(-d)).mean() < 0.2


def test_neighbours_recall(spark, small, vectors):
    ids, x, _ = vectors
    got = {}
    for r in plans.QUERIES["m11_lsh_neighbours"](spark, small).collect():
        got.setdefault(r["query"], set()).add(r["item"])
    found = total = 0
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q]) ** 2).sum(1)
        best = [int(i) for i in ids[np.argsort(d, kind="stable")] if i != q][:5]
        found, total = found + len(got.get(int(q), set()) & set(best)), total + 5
    assert found >= 0.9 * total
