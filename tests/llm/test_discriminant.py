"""The quadratic discriminant against plain numpy, held-out labels, and awkward tables."""

import zlib

import numpy as np
import pytest
from marginalia.llm import discriminant, queries


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_query_against_numpy(spark, small, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    ids = sorted(texts)
    x = discriminant.feature_matrix([(texts[i] or "").encode() for i in ids])
    learnt = np.array([i in labels and fold(i) != 0 for i in ids])
    y = np.array([labels.get(i, -1) for i in ids])
    expected = by_hand_scores(x[learnt], y[learnt], x)
    got = {r.doc_id: r for r in queries.op12_quality_classifier(spark, small).collect()}
    assert set(got) == set(ids)
    for i, s in zip(ids, expected, strict=True):
        assert got[i].held_out == (fold(i) == 0) and abs(got[i].score - s) < 1e-6 and got[i].predicted == int(got[i].score >= 0.3)


def by_hand_scores(xs, ys, x):
    """From inverses and determinants, without Cholesky factors."""
    n = np.array([(ys == c).sum() for c in (0, 1)])
    cov = [np.cov(xs[ys == c].T, bias=True) for c in (0, 1)]
    pooled = sum(k * c for k, c in zip(n, cov, strict=True)) / n.sum()
    out = []
    for c in (0, 1):
        s = 0.98 * (0.5 * cov[c] + 0.5 * pooled) + 0.02 * np.diag(np.maximum(np.diag(pooled), 1e-3))
        d = x - xs[ys == c].mean(0)
        out.append(np.log(n[c] / n.sum()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d))
    return 1 / (1 + np.exp(np.clip(out[0] - out[1], -700, 700)))


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op12_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(good) > 500 and len(bad) > 50
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area >= 0.99
    assert np.mean([s >= 0.3 for s in good]) >= 0.99 and np.mean([s >= 0.3 for s in bad]) <= 0.05


def test_labels_of_the_held_fold_and_other_columns_do_not_matter(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    score = lambda d, l: {r.doc_id: round(r.score, 9) for r in discriminant.classify(d, l).collect()}
    plain = score(docs, labels)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 5 = 0, 1 - quality, quality) AS quality")
    assert score(docs.selectExpr("doc_id", "text", "'x' AS lang", "doc_id AS y", "1 AS words", "2.0 AS score", "3 AS id"), turned.union(turned)) == plain


def test_few_labels_and_awkward_tables(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in discriminant.classify(awkward, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert {r.score for r in discriminant.classify(awkward, one).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 0), (6, 0), (7, 0), (6, 1)], "doc_id long, quality int")
    rows = discriminant.classify(awkward, both, folds=1000, held_fold=999).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert discriminant.classify(nothing, both).count() == 0


@pytest.mark.parametrize("d", [np.zeros(13), np.ones(13)])
def test_constant_features_can_be_factored(d):
    model = discriminant.fit(np.array([1.0, 1.0]), np.stack([d, d + 1]), np.zeros((2, 13, 13)))
    assert model.score(np.stack([d, d + 1])).round().tolist() == [0, 1]
