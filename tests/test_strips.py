"""Windows over strips against sums taken anew, and rankings by ranges against rankings by windows."""

import numpy as np
import pytest
from marginalia.operators import ranking, strips, subword, tables
from pyspark.sql import functions as F

RNG = np.random.default_rng(5)
BOOK = strips.Codebook(RNG.normal(size=(7, 4)))
QUERIES = RNG.normal(size=(2, 4))


def score(strip, x0, x1, q):
    v = sum((BOOK.vectors[strip[x // strips.CELL]] for x in range(x0, x1)), np.zeros(4))
    n = np.linalg.norm(v)
    return round(-float(v @ q) / n, 6) + 0.0 if n else 0.0


@pytest.fixture(scope="module")
def words(spark):
    rows = [(i, f"w{i}", RNG.integers(0, 7, i % 9).tolist()) for i in range(40)] + [(99, "none", None)]
    return spark.createDataFrame(rows, "item long, label string, strip array<int>")


def test_every_window(spark, words, monkeypatch):
    monkeypatch.setattr(strips, "CHUNK", 25)
    given = {r.item: r.strip or [] for r in words.collect()}
    expected = {(q, i, w, r): score(s, 8 * r, 8 * r + w, QUERIES[q]) for i, s in given.items() for w in (16, 24) for r in range(max(0, (10 * len(s) - w) // 8 + 1)) for q in range(2)}
    got = {(int(r.query), r.item, r.w, r.r): r.score for r in strips.spot(words, BOOK, ["0", "1"], QUERIES, (16, 24), 8).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 2e-6 for k, v in expected.items())


def test_best_two_are_those_of_all_windows(words):
    every = strips.spot(words, BOOK, ["0", "1"], QUERIES, (24,), 8)
    two = strips.spot(words, BOOK, ["0", "1"], QUERIES, (24,), 8, 2)
    rows = lambda d: sorted((r.query, r.item, r.r, r.score) for r in d.collect())
    assert rows(two) == rows(subword.best_two(every, 2))
    assert strips.spot(words.where("false"), BOOK, ["0", "1"], QUERIES, (24,), 8, 2).count() == 0


def test_refined_hits_never_get_worse(words):
    hits = strips.spot(words, BOOK, ["0", "1"], QUERIES, (24,), 8, 2).join(words.select("item", "strip"), "item")
    given = {(r.query, r.item, r.x0, r.x1): (r.strip, r.score) for r in hits.collect()}
    out = strips.refine(hits, BOOK, ["0", "1"], QUERIES, 4).collect()
    assert len(out) == len(given)
    for r in out:
        near = [(s, own, x0, x1) for (q, i, x0, x1), (s, own) in given.items() if (q, i) == (r.query, r.item) and abs(r.x0 - x0) <= 4 and abs(r.x1 - x1) <= 4]
        assert any(r.score <= own and (r.score == own or abs(score(s, r.x0, r.x1, QUERIES[int(r.query)]) - r.score) < 2e-6) for s, own, *_ in near)


def test_projected_codebook_projects_windows(words):
    weights = RNG.normal(size=(4, 3))
    v = {r.item: r.v for r in strips.whole(words, BOOK.project(weights)).collect()}
    for r in words.collect():
        plain = sum((BOOK.vectors[c] for c in r.strip or []), np.zeros(4)) @ weights
        assert np.allclose(v[r.item], strips.unit(plain[None])[0])


def test_rankings_by_ranges(spark):
    """One query holds nearly all rows, scores tie, ids are null."""
    rows = [("q" if i % 50 else None, i, float(RNG.integers(0, 60)), bool(RNG.random() < 0.2)) for i in range(3000)] + [("r", 1, 1.0, False)]
    ranked = spark.createDataFrame(rows, "query string, item long, score double, relevant boolean").repartition(7)
    for higher in (True, False):
        of = lambda f: {r.query: (r.n_relevant, round(r.ap, 9)) for r in f(ranked, higher_is_better=higher).collect()}  # noqa: B023, E731
        assert of(ranking.mid_tie_ap_by_ranges) == of(ranking.mid_tie_ap)
    sums = {}
    for q, i, s, _ in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        sums[(q, i)] = sums.get(q, 0.0), s
        sums[q] = sums.get(q, 0.0) + s
    for r in tables.running_before(ranked, ("query",), ("score", "item"), ("score",)).collect():
        assert r.score_before == sums[(r.query, r.item)][0]
    results = ranked.where("query IS NOT NULL").withColumns({"r": F.lit(0).cast("long"), "label": F.lit("x")})
    kept = subword.best_share(results, 0.25).collect()
    assert sorted((r.score, r.item) for r in kept) == sorted((s, i) for q, i, s, _ in rows if q == "q")[: sum(q == "q" for q, *_ in rows) // 4]
