import numpy as np
import pytest
from marginalia import plans
from marginalia.operators import blocks, frontends, learn, ranking
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sets(spark):
    """Vectors with many copies, so many equal scores, nulls, and a query without a relevant item."""
    rng = np.random.default_rng(4)
    kinds = rng.integers(-3, 4, (40, 6)) / 8
    rows = [(i, kinds[rng.integers(40)].tolist(), int(rng.integers(5))) for i in range(700)]
    rows += [(700, None, 1), (701, [0.0] * 6, None), (800, [1.0] * 6, 99)]
    items = spark.createDataFrame(rows, "item long, v array<float>, label int")
    return items.where("item % 100 = 0").select(F.col("item").alias("query"), F.col("v").alias("qv"), F.col("label").alias("qlabel")), items


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(sorted(map(tuple, a), key=repr), sorted(map(tuple, b), key=repr), strict=True):
        assert all(u == v or abs(u - v) < 1e-9 for u, v in zip(x, y, strict=True)), (x, y)


def test_searches_against_rankings(sets, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 3)
    asked, items = sets
    pairs = ranking.similarity(asked, items.where("v IS NOT NULL")).where("score IS NOT NULL")
    asked, items = asked.where("qv IS NOT NULL"), items.where("v IS NOT NULL")
    near(ranking.searched_ap(asked, items).drop("blend").collect(), ranking.mid_tie_ap(pairs).collect())
    runs = blocks.runs(asked, items)
    near(blocks.by_query(runs, blocks.in_order, "ap double").drop("blend").collect(), ranking.sorted_ap(pairs).collect())
    names = ["ap_at_k", "p_at_k", "recall_at_k"]
    near(blocks.by_query(runs, blocks.upto(9), ", ".join(f"{n} double" for n in names)).where("query <> 800").select("query", *names).collect(), ranking.at_k(pairs, 9).where("query <> 800").collect())
    near(ranking.searched_places(asked, items, 7).select("query", "item", "score", "place").collect(), ranking._placed(pairs, ("query",)).where("place <= 7").select("query", "item", "score", "place").collect())


def test_blocks_are_folded_one_by_one(sets, monkeypatch):
    """All blocks' runs were on disk at once, a byte or more for each pair and blend."""
    asked, items = (df.where(f"{c} IS NOT NULL") for df, c in zip(sets, ("qv", "v"), strict=True))
    asked = asked.withColumn("other", F.reverse("qv"))
    whole = ranking.searched_ap(asked, items, ("qv", "other"), ((0.5, 0.5), (1.0, 0.0))).collect()
    written = []
    keep = blocks.materialise
    monkeypatch.setattr(blocks, "materialise", lambda df, label: written.append((label, df.count())) or keep(df, label))
    monkeypatch.setattr(blocks, "SCORES", 2000)
    monkeypatch.setattr(blocks, "TOGETHER", 2)
    near(ranking.searched_ap(asked, items, ("qv", "other"), ((0.5, 0.5), (1.0, 0.0))).collect(), whole)
    assert len([n for label, n in written if label == "folded"]) > 3 and sum(n for label, n in written if label == "folded") == len(whole)


def test_two_score_sets(sets):
    """Every pair was a row."""
    asked, items = sets
    asked = asked.where("query <> 700").unionByName(asked.where("query = 0").selectExpr("query + 7 AS query", "qv", "CAST(NULL AS int) AS qlabel"))
    pairs = ranking.similarity(asked, items).groupBy("relevant").agg(F.avg("score"), F.stddev_pop("score"))
    got = blocks.score_sets(asked, items)
    near(got.collect(), pairs.collect())
    assert got.count() == 3 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_null_vectors_stand_last(sets):
    asked, items = sets
    got = {r["query"]: r["item"] for r in ranking.searched_places(asked, items, 1000).where("score IS NULL").select("query", "item").collect() if r["query"] != 700}
    assert set(got.values()) == {700} and len(got) == asked.count() - 1


def test_no_pair_is_a_row(spark, small):
    """What all pairs cost was a join, a row and a sort for each; a run is a row now."""
    for name in ("r01_qbe_ap", "r04_hybrid_sweep", "p30_top_five", "v04_distances", "e04_word_bags"):
        plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner, NOT" not in plan and "Join Inner, (query" not in plan and "MapInArrow" in plan, name


def test_score_sets_and_precision_in_blocks(spark, small):
    """Both were joins with a row for every pair."""
    for name in ("p27_two_score_sets", "u03_precision_function"):
        plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "MapInArrow" in plan, name


def test_precision_of_large_ids(spark, tmp_path):
    """An item's id was taken off its score, which put ids past a million before others of a higher score."""
    rows = [(0, [1.0, 0.0], 1), (3 * 10**6 + 1, [0.500002, 0.0], 1), (7, [0.500001, 0.0], 2), (8, [0.1, 0.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [(r.query, r.ap) for r in plans.QUERIES["u03_precision_function"](spark, str(tmp_path)).collect()] == [(0, round((1 + 2 / 3) / 2, 6))]


def test_neighbours_meet_once(spark):
    """A pair that shares all 24 buckets was 24 rows of a join before its copies were dropped."""
    rows = spark.createDataFrame([(i, [i / 1000, 0.5]) for i in range(300)], "item long, v array<double>")
    got = learn.lsh_neighbours(rows, rows.where("item % 100 = 0"), "item", "v", 2)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["query"], r["item"]) for r in got.collect()) == [(0, 1), (0, 2), (100, 99), (100, 101), (200, 199), (200, 201)]


def test_front_ends_hold_few_products(spark, monkeypatch):
    """All queries of a block were in one product before."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, str(i % 3), rng.normal(size=4).tolist()) for i in range(90)], "item long, label string, v array<double>")
    texts = spark.createDataFrame([], "label string, y array<double>")
    raw = frontends.FrontEnd("features", lambda v: v, None)
    got = {}
    for n in (frontends.TOGETHER, 7, 1000):
        monkeypatch.setattr(frontends, "TOGETHER", n)
        got[n] = sorted((r["query"], r["item"], r["score"]) for r in frontends.scores(rows, rows, texts, [raw], "item", "v", "label").collect())
    assert frontends.NAMES and len(got[7]) == 90 * 89
    for n in got:
        assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6 for a, b in zip(got[n], got[1000], strict=True))
