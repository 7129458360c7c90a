import pytest
from marginalia.functions import text as t
from marginalia.functions import vectors as v
from marginalia.operators import ranking, spans, stats, text_ops
from pyspark.sql import functions as F


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(x).alias(k) if not isinstance(x, list) else F.array(*map(F.lit, x)).alias(k) for k, x in values.items()]).select(column.alias("x")).first().x


def test_position_histogram_of_known_words(spark):
    """Values worked out by hand for aaaa: 1 everywhere but the middle third, which holds two thirds of a letter's width."""
    words = spark.createDataFrame([("aaaa",), ("abab",), ("",)], "word string")
    got = {(r.word, r.level, r.region, r.symbol): r.value for r in text_ops.phoc(words).collect()}
    assert [got["aaaa", 2, r, "a"] for r in (0, 1)] == [1, 1]
    assert [got["aaaa", 3, r, "a"] for r in (0, 1, 2)] == [1, pytest.approx(0.6667, abs=1e-4), 1]
    assert [got["aaaa", 4, r, "a"] for r in range(4)] == [1] * 4
    assert got["abab", 4, 1, "b"] == 1 and ("abab", 4, 1, "a") not in got


def test_text_functions(spark):
    assert one(spark, t.clean_words(F.col("s")), s="It-was [so]  &c. (No)") == ["it", "was", "so", "&c", "(", "no", ")"]
    assert one(spark, t.positions(F.col("s"), F.lit("aa")), s="aaaa") == [1, 2, 3]
    assert one(spark, t.positions(F.col("s"), F.lit("aa"), overlapping=False), s="aaaa") == [1, 3]
    assert one(spark, t.ngrams(F.col("s"), 3), s="ab") == []
    assert one(spark, t.normalised_levenshtein(F.col("s"), F.lit("")), s="") is None
    assert one(spark, t.normalised_levenshtein(F.col("s"), F.lit("")), s="abc") == 1
    assert one(spark, t.length_code(F.col("s"), 4), s="ab") == [1, 2, 0, 0]
    hits = F.array(F.struct(F.lit(2).alias("at"), F.lit("he").alias("gram")))
    assert one(spark, t.partial_pattern(hits, F.char_length("s")), s="ther") == "^[a-z]{1,1}he[a-z]{1,1}$"


def test_vector_functions(spark):
    assert one(spark, v.l2_normalised(F.col("a")), a=[4.0, 3.0]) == [0.8, 0.6]
    assert one(spark, v.l2_normalised(F.col("a")), a=[0.0, 0.0]) == [0, 0]
    assert one(spark, v.angle_distance(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) is None
    assert one(spark, v.blended(F.col("a"), F.col("b"), 0.25), a=[4.0, 0.0], b=[0.0, 4.0]) == [1, 3]
    assert one(spark, v.interval_iou(F.lit(0), F.lit(10), F.lit(10), F.lit(20)), a=1) == 0
    assert one(spark, v.interval_iou(F.lit(0), F.lit(4), F.lit(6), F.lit(10)), a=1) == pytest.approx(-0.2)
    assert one(spark, v.fourier_features(F.col("a"), [[1.0, 0.0]]), a=[0.0, 5.0]) == [1, 0]
    assert one(spark, v.l1(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 0.0]) == 4


def test_ranking_edges(spark):
    rows = [("tie", 1, 0.5, True), ("tie", 2, 0.5, True), ("all", 1, 0.5, True), ("all", 2, 0.5, False), ("all", 3, 0.5, False), ("one", 1, 0.1, True), ("none", 1, 0.1, False)]
    r = spark.createDataFrame(rows, "query string, item int, score double, relevant boolean")
    assert {x.query: x.ap for x in ranking.mid_tie_ap(r).collect()} == {"tie": 1.5, "all": 0.5, "one": 1.0}
    assert {x.query: x.ap for x in ranking.sorted_ap(r).collect()} == {"tie": 1, "all": 1, "one": 1}
    assert {x.query: x.p_at_k for x in ranking.at_k(r, 10).collect()}["none"] == 0
    assert {x.query: x.p_at_1 for x in ranking.precision_at_1(r).collect()} == {"tie": 1, "all": 1, "one": 1, "none": 0}


def test_span_edges(spark):
    w = spans.sliding_windows(spark.createDataFrame([(1, 3), (2, 20)], "id int, n int"), F.col("n"), 8, 5).collect()
    assert [(r.id, r.x0, r.x1) for r in w] == [(1, 0, 2), (2, 0, 7), (2, 5, 12), (2, 10, 17)]
    one_value = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert [tuple(r) for r in stats.histogram(one_value, "v", 5).collect()] == [(0, 2)]
    assert stats.otsu(stats.histogram(one_value, "v", 5)).first().threshold is None
    near = spans.best_and_second(spark.createDataFrame([(1, 0, 9.0), (1, 1, 8.0)], "id int, at int, score double"), ("id",), "at", 2.0)
    assert near.count() == 1
    assert spans.folds(spark.createDataFrame([(i, i % 2) for i in range(20)], "k int, y int"), "y", "k", 5, 1).groupBy("fold").count().where("count = 4").count() == 5
