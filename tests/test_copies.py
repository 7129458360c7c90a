from marginalia.operators import keyword, tables
from marginalia.plans import subword
from pyspark.sql import functions as F


def test_words_written_alike_are_one_shape(spark, small):
    """A word's vectors, windows and alignments were worked out for each of its copies before."""
    every = subword.inked(spark, small)
    twice = every.unionByName(every.withColumn("item", F.col("item") + 10**6))
    assert subword.shapes(twice).count() == every.select("label", "strip").distinct().count()


def test_points_and_boxes_at_one_place_meet_once(spark):
    """Copies of points met copies of boxes one by one before; what is counted stays."""
    points = spark.createDataFrame([(0.5, 0.5, 1)] * 30 + [(1.0, 1.0, 2)] * 10 + [(None, 1.0, 2)], "px double, py double, f int")
    boxes = spark.createDataFrame([(b, 0.0, 0.0) for b in range(50)] + [(90, 5.0, 5.0), (91, None, 5.0)], "box long, x double, y double")
    every, firsts = tables.one_of_each(boxes)
    assert {(r.box, r.first) for r in every.collect()} == {(b, 0) for b in range(50)} | {(90, 90), (91, 91)} and firsts.count() == 3
    model = keyword.learnt(points, boxes.where("box < 50"), 2.0, 2.0)
    assert {(r.f, r.value) for r in model.collect()} == {(1, 30.0), (2, 10.0)}
    got = {r.box: r.score for r in keyword.climbed(points, boxes, model, 2.0, 2.0).collect()}
    assert len(got) == 52 and {got[b] for b in range(50)} == {25.0} and got[90] == 0.0
