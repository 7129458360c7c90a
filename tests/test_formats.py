import numpy as np
import pytest
from marginalia.operators import image, tables
from marginalia.sources import annotations as a
from pyspark.sql import functions as F


def put(path, text):
    path.write_text(text)
    return str(path)


def test_boxes_in_three_modes(spark, tmp_path):
    p = put(tmp_path / "b.gtp", "2700270.tif 251 146 499 249 letters\n\nd/x.png -3 4 5 6 don't\ny.png 1 2 3 4 two words\n")
    got = [tuple(r) for r in a.read_boxes(spark, p).collect()]
    assert got == [("2700270.tif", 251, 146, 499, 249, "letters"), ("d/x.png", -3, 4, 5, 6, "don"), ("y.png", 1, 2, 3, 4, "two")]
    assert [r.label for r in a.read_boxes(spark, p, "dropmalformed").collect()] == ["letters", "two words"]
    with pytest.raises(Exception, match="malformed annotation"):
        a.read_boxes(spark, p, "failfast").collect()
    out = str(tmp_path / "out")
    a.write_boxes(a.read_boxes(spark, p).unionByName(spark.createDataFrame([("z.png", 1, 1, 2, 2, "(x")], "page string, x1 int, y1 int, x2 int, y2 int, label string")), out)
    assert sorted(tuple(r) for r in a.read_boxes(spark, out).collect()) == sorted(got)
    grown = a.expand_boxes(a.read_boxes(spark, p).limit(1), 300, F.lit(500), F.lit(1000)).first()
    assert (grown.x1, grown.y1, grown.x2, grown.y2) == (0, 0, 499, 548)
    low = a.bounded_heights(spark.createDataFrame([(0, 10, 9, 13), (0, 0, 9, 99)], "x1 int, y1 int, x2 int, y2 int"), 8, 50).collect()
    assert [(r.y1, r.y2, r.scale) for r in low] == [(8, 15, 1.0), (0, 99, 0.5)]
    assert a.centred_heights(spark.createDataFrame([(0, 10), (0, 20)], "y1 int, y2 int")).select(F.col("y2") - F.col("y1")).distinct().count() == 1


def test_postings_bounds_and_segments(spark, tmp_path):
    p = put(tmp_path / "p.csv", "an\nwordimg_12,wordimg_99\nth\nwordimg_7\n")
    assert {r.ngram: r.ids for r in a.read_postings(spark, p).collect()} == {"an": [12, 99], "th": [7]}
    posts = a.read_postings(spark, p).select("ngram", F.explode("ids").alias("id"))
    a.write_postings(posts, str(tmp_path / "q"), "id", 1)
    text = "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "q")).collect())
    assert {r.ngram: r.ids for r in a.read_postings(spark, put(tmp_path / "r.csv", text)).collect()} == {"an": [12], "th": [7]}
    b = put(tmp_path / "c.csv", "ab,x.png,1,2,30,40,0,3,4,9\nq,x.png,5,5,6,6\n")
    rows = a.read_bounds(spark, b).collect()
    assert [[tuple(c) for c in r.chars] for r in rows] == [[(0, 3), (4, 9)], []] and rows[0].x2 == 30
    a.write_bounds(a.read_bounds(spark, b), str(tmp_path / "d"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "d")).collect()) == ["ab,x.png,1,2,30,40,0,3,4,9", "q,x.png,5,5,6,6"]
    c = put(tmp_path / "e.csv", "ab,x.png,1,2,30,40,0,3,.5,4,9,.25\n")
    assert [tuple(x) for x in a.read_bounds(spark, c, confidence=True).first().chars] == [(0, 3, 0.5), (4, 9, 0.25)]
    j = put(tmp_path / "s.json", '{"ori_image": "x.png", "org_bbox": [10, 2, 30, 40], "scale_factor": 2.0, "gt": "ab", "alignment": [[[0, 6], [8, 18]]]}\n')
    s = a.read_segments(spark, j)
    assert [tuple(x) for x in s.first().chars] == [(10, 13), (14, 19)]
    words = spark.createDataFrame([("x.png", 10, 2, 30, 40, "AB")] * 2, "page string, x1 int, y1 int, x2 int, y2 int, label string")
    assert a.align_segments(s, words).count() == 1
    numbered = words.limit(1).withColumn("o", F.lit(1))
    assert a.align_bounds(a.read_bounds(spark, b).limit(1).withColumn("o", F.lit(1)), numbered, "o").count() == 1


def test_page_xml(spark, tmp_path):
    p = put(tmp_path / "p.xml", '<P xmlns="urn:x"><Page imageFilename="a.png"><TextLine><Word><Coords><Point x="9" y="2"/><Point x="4" y="8"/></Coords><TextEquiv><Unicode>It-is (so)</Unicode></TextEquiv></Word><Word><Coords><Point x="1" y="2"/><Point x="3" y="8"/></Coords><TextEquiv><Unicode>No</Unicode></TextEquiv></Word></TextLine></Page></P>')
    rows = a.page_words(a.read_page_xml(spark, p)).orderBy("place").collect()
    assert [(r.label, r.x1, r.y1, r.x2, r.y2, r.place) for r in rows] == [("No", 1, 2, 3, 8, 1), ("It-is (so)", 4, 2, 9, 8, 2)]
    assert rows[1].tokens == ["it", "is", "(", "so", ")"]


def test_lists_and_matrices(spark, tmp_path):
    assert [tuple(r) for r in a.read_lines(spark, put(tmp_path / "n.txt", "TH\nHE\n"), ranked=True).collect()] == [(1, "th"), (2, "he")]
    assert [r.word for r in a.read_lines(spark, put(tmp_path / "w.txt", "one\n\n two\n")).collect()] == ["one", "two"]
    assert [tuple(r) for r in a.read_frequencies(spark, put(tmp_path / "f.csv", "1,ann,x,x,x,50\n2,bob,x,x,x,7\n3,cy\n"), 10).collect()] == [("ann", 50)]
    r = a.read_registrations(spark, put(tmp_path / "g.csv", "state,file,dx,dy,rot,w,h,conf\nUT,a.png,1,-2,0.5,10,20,3\n")).first()
    assert (r.state, r.dy, r.rot) == ("UT", -2, 0.5)
    m = put(tmp_path / "m.txt", "[ 2 3 ] 1 2 3 4.5 -6 7e-3")
    rows = [(x.row, x["values"]) for x in a.read_matrix(spark, m).orderBy("row").collect()]
    assert rows == [(0, [1, 2, 3]), (1, [4.5, -6, 0.007])]
    a.write_matrix(a.read_matrix(spark, m), str(tmp_path / "mm"))
    assert [(x.row, x["values"]) for x in a.read_matrix(spark, str(tmp_path / "mm")).orderBy("row").collect()] == rows
    assert [tuple(x) for x in a.read_codebook(spark, put(tmp_path / "c.txt", "2 2\n1\n2\n3\n4\n")).collect()] == [(0, [1, 2]), (1, [3, 4])]
    assert [tuple(x) for x in a.read_weighted_codebook(spark, put(tmp_path / "cw.txt", "1,2,.5\n3,4,.25\n")).collect()] == [(0, [1, 2], 0.5), (1, [3, 4], 0.25)]
    s = spark.createDataFrame([([0.0, 0.0, 2.5, 0.0, 1.0, 0.0],), ([0.0],), ([],)], "v array<double>").select("v", a.zero_runs(F.col("v")).alias("t"))
    assert [r.t for r in s.collect()] == [":2 2.5 :1 1.0 :1", ":1", ""]
    assert [r.b for r in s.where("t <> ''").select(a.from_zero_runs(F.col("t")).alias("b")).collect()] == [[0, 0, 2.5, 0, 1, 0], [0]]
    a.write_rankings(spark.createDataFrame([(1, 5, 0.2), (1, 6, 0.9)], "query int, item int, score double"), str(tmp_path / "rk"))
    assert spark.read.text(str(tmp_path / "rk")).first().value == "1{6,5}"


def test_images(spark, tmp_path):
    g = np.full((20, 30), 240, dtype=np.uint8)
    g[3:8, 4:9] = 10
    g[12:15, 20:28] = 20
    g[15, 19] = 15
    (tmp_path / "i.pgm").write_bytes(image.encode_pgm(g))
    (tmp_path / "j.pgm").write_text("P2\n# note\n2 2\n255\n0 255\n255 0\n")
    assert (image.decode_pnm((tmp_path / "i.pgm").read_bytes()) == g).all()
    rows = {r.path[-5:]: r for r in image.describe_images(a.read_images(spark, str(tmp_path), "*.pgm")).collect()}
    i = rows["i.pgm"]
    assert (i.width, i.height, i.ink, i.n_components) == (30, 20, 25 + 24 + 1, 2) and rows["j.pgm"].n_components == 1
    ink = g < 100
    assert image.profile(ink, 0).sum() == ink.sum() and (image.local_threshold(g, 6) & ~ink).sum() < 30
    flipped = image.map_images(a.read_images(spark, str(tmp_path), "i.pgm"), lambda x: 255 - x).first()
    assert (image.decode_pnm(bytes(flipped.content)) == 255 - g).all()
    bar = np.zeros((30, 40), dtype=bool)
    bar[:, 20] = True
    assert abs(image.slant(image.shear(bar.astype(np.uint8), 0.5, 0) > 0) + 0.5) < 0.06
    assert image.resized(g, 40, 60).shape == (40, 60)


def test_places_and_sizes(spark):
    rows = spark.createDataFrame([(i * 3 % 101, i) for i in range(101)], "k int, v int").repartition(4)
    assert [r.rn for r in tables.positions(rows, "k").orderBy("k").collect()] == list(range(101))
    got = tables.cut_by_size(rows, "k", "v", 100.0).orderBy("k").collect()
    before = 0
    for r in got:
        assert r.node == before // 100
        before += r.v
