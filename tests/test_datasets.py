import pytest
from marginalia.sources import datasets


def test_splits_are_appended(spark):
    train, test = spark.createDataFrame([(1, "a")], "id int, word string"), spark.createDataFrame([(2, 5)], "id int, writer int")
    assert sorted(map(tuple, datasets.appended(train, test).select("id", "word", "writer", "split").collect())) == [(1, "a", None, "train"), (2, None, 5, "test")]


def test_a_set_is_read_once(spark, tmp_path):
    calls = []
    readers = {"one": lambda s: calls.append(1) or s.range(3)}
    for _ in range(2):
        assert datasets.load(spark, "one", readers, f"file://{tmp_path}").count() == 3
    assert calls == [1]
    with pytest.raises(ValueError, match="no data set two"):
        datasets.load(spark, "two", readers, str(tmp_path))


def test_store_and_columns(spark, tmp_path):
    rows = spark.createDataFrame([(i, bytes([i]), [i, i + 1, i + 2]) for i in range(20)], "id long, image binary, v array<int>")
    datasets.write_store(rows, "id", f"file://{tmp_path}/s")
    got = datasets.read_store(spark, f"file://{tmp_path}/s", "id", [3, 7], ["image"])
    assert sorted((r.id, bytes(r.image)) for r in got.collect()) == [(3, b"\x03"), (7, b"\x07")]
    assert "PushedFilters: [In(id" in got._jdf.queryExecution().toString()
    assert [r.v for r in datasets.matrix_columns(rows.where("id = 4"), "v", [2, 0]).collect()] == [[6, 4]]


def test_result_tables(spark, tmp_path):
    rows = spark.createDataFrame([("ab", 1, 0, 20, 0.5, True), ("ab", 2, 8, 28, 0.25, False)], "query string, item long, x0 long, x1 long, score double, relevant boolean")
    datasets.write_spottings(rows, f"file://{tmp_path}/t")
    assert sorted(map(tuple, datasets.read_spottings(spark, f"file://{tmp_path}/t").collect())) == sorted(map(tuple, rows.collect()))
    for turn in range(2):
        datasets.append_log(rows, turn, f"file://{tmp_path}/log")
    assert sorted(r.turn for r in spark.read.parquet(f"file://{tmp_path}/log").collect()) == [0, 0, 1, 1]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "p1.gt.txt").write_text("x")
    r = datasets.pointers(spark, f"file://{tmp_path}/labels").first()
    assert r.label_file.endswith("/p1.gt.txt") and r.image.endswith("/p1.gt.png")
