"""Binary formats byte by byte, what filters and schemas leave unread, and functions for SQL at their edges."""

import os
import struct

import numpy as np
import pytest
from marginalia.functions import sql
from marginalia.operators import visitor
from marginalia.sources import binary


@pytest.fixture(scope="module")
def session(spark):
    binary.register(spark)
    sql.register(spark)
    return spark


def test_single_files(session, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "m").write_bytes(struct.pack("<ii", 4, 3) + m.tobytes())
    rows = session.read.format("matrix").option("columns_per_task", 3).load(str(tmp_path / "m"))
    assert {r.number: r.v for r in rows.collect()} == {i: m[i].tolist() for i in range(4)}
    pictures = [(2, 3, bytes(range(6))), (0, 0, b""), (1, 2, b"ab")]
    at, body, toc = 4 + 8 * 3, b"", []
    for h, w, p in pictures:
        toc.append(at + len(body))
        body += struct.pack("<ii", w, h) + p
    (tmp_path / "i").write_bytes(struct.pack("<i", 3) + struct.pack("<3q", *toc) + body)
    got = session.read.format("images").load(str(tmp_path / "i")).orderBy("number").collect()
    assert [(r.height, r.width, bytes(r.pixels)) for r in got] == pictures
    assert [r.number for r in session.read.format("images").schema("number long").load(f"file://{tmp_path}/i").orderBy("number").collect()] == [0, 1, 2]
    assert [tuple(r) for r in session.read.format("images").schema("width int, number long").load(str(tmp_path / "i")).orderBy("number").collect()] == [(3, 0), (0, 1), (2, 2)]


@pytest.mark.parametrize("condition, expected", [("number = 7", {7}), ("number IN (1, 30, 99)", {1, 30}), ("number > 5 AND number <= 8", {6, 7, 8}), ("number >= 38 AND number < 100", {38, 39}), ("number = 3 AND number IN (4, 5)", set()), ("number % 20 = 1 AND number > 1", {21}), ("number < 0", set()), ("number = 1 OR number = 39", {1, 39})])
def test_parts_and_filters(session, tmp_path, condition, expected):
    rows = [(i, [float(i), -float(i)]) for i in range(40)]
    path = str(tmp_path / "parts")
    session.createDataFrame(rows, "number long, v array<float>").repartitionByRange(3, "number").sortWithinPartitions("number").write.format("matrix").mode("append").save(path)
    assert all(n.startswith("part-") for n in os.listdir(path))
    back = session.read.format("matrix").option("columns_per_task", 7).load(path)
    assert {(r.number, *r.v) for r in back.collect()} == {(i, *v) for i, v in rows}
    assert {r.number for r in back.where(condition).collect()} == expected


def test_only_wanted_ranges_are_planned(tmp_path):
    (tmp_path / "m").write_bytes(struct.pack("<ii", 100, 1) + np.arange(100, dtype="<f4").tobytes())
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    class Schema:
        def fieldNames(self):
            return ["number", "v"]

    def planned(*filters):
        r = binary.MatrixReader({"path": str(tmp_path / "m"), "columns_per_task": "10"}, Schema())
        left = list(r.pushFilters(list(filters)))
        return left, [(p.first, p.last) for p in r.partitions()], [b.column(0).to_pylist() for p in r.partitions() for b in r.read(p)]

    assert planned(EqualTo(("number",), 42)) == ([], [(40, 50)], [[42]])
    assert planned(In(("number",), (3, 95))) == ([], [(0, 10), (90, 100)], [[3], [95]])
    left, parts, _ = planned(GreaterThan(("number",), 84), LessThan(("number",), 99), EqualTo(("v",), 1))
    assert [f.attribute for f in left] == [("v",)] and parts == [(85, 95), (95, 99)]


def test_bad_matrices(session, tmp_path):
    for rows in ([(0, [1.0]), (1, [1.0, 2.0])], [(0, None)]):
        with pytest.raises(Exception, match="a matrix has"):
            session.createDataFrame(rows, "number long, v array<float>").coalesce(1).write.format("matrix").mode("append").save(str(tmp_path / "bad"))
    assert not os.path.exists(tmp_path / "bad") or not [n for n in os.listdir(tmp_path / "bad") if not n.startswith("_")]


def test_sql_functions(session):
    one = lambda q: session.sql(f"SELECT {q} AS x").first().x
    assert one("normalised_levenshtein('kitten', 'sitting')") == pytest.approx(3 / 7) and one("normalised_levenshtein('', '')") is None
    assert one("platt(0.0D, 2.0D, 0.0D)") == 0.5 and one("interval_iou(0D, 10D, 5D, 15D)") == pytest.approx(1 / 3) and one("interval_iou(1D, 1D, 1D, 1D)") is None
    ap = session.sql("SELECT g, average_precision(s, r) AS ap FROM VALUES ('a', 3.0D, true), ('a', 2.0D, false), ('a', 1.0D, true), ('b', 1.0D, false) AS t(g, s, r) GROUP BY g").collect()
    assert {r.g: r.ap for r in ap} == {"a": pytest.approx((1 + 2 / 3) / 2), "b": None}
    assert session.sql("SELECT * FROM position_histogram('', array(2))").count() == 0 and session.sql("SELECT * FROM position_histogram(NULL, array(2))").count() == 0
    with pytest.raises(Exception, match="a string and an array"):
        session.sql("SELECT * FROM position_histogram(1, array(2))").collect()


@pytest.mark.parametrize("width, stride", [(3, 1), (4, 2), (2, 5)])
def test_windows_in_sql(session, width, stride):
    sizes = {"a": 11, "b": 1, "c": 4}
    session.createDataFrame([(k, i, float(i * i)) for k, n in sizes.items() for i in range(n)], "k string, i int, v double").repartition(5).createOrReplaceTempView("w_rows")
    got = {(r.k, r.start): (r.n, r["mean"]) for r in session.sql(f"SELECT * FROM sliding_windows(TABLE(w_rows) PARTITION BY (k) ORDER BY (i), 'k', {width}, {stride}, 'v')").collect()}
    expected = {}
    for k, n in sizes.items():
        for start in range(0, max(1, n - width + 1), stride):
            seen = [i * i for i in range(start, min(n, start + width))]
            expected[(k, start)] = (len(seen), pytest.approx(sum(seen) / len(seen)))
    assert got == expected
    with pytest.raises(Exception, match="no column zz"):
        session.sql("SELECT * FROM sliding_windows(TABLE(w_rows) PARTITION BY (k) ORDER BY (i), 'k', 2, 1, 'zz')").collect()


def test_visitors(session):
    class Largest:
        """A visitor of its own: the largest of weight times distance from a corner."""

        def start(self):
            return np.array([-1.0])

        def step(self, state, weights, xs):
            return np.maximum(state, (weights * xs).max())

        def merge(self, a, b):
            return np.maximum(a, b)

        def finish(self, state):
            return state[0]

    rng = np.random.default_rng(1)
    points = [(i, float(x), float(y), int(f)) for i, (x, y, f) in enumerate(zip(rng.uniform(0, 20, 300), rng.uniform(0, 20, 300), rng.integers(0, 4, 300), strict=True))] + [(999, None, 1.0, 2)]
    boxes = [(b, float(x), float(y)) for b, (x, y) in enumerate(rng.uniform(-2, 18, (30, 2)))] + [(77, 500.0, 500.0)]
    p, b = session.createDataFrame(points, "pid long, px double, py double, f int").repartition(4), session.createDataFrame(boxes, "box long, x double, y double")
    inside = lambda x, y: [q for q in points if q[1] is not None and x <= q[1] <= x + 5 and y <= q[2] <= y + 4]
    got = {r.box: r.value for r in visitor.visited(p, b, 5.0, 4.0, Largest(), ("f", "px"), states=3).collect()}
    assert got == {k: pytest.approx(max([q[3] * q[1] for q in inside(x, y)], default=-1.0)) for k, x, y in boxes}
    weights, learnt = np.array([1.0, 2.0, 0.5, 1.0]), np.array([0.6, 0.8, 0.0, 0.0])
    bags = {r.box: r.value for r in visitor.visited(p, b, 5.0, 4.0, visitor.Bag(weights, learnt), ("f",)).collect()}
    for k, x, y in boxes:
        n = np.bincount([q[3] for q in inside(x, y)], minlength=4)
        assert bags[k] == pytest.approx(((learnt - visitor.unit_bag(n, weights)) ** 2).sum())
