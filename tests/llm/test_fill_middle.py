"""Fill-in-the-middle against a plain version over a list of units, and exact round trips."""

import hashlib
import re

import pytest
from marginalia.llm import fill_middle, queries
from pyspark.sql import functions as F

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, percent=100, spm=50, seed=7, units=LINES):
    text = text or ""
    parts = units.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
    if not text or any(m in text for m in fill_middle.MARKERS) or h[2] % 100 >= percent:
        return len(parts), "plain", None, None, text
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(parts), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_query(spark, small, texts):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = queries.op11_fill_in_middle(spark, small).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"psm", "spm"}
    for r in rows:
        n, form, p, m, output = plain(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p, m, sha(output), sha(texts[r.doc_id]))


HARD = [None, "", "\n", "\n\n\n", "one", "one\n", "\none", "a\nb\nc", "a\x01b\n\x02d\x02e\x01\n\x02", "\x01", "\x02\x01\x02", "x<P>y\nz", "<M>\n", "<P\n><S\nM>", "a<\n<\n<S\n", "é\n日本\n😀\r\n x\n", "$1\\\n$0\n", "\x00\n\x00", "long line " * 30_000, "line\n" * 20_000]


@pytest.mark.parametrize("unit, pattern", [("line", LINES), ("character", re.compile(r"(?s).")), ("word", re.compile(r"\s*\S+\s*|\s+", re.ASCII))])
def test_hard_texts(spark, unit, pattern):
    given = [(i + 100 * j, t) for j in range(6) for i, t in enumerate(HARD) if unit == "line" or len(t or "") < 1000] + [(None, "a\nb\nc"), (3, "\n\n\n"), (3, "other\ntext")]
    rows = spark.createDataFrame(given, "doc_id long, text string")
    cut = fill_middle.fill_in_middle(rows, unit=unit, percent=80, spm_percent=30, seed=11)
    got = cut.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(given, key=str)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text, 80, 30, 11, pattern), (r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_awkward_tables(spark, awkward, nothing):
    rows = awkward.drop("n")
    got = fill_middle.fill_in_middle(rows.withColumns({"text_": F.lit(1), "cut_": F.lit("x"), "part_": F.lit(2), "DRAW_": F.lit(3)}))
    assert got.columns[: len(rows.columns)] == rows.columns and got.count() == awkward.count()
    for r in got.collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
    assert fill_middle.fill_in_middle(nothing.drop("n")).count() == 0
    with pytest.raises(ValueError, match="names of the result"):
        fill_middle.fill_in_middle(awkward)
