from pathlib import Path

import corpus_pipeline
from marginalia.llm import line_dedup, mixing, near_dedup, quality
from marginalia.runtime import scratch_dir


def test_stages_follow_their_operators(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, small)
        if name != "pack":
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
        if name == "quality_rules":
            model = quality.train_quality(before, spark.read.parquet(f"{small}/labels.parquet"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality.quality(before, model).where("kept").collect()}
        if name == "line_dedup":
            gone = line_dedup.duplicate_lines(before).count()
            lines = lambda rows: sum(len(r.text.split("\n")) if r.text else 0 for r in rows.collect())
            assert abs(lines(before) - lines(docs) - gone) <= sizes[-1] and sizes[-1] == sizes[-2]
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "near_dedup":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in near_dedup.near_duplicates(before).where("kept").collect()}
        if name == "mix_sources":
            assert sizes[-1] == sum(r.copies for r in mixing.mix(before).collect())
    assert corpus_pipeline.run(spark, small).count() == sizes[-1] > 0


def test_awkward_tables_run_through_all_stages(spark, small, awkward, nothing):
    """Nulls, repeats and clashing columns; the stages are run one after another on what the one before kept."""
    from pyspark.sql import functions as F

    for docs in (awkward, nothing):
        docs = docs.withColumns({"n_lines": F.lit(1), "N_Removed": F.lit("x"), "__gone": F.lit(2), "copies": F.lit(3), "n_chars": F.length("text")})
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, small)
            if name != "pack":
                assert docs.columns == columns
                docs = spark.createDataFrame(docs.collect(), docs.schema)
        docs.collect()
    assert corpus_pipeline.quality_rules(spark, awkward, small).columns == awkward.columns


def test_every_stage_keeps_any_column(spark, small, texts):
    """Columns with the names that the operators use for their own, on documents with words, through all stages in order."""
    from pyspark.sql import functions as F

    names = ["__id", "__copies", "__copy", "__gone", "__version", "number", "row", "row_", "mix_row", "mix_copies", "mix_copy", "MIX_ROW_", "id", "size", "node", "component", "kept", "copies", "n_words"]
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in names})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        if name != "pack":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.count() and all(r[n] == f"{n}:{r.doc_id}" for r in docs.collect() for n in names)
    assert docs.count()


def test_rows_that_repeat_are_mixed_one_by_one(spark):
    """The stage takes as many copies as the operator gives, row by row."""
    rows = [(i % 7 if i % 11 else None, "w " * (i % 13), f"s{i % 2}", i) for i in range(300)] + [(1, None, "s0", 900), (2, "x y", None, 901)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    copies = mixing.mix(docs).groupBy("doc_id", "source", "size").agg({"copies": "sum"}).collect()
    expected = {(r[0], r[1], r[2]): r[3] for r in copies if r[3]}
    got = {}
    for r in mixing.mix_documents(docs).collect():
        key = (r.doc_id, r.source, len((r.text or "").split()))
        got[key] = got.get(key, 0) + 1
    assert got == expected
    each = {}
    for r in mixing.mix_documents(docs).collect():
        each[r.n] = each.get(r.n, 0) + 1
    assert max(each.values()) <= 2
    assert mixing.mix_documents(docs.where("false")).count() == 0


def test_stages_leave_no_files(spark, small):
    """Each stage's tables stayed beside the next one's, and so did its result."""
    at = Path(scratch_dir(spark).removeprefix("file://"), "marginalia")
    folders = lambda: {p.name for p in at.iterdir()} if at.exists() else set()
    before = folders()
    rows = corpus_pipeline.run(spark, small)
    left = {n.rsplit("-", 1)[0] for n in folders() - before}
    assert rows.count() and "pipeline-mix_sources" in left and not {n for n in left if n.startswith(("line", "near", "mix", "pipeline-n", "pipeline-l", "pipeline-q"))}, left
