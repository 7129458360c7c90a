"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import free_name, narrow
from marginalia.runtime import materialise, ship_package


def word_count(text: Column) -> Column:
    """Runs of other characters than space and 0x09 to 0x0D; null: 0."""
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([0 if t is None else len(t.encode("utf-8", "surrogatepass").split()) for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")(text)


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """source, source_size -> the same with target: ``share`` of all sizes by weight, no source above
    ``most`` times its size, what it cannot take going to the others by weight.

    That is the level w * weight at which capped and uncapped sources add up to the share. Sources are
    walked in the order in which they reach their cap as the level rises; there is one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level, rest = Window.orderBy("level", F.col("source").asc_nulls_last()), Window.unboundedPreceding
    everything = Window.partitionBy()
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    s = s.withColumn("whole", share * F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    before = by_level.rowsBetween(rest, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("taken", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("open_level", (F.col("whole") - F.col("capped")) / (F.col("weights") - F.col("taken")))
    level = F.max(F.when(F.col("open_level") <= F.col("level"), F.col("open_level"))).over(everything)
    return s.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "target")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5, most: float = 2.0, seed: str = "mix", row_col: str | None = None,
) -> DataFrame:
    """One row per document: ``id_col``, source, size, source_size, target, copies, and row_ with what ``row_col`` holds, if given.

    Each document of a source is expected target / source_size times. Along the order (size, id) of a
    source, the expected copies are prefix-summed, an offset in [0, 1) drawn from ``seed`` and the source's
    name is added, and a document is emitted once per integer crossed. Walking by size spreads the copies
    over short and long documents, which keeps the words taken near the target; a rate of at most ``most``
    never emits a document more than ``ceil(most)`` times.

    The order is a range-partitioned sort on (source, size, id), so that a source with a third of all rows
    spans many tasks; prefixes are positions within a task plus the counts of the tasks before it. Null
    texts have size 0, and a source of size 0 emits nothing. Null is a source, the last one. Repeated rows are
    separate documents; of rows equal in source, size and id any order gives the same multiset. An empty
    table gives an empty result. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    row = {"row_": row_col} if row_col else {}
    rows = narrow(docs, id=id_col, text=text_col, source=source_col, **row).select("id", "source", *row, word_count(F.col("text")).alias("size"))
    position = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(F.col("source").asc_nulls_last(), "size", F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last(), "size", F.col("id").asc_nulls_last())
    ordered = materialise(ordered.withColumn("at", position), "mix-ordered").withColumn("task", F.shiftright("at", 33))
    runs = ordered.groupBy("source", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words"))
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    aims = targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    aims = aims.withColumnRenamed("source", "of")
    runs = runs.join(aims, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("s"), F.col("task").alias("t"), "first", "before", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    nth = F.col("at") - F.col("first") + F.col("before")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    crossed = F.least(F.floor((nth + 1) * rate + offset) - F.floor(nth * rate + offset), F.ceil(F.lit(most)))
    joined = ordered.join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t")))
    return joined.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", crossed.cast("long").alias("copies"), *row)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", *, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """``docs`` with all its columns, each row as many times as ``mix`` says, so not at all for 0.

    Rows are numbered and written once, so each has its own number of copies, also where ids, or whole rows, repeat or are null, and a
    task run anew meets the same numbers. Up to ``broadcast_rows`` numbers of copies are sent to the texts; with more, the texts are
    shuffled by row, a key that no two rows share. The columns may have any names. An empty table gives an empty one.
    """
    row, copies, copy = names = [free_name([*docs.columns, "row_"], x) for x in ("mix_row", "mix_copies", "mix_copy")]
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    found = mix(numbered, id_col, row_col=row, **options).where("copies > 0").select(F.col("row_").alias(copy), F.col("copies").alias(copies))
    found = materialise(found, "mix-copies")
    chosen = F.broadcast(found) if found.count() <= broadcast_rows else found
    met = numbered.join(chosen, numbered[row] == chosen[copy]).drop(copy)
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(*names)
