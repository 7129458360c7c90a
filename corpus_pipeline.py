"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.

What holds for every stage: a null or empty text is a document without words, which fails the quality rules' base and would pass
the others unchanged; a null id can't be referred to, so such rows are never dropped as copies and lose no lines; whole texts are
read, however long; ties go to the smaller id; rows that repeat an id and a text fare alike; an empty table gives an
empty one; further columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import line_dedup, mixing, near_dedup, packing, quality
from marginalia.llm.queries import tokenizer_path
from marginalia.runtime import materialise, release, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the trees reject go, among them those of under 50 words, so null and empty texts. Rows that
    repeat an id are judged one by one."""
    return quality.quality_filter(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text. A document that loses every line stays, with an empty text. Null texts stay
    null, with their n_chars null."""
    done = line_dedup.line_dedup(docs).select(*docs.columns)
    return done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of least id. Empty and null texts have no copies."""
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, also not at all; null sources are one source, the last. Documents
    without words have no size, and no part of the mix depends on them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and place. A document that the mix took twice has each piece twice; a
    null or empty text is the one closing id."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL can express neither the trees nor the signatures nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's own files go when its result is written, and the stage's before with them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            before, docs = docs, keep(materialise(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
