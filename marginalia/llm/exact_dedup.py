"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import ascii_lower, narrow
from marginalia.runtime import materialise


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, normalise: Callable[[Column], Column] = ascii_lower,
    prefix_chars: int = 256, broadcast_rows: int = 1_000_000, digest: bool = False,
) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept (and text_sha256 if ``digest``).

    Two documents are equal when ``normalise`` makes their texts equal; the largest id of a group
    stays. ``normalise`` must keep the number of bytes, as ASCII lower-casing does. The first scan
    reads lengths and the hash of a prefix; only rows that share both with another row are hashed
    in full. Their ids are broadcast up to ``broadcast_rows``, and joined by a shuffle beyond.

    A null text is the empty text, and empty texts are equal to each other. A row whose id is null
    cannot be referred to: it is a group of one and kept. Rows that repeat an id and a text count
    as members, share one outcome and are each returned. An empty table gives an empty result;
    columns other than the two named ones are not looked at.
    """
    rows = narrow(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    full = F.sha2(normalise(F.col("text")), 256)
    keys = materialise(
        rows.select("id", F.octet_length("text").alias("n"), F.xxhash64(normalise(F.substring("text", 1, prefix_chars))).alias("prefix")), "exact-keys"
    )
    same_length = keys.groupBy("n").count().where("count > 1").select("n")
    by_length = keys.join(same_length, "n", "left_semi")
    same_prefix = by_length.groupBy("n", "prefix").count().where("count > 1").select("n", "prefix")
    alive = materialise(by_length.join(same_prefix, ["n", "prefix"], "left_semi").where("id IS NOT NULL").select("id").distinct(), "exact-alive")
    chosen = F.broadcast(alive) if alive.count() <= broadcast_rows else alive
    hashed = materialise(rows.join(chosen, "id", "left_semi").select("id", full.alias("sha")), "exact-hashed")
    groups = hashed.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    members = hashed.distinct().join(groups, "sha")
    if digest:
        every, on = rows.select("id", full.alias("sha")), ["id", "sha"]
    else:
        every, on, members = keys.select("id"), ["id"], members.drop("sha")
    out = every.join(members, on, "left")
    keep = F.coalesce("keep_id", "id")
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"), *([F.col("sha").alias("text_sha256")] if digest else []),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that ``duplicate_groups`` keeps, with all their columns. Rows whose id is null stay."""
    gone = duplicate_groups(docs, id_col, text_col, **options).where("NOT kept").select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
