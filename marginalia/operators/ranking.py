"""Similarity ranking and retrieval metrics as window plans.

Rankings come as rows (query, item, score, relevant). Scores are rounded by the caller, as ties count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import dot
from marginalia.operators import blocks
from marginalia.operators.tables import running_before


def similarity(queries: DataFrame, items: DataFrame, digits: int = 6) -> DataFrame:
    """Every query (query, qv, qlabel) against every item (item, v, label), but not against itself: a stated query
    set, so the rows are as many as queries times items. Scores are dot products."""
    met = queries.join(items, queries["query"] != items["item"])
    return met.select("query", "item", F.round(dot(F.col("qv"), F.col("v")), digits).alias("score"), (F.col("qlabel") == F.col("label")).alias("relevant"))


def mid_tie_ap(ranked: DataFrame, by: tuple[str, ...] = ("query",), *, higher_is_better: bool = True) -> DataFrame:
    """``by``, n_relevant, ap. An item's rank is the number of better ones plus half of its equals, rounded down;
    the j-th relevant item in order of rank adds j / (rank + 1). Shared ranks can push this over 1."""
    order = F.desc("score") if higher_is_better else F.asc("score")
    better = F.rank().over(Window.partitionBy(*by).orderBy(order)) - 1
    equal = F.count("*").over(Window.partitionBy(*by, "score")) - 1
    relevant = ranked.withColumn("rank", better + F.floor(equal / 2)).where("relevant")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    return relevant.withColumn("part", nth / (F.col("rank") + 1)).groupBy(*by).agg(F.count("*").alias("n_relevant"), F.avg("part").alias("ap"))


def searched_ap(queries: DataFrame, items: DataFrame, vectors: tuple[str, ...] = ("qv",), blends: tuple[tuple[float, ...], ...] = ((1.0,),)) -> DataFrame:
    """blend, query, n_relevant, ap: what ``mid_tie_ap`` gives for ``similarity``, but the pairs are never rows."""
    return blocks.ranked(queries, items, blocks.mid_tie, "n_relevant long, ap double", vectors, blends)


def searched_places(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """query, item, score, relevant, place of the ``k`` best of ``similarity``, ties by item."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return blocks.best(queries, items, k).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mid_tie_ap_by_ranges(ranked: DataFrame, by: tuple[str, ...] = ("query",), *, higher_is_better: bool = True) -> DataFrame:
    """What ``mid_tie_ap`` gives, for few queries over very many items: no query's rows come together.

    Items of a score are counted first, then the counts are summed along a range sort. The relevant items of a score share
    its rank, and it lies above the rank of any better score, so a score with k relevant items after j better ones adds
    (j + 1 + ... + j + k) / (rank + 1).
    """
    ties = ranked.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum(F.col("relevant").cast("int")).alias("hits"))
    sums = running_before(ties, by, [F.desc("score") if higher_is_better else F.asc("score")], ("n", "hits")).where("hits > 0")
    part = (F.col("hits") * F.col("hits_before") + F.col("hits") * (F.col("hits") + 1) / 2) / (F.col("n_before") + F.floor((F.col("n") - 1) / 2) + 1)
    return sums.withColumn("part", part).groupBy(*by).agg(F.sum("hits").alias("n_relevant"), (F.sum("part") / F.sum("hits")).alias("ap"))


def _placed(ranked: DataFrame, by: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "item")
    hits = F.sum(F.col("relevant").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("place", F.row_number().over(w)).withColumn("hits", hits)


def sorted_ap(ranked: DataFrame, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """``by``, ap: precision at each relevant place in score order, ties by item, over the relevant."""
    return _placed(ranked, by).where("relevant").groupBy(*by).agg(F.avg(F.col("hits") / F.col("place")).alias("ap"))


def precision_at_1(ranked: DataFrame, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """``by``, best, p_at_1: the first of the best items and whether it is relevant."""
    return _placed(ranked, by).where("place = 1").select(*by, F.col("item").alias("best"), F.col("relevant").cast("int").alias("p_at_1"))


def at_k(ranked: DataFrame, k: int, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """``by``, ap_at_k over at most k relevant, p_at_k as the precision at the last hit by k (0 if none), recall_at_k; null without relevant items."""
    part = F.when(F.col("relevant") & (F.col("place") <= k), F.col("hits") / F.col("place"))
    found = F.max(F.when(F.col("place") <= k, F.col("hits")))
    return _placed(ranked, by).groupBy(*by).agg(
        (F.coalesce(F.sum(part), F.lit(0.0)) / F.nullif(F.least(F.lit(k), F.sum(F.col("relevant").cast("int"))), F.lit(0))).alias("ap_at_k"),
        F.coalesce(F.max_by(part, F.when(part.isNotNull(), F.col("place"))), F.lit(0.0)).alias("p_at_k"),
        (found / F.nullif(F.sum(F.col("relevant").cast("int")), F.lit(0))).alias("recall_at_k"),
    )


def thresholds(ranked: DataFrame, precision: float, recall: float, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """``by``, and the scores of the relevant places whose precision and recall are closest to the targets (the
    first of equals), with the precision at that recall."""
    total = F.sum(F.col("relevant").cast("int")).over(Window.partitionBy(*by))
    hit = _placed(ranked, by).withColumn("total", total).where("relevant").withColumn("p", F.col("hits") / F.col("place")).withColumn("r", F.col("hits") / F.col("total"))
    near = lambda c, at: F.struct(F.round(F.abs(F.col(c) - at), 9), F.col("place"))
    return hit.groupBy(*by).agg(
        F.min_by("score", near("p", precision)).alias("score_at_precision"), F.min_by("score", near("r", recall)).alias("score_at_recall"), F.min_by("p", near("r", recall)).alias("precision_at_recall")
    )


def best_setting(scored: DataFrame, setting: str, value: Column) -> DataFrame:
    """``setting``, value, best: the setting of the largest value, the first of equals, is marked."""
    w = Window.partitionBy().orderBy(F.desc("value"), setting)
    return scored.select(setting, value.alias("value")).withColumn("best", F.row_number().over(w) == 1)


def word_error_rate(lines: DataFrame) -> DataFrame:
    """(line, correct) -> wer: 100 * (1 - the mean over lines of the share of correct words)."""
    share = lines.groupBy("line").agg(F.avg(F.col("correct").cast("double")).alias("share"))
    return share.agg(F.round(100 * (1 - F.avg("share")), 6).alias("wer"), F.count("*").alias("n_lines"))
