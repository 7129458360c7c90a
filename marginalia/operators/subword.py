"""Subword spotting: sliding windows over words, the best windows of each word, and precision by place.

A word has a row (item, label); a character is ``CHAR`` wide. A result is a row (query, item, label, x0, x1, score), lower
scores being better, as the score of a spotter is a negated likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import interval_iou
from marginalia.operators.ranking import mid_tie_ap_by_ranges
from marginalia.operators.tables import running_before
from marginalia.runtime import materialise, small

CHAR = 10
#: A window that overlaps an occurrence by more than this is a hit.
LIVE_OVERLAP = 0.55


def windows(words: DataFrame, width: Column, stride: int) -> DataFrame:
    """``words`` with a row for each window that fits: r, x0, x1. Words narrower than the window have none."""
    last = F.floor((CHAR * F.char_length("label") - width) / stride)
    return words.where(last >= 0).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumns({"x0": F.col("r") * stride, "x1": F.col("r") * stride + width})


def grid(areas: DataFrame, width: int, height: int, stride: int) -> DataFrame:
    """``areas`` (.., w, h) with the corners x, y of every window on a grid."""
    across = lambda size, window: F.when(size >= window, F.sequence(F.lit(0), size - window, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return areas.withColumn("x", F.explode(across(F.col("w"), width))).withColumn("y", F.explode(across(F.col("h"), height)))


def best_two(results: DataFrame, apart: int) -> DataFrame:
    """Of each query and item the best result (ties: the first window), and the best one more than ``apart`` windows from it."""
    key = ["query", "item"]
    top = results.groupBy(*key).agg(F.min(F.struct("score", "r")).alias("t")).select(*key, F.col("t.r").alias("top"))
    second = results.join(top, key).where(F.abs(F.col("r") - F.col("top")) > apart).groupBy(*key).agg(F.min(F.struct("score", "r")).alias("t")).select(*key, F.col("t.r").alias("r"))
    chosen = top.withColumnRenamed("top", "r").unionByName(second)
    return results.join(chosen, [*key, "r"])


def best_share(results: DataFrame, share: float) -> DataFrame:
    """The best ``share`` of each query's results, rounded down; ties by item and window. Places come from a range sort, as a
    query may hold all rows."""
    total = results.groupBy("query").agg(F.floor(F.count("*") * share).alias("most"))
    placed = running_before(results.withColumn("one", F.lit(1)), ("query",), ("score", "item", "r"), ("one",))
    return placed.join(small(total), "query").where(F.col("one_before") < F.col("most")).select(*results.columns)


def _bounds(place: Column, length: Column) -> tuple[Column, Column]:
    return CHAR * (place - 1), CHAR * (place - 1 + length)


def _with_misses(results: DataFrame, scored: DataFrame, words: DataFrame, twice: bool) -> DataFrame:
    """``scored`` (query, item, score, relevant, claims) and a relevant row at the query's worst score for each occurrence that no
    result claimed: of every word with the n-gram the first, and with ``twice`` the second too."""
    scored = materialise(scored, "judged")
    worst = small(materialise(results.groupBy("query").agg(F.max("score").alias("worst")), "worst"))
    claims = scored.groupBy("query", "item").agg(F.sum("claims").alias("claims"))
    holders = words.join(worst).where(F.expr("instr(label, query) > 0"))
    occurs = F.when(F.expr("locate(query, label, instr(label, query) + 1) > 0"), 2).otherwise(1) if twice else F.lit(1)
    missed = holders.join(claims, ["query", "item"], "left").withColumn("lacking", occurs - F.coalesce("claims", F.lit(0))).where("lacking > 0")
    rows = missed.select("query", "item", F.col("worst").alias("score"), F.lit(True).alias("relevant"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("lacking").cast("long")))).drop("col")
    dummies = scored.where("dummy").join(worst, "query").select("query", "item", F.col("worst").alias("score"), F.lit(True).alias("relevant"))
    return scored.where("relevant IS NOT NULL").select("query", "item", "score", "relevant").unionByName(dummies).unionByName(rows)


def ap_by_overlap(results: DataFrame, words: DataFrame) -> DataFrame:
    """query, n_relevant, ap. A result is judged at the occurrence, first or second, that it overlaps most. It is relevant if it
    overlaps it by more than ``LIVE_OVERLAP`` and no other result of the word overlaps that occurrence as much; one that is
    best but overlaps too little counts as nothing if the word has other results, else as wrong. Occurrences that no
    result claims are appended, with the worst score."""
    length = F.char_length("query")
    first, second = F.expr("instr(label, query)"), F.expr("locate(query, label, instr(label, query) + 1)")
    iou = lambda place, x0, x1: interval_iou(*_bounds(place, length), x0, x1)
    placed = results.withColumns({"one": first, "two": second})
    later = (F.col("two") > 0) & (iou(F.col("two"), F.col("x0"), F.col("x1")) > iou(F.col("one"), F.col("x0"), F.col("x1")))
    placed = placed.withColumn("place", F.when(F.col("one") > 0, F.when(later, F.col("two")).otherwise(F.col("one"))))
    each = Window.partitionBy("query", "item")
    placed = placed.withColumns({"own": iou(F.col("place"), F.col("x0"), F.col("x1")), "all": F.collect_list(F.struct("r", "x0", "x1")).over(each)})
    beaten = F.exists("all", lambda o: (o["r"] != F.col("r")) & (iou(F.col("place"), o["x0"], o["x1"]) >= F.col("own")))
    hit, alone = F.col("own") > LIVE_OVERLAP, F.size("all") == 1
    relevant = F.when(F.col("place").isNull(), False).when(alone, hit).when(beaten, False).when(hit, True)
    held = F.col("place").isNotNull()
    scored = placed.select("query", "item", "score", relevant.alias("relevant"), (held & alone & ~hit).alias("dummy"), F.when(held & (alone | (~beaten & hit)), 1).otherwise(0).alias("claims"))
    return mid_tie_ap_by_ranges(_with_misses(results, scored, words, True), higher_is_better=False)


def agrees_by_parts(place: Column, length: Column, letters: Column, middle: Column, width: Column) -> Column:
    """Whether an n-gram's place in its label and a window's middle in its image are in the same half, or both in the middle third."""
    at, half = place - 1 + length / 2.0, letters / 2.0
    return ((at < 0.8 * half) & (middle < 0.8 * width / 2)) | ((at > 1.2 * half) & (middle > 1.2 * width / 2)) | ((at > letters / 3) & (at < 2 * letters / 3) & (middle > width / 3) & (middle < 2 * width / 3))


def ap_by_position(results: DataFrame, words: DataFrame) -> DataFrame:
    """query, n_relevant, ap without letter bounds: of a word's results the nearest to the n-gram's relative place is relevant; a
    single one is if ``agrees_by_parts``. Words without a result are appended, with the worst score."""
    letters, width = F.char_length("label"), CHAR * F.char_length("label")
    place, length, middle = F.expr("instr(label, query)"), F.char_length("query"), F.col("x0") + (F.col("x1") - F.col("x0")) / 2.0
    each = Window.partitionBy("query", "item")
    off = F.round(F.abs((place - 1 + length / 2.0) / letters - middle / width), 9)
    placed = results.withColumns({"off": off, "n": F.count("*").over(each)}).withColumn("least", F.min("off").over(each))
    held, alone = place > 0, F.col("n") == 1
    agrees = agrees_by_parts(place, length, letters, middle, width)
    scored = placed.select("query", "item", "score", (held & F.when(alone, agrees).otherwise(F.col("off") == F.col("least"))).alias("relevant"), (held & alone & ~agrees).alias("dummy"), F.when(held, 1).otherwise(0).alias("claims"))
    return mid_tie_ap_by_ranges(_with_misses(results, scored, words, False), higher_is_better=False)
