"""Joins and filters between tables, by key, place or position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.runtime import materialise


def first_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on all keys; of several right rows with the same keys one is used."""
    return left.join(right.dropDuplicates(keys), keys)


def positions(rows: DataFrame, order: str, name: str = "rn") -> DataFrame:
    """The rows with their 0-based place in order: a range sort, places within tasks, and the tasks' counts before."""
    placed = materialise(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "positions")
    placed = placed.withColumn("__task", F.shiftright("__at", 33))
    counts = placed.groupBy("__task").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return placed.join(before, "__task").withColumn(name, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")).drop("__task", "__at", "__before")


def running_before(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    """The rows with, for each of ``columns``, its sum over the earlier rows of the same ``by``, as ``<column>_before``.

    A range sort by ``by`` and ``order``, so that a ``by`` that holds most rows spreads over many tasks; sums within a task's part of a
    ``by``, and the parts' totals before it. ``order`` should leave no ties.
    """
    sorted_ = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(sorted_, "running").withColumn("__task", F.shiftright("__at", 33))
    part = ["__task", *by]
    totals = placed.groupBy(*part).agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    earlier = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*part, *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}_before") for c in columns])
    within = Window.partitionBy(*part).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__{c}_inner") for c in columns])
    joined = inner.join(before.select(*[F.col(c).alias(f"__by_{c}") for c in part], *[f"__{c}_before" for c in columns]), [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in part])
    return joined.select(*rows.columns, *[(F.col(f"__{c}_inner") + F.col(f"__{c}_before")).alias(f"{c}_before") for c in columns])


def zip_rows(a: DataFrame, a_order: str, b: DataFrame, b_order: str) -> DataFrame:
    """The i-th row of one with the i-th of the other, as far as both go."""
    return positions(a, a_order).join(positions(b, b_order), "rn").drop("rn")


def cut_by_size(rows: DataFrame, order: str, size: str, target: float) -> DataFrame:
    """The rows with node, the number of whole ``target``s in the sizes before; prefix sums go by task, as in ``positions``."""
    placed = materialise(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "sizes").withColumn("__task", F.shiftright("__at", 33))
    sums = placed.groupBy("__task").agg(F.sum(size).alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inner = F.coalesce(F.sum(size).over(Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("__inner", inner).join(before, "__task").withColumn("node", F.floor((F.col("__inner") + F.col("__before")).cast("double") / target).cast("long")).drop("__task", "__at", "__before", "__inner")


def points_in_boxes(points: DataFrame, boxes: DataFrame, w: float, h: float, columns: Sequence[str] = ("pid",)) -> DataFrame:
    """box, pid (or other ``columns``) of the points (pid, px, py) in the boxes (box, x, y) of one size, edges included.

    Both go to cells of the box's size, a point to one and a box to the four it may touch: the join is on equality."""
    at = points.withColumn("cx", F.floor(F.col("px") / w)).withColumn("cy", F.floor(F.col("py") / h))
    spread = boxes.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x") / w), F.floor((F.col("x") + w) / w)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / h), F.floor((F.col("y") + h) / h))))
    inside = F.col("px").between(F.col("x"), F.col("x") + w) & F.col("py").between(F.col("y"), F.col("y") + h)
    return at.join(spread, ["cx", "cy"]).where(inside).select("box", *columns)


def one_of_each(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """box and first of all boxes (box, x, y), first being the least box at the same place, and box, x, y of the firsts: what holds for one holds for all there."""
    marked = materialise(boxes.select("box", "x", "y", F.min("box").over(Window.partitionBy("x", "y")).alias("first")), "box-places")
    return marked.select("box", "first"), marked.where("box = first").select("box", "x", "y")


def mask_iou(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """common, joint, iou of two sets of places."""
    each = a.select(*keys, F.lit(1).alias("ina"), F.lit(0).alias("inb")).union(b.select(*keys, F.lit(0), F.lit(1)))
    place = each.groupBy(*keys).agg(F.max("ina").alias("ina"), F.max("inb").alias("inb"))
    return place.agg(F.sum(F.col("ina") * F.col("inb")).alias("common"), F.count("*").alias("joint"), F.round(F.sum(F.col("ina") * F.col("inb")) / F.count("*"), 6).alias("iou"))


def append_missed(found: DataFrame, expected: DataFrame, key: str, score: str) -> DataFrame:
    """``found`` and, with the worst (largest) score, the expected keys that weren't found."""
    worst = found.agg(F.max(score).alias(score))
    missed = expected.join(found, key, "left_anti").join(F.broadcast(worst)).select(key, score, F.lit(True).alias("missed"))
    return found.select(key, score, F.lit(False).alias("missed")).unionByName(missed)


def resume_from(rows: DataFrame, order: str, start: Column) -> DataFrame:
    """The rows from the first on that meets ``start``; none if there is no such row."""
    first = rows.where(start).agg(F.min(order).alias("__first"))
    return rows.join(F.broadcast(first), F.col(order) >= F.col("__first")).drop("__first")


def thinned(rows: DataFrame, order: str, steps: Sequence[int]) -> DataFrame:
    """Every row whose 1-based place is divisible by one of ``steps``."""
    place = F.col("rn") + 1
    keep = F.lit(False)
    for s in steps:
        keep = keep | (place % s == 0)
    return positions(rows, order).where(keep).drop("rn")


def joined_places(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The places of either partition, each once."""
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def cleared_places(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The places of ``a``, each once, without those of ``b``."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def place_bounds(places: DataFrame, x: str, y: str) -> DataFrame:
    """n, left, right, upper, lower of a partition; an empty one has no bounds."""
    return places.agg(F.count("*").alias("n"), F.min(x).alias("left_x"), F.max(x).alias("right_x"), F.min(y).alias("upper_y"), F.max(y).alias("lower_y"))
