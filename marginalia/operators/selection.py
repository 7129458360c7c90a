"""Small selections, guards and figures over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(items: DataFrame, label: str) -> DataFrame:
    """``items`` with how many others share the label, and whether it can be a query by example (needs another) or by text."""
    counts = items.groupBy(label).agg(F.count("*").alias("n"))
    return items.join(counts, label).withColumn("others", F.col("n") - 1).withColumns({"by_example": F.col("others") >= 1, "by_text": F.col("n") >= 1}).drop("n")


def rescaled(rows: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """``rows`` with shown, 1 for the least score of its group and 0 for the largest; 1 where all are equal."""
    w = Window.partitionBy(*by)
    span = F.max(score).over(w) - F.min(score).over(w)
    return rows.withColumn("shown", F.when(span == 0, 1.0).otherwise(1 - (F.col(score) - F.min(score).over(w)) / F.when(span != 0, span)))


def crossing(one: Sequence[Column], two: Sequence[Column]) -> tuple[Column, Column]:
    """Where two lines (a, b, c), a x + b y + c = 0, meet: the cross product over its last part, null for parallels."""
    x, y, w = one[1] * two[2] - one[2] * two[1], one[2] * two[0] - one[0] * two[2], one[0] * two[1] - one[1] * two[0]
    w = F.when(w != 0, w)
    return x / w, y / w


def line_through(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    return y1 - y2, x2 - x1, x1 * y2 - x2 * y1


def guarded(score: Column, width: Column, letters: Column, narrowest: float, widest: float, bad: float) -> Column:
    """The score, or ``bad`` where the width can't be that of so many letters."""
    return F.when(width.between(letters * narrowest, letters * widest), score).otherwise(F.lit(bad))


def in_window(place: Column, length: Column, left: Column, right: Column) -> Column:
    """Whether an n-gram at ``place`` lies in the window of letters, one more to each side."""
    return (place >= left - length - 1) & (place <= right + 1)


def no_nan(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows``, but a NaN in one of the columns ends the query with the column's name."""
    stop = lambda c: F.when(F.isnan(c), F.raise_error(F.lit(f"NaN in {c}"))).otherwise(F.col(c))
    return rows.withColumns({c: stop(c) for c in columns})


def rth(rows: DataFrame, by: Sequence[str], order: Sequence[Column], r: int) -> DataFrame:
    """The r-th row of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") == r).drop("_r")


def draw(*parts: Column | str) -> Column:
    """A number from 0 up to 1 out of the parts' text, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("double") / 268435456.0


def sampled(rows: DataFrame, by: str, order: str, middle: int, seed: str) -> DataFrame:
    """by, pick, order: the first row (pick 0), ``middle`` drawn ones between with replacement, and the last of each group."""
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    sizes = numbered.groupBy(by).agg(F.max("at").alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(middle + 1)))
    between = 2 + F.floor(draw(F.lit(seed), F.col(by), F.col("pick").cast("string")) * (F.col("n") - 2))
    picks = sizes.withColumn("pick", k).withColumn("at", F.when(F.col("pick") == 0, 1).when(F.col("pick") == middle + 1, F.col("n")).when(F.col("n") > 2, between))
    return picks.join(numbered, [by, "at"]).select(by, "pick", order)


def stable_intersect(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, ia, ib: keys in both with the place of their first occurrence in either; ``at`` is the place. Order by ia to keep the left order."""
    first = lambda rows, name: rows.groupBy(key).agg(F.min("at").alias(name))
    return first(left, "ia").join(first(right, "ib"), key)


def neighbours(cells: DataFrame, value: str) -> DataFrame:
    """cells (x, y, value) with around, the sum of the four neighbours there are, and lowest, their least value."""
    sides = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    sent = cells.withColumn("s", sides).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.col(value).alias("_v"))
    met = sent.groupBy("x", "y").agg(F.sum("_v").alias("around"), F.min("_v").alias("lowest"))
    return cells.join(met, ["x", "y"], "left")
