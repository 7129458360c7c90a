"""Codewords: nearest, soft assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import squared_l2


def distances(rows: DataFrame, book: DataFrame, digits: int = 6) -> DataFrame:
    """(item, v) x (code, center) -> item, code, d. A codebook is a model of fixed size, so it is sent to the rows."""
    return rows.join(F.broadcast(book)).select("item", "code", F.round(squared_l2(F.col("v"), F.col("center")), digits).alias("d"))


def nearest(rows: DataFrame, book: DataFrame) -> DataFrame:
    """item, code, d of the nearest codeword, the first of equals."""
    best = distances(rows, book).groupBy("item").agg(F.min(F.struct("d", "code")).alias("b"))
    return best.select("item", "b.code", "b.d")


def soft_assignment(rows: DataFrame, book: DataFrame, t: int, eps: float = 1e-4) -> DataFrame:
    """item, code, weight of the t nearest codewords: inverse distances, shifted by eps, that add up to one."""
    near = distances(rows, book).withColumn("rn", F.row_number().over(Window.partitionBy("item").orderBy("d", "code"))).where(F.col("rn") <= t)
    inverse = 1 / (eps + F.col("d"))
    return near.select("item", "code", F.round(inverse / F.sum(inverse).over(Window.partitionBy("item")), 6).alias("weight"))
