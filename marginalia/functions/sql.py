"""Functions for SQL users: scalar functions in SQL itself, an aggregate over Arrow batches, and Python table functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, NullType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from marginalia.runtime import ship_package

#: Characters of the position histogram.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"

SCALARS = {
    "normalised_levenshtein": "(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN greatest(char_length(a), char_length(b)) > 0 THEN levenshtein(a, b) / greatest(char_length(a), char_length(b)) END",
    "platt": "(s DOUBLE, a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(a * s + b))",
    "interval_iou": "(s1 DOUBLE, e1 DOUBLE, s2 DOUBLE, e2 DOUBLE) RETURNS DOUBLE RETURN CASE WHEN greatest(e1, e2) <> least(s1, s2) THEN (least(e1, e2) - greatest(s1, s2)) / (greatest(e1, e2) - least(s1, s2)) END",
}


class PositionHistogram:
    """``position_histogram(word, levels)``: level, region, symbol, value of the soft position histogram, without its zeros."""

    @staticmethod
    def analyze(word: AnalyzeArgument, levels: AnalyzeArgument) -> AnalyzeResult:
        if word.dataType not in (StringType(), NullType()) or not isinstance(levels.dataType, ArrayType):
            raise ValueError("position_histogram takes a string and an array of levels")
        return AnalyzeResult(StructType([StructField("level", IntegerType()), StructField("region", IntegerType()), StructField("symbol", StringType()), StructField("value", DoubleType())]))

    def eval(self, word: str | None, levels: list[int] | None) -> Iterator[tuple]:
        n = len(word or "")
        for level in levels or []:
            best: dict[tuple[int, str], float] = {}
            for i, symbol in enumerate(word or ""):
                if symbol not in ALPHABET:
                    continue
                for region in range(i * level // n, min(level, -(-(i + 1) * level // n))):
                    share = round((min((i + 1) / n, (region + 1) / level) - max(i / n, region / level)) * n, 9)
                    if share > 0:
                        best[(region, symbol)] = max(best.get((region, symbol), 0.0), share)
            for (region, symbol), share in best.items():
                yield level, region, symbol, round(share, 6)


class SlidingWindows:
    """``sliding_windows(TABLE(t) PARTITION BY key ORDER BY place, width, stride, column)``: key, start, n and mean of ``column``, for windows
    of ``width`` rows every ``stride``; a key with fewer rows has one window of them all. A null value counts as 0.

    The schema comes from the table's: the key keeps its type. Rows pass one by one and a window that is full is given at
    once, so what is held is the rows that the open windows share, not the key's.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, width: AnalyzeArgument, stride: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("sliding_windows takes a table")
        names = {f.name: f for f in rows.dataType.fields}
        for given in (key, column):
            if given.value not in names:
                raise ValueError(f"the table has no column {given.value}")
        if not (isinstance(width.value, int) and isinstance(stride.value, int) and width.value > 0 and stride.value > 0):
            raise ValueError("width and stride are positive numbers")
        return AnalyzeResult(StructType([StructField(key.value, names[key.value].dataType), StructField("start", LongType()), StructField("n", IntegerType()), StructField("mean", DoubleType())]))

    def __init__(self) -> None:
        self.held: list[float] = []
        self.at = self.start = 0
        self.given = None

    def eval(self, rows: Row, key: str, width: int, stride: int, column: str) -> Iterator[tuple]:
        self.given = rows[key]
        if self.at >= self.start:
            self.held.append(float(rows[column]) if rows[column] is not None else 0.0)
        self.at += 1
        if len(self.held) == width:
            yield rows[key], self.start, width, sum(self.held) / width
            self.start += stride
            self.held = self.held[stride:]

    def terminate(self) -> Iterator[tuple]:
        if self.given and not self.start:
            yield self.given, 0, len(self.held), sum(self.held) / len(self.held)


def average_precision(score: pd.Series, relevant: pd.Series) -> float:
    """The precision at each relevant place in falling order of score, over the relevant ones; for groups that fit in a task."""
    order = np.argsort(-score.to_numpy(dtype=float), kind="stable")
    hits = relevant.to_numpy(dtype=bool)[order]
    if not hits.any():
        return None
    places = np.flatnonzero(hits) + 1
    return float((np.arange(1, len(places) + 1) / places).mean())


def register(spark: SparkSession) -> None:
    """Makes all of them known to ``spark.sql``. Larger groups than a task holds are ranked by ``operators.ranking``."""
    ship_package(spark)
    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("position_histogram", F.udtf(PositionHistogram))
    spark.udtf.register("sliding_windows", F.udtf(SlidingWindows))
    spark.udf.register("average_precision", F.pandas_udf(average_precision, "double"))

