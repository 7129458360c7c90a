"""Alignment of two sequences of feature columns by dynamic programming, and what is searched with it.

A pair of sequences is a row; rows are independent, so Spark deals them and a task holds a chunk of pairs of bounded size. The
programme runs over anti-diagonals, for all pairs of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from marginalia.runtime import ship_package

#: Cells of the padded matrices of a chunk of pairs; a larger pair comes alone.
CELLS = 1 << 21
DIAGONAL, DOWN, RIGHT = 0, 1, 2


def sequences(column: pa.Array) -> list[np.ndarray]:
    """Arrays (length, width) of a list of lists of numbers; a null is empty."""
    outer, out = column.offsets.to_numpy(), []
    inner = column.values
    bounds, flat = inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        lo, hi = (outer[i], outer[i + 1]) if column[i].is_valid else (0, 0)
        out.append(flat[bounds[lo] : bounds[hi]].reshape(hi - lo, -1) if hi > lo else np.zeros((0, 0)))
    return out


def distances(a: list[np.ndarray], b: list[np.ndarray], radius: int, outside: float) -> np.ndarray:
    """Squared distances of all columns of each pair, padded with infinity; cells farther than ``radius`` columns off the straight line
    from corner to corner cost ``outside`` more."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    d = np.full((len(a), int(n.max()), int(m.max())), np.inf)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        own = np.round(((x[:, None] - y[None]) ** 2).sum(2), 9)
        off = np.abs(np.arange(len(x))[:, None] * len(y) - np.arange(len(y))[None] * len(x)) > radius * len(y)
        d[k, : len(x), : len(y)] = own + outside * off
    return d


def programme(d: np.ndarray, slanted: float, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Costs of the best paths from the first cell to every cell, and the moves that led there; a move that isn't diagonal costs
    ``slanted`` more. Ties: diagonal, then down (a goes on), then right (b goes on)."""
    k, n, m = d.shape
    cost = np.full((k, n + 1, m + 1), np.inf)
    cost[:, 0, 0] = 0.0
    moves = np.zeros((k, n, m), dtype=np.int8) if back else None
    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n, s + 1))
        j = s - i
        steps = np.stack([cost[:, i, j], cost[:, i, j + 1] + slanted, cost[:, i + 1, j] + slanted])
        if s == 0:
            steps[1:] = np.inf
        cost[:, i + 1, j + 1] = d[:, i, j] + steps.min(0)
        if s == 0:
            cost[:, 0, 0] = np.inf
        if back:
            moves[:, i, j] = steps.argmin(0)
    return cost[:, 1:, 1:], moves


def path_of(moves: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    out = [(i, j)]
    while i or j:
        move = moves[i, j]
        i, j = i - (move != RIGHT), j - (move != DOWN)
        out.append((int(i), int(j)))
    return out[::-1]


def align(pairs: DataFrame, a: str = "a", b: str = "b", *, radius: int = 100, outside: float = 100.0, slanted: float = 0.0, path: bool = False) -> DataFrame:
    """``pairs`` with cost, and with path if asked, instead of the two sequences.

    path is an array of (i, j), from the first columns to the last. A pair with an empty or null sequence has a null cost. The costs are
    those of the columns met, plus ``outside`` for each beyond the band of ``radius`` and ``slanted`` for each move that isn't diagonal.
    """
    ship_package(pairs.sparkSession)
    keep = [c for c in pairs.columns if c not in (a, b)]
    rows = pairs.select(*keep, pairs[a].cast("array<array<double>>").alias("__a"), pairs[b].cast("array<array<double>>").alias("__b"))
    step = ArrayType(StructType([StructField("i", LongType()), StructField("j", LongType())]))
    schema = StructType([*(pairs.schema[c] for c in keep), StructField("cost", DoubleType()), *([StructField("path", step)] if path else [])])
    arrow = to_arrow_schema(schema)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = sequences(batch.column(width)), sequences(batch.column(width + 1))
            at = 0
            while at < len(xs):
                to, n, m = at, 1, 1
                while to < len(xs) and (to == at or (to + 1 - at) * max(n, len(xs[to])) * max(m, len(ys[to])) <= CELLS):
                    n, m, to = max(n, len(xs[to])), max(m, len(ys[to])), to + 1
                full = [k for k in range(at, to) if len(xs[k]) and len(ys[k])]
                costs, paths = [None] * (to - at), [None] * (to - at)
                if full:
                    best, moves = programme(distances([xs[k] for k in full], [ys[k] for k in full], radius, outside), slanted, path)
                    for f, k in enumerate(full):
                        i, j = len(xs[k]) - 1, len(ys[k]) - 1
                        costs[k - at] = float(best[f, i, j])
                        if path:
                            paths[k - at] = [{"i": p, "j": q} for p, q in path_of(moves[f], i, j)]
                cols = [batch.column(c).slice(at, to - at).cast(arrow.field(c).type) for c in range(width)]
                extra = [pa.array(costs, pa.float64()), *([pa.array(paths, arrow.field(width + 1).type)] if path else [])]
                yield pa.RecordBatch.from_arrays([*cols, *extra], schema=arrow)
                at = to

    return rows.mapInArrow(run, schema)


def portion(place: Column, letters: Column, length: Column, columns: Column, scale: float, shift: Column | float = 0.0) -> tuple[Column, Column]:
    """First column and the one after the last of the part of an image where an n-gram is expected: ``scale`` times as wide as its
    share of the word, around its place (from 1), moved by ``shift`` times that share, cut at the image."""
    share = length / (0.5 + letters)
    start = (place - 1) / (0.5 + letters) - share * (scale - 1) / 2 + share * shift
    return F.greatest(F.lit(0), F.floor(F.round(start * columns, 9))).cast("int"), F.least(columns, F.floor(F.round((start + scale * share) * columns, 9))).cast("int")


def scans(steps: int, step: float) -> list[float]:
    """0, step, -step, 2 * step, ..: the order in which an exemplar is moved along a word."""
    return [0.0, *(round(sign * k * step, 9) for k in range(1, steps + 1) for sign in (1, -1))]


def best_scan(costs: DataFrame, by: tuple[str, ...], order: str = "turn") -> DataFrame:
    """``by`` with the scan of the least cost, the first of equals."""
    best = costs.where("cost IS NOT NULL").groupBy(*by).agg(F.min(F.struct("cost", order, "scan")).alias("b"))
    return best.select(*by, F.col("b.scan").alias("scan"), F.col("b.cost").alias("cost"))


def best_triple(costs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Windows of three sequences that are most alike, from costs (``by``, other, w1, w2, cost) of the first's windows with the second's
    (other 2) and with the third's (other 3): ``by``, w1, w2, w3, cost. Both partners are aligned to the first only, so for a
    window of the first each partner's best window is found by itself, and not all triples are formed. Ties: the first windows."""
    side = costs.where("cost IS NOT NULL").groupBy(*by, "w1", "other").agg(F.min(F.struct("cost", "w2")).alias("b"))
    both = side.groupBy(*by, "w1").agg(F.max(F.when(F.col("other") == 2, F.col("b"))).alias("x"), F.max(F.when(F.col("other") == 3, F.col("b"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    best = both.groupBy(*by).agg(F.min(F.struct(F.round(F.col("x.cost") + F.col("y.cost"), 6).alias("cost"), "w1", F.col("x.w2").alias("w2"), F.col("y.w2").alias("w3"))).alias("t"))
    return best.select(*by, "t.w1", "t.w2", "t.w3", "t.cost")
