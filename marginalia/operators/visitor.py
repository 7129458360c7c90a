"""Visiting the features of windows: a user's state is stepped through every feature of a window, kept as numbers, and merged.

Points and windows meet by an equality of cells, each task folds what it meets into one state per window, and the states of a
window are merged as they come together, so a crowded window isn't gathered feature by feature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.tables import points_in_boxes
from marginalia.runtime import ship_package


class Visitor(Protocol):
    """``start`` is the state of no features, an array of fixed length; ``step`` takes the features of a window in any order and any
    portions, as one array a column; ``merge`` puts two states of one window together; ``finish`` gives the window's value."""

    def start(self) -> np.ndarray: ...

    def step(self, state: np.ndarray, *columns: np.ndarray) -> np.ndarray: ...

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    def finish(self, state: np.ndarray) -> float: ...


def visited(points: DataFrame, boxes: DataFrame, width: float, height: float, visitor: Visitor, columns: Sequence[str] = (), *, states: int = 10_000) -> DataFrame:
    """box, value: ``visitor`` over the points (pid, px, py and ``columns``) in each window of one size at (box, x, y), edges included.

    Windows without a point have the value of the start state. A task gives its states away when it holds ``states`` of them. Points with a
    null place are in no window; repeated points count each; boxes are told apart by ``box``, which may not be null.
    """
    ship_package(points.sparkSession)
    inside = points_in_boxes(points, boxes, width, height, columns)
    box = inside.schema["box"].dataType.simpleString()
    none = pa.array([visitor.start().tolist()], pa.list_(pa.float64()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([s.tolist() for s in held.values()], pa.list_(pa.float64()))], names=["box", "state"])
            held.clear()
            return out

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            own = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(own, kind="stable")
            values = [batch.column(i).to_numpy(zero_copy_only=False)[order] for i in range(1, batch.num_columns)]
            starts = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(own) else []
            for lo, hi in zip(starts, [*starts[1:], len(own)], strict=False):
                b = own[order][lo].item() if hasattr(own[order][lo], "item") else own[order][lo]
                held[b] = visitor.step(held[b] if b in held else visitor.start(), *(v[lo:hi] for v in values))
            if len(held) >= states:
                yield given()
        if held:
            yield given()

    def merged(batches: Iterator[pa.RecordBatch]) -> pa.Table:
        state, key = None, None
        for batch in batches:
            key = batch.column(0).slice(0, 1) if key is None else key
            for s in batch.column(1).to_pylist():
                state = np.array(s) if state is None else visitor.merge(state, np.array(s))
        return pa.table([key, pa.array([float(visitor.finish(state))])], names=["box", "value"])

    partial = inside.mapInArrow(fold, f"box {box}, state array<double>")
    found = partial.groupBy("box").applyInArrow(lambda table: merged(iter(table.to_batches())), f"box {box}, value double")
    empty = float(visitor.finish(np.array(none[0].as_py())))
    return boxes.select("box").join(found, "box", "left").select("box", F.coalesce("value", F.lit(empty)).alias("value"))


def unit_bag(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Shares of the counts times the weights, of unit length; no counts are zeros."""
    total = counts.sum()
    v = counts / total * weights if total else np.zeros(len(counts))
    size = np.linalg.norm(v)
    return v / size if size else v


class Bag:
    """Counts codes, and tells how far the window's weighed bag is from a learnt one: the squared distance of unit vectors."""

    def __init__(self, weights: np.ndarray, learnt: np.ndarray) -> None:
        self.weights, self.learnt = weights, learnt

    def start(self) -> np.ndarray:
        return np.zeros(len(self.weights))

    def step(self, state: np.ndarray, codes: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """``times``: how many points of the code a row stands for."""
        return state + np.bincount(codes.astype(np.int64), times, minlength=len(state))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def finish(self, state: np.ndarray) -> float:
        return ((self.learnt - unit_bag(state, self.weights)) ** 2).sum()
