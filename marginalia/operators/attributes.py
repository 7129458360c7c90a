"""Attribute models: bagged linear classifiers with the regularisation of the best validation precision, and out-of-bag scores.

All attributes, bags and regularisations are columns of one weight matrix, so that a pass over the rows serves them all: a task
multiplies its rows with the matrix and adds up the gradient. Only the matrix and its gradient are on the driver; more attributes than
it should hold are fitted in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.encoding import added
from marginalia.operators.ranking import sorted_ap
from marginalia.runtime import materialise, ship_package

PARTS = 5
BIAS = 0.1
LAMBDAS = (1e-3, 1e-4, 1e-5)
#: Rows times columns of a product in a task.
CELLS = 1 << 21


@dataclass(frozen=True)
class Rows:
    """A batch: features with the constant ``BIAS`` as the last, attributes as -1 and 1, and each shuffle's part of a row."""

    x: np.ndarray
    y: np.ndarray
    part: np.ndarray

    @staticmethod
    def of(columns: list[pa.Array]) -> Rows:
        n = len(columns[0])
        x, y, part = (c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) for c in columns[:3])
        return Rows(np.concatenate([x, np.full((n, 1), BIAS)], axis=1), 2 * y - 1, part)

    def trains(self) -> np.ndarray:
        """(rows, bags): bag b of a shuffle leaves out the rows of part b."""
        return (self.part[:, :, None] != np.arange(PARTS)).reshape(len(self.x), -1).astype(np.float64)

    def pieces(self, width: int) -> Iterator[Rows]:
        step = max(1, CELLS // width)
        for at in range(0, len(self.x), step):
            yield Rows(self.x[at : at + step], self.y[at : at + step], self.part[at : at + step])


def gradient(rows: Rows, weights: np.ndarray) -> np.ndarray:
    """Sums of loss and gradient of the squared hinge; ``weights`` is (d, attributes, bags, lambdas)."""
    d, a, b, k = weights.shape
    loss, slope = np.zeros((a, b, k)), np.zeros_like(weights)
    for piece in rows.pieces(a * b * k):
        miss = np.maximum(0.0, 1 - piece.y[:, :, None, None] * np.tensordot(piece.x, weights, 1)) * piece.trains()[:, None, :, None]
        loss += (miss * miss).sum(0)
        slope += np.tensordot(piece.x.T, -2 * miss * piece.y[:, :, None, None], 1)
    return np.concatenate([loss.ravel(), slope.ravel()])


def prepared(rows: DataFrame, id_col: str, features: str, attributes: str, shuffles: int) -> DataFrame:
    """x, y, part and id. A row's parts are drawn from hashes of its id, so reruns and lost tasks agree."""
    part = F.array(*[F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(p)), F.lit(PARTS)).cast("double") for p in range(shuffles)])
    return materialise(rows.where(f"{features} IS NOT NULL AND {attributes} IS NOT NULL").select(F.col(features).cast("array<double>").alias("x"), F.col(attributes).cast("array<double>").alias("y"), part.alias("part"), F.col(id_col).alias("id")), "attribute-rows")


def fit(ready: DataFrame, shuffles: int, lambdas: Sequence[float] = LAMBDAS, rounds: int = 40) -> np.ndarray:
    """(d, attributes, bags, lambdas): minimisers of lambda / 2 |w|^2 plus the mean squared hinge over the bag's rows, by accelerated
    gradients. An attribute with fewer than two rows on either side has zeros."""
    one = ready.select(F.size("x").alias("d"), F.size("y").alias("a")).first()
    if one is None:
        raise ValueError("no rows to learn from")
    d, a, b, k = one.d + 1, one.a, shuffles * PARTS, len(lambdas)
    data = ready.select("x", "y", "part")

    def first(columns: list[pa.Array]) -> np.ndarray:
        r = Rows.of(columns)
        return np.concatenate([r.trains().sum(0), (r.y > 0).sum(0), [len(r.x)], (r.x.T @ r.x).ravel()])

    sums = added(data, first, b + a + 1 + d * d)
    n, positive, total = np.maximum(sums[:b], 1)[None, :, None], sums[b : b + a], sums[b + a]
    known = ((positive >= 2) & (total - positive >= 2))[:, None, None]
    square = sums[b + a + 1 :].reshape(d, d)
    scale = np.sqrt(np.maximum(np.diag(square) / max(total, 1), 1e-12))  # steps are taken as if all features were of one size
    own = np.asarray(lambdas) / (scale**2)[:, None, None, None]
    steep = 2 * np.linalg.eigvalsh(square / np.outer(scale, scale))[-1] / n + own.max(0)
    scale = scale[:, None, None, None]
    u = np.zeros((d, a, b, k))
    ahead, speed = u, 1.0
    for _ in range(rounds):
        at = ahead / scale
        slope = added(data, lambda columns, at=at: gradient(Rows.of(columns), at), a * b * k * (1 + d))[a * b * k :].reshape(u.shape) / scale / n + own * ahead
        step = np.where(known, ahead - slope / steep, 0.0)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        ahead, u, speed = step + (speed - 1) / faster * (step - u), step, faster
    return u / scale


def held_out_scores(ready: DataFrame, weights: np.ndarray, shuffles: int) -> DataFrame:
    """id, attribute, bag, setting, score, relevant: every row by the models of the bags that left it out, one bag a shuffle."""
    ship_package(ready.sparkSession)
    d, a, b, k = weights.shape
    kind = ready.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for r in Rows.of(batch.columns[:3]).pieces(a * k * shuffles * d):
                n = len(r.x)
                bag = (r.part + PARTS * np.arange(shuffles)).astype(np.int64)
                s = np.einsum("nd,danpk->npak", r.x, weights[:, :, bag].reshape(d, a, n, shuffles, k), optimize=True)
                place = np.indices(s.shape)
                ids = batch.column(3).slice(done, n).take(pa.array(place[0].ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(place[2].ravel(), pa.int32()), pa.array(np.broadcast_to(bag[:, :, None, None], s.shape).ravel(), pa.int32()), pa.array(place[3].ravel(), pa.int32()), pa.array(np.round(s, 9).ravel()), pa.array(np.broadcast_to(r.y[:, None, :, None] > 0, s.shape).ravel())], names=["id", "attribute", "bag", "setting", "score", "relevant"])
                done += n

    return ready.select("x", "y", "part", "id").mapInArrow(run, f"id {kind}, attribute int, bag int, setting int, score double, relevant boolean")


def selected(scores: DataFrame) -> DataFrame:
    """attribute, bag, setting, ap: the setting of the best average precision over the rows that the bag left out, the first of equals.
    A bag without a relevant row left out takes the first setting."""
    by = ("attribute", "bag", "setting")
    each = scores.select(*by).distinct().join(sorted_ap(scores.withColumnRenamed("id", "item"), by), list(by), "left")
    best = each.groupBy("attribute", "bag").agg(F.max(F.struct(F.round(F.coalesce("ap", F.lit(0.0)), 9).alias("ap"), (-F.col("setting")).alias("s"))).alias("b"))
    return best.select("attribute", "bag", (-F.col("b.s")).alias("setting"), F.col("b.ap").alias("ap"))


def bagged(rows: DataFrame, id_col: str, features: str, attributes: str, *, shuffles: int = 2, lambdas: Sequence[float] = LAMBDAS, rounds: int = 40) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Weights (d, attributes), the last row for the constant, averaged over ``shuffles`` times five bags, each with its best
    regularisation; the choices (attribute, bag, setting, ap); and the out-of-bag scores (id, attribute, score), averaged per row.

    Rows with null features or attributes are left out; ids that repeat are in the same bags, and their scores are averaged together.
    """
    ready = prepared(rows, id_col, features, attributes, shuffles)
    w = fit(ready, shuffles, lambdas, rounds)
    scores = materialise(held_out_scores(ready, w, shuffles), "held-out")
    choice = materialise(selected(scores), "choices")
    index = np.zeros(w.shape[1:3], dtype=np.int64)
    for r in choice.toLocalIterator():
        index[r.attribute, r.bag] = r.setting
    mean = np.take_along_axis(w, index[None, :, :, None], 3)[..., 0].mean(2)
    own = scores.join(F.broadcast(choice.select("attribute", "bag", "setting")), ["attribute", "bag", "setting"])
    return mean, choice, own.groupBy("id", "attribute").agg(F.avg("score").alias("score"))
