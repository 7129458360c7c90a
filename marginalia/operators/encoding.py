"""Encodings of images from their local features: diagonal mixtures, Fisher vectors, spatial pyramids.

An image is a row; its features are one array of the row, so what a task holds is bounded by its batch and one image. Models are arrays of a
size that the caller sets; they go to the tasks whole, and only sums of the models' size come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.alignment import sequences
from marginalia.runtime import materialise, ship_package


def added(rows: DataFrame, of: Callable[[list[pa.Array]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of ``of`` (a batch's columns), an array of ``size`` numbers.

    Each task adds up its own, the tasks' arrays are added by place in Spark, and only ``size`` numbers come to the driver.
    """
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "x"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toLocalIterator():
        out[r.i] = r.x
    return out


@dataclass(frozen=True)
class Mixture:
    """Gaussians with diagonal covariances: priors (k), means and variances (k, d)."""

    priors: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of prior times density, a row per row of ``x``. Written as products, so that no (n, k, d) array is made."""
        inverse = 1 / self.variances
        square = (x * x) @ inverse.T - 2 * x @ (self.means * inverse).T + (self.means**2 * inverse).sum(1)
        return np.log(self.priors) - 0.5 * (square + np.log(2 * np.pi * self.variances).sum(1))

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each component for each row, and each row's log-likelihood."""
        logs = self.logs(x)
        top = logs.max(1, keepdims=True)
        likely = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        return np.exp(logs - likely[:, None]), likely

    @staticmethod
    def joined(parts: Sequence[Mixture]) -> Mixture:
        """One mixture of the components of several, with priors that add up to 1."""
        priors = np.concatenate([p.priors for p in parts])
        return Mixture(priors / priors.sum(), np.concatenate([p.means for p in parts]), np.concatenate([p.variances for p in parts]))


def fit_mixtures(features: DataFrame, bins: int, k: int, *, rounds: int = 30, floor: float = 1e-4, seed: int = 1, tolerance: float = 1e-6) -> tuple[list[Mixture], list[np.ndarray]]:
    """A mixture of ``k`` per bin of ``features`` (bin, v), and the bins' log-likelihoods before each round.

    Starts at ``k`` features of each bin, the first by a hash of their values, with the bin's variances. In each round the tasks add up
    posteriors, first and second moments; all bins go in the same round. Ends after ``rounds`` rounds, or when no bin gains
    more than ``tolerance`` of its likelihood. Variances stay at ``floor`` or above. A bin must have ``k`` different features.
    """
    rows = materialise(features.where("bin IS NOT NULL AND v IS NOT NULL").select(F.col("bin").cast("int").alias("bin"), F.col("v").cast("array<double>").alias("v")), "features")
    picked = []
    for b in range(bins):
        first = rows.where(F.col("bin") == b).select("v").distinct().orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(k).collect()
        if len(first) < k:
            raise ValueError(f"bin {b} has fewer than {k} different features")
        picked.append(np.array([r.v for r in first]))
    d = picked[0].shape[1]

    def matrix(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        return columns[0].to_numpy(), columns[1].flatten().to_numpy().reshape(-1, d)

    def moments(columns: list[pa.Array]) -> np.ndarray:
        which, x = matrix(columns)
        out = np.zeros((bins, 1 + 2 * d))
        np.add.at(out, which, np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1))
        return out.ravel()

    whole = added(rows, moments, bins * (1 + 2 * d)).reshape(bins, -1)
    mean, square = whole[:, 1 : 1 + d] / whole[:, :1], whole[:, 1 + d :] / whole[:, :1]
    parts = [Mixture(np.full(k, 1 / k), picked[b], np.tile(np.maximum(square[b] - mean[b] ** 2, floor), (k, 1))) for b in range(bins)]
    likelihoods: list[np.ndarray] = []
    for _ in range(rounds):
        now = list(parts)

        def expected(columns: list[pa.Array], now: list[Mixture] = now) -> np.ndarray:
            which, x = matrix(columns)
            out = np.zeros((bins, 1 + k * (1 + 2 * d)))
            for b in np.unique(which):
                own = x[which == b]
                p, likely = now[b].posteriors(own)
                out[b] += np.concatenate([[likely.sum()], np.concatenate([p.sum(0)[:, None], p.T @ own, p.T @ (own * own)], axis=1).ravel()])
            return out.ravel()

        sums = added(rows, expected, bins * (1 + k * (1 + 2 * d))).reshape(bins, -1)
        likelihoods.append(sums[:, 0])
        for b in range(bins):
            s = sums[b, 1:].reshape(k, -1)
            n = np.maximum(s[:, :1], 1e-12)
            m = s[:, 1 : 1 + d] / n
            parts[b] = Mixture(np.maximum(s[:, 0], 1e-12) / s[:, 0].sum(), m, np.maximum(s[:, 1 + d :] / n - m * m, floor))
        if len(likelihoods) > 1 and (likelihoods[-1] - likelihoods[-2] <= tolerance * np.abs(likelihoods[-2])).all():
            break
    return parts, likelihoods


def fisher(x: np.ndarray, mixture: Mixture) -> np.ndarray:
    """The improved Fisher vector of an image's features (n, d): first-order gradients by component, then second-order ones, over the
    number of features, with signed square roots, of unit length. An image without features has zeros."""
    k, d = mixture.means.shape
    if not len(x):
        return np.zeros(2 * k * d)
    p, _ = mixture.posteriors(x)
    n, s1, s2 = p.sum(0)[:, None], p.T @ x, p.T @ (x * x)
    deviation = np.sqrt(mixture.variances)
    first = (s1 - n * mixture.means) / deviation / (len(x) * np.sqrt(mixture.priors))[:, None]
    second = ((s2 - 2 * mixture.means * s1 + mixture.means**2 * n) / mixture.variances - n) / (len(x) * np.sqrt(2 * mixture.priors))[:, None]
    v = np.concatenate([first.ravel(), second.ravel()])
    v = np.sign(v) * np.sqrt(np.abs(v))
    size = np.linalg.norm(v)
    return v / size if size else v


def fisher_vectors(images: DataFrame, mixture: Mixture, id_col: str = "item", features: str = "features") -> DataFrame:
    """``id_col`` and fisher of each image, whose features are one array of arrays; null counts as none."""
    return _encoded(images, id_col, features, "array<array<double>>", sequences, lambda x: fisher(x, mixture), "fisher")


def _encoded(images: DataFrame, id_col: str, column: str, cast: str, unpack: Callable, encode: Callable, name: str) -> DataFrame:
    ship_package(images.sparkSession)
    rows = images.select(id_col, images[column].cast(cast).alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(x).tolist() for x in unpack(batch.column(1))], pa.list_(pa.float64()))], names=[id_col, name])

    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {name} array<double>")


class Area:
    """Summed areas of a grid of codes: how often each code stands in a rectangle, by four look-ups."""

    def __init__(self, codes: np.ndarray, n_codes: int) -> None:
        """``codes``: (width, height) of code numbers; others than 0 to n_codes - 1 count as no code."""
        self.shape = codes.shape
        self.sums = np.zeros((codes.shape[0] + 1, codes.shape[1] + 1, n_codes))
        self.sums[1:, 1:] = (codes[..., None] == np.arange(n_codes)).cumsum(0).cumsum(1)

    def counts(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
        """A row per rectangle from (x0, y0) to before (x1, y1); cut at the grid, empty ones have zeros."""
        x0, x1 = (np.clip(x, 0, self.shape[0]) for x in (x0, x1))
        y0, y1 = (np.clip(y, 0, self.shape[1]) for y in (y0, y1))
        x1, y1 = np.maximum(x0, x1), np.maximum(y0, y1)
        return self.sums[x1, y1] - self.sums[x0, y1] - self.sums[x1, y0] + self.sums[x0, y0]


def compensations(levels: Sequence[tuple[int, int]]) -> list[int]:
    """What each level's counts are multiplied by: the parts of the first level, times how many times more parts across and down each
    further level has than the one before, in whole numbers."""
    out = [levels[0][0] * levels[0][1]]
    for (a, b), (c, d) in zip(levels, levels[1:], strict=False):
        out.append(out[-1] * (c // a) * (d // b))
    return out


def pyramid(area: Area, windows: np.ndarray, levels: Sequence[tuple[int, int]], skip: int) -> np.ndarray:
    """Pooled codes of each window (x, y, w, h in places; a code stands for ``skip`` by ``skip`` of them): level by level, the
    parts across, in each the parts down, in each the codes' counts, with the level's compensation."""
    x, y, w, h = (windows[:, i].astype(np.float64) for i in range(4))
    cell = lambda place: np.trunc(np.trunc(place) / skip).astype(np.int64)
    out = []
    for (across, down), weight in zip(levels, compensations(levels), strict=True):
        for i in range(across):
            for j in range(down):
                out.append(weight * area.counts(cell(x + i * (w / across)), cell(y + j * (h / down)), cell(x + (i + 1) * (w / across)), cell(y + (j + 1) * (h / down))))
    return np.stack(out, axis=1).reshape(len(windows), -1)


def power_unit(v: np.ndarray, a: float = 0.35) -> np.ndarray:
    """Rows with signed powers, of unit length; zero rows stay."""
    v = np.sign(v) * np.abs(v) ** a
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def pyramids(images: DataFrame, n_codes: int, levels: Sequence[tuple[int, int]], skip: int, windows: Callable[[int, int], np.ndarray], id_col: str = "item", grid: str = "grid", *, normalised: bool = True) -> DataFrame:
    """``id_col``, window, pooled of every window of every image, whose codes are an array (x) of arrays (y).

    ``windows`` gives rows (x, y, w, h) for a width and height in places; window is the row's number. The area sums of an image are
    made once for all its windows. Null or empty grids have no windows.
    """
    ship_package(images.sparkSession)
    rows = images.select(id_col, images[grid].cast("array<array<int>>").alias("__g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, codes in enumerate(sequences(batch.column(1))):
                if not codes.size:
                    continue
                at = np.asarray(windows(codes.shape[0] * skip, codes.shape[1] * skip)).reshape(-1, 4)
                v = pyramid(Area(codes, n_codes), at, levels, skip)
                v = power_unit(v) if normalised else v
                ids = batch.column(0).take(pa.array([i] * len(at), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(at)), pa.int32()), pa.array(list(v), pa.list_(pa.float64()))], names=[id_col, "window", "pooled"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, window int, pooled array<double>")


def scan_widths(width: int, stride: int) -> Callable[[int, int], np.ndarray]:
    """Windows as high as the image around centres ``stride`` apart, of 1.2, 1 and 0.8 times ``width``; an image too narrow for one has
    a single centre, its middle."""

    def of(w: int, h: int) -> np.ndarray:
        sizes = [int(width * 1.2), width, int(width * 0.8)]
        centres = list(range(sizes[2] // 3, w - sizes[2] // 3, stride)) or [w // 2]
        return np.array([(x - s // 2, 0, s, h) for x in centres for s in sizes])

    return of
