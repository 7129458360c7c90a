"""Common subspaces of two kinds of vectors: random Fourier features, correlation analysis, and settings chosen by retrieval.

The sums of products over the rows are taken once for all settings: fewer features are a part of more, so every setting's covariances are
blocks of the same matrices. They and the projections are of the settings' size, not the data's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import blocks
from marginalia.operators.encoding import added
from marginalia.operators.strips import unit
from marginalia.runtime import materialise


@dataclass(frozen=True)
class Fourier:
    """Random directions (m, d); features are cosines and sines of the products, over the root of their number."""

    directions: np.ndarray

    @staticmethod
    def draw(m: int, d: int, width: float, seed: int) -> Fourier:
        return Fourier(np.random.default_rng(seed).normal(0, 1 / width, (m, d)))

    def of(self, x: np.ndarray, m: int | None = None) -> np.ndarray:
        p = x @ self.directions[:m].T
        return np.concatenate([np.cos(p), np.sin(p)], axis=1) / np.sqrt(p.shape[1])


@dataclass(frozen=True)
class Setting:
    width: float
    m: int
    reg: float
    k: int


def correlated(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, reg: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections of both sides on their ``k`` most correlated directions, and the correlations: a generalised eigenproblem of
    covariances with ``reg`` added to the diagonals, solved by whitening. Signs: a direction's largest weight is positive."""
    def whitener(c: np.ndarray) -> np.ndarray:
        return np.linalg.inv(np.linalg.cholesky(c + reg * np.eye(len(c)))).T

    a, b = whitener(xx), whitener(yy)
    u, s, vt = np.linalg.svd(a.T @ xy @ b)
    wx, wy = a @ u[:, :k], b @ vt.T[:, :k]
    sign = np.sign(wx[np.abs(wx).argmax(0), np.arange(wx.shape[1])])
    return wx * sign, wy * sign, s[:k]


@dataclass(frozen=True)
class Subspace:
    """One setting's maps for images and texts into the common space; both give unit vectors."""

    images: Fourier
    texts: Fourier
    image_mean: np.ndarray
    text_mean: np.ndarray
    wx: np.ndarray
    wy: np.ndarray
    m: int

    def image(self, x: np.ndarray) -> np.ndarray:
        return unit((self.images.of(x, self.m) - self.image_mean) @ self.wx)

    def text(self, y: np.ndarray) -> np.ndarray:
        return unit((self.texts.of(y, self.m) - self.text_mean) @ self.wy)


def pair(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    n = len(columns[0])
    return tuple(c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) for c in columns[:2])


def learn(rows: DataFrame, x: str, y: str, widths: Sequence[float], ms: Sequence[int], regs: Sequence[float], ks: Sequence[int], seed: int = 0) -> dict[Setting, Subspace]:
    """A subspace for each setting, from one pass over (x, y): both sides' features of all widths and of the largest ``ms``, their sums
    and products. Rows with a null side are left out."""
    data = rows.where(f"{x} IS NOT NULL AND {y} IS NOT NULL").select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"))
    one = data.select(F.size("x").alias("dx"), F.size("y").alias("dy")).first()
    if one is None:
        raise ValueError("no rows to learn from")
    top = max(ms)
    maps = {w: (Fourier.draw(top, one.dx, w, seed), Fourier.draw(top, one.dy, w, seed + 1)) for w in widths}
    size = 4 * top  # cosines and sines of both sides

    def sums(columns: list[pa.Array]) -> np.ndarray:
        a, b = pair(columns)
        out = [np.array([len(a)], dtype=np.float64)]
        for images, texts in maps.values():
            z = np.concatenate([images.of(a), texts.of(b)], axis=1)
            out += [z.sum(0), (z.T @ z).ravel()]
        return np.concatenate(out)

    got = added(data, sums, 1 + len(widths) * (size + size * size))
    n, at, found = got[0], 1, {}
    for w in widths:
        mean = got[at : at + size] / n
        c = got[at + size : at + size + size * size].reshape(size, size) / n - np.outer(mean, mean)
        at += size + size * size
        for m in ms:
            # the first m cosines and the first m sines, as scaled for m of them
            own = np.concatenate([np.arange(m), top + np.arange(m)])
            other, scale = 2 * top + own, top / m
            for reg in regs:
                wx, wy, _ = correlated(scale * c[np.ix_(own, own)], scale * c[np.ix_(own, other)], scale * c[np.ix_(other, other)], reg, max(ks))
                for k in ks:
                    found[Setting(w, m, reg, k)] = Subspace(*maps[w], np.sqrt(scale) * mean[own], np.sqrt(scale) * mean[other], wx[:, :k], wy[:, :k], m)
    return found


def chosen(train: DataFrame, valid: DataFrame, id_col: str, x: str, y: str, label: str, *, widths: Sequence[float], ms: Sequence[int], regs: Sequence[float], ks: Sequence[int], queries: int = 100, texts: int = 1000) -> tuple[Subspace, DataFrame]:
    """The subspace of the best mean precision by example plus that by text over ``valid``, and all settings' values.

    Examples are the ``queries`` rows of ``valid`` first by a hash of their id, texts one a label (at most ``texts``, as a text's vector is
    the same for all rows of a label); each is asked of all rows of ``valid``. All settings go through one plan, and no score is a row. Ties: the first setting.
    """
    spaces = learn(train, x, y, widths, ms, regs, ks)
    order = [Setting(*s) for s in product(widths, ms, regs, ks)]
    valid = materialise(valid.where(f"{x} IS NOT NULL"), "validation")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    shown = valid.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(queries).select(F.col(id_col).alias("query"), name(label).alias("qlabel"), F.col(x).cast("array<double>").alias("qv"))
    spelt = valid.where(f"{y} IS NOT NULL").groupBy(label).agg(F.min(F.col(y).cast("array<double>")).alias("qv")).orderBy(label).limit(texts).select(name(label).alias("query"), name(label).alias("qlabel"), "qv")
    items = valid.select(F.col(id_col).alias("item"), name(label).alias("label"), F.col(x).cast("array<double>").alias("v"))
    width, tried = items.agg(F.max(F.size("v"))).first()[0] or 1, [spaces[s] for s in order]

    def precisions(kind: int, asked: DataFrame) -> DataFrame:
        def scored(block: blocks.Asked, v: np.ndarray) -> Callable[[int, int], Iterator[np.ndarray]]:
            if "sides" not in block.extra:
                block.extra["sides"] = [(s.text if kind else s.image)(block.matrices[0]) for s in tried]
            every = [s.image(v) for s in tried]
            return lambda lo, hi: (side[lo:hi] @ own.T for side, own in zip(block.extra["sides"], every, strict=True))

        found = blocks.ranked(asked, items, blocks.mid_tie, "n_relevant long, ap double", scored=scored, sets=len(tried), itself=bool(kind), width=width)
        return found.select(F.col("blend").alias("setting"), F.lit(kind).alias("kind"), "ap")

    ap = precisions(0, shown).unionByName(precisions(1, spelt)).groupBy("setting", "kind").agg(F.avg("ap").alias("ap"))
    value = ap.groupBy("setting").agg(F.max(F.when(F.col("kind") == 0, F.col("ap"))).alias("by_example"), F.max(F.when(F.col("kind") == 1, F.col("ap"))).alias("by_text"))
    names = train.sparkSession.createDataFrame([(i, s.width, s.m, s.reg, s.k) for i, s in enumerate(order)], "setting int, width double, m int, reg double, k int")
    table = materialise(names.join(value, "setting").withColumn("value", F.round(F.coalesce("by_example", F.lit(0.0)) + F.coalesce("by_text", F.lit(0.0)), 9)), "settings")
    best = table.orderBy(F.desc("value"), "setting").first()
    return spaces[order[best.setting]], table
