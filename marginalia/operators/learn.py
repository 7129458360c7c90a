"""Models over feature arrays: ``pyspark.ml`` where it has them, Gramians by aggregation and small solves on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.vectors import dot, doubles
from marginalia.operators import blocks
from marginalia.runtime import ship_package


def with_vector(rows: DataFrame, column: str, name: str = "features") -> DataFrame:
    return rows.withColumn(name, array_to_vector(F.col(column).cast("array<double>")))


def kmeans(rows: DataFrame, column: str, k: int, seed: int = 1):
    return KMeans(k=k, seed=seed, initMode="k-means||", featuresCol="features").fit(with_vector(rows, column))


def rescued(centers: DataFrame, assigned: DataFrame, column: str) -> DataFrame:
    """(code, center), (code, vector) -> code, center: every codeword at the mean of its members; one without members keeps its place."""
    each = assigned.select("code", F.posexplode(F.col(column).cast("array<double>")).alias("i", "x")).groupBy("code", "i").agg(F.avg("x").alias("x"))
    means = each.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("code", F.transform("s", lambda s: s["x"]).alias("mean"))
    return centers.join(means, "code", "left").select("code", F.coalesce("mean", doubles(F.col("center"))).alias("center"))


def pca(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The rows with projected, their first k principal coordinates."""
    v = with_vector(rows, column)
    return PCA(k=k, inputCol="features", outputCol="p").fit(v).transform(v).withColumn("projected", vector_to_array("p")).drop("p", "features")


def gaussian_mixtures(rows: DataFrame, column: str, k: int, seed: int = 1):
    return GaussianMixture(k=k, seed=seed, featuresCol="features", maxIter=20).fit(with_vector(rows, column))


def svm_bags(rows: DataFrame, column: str, label: str, *, bags: int = 10, reg: float = 1e-3) -> DataFrame:
    """attribute, weights, bias, n_bags: for every value of ``label`` a linear SVM against the rest, averaged over bags.

    A bag holds the rows whose hash with its number isn't 0 modulo 5, so runs agree. Values with fewer than two rows on
    either side are skipped. Attributes are values of a label and so few; each fit is distributed.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    v, total, out = with_vector(rows, column).cache(), sum(counts.values()), []
    for a in sorted(counts):
        if counts[a] < 2 or total - counts[a] < 2:
            continue
        marked = v.withColumn("y", (F.col(label) == a).cast("double"))
        fits = [LinearSVC(labelCol="y", regParam=reg, maxIter=10).fit(marked.where(F.pmod(F.xxhash64(F.col(column), F.lit(b)), F.lit(5)) != 0)) for b in range(bags)]
        out.append((int(a), np.mean([f.coefficients.toArray() for f in fits], axis=0).tolist(), float(np.mean([f.intercept for f in fits])), bags))
    v.unpersist()
    return rows.sparkSession.createDataFrame(out, "attribute int, weights array<double>, bias double, n_bags int")


def platt(scored: DataFrame, score: str, label: str) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(a * score + b))."""
    m = LogisticRegression(labelCol="y", featuresCol="f", maxIter=50).fit(scored.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("f"), F.col(label).cast("double").alias("y")))
    return -float(m.coefficients[0]), -float(m.intercept)


def gramian(rows: DataFrame, x: str, y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """X'X, X'Y, Y'Y, the columns' sums and the number of rows; each task adds its own up, and d * d numbers a task come back."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums, n = None, None, 0
        for b in batches:
            if len(b):
                z = np.concatenate([np.stack(b["x"].to_numpy()), np.stack(b["y"].to_numpy())], axis=1).astype(np.float64)
                total, sums, n = (z.T @ z if total is None else total + z.T @ z), (z.sum(0) if sums is None else sums + z.sum(0)), n + len(z)
        if n:
            yield pd.DataFrame({"g": [total.ravel().tolist()], "s": [sums.tolist()], "n": [n]})

    first = rows.select(F.size(x).alias("dx"), F.size(y).alias("dy")).first()
    parts = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).mapInPandas(run, "g array<double>, s array<double>, n long")
    each = lambda c: parts.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
    d = first.dx + first.dy
    g, s, n = each("g").reshape(d, d), each("s"), parts.agg(F.sum("n")).first()[0]
    return g[: first.dx, : first.dx], g[: first.dx, first.dx :], g[first.dx :, first.dx :], s[: first.dx], s[first.dx :], n


def ridge(rows: DataFrame, x: str, y: str, lam: float) -> np.ndarray:
    xx, xy, *_ = gramian(rows, x, y)
    return np.linalg.solve(xx + lam * np.eye(len(xx)), xy)


def cca(rows: DataFrame, x: str, y: str, k: int, reg: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections of both sides and their correlations, largest first, from the covariances."""
    xx, xy, yy, sx, sy, n = gramian(rows, x, y)
    xx, yy, xy = xx / n - np.outer(sx, sx) / n**2 + reg * np.eye(len(xx)), yy / n - np.outer(sy, sy) / n**2 + reg * np.eye(len(yy)), xy / n - np.outer(sx, sy) / n**2
    root = lambda m: (lambda w, v: v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-12))) @ v.T)(*np.linalg.eigh(m))
    u, s, vt = np.linalg.svd(root(xx) @ xy @ root(yy))
    return root(xx) @ u[:, :k], root(yy) @ vt.T[:, :k], s[:k]


def random_features(rows: DataFrame, column: str, m: int, gamma: float = 1.0, seed: int = 1) -> DataFrame:
    """The rows with fourier: cos and sin of m fixed random projections, over the square root of m."""
    ship_package(rows.sparkSession)
    d = rows.select(F.size(column)).first()[0]
    w = np.random.default_rng(seed).normal(0, np.sqrt(2 * gamma), (d, m))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            p = np.stack(b.to_numpy()).astype(np.float64) @ w if len(b) else np.zeros((0, m))
            yield pd.Series(list(np.concatenate([np.cos(p), np.sin(p)], axis=1) / np.sqrt(m)))

    return rows.withColumn("fourier", F.pandas_udf(run, "array<double>")(F.col(column)))


def lsh_neighbours(rows: DataFrame, queries: DataFrame, id_col: str, column: str, k: int, *, tables: int = 24, width: float = 0.8, seed: int = 7) -> DataFrame:
    """query, item, d: the k nearest rows that share a random-projection bucket with the query, distances exact."""
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", numHashTables=tables, bucketLength=width, seed=seed).fit(with_vector(rows, column))
    hashed = lambda r: model.transform(with_vector(r, column)).select(id_col, column, F.transform("h", lambda h: vector_to_array(h)[0]).alias("h"))
    asked = hashed(queries).select(F.col(id_col).alias("query"), F.col(column).alias("qv"), F.col("h").alias("qbuckets"))
    near = blocks.sharing(asked, hashed(rows).select(F.col(id_col).alias("item"), F.col(column).alias("v"), F.col("h").alias("buckets")), k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "item"))
    return near.withColumn("rn", rank).where(F.col("rn") <= k).drop("rn")


def self_organising_map(rows: DataFrame, column: str, side: int, *, epochs: int = 8, seed: int = 1) -> np.ndarray:
    """side * side nodes by batch training: every epoch each row votes for its nearest node, and nodes move to the votes'
    mean weighed by a neighbourhood that shrinks as exp(-10 (t / epochs) ** 2). Only sums by node come to the driver."""
    ship_package(rows.sparkSession)
    d = rows.select(F.size(column)).first()[0]
    nodes = np.random.default_rng(seed).normal(0, 0.1, (side * side, d))
    place = np.stack(np.divmod(np.arange(side * side), side), axis=1)
    gap = ((place[:, None] - place[None]) ** 2).sum(2)
    for t in range(epochs):
        now = nodes.copy()

        def run(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            sums, n = np.zeros_like(now), np.zeros(len(now))
            for b in batches:
                if len(b):
                    x = np.stack(b["v"].to_numpy()).astype(np.float64)
                    best = (-2 * x @ now.T + (now**2).sum(1)).argmin(1)
                    np.add.at(sums, best, x)
                    n += np.bincount(best, minlength=len(now))
            yield pd.DataFrame({"node": np.arange(len(now)), "n": n, "s": sums.tolist()})

        parts = rows.select(F.col(column).alias("v")).mapInPandas(run, "node int, n double, s array<double>")
        got = parts.select("node", "n", F.posexplode("s").alias("i", "x")).groupBy("node", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("node", "i").toPandas()
        sums, n = got["x"].to_numpy().reshape(len(nodes), d), got["n"].to_numpy().reshape(len(nodes), d)[:, 0]
        reach = max(0.5, side / 2 * np.exp(-10 * (t / epochs) ** 2))
        near = np.exp(-gap / (2 * reach**2))
        nodes = near @ sums / np.maximum(near @ n, 1e-9)[:, None]
    return nodes


def viterbi(sequences: DataFrame, by: str, order: str, symbol: str, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> DataFrame:
    """by, states, log_p: the likeliest state path of every sequence under a discrete HMM, in logarithms."""
    with np.errstate(divide="ignore"):
        logs = np.log(start), np.log(move), np.log(emit)
    grouped = sequences.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, symbol))).alias("s")).select(by, F.transform("s", lambda s: s[symbol].cast("int")).alias("seq"))
    return _viterbi(grouped, by, *logs)


def _viterbi(grouped: DataFrame, by: str, ls: np.ndarray, lm: np.ndarray, le: np.ndarray) -> DataFrame:
    ship_package(grouped.sparkSession)
    def best(seq: np.ndarray) -> tuple[list[int], float]:
        score, back = ls + le[:, seq[0]], []
        for o in seq[1:]:
            step = score[:, None] + lm
            back.append(step.argmax(0))
            score = step.max(0) + le[:, o]
        path = [int(score.argmax())]
        for k in reversed(back):
            path.append(int(k[path[-1]]))
        return path[::-1], float(score.max())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [best(s) for s in b["seq"]]
            yield pd.DataFrame({by: b[by], "states": [g[0] for g in got], "log_p": [g[1] for g in got]})

    return grouped.mapInPandas(run, f"{by} {grouped.schema[by].dataType.simpleString()}, states array<int>, log_p double")


def spread(rows: DataFrame, column: str, weights: np.ndarray) -> DataFrame:
    """The rows with projected: their products with the columns of a fixed matrix."""
    return rows.withColumn("projected", F.array(*[dot(F.col(column), F.array(*map(F.lit, w.tolist()))) for w in weights.T]))
