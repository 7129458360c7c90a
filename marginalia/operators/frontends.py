"""Six scoring front-ends that end in one evaluation: raw features, direct attributes, calibrated attributes, regression, linear and
kernel common subspaces. Each maps images, and all but the first also texts, to unit vectors whose products are the scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import attributes, blocks, subspace
from marginalia.operators.encoding import added
from marginalia.operators.strips import unit
from marginalia.runtime import materialise, ship_package

#: Queries in one product.
TOGETHER = 64
NAMES = ("features", "direct", "calibrated", "regression", "linear", "kernel")


@dataclass(frozen=True)
class FrontEnd:
    name: str
    image: Callable[[np.ndarray], np.ndarray]
    text: Callable[[np.ndarray], np.ndarray] | None


def calibrations(scored: DataFrame, count: int, rounds: int = 25) -> np.ndarray:
    """(attributes, 2): slope and offset of the logistic curve of each attribute, from rows (s, y) of arrays, by Newton's steps for all
    attributes at once; a task adds up gradients and curvatures, five numbers an attribute."""
    ab = np.zeros((count, 2))
    for _ in range(rounds):
        def sums(columns: list[pa.Array], ab: np.ndarray = ab) -> np.ndarray:
            s, y = subspace.pair(columns)
            p = 1 / (1 + np.exp(-np.clip(ab[:, 0] * s + ab[:, 1], -500, 500)))
            h = p * (1 - p)
            return np.stack([((p - y) * s).sum(0), (p - y).sum(0), (h * s * s).sum(0), (h * s).sum(0), h.sum(0)]).ravel()

        gs, g1, ss, s1, h = added(scored, sums, 5 * count).reshape(5, count)
        ss, h = ss + 1e-6, h + 1e-6
        det = ss * h - s1 * s1
        step = np.stack([(h * gs - s1 * g1) / det, (ss * g1 - s1 * gs) / det], 1)
        size = np.maximum(1.0, np.abs(step).max(1, keepdims=True) / 5.0)
        ab = ab - step / size
        if np.abs(step).max(initial=0) < 1e-9:
            break
    return ab


def learnt(train: DataFrame, valid: DataFrame, id_col: str, x: str, y: str, label: str, *, rounds: int = 40, reg: float = 0.1, widths, ms, regs, ks) -> list[FrontEnd]:
    """The six front-ends. Attributes come from bagged classifiers; what is learnt on top of them uses their out-of-bag scores, so that it
    isn't misled by rows that the classifiers have seen."""
    w, _, out = attributes.bagged(train, id_col, x, y, rounds=rounds)
    count = w.shape[1]
    attribute = lambda v: np.concatenate([v, np.full((len(v), 1), attributes.BIAS)], axis=1) @ w
    scored = out.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("attribute", "score"))).alias("s")).select("id", F.transform("s", lambda s: s["score"]).alias("s"))
    rows = materialise(scored.join(train.select(F.col(id_col).alias("id"), F.col(y).cast("array<double>").alias("y"), F.col(label).alias("label")), "id"), "out-of-bag")
    ab = calibrations(rows.select("s", "y"), count)
    calibrated = lambda s: 1 / (1 + np.exp(-np.clip(ab[:, 0] * s + ab[:, 1], -500, 500)))

    def sums(columns: list[pa.Array]) -> np.ndarray:
        a, b = (unit(z) for z in subspace.pair(columns))
        z = np.concatenate([a, b], axis=1)
        return np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])

    size = 2 * count
    got = added(rows.select("s", "y"), sums, 1 + size + size * size)
    mean = got[1 : 1 + size] / got[0]
    c = got[1 + size :].reshape(size, size) / got[0] - np.outer(mean, mean)
    ma, mt = mean[:count], mean[count:]
    ridge = np.linalg.solve(c[:count, :count] + reg * np.eye(count), c[:count, count:])
    k = min(max(ks), count)
    wx, wy, _ = subspace.correlated(c[:count, :count], c[:count, count:], c[count:, count:], max(regs), k)
    kernel, _ = subspace.chosen(rows.select("id", "label", "s", "y"), valid.join(_attributes(valid, id_col, x, attribute).withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id")).select(F.col(id_col).alias("id"), F.col(label).alias("label"), "s", F.col(y).alias("y")), "id", "s", "y", "label", widths=widths, ms=ms, regs=regs, ks=ks)
    return [
        FrontEnd("features", unit, None),
        FrontEnd("direct", lambda v: unit(attribute(v)), unit),
        FrontEnd("calibrated", lambda v: unit(calibrated(attribute(v))), unit),
        FrontEnd("regression", lambda v: unit((unit(attribute(v)) - ma) @ ridge), lambda t: unit(unit(t) - mt)),
        FrontEnd("linear", lambda v: unit((unit(attribute(v)) - ma) @ wx), lambda t: unit((unit(t) - mt) @ wy)),
        FrontEnd("kernel", lambda v: kernel.image(attribute(v)), kernel.text),
    ]


def _attributes(rows: DataFrame, id_col: str, x: str, attribute: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """id and s: the attributes of each row."""
    ship_package(rows.sparkSession)
    given = rows.where(f"{x} IS NOT NULL").select(F.col(x).cast("array<double>").alias("x"), F.col(id_col).alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = attribute(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(s), pa.list_(pa.float64()))], names=["id", "s"])

    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, s array<double>")


def scores(rows: DataFrame, queries: DataFrame, texts: DataFrame, models: list[FrontEnd], id_col: str, x: str, label: str, block: int = 4096) -> DataFrame:
    """front_end, kind, query, item, score, relevant of every row with every query, by example (but not itself) and by text.

    Queries (``id_col``, ``label``, ``x``) and texts (``label``, y) are stated sets; they go to the rows in blocks of ``block``.
    """
    ship_package(rows.sparkSession)
    given = rows.where(f"{x} IS NOT NULL").select(F.col(x).cast("array<double>").alias("x"), F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"))
    kind = given.schema["id"].dataType.simpleString()
    asked = queries.where(f"{x} IS NOT NULL").select(F.lit(0).alias("kind"), F.col(id_col).cast("string").alias("name"), F.col(label).cast("string").alias("c"), F.col(x).cast("array<double>").alias("v"))
    asked = asked.unionByName(texts.select(F.lit(1).alias("kind"), F.col(label).cast("string").alias("name"), F.col(label).cast("string").alias("c"), F.col("y").cast("array<double>").alias("v")))
    asked = materialise(asked.withColumn("block", F.pmod(F.xxhash64("kind", "name"), F.lit(max(1, -(-asked.count() // block))))), "asked")
    out = None
    for b in range(asked.agg(F.max("block")).first()[0] + 1 if not asked.isEmpty() else 0):
        part = sorted(map(tuple, asked.where(F.col("block") == b).drop("block").collect()))
        sets = []
        for m in models:
            for which, of in ((0, m.image), (1, m.text)):
                own = [q for q in part if q[0] == which]
                if own and of:
                    sets.append((m, which, [q[1:3] for q in own], of(np.array([q[3] for q in own]))))

        def run(batches: Iterator[pa.RecordBatch], sets=sets) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                ids, labels = np.array([str(i) for i in batch.column(1).to_pylist()]), np.array([str(c) for c in batch.column(2).to_pylist()])
                for m, which, names, matrix in sets:
                    own = m.image(v)
                    for j, (name, c) in enumerate(names):
                        if j % TOGETHER == 0:  # a task holds the products with so many queries, not with a block's
                            s = np.round(own @ matrix[j : j + TOGETHER].T, 6) + 0.0
                        at = np.flatnonzero(ids != name) if which == 0 else np.arange(len(ids))
                        yield pa.RecordBatch.from_arrays([pa.array([m.name] * len(at), pa.string()), pa.array(np.full(len(at), which), pa.int32()), pa.array([name] * len(at), pa.string()), batch.column(1).take(pa.array(at)), pa.array(s[at, j % TOGETHER]), pa.array(labels[at] == c)], names=["front_end", "kind", "query", "item", "score", "relevant"])

        found = given.mapInArrow(run, f"front_end string, kind int, query string, item {kind}, score double, relevant boolean")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], f"front_end string, kind int, query string, item {kind}, score double, relevant boolean")


def _first_and_mid_tie(score: np.ndarray, hit: np.ndarray) -> dict | None:
    """n_relevant and ap of ``blocks.mid_tie``, and whether the first of the best items is relevant."""
    got = blocks.mid_tie(score, hit)
    return got and got | {"p_at_1": float(hit[0])}


def evaluated(rows: DataFrame, queries: DataFrame, texts: DataFrame, models: list[FrontEnd], id_col: str, x: str, label: str) -> DataFrame:
    """front_end, kind, n_queries, map, p_at_1: what ``scores`` tells by ``ranking.mid_tie_ap`` and ``ranking.precision_at_1``. The scores are
    ranked where they are made and are never rows."""
    id_type = rows.schema[id_col].dataType
    items = rows.where(f"{x} IS NOT NULL").select(F.col(id_col).alias("item"), F.col(label).cast("string").alias("label"), F.col(x).cast("array<double>").alias("v"))
    width = items.agg(F.max(F.size("v"))).first()[0] or 1
    by_example = queries.where(f"{x} IS NOT NULL").select(F.col(id_col).cast(id_type).alias("query"), F.col(label).cast("string").alias("qlabel"), F.col(x).cast("array<double>").alias("qv"))
    by_text = texts.select(F.col(label).cast("string").alias("query"), F.col(label).cast("string").alias("qlabel"), F.col("y").cast("array<double>").alias("qv"))

    def figures(kind: int, asked: DataFrame, chosen: list[FrontEnd]) -> DataFrame:
        def scored(block: blocks.Asked, v: np.ndarray) -> Callable[[int, int], Iterator[np.ndarray]]:
            if "sides" not in block.extra:
                block.extra["sides"] = [(m.text if kind else m.image)(block.matrices[0]) for m in chosen]
            every = [m.image(v) for m in chosen]
            return lambda lo, hi: (side[lo:hi] @ own.T for side, own in zip(block.extra["sides"], every, strict=True))

        found = blocks.ranked(asked, items, _first_and_mid_tie, "n_relevant long, ap double, p_at_1 double", scored=scored, sets=len(chosen), itself=bool(kind), width=width)
        names = F.array(*[F.lit(m.name) for m in chosen])
        return found.select(F.get(names, F.col("blend")).alias("front_end"), F.lit(kind).alias("kind"), "ap", "p_at_1")

    each = figures(0, by_example, models).unionByName(figures(1, by_text, [m for m in models if m.text]))
    return each.groupBy("front_end", "kind").agg(F.count("*").alias("n_queries"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("p_at_1"), 6).alias("p_at_1"))
