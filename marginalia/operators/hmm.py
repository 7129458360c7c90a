"""Hidden Markov models with mixtures of full-covariance Gaussians: training over many sequences, likelihoods, heat maps.

A sequence is one array of a row, as its passes need it whole; ``segments`` cuts longer ones. In training the tasks add up expected
counts and moments, whose size is the model's, and only those come to the driver, once a round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.alignment import sequences
from marginalia.operators.encoding import added
from marginalia.operators.tables import running_before
from marginalia.runtime import materialise, ship_package

#: Places times states of the arrays of a chunk of sequences; a longer sequence comes alone.
CELLS = 1 << 19


def log_density(x: np.ndarray, mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """Logarithm of a Gaussian density with a full covariance, for each row of ``x``."""
    factor = np.linalg.cholesky(covariance)
    white = np.linalg.solve(factor, (x - mean).T)
    return -0.5 * ((white * white).sum(0) + len(mean) * np.log(2 * np.pi)) - np.log(np.diag(factor)).sum()


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


@dataclass(frozen=True)
class Model:
    """start (s), move (s, s), shares (s, m), means (s, m, d), covariances (s, m, d, d)."""

    start: np.ndarray
    move: np.ndarray
    shares: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        """(n, s, m): log of share times density of each component."""
        s, m = self.shares.shape
        with np.errstate(divide="ignore"):
            return np.stack([np.stack([np.log(self.shares[i, k]) + log_density(x, self.means[i, k], self.covariances[i, k]) for k in range(m)], 1) for i in range(s)], 1)

    def best_path(self, x: np.ndarray) -> float:
        """Logarithm of the probability of the likeliest state path and the sequence."""
        with np.errstate(divide="ignore"):
            start, move = np.log(self.start), np.log(self.move)
        emit = _logsumexp(self.log_parts(x), 2)
        v = start + emit[0]
        for e in emit[1:]:
            v = (v[:, None] + move).max(0) + e
        return float(v.max())


class Expected:
    """Expected counts of a chunk of sequences under a model, by forward and backward passes in logarithms, all sequences at once."""

    def __init__(self, model: Model, xs: list[np.ndarray]) -> None:
        s, m = model.shares.shape
        d = model.means.shape[2]
        n, long = np.array([len(x) for x in xs]), max(map(len, xs))
        here = np.arange(long)[None] < n[:, None]
        x = np.zeros((len(xs), long, d))
        for i, own in enumerate(xs):
            x[i, : len(own)] = own
        parts = model.log_parts(x.reshape(-1, d)).reshape(len(xs), long, s, m)
        emit = _logsumexp(parts, 3)
        with np.errstate(divide="ignore"):
            start, move = np.log(model.start), np.log(model.move)
        ahead = np.empty((len(xs), long, s))
        ahead[:, 0] = start + emit[:, 0]
        for t in range(1, long):
            ahead[:, t] = emit[:, t] + _logsumexp(ahead[:, t - 1, :, None] + move, 1)
        behind = np.zeros((len(xs), long, s))
        for t in range(long - 2, -1, -1):
            step = _logsumexp(move + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t < n - 1)[:, None], step, 0.0)
        likely = _logsumexp(ahead[np.arange(len(xs)), n - 1], 1)
        state = np.exp(ahead + behind - likely[:, None, None]) * here[..., None]
        moves = np.zeros((s, s))
        for t in range(long - 1):
            on = np.flatnonzero(t < n - 1)
            moves += np.exp(ahead[on, t, :, None] + move + (emit[on, t + 1] + behind[on, t + 1])[:, None, :] - likely[on, None, None]).sum(0)
        part = state[..., None] * np.exp(parts - emit[..., None])
        flat, w = x.reshape(-1, d), part.reshape(-1, s, m)
        self.likelihood, self.first, self.moves, self.state = likely.sum(), state[:, 0].sum(0), moves, state
        self.weights, self.sums = w.sum(0), np.einsum("nsm,nd->smd", w, flat)
        self.squares = np.einsum("nsm,nd,ne->smde", w, flat, flat, optimize=True)

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.likelihood], self.first, self.moves.ravel(), self.weights.ravel(), self.sums.ravel(), self.squares.ravel()])


def chunks(xs: list[np.ndarray], states: int) -> Iterator[list[int]]:
    """Places of sequences of like lengths whose padded arrays stay within CELLS; empty ones are left out."""
    held: list[int] = []
    for i in sorted((i for i, x in enumerate(xs) if len(x)), key=lambda i: len(xs[i])):
        if held and (len(held) + 1) * len(xs[i]) * states > CELLS:
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def first_model(rows: DataFrame, states: int, mixtures: int, *, stay: float = 0.6, floor: float = 1e-3, column: str = "seq", seed: int = 1) -> Model:
    """Where training starts: means at observations chosen by a hash of their values, in order of their first number, all with the
    covariance of all observations; states tend to stay."""
    flat = rows.select(F.explode(F.col(column).cast("array<array<double>>")).alias("x")).where("x IS NOT NULL")
    d = len(flat.first().x)
    at = [F.get("x", F.lit(i)) for i in range(d)]
    moments = flat.agg(*[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(d)]).first()
    covariance = np.array(list(moments)).reshape(d, d) + floor * np.eye(d)
    chosen = flat.distinct().orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(states * mixtures).collect()
    if len(chosen) < states * mixtures:
        raise ValueError(f"fewer than {states * mixtures} different observations")
    means = np.array(sorted(list(r.x) for r in chosen)).reshape(states, mixtures, d)
    move = np.full((states, states), (1 - stay) / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, stay if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, np.full((states, mixtures), 1 / mixtures), means, np.tile(covariance, (states, mixtures, 1, 1)))


def baum_welch(rows: DataFrame, model: Model, *, rounds: int = 20, least: float = 0.3, floor: float = 1e-3, column: str = "seq") -> tuple[Model, list[float]]:
    """The model after training, and the log-likelihoods of the models before each round and of the last.

    Ends when start and move change by less than ``least`` in all (a sum of absolute differences), or after ``rounds`` rounds. ``floor`` is
    added to the covariances' diagonals. A component that no observation belongs to stays as it is. Null and empty sequences count nothing.
    """
    seqs = materialise(rows.select(F.col(column).cast("array<array<double>>").alias("seq")).where("size(seq) > 0"), "sequences")
    s, m = model.shares.shape
    d = model.means.shape[2]
    size = 1 + s + s * s + s * m * (1 + d + d * d)

    def total(now: Model) -> np.ndarray:
        def expected(columns: list[pa.Array]) -> np.ndarray:
            xs = sequences(columns[0])
            return sum((Expected(now, [xs[i] for i in part]).flat() for part in chunks(xs, s * m)), np.zeros(size))

        return added(seqs, expected, size)

    likelihoods = []
    for _ in range(rounds):
        sums = total(model)
        likelihoods.append(float(sums[0]))
        cut = np.cumsum([1, s, s * s, s * m, s * m * d])
        first, moves, weights, x, xx = (part.reshape(shape) for part, shape in zip(np.split(sums, cut)[1:], ((s,), (s, s), (s, m), (s, m, d), (s, m, d, d)), strict=True))
        if not first.sum():
            break
        start, left = first / first.sum(), moves.sum(1, keepdims=True)
        move = np.where(left > 0, moves / np.where(left > 0, left, 1), model.move)
        used = weights[..., None] > 1e-9
        means = np.where(used, x / np.maximum(weights, 1e-9)[..., None], model.means)
        spread = xx / np.maximum(weights, 1e-9)[..., None, None] - means[..., :, None] * means[..., None, :] + floor * np.eye(d)
        shares = weights / np.maximum(weights.sum(1, keepdims=True), 1e-300)
        change = np.abs(start - model.start).sum() + np.abs(move - model.move).sum()
        model = Model(start, move, np.where(weights.sum(1, keepdims=True) > 0, shares, model.shares), means, np.where(used[..., None], spread, model.covariances))
        if change < least:
            break
    return model, [*likelihoods, float(total(model)[0])]


def scores(rows: DataFrame, model: Model, keys: Sequence[str], column: str = "seq", name: str = "log_p") -> DataFrame:
    """``keys`` and the logarithm of the probability of each sequence with its likeliest path; null for a null or empty sequence."""
    ship_package(rows.sparkSession)
    given = rows.select(*keys, F.col(column).cast("array<array<double>>").alias("__seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.best_path(x) if len(x) else None for x in sequences(batch.column(len(keys)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.float64())], names=[*keys, name])

    return given.mapInArrow(run, ", ".join([*(f"{k} {given.schema[k].dataType.simpleString()}" for k in keys), f"{name} double"]))


def segments(rows: DataFrame, by: str, order: str, features: Column, length: int, stride: int, *, whole: bool = True) -> DataFrame:
    """``by``, stretch, seq: stretches of ``length`` observations of each ``by`` in order, every ``stride`` of them; with ``whole`` only those of full length.

    Places come from a range sort, and a row goes to the stretches that hold it, so a ``by`` of any length is many short rows.
    """
    placed = running_before(rows.select(by, order, features.cast("array<double>").alias("x"), F.lit(1).alias("one")), (by,), (order,), ("one",))
    last, first = F.floor(F.col("one_before") / stride), F.greatest(F.lit(0), F.ceil((F.col("one_before") - length + 1) / stride))
    each = placed.where(last >= first).select(by, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("stretch"), "one_before", "x")
    grouped = each.groupBy(by, "stretch").agg(F.array_sort(F.collect_list(F.struct("one_before", "x"))).alias("s")).select(by, "stretch", F.transform("s", lambda s: s["x"]).alias("seq"))
    return grouped.where(F.size("seq") == length) if whole else grouped


def densities(rows: DataFrame, means: dict, covariances: dict, id_col: str, class_col: str, column: str = "v") -> DataFrame:
    """``id_col`` and the log-density of each row under its class's Gaussian; null where the class has none."""
    ship_package(rows.sparkSession)
    given = rows.select(id_col, class_col, F.col(column).cast("array<double>").alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, out = batch.column(1).to_pylist(), [None] * batch.num_rows
            for c in set(labels) & set(means):
                at = [i for i, x in enumerate(labels) if x == c]
                found = log_density(np.array(batch.column(2).take(pa.array(at)).to_pylist(), dtype=np.float64), means[c], covariances[c])
                for i, x in zip(at, found.tolist(), strict=True):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[id_col, "log_density"])

    return given.mapInArrow(run, f"{id_col} {given.schema[id_col].dataType.simpleString()}, log_density double")
