"""Windows over strips: word images as rows of codewords, their vectors by differences of running sums, and the spotters' scores.

A word is a row (item, label, strip): ``strip`` holds the codeword of each cell, a cell is ``CELL`` places wide, and a codeword's vector
stands at each of its places. The codebook is a model: a matrix of a size set by who trains it, sent to the tasks whole, as
are the queries (a stated set, in blocks if it is long). A window's vector is the sum over its places, taken as the difference of two
running sums, so no window is summed anew, and all windows of a chunk of words meet all queries in one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marginalia.runtime import ship_package

CELL = 10
#: Windows in one matrix product, and so what a task holds.
CHUNK = 20_000


@dataclass(frozen=True)
class Codebook:
    """The vectors of the codewords. ``project`` maps them once; sums of projected vectors are projected sums, so windows of
    attributes cost no more than windows of features."""

    vectors: np.ndarray

    def project(self, weights: np.ndarray) -> Codebook:
        return Codebook(self.vectors @ weights)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    size = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def query_vectors(exemplars: np.ndarray, texts: np.ndarray, alpha: float) -> np.ndarray:
    """alpha * image + (1 - alpha) * text of unit vectors, not made unit again."""
    return alpha * unit(exemplars) + (1 - alpha) * unit(texts)


class Sums:
    """Running sums over the cells of some strips, end to end."""

    def __init__(self, strips: Sequence[np.ndarray], book: Codebook) -> None:
        self.lengths = np.array([len(s) for s in strips], dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        cells = np.concatenate([*strips, np.zeros(1, dtype=np.int64)]).astype(np.int64)  # one more cell for the place behind the last
        self.cells, self.vectors = cells, book.vectors
        self.before = np.zeros((len(cells), book.vectors.shape[1]))
        np.cumsum(CELL * book.vectors[cells[:-1]], axis=0, out=self.before[1:])

    def upto(self, word: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The sum over a word's places before ``x``, and over all words before it."""
        cell = self.first[word] + x // CELL
        return self.before[cell] + (x % CELL)[:, None] * self.vectors[self.cells[cell]]

    def windows(self, word: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
        """Unit vectors of the windows from x0 to before x1."""
        return unit(self.upto(word, x1) - self.upto(word, x0))


def _rows(words: DataFrame) -> DataFrame:
    return words.select("item", "label", F.coalesce("strip", F.array().cast("array<int>")).alias("strip"))


def _chunks(batch: pa.RecordBatch, strip: int, windows_of) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch with about CHUNK windows, and their strips."""
    strips = [np.asarray(s, dtype=np.int64) for s in batch.column(strip).to_pylist()]
    at, held = 0, 0
    for i, s in enumerate(strips):
        n = windows_of(len(s))
        if held and held + n > CHUNK:
            yield batch.slice(at, i - at), strips[at:i]
            at, held = i, 0
        held += n
    if at < len(strips):
        yield batch.slice(at), strips[at:]


def _grid(lengths: np.ndarray, widths: Sequence[int], stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word, width and number of every window that fits, by word, width and number."""
    counts = np.maximum(0, (CELL * lengths[:, None] - np.asarray(widths)[None]) // stride + 1)
    word, which = np.repeat(np.indices(counts.shape).reshape(2, -1), counts.ravel(), axis=1)
    total = counts.ravel()
    number = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return word, np.asarray(widths)[which], number


def _scores(sums: Sums, word: np.ndarray, x0: np.ndarray, x1: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Negated likeness, lower is better; a row per window, a column per query."""
    return np.round(-(sums.windows(word, x0, x1) @ queries.T), 6) + 0.0


RESULT = "query string, item {item}, label string, w int, r long, x0 long, x1 long, score double"


def spot(words: DataFrame, book: Codebook, names: Sequence[str], queries: np.ndarray, widths: Sequence[int], stride: int, apart: int | None = None) -> DataFrame:
    """query, item, label, w, r, x0, x1, score of the windows of every word against every query.

    With ``apart``, only the best window of each word and query (ties: the narrowest, then the first) and the best one more than
    ``apart`` windows from it, for one width; they are chosen in the task, so no other window leaves it. Without it every window
    is a row: the full spotter. Words narrower than a window have none; null strips are empty.
    """
    ship_package(words.sparkSession)
    rows = _rows(words)
    item = rows.schema["item"].dataType
    item_type, kinds = to_arrow_type(item), (pa.string(), None, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    windows_of = lambda n: sum(max(0, (CELL * n - w) // stride + 1) for w in widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, strips in _chunks(batch, 2, windows_of):
                sums = Sums(strips, book)
                word, w, r = _grid(sums.lengths, widths, stride)
                if not len(word):
                    continue
                scores = _scores(sums, word, r * stride, r * stride + w, queries)
                for q, name in enumerate(names):
                    at = np.arange(len(word)) if apart is None else _two(word, r, scores[:, q], apart)
                    of = pa.array(word[at])
                    cols = [pa.array([name] * len(at), pa.string()), part.column(0).take(of).cast(item_type), part.column(1).take(of), w[at], r[at], r[at] * stride, r[at] * stride + w[at], scores[at, q]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(cols, kinds, strict=True)], names=RESULT_NAMES)

    return rows.mapInArrow(run, RESULT.format(item=item.simpleString()))


RESULT_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _two(word: np.ndarray, r: np.ndarray, score: np.ndarray, apart: int) -> np.ndarray:
    """Places of each word's best window and of its best one farther off; windows are in order of word."""
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    of = np.cumsum(np.concatenate([[0], (word[1:] != word[:-1]).astype(np.int64)]))

    def first_best(s: np.ndarray) -> np.ndarray:
        low = np.minimum.reduceat(s, starts)
        place = np.where(s == low[of], np.arange(len(s)), len(s))
        return np.minimum.reduceat(place, starts)

    best = first_best(score)
    far = np.where(np.abs(r - r[best][of]) > apart, score, np.inf)
    second = first_best(far)
    return np.sort(np.concatenate([best, second[np.isfinite(far[second])]]))


def refine(hits: DataFrame, book: Codebook, names: Sequence[str], queries: np.ndarray, step: int) -> DataFrame:
    """``hits`` (query, item, label, strip, x0, x1, score) with their edges moved.

    Each edge is tried ``step`` to either side, alone; an edge's move counts if it scores lower than the hit. Of the two edges' best
    moves the better is taken (ties: the right edge), or both together if that is lower still. The left edge moves left only where
    it stands farther in than ``step``, the right edge moves right only within the image.
    """
    ship_package(hits.sparkSession)
    rows = hits.select("query", "item", "label", "strip", "x0", "x1", "score")
    item = rows.schema["item"].dataType
    place = {n: i for i, n in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, strips in _chunks(batch, 3, lambda n: 5):
                sums, at = Sums(strips, book), np.arange(len(strips))
                q = queries[[place[n] for n in part.column(0).to_pylist()]]
                x0, x1, score = (part.column(i).to_numpy().astype(t) for i, t in ((4, np.int64), (5, np.int64), (6, np.float64)))
                image = CELL * sums.lengths

                def tried(a: np.ndarray, b: np.ndarray, allowed: np.ndarray) -> np.ndarray:
                    a, b = np.clip(a, 0, image), np.clip(b, 0, image)  # noqa: B023
                    s = np.round(-(sums.windows(at, a, b) * q).sum(1), 6) + 0.0  # noqa: B023
                    return np.where(allowed & (a < b), s, np.inf)

                def moved(edges: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    best, low = own.copy(), score.copy()  # noqa: B023
                    for where, s in edges:
                        better = s < low
                        best, low = np.where(better, where, best), np.where(better, s, low)
                    return best, low

                left, s0 = moved([(x0 - step, tried(x0 - step, x1, x0 > step)), (x0 + step, tried(x0 + step, x1, x0 + step < x1))], x0)
                right, s1 = moved([(x1 + step, tried(x0, x1 + step, x1 + step < image)), (x1 - step, tried(x0, x1 - step, x1 - step > x0))], x1)
                take = s0 < s1
                n0, n1, low = np.where(take, left, x0), np.where(take, x1, right), np.minimum(s0, s1)
                both = tried(left, right, (left != x0) & (right != x1))
                wins = both < low
                n0, n1, low = np.where(wins, left, n0), np.where(wins, right, n1), np.where(wins, both, low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n0), pa.array(n1), pa.array(low)], names=["query", "item", "label", "x0", "x1", "score"])

    return rows.mapInArrow(run, f"query string, item {item.simpleString()}, label string, x0 long, x1 long, score double")


def whole(words: DataFrame, book: Codebook, column: str = "v") -> DataFrame:
    """``words`` (item, label, strip) with the unit vector of each whole word; an empty strip has the zero vector."""
    ship_package(words.sparkSession)
    rows = _rows(words)
    item = rows.schema["item"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, strips in _chunks(batch, 2, lambda n: 1):
                sums = Sums(strips, book)
                v = sums.windows(np.arange(len(strips)), np.zeros(len(strips), np.int64), CELL * sums.lengths)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(v), pa.list_(pa.float64()))], names=["item", "label", column])

    return rows.mapInArrow(run, f"item {item.simpleString()}, label string, {column} array<double>")


def columns(words: DataFrame, book: Codebook, name: str = "columns") -> DataFrame:
    """``words`` (item, label, strip) with a sequence of feature columns, two a cell: the cell's vector, and its mean with the next
    cell's (the last cell's own)."""
    ship_package(words.sparkSession)
    rows = _rows(words)
    item = rows.schema["item"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column(2).to_pylist():
                v = book.vectors[np.asarray(s, dtype=np.int64)]
                out.append(np.stack([v, (v + np.concatenate([v[1:], v[-1:]])) / 2], axis=1).reshape(2 * len(v), -1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["item", "label", name])

    return rows.mapInArrow(run, f"item {item.simpleString()}, label string, {name} array<array<double>>")
