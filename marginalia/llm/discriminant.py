"""Quality classifier: quadratic discriminant analysis over transformed document statistics.

Each class is a normal density over FEATURES, with a covariance that is shrunk twice: toward the pooled covariance of both
classes, and toward the pooled variances alone, so that it can be factored whatever the rows. The Cholesky factors are
made once, with the model; a document's score is the logistic function of the difference of the two log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import narrow, text_chunks
from marginalia.llm.quality import text_stats
from marginalia.runtime import materialise, ship_package

FEATURES = ("words", "chars_per_word", "symbols", "repeated_lines", "repeated_words", "words_per_line", "digits", "capitals", "distinct_words", "ended_lines", "marks", "stops", "bare")
MARKS = b"!?;:()[]{}\"'/\\@_~^=+`-"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def feature_matrix(texts: list[bytes]) -> np.ndarray:
    """FEATURES of each text: logarithms of counts and of smoothed shares, which are nearer to normal than the shares are."""
    s = text_stats(texts)
    words, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    count = lambda among: np.array([len(t) - len(t.translate(None, among)) for t in texts], dtype=np.int64)
    bare = np.array([sum(not w.strip(PUNCTUATION) for w in t.split()) for t in texts], dtype=np.int64)
    share = lambda part, whole: np.log((part + 0.5) / (whole + 1.0))
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, share(s["n_symbols"], words), share(s["n_dup_lines"], lines), share(s["n_repeat_words"], words), np.log(words / lines), share(s["n_digits"], words),
        share(s["n_upper"], words), s["n_distinct_words"] / np.sqrt(words), share(s["n_ended_lines"], lines), share(count(MARKS), words), share(count(b".,"), words), share(bare, words),
    ], axis=1).astype(np.float64)


@dataclass(frozen=True)
class Discriminant:
    """Means, lower Cholesky factors and log shares of the classes 0 and 1. Without rows of both, only ``share`` counts."""

    means: np.ndarray
    factors: np.ndarray
    log_shares: np.ndarray
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        if not len(self.means) or not len(x):
            return np.full(len(x), self.share)
        logs = []
        for mean, factor, log_share in zip(self.means, self.factors, self.log_shares, strict=True):
            white = np.linalg.solve(factor, (x - mean).T)
            logs.append(log_share - np.log(np.diag(factor)).sum() - 0.5 * (white * white).sum(0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(counts: np.ndarray, means: np.ndarray, covariances: np.ndarray, *, to_pooled: float = 0.5, to_variances: float = 0.02, floor: float = 1e-3) -> Discriminant:
    """The model of two classes' counts, means and (population) covariances.

    A class's covariance takes ``to_pooled`` of the pooled one, and the sum ``to_variances`` of the pooled variances (each at
    least ``floor``) on the diagonal, so it is positive definite even for a class of one row or for constant features.
    """
    share = float(counts[1] / counts.sum()) if counts.sum() else 0.5
    if not counts.all():
        return Discriminant(np.zeros((0, len(FEATURES))), np.zeros((0, 0, 0)), np.zeros(0), share)
    pooled = np.einsum("c,cij->ij", counts / counts.sum(), covariances)
    variances = np.diag(np.maximum(np.diag(pooled), floor))
    shrunk = [(1 - to_variances) * ((1 - to_pooled) * c + to_pooled * pooled) + to_variances * variances for c in covariances]
    return Discriminant(means, np.stack([np.linalg.cholesky(c) for c in shrunk]), np.log(counts / counts.sum()), share)


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and FEATURES of every whole text (null: empty), in one pass over the texts, where they lie."""
    ship_package(docs.sparkSession)
    rows = narrow(docs, id=id_col, text=text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            x = feature_matrix(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["id", *FEATURES])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{k} double' for k in FEATURES)}")


def train(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **shrinkage) -> Discriminant:
    """The model of ``document_features`` and (id, label) rows, label 1 or 0.

    Counts, means and covariances are summed by Spark over all labelled rows; one row a class comes to the driver. Null
    ids and labels are left out, repeated label rows count once, a document with both labels counts for both.
    """
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").distinct()
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = [F.count("*").alias("n"), *(F.avg(k).alias(f"m{i}") for i, k in enumerate(FEATURES)), *(F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs)]
    got = {r.y: r for r in features.join(given, "id").groupBy("y").agg(*sums).collect()}
    d = len(FEATURES)
    counts, means, covariances = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for y, r in got.items():
        counts[y], means[y] = r.n, [r[f"m{i}"] for i in range(d)]
        for i, j in pairs:
            covariances[y, i, j] = covariances[y, j, i] = r[f"c{i}_{j}"]
    return fit(counts, means, covariances, **shrinkage)


def score_features(features: DataFrame, model: Discriminant) -> DataFrame:
    """id and score of ``document_features`` rows."""
    ship_package(features.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(1 + j).to_numpy() for j in range(len(FEATURES))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["id", "score"])

    return features.select("id", *FEATURES).mapInArrow(run, f"id {features.schema['id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, folds: int = 5, held_fold: int = 0, least: float = 0.3, **shrinkage) -> DataFrame:
    """One row per document: ``id_col``, held_out, score, predicted.

    Learns from the labels of ids whose crc32 (of the decimal id) modulo ``folds`` is not ``held_fold``; the others are
    held_out. score is the probability of label 1, predicted is 1 from ``least`` on. Only the text is looked at.

    Null and empty texts have no words and get a score like any other. A null id is never labelled and not held out. Repeated
    rows are scored one by one, alike. Without labels every score is 0.5, with one label only it is that label; an empty table gives
    an empty one. Of the input only the two named columns are read. Long texts are read whole, one at a time.
    """
    features = materialise(document_features(docs, id_col, text_col), "features")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == held_fold, F.lit(False))
    model = train(features.where(~held), labels, id_col, label_col, **shrinkage)
    scored = score_features(features, model)
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
