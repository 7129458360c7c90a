"""Quality rules: document statistics, two fixed rules and gradient-boosted trees over the statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import narrow, text_chunks
from marginalia.runtime import ship_package

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_distinct_words", "n_ended_lines")
SYMBOLS = b"#*$%&|<>"
#: Features of the trees, and the sign that the log-odds of being good must follow (0: free).
FEATURES = (("words", 0), ("chars_per_word", 0), ("symbols_per_word", -1), ("dup_line_share", -1), ("repeat_share", -1), ("words_per_line", 0), ("digits_per_word", 0), ("upper_per_word", 0), ("distinct_share", 0), ("ended_line_share", 0))


def text_stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    """STATS of each text. Words are runs of other bytes than space and 0x09 to 0x0D."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    out = {"n_words": n, "word_chars": np.array([len(b"".join(w).decode("utf-8", "replace")) for w in words], dtype=np.int64)}
    count = lambda among: np.array([len(t) - len(t.translate(None, among)) for t in texts], dtype=np.int64)
    out |= {"n_symbols": count(SYMBOLS), "n_digits": count(b"0123456789"), "n_upper": count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    out["n_lines"] = np.array([len(x) for x in lines], dtype=np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64)
    out["n_ended_lines"] = np.array([sum(y.rstrip()[-1:] in b".!?" for y in x) for x in lines], dtype=np.int64)
    codes = np.fromiter((hash(w) for ws in words for w in ws), dtype=np.int64, count=int(n.sum())).view(np.uint64)
    doc = np.repeat(np.arange(len(texts)), n)
    out["n_repeat_words"] = _repeated(codes, doc, len(texts))
    out["n_distinct_words"] = np.array([len(set(w)) for w in words], dtype=np.int64)
    return out


def _repeated(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words in three-word windows that a document has twice or more, the first included."""
    covered = np.zeros(len(codes), dtype=bool)
    if len(codes) > 3:
        with np.errstate(over="ignore"):
            key = codes[:-2] * np.uint64(0x9E3779B97F4A7C15)
            key = (key ^ (key >> np.uint64(29))) + codes[1:-1]
            key = key * np.uint64(0xBF58476D1CE4E5B9)
            key = (key ^ (key >> np.uint64(32))) + codes[2:]
            key = key * np.uint64(0x94D049BB133111EB) + doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = np.flatnonzero(doc[:-2] == doc[2:])
        at = at[np.argsort(key[at])]
        same = key[at[1:]] == key[at[:-1]]
        twice = np.zeros(len(codes), dtype=bool)
        twice[at[1:][same]] = True
        twice[at[:-1][same]] = True
        covered |= twice
        covered[1:] |= twice[:-1]
        covered[2:] |= twice[:-2]
    return np.bincount(doc[covered], minlength=n_docs).astype(np.int64)


def feature_matrix(s: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES, one row per document."""
    words, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_words"] / lines,
        s["n_digits"] / words, s["n_upper"] / words, s["n_distinct_words"] / words, s["n_ended_lines"] / lines,
    ], axis=1).astype(np.float64)


@dataclass(frozen=True)
class Trees:
    """All trees in flat node arrays: a leaf points at itself, so ``depth`` steps reach it from any root."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if len(x):
            node = np.repeat(self.roots[None, :], len(x), 0)
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node].sum(1)
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, signs: tuple[int, ...] = tuple(s for _, s in FEATURES), rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: int = 5) -> Trees:
    """Second-order boosting of the logistic loss over binned features.

    A split on a feature with a sign is taken only if its two children's values follow the sign, and
    the middle of the two bounds all values below them; so each tree, and their sum, is monotone.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, dtype=int)
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    total = np.full(len(x), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        clipped = lambda gs, hs, lo, hi: float(np.clip(gs / (hs + l2), lo, hi))

        def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
            me, gs, hs = len(nodes), g[rows].sum(), h[rows].sum()  # noqa: B023
            value = clipped(gs, hs, lo, hi)  # noqa: B023
            nodes.append([0, np.inf, me, me, value * rate])
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth and len(rows) >= 2 * least:
                gain = lambda a, b, v: 2 * a * v - (b + l2) * v * v
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))  # noqa: B023
                    vl, vr = np.clip(gl / (hl + l2), lo, hi), np.clip((gs - gl) / (hs - hl + l2), lo, hi)
                    won = gain(gl, hl, vl) + gain(gs - gl, hs - hl, vr) - gain(gs, hs, value)
                    won[(nl < least) | (len(rows) - nl < least) | (signs[j] * (vr - vl) < 0)] = -1
                    if won[k := int(np.argmax(won))] > best[0]:
                        best = (won[k], j, k, vl[k], vr[k])
            if best[1] >= 0:
                _, j, k, vl, vr = best
                go = binned[rows, j] <= k
                mid = (vl + vr) / 2
                bound = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[signs[j]]
                nodes[me][:4] = [j, edges[j][k], grow(rows[go], level + 1, *bound[0]), grow(rows[~go], level + 1, *bound[1])]
            return me

        start = len(nodes)
        roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf))
        one = _flat([start], nodes, depth, 0.0)
        total = total + one.log_odds(x)
    return _flat(roots, nodes, depth, base)


def _flat(roots: list[int], nodes: list[list[float]], depth: int, base: float) -> Trees:
    a = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    return Trees(np.array(roots, dtype=np.int64), a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], depth, base)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """id and STATS of every whole text, with good (the trees' probability) where a model is given."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            s = text_stats(texts)
            cols = [pa.array(ids, id_type), *(pa.array(s[k]) for k in STATS)]
            if model:
                cols.append(pa.array(1 / (1 + np.exp(-model.log_odds(feature_matrix(s))))))
            yield pa.RecordBatch.from_arrays(cols, names=["id", *STATS, *(["good"] if model else [])])

    rows = narrow(docs, id=id_col, text=text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{k} long' for k in STATS)}{', good double' if model else ''}")


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_labelled: int = 20_000, **fit) -> Trees:
    """Trees fitted on at most ``max_labelled`` labelled documents (1: good), chosen by the hash of their id.

    Only those ids are broadcast and only their statistics come to the driver, so both are bounded by
    the parameter. Rows whose label or id is null are left out; without both labels the trees are empty.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").orderBy(F.xxhash64("id"), "id", "y").limit(max_labelled).dropDuplicates(["id"])
    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["id"], "left_semi")
    got = document_stats(rows, id_col, text_col).join(F.broadcast(chosen), "id").orderBy("id", *STATS).toPandas()
    s = {k: got[k].to_numpy() for k in STATS}
    return fit_trees(feature_matrix(s), got["y"].to_numpy(dtype=float), **fit)


def quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = 50, repeat_percent: int = 50, least_good: float = 0.2) -> DataFrame:
    """One row per document: ``id_col``, STATS, base_failed, good, kept.

    base_failed: fewer than ``least_words`` words, or more than ``repeat_percent`` per cent of them in
    repeated windows. Other documents are kept unless the trees give them less than ``least_good``, a
    low bar, so that documents in doubt stay. A null text has no words and fails. Repeated rows are
    judged one by one, null ids are passed through, and only the two named columns are read.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return document_stats(docs, id_col, text_col, model).select(
        F.col("id").alias(id_col), *STATS, failed.alias("base_failed"), "good", (~failed & (F.col("good") >= least_good)).alias("kept")
    )


def quality_filter(docs: DataFrame, model: Trees, text_col: str = "text", *, least_words: int = 50, repeat_percent: int = 50, least_good: float = 0.2) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns; the texts are judged where they are, without a join."""
    ship_package(docs.sparkSession)

    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column]
            out, at = [np.zeros(0, dtype=bool)], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 2 << 20):
                    size, to = size + len(texts[to]), to + 1
                s = text_stats(texts[at:to])
                failed = (s["n_words"] < least_words) | (100 * s["n_repeat_words"] > repeat_percent * s["n_words"])
                out.append(~failed & (1 / (1 + np.exp(-model.log_odds(feature_matrix(s)))) >= least_good))
                at = to
            yield pd.Series(np.concatenate(out))

    return docs.where(F.pandas_udf(kept, "boolean")(docs[text_col]))
