"""LM scoring with a probabilistic suffix tree over words."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import narrow, text_chunks
from marginalia.runtime import materialise, ship_package

#: The end of a text: no word is empty.
END = b""
#: Symbols have 21 bits in an n-gram's key, so three fit a long.
WIDTH = 21


def held_out(doc_id: object) -> bool:
    """Whether the crc32 of the id as text leaves 2 modulo 7; null counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]




def word_counts(rows: DataFrame, most_held: int = 400_000) -> DataFrame:
    """(id, text) -> word, c over the training texts. A task adds up before the shuffle and never holds
    more than about ``most_held`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"])
        for ids, texts in text_chunks(batches):
            for i, t in zip(ids, texts, strict=True):
                if not held_out(i):
                    held.update(tokens(t))
            if len(held) > most_held:
                yield flush()
                held.clear()
        yield flush()

    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def ngram_keys(symbols: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams of known symbols (0 is none) within texts; ``last`` marks the ends of texts."""
    if len(symbols) < n:
        return np.zeros(0, dtype=np.int64)
    m = len(symbols) - n + 1
    key, good = np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
    for k in range(n):
        part = symbols[k : k + m]
        key = (key << WIDTH) | part
        good &= part > 0
        if k < n - 1:
            good &= ~last[k : k + m]
    return key[good]


#: A segment has as many tokens as make the floor's share of it TOLD occurrences, within these bounds: fewer, and chance n-grams reach the
#: share. Its n-grams are sorted in SLICES, so that a task holds four bytes a token and a slice's keys.
TOLD, LEAST_SEGMENT, MOST_SEGMENT, SLICES = 8, 1 << 22, 1 << 25, 4

#: A document's row holds its tokens' numbers; its rows marked rare hold the words without a number, by hash, and how often each stands in it.
NUMBERED = "id {id}, row long, h long, rare boolean, times long, n_tokens long, n_known long, symbols binary"


def numbered(rows: DataFrame, lookup) -> DataFrame:
    """(id, text) -> NUMBERED: the texts are cut into words for the last time, and each word looked up in ``lookup``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["id"].dataType
    names = [c.split()[0] for c in NUMBERED.split(", ")]
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows_of = lookup.value, []

        def without_rows() -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows_of.extend(b.column(2).to_pylist())
                yield b

        for ids, texts in text_chunks(without_rows()):
            numbers, rows_of[: len(ids)] = rows_of[: len(ids)], []
            cells: list[list] = [[] for _ in names]
            row, h, times = [], [], []
            for i, number, t in zip(ids, numbers, texts, strict=True):
                words = tokens(t)
                symbols = np.fromiter(map(table.get, words, repeat(0)), dtype=np.int32, count=len(words))
                unknown = np.flatnonzero(symbols == 0).tolist()
                for cell, x in zip(cells, (i, number, number, False, 0, len(words), len(words) - len(unknown), symbols.tobytes()), strict=True):
                    cell.append(x)
                found = Counter(words[j] for j in unknown)
                row.extend(repeat(number, len(found)))
                h.extend(xxhash.xxh64_intdigest(w, seed=42) for w in found)
                times.extend(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], schema=schema)
            if row:
                none = lambda t: pa.nulls(len(row), t)  # noqa: B023, E731
                hashes = np.array(h, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([none(types[0]), pa.array(row, pa.int64()), pa.array(hashes), pa.array([True] * len(row)), pa.array(times, pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary())], schema=schema)

    return rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, NUMBERED.format(id=kind.simpleString()))


def _strung(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a batch of documents end to end, the marks of their ends, and where each starts."""
    parts = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in column]
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    symbols = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
    last = np.zeros(len(symbols), dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    return symbols, last, np.cumsum(sizes) - sizes


def _bounded(batches: Iterator[pa.RecordBatch], column: int, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``budget`` bytes of that column; a longer value comes alone."""
    for batch in batches:
        sizes = [len(x.as_buffer()) for x in batch.column(column)]
        at, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > budget:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        if at < batch.num_rows:
            yield batch.slice(at)


def _slices(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (SLICES - 1).bit_length())


def ngram_counts(docs: DataFrame, frequent: int, n: int, share: float, candidates=None, segment: int = MOST_SEGMENT) -> DataFrame:
    """key, c of n-grams of the ``frequent`` first symbols over (symbols) of the training texts.

    With ``candidates`` (sorted keys): the exact counts of those, added up by task. Without them a segment tells only of n-grams that
    reach ``share`` of its tokens, so one it doesn't tell of stands in it at most ``unsaid`` times. c is the sum of
    what was told, less the telling segments' ``unsaid``; the row of key -1 has the sum of all segments' ``unsaid``. A
    key's c and that together are the most times that it can stand in all texts, and an n-gram that reaches the share
    of all tokens is told of by some segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if candidates is None else candidates.value
        parts, size = [], 0
        sums = np.zeros(0 if wanted is None else len(wanted), dtype=np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            unsaid = max(0, ceil(share * size) - 1)
            for k in range(SLICES):
                keys = np.concatenate([x[_slices(x) == k] for x in (ngram_keys(symbols.astype(np.int64), last, n) for symbols, last in parts)])
                keys.sort()
                at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
                counts = np.diff(np.concatenate([at, [len(keys)]])) if len(keys) else at
                most = counts >= share * size
                yield pa.RecordBatch.from_arrays([pa.array(keys[at[most]]), pa.array((counts[most] - unsaid).astype(np.int64))], names=["key", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([unsaid], pa.int64())], names=["key", "c"])
            parts.clear()

        for batch in _bounded(batches, 0):
            symbols, last, _ = _strung(batch.column(0))
            symbols = np.where(symbols <= frequent, symbols, 0)
            if wanted is not None:
                keys = ngram_keys(symbols, last, n)
                at, there = _find(wanted, keys, np.ones(len(keys), dtype=bool))
                np.add.at(sums, at[there], 1) if len(sums) > 8 * len(keys) else np.add(sums, np.bincount(at[there], minlength=len(sums))[: len(sums)], out=sums)
                continue
            parts.append((symbols.astype(np.int32), last))
            size += len(symbols)
            if size >= segment:
                yield from flush()
                size = 0
        if parts:
            yield from flush()
        if len(sums):
            seen = sums > 0
            yield pa.RecordBatch.from_arrays([pa.array(wanted[seen]), pa.array(sums[seen])], names=["key", "c"])

    return docs.select("symbols").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


@dataclass(frozen=True)
class SuffixTree:
    """States by depth, and what they keep.

    ``known``: symbol of each common word, the ``frequent`` most common of which can be in a context; ``counts`` by symbol. For depth d,
    ``states[d]`` are the sorted keys of the contexts of d words that passed the test, ``rest[d]`` the weight
    each leaves to its parent, ``moves[d]`` the sorted keys (context, next) and ``gain[d]`` their discounted shares.
    """

    known: dict[bytes, int]
    frequent: int
    counts: np.ndarray
    total: int
    distinct: int
    states: dict[int, np.ndarray]
    rest: dict[int, np.ndarray]
    moves: dict[int, np.ndarray]
    gain: dict[int, np.ndarray]

    @property
    def denominator(self) -> float:
        return float(self.total + self.distinct + 1)

    def log10(self, symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: log10 of its base probability without the denominator for words that
        are not known, and the same under its longest suffix state, to which their base is added later."""
        known = symbols > 0
        base = np.where(known, np.log10(self.counts[symbols] + 1.0), 0.0) - np.log10(self.denominator)
        p = np.where(known, 10.0**base, 1.0)
        first = np.concatenate([[True], last[:-1]]) if len(last) else last
        common = np.where(symbols <= self.frequent, symbols, 0)
        context, usable = np.zeros(len(symbols), dtype=np.int64), np.ones(len(symbols), dtype=bool)
        start = first
        for d in sorted(self.states):
            before = np.concatenate([np.zeros(min(d, len(symbols)), dtype=np.int64), common[:-d]])
            usable = usable & ~start & (before > 0)
            start = np.concatenate([np.ones(min(1, len(start)), dtype=bool), start[:-1]]) | first
            context = context | (before << (WIDTH * (d - 1)))
            at, there = _find(self.states[d], context, usable)
            usable = usable & there
            move, kept = _find(self.moves[d], (context << WIDTH) | common, usable & (common > 0))
            p = np.where(usable, np.where(kept, _take(self.gain[d], move), 0.0) + _take(self.rest[d], at) * p, p)
        score = np.log10(p) - np.where(known, 0.0, np.log10(self.denominator))
        return base, score


def _find(keys: np.ndarray, wanted: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    inside = np.minimum(at, max(len(keys) - 1, 0))
    return inside, among & (keys[inside] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[at] if len(values) else np.zeros(len(at))


def grow(known: dict[bytes, int], frequent: int, counts: np.ndarray, total: int, distinct: int, ngrams: dict[int, tuple[np.ndarray, np.ndarray]], *, least_gain: float, discount: float) -> SuffixTree:
    """Keeps a context where its next words tell it from its parent's.

    The test sums, over the kept next words, how far their count times the log of the ratio of the context's share to
    the parent's goes: the log-likelihood that the longer context saves. A context needs its parent.
    """
    states, rest, moves, gain = {}, {}, {}, {}
    root = lambda w: (counts[w] + 1.0) / (total + distinct + 1.0)
    probability = {0: (lambda context, w: root(w))}
    for d in sorted(n - 1 for n in ngrams):
        keys, c = ngrams[d + 1]
        context, nxt = keys >> WIDTH, keys & ((1 << WIDTH) - 1)
        names, where = np.unique(context, return_inverse=True)
        if d == 1:
            times = counts[names]
        else:
            at = np.searchsorted(ngrams[d][0], names) if len(ngrams[d][0]) else np.zeros(len(names), dtype=int)
            at = np.minimum(at, max(len(ngrams[d][0]) - 1, 0))
            there = (ngrams[d][0][at] == names) if len(ngrams[d][0]) else np.zeros(len(names), dtype=bool)
            times = np.where(there, ngrams[d][1][at] if len(ngrams[d][0]) else 0, 0)
        parent = context & ((1 << (WIDTH * (d - 1))) - 1)
        share = c / np.maximum(times[where], 1)
        saved = np.bincount(where, c * np.log(np.maximum(share, 1e-300) / probability[d - 1](parent, nxt)), minlength=len(names)) if len(names) else np.zeros(0)
        fine = (saved >= least_gain) & (times > 0)
        if d > 1:
            fine &= np.isin(names & ((1 << (WIDTH * (d - 1))) - 1), states[d - 1])
        chosen = fine[where] if len(names) else np.zeros(0, dtype=bool)
        states[d], moves[d] = names[fine], keys[chosen]
        gain[d] = np.maximum(c[chosen] - discount, 0) / times[where[chosen]] if len(names) else np.zeros(0)
        left = np.searchsorted(states[d], context[chosen])
        rest[d] = np.maximum(1 - np.bincount(left, gain[d], minlength=len(states[d])), 1e-9) if len(states[d]) else np.zeros(0)

        def deeper(context: np.ndarray, w: np.ndarray, d: int = d, below=probability[d - 1]) -> np.ndarray:
            at, there = _find(states[d], context, np.ones(len(context), dtype=bool))
            move, kept = _find(moves[d], (context << WIDTH) | w, there)
            p = below(context & ((1 << (WIDTH * (d - 1))) - 1), w)
            return np.where(there, np.where(kept, _take(gain[d], move), 0.0) + _take(rest[d], at) * p, p)

        probability[d] = deeper
    return SuffixTree(known, frequent, counts, total, distinct, states, rest, moves, gain)


def train(rows: DataFrame, **options) -> tuple[SuffixTree, DataFrame]:
    """The tree over (id, text), and the table word, c of all training words; see ``trained``."""
    return trained(rows, **options)[:2]


def trained(rows: DataFrame, *, root: float = 0.003, known_share: float | None = None, state_share: float | None = None, depth: int = 2, least_gain: float = 20.0, discount: float = 0.5) -> tuple[SuffixTree, DataFrame, DataFrame]:
    """The tree over (id, text), the table word, c of all training words, and the ``numbered`` documents.

    An n-gram is asked about from ``root`` times the square root of all tokens on, three at least, and a word is known
    to the tree from a fifth of that on. So what the tree holds grows with the corpus, and yet it may be broadcast: there are at most
    sqrt(tokens) / ``root`` n-grams of a length and five times as many words. Shares of all tokens may be given instead. Counts are over all
    training texts. N-grams are found in two passes over the numbered documents, by segment and then exactly. More frequent words than
    a key has room for (2**21 - 1) are an error, not a collision.
    """
    spark = rows.sparkSession
    ship_package(spark)
    vocabulary = materialise(word_counts(rows), "lm-words")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(3.0, root * float(total or 0) ** 0.5)
    state_share = state_share or least / max(total, 1)
    known_share = known_share or state_share / 5
    # columns, not rows: a Python object for each row would be many times the size
    often = vocabulary.where(F.col("c") >= known_share * total).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    counts = np.concatenate([[0], often.column("c").to_numpy()]).astype(np.int64)
    known = {w: i for i, w in enumerate(often.column("word").to_pylist(), 1)}
    del often
    frequent = int((counts[1:] >= state_share * total).sum())
    if frequent >= 1 << WIDTH:
        raise ValueError(f"{frequent} frequent words; an n-gram's key has room for {(1 << WIDTH) - 1}: raise root")
    docs = materialise(numbered(rows, spark.sparkContext.broadcast(known)), "lm-numbered")
    train_id = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    segment = min(MOST_SEGMENT, max(LEAST_SEGMENT, ceil(TOLD / state_share)))
    # tasks of a segment each: a small task's share of its tokens would be less than one occurrence, and every n-gram would be told of
    texts = docs.where(~F.col("rare") & (F.pmod(train_id, F.lit(7)) != 2)).select("symbols").coalesce(max(1, total // segment))
    column = lambda df, name: df.select(name).toArrow().column(name).to_numpy().astype(np.int64)
    ngrams = {}
    for n in range(2, depth + 2):
        told = materialise(ngram_counts(texts, frequent, n, state_share, segment=segment), "lm-told")
        unsaid = told.where("key = -1").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        candidates = materialise(told.where((F.col("key") >= 0) & (F.col("c") + unsaid >= state_share * total)).select("key"), "lm-candidates")
        if candidates.count() <= 8 / state_share:
            chosen = spark.sparkContext.broadcast(np.sort(column(candidates, "key")))
            exact = ngram_counts(texts, frequent, n, state_share, chosen)
        else:
            # more than may be sent to every task: all n-grams are counted, and the candidates' rows kept
            exact = ngram_counts(texts, frequent, n, 0.0).join(candidates, "key", "left_semi")
        exact = exact.where(F.col("c") >= state_share * total).toArrow().sort_by("key")
        ngrams[n] = exact.column("key").to_numpy().astype(np.int64), exact.column("c").to_numpy().astype(np.int64)
    return grow(known, frequent, counts, total, distinct, ngrams, least_gain=least_gain, discount=discount), vocabulary, docs


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Base is the add-one unigram model over all words of the training texts (those not ``held_out``). The tree
    predicts each token from its longest suffix state: contexts of up to ``depth`` words, each giving its kept
    next words a discounted share and the rest to its parent, down to the base. So the probabilities after any context
    add up to one, and a word that the tree doesn't know costs its base and the weights passed down.

    Known words are scored in place. Each other word of a document goes once, with its number, to the table of
    counts; a word's hash is the key, so that no key is hot: frequent words are known. Nulls are empty
    texts, whose one token is the end. A null id is a training text. Repeated rows count and are scored one by
    one. An empty table gives an empty result; columns other than the two named ones aren't read.
    """
    ship_package(docs.sparkSession)
    rows = narrow(docs, id=id_col, text=text_col)
    tree, vocabulary, numbers = trained(rows, **options)
    sent = docs.sparkSession.sparkContext.broadcast(replace(tree, known={}))
    keep = ("id", "row", "h", "rare", "times", "n_tokens", "n_known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in _bounded(batches, len(keep)):
            symbols, last, starts = _strung(batch.column(len(keep)))
            scored = [np.add.reduceat(x, starts) for x in model.log10(symbols, last)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, scored)], names=[*keep, "base", "score"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbers.select(*keep).schema)
    found = numbers.where("NOT rare").select(*keep, "symbols").mapInArrow(run, f"{types}, base double, score double")
    parts = found.unionByName(numbers.where("rare").select(*keep), allowMissingColumns=True)
    counted = vocabulary.select(F.xxhash64("word").alias("h"), F.lit(True).alias("rare"), "c")
    met = parts.join(counted, ["h", "rare"], "left")
    extra = F.when(F.col("rare"), F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).otherwise(0.0)
    summed = met.groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(extra)).alias("base_score"), (F.max("score") + F.sum(extra)).alias("score"),
    )
    out = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return summed.select(F.col("id").alias(id_col), out.alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
