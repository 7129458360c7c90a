"""Best-fit packing with bound-certified repacking."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import narrow, text_chunks
from marginalia.runtime import materialise, ship_package

class WordEncoder:
    """Ids of a tokenizer that never joins across white space, with bounded caches.

    A text's ids are those of its white-space separated words in a row. Arrow splits the texts of a batch and numbers
    their distinct words, so Python looks at each distinct word of a batch once and numpy puts the ids together. A word
    of ASCII letters and punctuation that is new is cut further by ``PIECES``, the fixed pre-tokenizer pattern, as pieces recur
    more than words do; any other word goes to the tokenizer whole. Caches that get full start anew.
    """

    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+")
    PLAIN = re.compile(r"[!-;=-@\[-~\xdf-\xf6\xf8-\xff]+\Z")

    def __init__(self, path: str, most_words: int = 700_000, most_pieces: int = 500_000):
        from tokenizers import Tokenizer

        # the task has one core; the tokenizer's own threads would only wait for it
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.most_words, self.most_pieces = most_words, most_pieces
        self.pieces: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.ids, self.starts = bytearray(), array("q", [0, 0])

    def _learn(self, words: list[str]) -> None:
        cut = [self.PIECES.findall(w) if self.PLAIN.match(w) else [w] for w in words]
        if len(self.pieces) > self.most_pieces:
            self.pieces = {}
        new = list(set(chain.from_iterable(cut)).difference(self.pieces))
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.pieces.update(zip(new, (array("I", e.ids).tobytes() for e in found), strict=True))
        piece = self.pieces.__getitem__
        first = len(self.number)
        for c in cut:
            self.ids += piece(c[0]) if len(c) == 1 else b"".join(map(piece, c))
            self.starts.append(len(self.ids) >> 2)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin, with the end of the last."""
        lower = pa.array([t if b"<|" in t else t.lower() for t in texts], pa.large_binary()).view(pa.large_string())
        split = pc.ascii_split_whitespace(lower)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.number) > self.most_words:
            self._forget()
        self._learn([w for w in words if w not in self.number])
        starts, ids = np.frombuffer(self.starts, dtype=np.int64), np.frombuffer(self.ids, dtype=np.uint32)
        number = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))[coded.indices.to_numpy()]
        begin = starts[number]
        ends = np.concatenate([[0], np.cumsum(starts[number + 1] - begin)])
        # the place of each id in the store: its own place, less that of its word's first id, plus the word's start there
        at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], np.diff(ends))
        out, bounds = ids[at], ends[split.offsets.to_numpy()]
        del starts, ids
        return out, bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every whole text, closed by id 0 and cut only beyond ``capacity``."""
    ship_package(docs.sparkSession)
    rows = narrow(docs, id=id_col, text=text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for ids, texts in text_chunks(batches, 8 << 20):
            out: list[tuple] = []
            flat, bounds = enc.encode(texts)
            flat = np.insert(flat, bounds[1:], 0).astype("<u4", copy=False)
            bounds = (bounds + np.arange(len(bounds))).tolist()
            view = memoryview(flat).cast("B")
            for i, begin, end in zip(ids, bounds, bounds[1:], strict=False):
                for k, at in enumerate(range(begin, end, capacity)):
                    stop = min(at + capacity, end)
                    out.append((i, k, at - begin, stop - at, zlib.crc32(view[4 * at : 4 * stop])))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """``bound_of_counts`` of a list of sizes."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The best bound on bins from two families of dual feasible functions, in whole numbers.

    A dual feasible function maps sizes to sizes so that no full bin gets over the capacity; hence
    the images' total, rounded up, bounds the bins. The first family drops sizes below e and lifts those
    over capacity - e to a whole bin; the second rounds (k + 1) * size down to whole bins, in k parts.
    """
    if not count.any():
        return 0
    size = np.arange(capacity + 1, dtype=np.int64)
    n, mass = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(0, capacity // 2 + 1)
    low = np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    lifted = (n[-1] - n[capacity - e]) * capacity + mass[capacity - e] - low
    best = int(-(-lifted.max() // capacity))
    for k in range(1, 21):
        whole, rest = np.divmod((k + 1) * size, capacity)
        # in units of capacity * k: exact multiples keep their size
        image = np.where(rest == 0, k * size, whole * capacity)
        best = max(best, int(-(-(image * count).sum() // (capacity * k))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Open bins wait by free space; a bit mask of
    the spaces at hand finds the tightest one in a few word operations."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = mask >> need
        if fit:
            free = need + (fit & -fit).bit_length() - 1
            b = waiting[free].pop()
            if not waiting[free]:
                mask ^= 1 << free
        else:
            free, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - free
        if free > need:
            waiting[free - need].append(b)
            mask |= 1 << (free - need)
    return bins, offsets, used


PLACE = "id {id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, settled boolean"


def pack(pieces: DataFrame, *, capacity: int = 2048, group_rows: int = 50_000, rounds: int = 4, salt: int = 7) -> DataFrame:
    """The columns of ``pieces`` (see ``pieces_of``) with sequence_id and offset.

    Pieces are dealt by hash to groups of about ``group_rows``; each is packed best-fit decreasing and
    its bin count is held against ``lower_bound``. A certified group keeps all bins but its emptiest;
    a group with a gap keeps only its full ones. What is left is exchanged: dealt anew among fewer groups
    and packed again, until a round saves no bin or ``rounds`` have passed. So the sequences in use beyond the
    bound come down to those of the last exchange, which ``certificate`` tells. Memory is that of one group; no bin crosses groups.

    Every length must be from 1 to ``capacity``. Repeated rows are packed one by one, an empty table
    gives an empty result, and a null id is passed through.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    schema = PLACE.format(id=pieces.schema["id"].dataType.simpleString())

    def place(turn: int):
        def run(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by([("id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
            lengths = t["length"].to_numpy()
            bins, offsets, used = best_fit_decreasing(lengths, capacity)
            fill = np.bincount(bins, lengths, minlength=used)
            settled = fill >= capacity
            if used == lower_bound(lengths, capacity):
                settled[:] = True
                settled[int(np.argmin(fill))] = fill.min() >= capacity
            number = (turn << 58) | (key[0].as_py() << 30)
            return pa.table([*(t[c] for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(bins + number), pa.array(offsets), pa.array(settled[bins])], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "settled"])

        return run

    open_, done = pieces, []
    for turn in range(rounds):
        n = open_.count()
        if not n and turn:
            break
        groups = max(1, -(-n // group_rows))
        dealt = open_.withColumn("grp", F.pmod(F.xxhash64("id", "piece", F.lit(salt + turn)), F.lit(groups)))
        placed = materialise(dealt.groupBy("grp").applyInArrow(place(turn), schema), "pack-round")
        if turn and placed.select("sequence_id").distinct().count() >= before:
            break
        done.append(placed.where("settled"))
        last = placed.where("NOT settled")
        before = last.select("sequence_id").distinct().count()
        open_ = last.drop("sequence_id", "offset", "settled")
    out = last
    for d in done:
        out = out.unionByName(d)
    return out.drop("settled") if done else spark.createDataFrame([], schema).drop("settled")


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """The sequences in use, and a lower bound on those of any packing. What comes to the driver is a count for each length."""
    counts = packed.groupBy("length").count().collect()
    count = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts:
        count[r["length"]] = r["count"]
    return packed.select("sequence_id").distinct().count(), bound_of_counts(count, capacity)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, **options) -> DataFrame:
    """One row per piece of a document: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the one closing id 0. See ``pack`` for the other cases.
    """
    pieces = materialise(pieces_of(docs, tokenizer_path, id_col, text_col, capacity=capacity), "pack-pieces")
    return pack(pieces, capacity=capacity, **options).withColumnRenamed("id", id_col)
