"""Repeated-substring dedup: a suffix array of the repeated parts, by bucket-pointer refinement.

A string of ``window`` bytes that occurs twice has, in both places, the same *anchor*: the 32-byte gram of
least hash in it (the leftmost of equals). So windows are grouped by anchor, a group holding all occurrences of any
window in it. Consecutive windows with one anchor form a *run*; a text has about one for every 35 bytes.

1. Each task cuts its texts into runs. Runs of equal bytes and equal place of the anchor are copies: all but the
   first are covered. Copies within a task are settled there, before the shuffle.
2. Runs meet by anchor, sorted; what is left of copies is settled in one streaming pass. An anchor with runs of
   different bytes asks for their text.
3. Those runs' suffixes are sorted by bucket-pointer refinement: buckets of 8-byte grams, then, pass by pass, the
   buckets of two suffixes or more are sorted on the bucket pointers of the suffixes 8, 16, 32 and at last
   36 bytes on, each pass reading the pointers that the one before has made finer. Suffixes in one
   bucket then share 100 bytes, and all but the first are covered. An anchor with more runs than
   ``most_runs`` goes another exact way: its windows are grouped by their MD5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import narrow, text_chunks
from marginalia.runtime import materialise, ship_package

GRAM, POSITION_BITS = 32, 22
BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, up to n; kept between calls."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b, dtype=np.uint64)])) for b in (BASE, INVERSE))
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def runs(parts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """part, anchor hash, bytes' hash, first window, anchor's place minus first and last window, of each run.

    The parts together must be shorter than 2**22 bytes.
    """
    text = np.frombuffer(b"".join(parts), dtype=np.uint8)
    n, wide = len(text), window - GRAM + 1
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    ends = np.cumsum(sizes)
    part = np.repeat(np.arange(len(parts)), sizes)
    valid = np.arange(n) + window <= np.repeat(ends, sizes)
    if not valid.any():
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:n])])
        gram = mixed((total[GRAM:] - total[:-GRAM]) * down[: n + 1 - GRAM])
    place = np.uint64((1 << POSITION_BITS) - 1)
    low = (gram & ~place) | np.arange(len(gram), dtype=np.uint64)
    step = 1
    while 2 * step <= wide:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < wide:
        low = np.minimum(low[: len(low) - (wide - step)], low[wide - step :])
    at = np.flatnonzero(valid)
    anchor = (low[at] & place).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (part[at[1:]] != part[at[:-1]])])
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    anchor = anchor[new]
    with np.errstate(over="ignore"):
        content = mixed((total[last + window] - total[first]) * down[first] + ((anchor - first) * 256 + (anchor - last)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    starts = ends - sizes
    return part[first], gram[anchor].view(np.int64), content.view(np.int64), first - starts[part[first]], anchor - first, anchor - last


def refined_buckets(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position the pointer of its suffix's bucket, suffixes being sorted on their first ``depth`` bytes.

    A pointer is the place in suffix order where the bucket starts. Bytes past the end count as zeros, so
    only positions with ``depth`` bytes to go should be compared.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 8, dtype=np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(min(8, depth)):
        key = (key << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    order = np.argsort(key)
    pointer = np.zeros(n + depth, dtype=np.int64)
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, dtype=bool)
    pointer[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) if n else 0
    done = min(8, depth)
    while done < depth:
        ahead = min(done, depth - done)
        alone = head & np.concatenate([head[1:], [True]])
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        suffix = order[slots]
        sort_on = (pointer[suffix] << 32) | pointer[suffix + ahead]
        by = np.argsort(sort_on)
        order[slots], sorted_key = suffix[by], sort_on[by]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        pointer[order[slots]] = np.maximum.accumulate(np.where(new, slots, 0))
        head[slots] = new
        done += ahead
    return pointer[:n]


def covered_windows(doc: np.ndarray, first: np.ndarray, contexts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, end of the bytes covered in these runs by windows that an earlier one among them equals."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    many = sizes - window + 1
    base = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(contexts)), many)
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    bucket = refined_buckets(np.frombuffer(b"".join(contexts), dtype=np.uint8), window)[base[own] + inner]
    d, p = doc[own], first[own] + inner
    order = np.lexsort((p, d, bucket))
    b, od, op = bucket[order], d[order], p[order]
    head = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, dtype=bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(b)), 0))
    covered = np.zeros(len(b), dtype=bool)
    covered[order] = (od != od[lead]) | (op != op[lead])
    at = np.flatnonzero(covered)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]])]) if len(at) else np.zeros(0, dtype=bool)
    start = at[new]
    end = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])] if len(at) else at
    return d[start], p[start], p[end] + window


def _cut(docs: DataFrame, window: int, most_held: int = 200_000) -> DataFrame:
    """(id, text) -> h, c, id, first, up, down of each run that the task itself doesn't settle, and, with down = -1
    and up the length, of the stretches that it found covered, which get an h of their own to spread."""
    reach = (1 << POSITION_BITS) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for ids, texts in text_chunks(batches):
            pieces = [(i, off, t[off : off + reach + window - 1]) for i, t in zip(ids, texts, strict=True) for off in range(0, max(len(t) - window + 1, 0), reach)]
            at = 0
            while at < len(pieces):
                size, to = len(pieces[at][2]), at + 1
                while to < len(pieces) and size + len(pieces[to][2]) < 2 * reach - window:
                    size, to = size + len(pieces[to][2]), to + 1
                yield settle(pieces[at:to], best)
                at = to
            if len(best) > most_held:
                best.clear()

    def settle(pieces: list[tuple[int, int, bytes]], best: dict) -> pa.RecordBatch:
        part, h, c, first, up, down = runs([p[2] for p in pieces], window)
        ids = np.array([p[0] for p in pieces], dtype=np.int64)[part]
        first = first + np.array([p[1] for p in pieces], dtype=np.int64)[part]
        order = np.lexsort((first, ids, c, h))
        h, c, ids, first, up, down = (x[order] for x in (h, c, ids, first, up, down))
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, dtype=bool)
        gone = ~new
        heads = np.flatnonzero(new)
        again = np.diff(np.concatenate([heads, [len(h)]])) > 1
        known = np.zeros(0, dtype=np.int64) if not best else heads[np.isin(h[heads], np.fromiter((k[0] for k in best), dtype=np.int64, count=len(best)))]
        for j in known.tolist():
            me = (int(ids[j]), int(first[j]))
            seen = best.get((int(h[j]), int(c[j])))
            if seen is not None:
                if seen < me:
                    gone[j] = True
                else:
                    best[int(h[j]), int(c[j])] = me
        for j in heads[again].tolist():
            best.setdefault((int(h[j]), int(c[j])), (int(ids[j]), int(first[j])))
        by = np.flatnonzero(gone)
        by = by[np.lexsort((first[by], ids[by]))]
        start, end, of = first[by], first[by] + up[by] - down[by] + window, ids[by]
        # runs go up within a text, and so do their ends
        apart = np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] > end[:-1])]) if len(by) else np.zeros(0, dtype=bool)
        close = np.concatenate([np.flatnonzero(apart)[1:] - 1, [len(by) - 1]]) if len(by) else by
        start, end, of = start[apart], end[close], of[apart]
        own = mixed(mixed(of.view(np.uint64)) + start.view(np.uint64)).view(np.int64)
        stay = ~gone
        cols = [(h, own), (c, own), (ids, of), (first, start), (up, end - start), (down, np.full(len(of), -1))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[stay], b]).astype(np.int64 if k < 4 else np.int32)) for k, (a, b) in enumerate(cols)], names=["h", "c", "id", "first", "up", "down"])

    return docs.mapInArrow(run, "h long, c long, id long, first long, up int, down int")


def _meet(cut: DataFrame, window: int, most_runs: int) -> DataFrame:
    """Runs, sorted by (h, c, id, first) within a task -> covered stretches (kind 0) and requests for text (1, 2).

    State between batches is the last run, its copies' first, and the runs of the last anchor up to
    ``most_runs``; with more, ``wide`` requests are made for all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # distinct runs of the last anchor, as far as they may be asked for again
        many, last_h, last_c = 0, None, None
        for batch in batches:
            h, c, ids, first, up, down = (batch.column(i).to_numpy() for i in range(6))
            n = len(h)
            if not n:
                continue
            anchor_starts = np.concatenate([[h[0] != last_h], h[1:] != h[:-1]])
            fresh = anchor_starts | np.concatenate([[c[0] != last_c], c[1:] != c[:-1]])
            done = down < 0
            reps = np.flatnonzero(fresh & ~done)
            asked, wide = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            before: list[tuple] = []  # (row, wide) of earlier batches
            bounds = np.searchsorted(reps, np.concatenate([[0], np.flatnonzero(anchor_starts), [n]]))
            several = np.flatnonzero(np.diff(bounds) > 1)
            for k in sorted({0, *several.tolist(), len(bounds) - 2}):
                if k:
                    held, many = [], 0
                mine = reps[bounds[k] : bounds[k + 1]]
                total = many + len(mine)
                if total > 1:
                    before += [(r, False) for r in held] if many == 1 else []
                    asked[mine[: max(0, most_runs - many)]] = True
                    if total > most_runs:
                        if many <= most_runs:
                            before += [(r, True) for r in held]
                            wide[mine] = True
                        else:
                            wide[mine] = True
                if many <= most_runs:
                    held += [(h[j], ids[j], first[j], up[j] - down[j] + window) for j in mine[: most_runs + 1 - many].tolist()]
                many = total
            last_h, last_c = h[-1], c[-1]
            cols: list[list] = [[], [], [], [], []]
            length = np.where(done, up, up - down + window)
            for kind, rows in ((0, ~fresh | done), (1, asked), (2, wide)):
                for x, y in zip(cols, (h, ids, first, length), strict=False):
                    x.append(y[rows])
                cols[4].append(np.full(int(rows.sum()), kind, dtype=np.int32))
            for r, w in before:
                for x, y in zip(cols, (*r, 1 + w), strict=True):
                    x.append(np.array([y]))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x).astype(np.int64)) for x in cols[:3]), *(pa.array(np.concatenate(x).astype(np.int32)) for x in cols[3:])], names=["h", "id", "first", "length", "kind"])

    return cut.mapInArrow(run, "h long, id long, first long, length int, kind int")


def _sorted_suffixes(contexts: DataFrame, window: int, budget: int = 2 << 20) -> DataFrame:
    """(h, id, first, context), sorted by h within a task -> id, start, end that bucket-pointer refinement covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h: list = []
        ids: list = []
        first: list = []
        text: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            got = covered_windows(np.array(ids, dtype=np.int64), np.array(first, dtype=np.int64), text, window)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], names=["id", "start", "end"])

        for batch in batches:
            for a, b, c, d in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size > budget and a != h[-1]:
                    yield flush()
                    h, ids, first, text, size = [], [], [], [], 0
                h.append(a)
                ids.append(b)
                first.append(c)
                text.append(d)
                size += len(d)
        if text:
            yield flush()

    return contexts.mapInArrow(run, "id long, start long, end long")


def _wide_windows(contexts: DataFrame, window: int) -> DataFrame:
    """The exact way for an anchor with very many runs: windows grouped by MD5, all but the first covered."""
    many = F.octet_length("context") - window
    each = contexts.select("id", "first", "context", F.explode(F.sequence(F.lit(0), many)).alias("j"))
    each = each.select("id", (F.col("first") + F.col("j")).alias("start"), F.unhex(F.md5(F.expr(f"substring(context, j + 1, {window})"))).alias("w"))
    lead = each.groupBy("w").agg(F.min(F.struct("id", "start")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    met = each.join(lead, "w").where((F.col("id") != F.col("lead.id")) | (F.col("start") != F.col("lead.start")))
    return met.select("id", "start", (F.col("start") + window).alias("end"))


def _by_document(docs: DataFrame, rows: DataFrame, value) -> DataFrame:
    """``docs`` with the array ``value`` of each one's rows. The texts are shuffled at every size: what is asked of
    them grows with the corpus, so it is not sent to them."""
    return docs.join(rows.groupBy("id").agg(F.collect_list(value).alias("found")), "id", "left")


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with unique long ids. Only where ids repeat or are null are rows numbered anew, in the order
    of (id, text hash), null last; then the second result maps them back."""
    ids = rows.agg(F.count("*").alias("n"), F.count("id").alias("known"), F.count_distinct("id").alias("apart")).first()
    if ids.n == ids.known == ids.apart:
        return rows.select(F.col("id").cast("long"), "text"), None
    ordered = rows.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"))
    own = materialise(ordered.select(F.monotonically_increasing_id().alias("number"), "id", "text"), "suffix-numbered")
    return own.select(F.col("number").alias("id"), "text"), own.select("number", "id")


def covered(rows: DataFrame, *, window: int = 100, most_runs: int = 20_000) -> DataFrame:
    """(id, text) with unique long ids and no nulls -> id, start, end of covered bytes; they may overlap."""
    ordered = _cut(rows, window).repartition("h").sortWithinPartitions("h", "c", "id", "first")
    met = materialise(_meet(ordered, window, most_runs), "suffix-met")
    settled = met.where("kind = 0").select("id", F.col("first").alias("start"), (F.col("first") + F.col("length")).alias("end"))
    asked = met.where("kind > 0").select("id", "h", "first", F.col("length").alias("size"), "kind")
    texts = _by_document(rows, asked, F.struct("h", "first", "size", "kind")).where("found IS NOT NULL")
    spelled = texts.select("id", F.col("text").cast("binary").alias("text"), F.explode("found").alias("r"))
    spelled = spelled.select("r.h", "id", "r.first", F.expr("substring(text, int(r.first) + 1, r.size)").alias("context"), "r.kind")
    spelled = materialise(spelled, "suffix-contexts")
    sorted_ = _sorted_suffixes(spelled.where("kind = 1").select("h", "id", "first", "context").repartition("h").sortWithinPartitions("h"), window)
    wide = _wide_windows(spelled.where("kind = 2"), window)
    return materialise(settled.union(sorted_).union(wide), "suffix-covered")


def suffix_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 100, **options,
) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_removed, spans (maximal removed runs, array of start and
    end in bytes), kept (the remaining bytes).

    A byte is removed if a ``window``-byte string over it also starts earlier: in a document of smaller id, or
    earlier in the same one; strings are those of the input. Null is the empty text. Rows that repeat an id
    are separate documents, in the order of their texts' hashes; null ids come last. An empty table gives
    an empty result. Columns other than the two named ones aren't read; ids are whole numbers.
    """
    ship_package(docs.sparkSession)
    rows, names = _numbered(narrow(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))))
    found = covered(rows, window=window, **options)
    merged = materialise(_maximal(found), "suffix-merged")
    met = _by_document(rows, merged, F.struct("start", "end")).select("id", F.col("text").cast("binary").alias("text"), F.transform(F.sort_array("found"), lambda s: s["start"]).alias("s"), F.transform(F.sort_array("found"), lambda s: s["end"]).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                few = batch.slice(at, 256)
                kept, gone = [], []
                for t, s, e in zip(*(few.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    s, e = s or [], e or []
                    kept.append(b"".join(t[a:b] for a, b in zip([0, *e], [*s, len(t)], strict=True)))
                    gone.append(len(t) - len(kept[-1]))
                spans = pa.array([[{"start": a, "end": b} for a, b in zip(s or [], e or [], strict=True)] for s, e in zip(few.column(2).to_pylist(), few.column(3).to_pylist(), strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([len(k) + g for k, g in zip(kept, gone, strict=True)], pa.int64()), pa.array(gone, pa.int64()), spans, pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "spans", "kept"])

    out = met.mapInArrow(run, "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    if names is not None:
        out = out.withColumnRenamed("id", "number").join(names, "number").select("id", "n_bytes", "n_removed", "spans", "kept")
    return out.withColumnRenamed("id", id_col)


def _maximal(found: DataFrame) -> DataFrame:
    """Stretches of bytes -> maximal runs; stretches that touch are one. A document's are few for its length."""
    in_text = Window.partitionBy("id").orderBy("start", "end")
    before = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("apart", (before.isNull() | (F.col("start") > before)).cast("int"))
    numbered = marked.withColumn("run", F.sum("apart").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
