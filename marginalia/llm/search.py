"""Ranked lexical search over compressed postings, document at a time.

*Index.* Texts are tokenised where they lie. A task cuts its documents into shards of bounded size, sorts a shard's documents by
id and writes, as one row, the postings of all its terms: places of documents as differences and counts, both as variable-length
integers. The corpus statistics are sums over the shards.

*Search.* The queries come in blocks of bounded size to every shard. A query's posting lists are merged by a heap over their
next documents, so that each document is scored once, and a heap of bounded size, keyed by score and then id, keeps the best.
Lists that together can't lift a document over the worst of the heap aren't merged but asked about the documents of the
others; the bounds are the lists' true maxima, so nothing is lost. A task goes on with its heaps from shard to shard, and the
heaps of all tasks are merged in two steps.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import narrow, text_chunks
from marginalia.runtime import materialise, ship_package

#: A term is a run of ASCII letters and digits and of all bytes of other characters; only A-Z are lower-cased.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as variable-length bytes: seven bits each, lowest first, the high bit set on all but the last."""
    values = values.astype(np.uint64)
    length = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 64, 7):
        length += values >= np.uint64(1 << bits)
    ends = np.cumsum(length)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    at, left, open_ = ends - length, values, np.arange(len(values))
    while len(open_):
        more = left >= np.uint64(128)
        out[at] = (left & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        at, left, open_ = at[more] + 1, left[more] >> np.uint64(7), open_[more]
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """What ``pack`` was given, as 64-bit integers."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    last = raw < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(raw)]])))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


INDEX = "shard string, ids array<{id}>, lengths binary, terms array<binary>, sizes binary, places binary, counts binary, n_docs long, n_terms long"


def _shard(name: str, docs: list[tuple], id_type: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
    """One row of the index; docs: (id, length, {term: count}), null ids last."""
    docs.sort(key=lambda d: (d[0] is None, 0 if d[0] is None else d[0]))
    lists: dict[bytes, list[int]] = defaultdict(list)
    for place, (_, _, counts) in enumerate(docs):
        for term, count in counts.items():
            lists[term].append(place << 32 | count)
    terms = sorted(lists)
    sizes = np.array([len(lists[t]) for t in terms], dtype=np.int64)
    flat = np.fromiter((x for t in terms for x in lists[t]), dtype=np.int64, count=int(sizes.sum()))
    places, counts = flat >> 32, flat & 0xFFFFFFFF
    steps = np.diff(places, prepend=0)
    steps[(np.cumsum(sizes) - sizes)] = places[np.cumsum(sizes) - sizes]
    lengths = np.array([n for _, n, _ in docs], dtype=np.int64)
    cells = [name, [d[0] for d in docs], pack(lengths), terms, pack(sizes), pack(steps), pack(counts), int((lengths > 0).sum()), int(lengths.sum())]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, schema.types, strict=True)], schema=schema)


def build_index(docs: DataFrame, terms: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", *, shard_postings: int = 1 << 19, shard_docs: int = 1 << 16) -> DataFrame:
    """One row per shard: its documents' ids and lengths, and per term the compressed postings.

    Every row of ``docs`` is indexed, those without a term with length 0. Given ``terms``, only their postings are kept;
    lengths and sums count all terms all the same. A shard ends at ``shard_postings`` postings or ``shard_docs`` documents; one longer
    document fits in one shard still. Ids that repeat are documents of their own; null ids and texts are allowed (a null text is empty).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship_package(spark)
    rows = narrow(docs, id=id_col, text=text_col)
    id_type = to_arrow_type(rows.schema["id"].dataType)
    kinds = [pa.string(), pa.list_(id_type), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    layout = INDEX.format(id=rows.schema["id"].dataType.simpleString())
    schema = pa.schema(list(zip([c.split()[0] for c in layout.split(", ")], kinds, strict=True)))
    wanted = spark.sparkContext.broadcast(terms) if terms is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep, task = wanted.value if wanted else None, TaskContext.get().partitionId()
        held, postings, made = [], 0, 0
        for ids, texts in text_chunks(batches):
            for i, text in zip(ids, texts, strict=True):
                found = terms_of(text)
                counts = Counter(found) if keep is None else Counter(filter(keep.__contains__, found))
                held.append((i, len(found), counts))
                postings += len(counts)
                if postings >= shard_postings or len(held) >= shard_docs:
                    yield _shard(f"{task}-{made}", held, id_type, schema)
                    held, postings, made = [], 0, made + 1
        if held:
            yield _shard(f"{task}-{made}", held, id_type, schema)

    return rows.mapInArrow(run, layout)


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) over all shards; the shards' sizes are unpacked in the task, and a task's terms are added before the shuffle."""
    ship_package(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, sizes in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([terms.values, pa.array(unpack(sizes.as_py()))], names=["term", "df"])

    return index.select("terms", "sizes").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """A shard's lists, unpacked: per term the places of its documents and the score that each place gets from a weight of one."""

    def __init__(self, row: dict, mean_terms: tuple[int, int], wanted: set[bytes]) -> None:
        n_docs, n_terms = mean_terms
        self.ids = row["ids"]
        lengths = unpack(row["lengths"]).tolist()
        damping = np.array([10 + (90 * n * n_docs) // n_terms for n in lengths], dtype=np.int64)
        sizes, steps, counts = unpack(row["sizes"]), unpack(row["places"]), unpack(row["counts"])
        ends = np.cumsum(sizes)
        places = np.cumsum(steps)
        if len(sizes):
            places -= np.repeat(np.concatenate([[0], places[ends[:-1] - 1]]), sizes)
        share = (1_000_000_000 * counts) // (1000 * counts + 8 * damping[places]) if len(places) else counts
        self.lists = {t: (places[e - s : e], share[e - s : e]) for t, s, e in zip(row["terms"], sizes.tolist(), ends.tolist(), strict=True) if t in wanted}
        self.unrolled: dict[bytes, tuple[list[int], list[int], int]] = {}

    def list_of(self, term: bytes) -> tuple[list[int], list[int], int] | None:
        """Places, their scores for a weight of one, and the largest of these."""
        if term not in self.unrolled and term in self.lists:
            places, share = self.lists[term]
            self.unrolled[term] = places.tolist(), share.tolist(), int(share.max())
        return self.unrolled.get(term)

    def search(self, query: list[tuple[bytes, int]], best: list[tuple], k: int) -> None:
        """Merges into ``best``, a heap of at most ``k`` (score, falling id, place in the heap's order, id)."""
        lists = [(w * got[2], got[0], got[1], w) for term, w in query if (got := self.list_of(term)) and w > 0]
        lists.sort(key=lambda x: (x[0], len(x[1])))
        below = [0]  # below[i]: what the i lists of the smallest bounds can add at most
        for bound, *_ in lists:
            below.append(below[-1] + bound)
        worst = best[0][0] if len(best) == k else 0
        asked = 0  # lists before this one can't lift a document into the heap by themselves
        while asked < len(lists) and below[asked + 1] < max(worst, 1):
            asked += 1
        width = len(lists)
        at = [0] * width
        merge = [lists[i][1][0] * width + i for i in range(asked, width)]
        heapq.heapify(merge)
        while merge:
            place = merge[0] // width
            score = 0
            while merge and merge[0] // width == place:
                i = merge[0] % width
                _, places, share, w = lists[i]
                score += w * share[at[i]]
                at[i] += 1
                if i >= asked and at[i] < len(places):
                    heapq.heapreplace(merge, places[at[i]] * width + i)
                else:
                    heapq.heappop(merge)
            for i in range(asked - 1, -1, -1):
                if score + below[i + 1] < worst:
                    break
                _, places, share, w = lists[i]
                j = at[i] = bisect_left(places, place, at[i])
                if j < len(places) and places[j] == place:
                    score += w * share[j]
            else:
                if score > 0 and score >= worst:
                    entry = (score, *_falling(self.ids[place]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    if len(best) == k and best[0][0] > worst:
                        worst = best[0][0]
                        before = asked
                        while asked < width and below[asked + 1] < worst:
                            asked += 1
                        if asked > before:
                            merge = [x for x in merge if x % width >= asked]
                            heapq.heapify(merge)


def _falling(i) -> tuple:
    """So that of equal scores the smaller id is the larger entry; null ids are the smallest."""
    return (False, 0) if i is None else (True, -i)


def _best(rows: DataFrame, k: int, *salt: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item", *salt).orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def weighted_terms(items: DataFrame, frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(item, term, w) of (item, term) rows: w falls with the documents that hold the term; terms that none holds are left out."""
    return items.join(frequencies, "term").select("item", "term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("w"))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item, term) of the items' whole texts."""
    ship_package(items.sparkSession)
    rows = narrow(items, item=id_col, text=text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["item"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            found = [(i, t) for i, text in zip(ids, texts, strict=True) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], id_type), pa.array([t for _, t in found], pa.binary())], names=["item", "term"])

    return rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, term binary").distinct()


def ranked(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, k: int = 10, block_terms: int = 500_000, salts: int = 64, **index,
) -> DataFrame:
    """``item_col``, rank (from 1), ``id_col`` and score of each item's ``k`` best documents with a score above 0.

    The score is the sum over the item's terms, once each, of w * ((10**9 * tf) div (1000 * tf + 8 * m)) in whole numbers; equal
    scores go by ascending id. Integer ids.

    Items come in blocks of about ``block_terms`` (item, term) rows, dealt by hash; only one block is on the driver and the executors at a
    time, and the index is searched once a block. Where all items fit in one block, only their terms' postings are kept.

    A null or empty text has no terms: it is never found, and an item without terms finds nothing. Rows that repeat a document's id are
    documents of their own and may both be ranked. Item rows that share an id are one item with the terms of all. Null ids are ids of their own;
    a null document id comes last among equal scores. Empty tables give an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    pairs = materialise(item_terms(items, item_col, item_text_col), "item-terms")
    blocks = max(1, -(-pairs.count() // block_terms))
    only = {bytes(r.term) for r in pairs.select("term").distinct().collect()} if blocks == 1 else None
    built = materialise(build_index(docs, only, id_col, text_col, **index), "shards")
    totals = built.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    frequencies = document_frequencies(built)
    if blocks > 1:
        frequencies = frequencies.join(pairs.select("term").distinct(), "term", "left_semi")
    weighted = materialise(weighted_terms(pairs, frequencies, totals.n).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "item-weights")
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    parts = []
    for block in range(blocks):
        queries: dict = defaultdict(list)
        for r in weighted.where(F.col("block") == block).toLocalIterator():
            queries[r.item].append((bytes(r.term), r.w))
        found = _searched(built, {i: sorted(q) for i, q in queries.items()}, (totals.n, totals.l), k, item_kind, kind)
        first = _best(found.withColumn("salt", F.pmod("task", F.lit(salts))), k, "salt").select("item", "id", "score")
        parts.append(materialise(first, "ranked") if blocks > 1 else first)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return _best(whole, k).select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _searched(index: DataFrame, queries: dict, totals: tuple[int, int], k: int, item_kind: str, id_kind: str) -> DataFrame:
    """(task, item, id, score): each task's best of its shards."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_type

    sent = index.sparkSession.sparkContext.broadcast((queries, {t for q in queries.values() for t, _ in q}))
    item_type, id_type = (to_arrow_type(_parse_datatype_string(x)) for x in (item_kind, id_kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        queries, wanted = sent.value
        best: dict = {i: [] for i in queries}
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard(batch.slice(r, 1).to_pylist()[0], totals, wanted)
                for item, query in queries.items():
                    shard.search(query, best[item], k)
        rows = [(item, -i if known else None, score) for item, heap in best.items() for score, known, i in heap]
        task = pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([task, pa.array([x[0] for x in rows], item_type), pa.array([x[1] for x in rows], id_type), pa.array([x[2] for x in rows], pa.int64())], names=["task", "item", "id", "score"])

    return index.select("ids", "lengths", "terms", "sizes", "places", "counts").mapInArrow(run, f"task long, item {item_kind}, id {id_kind}, score long")
