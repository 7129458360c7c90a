"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marginalia.llm.common import narrow, text_chunks
from marginalia.llm.graph import linked_components
from marginalia.runtime import materialise, scratch, ship_package

#: A chunk is one long: four minimum hashes of 16 bits. One of its symbols may differ.
SYMBOLS, BITS = 4, 16
#: Tasks over which one shingle's documents are dealt where documents meet in shingles.
SPREAD = 8


def shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles, A-Z lower-cased.

    A text of fewer words gives its whole sequence as one shingle, and one without words the empty set.
    """
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), dtype=np.uint64, count=int(n.sum()))
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(codes), dtype=np.uint64)
        for k in range(width):
            mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + np.concatenate([codes[k:], np.zeros(min(k, len(codes)), dtype=np.uint64)])
            mixed ^= mixed >> np.uint64(32)
    out, start = [], 0
    for ws, m in zip(words, n.tolist(), strict=True):
        if m >= width:
            out.append(np.unique(mixed[start : start + m - width + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=m)] if m else [], dtype=np.uint64))
        start += m
    return out


def signatures(sets: list[np.ndarray], chunks: int) -> np.ndarray:
    """Chunks of 16-bit minimum hashes, a row per set; the rows of empty sets mean nothing."""
    k = chunks * SYMBOLS
    rng = np.random.default_rng(20240229)
    a, b = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    low = np.zeros((len(sets), k), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        with np.errstate(over="ignore"):
            for j in range(k):
                h = (flat ^ b[j]) * a[j]
                h ^= h >> np.uint64(32)
                low[full, j] = np.minimum.reduceat(h * np.uint64(0x9E3779B97F4A7C15), starts)
    # a minimum's top bits are near zero for every large set: mixed, all its bits count
    with np.errstate(over="ignore"):
        low = (low ^ (low >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    symbol = (low >> np.uint64(64 - BITS)).reshape(len(sets), chunks, SYMBOLS)
    shifts = np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(symbol << shifts, axis=2).view(np.int64)


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(id, text) -> id, set: the sorted hashes as bytes."""
    kind = rows.schema["id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            sets = shingles(texts, width)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, set binary")


def _signed(rows: DataFrame, width: int, chunks: int) -> DataFrame:
    """(id, text) -> id, n_shingles, digest of the set, s0.. the signature's chunks."""
    names = ["id", "n_shingles", "digest", *(f"s{i}" for i in range(chunks))]
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            sets = shingles(texts, width)
            sig = signatures(sets, chunks)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            cols = [pa.array(ids, id_type), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *(pa.array(np.ascontiguousarray(sig[:, i])) for i in range(chunks))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_shingles long, digest binary, {', '.join(f'{c} long' for c in names[3:])}")


def _differing(x: Column, y: Column) -> Column:
    """In how many of its 16-bit symbols a chunk differs."""
    d = F.bitwise_xor(x, y) if hasattr(F, "bitwise_xor") else x.bitwiseXOR(y)
    for shift in (8, 4, 2, 1):
        d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
    return F.bit_count(d.bitwiseAND(F.lit(0x0001000100010001)))


def _texts_of(rows: DataFrame, nodes: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows (id, text) of these nodes."""
    wanted = materialise(nodes.select(F.col("node").alias("id")).distinct(), "near-wanted")
    chosen = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    return rows.join(chosen, "id", "left_semi")


def _one_text_each(known: DataFrame) -> DataFrame:
    """(id, text) rows with one for each id: of the texts that share one the first in order, a null after the others."""
    several = materialise(known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "near-repeated")
    if several.isEmpty():
        return known
    first = known.join(several, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return known.join(several, "id", "left_anti").unionByName(first)


def _each_shingle(rows: DataFrame, nodes: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """node, h of every shingle of these nodes."""
    chosen = _texts_of(rows, nodes, broadcast_rows)
    kind = chosen.schema["id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_chunks(batches):
            sets = shingles(texts, width)
            many = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type).take(pa.array(many)), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "h"])

    return materialise(chosen.mapInArrow(run, f"node {kind.simpleString()}, h long"), "near-each")


def _by_rare_shingles(asked: DataFrame, rows: DataFrame, sizes: DataFrame, width: int, percent: int, broadcast_rows: int) -> DataFrame:
    """Pairs (a, b) of these nodes (node, component) that may be linked, of different components.

    The order of shingles goes from rare to frequent. Two sets of m <= n shingles linked at the share t = ``percent`` / 100
    have at least t / (1 + t) * (m + n) in common, so one of the first m - 2 * t / (1 + t) * m + 1 of the lesser set is among the
    first n - t * n + 1 of the larger. Beyond the first shingles of both lie at most as many common ones as the larger of the two
    remainders, so the first ones must share the difference. Documents that only share a passage which many have
    thus don't meet: their first shingles are their own. All of this is exact. ``sizes`` has n of every node.
    """
    asked = materialise(asked, "near-asked")
    each = _each_shingle(rows, asked, width, broadcast_rows)
    shared = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    known = materialise(each.join(shared, "h"), "near-common")
    n = F.col("n")
    first = n - F.ceil(n * percent / 100) + 1
    lesser = n - F.ceil(n * 2 * percent / (100 + percent)) + 1
    # shingles that no other set has come first in the order and meet nobody
    own = n - F.col("common")
    both = known.groupBy("node").agg(F.count("*").alias("common")).join(sizes, "node").join(asked, "node")
    able = materialise(both.withColumns({"first": first - own, "lesser": lesser - own, "beyond": n - first}).where("first > 0"), "near-able")
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "h"))
    prefix = known.join(able.select("node", "first", "lesser"), "node").withColumn("place", place).where("place <= first")
    prefix = materialise(prefix.select("node", "h", (F.col("place") <= F.col("lesser")).alias("early")), "near-prefix")
    # a map of 256 bits tells most pairs apart: beyond its common bits there are only as many common shingles as fell on bits already set
    word, bit = F.shiftright("h", 6).bitwiseAND(F.lit(3)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    maps = [F.coalesce(F.bit_or(F.when(word == w, bit)), F.lit(0)).alias(f"m{w}") for w in range(4)]
    firsts = prefix.groupBy("node").agg(F.collect_list("h").alias("firsts"), *maps)
    bits = lambda of: sum((of(w) for w in range(4)), F.lit(0))
    loaded = materialise(able.join(firsts.withColumn("hidden", F.size("firsts") - bits(lambda w: F.bit_count(f"m{w}"))), "node"), "near-firsts")
    # a frequent shingle is dealt over several tasks: one side by node, the other to all of them
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = F.explode(F.array(*[F.lit(i) for i in range(SPREAD)])), F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int")
    x = prefix.where("early").withColumn("part", left).join(loaded, "node").repartition(parts, "h", "part").alias("x")
    y = prefix.withColumn("part", right).join(loaded, "node").repartition(parts, "h", "part").alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    needed = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent)) - F.greatest("x.beyond", "y.beyond")
    likely = bits(lambda w: F.bit_count(F.col(f"x.m{w}").bitwiseAND(F.col(f"y.m{w}")))) + F.least("x.hidden", "y.hidden") >= needed
    enough = likely & (F.size(F.array_intersect("x.firsts", "y.firsts")) >= needed)
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.component") != F.col("y.component")) & ordered & enough)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _confirm(pairs: DataFrame, rows: DataFrame, width: int, percent: int, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` per cent of their union in common."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = materialise(_sets(_texts_of(rows, ends, broadcast_rows), width), "near-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    met = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return met.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, chunks: int = 10, broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id (the smallest id reachable), kept.

    Documents are linked when their sets of ``width``-word shingles have at least ``percent`` per cent of
    their union in common. Documents of equal sets are one node from the start. Every node has a signature
    of ``4 * chunks`` minimum hashes of 16 bits in ``chunks`` chunks. Two signatures that differ in at most
    ``2 * chunks - 1`` symbols have, by the pigeonhole principle, a chunk with at most one error; each
    chunk is therefore indexed four times, each time without one of its symbols, and pairs within that
    distance always meet. With 40 symbols a pair at 80 % differs in 8 on average; it goes
    past 19 about once in 46,000 times. Pairs that meet are confirmed on their full sets, read again for the
    documents in question only. ``graph`` tells how large groups are linked without all their pairs.

    A null text has no words: no shingles, no links. A null id can't be referred to: its component is
    null and it is kept. Rows that repeat an id are one node and are each returned, alike; of their texts the
    first in order stands for the id. An empty table gives an empty result; other columns are not read.
    """
    ship_package(docs.sparkSession)
    every = narrow(docs, id=id_col, text=text_col)
    known = every.where("id IS NOT NULL")
    rows = _one_text_each(known)
    signed = materialise(_signed(every if rows is known else rows.unionByName(every.where("id IS NULL")), width, chunks), "near-signed")
    s = [f"s{i}" for i in range(chunks)]
    able = signed.where("n_shingles > 0 AND id IS NOT NULL")
    nodes = able.groupBy("digest").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in s))
    nodes = materialise(nodes, "near-nodes")
    masks = [~(0xFFFF << (BITS * i)) & (2**64 - 1) for i in range(SYMBOLS)]
    signed_mask = lambda m: F.lit(m - 2**64 if m >= 2**63 else m)
    entries = F.array(*[F.xxhash64(F.lit(SYMBOLS * c + i), F.col(f"s{c}").bitwiseAND(signed_mask(masks[i]))) for c in range(chunks) for i in range(SYMBOLS)])
    keys = nodes.select(F.explode(entries).alias("key"), "node")

    def near(x: str, y: str) -> Column:
        of = lambda side, c: F.col(f"{side}.{c}")
        alike = (100 * of(x, "n") >= percent * of(y, "n")) & (100 * of(y, "n") >= percent * of(x, "n"))
        return alike & (sum((_differing(of(x, c), of(y, c)) for c in s), F.lit(0)) < 2 * chunks)

    payload = nodes.select("node", "n", *s)

    def rest(asked: DataFrame) -> DataFrame:
        return _by_rare_shingles(asked, rows, payload.select("node", "n"), width, percent, broadcast_rows)

    labels = linked_components(keys, payload, near, lambda pairs: _confirm(pairs, rows, width, percent, broadcast_rows), rest=rest, broadcast_rows=broadcast_rows)
    classes = nodes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = signed.join(classes, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    out = out.select("id", "n_shingles", component.alias("component_id"))
    if rows is not known:
        out = known.select("id").join(out.where("id IS NOT NULL"), "id").unionByName(out.where("id IS NULL"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns. Up to ``broadcast_rows`` ids to leave
    out are sent to the texts; with more, the texts are shuffled."""
    with scratch() as keep:
        found = near_duplicates(docs, id_col, text_col, broadcast_rows=broadcast_rows, **options)
        gone = keep(materialise(found.where("NOT kept").select(F.col(id_col).alias("__gone")).distinct(), "near-gone"))
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, docs[id_col] == gone["__gone"], "left_anti")
