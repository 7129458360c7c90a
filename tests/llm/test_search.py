"""Ranked search against a plain scan of every document, packed integers, shards, blocks and awkward tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marginalia.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(ASCII))


def scan(docs, items, k=10):
    """docs: rows (id, text); items: {id: text} -> {item: [(score, id)]}."""
    counts = [(i, Counter(cut(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items.items():
        scored = []
        for (i, c), size in zip(counts, sizes, strict=True):
            score = 0
            for t in set(cut(text)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n // total)))
            if score > 0:
                scored.append((-score, i is None, i))
        out[item] = [(-s, i) for s, _, i in sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


def lists(rows, item="item_id", doc="doc_id"):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[item]), r["rank"])):
        out.setdefault(r[item], []).append((r["score"], r[doc]))
        assert r["rank"] == len(out[r[item]])
    return out


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**62))))
@settings(max_examples=200, deadline=None)
def test_packed_integers(values):
    assert search.unpack(search.pack(np.array(values, dtype=np.int64))).tolist() == values


def test_query_against_scan(spark, small, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    expected = scan(sorted(texts.items()), items)
    assert lists(queries.op13_ranked_search(spark, small).collect()) == {i: x for i, x in expected.items() if x}


@pytest.mark.parametrize("options", [{"shard_postings": 1}, {"shard_docs": 7}, {"block_terms": 100}, {"k": 1}, {"k": 150, "shard_docs": 20, "salts": 2}])
def test_shards_blocks_and_depth(spark, small, texts, options):
    """Also what is no longer merged but asked about, with many ties: each text stands three times."""
    rows = [(3 * d + j, t) for d, t in texts.items() if d < 60 for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.read.parquet(f"{small}/benchmark.parquet").where("item_id < 12")
    got = lists(search.ranked(docs, items, **options).collect())
    assert got == {i: x for i, x in scan(sorted(rows), {r.item_id: r.text for r in items.collect()}, options.get("k", 10)).items() if x}


def test_index_holds_every_posting(spark, small, texts):
    got = Counter()
    index = search.build_index(spark.read.parquet(f"{small}/documents.parquet"), shard_docs=9)
    for r in index.collect():
        sizes, steps, counts, lengths = (search.unpack(r[c]) for c in ("sizes", "places", "counts", "lengths"))
        assert r.ids == sorted(r.ids) and len(lengths) == len(r.ids) <= 9 and r.n_terms == lengths.sum()
        at = 0
        for term, n in zip(r.terms, sizes, strict=True):
            for place, count in zip(np.cumsum(steps[at : at + n]), counts[at : at + n], strict=True):
                got[(r.ids[place], bytes(term).decode())] += int(count)
            at += n
        assert at == len(steps)
    assert got == Counter({(d, w): c for d, t in texts.items() for w, c in Counter(cut(t)).items()})
    assert {bytes(r.term).decode(): r.df for r in search.document_frequencies(index).collect()} == Counter(w for t in texts.values() for w in set(cut(t)))


def test_awkward_tables(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "ONE two zebra", "x"), (1, "words", "y"), (2, None, "z"), (3, "", "z"), (None, "seven LONG", "z"), (4, "...", "z"), (5, "none of these", "z")], "item_id int, text string, doc_id string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    expected = scan(rows, {1: "one two zebra words", 2: None, None: "seven long", 5: "none of these"})
    assert lists(search.ranked(awkward, items, k=10).collect()) == {i: x for i, x in expected.items() if x}
    for docs, asked in ((nothing, items), (awkward, items.where("false")), (nothing, items.where("false"))):
        got = search.ranked(docs, asked)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
