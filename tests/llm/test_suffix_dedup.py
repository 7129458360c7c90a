import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marginalia.llm import suffix_dedup
from marginalia.llm.queries import op1_suffix_array_dedup


def brute(texts, window=100):
    """doc -> spans, by a set of all strings seen so far."""
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            if s in seen:
                gone[p : p + window] = True
            seen.add(s)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out[d] = [(int(a), int(e)) for a, e in zip(edge[::2], edge[1::2], strict=True)]
    return out


def check(rows, texts, window=100):
    expected = brute(texts, window)
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in rows} == expected
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        mask = np.ones(len(b), dtype=bool)
        for s, e in expected[r.doc_id]:
            mask[s:e] = False
        assert bytes(r.kept) == bytes(np.frombuffer(b, np.uint8)[mask]) and r.n_removed == (~mask).sum() and r.n_bytes == len(b)


def test_query_against_a_set_of_strings(spark, small, texts):
    expected = brute(texts)
    rows = op1_suffix_array_dedup(spark, small).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in rows} == {d: (sum(e - s for s, e in x), len(x)) for d, x in expected.items()}
    for r in rows:
        b, left, at = (texts[r.doc_id] or "").encode(), b"", 0
        for s, e in [*expected[r.doc_id], (len((texts[r.doc_id] or "").encode()), 0)]:
            left, at = left + b[at:s], e
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("most_runs", [20_000, 2])
def test_shifted_copies_and_periods(spark, most_runs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = {}
    for d in range(60):
        kind = d % 6
        a, b = sorted(rng.randrange(len(passage)) for _ in range(2))
        own = " ".join(word() for _ in range(rng.randrange(40)))
        texts[d] = [passage[a:b] + own, own + passage[a:], passage[:b] * 2, "ab" * rng.randrange(120), passage[:a] + "X" + passage[a + 1 :], "is " * 90 + own][kind]
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    check(suffix_dedup.suffix_dedup(rows, most_runs=most_runs).collect(), texts)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij ") for _ in range(2_300_000))
    texts = {1: long[:2_200_000], 2: long[1000:1300] + "q" + long[2_099_000:2_099_400]}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.suffix_dedup(rows).collect()}
    assert got == {1: [], 2: [(0, 300), (301, 701)]}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(x % 3 for x in b)), st.integers(9, 40))
def test_buckets_are_the_suffix_order(text, depth):
    pointers = suffix_dedup.refined_buckets(np.frombuffer(text, np.uint8), depth)
    padded = text + bytes(depth)
    keys = [padded[i : i + depth] for i in range(len(text))]
    ordered = sorted(keys)
    assert pointers.tolist() == [ordered.index(k) for k in keys]


def test_awkward_rows(awkward, nothing):
    rows = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, len(r.spans)) for r in suffix_dedup.suffix_dedup(awkward).collect()))
    long = len("long words here " * 4000)
    assert rows == sorted([(False, 1, 0, 0, 0), (False, 2, 0, 0, 0), (False, 3, 33, 0, 0), (False, 3, 33, 0, 0), (False, 5, long, long - 16, 1), (False, 6, long, long - 16, 1), (False, 7, 4, 0, 0), (True, 0, 0, 0, 0), (True, 0, 33, 0, 0)])
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
