import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from marginalia.llm import packing
from marginalia.llm.queries import op3_best_fit_packing, tokenizer_path
from tokenizers import Tokenizer

PATH = tokenizer_path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)


def sequences(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return by


def test_query_against_the_tokenizer(spark, small, texts):
    rows = op3_best_fit_packing(spark, small).collect()
    found = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    assert len(found) == len(rows)
    expected = {}
    for d, t in texts.items():
        ids = np.array([*REAL.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            expected[d, k] = (s, len(part), zlib.crc32(part.tobytes()))
    assert found == expected
    lengths = np.array([v[1] for v in expected.values()])
    assert len(sequences(rows)) - packing.lower_bound(lengths, 2048) <= 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbÉéßİΣσς'sn2²½ \n\t\x0b\x1c\x85\xa0.,<|endoftext|>´́ 中ﬁ'tÀ×÷"), max_size=30), max_size=4))
def test_encoder_is_the_tokenizer(texts):
    texts = [*texts, "<|endoftext|> I'LL won't <|ENDOFTEXT|>x"]
    enc = packing.WordEncoder(PATH, most_words=3, most_pieces=2)
    got = []
    for part in (texts[:1], texts[1:]):
        ids, bounds = enc.encode([t.encode() for t in part])
        got += [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)]
    assert got == [REAL.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=9))
def test_bounds_hold(lengths):
    a = np.array(lengths, dtype=np.int64)
    bins, offsets, used = packing.best_fit_decreasing(a, 24)
    assert all(sum(a[bins == b]) <= 24 for b in range(used))
    best = used
    while best and _fits(sorted(lengths, reverse=True), [24] * (best - 1)):
        best -= 1
    assert packing.lower_bound(a, 24) <= best <= used


def _fits(items, free):
    if not items:
        return True
    tried = set()
    for i, f in enumerate(free):
        if f >= items[0] and f not in tried:
            tried.add(f)
            if _fits(items[1:], [*free[:i], f - items[0], *free[i + 1 :]]):
                return True
    return False


def test_exchange_fills_the_gaps(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 3000)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "id long, piece int, start long, length long, ids_crc32 long")
    apart = len(sequences(packing.pack(pieces, group_rows=150, rounds=1).collect()))
    packed = packing.pack(pieces, group_rows=150)
    rows = packed.collect()
    used, bound = packing.certificate(packed)
    assert used == len(sequences(rows)) and bound == packing.lower_bound(lengths, 2048) <= used
    assert len(rows) == 3000
    assert len(sequences(rows)) <= apart


def test_awkward_rows(awkward, nothing):
    rows = packing.pack_documents(awkward, PATH).collect()
    sequences(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece) for r in rows if r.length == 1) == [(False, 1, 0), (False, 2, 0), (False, 7, 0), (True, 0, 0)]
    assert sum(r.doc_id == 3 for r in rows) == 2
    assert packing.pack_documents(nothing, PATH).count() == 0


@pytest.mark.parametrize("lengths", [[2048] * 3, [1], []])
def test_bound_of_plain_cases(lengths):
    assert packing.lower_bound(np.array(lengths, dtype=np.int64), 2048) == len(lengths)
