import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from marginalia.llm import suffix_lm
from marginalia.llm.queries import op10_suffix_tree_lm


def words(text):
    return [*(text or "").encode().lower().split(), b""]


def test_base_scores(spark, small, texts):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, t in texts.items() if not held[d] for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    rows = op10_suffix_tree_lm(spark, small).collect()
    assert len(rows) == len(texts)
    gained = 0.0
    for r in rows:
        w = words(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(x in counts for x in w), total)
        assert r.base_score == pytest.approx(sum(log10((counts[x] + 1) / (total + distinct + 1)) for x in w), abs=1e-6)
        gained += (r.score - r.base_score) if r.held_out else 0
    assert gained > 0


def model_and_probability(spark, texts, **options):
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    tree, vocabulary = suffix_lm.train(rows, **options)
    counts = {bytes(r.word): r.c for r in vocabulary.collect()}

    def probability(context, w):
        """Of word w after a context, by walking down the tree one state at a time."""
        p = (counts.get(w, 0) + 1) / (tree.total + tree.distinct + 1)
        known = tree.known.get(w, 0)
        key = 0
        for d in sorted(tree.states):
            if len(context) < d or not tree.known.get(context[-d], 0):
                break
            key |= tree.known[context[-d]] << (suffix_lm.WIDTH * (d - 1))
            at = np.flatnonzero(tree.states[d] == key)
            if not len(at):
                break
            move = np.flatnonzero(tree.moves[d] == (key << suffix_lm.WIDTH | known)) if known else []
            p = (tree.gain[d][move[0]] if len(move) else 0.0) + tree.rest[d][at[0]] * p
        return p

    return tree, counts, probability


def test_scores_are_the_trees_probabilities_and_add_up_to_one(spark):
    rng = np.random.default_rng(6)
    texts = {}
    for d in range(90):
        s = [d % 4, 0]
        while len(s) < 60:  # the next word depends on the two before it
            s.append((s[-1] + s[-2] + int(rng.random() < 0.2)) % 4)
        texts[d] = " ".join("abcd"[x] for x in s) + f" only{d}"
    options = {"known_share": 1e-3, "state_share": 2e-3, "least_gain": 5.0}
    tree, counts, probability = model_and_probability(spark, texts, **options)
    assert len(tree.states[1]) >= 4 and len(tree.states[2]) >= 1
    for context in ([], [b"a"], [b"b", b"a"], [b"c", b"c"], [b"only3"], [b"only3", b"a"]):
        assert sum(probability(context, w) for w in counts) + probability(context, b"never") == pytest.approx(1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in suffix_lm.score(docs, **options).collect():
        w = words(texts[r.doc_id])
        assert r.score == pytest.approx(sum(log10(probability(w[:i], x)) for i, x in enumerate(w)), abs=1e-6)
    held = [r for r in suffix_lm.score(docs, **options).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 30 * len(held) * 0.1


def test_two_passes_find_every_frequent_ngram(spark):
    rng = np.random.default_rng(1)
    texts = {d: " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 50) % 40) for d in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    train = [words(t) for d, t in texts.items() if not suffix_lm.held_out(d)]
    total = sum(map(len, train))
    tree, _ = suffix_lm.train(rows, known_share=1e-3, state_share=5e-3, least_gain=-1e9)
    common = {w for w, c in Counter(x for t in train for x in t).items() if c >= 5e-3 * total}
    pairs = Counter(p for t in train for p in zip(t, t[1:], strict=False) if set(p) <= common)
    expected = {tree.known[a] << suffix_lm.WIDTH | tree.known[b] for (a, b), c in pairs.items() if c >= 5e-3 * total}
    assert set(tree.moves[1].tolist()) == expected


def test_awkward_rows(awkward, nothing):
    rows = suffix_lm.score(awkward).collect()
    assert len(rows) == 9 and {(r.doc_id, r.n_tokens) for r in rows} >= {(1, 1), (2, 1), (7, 1), (3, 8)}
    assert suffix_lm.score(nothing).count() == 0


def test_segments_tell_of_every_ngram_that_can_be_frequent(spark):
    rng = np.random.default_rng(9)
    docs = [rng.integers(1, 12, rng.integers(1, 60)).astype(np.int32) for _ in range(80)]
    rows = spark.createDataFrame([(x.tobytes(),) for x in docs], "symbols binary").repartition(3)
    pairs = Counter((int(a) << suffix_lm.WIDTH) | int(b) for x in docs for a, b in zip(x, x[1:], strict=False) if a <= 9 and b <= 9)
    total = sum(map(len, docs))
    for share, segment in ((0.004, 300), (0.01, 150), (0.0, 100)):
        told = {r.key: r.c for r in suffix_lm.ngram_counts(rows, 9, 2, share, segment=segment).collect()}
        unsaid = told.pop(-1)
        assert all(c <= told.get(k, 0) + unsaid for k, c in pairs.items()) and told.keys() <= pairs.keys()
        assert {k for k, c in pairs.items() if c >= share * total} <= told.keys()
        wanted = spark.sparkContext.broadcast(np.array(sorted(told), dtype=np.int64))
        assert {r.key: r.c for r in suffix_lm.ngram_counts(rows, 9, 2, share, wanted).collect()} == {k: pairs[k] for k in told}
