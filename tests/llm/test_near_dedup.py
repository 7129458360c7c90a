import random

from marginalia.llm import graph, near_dedup
from marginalia.llm.queries import op6_minhash_near_dedup


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(texts, width, percent, reach):
    sets = {d: shingle_set(t, width) for d, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = reach(ids, links)
    return {(d, len(sets[d]), low[d], low[d] == d) for d in ids}


def test_query_against_all_pairs(spark, small, texts, reaching):
    assert set(map(tuple, op6_minhash_near_dedup(spark, small).collect())) == brute(texts, 4, 80, reaching)


def test_groups_around_the_threshold(spark, reaching):
    """Chains in which the first text is not linked with the last, and many links close to 80 %."""
    rng = random.Random(5)
    texts, base = {}, [f"w{i}" for i in range(120)]
    for d in range(150):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        texts[d] = " ".join(w)
        if d % 10 == 9:
            base = w
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert set(map(tuple, near_dedup.near_duplicates(rows, width=4).collect())) == brute(texts, 4, 80, reaching)
    assert set(map(tuple, near_dedup.near_duplicates(rows).collect())) == brute(texts, 5, 80, reaching)


def test_every_pair_within_the_distance_meets(spark):
    """The guarantee itself: any two signatures with at most 2 * chunks - 1 differing symbols share a key."""
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(1 << 16) for _ in range(40)]
        b = list(a)
        for i in rng.sample(range(40), 19):
            b[i] = (b[i] + 1 + rng.randrange(65535)) % 65536
        meet = [c for c in range(10) if sum(a[4 * c + i] != b[4 * c + i] for i in range(4)) <= 1]
        assert meet


def test_components_of_paths_and_stars(spark, reaching):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (129, 200)]
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.component for r in got} == reaching(nodes, links)


def test_awkward_rows(awkward, nothing):
    got = near_dedup.near_duplicates(awkward)
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str)
    assert rows == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 3, 3, True), (3, 3, 3, True), (None, 3, None, True), (5, 3, 5, True), (6, 3, 5, False), (7, 0, 7, True), (None, 0, None, True)], key=str)
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.near_dedup(awkward).count() == 8


def test_texts_that_share_an_id(spark):
    """The first text in order stands for the id, whatever the order of the rows."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, b), (1, a), (2, b), (3, a), (4, None), (4, b), (None, a), (None, b)]
    expected = sorted([(1, 27, 1, True), (1, 27, 1, True), (2, 27, 2, True), (3, 27, 1, False), (4, 27, 2, False), (4, 27, 2, False), (None, 27, None, True), (None, 27, None, True)], key=str)
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(3), width=4).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == expected
