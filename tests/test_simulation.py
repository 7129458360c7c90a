from marginalia.operators import text_ops


def test_rows_that_share_an_id_are_spotted_one_by_one(spark):
    """They met each other's hits when these were grouped by id and joined back, a row for every pair."""
    words = spark.createDataFrame([(1, "banana"), (1, "ananas"), (2, "xyz")], "id long, word string")
    grams, lex = spark.createDataFrame([("an",), ("na",)], "ngram string"), spark.createDataFrame([("banana",), ("ananas",)], "word string")
    got = text_ops.simulate_step(words, grams, lex, "id", recall=1.1)
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.n_letters, r.spotted_share, r.n_candidates, r.transcribed) for r in got.collect()) == [(1, 6, 0.833333, 1, True), (1, 6, 0.833333, 1, True), (2, 3, 0.0, 0, False)]
