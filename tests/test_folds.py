"""The fold of hits at sizes and on rows that the queries' own tables don't have."""

from marginalia.operators import spans


def test_many_hits_of_one_are_folded_in_numpy(spark):
    """20,000 hits apart from each other took their square in interpreted array functions."""
    apart = spark.range(20000).selectExpr("1L AS user_id", "id", "id * 100.0D AS s", "id * 100.0D + 50 AS e", "id / 7.0D AS score")
    again = spark.sql("SELECT 1L AS user_id, 30000L AS id, 501D AS s, 551D AS e, 9D AS score UNION ALL SELECT 2L, 1L, null, null, null UNION ALL SELECT 2L, 2L, 0D, 40D, 3D")
    got = spans.merged_hits(apart.unionByName(again), "user_id")
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.user_id, r.s): (r.e, r.score, r.n) for r in got.collect()}
    assert len(rows) == 20001 and rows[1, 501.0] == (551.0, (5 / 7 + 9) / 2, 2) and rows[1, 600.0] == (650.0, 6 / 7, 1)
    # extremes pass over nulls: the null hit covers the second, its box stays, and an average with a null is null
    assert rows[2, None] == (None, None, 2)
