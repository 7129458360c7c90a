"""Every query with SQL against DuckDB on the smallest tables, and what must hold for the rest."""

import math

import __spark_entry__
import duckdb
import pytest
from marginalia import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v.isoformat() if hasattr(v, "isoformat") else float(v) if isinstance(v, float) else v
    return sorted(repr([clean(v) for v in row]) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_against_sql(spark, sql, small, name):
    got, expected = plans.QUERIES[name](spark, small).toPandas(), sql.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


def test_entry(spark):
    assert {"r01_qbe_ap", "t06_phoc_soft"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.ap > 0 for r in rows)


def test_merged_hits_fold_in_order(spark, small):
    from marginalia.plans.numeric import hits

    expected = {}
    for r in hits(spark, small).orderBy("id").collect():
        kept = expected.setdefault(r.user_id, [])
        for k in kept:
            if (min(k[1], r.e) - max(k[0], r.s)) / (max(k[1], r.e) - min(k[0], r.s)) > 0.55:
                if r.score > k[3]:
                    k[:2] = r.s, r.e
                k[2], k[3], k[4] = (k[2] + r.score) / 2, max(k[3], r.score), k[4] + 1
                break
        else:
            kept.append([r.s, r.e, r.score, r.score, 1])
    got = {}
    for r in plans.QUERIES["w09_merged_hits"](spark, small).collect():
        got.setdefault(r.user_id, []).append((r.s, r.e, round(r.score, 9), r.n))
    assert {u: sorted(v) for u, v in got.items()} == {u: sorted((float(a), float(b), round(s, 9), n) for a, b, s, _, n in v) for u, v in expected.items()}


def test_refined_edges_never_get_worse(spark, small):
    n = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in plans.QUERIES["w07_refined_edges"](spark, small).collect():
        before = -abs(n[r.id] // 3 - 150) - abs(n[r.id] * 2 // 3 - 380)
        assert r.score >= before and r.score == -abs(r.x0 - 150) - abs(r.x1 - 380)


def test_simulation_adds_up(spark, small):
    from marginalia.plans.text import _step

    step = _step(spark, small)
    b = plans.QUERIES["t15_progress_buckets"](spark, small).first()
    assert b.b0 + b.b1 + b.b2 + b.b3 + b.b4 == step.count() > b.n_transcribed > 0
    assert step.where("transcribed AND (n_candidates > 10 OR n_candidates < 1)").count() == 0
