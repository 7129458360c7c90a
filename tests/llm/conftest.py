import pytest


@pytest.fixture(scope="session")
def texts(spark, small):
    """doc_id -> text of the small table."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with the operators' own."""
    long = "long words here " * 4000
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three four five six seven", None), (3, "one two three four five six seven", None), (None, "one two three four five six seven", "b"), (5, long, "b"), (6, long.upper(), "b"), (7, " \n\n ", None), (None, None, None)]
    return spark.createDataFrame([(*r, "x", 1, 2.0, "y", 3) for r in rows], "doc_id long, text string, source string, id string, node int, n double, keep_id string, component int")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


def reach(nodes, links):
    """node -> the smallest node reachable."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.fixture(scope="session")
def reaching():
    return reach
