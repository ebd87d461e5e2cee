"""The forest against brute force: recall, the share of vectors that it looks at, and the exact way."""

import math

import numpy as np
import pytest

from sparkloom.llm import ann_forest


def nearest(x, q, top=20):
    s = x @ x[q]
    return [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:top]


def clusters(n, rng):
    middle = rng.normal(size=(n // 100, 64))
    return (middle[rng.integers(0, n // 100, n)] + 0.15 * rng.normal(size=(n, 64))).astype(np.float32).astype(np.float64)


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_recall_and_scanned_share_on_clusters():
    rng = np.random.default_rng(4)
    x = clusters(20000, rng)
    forest = ann_forest.Forest(x, ann_forest.TREES, ann_forest.LEAF)
    leaves, hits, seen = forest.index(x), 0, 0
    queries = range(0, len(x), 400)
    for q in queries:
        best = nearest(x, q)
        most = ann_forest.SLACK / math.sqrt(x.shape[1] + 1) * forest.distance(x[q], (x @ x[q])[best[-1]])
        mark = np.zeros(len(x), bool)
        for t, n in forest.probes(x[q], most):
            mark |= leaves[:, t] == n
        hits += mark[best].sum()
        seen += mark.mean()
    assert hits >= 0.9 * 20 * len(queries) and seen / len(queries) < 0.2


def test_search_of_clusters_and_its_exact_way(spark):
    x = clusters(4000, np.random.default_rng(5))
    df = table(spark, x)
    some = found(ann_forest.search(df, every=100))
    hits = sum(len(set(nearest(x, q)) & set(v)) for q, v in some.items())
    assert len(some) == 40 and hits >= 0.9 * 20 * 40
    exact = found(ann_forest.search(df, every=400, slack=math.inf))
    assert exact == {q: nearest(x, q) for q in range(0, 4000, 400)}


def test_blocks_of_points_and_queries_change_nothing(spark, monkeypatch):
    x = clusters(1500, np.random.default_rng(6))
    df = table(spark, x)
    whole = found(ann_forest.search(df, every=10))
    monkeypatch.setattr(ann_forest, "BLOCK", 40)
    monkeypatch.setattr(ann_forest, "QUERIES", 7)
    assert found(ann_forest.search(df, every=10)) == whole


def test_ids_with_two_vectors_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 AS rank", "'x' AS leaf")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in ann_forest.search(df, 10).orderBy("rank").collect()]
    assert got == [(0, 2, pytest.approx(3.0)), (0, 1, pytest.approx(2.0))]
