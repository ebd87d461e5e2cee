"""Clusters of whole-number vectors, against a plain comparison with all centroids."""

import hashlib
import math
import random

import pytest

from sparkloom.llm import yinyang


def plain(rows, k=16, dims=64, rounds=3):
    use = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**20 for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(use, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in use]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(use, own, strict=True) if o == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in use]
    total = {}
    for _, d, n in last:
        total[n] = total.get(n, 0) + d
    return sorted(((i, n, d, total[n], sum(total.values()), centroids[n]) for i, d, n in last), key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    return sorted((tuple(r)[:6] for r in yinyang.kmeans(df, **more).collect()), key=str)


def half(x):
    """Fits a float exactly."""
    return round(x * 256) / 256


def cloud(n, dims, seed, spread=0.3, centres=9):
    rng = random.Random(seed)
    at = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(centres)]
    return [(i, [half(x + rng.gauss(0, spread)) for x in rng.choice(at)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_comparisons(spark, seed):
    rows = cloud(400, 64, seed)
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("groups", [1, 3, 16])
def test_any_number_of_groups_and_rounds(spark, groups):
    rows = cloud(200, 5, 7, spread=1.0)
    assert got(spark, rows, k=16, dims=5, rounds=6, groups=groups) == plain(rows, 16, 5, 6)


def test_ties_and_repeated_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(150)] + [(1000 + i, [0.5, 0.5, 0.5]) for i in range(80)]
    for rounds in (0, 1, 4):
        assert got(spark, rows, k=12, dims=3, rounds=rounds) == plain(rows, 12, 3, rounds)


def test_odd_vectors(spark):
    good = cloud(40, 64, 5)
    one = [1.0] * 63
    rows = good + [(100, None), (101, []), (102, [1.0] * 63), (103, [*one, None]), (104, [*one, float("nan")]), (105, [*one, float("inf")]), (106, [*one, 2.0**20]), (107, [*one, -1048575.0]), (None, [*one, 0.5]), (5, [*one, 0.25]), (5, [*one, 0.25])]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:3]) == plain(rows[:3])
    assert got(spark, []) == []
    df = spark.createDataFrame(good, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS cluster", "3 AS v", "4 AS distance")
    assert sorted((tuple(r)[:6] for r in yinyang.kmeans(df).collect()), key=str) == plain(good)


def test_bounds_leave_most_distances_out(spark):
    rows = cloud(3000, 8, 11, spread=0.02, centres=24)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = yinyang.kmeans(df, k=24, dims=8, rounds=8, groups=6)
    assert out.selectExpr("avg(scanned)").first()[0] < 0.25 * 24
