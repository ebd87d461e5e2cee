"""Queries over the whole of their tables, beside SQL without cuts or plain loops."""

import pytest

import __spark_entry__ as entry
from sparkloom.operators import ranking
from sparkloom.plans import order_queries

from .compare import differences, duck

SF = "/root/testdata/sf0.01"


def test_signature_shapes_lose_no_row(spark):
    rows = [(i, "abc"[i * 5 % 3], [["x", "y", "z"][(i * j + i) % 3] for j in range(i % 4)], i * 37 % 101) for i in range(120)]
    df = spark.createDataFrame(rows, "ordinal int, returns string, params array<string>, quality int")
    asked = df.withColumnRenamed("ordinal", "query")
    got = ranking.similar_signatures(asked, df, "query", 3).collect()
    assert set(map(tuple, ranking.similar_signatures(asked, df, "query", 3, bound=5).collect())) == set(map(tuple, got))
    want = set()
    for q, returns, params, _ in rows:
        scores = [((r == returns) * 10 + (len(p) == len(params)) * 5 + 3 * sum(x in p for x in params) + n // 10, i) for i, r, p, n in rows]
        want |= {(q, i, s, at + 1) for at, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:3])}
    assert set(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["signature_similarity", "order_pack", "module_waves", "direct_dependencies"])
def test_all_rows_take_part(spark, name):
    assert differences(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_calls_of_all_parts(spark):
    want = {(k, d) for k in range(2000) for d in (2 * k, 2 * k + 1, *([k // 17] if k % 17 == 0 else [])) if d != k and d < 2000}
    assert {tuple(r) for r in order_queries.call_edges(spark, SF).collect()} == want
    place = {r["name"]: r["place"] for r in entry.queries()["topo_order"](spark, SF).collect()}
    assert set(place) == {f"f{k}" for k in range(2000)} and sorted(place.values()) == list(range(2000))
    assert all(place[f"f{a}"] < place[f"f{b}"] for a, b in want if a < b)
