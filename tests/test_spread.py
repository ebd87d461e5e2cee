"""Small keys that large texts are made from are dealt to many tasks, and what is made of them stays there."""

import pytest

import __spark_entry__ as entry
from sparkloom.operators import spans
from sparkloom.operators.spread import spread
from sparkloom.plans.programs import programs
from sparkloom.plans.span_queries import tokens_of
from sparkloom.plans.units import units

SF = "/root/testdata/sf0.1"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_the_rows(spark):
    assert spread(spark.range(10), "id", rows=3).rdd.getNumPartitions() == 4
    assert spread(spark.range(0), "id").rdd.getNumPartitions() == 1
    assert units(spark, SF).rdd.getNumPartitions() == programs(spark, SF).rdd.getNumPartitions() == 8


def test_lines_and_tokens_stay_where_their_texts_are(spark):
    for df in (tokens_of(spark, SF), *(entry.queries()[q](spark, SF) for q in ("brace_depth", "function_spans", "memory_functions"))):
        assert plan(df).count("Exchange") == 1


def test_texts_are_taken_apart_once_for_calls_and_definitions(spark):
    df = entry.queries()["call_graph"](spark, "/root/testdata/sf0.001")
    assert df.collect() and "ReusedExchange" in plan(df)


def test_what_is_no_sign_is_one_token(spark):
    df = spark.createDataFrame([(1, "\n  int a = 1 + b / 2;\n  #define X (\n\n int f\n (int x) /* ( */ { y \n z")], "id long, t string")
    rows = spans.c_tokens(df, "id", "t").orderBy("i").collect()
    assert [r["token"] for r in rows] == ["\n  int a = 1 + b / 2", ";", "\n", "  #define X (", "\n\n int ", "f\n (", "int x", ")", " ", "/* ( */", " ", "{", " y \n z"]
    found = spans.c_functions(spans.c_tokens(df, "id", "t"), "id").collect()
    assert [tuple(r) for r in found] == [(1, 1, "f", 5, 7, 38, 61, 68)]


def test_rules_only_fold_lines_that_matter(spark):
    """Rules of blocks look at the lines that can change: long texts without any take little more than being split."""
    from pyspark.sql import functions as F

    from sparkloom.operators import rewrites

    e = '[{"code": "E0252", "line": 2, "message": "the name `Read` is defined multiple times"}, {"code": "E0119", "line": 9, "message": "conflicting implementations of trait `D` for type `X`"}]'
    source = "use a::Read;\n\tpub use b::{c::Read, Wr};\nuse d::Wr;\nlet z = Read;\n\x0cuse e::Read;\r\nimpl D for X {\n}\n impl q::D for r::X {\n}\n```\nfn f() {}\n"
    df = spark.createDataFrame([(source,), (None,), ("",)], "t string").withColumn("e", F.from_json(F.lit(e), "array<struct<code:string,line:int,message:string>>"))
    got = [r["t"] for r in rewrites.apply_rules(df, "t", "e").collect()]
    assert got == ["use a::Read;\nuse d::Wr;\nlet z = Read;\nimpl D for X {\n}\nfn f() {}", None, ""]
    texts = df.select(rewrites.truncated_functions(F.split("t", "\n"), F.col("e")).alias("r"))
    assert ", ---)" in texts._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_estimated_once_for_all_sums(spark):
    df = entry.queries()["agg_pack"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("IsAlphabetic") == 3


def test_scores_of_documents_stay_with_them(spark):
    df = entry.queries()["pattern_relevance"](spark, SF)
    assert plan(df).count("Exchange hashpartitioning(doc_id") == 1 and "REPARTITION_BY_NUM" in plan(df)


@pytest.mark.parametrize("query", ["predicate_pack", "text_pack", "documented_rust", "brace_depth", "file_markers"])
def test_keys_are_dealt_once_and_texts_stay(spark, query):
    df = entry.queries()[query](spark, SF)
    assert plan(df).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan(df) and df.rdd.getNumPartitions() == 8
