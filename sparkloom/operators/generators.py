"""Test inputs from hashes of their numbers, the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inputs at the edges of ranges.
EDGE_ARGS = ("0", "-1", "1", "2147483647", "-2147483648")
EDGE_STDIN = ("", "0\n", "\n")


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / float(1 << 53)


def random_text(seed: int, n: Column, most: int) -> Column:
    """Up to most printable characters."""
    size = F.floor(draw(seed, n, F.lit(-1)) * most).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), size), lambda i: F.char(F.floor(draw(seed, n, i) * 95 + 32).cast("int"))), "")


def random_stdin(seed: int, n: Column, hint: Column, most: int = 16) -> Column:
    """Lines of whole numbers, of decimals, or of text, as the hint says."""
    whole = F.floor(draw(seed, n) * 2_000_001 - 1_000_000).cast("long").cast("string")
    decimal = F.format_string("%.3f", draw(seed, n) * 2000 - 1000)
    return F.concat(F.when(hint == "int", whole).when(hint == "float", decimal).otherwise(random_text(seed, n, most)), F.lit("\n"))


def fuzz_inputs(spark: SparkSession, mode: str, iterations: int = 100, seed: int = 1) -> DataFrame:
    """(seq, label, value): edge rows first, then random ones; a mode without input has one row."""
    if mode == "none":
        return spark.range(1).select(F.lit(0).cast("long").alias("seq"), F.lit("no_input").alias("label"), F.lit("").alias("value"))
    edges = EDGE_ARGS if mode == "args" else EDGE_STDIN
    fixed = spark.createDataFrame([(i, f"edge_{i}", v) for i, v in enumerate(edges)], "seq long, label string, value string")
    number = F.floor(draw(seed, F.col("id")) * 2_000_001 - 1_000_000).cast("long").cast("string")
    value = number if mode == "args" else random_stdin(seed, F.col("id"), F.lit("int"))
    rest = spark.range(len(edges), max(iterations, len(edges))).select(F.col("id").alias("seq"), F.concat(F.lit("random_"), "id").alias("label"), value.alias("value"))
    return fixed.unionByName(rest)


def fuzz_summary(runs: DataFrame, key: str) -> DataFrame:
    """(key, iterations, failures, first_divergence, all_passed) of runs (key, seq, a, b, ran): runs that broke count as iterations only."""
    bad = F.col("ran") & ~F.col("a").eqNullSafe(F.col("b"))
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("iterations"), F.count_if(bad).alias("failures"), F.min(F.when(bad, F.col("seq"))).alias("first_divergence"), (F.count_if(bad) == 0).alias("all_passed"))


def value_combos(lists: Column) -> Column:
    """Combinations of test values: as many as the longest list has, shorter lists in turn; no lists give one empty one."""
    longest = F.array_max(F.transform(lists, F.size))
    combos = F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.transform(lists, lambda v: F.element_at(v, (i % F.size(v) + 1).cast("int"))))
    return F.when(F.size(lists) == 0, F.array(F.array().cast("array<string>"))).otherwise(combos)
