"""Sharding: a keyed Feistel permutation of global row numbers says where each row goes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, stored

ROUNDS = 6
PRIME = 2147483647
#: Multiplier and addend of each round, below 2**31 so that every product stays below 2**62 (as BIGINT in SQL, too).
ROUND_KEYS = [(1103515245 + 40503 * i, 747796405 + 2654435 * i) for i in range(ROUNDS)]


def number_rows(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """df with a gapless long from 0 in the order of the columns named, nulls first.

    Rows are dealt by range and sorted where they land; the ranges' row counts (one row for each partition) give
    each range its first number. Rows equal in all those columns get their numbers in any order.
    """
    at = "__loom_at"
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    table = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "rows")
    part = F.shiftright(at, 33)
    before = Window.orderBy("__loom_part").rowsBetween(Window.unboundedPreceding, -1)
    first = table.groupBy(part.alias("__loom_part")).count().select("__loom_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__loom_first"))
    numbered = table.withColumn("__loom_part", part).join(F.broadcast(first), "__loom_part")
    return numbered.withColumn(name, F.col("__loom_first") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, "__loom_part", "__loom_first")


def sides(n: int) -> tuple[int, int]:
    """The two halves of the permuted domain: their product is n or little more."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def permute(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place in 0..n-1 of each row number: rounds on pairs (left, right), again while the place is n or more."""
    a, b = sides(n)
    x = x.astype(np.int64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] // b, x[todo] % b
        for i, (m, c) in enumerate(ROUND_KEYS):
            y = ((right if i % 2 == 0 else left) % PRIME * m + c + seed) % PRIME
            y = (y * y % PRIME + y * 3) % PRIME
            if i % 2 == 0:
                left = (left + y) % a
            else:
                right = (right + y) % b
        x[todo] = left * b + right
        todo = todo[x[todo] >= n]
    return x


def assign_shards(df: DataFrame, order: list[str], shards: int, seed: int = 7) -> DataFrame:
    """df with place, shard and slot (long, int, long): shard is place modulo shards, slot is place divided by it.

    Shards' row counts differ by one at most, slots are gapless from 0, and place is a bijection of the row numbers,
    so a row's shard and slot follow from its number alone. An empty table stays empty. Equal texts (copies) are
    spread like other rows, for the counts' sake.
    """
    prepare(df.sparkSession)
    rows = number_rows(df, order, "__loom_row")
    n = rows.agg(F.max("__loom_row")).first()[0]
    n = 0 if n is None else n + 1

    @F.pandas_udf("long")
    def place(x):
        import pandas as pd

        return pd.Series(permute(x.to_numpy(), n, seed))

    return (
        rows.withColumn("place", place("__loom_row"))
        .withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", F.expr(f"place div {shards}"))
        .drop("__loom_row")
    )


def sharded_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Shard and slot of each document, by doc_id; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size: Column = F.octet_length(text).cast("long") + 16
    slim = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(slim, ["doc_id", "text_crc32"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
