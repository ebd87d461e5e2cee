"""Choices of the best rows, top-k by similarity, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import first_by


def words(text: Column) -> Column:
    """Distinct lower-case words of two bytes or more, split at white space and, again, at what is no letter or digit."""
    low = F.lower(text)
    every = F.concat(F.split(low, r"[\s\p{Z}]+"), F.split(low, r"[^\p{IsAlphabetic}\p{N}]"))
    return F.array_distinct(F.filter(every, lambda w: F.octet_length(w) >= 2))


#: Rows of features of a pattern store up to which they are broadcast.
BROADCAST_FEATURES = 1_000_000


def relevant_patterns(units: DataFrame, patterns: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """The k patterns (ordinal, tags, c_pattern, usage) of most relevance for each unit, ties by ordinal.

    10 points for each tag that the text holds, 1 for each common word, and the usage. A unit meets the patterns that it
    shares a word or tag with, by that word or tag, and besides the k of most usage: no other can be among its k best.
    Each distinct tag is looked for once in a text.
    """
    tagged = patterns.select("ordinal", F.explode("tags").alias("tag")).select("ordinal", F.lower("tag").alias("tag"))
    worded = patterns.select("ordinal", F.explode(words(F.col("c_pattern"))).alias("word"))
    most_used = patterns.orderBy(F.desc("usage"), "ordinal").limit(k).select("ordinal", F.lit("").alias("feature"), F.lit(0).alias("points"))
    points = worded.select("ordinal", F.concat(F.lit("w"), "word").alias("feature"), F.lit(1).alias("points"))
    points = points.union(tagged.groupBy("ordinal", F.concat(F.lit("t"), "tag").alias("feature")).agg((F.count(F.lit(1)) * 10).cast("int"))).union(most_used)
    tags = tagged.agg(F.collect_set("tag").alias("__tags"))  # one row
    held = F.filter("__tags", lambda x: F.contains(F.col("__low"), x))
    features = F.concat(F.array(F.lit("")), F.transform("__words", lambda w: F.concat(F.lit("w"), w)), F.transform(held, lambda x: F.concat(F.lit("t"), x)))
    u = units.select(key, F.lower(text).alias("__low"), words(F.col(text)).alias("__words")).crossJoin(F.broadcast(tags))
    u = u.select(key, F.explode(features).alias("feature"))
    points = F.broadcast(points) if points.count() <= BROADCAST_FEATURES else points
    scored = u.join(points, "feature").groupBy(key, "ordinal").agg(F.sum("points").alias("points"))
    scored = scored.join(patterns.select("ordinal", "usage"), "ordinal").select(key, "ordinal", (F.col("points") + F.col("usage")).cast("int").alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ordinal"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Rows of stored shapes up to which each shape asked for is held against all of them.
COMPARED_SHAPES = 100_000


def similar_signatures(queries: DataFrame, store: DataFrame, key: str, k: int, bound: int = COMPARED_SHAPES) -> DataFrame:
    """The k stored rows (ordinal, returns, params, quality) most like each query (key, returns, params), ties by ordinal.

    10 for the return type, 5 for as many parameters, 3 for each of the query's that the other has, a tenth of quality.

    The score sees of a query its shape, the return type and the parameters in any order, and of a stored row its shape,
    where a repeated parameter counts once, and the tenth. So each distinct shape of a query is ranked once, against the
    k best rows of each stored shape: no other row of a shape can be among the k best.

    Up to `bound` such rows are broadcast. More of them meet what is asked for by what they share: return type, number
    of parameters, each parameter. A row that shares nothing scores its tenth only, so the k best of all by that, k rows,
    stand for the rest.
    """
    shape = F.struct(F.col("returns").alias("r"), F.size("params").alias("n"), F.array_sort(F.array_distinct("params")).alias("s"))
    s = store.select("ordinal", shape.alias("shape"), F.floor(F.col("quality") / 10).alias("tenth"))
    best = F.row_number().over(Window.partitionBy("shape").orderBy(F.desc("tenth"), "ordinal"))
    s = s.withColumn("__at", best).filter(F.col("__at") <= k).select("ordinal", "shape", "tenth")
    q = queries.select(key, F.struct(F.col("returns").alias("r"), F.array_sort("params").alias("p")).alias("asked"))
    asked = q.select("asked").distinct()
    if s.limit(bound + 1).count() <= bound:
        shared = F.size(F.filter("asked.p", lambda x: F.array_contains("shape.s", x)))
        score = F.when(F.col("asked.r") == F.col("shape.r"), 10).otherwise(0) + F.when(F.size("asked.p") == F.col("shape.n"), 5).otherwise(0) + shared * 3 + F.col("tenth")
        scored = asked.crossJoin(F.broadcast(s)).select("asked", "ordinal", score.cast("int").alias("score"))
    else:
        sign = lambda kind, value, points: F.struct(F.concat(F.lit(kind), value.cast("string")).alias("sign"), F.lit(points).alias("points"))
        signs = lambda r, n, p: F.concat(F.array(sign("r", r, 10), sign("n", n, 5)), F.transform(p, lambda x: sign("p", x, 3)))
        mine = asked.select("asked", F.explode(signs(F.col("asked.r"), F.size("asked.p"), F.col("asked.p"))).alias("x")).select("asked", "x.*")
        held = s.select("ordinal", F.explode(signs(F.col("shape.r"), F.col("shape.n"), F.col("shape.s"))).alias("x")).select("ordinal", "x.sign")
        met = mine.join(held, "sign").groupBy("asked", "ordinal").agg(F.sum("points").alias("points"))
        first = F.broadcast(s.orderBy(F.desc("tenth"), "ordinal").limit(k).select("ordinal"))  # k rows
        every = met.unionByName(asked.crossJoin(first).withColumn("points", F.lit(0).cast("long"))).groupBy("asked", "ordinal").agg(F.max("points").alias("points"))
        scored = every.join(s.select("ordinal", "tenth"), "ordinal").select("asked", "ordinal", (F.col("points") + F.col("tenth")).cast("int").alias("score"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "ordinal"))
    ranked = scored.withColumn("rank", rank).filter(F.col("rank") <= k)
    return q.join(ranked, q["asked"].eqNullSafe(ranked["asked"])).select(key, "ordinal", "score", "rank")


def spec_ratio(passed: Column, total: Column) -> Column:
    return F.when(passed.isNotNull() & (total > 0), passed / total).otherwise(0.5)


def best_candidate(df: DataFrame, unit: str) -> DataFrame:
    """Among those that compile: spec ratio, score, fewer unsafe, then order. If none does: the score, then the last."""
    compiles = F.col("compiles")
    order = [
        F.desc("compiles"),
        F.desc(F.when(compiles, spec_ratio(F.col("specs_passed"), F.col("specs_total")))),
        F.desc("score"),
        F.when(compiles, F.col("unsafe")),
        F.when(compiles, F.col("ordinal")).otherwise(-F.col("ordinal")),
    ]
    return first_by(df, [unit], order)


def first_that_compiles(df: DataFrame, unit: str) -> DataFrame:
    return first_by(df, [unit], [F.desc("compiles"), F.col("ordinal")])


def tournament(df: DataFrame, unit: str) -> DataFrame:
    """The winner of pairwise rounds: the comparison is lexicographic and ties go left, so it is the first in its order."""
    return first_by(df, [unit], [F.desc("compiles"), F.desc("score"), F.col("unsafe"), F.col("cost"), F.col("ordinal")])


def keep_best(df: DataFrame, key: str, score: str, arrival: str) -> DataFrame:
    """Upsert in order of arrival where a higher score replaces; the earliest of the highest stays."""
    return first_by(df, [key], [F.desc(score), F.col(arrival)])


def keep_capacity(df: DataFrame, score: str, arrival: str, key: str, most: int) -> DataFrame:
    """The rows of highest score, the earliest first; rows of one score and arrival come by key, so that the order is total."""
    return df.orderBy(F.desc(score), arrival, key).limit(most)


def merge_counts(df: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
