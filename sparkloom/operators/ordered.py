"""Computations whose result depends on order: folds, running sums over lines, forward fills, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import emitting
from ..functions.text import lines, strip


def exploded_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., pos, line): pos counts from 0."""
    return df.select(*keep, F.posexplode(lines(F.col(text))).alias("pos", "line"))


def code_only(line: Column) -> Column:
    """A line without what is in string literals and after `//`; escapes count, and strings end with their line."""
    line = strip(line)
    # Possessive, so that a literal of any length needs no stack.
    bare = F.regexp_replace(line, r'"[^"\\]*+(?:\\.[^"\\]*+)*+("|\z)', "")
    return F.when(line.startswith("//"), "").otherwise(F.regexp_replace(bare, r"//.*", ""))


def brace_delta(line: Column) -> Column:
    code = code_only(line)
    return F.when(line.contains("{") | line.contains("}"), F.regexp_count(code, F.lit(r"\{")) - F.regexp_count(code, F.lit(r"\}"))).when(line.isNotNull(), 0)


def brace_depth(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, pos, line, depth) with the running depth after each line."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return exploded_lines(df, text, [key]).withColumn("depth", F.sum(brace_delta(F.col("line"))).over(so_far))


def brace_state(rows: Column) -> Column:
    """(n, depth, even) of a text's lines: their number, the depth after the last, and the lines up to the last of depth 0."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(0).alias("even"))

    def step(acc, d):
        n, depth = acc["n"] + 1, acc["depth"] + d
        return F.struct(n.alias("n"), depth.alias("depth"), F.when(depth == 0, n).otherwise(acc["even"]).alias("even"))

    return F.aggregate(F.transform(rows, brace_delta), start, step)


def closed_braces(text: Column, rows: Column, state: Column) -> Column:
    """A text cut after the last line of depth 0 if braces stay open, else closed at the end; balanced texts stay."""
    n, depth, even = state["n"], state["depth"], state["even"]
    shortened = F.concat(F.array_join(F.slice(rows, 1, even), "\n"), F.lit("\n// truncated "), (n - even).cast("string"), F.lit(" lines of incomplete code"))
    closed = F.concat(text, F.lit("\n"), F.repeat(F.lit("}"), depth), F.lit(" // auto-closed: truncated output"))
    return F.coalesce(F.when(depth <= 0, text).when((even > 0) & (even < n), shortened).otherwise(closed), text)


def close_braces(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, text) with open braces cut off or closed. Narrow: one fold over a text's lines, with a state of three numbers."""
    rows = lines(F.col(text))
    known = df.select(key, text, rows.alias("__r")).withColumn("__f", brace_state(F.col("__r")))
    return known.select(key, closed_braces(F.col(text), F.col("__r"), F.col("__f")).alias(text))


def of_current_file(df: DataFrame, text: str, key: str, file: Column) -> DataFrame:
    """(key, pos, line) of preprocessed text: lines after a line directive of the file, without blank ones.

    Directives start with # and hold a quote. If that leaves nothing of a text, all its other lines stay.
    """
    rows = exploded_lines(df.withColumn("__f", file), text, [key, "__f"])
    directive = F.col("line").startswith("#") & F.col("line").contains('"')
    mine = F.contains(F.col("line"), F.col("__f")) | F.col("line").contains('"<stdin>"')
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("directive", directive).withColumn("inside", F.coalesce(F.last(F.when(directive, mine), ignorenulls=True).over(so_far), F.lit(False)))
    marked = marked.withColumn("kept", F.col("inside") & ~F.col("directive") & (strip(F.col("line")) != ""))
    some = F.max("kept").over(Window.partitionBy(key))
    return marked.withColumn("some", some).filter(F.expr("IF(some, kept, NOT directive)")).select(key, "pos", "line")


def first_definitions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each definition in the order of modules and positions."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def best_version(df: DataFrame, key: str, order: str, ceiling: Column) -> DataFrame:
    """(key, best): the order of the version that a fold keeps.

    A version with substance and no more unsafe than the ceiling replaces the kept one if its score is higher, or if
    it compiles and the kept one does not - so a later lower score can win, which no maximum gives.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, "score", "compiles", "unsafe", "substance")))
    start = F.struct(F.lit(None).cast("long").alias("best"), F.lit(0).cast("int").alias("score"), F.lit(False).alias("compiles"))

    def step(acc, x):
        wins = x["substance"] & (x["unsafe"] <= ceiling) & ((x["score"] > acc["score"]) | (x["compiles"] & ~acc["compiles"]))
        taken = F.struct(x[order].cast("long").alias("best"), x["score"].cast("int").alias("score"), x["compiles"].alias("compiles"))
        return F.when(wins, taken).otherwise(acc)

    return df.groupBy(key).agg(rows.alias("__v")).select(key, F.aggregate("__v", start, step).alias("__b")).select(key, F.col("__b.best").alias("best"), F.col("__b.score").alias("score"))


def packed(sizes: Column, target: Column) -> Column:
    """Chunk number of each size in turn: a new chunk begins when the current one is not empty and would pass the target."""
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("have"))

    def step(acc, n):
        new = (acc["at"] < 0) | (acc["have"] + n > target)
        at = (acc["at"] + new.cast("int")).cast("long")
        have = (F.when(new, F.lit(0)).otherwise(acc["have"]) + n).cast("long")
        return F.struct(at.alias("at"), have.alias("have")), F.array(at)

    return emitting(sizes, start, step, "bigint")


def stalls(counts: Column) -> Column:
    """Running stall counter of error counts in turn: one more where the count repeats above 0, else 0."""
    start = F.struct(F.lit(None).cast("int").alias("prev"), F.lit(0).alias("n"))

    def step(acc, x):
        n = F.when(acc["prev"].isNull(), acc["n"]).when((x == acc["prev"]) & (x > 0), acc["n"] + 1).otherwise(0).cast("int")
        return F.struct(x.cast("int").alias("prev"), n.alias("n")), F.array(n)

    return emitting(counts, start, step, "int")


def earlier_waves(df: DataFrame, key: str, wave: str, value: str) -> DataFrame:
    """Each row with the values of all earlier waves of its key, none of its own wave."""
    before = Window.partitionBy(key).orderBy(wave).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("seen", F.sort_array(F.collect_list(value).over(before)))
