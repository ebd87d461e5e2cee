"""Joins of result sets, states, errors and patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def compare_results(a: DataFrame, b: DataFrame, name: str, ordinal: str, values: list[str]) -> DataFrame:
    """Full outer comparison by name: a keeps its repeated names, b only fills in names that a lacks.

    Every row shows a's first and b's first row of its name, null where a side has none.
    """
    first = lambda df, side: first_by(df, [name], [F.col(ordinal)]).select(name, *[F.col(v).alias(f"{side}_{v}") for v in values])
    names = a.groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    both = first(a, "a").join(first(b, "b"), name, "full_outer").join(names, name, "left")
    return both.withColumn("__i", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("__n"), F.lit(1)).cast("int")))).drop("__n", "__i")


def regressions(base: DataFrame, now: DataFrame, name: str, state: str, ordinal: str) -> DataFrame:
    """Base rows that were validated and whose first row now is not."""
    then = base.filter(F.col(state) == "Validated").select(name, F.col(state).alias("was"))
    return then.join(first_by(now, [name], [F.col(ordinal)]).select(name, F.col(state).alias("is")), name).filter(F.col("is") != "Validated")


def match_with_fallback(left: DataFrame, right: DataFrame, key: str, payload: str) -> DataFrame:
    """left joined to right by key, else by the key with `-` as `_`; rows that match neither way go."""
    exact = right.select(F.col(key).alias("__k1"), F.col(payload).alias("__p1"))
    under = right.select(F.col(key).alias("__k2"), F.col(payload).alias("__p2"))
    joined = left.join(exact, left[key] == F.col("__k1"), "left").join(under, F.translate(left[key], "-", "_") == F.col("__k2"), "left")
    return joined.withColumn(payload, F.coalesce("__p1", "__p2")).filter(F.col(payload).isNotNull()).drop("__k1", "__p1", "__k2", "__p2")


def not_migrated(functions: DataFrame, states: DataFrame, name: str, done: str) -> DataFrame:
    """Functions without a state that is done."""
    return functions.join(states.filter(F.col(done)).select(name), name, "left_anti")


def missing_counterparts(names: DataFrame, keys: list[str], lower: Column, snake: Column, known: DataFrame) -> DataFrame:
    """Rows of names of which neither form is known; each form is an equi-join of its own.

    The last of the keys is the name, those before it say where it must be known; known has the same columns.
    """
    *where, name = keys
    forms = names.select(*keys, F.explode(F.array_distinct(F.array(lower, snake))).alias("__form"))
    found = forms.join(known.select(*where, F.col(name).alias("__form")).distinct(), [*where, "__form"], "left_semi").select(*keys).distinct()
    return names.join(found, keys, "left_anti")


def fixed_errors(before: DataFrame, after: DataFrame, keys: list[str], line: str, reach: int = 5) -> DataFrame:
    """Errors of before without one of the same keys within reach lines after.

    Lines fall into cells of reach + 1, and an error can only meet those of its cell and the two beside it: the join
    is by keys and cell, so that one code with very many errors does not compare all of them.
    """
    cell = F.floor(F.col(line) / (reach + 1))
    spread = after.select(*keys, F.col(line).alias("__line"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("__cell"))
    marked = before.withColumn("__cell", cell)
    near = [marked[k] == spread[k] for k in keys] + [marked["__cell"] == spread["__cell"], F.abs(marked[line] - spread["__line"]) <= reach]
    return marked.join(spread, near, "left_anti").drop("__cell")


def enclosing(events: DataFrame, keys: list[str], order: str, is_start: Column, value: str) -> DataFrame:
    """Each event with the value of the last start at or before it, as-of backward; null before the first."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("enclosing", F.last(F.when(is_start, F.col(value)), ignorenulls=True).over(so_far))


def match_patterns(errors: DataFrame, patterns: list[tuple[str, str, int, int]], code: str, message: str) -> DataFrame:
    """Errors joined to reliable patterns (code, text, successes, failures) whose text their message holds or matches.

    Patterns are a small store on the driver: those that do not compile can only be held literally.
    """
    rows = []
    for ordinal, (of, text, good, bad) in enumerate(patterns):
        if good > 0 and (bad == 0 or good / (good + bad) >= 0.5):
            try:
                re.compile(text)
                rows.append((ordinal, of, text, True, good))
            except re.error:
                rows.append((ordinal, of, text, False, good))
    store = errors.sparkSession.createDataFrame(rows, "ordinal int, p_code string, p_text string, compiles boolean, successes int")
    texts = F.expr(f"contains({message}, p_text) OR (compiles AND {message} RLIKE IF(compiles, p_text, 'a'))")
    return errors.join(F.broadcast(store), (errors[code] == F.col("p_code")) & texts)


def best_match(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The match of most successes for each key, then the first."""
    return first_by(matches, keys, [F.desc("successes"), F.col("ordinal")])
