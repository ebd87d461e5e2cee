"""Folds over arrays whose result is a sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def emitting(values: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What a fold over an array emits: step gives the next state and an array<kind> of what comes out, often of one or none.

    A fold's state is copied at every step, so that one which holds all that came out would take time with the square
    of its length. Here an outer fold goes over blocks of about the root of the length, and an inner one holds what
    comes out of a block. Null gives null.
    """
    once = F.array(values)  # in an array, so that lambdas below take what it holds and do not compute it again

    def inner(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        done = F.array(F.aggregate(block, begin, inner))
        return F.transform(done, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))[0]

    def fold(v: Column) -> Column:
        length = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        last = F.ceil(F.size(v) / length).cast("int") - 1
        numbers = F.when(F.size(v) > 0, F.sequence(F.lit(0), last)).when(v.isNotNull(), F.array().cast("array<int>"))
        blocks = F.transform(numbers, lambda b: F.slice(v, b * length + 1, length))
        begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(blocks, begin, outer, lambda acc: F.flatten(acc["out"]))

    return F.transform(once, fold)[0]
