"""How rows are dealt to tasks before they grow."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame

#: Rows that a task gets.
TASK_ROWS = 2500


def spread(df: DataFrame, *by: Column | str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by columns into as many partitions as it has times `rows`, for narrow rows that texts are made from.

    A file of keys is small, so few tasks read it, and adaptive execution joins small partitions again. Neither sees
    that each key grows to a text and its tokens. A number of partitions that is asked for stays, and what groups by
    the same columns later moves nothing. Counting reads no column.
    """
    return df.repartition(max(1, math.ceil(df.count() / rows)), *by)
