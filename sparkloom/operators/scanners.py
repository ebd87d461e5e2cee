"""Scanners that no regular expression replaces, as Pandas functions over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matching(text: str, at: int, opening: str = "{", closing: str = "}") -> int:
    """Where the bracket that opens at `at` closes; the text's length if it stays open."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == opening) - (text[i] == closing)
        if depth == 0:
            return i
    return len(text)


def empty_functions(text: str) -> int:
    """Functions whose body is blank or just todo!(); what stands inside a body is not looked at again."""
    found = at = 0
    while (head := min((i for i in (text.find("fn ", at), text.find("fn(", at)) if i >= 0), default=-1)) >= 0:
        brace = text.find("{", head + 2)
        if brace < 0:
            break
        end = matching(text, brace)
        found += text[brace + 1 : end].strip() in ("", "todo!()")
        at = end + 1
    return found


def top_level_parts(text: str) -> list[str]:
    """Arguments between top-level commas, trimmed; blank ones go."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


@F.pandas_udf(T.IntegerType())
def empty_function_count(texts: pd.Series) -> pd.Series:
    return texts.map(empty_functions, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_arguments(texts: pd.Series) -> pd.Series:
    return texts.map(top_level_parts, na_action="ignore")
