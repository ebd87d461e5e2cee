"""Scalar functions of the small expression language in the fixtures: positions count from 0, ranges leave out their end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_of(text: Column, part: str) -> Column:
    """-1 where the part is absent."""
    return F.instr(text, part) - 1


def substring(text: Column, start: int, end: int) -> Column:
    """Clamped to the text; nothing if start is not before end."""
    return F.substring(text, max(start, 0) + 1, max(end - max(start, 0), 0))


def char_at(text: Column, at: int) -> Column:
    return F.substring(text, at + 1, 1)


def round_half_away(x: Column) -> Column:
    return F.round(x, 0)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def number_text(x: Column) -> Column:
    """A number as printed: whole ones below 10**15 without a point, others like %.6g, which has six digits that count."""
    size = F.floor(F.log10(F.abs(x)))
    # Rounding to six digits may carry into one more place.
    places = F.floor(F.log10(F.abs(F.expr("1.0D") * F.round(x / F.pow(F.lit(10.0), size), 5)))) + size
    trimmed = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    plain = F.format_string("%.10f", F.bround(x * F.pow(F.lit(10.0), 5 - places), 0) / F.pow(F.lit(10.0), 5 - places))
    whole = F.format_string("%d", x.cast("long"))
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), whole).when((places >= -4) & (places < 6), trimmed(plain)).otherwise(trimmed(F.format_string("%.5e", x)))


def to_number(text: Column) -> Column:
    """The number that the text starts with, after white space; 0 where there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def add(a: Column, b: Column, a_text: bool, b_text: bool) -> Column:
    """The sum of two numbers; joined texts if either side is one, a number as it prints."""
    if not a_text and not b_text:
        return a + b
    return F.concat(a if a_text else number_text(a), b if b_text else number_text(b))


def divide(a: Column, b: Column) -> Column:
    """Null where C would fail on 0."""
    return F.when(b != 0, a / b)


def _bytes(text: Column) -> Column:
    """The bytes of a text's UTF-8, as numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    pairs = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    codes = F.transform(pairs, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.length(digits) > 0, codes).otherwise(F.array().cast("array<int>"))


def djb2(text: Column) -> Column:
    """h * 33 + byte from 5381, modulo 2**32."""
    return F.aggregate(_bytes(text), F.lit(5381).cast("long"), lambda h, x: (h * 33 + x) % F.lit(1 << 32))


def adler32(text: Column) -> Column:
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(acc, x):
        a = (acc["a"] + x) % 65521
        return F.struct(a.alias("a"), ((acc["b"] + a) % 65521).alias("b"))

    return F.aggregate(_bytes(text), start, step, lambda acc: acc["b"] * 65536 + acc["a"])


def json_get(text: Column, key: str) -> Column:
    """The value of a key of any case, as text; null where there is none."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    return F.try_element_at(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == key.lower()), lambda e: e["value"]), F.lit(1))
