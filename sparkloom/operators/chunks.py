"""Chunks of long C sources: functions of the data model first, tables of data by themselves, the rest packed in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import c_types, line_count, strip
from .ordered import exploded_lines, packed
from .spans import block_ends, c_functions, c_tokens

#: Parts of the names of functions that make, read or set data, and those that count behind a type's name.
MODEL_PARTS = ("create", "new", "init", "is_", "get_", "set_")
TYPED_PARTS = ("create", "is", "get", "set")
SHORT_BODY, LONG_TABLE = 20, 30


def data_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, end, name, source): static or constant arrays of more than thirty lines, lines from 0, both inclusive.

    What begins within another array's block is part of it.
    """
    bare = strip(F.col("line"))
    head = (bare.startswith("static ") | bare.startswith("const ")) & bare.contains("[") & bare.contains("= {")
    rows = exploded_lines(df, text, [key])
    blocks = block_ends(rows, [key], "pos", "line", head)
    before = F.max("end").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    outer = blocks.withColumn("before", before).filter((F.coalesce("before", F.lit(-1)) < F.col("pos")) & (F.col("end") - F.col("pos") >= LONG_TABLE))
    name = F.element_at(F.split(strip(F.substring_index("line", "[", 1)), r"\s+"), -1)
    named = outer.select(key, "pos", "end", name.alias("name"))
    source = F.concat(F.array_join(F.slice(F.split(text, "\n"), F.col("pos") + 1, F.col("end") - F.col("pos") + 1), "\n"), F.lit("\n"))
    return named.join(df.select(key, text), key).select(key, "pos", "end", "name", source.alias("source"))


def is_model(name: Column, body_lines: Column, types: Column) -> Column:
    """Whether a short function's name says that it belongs to the data model; types are lower-case names of types."""
    low = F.lower(name)
    any_of = lambda parts: reduce(lambda a, b: a | b, [low.contains(p) for p in parts])
    return (body_lines < SHORT_BODY) & (any_of(MODEL_PARTS) | (F.exists(types, lambda t: low.startswith(t)) & any_of(TYPED_PARTS)))


def structural_chunks(df: DataFrame, key: str, text: str, target: int) -> DataFrame:
    """(key, chunk, is_data, names, lines, source): functions of each text in chunks of up to `target` lines.

    Chunk 0 has all functions of the data model, and the next one the tables of data. A text without types or without
    such functions has its functions packed only, and one without functions is a chunk of its own, without a source.
    Packing fills one chunk after the other; a function longer than the target has a chunk for itself.
    """
    texts = df.select(key, F.col(text).alias("text"))
    spans = c_functions(c_tokens(texts, key, "text"), key)
    known = texts.select(key, "text", F.transform(c_types(F.col("text")), F.lower).alias("types"), line_count(F.col("text")).alias("all"))
    source = F.substring(F.col("text"), F.col("first") + 1, F.col("last") - F.col("first"))
    body = F.substring(F.col("text"), F.col("opens") + 1, F.col("last") - F.col("opens"))
    rows = known.join(spans, key, "left").withColumn("source", source).withColumn("model", is_model(F.col("function"), line_count(body), F.col("types")) & (F.size("types") > 0))
    each = F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct("body", "function", (F.col("last_line") - F.col("first_line") + 1).cast("long").alias("n"), "model", "source"))))
    grouped = rows.groupBy(key).agg(each.alias("v"), F.first("all").alias("all"))
    blocks = data_blocks(texts, key, "text").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("name").alias("function"), (F.col("end") - F.col("pos") + 1).cast("long").alias("n"), "source"))).alias("d"))
    model, logic = F.filter("v", lambda f: f["model"]), F.filter("v", lambda f: ~f["model"])
    both = grouped.join(blocks, key, "left").select(key, "v", "all", model.alias("m"), logic.alias("g"), F.coalesce("d", F.array().cast(blocks.schema["d"].dataType)).alias("d"))
    structured = F.size("m") > 0
    both = both.withColumn("d", F.when(structured, F.col("d")).otherwise(F.slice("d", 1, 0)))
    both = both.withColumn("at", packed(F.transform("g", lambda f: f["n"]), F.lit(target))).withColumn("first", F.lit(0) + structured.cast("int") + (F.size("d") > 0).cast("int"))
    member = lambda f, chunk, i, data: F.struct(chunk.cast("int").alias("chunk"), i.alias("i"), F.lit(data).alias("is_data"), f["function"].alias("name"), f["n"].alias("n"), f["source"].alias("source"))
    members = F.concat(
        F.transform("m", lambda f, i: member(f, F.lit(0), i, False)),
        F.transform("d", lambda f, i: member(f, F.lit(1), i, True)),
        F.transform("g", lambda f, i: member(f, F.col("first") + F.get("at", i), i, False)),
    )
    whole = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("i"), F.lit(False).alias("is_data"), F.lit(None).cast("string").alias("name"), F.col("all").cast("long").alias("n"), F.lit(None).cast("string").alias("source"))
    rows = both.select(key, F.explode(F.when(F.size("v") > 0, members).otherwise(F.array(whole))).alias("x")).select(key, "x.*")
    parts = F.array_sort(F.collect_list(F.struct("i", "name", "source")))
    out = rows.groupBy(key, "chunk", "is_data").agg(parts.alias("p"), F.sum("n").alias("lines"))
    own = lambda field: F.array_compact(F.transform("p", lambda x: x[field]))
    return out.select(key, "chunk", "is_data", own("name").alias("names"), "lines", F.array_join(own("source"), "\n\n").alias("source"))
