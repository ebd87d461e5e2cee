"""Outlines of source texts and of answers about them: bodies elided, fenced JSON parsed, notes from signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import emitting
from .text import lines, strip

#: How lines start that are kept whole, and what stands for a body.
DECLARATIONS = ("#include", "#define", "typedef", "struct ", "enum ", "union ")
MAIN_HEADS = ("int main", "void main")
ELIDED = "    // ... (body abbreviated for context)"


def _starts(line: Column, heads: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(h) for h in heads]), lambda h: F.startswith(line, h))


def abbreviated(text: Column, most: int) -> Column:
    """A text of more than `most` lines with the bodies of functions elided; declarations and main stay whole.

    One fold over the lines. Its state is the depth of braces and whether a body is being left out (0 no, 1 yes, 2 and
    said so). A body starts where braces open at depth 0, and lasts until they are closed.
    """
    rows = lines(text)
    of = F.transform(rows, lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    state = lambda d, b: F.struct(d.cast("int").alias("depth"), b.cast("int").alias("body"))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        opened, closed = F.regexp_count(x["bare"], F.lit(r"\{")), F.regexp_count(x["bare"], F.lit(r"\}"))
        depth, main = acc["depth"] + opened - closed, _starts(x["bare"], MAIN_HEADS)
        body = F.when(main, 0).otherwise(acc["body"])
        enters = (acc["depth"] == 0) & (opened > 0) & ~main & ~_starts(x["bare"], DECLARATIONS)
        inside = (body > 0) & (acc["depth"] > 0)
        after = F.when(enters, state(depth, F.lit(1))).when(inside & (depth <= 0), state(F.lit(0), F.lit(0))).when(inside, state(depth, F.lit(2)))
        said = F.when(body == 1, F.array(F.lit(ELIDED))).otherwise(F.array().cast("array<string>"))
        out = F.when(~enters & inside, F.when(depth <= 0, F.array_append(said, F.lit("}"))).otherwise(said)).otherwise(F.array(x["line"]))
        return after.otherwise(state(F.greatest(depth, F.lit(0)), body)), out

    short = emitting(of, state(F.lit(0), F.lit(0)), step, "string")
    return F.when(F.size(rows) <= most, text).otherwise(F.array_join(short, "\n"))


#: What lines of the summary's sections start with, or may not start with.
RECORDS = ("struct ", "enum ", "union ")
NOT_SIGNATURES = ("//", "#", "typedef", "if", "while", "for")
SHOWN_GLOBALS = 10


def declarations(text: Column) -> Column:
    """C-21: array<struct<kind, text>> of a C source's typedefs, records, top-level signatures and globals, in order.

    One pass over the lines by an automaton of two states: within a record whose braces are open, whose lines are
    passed over, or else at a depth of braces that is never below 0. A record inside a function ends at depth 0.
    """
    of = F.transform(lines(text), lambda x: strip(x))
    state = lambda record, depth: F.struct(record.alias("record"), depth.cast("int").alias("depth"))
    entry = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    head = lambda x: strip(F.substring_index(x, "{", 1))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        change = F.regexp_count(x, F.lit(r"\{")) - F.regexp_count(x, F.lit(r"\}"))
        record = _starts(x, RECORDS) & x.contains("{")
        typedef = x.startswith("typedef")
        top = acc["depth"] == 0
        signature = top & ~_starts(x, NOT_SIGNATURES) & x.contains("(") & (x.endswith("{") | x.endswith(")")) & (head(x) != "")
        value = top & ~_starts(x, ("//", "#")) & x.contains("=") & x.endswith(";") & ~x.contains("(")
        found = F.when(record, F.array(entry("record", head(x)))).when(typedef, F.array(entry("typedef", x)))
        found = found.otherwise(F.array_compact(F.array(F.when(signature, entry("function", head(x))), F.when(value, entry("global", x)))))
        inside = F.when(acc["record"], acc["depth"] + change).otherwise(change)
        after = F.when(acc["record"] | record, state(inside > 0, F.greatest(inside, F.lit(0))))
        after = after.when(typedef, acc).otherwise(state(F.lit(False), F.greatest(acc["depth"] + change, F.lit(0))))
        return after, F.when(acc["record"], F.array().cast("array<struct<kind:string,text:string>>")).otherwise(found)

    return emitting(of, state(F.lit(False), F.lit(0)), step, "struct<kind:string,text:string>")


def structural_summary(found: Column) -> Column:
    """Sections on the declarations of a text by kind; of more than ten globals the rest is counted. None give an empty text.

    `found` should be a column of its own: it is read once for each section.
    """

    def section(kind: str, write: Callable[[Column], Column]) -> Column:
        own = F.transform(F.filter(found, lambda e: e["kind"] == kind), lambda e: e["text"])
        return F.when(F.size(own) > 0, F.concat(write(own), F.lit("\n"))).otherwise("")

    count = lambda own: F.size(own).cast("string")
    more = lambda own: F.when(F.size(own) > SHOWN_GLOBALS, F.concat(F.lit(" ... and "), (F.size(own) - SHOWN_GLOBALS).cast("string"), F.lit(" more"))).otherwise("")
    sections = F.concat(
        section("typedef", lambda own: F.concat(F.lit("**Typedefs ("), count(own), F.lit("):** "), F.array_join(own, "; "))),
        section("record", lambda own: F.concat(F.lit("**Structs/Enums ("), count(own), F.lit("):** "), F.array_join(own, ", "))),
        section("function", lambda own: F.concat(F.lit("**Functions ("), count(own), F.lit("):**\n"), F.array_join(F.transform(own, lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n"))),
        section("global", lambda own: F.concat(F.lit("**Globals ("), count(own), F.lit("):** "), F.array_join(F.slice(own, 1, SHOWN_GLOBALS), "; "), more(own))),
    )
    return F.when(found.isNotNull(), sections)


#: Lines of headers that are passed over, and what lines that define types start with.
HEADER_NOISE = ("#pragma", "#ifndef", "#define _", "#endif", "#include", "#ifdef", "#else", "#if ")
TYPE_STARTS = ("typedef ", "struct ", "enum ", "#define ", "extern ")


def header_type_lines(text: Column) -> Column:
    """S-15: the lines of a C header that define types, with those of the blocks that they open, as an array."""
    of = F.transform(lines(text), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        change = F.regexp_count(x["bare"], F.lit(r"\{")) - F.regexp_count(x["bare"], F.lit(r"\}"))
        noise = _starts(x["bare"], HEADER_NOISE)
        begins = _starts(x["bare"], TYPE_STARTS) | (x["bare"].contains("typedef") & x["bare"].contains("(*)"))
        kept = ~noise & ((acc["block"]) | begins)
        depth = F.when(kept, acc["depth"] + change).otherwise(acc["depth"])
        block = F.when(kept, depth > 0).otherwise(acc["block"])
        return F.struct(block.alias("block"), depth.cast("int").alias("depth")), F.when(kept, F.array(x["line"])).otherwise(F.array().cast("array<string>"))

    start = F.struct(F.lit(False).alias("block"), F.lit(0).alias("depth"))
    return emitting(of, start, step, "string")


def fenced_json(text: Column) -> Column:
    """What the first ```json fence holds, else the first fence of any kind; all where that is not closed or missing."""
    after = lambda mark: F.substring_index(F.regexp_replace(text, rf"(?s)\A.*?{mark}", ""), "```", 1)
    closed = lambda mark: text.rlike(rf"(?s)\A.*?{mark}.*?```")
    tagged = text.contains("```json")
    inside = F.when(tagged & closed("```json"), after("```json")).when(~tagged & closed("```"), after("```")).otherwise(text)
    return strip(inside)


def parsed_json(text: Column, schema: str, required: list[str]) -> Column:
    """(value, error) of the JSON that a text holds: error says that it is malformed or lacks a required field."""
    value = F.from_json(fenced_json(text), schema)
    fails = value.isNull() | F.coalesce(F.greatest(*[value[f].isNull() for f in required]), F.lit(True)) if len(required) > 1 else value.isNull() | value[required[0]].isNull()
    return F.struct(F.when(~fails, value).alias("value"), F.when(fails, "failed to parse analysis JSON").alias("error"))


def brief_of(signature: Column, name: Column) -> Column:
    """A sentence about a translated function: its parameters' names, and what it returns unless that is ()."""
    head = r"fn\s+\w+\(([^)]*)\)(?:\s*->\s*(\S+))?"
    inside, returned = F.regexp_extract(signature, head, 1), F.regexp_extract(signature, head, 2)
    names = F.transform(F.split(inside, ","), lambda p: strip(F.substring_index(p, ":", 1)))
    known = signature.rlike(head)
    given = F.when(known & (inside != ""), F.concat(F.lit(" with "), F.array_join(names, ", "))).otherwise("")
    gives = F.when(known & (returned != "") & (returned != "()"), F.concat(F.lit(", returning `"), returned, F.lit("`"))).otherwise("")
    return F.concat(F.lit("Migrated from C function `"), name, F.lit("`"), given, gives, F.lit("."))


def comments_above(text: Column, name: Column) -> Column:
    """W-04: the comments right above the first line that holds a name and a parenthesis, as an array of their lines.

    Blank lines between do not matter. Line comments come in order; a block comment ends the search, and its lines come
    first and from its last line up. Comment marks and blank lines of a block go.
    """
    bare = F.transform(lines(text), strip)
    at = F.array_position(F.transform(bare, lambda x: F.contains(x, name) & x.contains("(") & ~x.startswith("//")), True).cast("int")
    above = F.reverse(F.slice(bare, 1, F.greatest(at - 1, F.lit(1))))
    stop = F.array_position(F.transform(above, lambda x: ~x.startswith("//") & (x != "")), True).cast("int")
    taken = F.when(stop > 0, F.slice(above, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(above)
    single = F.transform(F.filter(taken, lambda x: x.startswith("//")), lambda x: strip(F.regexp_replace(x, r"\A(?://)+", "")))
    rest = F.when((stop > 0) & F.get(above, stop - 1).endswith("*/"), F.slice(above, F.greatest(stop, F.lit(1)), F.size(above))).otherwise(F.array().cast("array<string>"))
    begin = F.array_position(F.transform(rest, lambda x: x.contains("/*")), True).cast("int")
    block = F.when(begin > 0, F.slice(rest, 1, F.greatest(begin, F.lit(1)))).otherwise(rest)
    cleaned = F.transform(block, lambda x: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\A(?:/\*)+", ""), r"(?:\*/)+\z", ""), r"\A\*+", "")))
    return F.when(at > 0, F.concat(F.filter(cleaned, lambda x: x != ""), F.reverse(single))).when(text.isNotNull(), F.array().cast("array<string>"))


#: Heads of functions that get documentation, and the note on unsafe code.
DOCUMENTED = ("pub fn ", "fn ", "pub unsafe fn ", "unsafe fn ")
SAFETY_NOTE = ("///", "/// # Safety", "/// This function contains unsafe code.")


def documented(rust: Column, comments: Column, name: Column) -> Column:
    """C-28: a Rust text with documentation above each function that has none: the C comments, or else a brief of its head.

    A function has documentation if the last line before it that is not blank is some. `comments` should be a column of
    its own. Each line ends with a line feed.
    """
    of = F.transform(lines(rust), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    given = F.transform(comments, lambda x: F.concat(F.lit("/// "), x))
    note = F.when(rust.contains("unsafe "), F.array(*[F.lit(x) for x in SAFETY_NOTE])).otherwise(F.array().cast("array<string>"))

    def step(has: Column, x: Column) -> tuple[Column, Column]:
        brief = F.array(F.concat(F.lit("/// "), brief_of(x["bare"], name)))
        wants = _starts(x["bare"], DOCUMENTED) & ~has
        out = F.when(wants, F.concat(F.when(F.size(given) > 0, given).otherwise(brief), note, F.array(x["line"]))).otherwise(F.array(x["line"]))
        return F.when(x["bare"] == "", has).otherwise(x["bare"].startswith("///")), out

    return F.array_join(F.transform(emitting(of, F.lit(False), step, "string"), lambda x: F.concat(x, F.lit("\n"))), "")


def heads_in(text: Column) -> Column:
    """Lower-case names x for which `fn x(` stands in a text: those in blocks, too."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"fn (\w+)\("), F.lit(1)))
