"""Scalar functions over source text, as columns. Counts of characters are code points unless a name says bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of idiomatic code, each worth 2 points up to three times.
POSITIVE_SIGNS = ("Result<", "Option<", ".iter()", ".into()", "impl ", "From<", "Into<", "enum ", ".collect()", ".map(", ".filter(", ".unwrap_or(", ".unwrap_or_else(", "Vec<", "String", "HashMap<", "&[", "&str")

#: Keyword and the tag that it gives.
TAG_KEYWORDS = (
    ("malloc", "memory"), ("free", "memory"), ("calloc", "memory"), ("realloc", "memory"), ("struct ", "struct"), ("enum ", "enum"), ("typedef", "typedef"),
    ("FILE", "file_io"), ("fopen", "file_io"), ("printf", "printf"), ("strcmp", "string"), ("strcpy", "string"), ("strlen", "string"), ("strdup", "string"),
    ("NULL", "null"), ("->", "pointer"), ("*)", "pointer"), ("void*", "pointer"), ("for (", "loop"), ("while (", "loop"), ("switch (", "switch"),
)

#: Parts of messages of errors that may pass.
TRANSIENT = ("502", "503", "504", "Bad Gateway", "Service Unavailable", "error decoding response body", "connection reset", "timed out")

#: Names that are no functions.
NOT_FUNCTIONS = ("if", "while", "for", "switch", "return", "sizeof", "typeof", "defined", "main", "__attribute__")

#: Fixed value: what a C function's head looks like.
C_FUNCTION = (
    r"(?m)^\s*(?:static\s+)?(?:inline\s+)?(?:const\s+)?(?:unsigned\s+)?(?:signed\s+)?(?:long\s+)?(?:short\s+)?(?:struct\s+\w+\s*\*?\s*|enum\s+\w+\s+)?"
    r"(?:void|int|char|float|double|size_t|ssize_t|uint\d+_t|int\d+_t|bool|_Bool|\w+_t)\s*\*?\s*\*?\s*(\w+)\s*\("
)
C_TYPE = r"(?:struct|enum|union|typedef\s+\w+\s+)\s*(\w+)\s*[{;]"
RUST_FUNCTION = r"(?m)^\s*(?:pub\s+)?(?:pub\(crate\)\s+)?(?:async\s+)?fn\s+(\w+)\s*\("


def has(text: Column, *parts: str) -> Column:
    """Whether text holds any of the parts, literally."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def occurrences(text: Column, part: str) -> Column:
    """How often a literal part occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


#: White space as \s takes it.
BLANKS = " \t\n\x0b\f\r"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lines(text: Column) -> Column:
    """Lines without their ends (LF or CR LF); a last line feed starts no line, and empty text has none."""
    parts = F.split(text, "\n", -1)
    full = F.when(F.length(text) == 0, F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text.contains("\r"), F.transform(full, lambda x: F.regexp_replace(x, r"\r\z", ""))).otherwise(full)


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def filled_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: strip(x) != ""))


def token_estimate(text: Column) -> Column:
    """Words and marks, one more for every 8 word characters, a quarter for each line after the first; 1 at least, 0 if empty."""
    word = r"\p{IsAlphabetic}\p{N}_"
    words, chars = F.regexp_count(text, F.lit(f"[{word}]++")), F.length(F.regexp_replace(text, f"[^{word}]++", ""))
    marks = F.regexp_count(text, F.lit(r"[^\p{IsAlphabetic}\p{N}_\s\p{Z}\u0085]"))
    total = words + marks + F.floor(chars / 8) + F.floor(F.greatest(line_count(text) - 1, F.lit(0)) / 4)
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(total, F.lit(1))).cast("long")


def difficulty(text: Column) -> Column:
    """easy, medium or hard, by the signs that need no parser."""
    pointers = text.contains("*") & ~text.contains("/*")
    hard = has(text, "void *", "void*", "goto ", "union ") | (text.contains("(*") & text.contains(")("))
    medium = pointers.cast("int") + has(text, "malloc", "calloc").cast("int") + text.contains(")(").cast("int")
    n = line_count(text)
    return F.when(hard | ((medium >= 2) & (n > 50)), "hard").when((medium >= 1) | (n > 30), "medium").otherwise("easy")


def cast_count(text: Column) -> Column:
    """Words that are just `as`."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w == "as"))


def index_count(text: Column) -> Column:
    return occurrences(text, "[i]") + occurrences(text, "[j]") + occurrences(text, "[idx]")


def function_count(text: Column) -> Column:
    """Lines that start a function."""
    head = lambda x: (x.startswith("fn ") | x.startswith("pub fn ") | x.startswith("pub(crate) fn ")) & x.contains("(")
    return F.size(F.filter(lines(text), lambda x: head(strip(x))))


def base_score(unsafe: Column, warnings: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - unsafe * 10 - warnings * 2)


def has_substance(c_lines: Column, rust_lines: Column, functions: Column, empty: Column) -> Column:
    """False for output that is too short for its source or mostly empty functions."""
    thin = (c_lines > 20) & (rust_lines < F.floor(c_lines / 4))
    hollow = (functions > 3) & (empty * 10 > functions * 3)
    return ~(thin | hollow)


def idiom_score(rust: Column, c: Column, unsafe: Column, warnings: Column, empty: Column) -> Column:
    """0 to 100; empty is the number of functions without a body (see operators.scanners)."""
    base, c_n, r_n, functions = base_score(unsafe, warnings), filled_lines(c), filled_lines(rust), function_count(rust)
    thin = F.when(c_n > 20, r_n < F.floor(c_n / 4)).otherwise(r_n < 1)
    hollow = (functions > 3) & (empty * 10 > functions * 3)
    good = reduce(lambda a, b: a + b, [F.least(occurrences(rust, p), F.lit(3)) * 2 for p in POSITIVE_SIGNS])
    bad = occurrences(rust, ".unwrap()") * 3 + cast_count(rust) + index_count(rust) * 2
    shorter = F.when((c_n > 5) & (r_n > 0) & (r_n < c_n), 5).otherwise(0)
    full = F.greatest(F.lit(0), F.least(F.lit(100), base + good - bad + shorter))
    return F.when(thin, F.least(base, F.lit(15))).when(hollow, F.least(base, F.lit(20))).otherwise(full).cast("int")


def idiom_hints(rust: Column) -> Column:
    """Kinds of hints that apply, in order: casts above 5, indexing above 5, unwraps above 2; a warning goes first."""
    found = F.array_compact(
        F.array(
            F.when(cast_count(rust) > 5, F.concat(F.lit("casts:"), cast_count(rust).cast("string"))),
            F.when(index_count(rust) > 5, F.concat(F.lit("indexing:"), index_count(rust).cast("string"))),
            F.when(occurrences(rust, ".unwrap()") > 2, F.concat(F.lit("unwraps:"), occurrences(rust, ".unwrap()").cast("string"))),
        )
    )
    return F.when(F.size(found) > 0, F.concat(F.array(F.lit("keep behaviour")), found)).otherwise(found)


def pattern_tags(text: Column) -> Column:
    found = F.array(*[F.when(text.contains(k), F.lit(t)) for k, t in TAG_KEYWORDS])
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def all_matches(text: Column, pattern: str) -> Column:
    """What the first group of each match of a pattern holds, in order. The group must take part in every match.

    Matches are marked in one pass and cut out. regexp_extract_all copies what is left of a text at each match, which
    takes time with the square of a long text's length.
    """
    mark, hit = "\x01", "\x02"
    pieces = F.split(F.regexp_replace(text, pattern, f"{mark}{hit}$1{mark}"), mark)
    return F.transform(F.filter(pieces, lambda p: p.startswith(hit)), lambda p: F.substring(p, F.lit(2), F.length(p)))


def c_functions(text: Column) -> Column:
    """Names of functions as their heads show them, in order, with repeats."""
    names = all_matches(text, C_FUNCTION)
    return F.filter(names, lambda n: ~n.isin(*NOT_FUNCTIONS) & ~n.startswith("_"))


def c_types(text: Column) -> Column:
    return F.array_sort(F.array_distinct(all_matches(text, C_TYPE)))


def c_calls(text: Column) -> Column:
    """Names before a parenthesis, in order, with repeats; keywords are no calls."""
    names = F.regexp_extract_all(text, F.lit(r"\b(\w+)\s*\("), F.lit(1))
    return F.filter(names, lambda n: ~n.isin(*[k for k in NOT_FUNCTIONS if k != "main"]))


def rust_functions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUST_FUNCTION), F.lit(1))


def rust_signatures(text: Column) -> Column:
    """Lines that start a function, up to their brace."""
    heads = F.filter(F.transform(lines(text), strip), lambda x: (x.startswith("pub fn ") | x.startswith("fn ")) & x.contains("("))
    return F.transform(heads, lambda x: strip(F.substring_index(x, "{", 1)))


def name_prefix(name: Column) -> Column:
    """Lower case: up to the first underscore if that is over one byte, else up to the first rise in case, else all."""
    before = F.when(name.contains("_"), F.substring_index(name, "_", 1))
    camel = F.regexp_extract(name, r"^(.*?[a-z])[A-Z]", 1)
    return F.lower(F.when(F.octet_length(before) > 1, before).when(F.length(camel) > 1, camel).otherwise(name))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def normal_signature(sig: Column) -> Column:
    """White space collapsed, one space after commas, a last word before a comma or parenthesis dropped."""
    text = F.regexp_replace(sig, r"\s+", " ")
    text = F.regexp_replace(text, r"\s*([(),])\s*", "$1")
    text = F.replace(text, F.lit(","), F.lit(", "))
    return strip(F.regexp_replace(text, r"(\w+)\s+\w+([,)])", "$1$2"))


def signature_hash(sig: Column) -> Column:
    return F.substring(F.sha2(normal_signature(sig), 256), 1, 16)


def return_type(sig: Column) -> Column:
    """Of a normal signature: all before the function's name; a lone word is itself, and no parenthesis means void."""
    head = strip(F.substring_index(sig, "(", 1))
    return F.when(sig.contains("("), F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*\z", "")).otherwise(head)).otherwise("void")


def param_types(sig: Column) -> Column:
    """Of a normal signature: each parameter without its last word, or as it is if it has one word only."""
    inside = strip(F.regexp_extract(sig, r"(?s)\((.*)\)", 1))
    each = F.transform(F.split(inside, ","), lambda p: F.array_join(F.filter(F.split(strip(p), r"\s+"), lambda w: w != ""), " "))
    types = F.transform(each, lambda p: F.when(p.contains(" "), F.regexp_replace(p, r" [^ ]*\z", "")).otherwise(p))
    return F.when((inside == "") | (inside == "void"), F.array().cast("array<string>")).otherwise(types)


def fenced_code(text: Column) -> Column:
    """What a ```rust fence holds, else what any closed fence holds after its first line, else all; without outer space."""
    first = F.regexp_extract(text, r"(?s)\A(?:(?!```rust).)*```rust((?:(?!```).)*)```", 1)
    has_first = text.rlike(r"(?s)```rust(?:(?!```).)*```")
    # A fence whose first line has no end takes everything after its marks.
    body = r"(?s)\A(?:(?!```).)*```(?:[^\n]*\n)?((?:(?!```).)*)```"
    any_fence = F.regexp_extract(text, body, 1)
    return strip(F.when(has_first, first).when(text.rlike(body), any_fence).otherwise(text))


def without_fences(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~strip(x).startswith("```")), "\n")


def simple_message(text: Column) -> Column:
    """The message as a pattern: escaped, names between backticks as `.+`."""
    escaped = F.regexp_replace(text, r"([\\.+*?()|\[\]{}^$#&\-~])", r"\\$1")
    return F.regexp_replace(escaped, "`[^`]+`", "`.+`")


def truncated(text: Column, most: int) -> Column:
    rows = lines(text)
    cut = F.concat(F.array_join(F.slice(rows, 1, most), "\n"), F.lit("\n// ... ("), (F.size(rows) - most).cast("string"), F.lit(" more lines)"))
    return F.when(F.size(rows) <= most, text).otherwise(cut)


def input_mode(text: Column) -> Column:
    return F.when(has(text, "argc", "argv"), "args").when(has(text, "scanf", "fgets", "getchar"), "stdin").otherwise("none")


def routing_spec(text: Column) -> Column:
    """task:provider/model/temperature/context as a struct; null without a colon. Empty models and bad numbers are null."""
    rest = F.regexp_replace(text, r"\A[^:]*:", "")
    part = lambda n: F.try_element_at(F.split(rest, "/"), F.lit(n))
    spec = F.struct(
        F.substring_index(text, ":", 1).alias("task"),
        part(1).alias("provider"),
        F.nullif(part(2), F.lit("")).alias("model"),
        part(3).try_cast("double").alias("temperature"),
        part(4).try_cast("long").alias("num_ctx"),
    )
    return F.when(text.contains(":"), spec)


def is_transient(text: Column) -> Column:
    return has(text, *TRANSIENT)


def lines_match(a: Column, b: Column, eps: float) -> Column:
    """Two lines: numbers within eps (a NaN on either side counts as within), else equal text."""
    x, y = strip(a).try_cast("double"), strip(b).try_cast("double")
    near = F.isnan(x) | F.isnan(y) | (F.abs(x - y) <= eps)
    return F.when(x.isNotNull() & y.isNotNull(), near).otherwise(a == b)


def c_comments_stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def unsafe_blocks(text: Column) -> Column:
    """Lines, but for comments, that open an unsafe block or declare an unsafe function or impl."""
    rows = F.filter(F.transform(lines(text), strip), lambda x: ~x.startswith("//"))
    return F.size(F.filter(rows, lambda x: x.rlike(r"\bunsafe\s*(\{|fn\b|impl\b)")))


def crate_name(name: Column) -> Column:
    """Lower case letters, digits and underscores; one that starts with a digit gets an underscore."""
    clean = F.lower(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"))
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)
