"""Spans of functions and blocks in source texts, and joins of positions to them.

Texts come dealt by their key (spread), so that their tokens or lines are never shuffled; others move by their tokens. Running sums over one text give depths; which function a token stands in, and where a block ends, follow
from windows over them. A text is bounded by what a source file may be; keys are as many as there are texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import exploded_lines

#: One token of C: a directive with its continued lines, a comment, a literal, a name with the parenthesis that follows
#: it, a mark that opens, closes or ends something, or a run of anything else, which ends where a directive's line begins.
C_TOKEN = (
    r"(?s)(?m:^)[ \t]*+#(?:\\\n|[^\n])*+"
    r"|//[^\n]*+|/\*.*?\*/"
    r'|"(?:[^"\\\n]++|\\.)*+"?+' + r"|'(?:[^'\\\n]++|\\.)*+'?+"
    r"|\w++\s*+\(|[(){};]|(?:\w++(?!\s*+\()|[^\w\"'/#(){};\n]++|\n(?![ \t]*+#)|/(?![/*]))++\n?+|\n|."
)
#: A character that no source has stands before each token while a text is cut.
CUT = "\x01"
DIRECTIVE, QUIET, NAMED = r"\A[ \t]*#", r"\A(?:\s*+\z|/[/*])", r"\A\w+\s*\(\z"
#: Names that take parentheses and are no calls.
NOT_CALLED = ("if", "while", "for", "switch", "return", "sizeof", "typeof", "defined", "__attribute__")
#: Fixed value: what a Rust function's line starts with.
RUST_HEAD = r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"


def asof(points: DataFrame, marks: DataFrame, keys: list[str], at: str, value: Column, forward: bool = False) -> DataFrame:
    """points with `mark`, the value of the last of the marks of their keys at or before them (or the next at or after).

    Both sides meet in one sorted pass by keys and place, so a key may have any number of either. A point without a
    place has no mark.
    """
    row = F.struct(*points.columns)
    left = points.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), row.alias("__row"), F.lit(None).alias("__mark"))
    right = marks.select(*keys, F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).alias("__row"), value.alias("__mark"))
    place = F.desc("__at") if forward else F.col("__at")
    so_far = Window.partitionBy(*keys).orderBy(place, "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("mark", F.last("__mark", ignorenulls=True).over(so_far))
    return met.filter("__side = 1").select("__row.*", F.when(F.col("__at").isNotNull(), F.col("mark")).alias("mark"))


def c_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, token, at, line, depth, body, function, opens): each token with its offset, line from 1, and the body it stands in.

    `body` counts the function bodies of a text from 1, and is null outside of them; `function` is the body's name. A
    body opens with a brace at depth 0 behind a parenthesis that closes; its name is the first name with a parenthesis
    since the last statement, block or directive. A brace too many does not count. Comments, literals and directives
    are tokens of their own, so braces and names in them are none. `opens` tells the brace of a body. Null texts have no
    tokens. Windows that need each other's results are computed in as few passes as that allows.
    """
    dealt = df.select(key, F.translate(F.col(text), CUT, " ").alias("text"))
    # Marked and split, since extracting matches one by one copies what is left of the text for each.
    pieces = F.split(F.regexp_replace("text", C_TOKEN, CUT + "$0"), CUT)
    tokens = dealt.select(key, F.posexplode(F.slice(pieces, 2, F.size(pieces) - 1)).alias("i", "token")).filter("token <> ''")
    token, i = F.col("token"), F.col("i")
    so_far = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda value, over: F.last(value, ignorenulls=True).over(over)
    rows = tokens.select(
        key, "i", "token", F.when(~token.rlike(QUIET), i).alias("sign"), F.when(token == "{", 1).when(token == "}", -1).otherwise(0).alias("step"), F.length("token").alias("size"),
        F.regexp_count("token", F.lit("\n")).alias("feeds"), (token.endswith("(") & token.rlike(NAMED)).alias("call"), (token.isin(";", "}") | (token.contains("#") & token.rlike(DIRECTIVE))).alias("closes"),
    )
    rows = rows.select(
        "*", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("int").alias("at"), (F.coalesce(F.sum("feeds").over(before), F.lit(0)) + 1).cast("int").alias("line"), F.sum("step").over(so_far).alias("sum"),
        F.max("sign").over(before).alias("sign_at"), latest(F.when(F.col("sign").isNotNull(), token == ")"), before).alias("behind"),
    )
    rows = rows.select("*", (F.col("sum") - F.least(F.min("sum").over(so_far), F.lit(0))).cast("int").alias("depth"))
    ends = (F.col("depth") == 0) & F.col("closes")
    rows = rows.select("*", ends.alias("ends"), F.coalesce(F.lag("depth").over(Window.partitionBy(key).orderBy("i")), F.lit(0)).alias("above"), F.coalesce(F.max(F.when(ends, i)).over(before), F.lit(-1)).alias("end"))
    named, opens = F.col("call") & (F.col("above") == 0), (token == "{") & (F.col("above") == 0)
    starts = F.col("sign").isNotNull() & ~F.col("ends") & (F.coalesce("sign_at", F.lit(-1)) <= F.col("end"))
    lead = F.regexp_extract("token", r"\A\s*", 0)
    first = F.struct((F.col("at") + F.length(lead)).alias("at"), (F.col("line") + F.regexp_count(lead, F.lit("\n"))).alias("line"))
    rows = rows.select("*", named.alias("named"), opens.alias("brace"), F.max(F.when(named, i)).over(before).alias("named_at"), latest(F.when(starts, first), so_far).alias("start"))
    leads = F.col("named") & (F.coalesce("named_at", F.lit(-1)) <= F.col("end"))
    rows = rows.select("*", latest(F.when(leads, F.struct("i", F.regexp_extract("token", r"\A\w+", 0).alias("name"))), so_far).alias("head"))
    is_body = F.coalesce(F.col("brace") & F.col("behind") & (F.col("head.i") > F.col("end")), F.lit(False))
    opened = F.struct(is_body.alias("yes"), F.col("head.name").alias("name"), "start", F.col("at").alias("brace"))
    rows = rows.select("*", is_body.alias("opens"), F.sum(is_body.cast("int")).over(so_far).alias("n"), latest(F.when(F.col("brace"), opened), so_far).alias("opened"))
    inside = F.col("opened.yes") & (F.greatest("depth", "above") > 0)
    return rows.select(
        key, "i", "token", "at", "line", "depth", F.when(inside, F.col("n")).alias("body"), F.when(inside, F.col("opened.name")).alias("function"), F.when(inside, F.struct("opened.start.*", "opened.brace")).alias("start"), "opens"
    )


def c_functions(tokens: DataFrame, key: str) -> DataFrame:
    """(key, body, function, first_line, last_line, first, opens, last): the span table of c_tokens.

    Spans go from the return type to the closing brace, as lines from 1 and as offsets, the last one exclusive; `opens`
    is the offset of the body's brace. A body
    that does not close goes on to the text's end.
    """
    inside = tokens.filter("body IS NOT NULL")
    # A run of what is no sign goes on to the line of its last character.
    run = ~F.col("token").rlike(r"\A(?:[\"'(){};]|/[/*]|[ \t]*+#|\w++\s*+\()")
    line = F.col("line") + F.when(run, F.regexp_count("token", F.lit("\n")) - F.col("token").endswith("\n").cast("int")).otherwise(0)
    marks = [F.col("start.line").alias("first_line"), F.col("start.at").alias("first"), F.col("start.brace").alias("opens")]
    spans = inside.groupBy(key, "body", "function", *marks).agg(F.max(line).alias("last_line"), F.max(F.col("at") + F.length("token")).alias("last"))
    return spans.select(key, "body", "function", "first_line", "last_line", "first", "opens", "last")


def c_calls(tokens: DataFrame, key: str) -> DataFrame:
    """(key, body, function, callee, line) of each name with a parenthesis inside a body."""
    named = tokens.filter(F.col("body").isNotNull() & F.col("token").rlike(NAMED))
    calls = named.select(key, "body", "function", F.regexp_extract("token", r"\A\w+", 0).alias("callee"), "line")
    return calls.filter(~F.col("callee").isin(*NOT_CALLED))


def named_in_bodies(tokens: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., src, dst, defines): distinct calls of functions, and each function itself as (f, f, true), in one pass.

    `defines` is known behind the grouping only, so what is filtered by it shares the grouping's shuffle.
    """
    callee = F.regexp_extract("token", r"\A\w+", 0)
    called = F.col("token").endswith("(") & F.col("token").rlike(NAMED) & ~callee.isin(*NOT_CALLED)
    named = tokens.filter(F.col("body").isNotNull() & (F.col("opens") | called))
    pairs = named.select(*scope, F.col("function").alias("src"), F.when(F.col("opens"), F.col("function")).otherwise(callee).alias("dst"), F.col("opens").cast("int").alias("__d"))
    return pairs.groupBy(*scope, "src", "dst").agg(F.max("__d").alias("__d")).select(*scope, "src", "dst", (F.col("__d") == 1).alias("defines"))


def call_graph(tokens: DataFrame, key: str, scope: list[str]) -> DataFrame:
    """(scope..., src, dst): distinct calls between functions that the texts of a scope define, none to itself.

    `tokens` must hold the columns of the scope beside those of c_tokens; without any, all texts are one project.
    """
    return edges_of(named_in_bodies(tokens, scope), scope)


def edges_of(named: DataFrame, scope: list[str]) -> DataFrame:
    """(scope..., src, dst) of named_in_bodies: a call to itself has met its definition there."""
    known = named.filter("defines").select(*scope, "dst")
    return named.filter("NOT defines").select(*scope, "src", "dst").join(known, [*scope, "dst"], "left_semi").select(*scope, "src", "dst")


def allocating(tokens: DataFrame, key: str) -> DataFrame:
    """(key, functions): sorted names of the functions whose body takes memory, or gives it back.

    Any text of the body counts that ends with malloc, calloc, realloc or free before a parenthesis, in comments, too.
    """
    touches = F.col("token").rlike(r"(malloc|calloc|realloc|free)\(")
    return tokens.filter(F.col("body").isNotNull() & F.col("token").contains("(") & touches).groupBy(key).agg(F.sort_array(F.collect_set("function")).alias("functions"))


def block_ends(lines: DataFrame, keys: list[str], pos: str, line: str, is_head: Column, exact: bool = False) -> DataFrame:
    """Rows of heads with `end`, the line on which the braces of the block that starts there are closed.

    The running depth of braces is compared at the ends of lines. A block ends on the first line after which the depth
    is not above what it was before the head, be it the head's own; one that does not close ends with the text. With
    `exact`, braces must have opened first and be even again, and a block that does not close ends with its head.

    Each line marks the depths that it goes down to; a head looks for the next mark of its depth, a forward as-of join.
    """
    opened, closed = F.regexp_count(line, F.lit(r"\{")), F.regexp_count(line, F.lit(r"\}"))
    so_far = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("__d", opened - closed).withColumn("__s", F.sum("__d").over(so_far)).withColumn("__b", F.col("__s") - F.col("__d"))
    rows = rows.withColumn("__end", F.max(pos).over(later))
    rows = rows.withColumn("__from", F.min(F.when(opened > 0, F.col(pos))).over(later) if exact else F.col(pos))
    down = F.array("__s") if exact else F.sequence("__s", F.greatest("__s", "__b"))
    marks = rows.select(*keys, F.col(pos).alias("__from"), F.explode(down).alias("__b"))
    met = asof(rows.filter(is_head), marks, [*keys, "__b"], "__from", F.col("__from"), forward=True)
    return met.withColumn("end", F.coalesce("mark", F.col(pos) if exact else F.col("__end"))).drop("__d", "__s", "__b", "__end", "__from", "mark")


def rust_functions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, function, first_line, last_line) of the functions of Rust texts, lines from 1."""
    rows = exploded_lines(df, text, [key])
    spans = block_ends(rows, [key], "pos", "line", F.col("line").rlike(RUST_HEAD), exact=True)
    return spans.select(key, F.regexp_extract("line", RUST_HEAD, 1).alias("function"), (F.col("pos") + 1).alias("first_line"), (F.col("end") + 1).alias("last_line"))


def functions_at(points: DataFrame, spans: DataFrame, keys: list[str], line: str) -> DataFrame:
    """points with `function`: that of the last span that begins at or before their line, null if it ends before it."""
    marks = spans.withColumn(line, F.col("first_line").cast(points.schema[line].dataType))
    met = asof(points, marks, keys, line, F.struct("function", "last_line"))
    return met.withColumn("function", F.when(F.col(line) <= F.col("mark.last_line"), F.col("mark.function"))).drop("mark")
