"""Queries whose result depends on order, graphs, state, generators and rewrites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import generators, graph, ordered, rewrites, scanners, sets
from ..streaming import limiters
from .result_queries import CANDIDATES, candidates
from .unit_queries import _TRIMMED, read
from .units import WITH_UNITS, d_rows, units

c = F.col

# ---------------------------------------------------------------- lines and braces


def brace_depth(spark, sf_dir):
    """W-01: running depth of braces over the lines of each translation."""
    return ordered.brace_depth(units(spark, sf_dir), "rust", "id").select("id", "pos", "depth")


#: A line without strings, then without a comment's tail.
_BARE = "regexp_replace(regexp_replace(x, '\"([^\"\\\\]|\\\\.)*(\"|$)', '', 'g'), '//.*', '')"
BRACE_DEPTH = f"""{WITH_UNITS},
    l AS (SELECT id, unnest(r_rows) AS x, generate_subscripts(r_rows, 1) - 1 AS pos FROM texts), b AS (SELECT id, pos, CASE WHEN ltrim(x) LIKE '//%' THEN '' ELSE {_BARE} END AS y FROM l)
    SELECT id, pos, sum((length(y) - length(replace(y, '{{', ''))) - (length(y) - length(replace(y, '}}', '')))) OVER (PARTITION BY id ORDER BY pos) AS depth FROM b"""


def truncate_balanced(spark, sf_dir):
    """W-02: translations cut after their last balanced line, or closed."""
    return ordered.close_braces(units(spark, sf_dir), "rust", "id").select("id", F.sha2("rust", 256).alias("out"))


TRUNCATE_BALANCED = f"""
    WITH RECURSIVE d AS ({BRACE_DEPTH.replace('WITH RECURSIVE', 'WITH')}), e AS (SELECT id, max(pos) FILTER (WHERE depth = 0) AS cut, arg_max(depth, pos) AS final, count(*) AS n FROM d GROUP BY id),
    u AS ({WITH_UNITS} SELECT id, rust, r_rows FROM texts)
    SELECT id, sha256(CASE WHEN final <= 0 THEN rust WHEN cut IS NOT NULL AND cut + 1 < n THEN array_to_string(r_rows[:cut + 1], chr(10)) || chr(10) || '// truncated ' || (n - cut - 1) || ' lines of incomplete code'
        ELSE rust || chr(10) || repeat('}}', final::INT) || ' // auto-closed: truncated output' END) AS out FROM u JOIN e USING (id)"""


def preprocessed(spark, sf_dir):
    k = c("conv_id")
    body = F.concat(F.lit('# 1 "a.c"\nint a;\n\n# 1 "sys.h" 1\nint s;\n# 2 "<stdin>"\n'), F.coalesce(c("text"), F.lit("")), F.lit("\n# 3 \"b.c\"\nint b;"))
    return read(spark, sf_dir, "conversations").select((k * 100 + c("turn")).alias("id"), body.alias("body"), F.when(k % 3 == 0, "dir/zzz.c").otherwise("a.c").alias("file"))


def directive_forward_fill(spark, sf_dir):
    """W-03: lines that come from the current file."""
    rows = preprocessed(spark, sf_dir)
    return ordered.of_current_file(rows, "body", "id", c("file")).groupBy("id").agg(F.count(F.lit(1)).alias("lines"), F.min("pos").alias("first"), F.sum(F.length("line")).alias("chars"))


DIRECTIVE_FORWARD_FILL = f"""
    WITH p AS (SELECT conv_id * 100 + turn AS id, '# 1 "a.c"' || chr(10) || 'int a;' || chr(10) || chr(10) || '# 1 "sys.h" 1' || chr(10) || 'int s;' || chr(10) || '# 2 "<stdin>"' || chr(10) || coalesce(text, '') || chr(10) || '# 3 "b.c"' || chr(10) || 'int b;' AS body,
        CASE WHEN conv_id % 3 = 0 THEN 'dir/zzz.c' ELSE 'a.c' END AS file FROM conversations),
    r AS (SELECT id, file, {d_rows('body')} AS rows FROM p), l AS (SELECT id, file, unnest(rows) AS x, generate_subscripts(rows, 1) - 1 AS pos FROM r),
    m AS (SELECT *, x LIKE '#%"%' AS dir, last_value(CASE WHEN x LIKE '#%"%' THEN contains(x, file) OR contains(x, '"<stdin>"') END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS mine FROM l)
    SELECT id, count(*) AS lines, min(pos)::INT AS first, sum(length(x)) AS chars FROM m WHERE mine AND NOT dir AND {_TRIMMED.format('x')} <> '' GROUP BY id"""


def file_markers(spark, sf_dir):
    """S-13: output split at file markers; lines under unknown names go."""
    from ..sources.texts import split_files

    body = F.concat(F.lit("// === a.rs ===\nfn a() {}\n// === other.rs ===\nlost\n// === b.rs ===\n"), c("rust"))
    return split_files(units(spark, sf_dir).select("id", body.alias("body")), "body", "id", ["a.rs", "b.rs"]).select("id", "file", F.sha2("content", 256).alias("content"))


FILE_MARKERS = f"""{WITH_UNITS}
    SELECT id, 'a.rs' AS file, sha256('fn a() {{}}') AS content FROM texts UNION ALL SELECT id, 'b.rs', sha256({_TRIMMED.format('rust')}) FROM texts"""


def comment_blocks(spark, sf_dir):
    """W-04: for each function line, the comment lines right above it, as gaps and islands."""
    rows = ordered.exploded_lines(units(spark, sf_dir), "rust", ["id"])
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last_other = F.max(F.when(~t.strip(c("line")).startswith("//"), c("pos"))).over(so_far)
    heads = rows.withColumn("above", c("pos") - F.coalesce(last_other, F.lit(-1)) - 1).filter(t.strip(c("line")).rlike(r"^(pub )?fn "))
    return heads.select("id", "pos", "above")


COMMENT_BLOCKS = f"""{WITH_UNITS},
    l AS (SELECT id, unnest(r_rows) AS x, generate_subscripts(r_rows, 1) - 1 AS pos FROM texts),
    m AS (SELECT *, coalesce(max(CASE WHEN NOT ltrim(x) LIKE '//%' THEN pos END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS o FROM l)
    SELECT id, pos::INT AS pos, (pos - o - 1)::INT AS above FROM m WHERE regexp_matches(ltrim(x), '^(pub )?fn ')"""

# ---------------------------------------------------------------- folds


def versions(spark, sf_dir):
    return candidates(spark, sf_dir).withColumn("substance", c("l_suppkey") % 7 != 0)


def best_version_fold(spark, sf_dir):
    """W-06."""
    return ordered.best_version(versions(spark, sf_dir), "unit", "ordinal", F.lit(1))


BEST_VERSION = f"""
    WITH RECURSIVE {CANDIDATES.strip()}, v AS (SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY ordinal, score, compiles, unsafe, l_suppkey % 7 <> 0) AS n, ordinal, score, compiles, unsafe, l_suppkey % 7 <> 0 AS substance FROM cand),
    f AS (SELECT DISTINCT unit, 0::BIGINT AS n, NULL::BIGINT AS best, 0 AS score, false AS ok FROM v
        UNION ALL SELECT f.unit, v.n, CASE WHEN w THEN v.ordinal ELSE best END, CASE WHEN w THEN v.score ELSE f.score END, CASE WHEN w THEN v.compiles ELSE ok END
        FROM f JOIN (SELECT * FROM v) v ON v.unit = f.unit AND v.n = f.n + 1, LATERAL (SELECT v.substance AND v.unsafe <= 1 AND (v.score > f.score OR (v.compiles AND NOT f.ok)) AS w))
    SELECT unit, best, score FROM f QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC) = 1"""


def greedy_chunks(spark, sf_dir):
    """P-01: line items of an order packed by quantity into chunks of up to 60."""
    rows = candidates(spark, sf_dir).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("ordinal", c("cost").cast("long").alias("n")))).alias("v"))
    return rows.select("unit", F.posexplode(ordered.packed(F.transform("v", lambda x: x["n"]), F.lit(60))).alias("place", "chunk"))


GREEDY_CHUNKS = f"""
    WITH RECURSIVE {CANDIDATES.strip()}, v AS (SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY ordinal, cost::BIGINT) AS n, cost::BIGINT AS q FROM cand),
    f AS (SELECT unit, n, q AS have, 0::BIGINT AS chunk FROM v WHERE n = 1
        UNION ALL SELECT v.unit, v.n, CASE WHEN f.have + v.q > 60 THEN v.q ELSE f.have + v.q END, f.chunk + (f.have + v.q > 60)::BIGINT FROM f JOIN v ON v.unit = f.unit AND v.n = f.n + 1)
    SELECT unit, (n - 1)::INT AS place, chunk FROM f"""


def module_split(spark, sf_dir):
    """A-07 P-02 C-09: functions by prefix; single ones and main go to misc; groups above the limit are packed to 60 % of it."""
    rows = read(spark, sf_dir, "part").select(
        F.floor(c("p_partkey") / 40).alias("unit"), F.concat(F.element_at(F.array(*[F.lit(x) for x in ("hash", "list", "main", "io", "z")]), (F.xxhash64("p_name") * 0 + c("p_size") % 5 + 1).cast("int")), F.lit("_"), c("p_partkey").cast("string")).alias("name"), c("p_size").alias("n"), c("p_partkey").alias("pos")
    )
    prefix = rows.withColumn("prefix", t.name_prefix(c("name")))
    size = F.count(F.lit(1)).over(Window.partitionBy("unit", "prefix"))
    keyed = prefix.withColumn("module", F.when((size < 2) | (c("prefix") == "main"), "misc").otherwise(c("prefix")))
    grouped = keyed.groupBy("unit", "module").agg(F.array_sort(F.collect_list(F.struct((c("module") != c("prefix")).alias("moved"), "prefix", "pos", "n"))).alias("v"), F.sum("n").alias("total"))
    chunks = F.when(c("total") > 200, ordered.packed(F.transform("v", lambda x: x["n"].cast("long")), F.lit(120))).otherwise(F.transform("v", lambda x: F.lit(0).cast("long")))
    return grouped.select("unit", "module", F.explode(F.arrays_zip("v", chunks.alias("k"))).alias("z")).groupBy("unit", "module", c("z.k").alias("part")).agg(F.count(F.lit(1)).alias("functions"), F.sum("z.v.n").alias("loc"))


MODULE_SPLIT = """
    WITH RECURSIVE r AS (SELECT p_partkey // 40 AS unit, (['hash', 'list', 'main', 'io', 'z'])[p_size % 5 + 1] AS base, p_size AS n, p_partkey AS pos FROM part),
    p AS (SELECT *, CASE WHEN base = 'z' THEN 'z_' || pos ELSE base END AS prefix FROM r),
    k AS (SELECT *, CASE WHEN prefix = 'main' OR count(*) OVER (PARTITION BY unit, prefix) < 2 THEN 'misc' ELSE prefix END AS module FROM p),
    o AS (SELECT *, sum(n) OVER (PARTITION BY unit, module) AS total, row_number() OVER (PARTITION BY unit, module ORDER BY module <> prefix, prefix, pos) AS i FROM k),
    f AS (SELECT unit, module, i, n, total, n::BIGINT AS have, 0::BIGINT AS part FROM o WHERE i = 1
        UNION ALL SELECT o.unit, o.module, o.i, o.n, o.total, CASE WHEN o.total > 200 AND f.have + o.n > 120 THEN o.n ELSE f.have + o.n END, f.part + (o.total > 200 AND f.have + o.n > 120)::BIGINT
        FROM f JOIN o ON o.unit = f.unit AND o.module = f.module AND o.i = f.i + 1)
    SELECT unit, module, part, count(*) AS functions, sum(n) AS loc FROM f GROUP BY ALL"""


def stall_counter(spark, sf_dir):
    """T-03: running stall counts of each unit's error counts."""
    rows = candidates(spark, sf_dir).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("ordinal", (c("l_partkey") % 3).cast("int").alias("e")))).alias("v"))
    return rows.select("unit", F.posexplode(ordered.stalls(F.transform("v", lambda x: x["e"]))).alias("place", "stalled"))


STALL_COUNTER = f"""
    WITH {CANDIDATES.strip()}, v AS (SELECT unit, row_number() OVER w - 1 AS place, l_partkey % 3 AS e, lag(l_partkey % 3) OVER w AS p FROM cand WINDOW w AS (PARTITION BY unit ORDER BY ordinal, l_partkey % 3)),
    g AS (SELECT *, e = p AND e > 0 AS same, count(*) FILTER (WHERE NOT coalesce(e = p AND e > 0, false)) OVER (PARTITION BY unit ORDER BY place) AS island FROM v)
    SELECT unit, place::INT AS place, (count(*) FILTER (WHERE same) OVER (PARTITION BY unit, island ORDER BY place))::INT AS stalled FROM g"""

# ---------------------------------------------------------------- sets, imports, definitions


def use_lines(spark, sf_dir):
    k = c("p_partkey")
    forms = ["use std::io::{self, Read};", "use std::io::{Write, Read};", "use std::io::Read;", "use std::fmt;", "let x = 1;", "use std::fmt::{Debug};", "use a::b::C;"]
    return read(spark, sf_dir, "part").select(F.floor(k / 9).alias("unit"), k.alias("pos"), F.element_at(F.array(*[F.lit(f) for f in forms]), (c("p_size") % 7 + 1).cast("int")).alias("line"))


_FORMS = "['use std::io::{self, Read};', 'use std::io::{Write, Read};', 'use std::io::Read;', 'use std::fmt;', 'let x = 1;', 'use std::fmt::{Debug};', 'use a::b::C;']"


def merge_imports(spark, sf_dir):
    """A-08."""
    return sets.merge_imports(use_lines(spark, sf_dir), "line", "unit").withColumnRenamed("unit", "unit")


MERGE_IMPORTS = f"""
    WITH l AS (SELECT p_partkey // 9 AS unit, {_FORMS}[p_size % 7 + 1] AS line FROM part),
    io AS (SELECT unit, bool_or(line LIKE '%self%') AS s, bool_or(line LIKE '%Write%') AS w FROM l WHERE line LIKE 'use std::io::{{%' GROUP BY unit)
    SELECT unit, 'use std::io::{{' || CASE WHEN s THEN 'self, ' ELSE '' END || 'Read' || CASE WHEN w THEN ', Write' ELSE '' END || '}};' AS line FROM io
    UNION ALL SELECT DISTINCT unit, line FROM l WHERE line LIKE 'use std::fmt::{{%'
    UNION ALL SELECT DISTINCT unit, line FROM l WHERE line IN ('use std::fmt;', 'use a::b::C;')
    UNION ALL SELECT DISTINCT unit, line FROM l WHERE line = 'use std::io::Read;' AND unit NOT IN (SELECT unit FROM io)"""


def first_definition_wins(spark, sf_dir):
    """W-05: the first line item of each part and supplier in the order of orders."""
    return ordered.first_definitions(candidates(spark, sf_dir), ["l_partkey", "l_suppkey"], ["unit", "ordinal"]).select("l_partkey", "l_suppkey", "unit", "ordinal")


FIRST_DEFINITION = f"WITH {CANDIDATES.strip()} SELECT l_partkey, l_suppkey, unit, ordinal FROM cand QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY unit, ordinal) = 1"


def set_pack(spark, sf_dir):
    """U-07: modules assembled in order, without their imports, and the sorted union of two sets of names (the form of U-03)."""
    k = c("p_partkey")
    lines_of = F.element_at(F.array(*[F.lit(x) for x in ("struct A;", "use std::fmt;", "fn f() {}", "pub struct A;", "```", "const B: i32 = 1;")]), (c("p_size") % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.floor(k / 12).alias("unit"), F.floor(k % 12 / 4).alias("module"), k.alias("pos"), lines_of.alias("line"))
    names = rows.groupBy("unit").agg(F.array_sort(F.array_union(F.collect_set(F.when(c("line").startswith("fn"), "f")), F.collect_set(F.when(c("line").contains("struct"), "A")))).alias("names"))
    return sets.assembled_rows(rows, "unit", "module", "pos", "line").join(names, "unit", "left").select("unit", F.sha2("text", 256).alias("text"), "names")


SET_PACK = """
    WITH r AS (SELECT p_partkey // 12 AS unit, p_partkey AS pos, p_size % 6 AS f, (['struct A;', 'use std::fmt;', 'fn f() {}', 'pub struct A;', '```', 'const B: i32 = 1;'])[p_size % 6 + 1] AS line FROM part),
    d AS (SELECT *, CASE WHEN f IN (0, 3) THEN 'A' WHEN f = 5 THEN 'B' END AS def FROM r WHERE f NOT IN (1, 4)),
    k AS (SELECT * FROM d QUALIFY def IS NULL OR row_number() OVER (PARTITION BY unit, def ORDER BY pos) = 1),
    n AS (SELECT unit, list_sort(list_distinct(list(CASE WHEN f = 2 THEN 'f' WHEN f IN (0, 3) THEN 'A' END) FILTER (WHERE f IN (0, 2, 3)))) AS names FROM r GROUP BY unit)
    SELECT k.unit, sha256(string_agg(line, chr(10) ORDER BY pos)) AS text, coalesce(any_value(names), []) AS names FROM k JOIN n USING (unit) GROUP BY k.unit"""

# ---------------------------------------------------------------- detectors, scanners, rewrites


def scanner_udfs(spark, sf_dir):
    """C-02 C-22: functions without a body, and arguments at top level."""
    args = F.concat(F.lit("a, f(b, c), [d, "), c("id").cast("string"), F.lit("], {e, f}"))
    return units(spark, sf_dir).select("id", scanners.empty_function_count("rust").alias("empty"), scanners.split_arguments(args).alias("arguments"))


def rewrite_errors(spark, sf_dir):
    """Translations behind five lines of preamble with marks that the line rules look for, and errors on those lines."""
    pre = "```rust\n#![allow(dead_code)]\n//! top\n\nuse libc::c_int;\n#![warn(missing_docs)]\n//! inner\n#[derive(Debug)]\n\nfn lone() {}\n#[derive(Clone)]\nstruct S;\nextern crate rand;\nuse rand::Rng;\n"
    e = lambda code, line, message: F.struct(F.lit(code).alias("code"), F.lit(line).alias("line"), F.lit(message).alias("message"))
    found = [e("E0000", 5, "an inner attribute is not permitted in this context"), e("E0753", 6, "expected outer doc comment"), e("E0774", 7, "derive"), e("E0774", 10, "derive"), e("E0432", 13, "unresolved import"), e("E0432", 4, "unresolved import")]
    errors = F.when(c("id") % 2 == 0, F.array(*found)).otherwise(F.array(*found[:2]))
    return units(spark, sf_dir).select("id", F.concat(F.lit(pre), c("rust")).alias("rust"), errors.alias("errors"))


def rewrite_line_rules(spark, sf_dir):
    """X-00 X-05 X-06 X-08 X-10."""
    return rewrite_errors(spark, sf_dir).select("id", F.sha2(rewrites.line_rules(c("rust"), c("errors")), 256).alias("out"))


_PRE = "|".join(["#![allow(dead_code)]", "//! top", "", "{0}", "#![warn(missing_docs)]", "// inner", "{1}", "fn lone() {{}}", "#[derive(Clone)]", "struct S;", "// R10: extern crate rand;", "{2}", ""])
_EVEN = _PRE.format("// R10: use libc::c_int;", "", "use rand::Rng;").replace("|", "' || chr(10) || '")
_ODD = _PRE.format("use libc::c_int;", "#[derive(Debug)]|", "use rand::Rng;").replace("|", "' || chr(10) || '")
REWRITE_LINE_RULES = f"""{WITH_UNITS} SELECT id, sha256(CASE WHEN id % 2 = 0 THEN '{_EVEN}' ELSE '{_ODD}' END || rust) AS out FROM texts"""


#: Lines before the translations, behind k % 5 lines of padding: @K is the key, @M one of seven numbers, @R what line 2 imports.
BLOCK_LINES = [
    "use a::Read;", "use b::@R;", "let v = n.value@M;", "fn gen@K<T: Debug, U>(x: T) {", "    self.go@K(x.clone());", "}", "impl D for X@M {", "}", "impl fmt::D for X@M {", "    fn fmt() {}", "}",
    "fn go@K(x: i32) {}", "#[cfg(windows)]", "fn win() {", "}", "fn opt(v: Option<&mut T>) {", "    if let Some(x) = v {}", "}",
]


def block_errors(spark, sf_dir):
    """Translations, each twice, behind lines that the block rules look for, and errors on or beside those lines."""
    k, p = c("id"), (c("id") % 5).cast("int")
    pre = F.lit("\n".join(BLOCK_LINES) + "\n")
    for mark, word in (("@K", k.cast("string")), ("@M", (k % 7).cast("string")), ("@R", F.when(k % 3 == 0, "Read").otherwise("Wr"))):
        pre = F.replace(pre, F.lit(mark), word)
    e = lambda when, code, line, message: F.when(when, F.struct(F.lit(code).alias("code"), line.cast("int").alias("line"), message.alias("message")))
    named = lambda before, word, behind: F.concat(F.lit(before), word.cast("string"), F.lit(behind))
    always = F.lit(True)
    errors = F.array_compact(
        F.array(
            e(always, "E0252", p + 2, F.lit("the name `Read` is defined multiple times")),
            e(always, "E0428", p + 20, F.lit("the name `add_numbers` is defined multiple times")),
            e(always, "E0609", p + 1 + k % 4, named("no field `value", k % 7, "` on type `N`")),
            e(always, "E0599", F.when(k % 2 == 0, p + 5).otherwise(p + 13), F.lit("trait bounds were not satisfied")),
            e(always, "E0599", F.when(k % 3 == 1, p + 5).otherwise(p + 6), named("no method named `go", k, "` found")),
            e(always, "E0119", F.when(k % 2 == 1, p + 9).otherwise(p + 30), named("conflicting implementations of trait `D` for type `X", k % 7, "`")),
            e(k % 4 == 0, "E0433", p + 13, F.lit("no windows here")),
            e(k % 5 < 3, "E0382", p + 17, F.lit("use of moved value: `v`")),
        )
    )
    text = F.concat(F.repeat(F.lit("// pad\n"), p), pre, c("rust"), F.lit("\n"), c("rust"))
    return units(spark, sf_dir).select("id", text.alias("rust"), errors.alias("errors"))


def rewrite_block_rules(spark, sf_dir):
    """X-00..X-14: all rules in their order, from fences to the closing of braces."""
    return rewrites.apply_rules(block_errors(spark, sf_dir), "rust", "errors").select("id", F.sha2("rust", 256).alias("out"), F.regexp_count("rust", F.lit(r"fn add_numbers\(")).alias("kept"))


def _stage(name: str, lines: str) -> str:
    """A table of lines numbered anew."""
    return f"{name} AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) AS n, x FROM ({lines}))"


def _deep(name: str, of: str) -> str:
    """Lines with the depth of braces before and after them, and whether they open any."""
    return f"""{name} AS MATERIALIZED (SELECT id, n, x, contains(x, '{{') AS opens, sum((length(x) - length(replace(x, '{{', ''))) - (length(x) - length(replace(x, '}}', '')))) OVER (PARTITION BY id ORDER BY n) AS d,
        coalesce(sum((length(x) - length(replace(x, '{{', ''))) - (length(x) - length(replace(x, '}}', '')))) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {of})"""


def _end(deep: str, row: str) -> str:
    """The last line of the block that opens at or after a row."""
    opened = f"(SELECT min(o.n) FROM {deep} o WHERE o.id = {row}.id AND o.n >= {row}.n AND o.opens)"
    return f"coalesce((SELECT min(z.n) FROM {deep} z WHERE z.id = {row}.id AND z.n >= {opened} AND z.d <= {row}.b), (SELECT max(z.n) FROM {deep} z WHERE z.id = {row}.id))"


def _rewrite_block_rules() -> str:
    pre = "'" + "\n".join(BLOCK_LINES).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for mark, word in (("@K", "id::VARCHAR"), ("@M", "(id % 7)::VARCHAR"), ("@R", "CASE WHEN id % 3 = 0 THEN 'Read' ELSE 'Wr' END")):
        pre = f"replace({pre}, '{mark}', {word})"
    text = f"repeat('// pad' || chr(10), (id % 5)::INT) || {pre} || chr(10) || rust || chr(10) || rust"
    bare = "regexp_replace(regexp_replace(x, '\"([^\"\\\\]|\\\\.)*(\"|$)', '', 'g'), '//.*', '')"
    stages = [
        f"t AS (SELECT id, {text} AS text FROM texts)",
        _stage("s0", f"SELECT id, unnest({d_rows('text')}) AS x, generate_subscripts({d_rows('text')}, 1) AS n FROM t"),
        # X-07: of lines that import Read, the first stays.
        _stage("s1", "SELECT *, trim(x) LIKE 'use %' AND (contains(x, '::Read') OR trim(x) LIKE '%Read;') AS imports FROM s0 QUALIFY NOT imports OR row_number() OVER (PARTITION BY id, imports ORDER BY n) = 1"),
        # X-02: of functions of the name, the first stays.
        _deep("d1", "s1"),
        f"h1 AS (SELECT id, n, {_end('d1', 'd')} AS last, row_number() OVER (PARTITION BY id ORDER BY n) AS r FROM d1 d WHERE contains(x, 'fn add_numbers('))",
        _stage("s2", "SELECT s.* FROM s1 s WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.id = s.id AND r > 1 AND s.n BETWEEN h1.n AND h1.last)"),
        # X-09: the first of the later impls near the error goes.
        _deep("d2", "s2"),
        "sizes AS (SELECT id, max(n) AS size, id % 5 + CASE WHEN id % 2 = 1 THEN 9 ELSE 30 END AS line FROM s2 GROUP BY id)",
        "i2 AS (SELECT d.*, row_number() OVER (PARTITION BY d.id ORDER BY d.n) AS r FROM d2 d WHERE regexp_matches(trim(x), '^impl\\s+(\\w+::)*D\\s+for\\s+(\\w+::)*X' || (id % 7)))",
        f"h2 AS (SELECT i.id, i.n, {_end('d2', 'i')} AS last FROM i2 i JOIN sizes USING (id) WHERE r > 1 AND i.n BETWEEN greatest(line - 3, 0) AND least(line + 2, size) + 5 QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY i.n) = 1)",
        _stage("s3", "SELECT s.* FROM s2 s WHERE NOT EXISTS (SELECT 1 FROM h2 WHERE h2.id = s.id AND s.n BETWEEN h2.n AND h2.last)"),
        # X-11: what stands under the Windows switch becomes comments.
        _deep("d3", "s3"),
        f"h3 AS (SELECT w.id, w.n - 1 AS n, {_end('d3', 'w')} AS last FROM d3 w JOIN s3 q ON q.id = w.id AND q.n = w.n - 1 AND q.x = '#[cfg(windows)]' WHERE w.id % 4 = 0)",
        _stage("s4", "SELECT s.id, s.n, CASE WHEN h.n IS NULL THEN x WHEN s.n = h.n THEN '// R11 (non-Windows): ' || trim(x) ELSE '// R11: ' || trim(x) END AS x FROM s3 s LEFT JOIN h3 h ON h.id = s.id AND s.n BETWEEN h.n AND h.last"),
        # X-01: the last head at or above the error, if it has parameters of type.
        "near AS (SELECT id, arg_max(n, n) AS n, arg_max(regexp_matches(x, 'fn\\s+\\w+\\s*<[^>]+>'), n) AS generic FROM (SELECT *, id % 5 + CASE WHEN id % 2 = 0 THEN 5 ELSE 13 END AS line FROM s4) WHERE n <= line AND (regexp_matches(x, 'fn\\s+\\w+\\s*<[^>]+>') OR (n < line AND regexp_matches(trim(x), '^(pub )?fn '))) GROUP BY id)",
        _stage("s5", "SELECT s.id, s.n, CASE WHEN near.generic AND NOT contains(regexp_extract(x, 'fn\\s+\\w+\\s*<[^>]+>'), 'Clone') THEN regexp_replace(x, '(\\w+): (\\w+)([,>])', '\\1: \\2 + Clone\\3', 'g') ELSE x END AS x FROM s4 s LEFT JOIN near ON near.id = s.id AND near.n = s.n"),
        # X-03, line by line, since no match spans lines here.
        "s6 AS (SELECT id, n, CASE WHEN id % 5 < 3 THEN regexp_replace(regexp_replace(x, '([(,]\\s*)v: Option<&mut ', '\\1mut v: Option<&mut '), 'if let Some\\((\\w+)\\) = v\\b', 'if let Some(ref mut \\1) = v') ELSE x END AS x FROM s5)",
        # X-13 and X-14.
        "s7 AS (SELECT id, n, CASE WHEN abs(n - (id % 5 + 1 + id % 4)) <= 1 THEN replace(x, '.value' || (id % 7), '.m_value' || (id % 7)) ELSE x END AS x FROM s6)",
        "s8 AS MATERIALIZED (SELECT id, n, CASE WHEN n = id % 5 + CASE WHEN id % 3 = 1 THEN 5 ELSE 6 END THEN replace(replace(x, 'self.go' || id || '(', 'go' || id || '(self, '), 'Self::go' || id || '(', 'go' || id || '(') ELSE x END AS x FROM s7)",
        # X-04
        f"z AS (SELECT id, n, x, sum((length(y) - length(replace(y, '{{', ''))) - (length(y) - length(replace(y, '}}', '')))) OVER (PARTITION BY id ORDER BY n) AS depth FROM (SELECT *, CASE WHEN ltrim(x) LIKE '//%' THEN '' ELSE {bare} END AS y FROM s8))",
        "e AS (SELECT id, max(n) FILTER (WHERE depth = 0) AS cut, arg_max(depth, n) AS final, count(*) AS n FROM z GROUP BY id)",
        """done AS (SELECT e.id, CASE WHEN any_value(final) <= 0 THEN string_agg(x, chr(10) ORDER BY z.n) WHEN any_value(cut) < any_value(e.n) THEN string_agg(x, chr(10) ORDER BY z.n) FILTER (WHERE z.n <= cut) || chr(10) || '// truncated ' || any_value(e.n - cut) || ' lines of incomplete code'
            ELSE string_agg(x, chr(10) ORDER BY z.n) || chr(10) || repeat('}', any_value(final)::INT) || ' // auto-closed: truncated output' END AS text FROM z JOIN e ON e.id = z.id GROUP BY e.id)""",
    ]
    return f"{WITH_UNITS}, " + ",\n".join(stages) + " SELECT id, sha256(text) AS out, len(regexp_extract_all(text, 'fn add_numbers\\('))::INT AS kept FROM done"


REWRITE_BLOCK_RULES = _rewrite_block_rules()


# ---------------------------------------------------------------- graphs


def call_edges(spark, sf_dir):
    """Parts as functions that call those of twice their number, and now and then one of a seventeenth."""
    k = c("p_partkey")
    part = read(spark, sf_dir, "part")
    calls = part.select(k.alias("src"), F.explode(F.array(k * 2, k * 2 + 1, F.when(k % 17 == 0, F.floor(k / 17)))).alias("dst")).filter("src <> dst")
    return calls.join(part.select(k.alias("dst")), "dst", "left_semi").select("src", "dst")


def topo_order(spark, sf_dir):
    """G-02: the queue's order of all functions, by the calls to later ones; with those back, cycles would leave names only.

    The queue is one sequence: edges and names are held by the driver.
    """
    edges = [(f"f{a}", f"f{b}") for a, b in call_edges(spark, sf_dir).filter("src < dst").select("src", "dst").collect()]
    return graph.order_frame(spark, graph.topological_order(edges))


# ---------------------------------------------------------------- state


def limiter_calls(spark, sf_dir):
    at = F.unix_micros(c("ts").cast("timestamp")) / 1e6
    return read(spark, sf_dir, "events").select((c("user_id") % 5).cast("string").alias("key"), c("event_id").alias("seq"), F.floor(at).cast("double").alias("at"))


def sliding_limiter(spark, sf_dir):
    """T-01: five calls a day of each key, by a fold over sorted runs of calls with the carried times that still count."""
    return limiters.limit(limiter_calls(spark, sf_dir), "sliding", 5, 86400.0)


def anchored_limiter(spark, sf_dir):
    """T-02: five calls in each window that begins with a call, found by doubling jumps between slices of time."""
    return limiters.limit(limiter_calls(spark, sf_dir), "anchored", 5, 86400.0)


SLIDING_LIMITER = """
    WITH RECURSIVE e AS (SELECT (user_id % 5)::VARCHAR AS key, event_id AS seq, floor(epoch_us(ts) / 1e6) AS t FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS i FROM e),
    f AS (SELECT key, seq, i, [t] AS held, true AS allowed FROM o WHERE i = 1
        UNION ALL SELECT o.key, o.seq, o.i, CASE WHEN len(young) < 5 THEN list_append(young, o.t) ELSE young END, len(young) < 5
        FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1, LATERAL (SELECT list_filter(f.held, lambda x: o.t - x < 86400) AS young))
    SELECT key, seq, allowed FROM f"""

ANCHORED_LIMITER = """
    WITH RECURSIVE e AS (SELECT (user_id % 5)::VARCHAR AS key, event_id AS seq, floor(epoch_us(ts) / 1e6) AS t FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS i FROM e),
    f AS (SELECT key, seq, i, t AS anchor, 1 AS n, true AS allowed FROM o WHERE i = 1
        UNION ALL SELECT o.key, o.seq, o.i, CASE WHEN o.t - f.anchor >= 86400 THEN o.t ELSE f.anchor END, CASE WHEN o.t - f.anchor >= 86400 THEN 1 WHEN f.n < 5 THEN f.n + 1 ELSE f.n END, o.t - f.anchor >= 86400 OR f.n < 5
        FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1)
    SELECT key, seq, allowed FROM f"""


def incremental_state(spark, sf_dir):
    """The last state of each key after two batches, in batch; T-04 keeps it between runs (limiters.upsert_state)."""
    from ..operators.joins import first_by

    rows = read(spark, sf_dir, "events").select((c("user_id") % 50).alias("name"), "event_id", (c("event_id") % 3 == 0).alias("migrated"))
    return first_by(rows, ["name"], [F.desc("event_id")])


INCREMENTAL_STATE = "SELECT user_id % 50 AS name, max(event_id) AS event_id, arg_max(event_id % 3 = 0, event_id) AS migrated FROM events GROUP BY 1"

# ---------------------------------------------------------------- generators, traces, statistics


def fuzz_inputs(spark, sf_dir):
    """N-01 N-02: fifty inputs for each mode."""
    out = [generators.fuzz_inputs(spark, m, 50).withColumn("mode", F.lit(m)) for m in ("args", "stdin", "none")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def fuzz_summary(spark, sf_dir):
    """A-13: divergences of runs, by order; runs that broke count as iterations."""
    k = c("l_partkey")
    runs = candidates(spark, sf_dir).select(c("unit"), c("ordinal").alias("seq"), (k % 5).alias("a"), F.when(k % 11 != 0, k % 5).otherwise(k % 3).alias("b"), (c("l_suppkey") % 9 != 0).alias("ran"))
    return generators.fuzz_summary(runs, "unit")


FUZZ_SUMMARY = f"""
    WITH {CANDIDATES.strip()}, r AS (SELECT unit, ordinal, l_partkey % 11 = 0 AND l_partkey % 5 <> l_partkey % 3 AND l_suppkey % 9 <> 0 AS bad FROM cand)
    SELECT unit, count(*) AS iterations, count(*) FILTER (WHERE bad) AS failures, min(ordinal) FILTER (WHERE bad) AS first_divergence, NOT bool_or(bad) AS all_passed FROM r GROUP BY unit"""


def test_value_combos(spark, sf_dir):
    """J-14 N-03: value combinations of parameter lists."""
    values = {"int": ["0", "1", "-1", "42"], "char *": ['"hello"', '""'], "double": ["0.0", "1.0", "-1.5", "3.14"], "int *": ["(int[]){1, 2, 3, 4, 5}"]}
    arrays = F.array(*[F.array(*[F.lit(x) for x in v]) for v in values.values()])
    k = c("p_partkey")
    lists = F.transform(F.slice(F.array(k % 4, F.floor(k / 4) % 4, F.floor(k / 16) % 4), 1, (k % 3 + 1).cast("int")), lambda i: F.element_at(arrays, (i + 1).cast("int")))
    return read(spark, sf_dir, "part").select(k.alias("id"), F.posexplode(generators.value_combos(lists)).alias("n", "combo"))


TEST_VALUE_COMBOS = """
    WITH v AS (SELECT [['0', '1', '-1', '42'], ['"hello"', '""'], ['0.0', '1.0', '-1.5', '3.14'], ['(int[]){1, 2, 3, 4, 5}']] AS vs),
    k AS (SELECT p_partkey AS id, list_transform(([p_partkey % 4, p_partkey // 4 % 4, p_partkey // 16 % 4])[:p_partkey % 3 + 1], lambda i: vs[i + 1]) AS lists FROM part, v),
    n AS (SELECT id, lists, unnest(range(list_max(list_transform(lists, lambda x: len(x))))) AS n FROM k)
    SELECT id, n::INT AS n, list_transform(lists, lambda x: x[n % len(x) + 1]) AS combo FROM n"""


def trace_groups(spark, sf_dir):
    """A-06 S-08: traces decoded from JSON and grouped; all count as cases, those with output are asserted."""
    rows = read(spark, sf_dir, "events").select("event_type", "event_id", F.from_json("props", "k INT").alias("p")).filter("p IS NOT NULL")
    order = F.array_sort(F.collect_list(F.struct("event_id", c("p.k").alias("k"))))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("cases"), F.count_if(c("p.k") % 2 == 0).alias("asserted"), F.slice(F.transform(order, lambda x: x["k"]), 1, 5).alias("first"))


TRACE_GROUPS = """
    WITH r AS (SELECT event_type, event_id, (props->>'k')::INT AS k FROM events WHERE props IS NOT NULL)
    SELECT event_type, count(*) AS cases, count(*) FILTER (WHERE k % 2 = 0) AS asserted, (list(k ORDER BY event_id))[:5] AS first FROM r GROUP BY 1"""


def column_stats(spark, sf_dir):
    """E-01: statistics that are 0 where there is nothing to compute them from."""
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    rows = read(spark, sf_dir, "events").groupBy((c("user_id") % 97).alias("bucket"))
    return rows.agg(zero(F.avg("value")).alias("mean"), zero(F.var_samp("value")).alias("variance"), zero(F.stddev_samp("value")).alias("stddev"), zero(F.min("value")).alias("low"), zero(F.max("value")).alias("high"), zero(F.median("value")).alias("median"))


COLUMN_STATS = """
    SELECT user_id % 97 AS bucket, round(coalesce(avg(value), 0), 6) AS mean, round(coalesce(var_samp(value), 0), 6) AS variance, round(coalesce(stddev_samp(value), 0), 6) AS stddev,
        round(coalesce(min(value), 0), 6) AS low, round(coalesce(max(value), 0), 6) AS high, round(coalesce(median(value), 0), 6) AS median FROM events GROUP BY 1"""


def fixture_builtins(spark, sf_dir):
    """E-02 E-03 E-05 E-07 E-08 E-09 E-10 E-11: scalar functions of the small expression language."""
    from ..functions import scripting as s

    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    url = F.concat(F.lit("http://host"), c("p_partkey").cast("string"), F.lit(":8080/a/b?x="), c("p_size").cast("string"), F.lit("#f"))
    return p.select(
        "p_partkey", s.index_of(c("p_name"), "an").alias("at"), s.substring(c("p_name"), 2, 6).alias("part"), s.char_at(c("p_name"), 1).alias("ch"), F.octet_length("p_name").alias("bytes"), F.reverse("p_name").alias("back"),
        s.round_half_away(c("p_retailprice") * 2).alias("rounded"), s.clamp(c("p_size"), 10, 40).alias("clamped"), s.add(c("p_size"), F.lit("x"), False, True).alias("joined"), s.divide(c("p_size"), c("p_size") % 3).alias("quotient"),
        s.djb2(c("p_name")).alias("hash"), F.crc32(c("p_name").cast("binary")).alias("crc"), s.adler32(c("p_name")).alias("adler"), F.parse_url(url, F.lit("QUERY"), F.lit("x")).alias("x"), s.json_get(F.concat(F.lit('{"Key": '), c("p_size").cast("string"), F.lit("}")), "kEY").alias("json"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        brace_depth, truncate_balanced, directive_forward_fill, file_markers, comment_blocks, best_version_fold, greedy_chunks, module_split, stall_counter, merge_imports, first_definition_wins, set_pack,
        scanner_udfs, rewrite_line_rules, rewrite_block_rules, topo_order, sliding_limiter, anchored_limiter, incremental_state, fuzz_inputs, fuzz_summary, test_value_combos, trace_groups,
        column_stats, fixture_builtins,
    )
}
ORACLE_SQL = {
    "brace_depth": BRACE_DEPTH, "truncate_balanced": TRUNCATE_BALANCED, "directive_forward_fill": DIRECTIVE_FORWARD_FILL, "file_markers": FILE_MARKERS, "comment_blocks": COMMENT_BLOCKS, "best_version_fold": BEST_VERSION,
    "greedy_chunks": GREEDY_CHUNKS, "module_split": MODULE_SPLIT, "stall_counter": STALL_COUNTER, "merge_imports": MERGE_IMPORTS, "first_definition_wins": FIRST_DEFINITION, "set_pack": SET_PACK, 
    "rewrite_line_rules": REWRITE_LINE_RULES, "rewrite_block_rules": REWRITE_BLOCK_RULES, "sliding_limiter": SLIDING_LIMITER, "anchored_limiter": ANCHORED_LIMITER, "incremental_state": INCREMENTAL_STATE, "fuzz_summary": FUZZ_SUMMARY,
    "test_value_combos": TEST_VALUE_COMBOS, "trace_groups": TRACE_GROUPS, "column_stats": COLUMN_STATS,
}
