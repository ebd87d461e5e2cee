"""Programs made from the part table: C files whose functions call each other, and Rust texts that go with them.

Each part is a function: its key chooses a template and a style of name, and it calls the functions of twice its key.
Twelve parts make a file. Templates hold what misleads a search by words: calls in comments and literals, prototypes,
macros, braces in literals, pointers to functions, tables of data. PROGRAMS_SQL gives the same rows in DuckDB; both
sides only share templates and the arithmetic of keys, and take texts apart each in its own way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread

#: @K is the key, @N the function's name, @A and @B the names of those it calls, @S and @L its name in snake and lower case.
C_TEMPLATES = [
    'static int @N(int a, const char *s) {\n    /* @B( is not called */ char *t = "@B(}";\n    return @A(a, t) + @N(a - 1, s);\n}',
    '// @A(1) is not called here\nint @N(int n) {\n    int *p = malloc(n);\n    if (!p) { return 0; }\n    return @A(n, "x") + @B(n);\n}',
    "struct Item@K {\n    int value;\n    struct Item@K *next;\n};\nint @A(int a, const char *s);\nvoid @N(struct Item@K *i) { while (i) { @B(i->value); i = i->next; } }",
    "#define USE@K(x) \\\n    @B(x) {\nchar\n*@N (const char *name)\n{\n    char c = '{';\n    free(name); return @A(c, name); }",
    "static const int table@K[] = {\n" + "    1, 2, 3, 4,\n" * 32 + "};\nint @N(double x, ...) {\n    return table@K[0];\n}",
    "enum Kind@K { A@K, B@K };\nint (*hook@K)(int);\nunsigned long @N(FILE *f, void *p) {\n    {\n        @A(1, 0);\n    }\n    hook@K(2);\n    return 1;\n}",
    "typedef struct {\n    int x;\n} Pair@K;\nint counter@K = 3;\nstruct Pair@K *create_@N(void) { return calloc(1, 8); }\nint @N(int n) { return create_@N()->x + @B(n) + sizeof(n); }",
    "int @N(unsigned int *v, size_t n) {\n    for (size_t i = 0; i < n; i++) {\n        v[i] = realloc_all(@A(i, 0));\n    }\n    return n;\n}",
    "void @N(int *v, int n) {\n    for (int i = 0; i < n; i++) {\n        for (int j = 0; j < i; j++) { int temp = v[j]; v[j] = v[i]; v[i] = temp; }\n    }\n    __sync_fetch_and_add(v, @A(n, 0));\n    SwapAll@K(v); // swap\n}",
]
RUST_TEMPLATES = [
    "// @N was left out",
    "pub fn @S(a: i32) -> i32 {\n    let f = |x: i32| { x + a };\n    f(1)\n}",
    "impl Unit@K {\n    pub fn @L(&self) -> i32 {\n        if true {\n            return 1;\n        }\n        0\n    }\n}",
    "mod m@K { pub extern fn @L() {} }",
    "async fn @S\n(x: i32)\n-> i32\n{\n    x\n}\nconst C@K: i32 = 1;",
]
#: Parts of modules: @M is one of seven numbers, so that modules of a unit define the same names.
MODULE_TEMPLATES = [
    "use std::io::{self, Read};\nuse std::fmt;\npub struct Shared@M {\n    pub a: i32,\n    pub b: i32,\n}",
    "```rust\nenum Kind@M {\n    A { x: i32 },\n    B,\n}\n```",
    "impl Shared@M {\n    const LIMIT@M: usize = 4;\n    fn get(&self) -> i32 { self.a }\n}",
    "pub const LIMIT@M: usize = 3;\nuse std::io::{Write, Read};\npub type Id@M = u64;",
    "\n\nfn free_@K(x: i32) -> i32 {\n    x\n}\n\n",
    "pub struct Outer@M {\n    inner: i32,\n    const Kind@M: [i32; 2] = [\n        1, 2\n    ];\n}",
]
HEADER_TEMPLATES = [
    '#ifndef H@K\n#define H@K\n#define _GUARD@K 1\n#include "x.h"\n/* struct no */\ntypedef struct {\n@R    struct { int b; } c;\n} T@K;\nint f@K(int a);\nextern int e@K;\n  enum E@K { A@K };\n#endif\n',
    "#pragma once\nint nothing@K;\n",
    "struct S@K {\n@R};\nvoid g@K(void) {\n    struct S@K s;\n}\nint (*typedef_@K)(*);\n",
]
FIELD = "    int a;\n"
CONTRACT = "pub struct Shared1 {\n    pub a: i32,\n}\npub type Id2 = u32;"
STYLES = ("step_{k}", "getItem{k}", "ParseNode{k}", "is_ready_{k}")


def _filled(templates: list[str], at: Column, words: dict[str, Column]) -> Column:
    text = F.element_at(F.array(*[F.lit(t) for t in templates]), (at % len(templates) + 1).cast("int"))
    for mark, word in words.items():
        text = F.replace(text, F.lit(mark), word)
    return text


def name_of(k: Column) -> Column:
    forms = [F.concat(F.lit(before), k.cast("string"), F.lit(behind)) for before, behind in (s.split("{k}") for s in STYLES)]
    return F.element_at(F.array(*forms), (k % len(STYLES) + 1).cast("int"))


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(.)([A-Z])", "$1_$2"))


def parts(spark: SparkSession, sf_dir: str, by: str = "file") -> DataFrame:
    """(k, file, unit, name, c, rust, module, header): a function for each part, and texts that go with it, dealt by k, file or unit."""
    k = F.col("k")
    read = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    keys = spread(read.select(k, F.floor(k / 12).alias("file"), F.floor(k / 24).alias("unit")), by)
    name = name_of(k)
    words = {"@K": k.cast("string"), "@N": name, "@A": name_of(k * 2), "@B": name_of(k * 2 + 1), "@S": snake(name), "@L": F.lower(name), "@M": (k % 7).cast("string"), "@R": F.repeat(F.lit(FIELD), (k % 23).cast("int"))}
    return keys.select(
        "k", "file", "unit", name.alias("name"), _filled(C_TEMPLATES, k, words).alias("c"), _filled(RUST_TEMPLATES, k, words).alias("rust"), _filled(MODULE_TEMPLATES, k, words).alias("module"),
        _filled(HEADER_TEMPLATES, k, words).alias("header"),
    )


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, c, rust): the texts of twelve parts, in the order of their keys."""
    rows = parts(spark, sf_dir).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", "c", "rust"))).alias("v"))
    joined = lambda field: F.array_join(F.transform("v", lambda x: x[field]), "\n")
    return rows.select("file", joined("c").alias("c"), joined("rust").alias("rust"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, module, name, text): six modules of four parts each for a unit of twenty-four."""
    k = F.col("k")
    rows = parts(spark, sf_dir, "unit").groupBy("unit", F.floor(k % 24 / 4).alias("module")).agg(F.array_sort(F.collect_list(F.struct("k", F.col("module").alias("t")))).alias("v"))
    return rows.select("unit", "module", F.concat(F.lit("m"), F.col("module").cast("string")).alias("name"), F.array_join(F.transform("v", lambda x: x["t"]), "\n").alias("text"))


def headers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(folder, name, text) of a header for each part, and (folder, file, c) of files that include ten of them or fewer.

    Each file takes those of its own first parts, one that is not there, a system header, and one again.
    """
    k = F.col("k")
    store = parts(spark, sf_dir).select((F.col("file") % 5).alias("folder"), F.concat(F.lit("h"), k.cast("string"), F.lit(".h")).alias("name"), F.col("header").alias("text"))
    line = lambda number: F.concat(F.lit('#include "h'), number.cast("string"), F.lit('.h"'))
    own = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: line(F.col("file") * 12 + i))
    text = F.concat(F.lit("#include <h1.h>\n#include  \"none.h\"\n"), F.array_join(own, "\n"), F.lit("\n  "), line(F.col("file") * 12), F.lit(" \nint x;"))
    files = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.floor(F.col("p_partkey") / 12).alias("file")).distinct()
    return store, files.select((F.col("file") % 5).alias("folder"), "file", text.alias("c"))


def _sql(values: list[str]) -> str:
    quoted = ("'" + v.replace("'", "''") + "'" for v in values)
    return "[" + ", ".join(quoted) + "]"


def _sql_name(k: str) -> str:
    return "(CASE " + f"({k}) % {len(STYLES)} " + " ".join(f"WHEN {i} THEN '{s.split('{k}')[0]}' || ({k}) || '{s.split('{k}')[1]}'" for i, s in enumerate(STYLES)) + " END)"


def _sql_filled(templates: list[str]) -> str:
    text = f"{_sql(templates)}[p_partkey % {len(templates)} + 1]"
    n = _sql_name("p_partkey")
    marks = {"@K": "p_partkey::VARCHAR", "@N": n, "@A": _sql_name("p_partkey * 2"), "@B": _sql_name("p_partkey * 2 + 1"), "@S": f"lower(regexp_replace({n}, '(.)([A-Z])', '\\1_\\2', 'g'))", "@L": f"lower({n})", "@M": "(p_partkey % 7)::VARCHAR", "@R": f"repeat('{FIELD}', (p_partkey % 23)::INT)"}
    for mark, word in marks.items():
        text = f"replace({text}, '{mark}', {word})"
    return text


#: Common table expressions functions(k, file, name, c, rust, module, header), programs(file, c, rust) and modules(unit, module, text).
PROGRAMS_SQL = f"""
    functions AS (SELECT p_partkey AS k, p_partkey // 12 AS file, {_sql_name('p_partkey')} AS name, {_sql_filled(C_TEMPLATES)} AS c,
        {_sql_filled(RUST_TEMPLATES)} AS rust, {_sql_filled(MODULE_TEMPLATES)} AS module, {_sql_filled(HEADER_TEMPLATES)} AS header FROM part),
    programs AS (SELECT file, string_agg(c, chr(10) ORDER BY k) AS c, string_agg(rust, chr(10) ORDER BY k) AS rust FROM functions GROUP BY file),
    modules AS (SELECT k // 24 AS unit, k % 24 // 4 AS module, string_agg(module, chr(10) ORDER BY k) AS text FROM functions GROUP BY ALL)"""
