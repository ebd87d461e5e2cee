"""Units of source code made from the part table: the engine's stand-in for a table of C sources and their translations.

Each part gets a C text and a Rust text put together from the pieces below by its key, and figures of a translation
run. UNITS_SQL gives the same rows in DuckDB; both sides only share the pieces and the arithmetic of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spread import spread

C_PIECES = [
    "int add_numbers(int a, int b) {\n    return a + b;\n}",
    "static void *make_node(size_t n) {\n    void *p = malloc(n);\n    return p;\n}",
    "struct Node {\n    int value;\n    struct Node *next;\n};\nint walk(struct Node *n) { while (n) n = n->next; return 0; }",
    "typedef struct HashTable {\n    int capacity;\n    int size;\n    Entry **buckets;\n} HashTable;\nunsigned int hash(const char *s) { return 5381; }",
    "int compare_ints(const void *a, const void *b) { return 0; }\nvoid sort_all(int *v, int n) { qsort(v, n, 4, compare_ints); }",
    "void close_all(FILE *f) {\n    if (!f) goto done;\n    fclose(f);\ndone:\n    free(f);\n}",
    "enum State { STATE_IDLE, STATE_RUN };\nvoid step(Machine *m) { switch (m->state) { case 0: m->state = STATE_RUN; } }",
    "int parse_expression(P *p) { return parse_term(p); }\nint parse_term(P *p) { return parse_factor(p); }\nint parse_factor(P *p) { return 1; }",
    "struct Tree { struct Tree *left; struct Tree *right; };\nint depth(struct Tree *t) { return 1; }",
    "void push(int x) { items[top++] = x; }\nint pop(void) { return items[--top]; }",
    "void enqueue(int x) { }\nint dequeue(void) { return 0; }\nuint32_t crc32(const char *b) { return 0; }",
    "int search_sorted(int *v, int low, int high) {\n    int mid = (low + high) / 2;\n    return mid;\n}",
    "int read_file(const char *name) { FILE *f = fopen(name, \"r\"); char buffer[64]; fread(buffer, 1, 64, f); return 0; }",
    "void lock_all(void) { pthread_mutex_lock(&m); pthread_create(&t, 0, run, 0); pthread_join(t, 0); }",
    "union Value { int i; float f; };\nint main(int argc, char **argv) { printf(\"%d\", argc); return add_numbers(1, 2); }",
    "/* helpers */\nint getValue(int k) { scanf(\"%d\", &k); return k; }\nint isReady(void) { return getValue(1); }",
]
RUST_PIECES = [
    "pub fn add_numbers(a: i32, b: i32) -> i32 {\n    a + b\n}",
    "fn make_node(n: usize) -> Vec<u8> { vec![0; n] }",
    "pub struct Node {\n    value: i32,\n    next: Option<Box<Node>>,\n}",
    "impl Node {\n    pub fn walk(&self) -> i32 { 0 }\n}",
    "fn total(v: &[i32]) -> i32 { v.iter().map(|x| x * 2).collect::<Vec<_>>().len() as i32 }",
    "fn empty_one() {}",
    "fn later() { todo!() }",
    "fn risky(p: *const u8) -> u8 {\n    unsafe { *p }\n}",
    "fn names(m: &HashMap<String, i32>) -> String { m.keys().next().unwrap().to_string() }",
    "fn looped(v: &[i32]) -> i32 {\n    let mut s = 0;\n    for i in 0..v.len() { s += v[i]; }\n    s\n}",
    "enum State { Idle, Run }\nconst LIMIT: usize = 16;",
    "pub(crate) fn parse(s: &str) -> Result<i32, String> { s.parse::<i32>().map_err(|e| e.to_string()) }",
    "fn casts(x: i32) -> f64 { let a = x as usize as i32 as f64; a as f64 }",
    "// a note\nfn text() -> &'static str { \"{ not a brace\" }",
    "use std::io::{self, Read};\nuse std::fmt;",
    "fn open_block(x: i32) -> i32 {\n    if x > 0 {\n        return 1;",
]
STATES = ["Pending", "Validated", "CompilesUnsafe", "NearlyCompiles", "CompilesLowScore", "FallbackUnsafe", "Repairing"]
FILLER = "int filler = 0;\n"


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, c, rust, unsafe, warnings, compiles, same, score, errors, state, iteration, calls, max_calls, tokens, budget)."""
    k = F.col("p_partkey")
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey")
    # A piece is chosen by the key and its quotients, so that neighbours differ in more than one.
    c = F.concat_ws("\n", _pick(C_PIECES, k), _pick(C_PIECES, F.floor(k / 16)), _pick(C_PIECES, F.floor(k / 7)), F.repeat(F.lit(FILLER), (k % 53).cast("int")))
    rust = F.concat_ws("\n", _pick(RUST_PIECES, k), _pick(RUST_PIECES, F.floor(k / 16)), _pick(RUST_PIECES, F.floor(k / 5)), _pick(RUST_PIECES, F.floor(k / 11)))
    return part.select(
        k.alias("id"),
        F.concat(F.lit("unit_"), k.cast("string")).alias("name"),
        c.alias("c"),
        rust.alias("rust"),
        (k % 8).cast("int").alias("unsafe"),
        (k % 5).cast("int").alias("warnings"),
        (k % 3 != 0).alias("compiles"),
        F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("same"),
        (k * 13 % 101).cast("int").alias("score"),
        (k * 7 % 130).cast("int").alias("errors"),
        _pick(STATES, k).alias("state"),
        (k % 8).cast("int").alias("iteration"),
        (k * 3 % 70).cast("int").alias("calls"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, 0).otherwise(k % 40 + 20).cast("int").alias("max_calls"),
        (k * 977 % 3000000).alias("tokens"),
        F.when(k % 6 != 0, F.lit(2000000)).cast("long").alias("budget"),
    )


def _sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


UNITS_SQL = f"""
    pieces AS (SELECT {_sql(C_PIECES)} AS cp, {_sql(RUST_PIECES)} AS rp, {_sql(STATES)} AS sp),
    units AS (
        SELECT p_partkey AS id, 'unit_' || p_partkey AS name,
            cp[p_partkey % 16 + 1] || chr(10) || cp[p_partkey // 16 % 16 + 1] || chr(10) || cp[p_partkey // 7 % 16 + 1] || chr(10)
                || repeat('{FILLER}', (p_partkey % 53)::INT) AS c,
            rp[p_partkey % 16 + 1] || chr(10) || rp[p_partkey // 16 % 16 + 1] || chr(10) || rp[p_partkey // 5 % 16 + 1] || chr(10) || rp[p_partkey // 11 % 16 + 1] AS rust,
            (p_partkey % 8)::INT AS unsafe, (p_partkey % 5)::INT AS warnings, p_partkey % 3 <> 0 AS compiles,
            CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS same,
            (p_partkey * 13 % 101)::INT AS score, (p_partkey * 7 % 130)::INT AS errors, sp[p_partkey % 7 + 1] AS state, (p_partkey % 8)::INT AS iteration,
            (p_partkey * 3 % 70)::INT AS calls, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE (p_partkey % 40 + 20)::INT END AS max_calls,
            p_partkey * 977 % 3000000 AS tokens, CASE WHEN p_partkey % 6 <> 0 THEN 2000000 END AS budget
        FROM part, pieces),
    texts AS (SELECT *, d_rows(c) AS c_rows, d_rows(rust) AS r_rows FROM units)"""


def d_rows(x: str) -> str:
    """DuckDB SQL of a text's lines."""
    rows = f"string_split({x}, chr(10))"
    return f"(CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN {x} LIKE '%' || chr(10) THEN {rows}[:-2] ELSE {rows} END)"


def d_count(x: str, part: str) -> str:
    part = part.replace("'", "''")
    return f"((length({x}) - length(replace({x}, '{part}', ''))) // {len(part.replace(chr(39) * 2, chr(39)))})"


def d_has(x: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


UNITS_SQL = UNITS_SQL.replace("d_rows(c)", d_rows("c")).replace("d_rows(rust)", d_rows("rust"))
#: The same for tables: WITH units AS (...), texts AS (...) in front of a query over texts.
WITH_UNITS = "WITH RECURSIVE " + UNITS_SQL.strip()
