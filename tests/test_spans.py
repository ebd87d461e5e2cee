"""Spans, calls, blocks, assembly and chunks of small texts, and those of programs against what they were made from."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.functions import outlines, predicates
from sparkloom.operators import chunks, sets, spans
from sparkloom.operators.ordered import exploded_lines
from sparkloom.session import prepare

SF = "/root/testdata/sf0.001"
SOURCE = """/* f( in a comment { */
#define OPEN(x) \\
    g(x) {
static int *f (int a, char c)
{
    char *s = "g({"; // g(1) }
    if (a) { return g(a) + f (a - 1, '}'); }
    h
    (2);
}
int (*pointer)(int) = g; struct S { int (*call)(int); };
int table[] = { 1, 2 };
void g(int x) { undefined(x); } int h(int y) { return f(y, 'a'); }
} void after(void) { g(1)
"""


def texts(spark, *sources):
    return spark.createDataFrame(list(enumerate(sources)), "id long, t string")


def test_functions_and_calls_of_a_text(spark):
    tokens = spans.c_tokens(texts(spark, SOURCE, None, "", "int x;"), "id", "t").cache()
    assert "".join(r[0] for r in tokens.filter("id = 0").orderBy("i").select("token").collect()) == SOURCE
    found = {r["function"]: r for r in spans.c_functions(tokens, "id").collect()}
    lines = SOURCE.split("\n")
    assert {f: (r["first_line"], r["last_line"]) for f, r in found.items()} == {"f": (4, 10), "g": (13, 13), "h": (13, 13), "after": (14, 14)}
    assert SOURCE[found["g"]["first"] : found["g"]["last"]] == "void g(int x) { undefined(x); }" and lines[12].startswith("void g")
    assert SOURCE[found["f"]["first"] :].startswith("static int *f") and SOURCE[found["f"]["opens"]] == "{"
    calls = {(r["function"], r["callee"], r["line"]) for r in spans.c_calls(tokens, "id").collect()}
    assert calls == {("f", "g", 7), ("f", "f", 7), ("f", "h", 8), ("g", "undefined", 13), ("h", "f", 13), ("after", "g", 14)}
    assert {tuple(r) for r in spans.call_graph(tokens, "id", []).collect()} == {("f", "g"), ("f", "h"), ("h", "f"), ("after", "g")}
    assert spans.call_graph(tokens, "id", ["id"]).count() == 4


def test_long_texts_take_time_with_their_length(spark):
    source = "".join(f"int f{i}(int a) {{\n    return f{i + 1}(a);\n}}\n" for i in range(20000))
    tokens = spans.c_tokens(texts(spark, source), "id", "t")
    assert spans.call_graph(tokens, "id", []).count() == 19999


def test_calls_of_programs_are_those_they_were_made_of(spark):
    style = ("step_{}", "getItem{}", "ParseNode{}", "is_ready_{}")
    name = lambda k: style[k % 4].format(k)
    calls = {0: (0,), 1: (0, 1), 2: (1,), 3: (0,), 4: (), 5: (0,), 6: (1,), 7: (0,), 8: (0,)}
    n = spark.read.parquet(f"{SF}/part.parquet").agg(F.max("p_partkey")).first()[0]
    keys = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    want = {(name(k), name(2 * k + i)) for k in keys for i in calls[k % 9] if 2 * k + i in keys and 2 * k + i != k}
    want |= {(name(k), "create_" + name(k)) for k in keys if k % 9 == 6}
    assert n and {tuple(r) for r in entry.queries()["call_graph"](spark, SF).collect()} == want


def test_blocks_end_where_a_scan_ends(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["head {", "head", "}", "x {", "} }", "} else {", "", "head { }", "head { {"]) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    lines = exploded_lines(spark.createDataFrame(rows, "id long, t string"), "t", ["id"])
    for exact in (False, True):
        want = set()
        for i, text in rows:
            all_ = text.split("\n") if text else []
            all_ = all_[:-1] if text.endswith("\n") else all_
            for a, x in enumerate(all_):
                if x.startswith("head"):
                    depth, opened, end = 0, False, a if exact else len(all_) - 1
                    for b in range(a, len(all_)):
                        depth += all_[b].count("{") - all_[b].count("}")
                        opened |= "{" in all_[b]
                        if (opened and depth == 0) if exact else depth <= 0:
                            end = b
                            break
                    want.add((i, a, end))
        got = spans.block_ends(lines, ["id"], "pos", "line", F.col("line").startswith("head"), exact).select("id", "pos", "end")
        assert {tuple(r) for r in got.collect()} == want


def test_functions_at_lines(spark):
    rust = "use x;\nfn a() {\n    1\n}\n\nimpl S {\n    pub async fn b(&self)\n    {\n        2\n    }\n}\nfn open() {\n  3\n"
    df = texts(spark, rust)
    points = spark.createDataFrame([(0, n) for n in range(1, 14)], "id long, line int")
    got = {r["line"]: r["function"] for r in spans.functions_at(points, spans.rust_functions(df, "id", "t"), ["id"], "line").collect()}
    assert got == {**dict.fromkeys(range(1, 14)), 2: "a", 3: "a", 4: "a", 7: "b", 8: "b", 9: "b", 10: "b", 12: "open"}


def test_assembly_removes_whole_definitions(spark):
    prepare(spark)
    one = "use b::C;\npub struct A {\n    x: i32,\n    const B: i32 = 1;\n}\n```\n"
    two = "\n  \nstruct A {\n    y: i32,\n    const D: [i32; 1] = [\n    1];\n}\nuse b::C;\nconst D: i32 = 2;\nenum Given { P {\n} }\nfn f() {}\n\n"
    three = "const D: i32 = 3;\nconst B: i32 = 4;\nstruct A {\n}"
    rows = [(1, 0, "m", one), (1, 1, "n", two), (1, 2, "o", three), (2, 0, "m", "  \n"), (3, 0, "p", "fn only() {}"), (3, 1, "q", None)]
    df = spark.createDataFrame(rows, "u long, module int, name string, t string").withColumnRenamed("t", "text")
    contracts = spark.createDataFrame([(1, "pub enum Given { P }")], "u long, contract string")
    got = {r["u"]: r["text"] for r in sets.assembled(df, "u", "text", contracts).collect()}
    assert got[1] == (
        "use b::C;\n\n// === P33: Type Contract (shared types) ===\npub enum Given { P }\n// === End Type Contract ===\n\n"
        "// --- Module: m ---\npub struct A {\n    x: i32,\n    const B: i32 = 1;\n}\n\n// --- Module: n ---\nconst D: i32 = 2;\nfn f() {}\n"
    )
    assert got[2] == "\n" and got[3] == "// --- Module: p ---\nfn only() {}\n"
    assert sets.assembled(df, "u", "text").filter("text LIKE '%Given%'").count() == 1
    assert sets.assembled(df.limit(0), "u", "text").collect() == []


def test_chunks_of_a_source(spark):
    table = "static const int big[] = {\n" + "  1,\n" * 40 + "};\n"
    long_ = "int long_one(int a) {\n" + "  a++;\n" * 30 + "}\n"
    source = "struct List { int n; };\n" + table + "int work(int a) {\n  return a;\n}\n" + long_ + "int list_get(int a) { return a; }\nint new_list(void) {\n  return 1;\n}\nint last(void) { return 0; }\n"
    rows = chunks.structural_chunks(texts(spark, source, "int plain(void) { return 1; }\n" * 3, "int x;\n", None), "id", "t", 10).orderBy("id", "chunk").collect()
    got = [(r["id"], r["chunk"], r["is_data"], r["names"], r["lines"]) for r in rows]
    assert got[:6] == [(0, 0, False, ["list_get", "new_list"], 4), (0, 1, True, ["big"], 42), (0, 2, False, ["work"], 3), (0, 3, False, ["long_one"], 32), (0, 4, False, ["last"], 1), (1, 0, False, ["plain"] * 3, 3)]
    assert got[6][:4] == (2, 0, False, []) and rows[1]["source"] == table


def test_summaries_and_headers(spark):
    source = "typedef int t;\nstruct A {\n  int x;\n};\nint f(int a) {\n  int y = 1;\n  struct B { int z; };\n}\nint g = 1;\n" + "".join(f"int g{i} = {i};\n" for i in range(11))
    df = texts(spark, source, "", "// nothing(", None).select("id", outlines.declarations(F.col("t")).alias("d")).select("id", outlines.structural_summary(F.col("d")).alias("s")).orderBy("id")
    got = [r["s"] for r in df.collect()]
    assert got[0] == "**Typedefs (1):** typedef int t;\n**Structs/Enums (2):** struct A, struct B\n**Functions (1):**\n- `int f(int a)`\n**Globals (12):** int g = 1;; " + "; ".join(f"int g{i} = {i};" for i in range(9)) + " ... and 2 more\n"
    assert got[1:] == ["", "", None]


def test_why_functions_cannot_be_traced(spark):
    cases = {
        ("int f(int a, const char *s) {", "int"): None, ("void f(void)", "void"): None, ("int f(int a, ...) {", "int"): "variadic function", ("int f(void *p) {", "int"): "void* parameter: void*",
        ("int f(struct S s) {", "int"): "struct/union parameter: struct S", ("int f(FILE *f) {", "int"): "FILE parameter: FILE*", ("int f(node n) {", "int"): "unsupported parameter type: node",
        ("static int f(int a) {", "static int"): "unsupported return type: static int", ("int f(const int *v, size_t n)", "int*"): None, ("int f(int)", "node"): "unsupported return type: node",
    }
    df = spark.createDataFrame(list(cases), "head string, returns string")
    assert {(r["head"], r["returns"]): r["x"] for r in df.select("*", predicates.not_instrumentable(F.col("head"), F.col("returns")).alias("x")).collect()} == cases
