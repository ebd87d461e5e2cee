"""Outlines against plain Python and written answers."""

import random

from pyspark.sql import functions as F

from sparkloom.functions import outlines as o


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_bodies_are_elided(spark):
    helper = "void helper(int x) {\n    int a = 1;\n    if (a) {\n        a--;\n    }\n    return;\n}\n"
    text = "#include <stdio.h>\ntypedef int myint;\nstruct Foo {\n int x;\n};\n" + helper + "int main() {\n    helper(1);\n    return 0;\n}\n"
    got = one(spark, text, lambda t: o.abbreviated(t, 5))
    assert got == "#include <stdio.h>\ntypedef int myint;\nstruct Foo {\n int x;\n};\nvoid helper(int x) {\n    // ... (body abbreviated for context)\n}\nint main() {\n    helper(1);\n    return 0;\n}"
    assert one(spark, text, lambda t: o.abbreviated(t, 50)) == text
    assert one(spark, "", lambda t: o.abbreviated(t, 0)) == "" and one(spark, None, lambda t: o.abbreviated(t, 0)) is None


def test_text_outside_functions_stays(spark):
    """Between bodies that close, every line at depth 0 stays, and each body leaves three lines."""
    rng = random.Random(2)
    parts, want = [], []
    for i in range(40):
        if rng.random() < 0.5:
            parts.append(f"int v{i};")
            want.append(parts[-1])
        else:
            inner = [f"  x{j};" for j in range(rng.randint(1, 4))]
            parts += [f"int f{i}(void) {{", *inner, "}"]
            want += [f"int f{i}(void) {{", o.ELIDED, "}"]
    assert one(spark, "\n".join(parts), lambda t: o.abbreviated(t, 3)).split("\n") == want


def test_fenced_json(spark):
    cases = {
        'x ```json\n{"a": 1}\n``` y ```json\n{"a": 2}```': '{"a": 1}',
        'see ```\n{"a": 3}\n``` end': '{"a": 3}',
        ' {"a": 4}\n': '{"a": 4}',
        '```json\n{"a": 5}': '```json\n{"a": 5}',
        "": "",
    }
    for text, want in cases.items():
        assert one(spark, text, o.fenced_json) == want
    parse = lambda t: o.parsed_json(t, "a int, b int", ["a", "b"])
    for text, want in (('```json {"a": 1, "b": 2} ```', (1, 2)), ('{"a": 1}', None), ("no", None), (None, None)):
        v = one(spark, text, parse)
        assert (v["value"] and tuple(v["value"])) == want and (v["error"] is None) == (want is not None)


def test_briefs(spark):
    brief = lambda t: o.brief_of(t, F.lit("f"))
    assert one(spark, "pub fn f(a: i32, mut b: &[u8]) -> Option<i32> {", brief) == "Migrated from C function `f` with a, mut b, returning `Option<i32>`."
    assert one(spark, "fn f() -> () {", brief) == "Migrated from C function `f`."
    assert one(spark, "struct X;", brief) == "Migrated from C function `f`."


def test_heads_in_blocks(spark):
    assert one(spark, "impl A { pub fn Go(&self) {} fn go() {} }", o.heads_in) == ["go"]


def test_comments_above_a_function(spark):
    cases = {
        "/* a\n * b\n */\n\n// c\n//// d\nint f(int x) {": ["b", "a", "c", "d"],
        "// far\nint y;\n// near\n\nint f(void);": ["near"],
        "int x;\nint f(void) { /* own */": [],
        "int f(void) /* own */": ["int f(void) /* own"],
        "// f(1) is no head\nvoid g();\nint f(int a)": [],
        " text */\nint f()": ["text"],
        "no function": [],
        "": [],
    }
    rows = spark.createDataFrame([(x,) for x in [*cases, None]], "t string")
    got = {r["t"]: r["c"] for r in rows.select("t", o.comments_above(F.col("t"), F.lit("f")).alias("c")).collect()}
    assert got == {**cases, None: None}


def test_documentation_goes_where_there_is_none(spark):
    rust = "use x;\nfn f(a: i32) -> u8 {\n}\n/// has\n\npub fn g() {}\n  unsafe fn h() {}\n"
    rows = spark.createDataFrame([(rust, ["one", "two"]), (rust, []), ("", []), (None, [])], "r string, c array<string>")
    got = [r[0] for r in rows.select(o.documented(F.col("r"), F.col("c"), F.lit("f")).alias("d")).collect()]
    note = "///\n/// # Safety\n/// This function contains unsafe code.\n"
    docs = "/// one\n/// two\n" + note
    assert got[0] == f"use x;\n{docs}fn f(a: i32) -> u8 {{\n}}\n/// has\n\npub fn g() {{}}\n{docs}  unsafe fn h() {{}}\n"
    assert "/// Migrated from C function `f` with a, returning `u8`.\n" + note + "fn f(" in got[1] and got[2:] == ["", None]
