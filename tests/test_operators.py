"""Operators against plain loops on small tables, and readers on temporary files."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import predicates as p
from sparkloom.functions import text as t
from sparkloom.operators import generators, graph, ordered, ranking, rewrites, scanners
from sparkloom.session import prepare
from sparkloom.sources import texts
from sparkloom.streaming import limiters


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_lines_and_tokens(spark):
    assert column(spark, ["", "\n", "a", "a\r\nb", "a\n\nb\n"], t.lines) == [[], [""], ["a"], ["a", "b"], ["a", "", "b"]]
    assert column(spark, ["", "a b", "héllo_1 + x", "a\nb\nc\nd\ne"], t.token_estimate) == [0, 2, 4, 6]
    assert column(spark, ["x = 1;", "/* *p */", "int *p;\n" * 51 + "malloc", "goto end;"], t.difficulty) == ["easy", "easy", "hard", "hard"]


def test_fences_and_reviews(spark):
    assert column(spark, ["a ```rust\nx\n``` b", "```\ny\n```", "```rust\nopen", " plain "], t.fenced_code) == ["x", "y", "```rust\nopen", "plain"]
    assert column(spark, ["1.0", "nan", "a"], lambda x: t.lines_match(x, F.lit("1.4"), 0.5)) == [True, True, False]


def test_score_is_bounded_and_falls_with_unsafe_blocks(spark):
    rng = random.Random(0)
    rust = ["".join(rng.choice(["Result<", ".unwrap() ", " as ", "[i]", "fn f() {}\n", "String", "\n"]) for _ in range(rng.randrange(30))) for _ in range(40)]
    rows = spark.createDataFrame([(x,) for x in rust], "x string")
    empty = scanners.empty_function_count("x")
    got = prepare(spark) and rows.select(*[t.idiom_score(F.col("x"), F.lit("int a;\n" * 8), F.lit(u), F.lit(0), empty) for u in (0, 1, 3)]).collect()
    assert all(0 <= v <= 100 for r in got for v in r) and all(r[0] >= r[1] >= r[2] for r in got)


def test_bracket_rounds_equal_the_sort(spark):
    rng = random.Random(1)
    rows = [(u, o, rng.random() < 0.5, rng.randrange(3), rng.randrange(2), float(rng.randrange(2))) for u in range(60) for o in range(rng.randrange(1, 8))]
    better = lambda a, b: a if (not a[2], -a[3], a[4], a[5]) <= (not b[2], -b[3], b[4], b[5]) else b
    want = {}
    for u in range(60):
        round_ = [r for r in rows if r[0] == u]
        while len(round_) > 1:
            round_ = [better(*round_[i : i + 2]) if i + 1 < len(round_) else round_[i] for i in range(0, len(round_), 2)]
        want[u] = round_[0][1]
    df = spark.createDataFrame(rows, "unit int, ordinal int, compiles boolean, score int, unsafe int, cost double")
    assert {r["unit"]: r["ordinal"] for r in ranking.tournament(df, "unit").collect()} == want


def test_the_fold_is_no_maximum(spark):
    rows = [(1, 1, 90, False, 0, True), (1, 2, 60, True, 0, True), (2, 1, 50, True, 9, True), (2, 2, 40, True, 0, False)]
    df = spark.createDataFrame(rows, "unit int, ordinal int, score int, compiles boolean, unsafe int, substance boolean")
    assert sorted(map(tuple, ordered.best_version(df, "unit", "ordinal", F.lit(3)).collect())) == [(1, 2, 60), (2, None, 0)]


def test_sliding_limit_is_no_count_over_a_range(spark):
    prepare(spark)
    calls = [("a", i, float(s)) for i, s in enumerate([0] * 61 + [59, 60, 60])]
    df = spark.createDataFrame(calls, "key string, seq long, at double")
    got = [r["allowed"] for r in limiters.limit(df, "sliding").orderBy("seq").collect()]
    assert got == [True] * 60 + [False, False, True, True]
    assert [r["allowed"] for r in limiters.limit(df, "anchored").orderBy("seq").collect()] == [True] * 60 + [False, False, True, True]


def test_limiter_over_a_stream(spark, tmp_path):
    prepare(spark)
    spark.createDataFrame([("a", i, float(i)) for i in range(8)], "key string, seq long, at double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, at double").parquet(str(tmp_path / "in"))
    query = limiters.limit_stream(stream, most=3, window=5.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    ended = query.awaitTermination(60)
    query.stop()
    assert ended
    assert [r["allowed"] for r in spark.table("limited").orderBy("seq").collect()] == [True, True, True, False, False, True, True, True]


def test_state_keeps_the_last_row(spark, tmp_path):
    path = str(tmp_path / "state")
    assert limiters.read_state(spark, path) is None
    for batch in ([("a", 1), ("b", 1)], [("a", 2)]):
        limiters.upsert_state(spark, spark.createDataFrame(batch, "name string, seq long"), path, "name", "seq")
    assert sorted(map(tuple, limiters.read_state(spark, path).collect())) == [("a", 2), ("b", 1)]


def test_waves_and_order(spark):
    prepare(spark)
    nodes, edges = spark.createDataFrame([(i,) for i in range(7)], "m int"), spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 3), (4, 5)], "a int, b int")
    assert {r["m"]: r["wave"] for r in graph.waves(nodes, edges, "m", "a", "b").collect()} == {0: 0, 6: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3}
    assert graph.topological_order([("b", "c"), ("a", "c"), ("c", "d")]) == ["a", "b", "c", "d"]
    assert graph.topological_order([("b", "a"), ("a", "b"), ("c", "a")]) == ["a", "b", "c"]


def rewritten(spark, rule, rows, *errors):
    kind = "r array<string>, e array<struct<code:string,line:int,message:string>>"
    return spark.createDataFrame([(rows, list(errors))], kind).select(rule(F.col("r"), F.col("e")).alias("r")).first()[0]


def test_block_rules(spark):
    a_repeated, d_conflicts = "the name `a` is defined multiple times", "conflicting implementations of trait `D` for type `X`"
    bounds = "trait bounds were not satisfied"
    cases = [
        (rewrites.repeated_functions, ["fn a() {", "}", "fn a() {", " x", "}", "z"], [("E0428", 3, a_repeated)], ["fn a() {", "}", "z"]),
        (rewrites.repeated_functions, ["fn a() {", " fn a() {}", "}", "fn b() {} fn a() {"], [("E0428", 3, a_repeated)], ["fn a() {", " fn a() {}", "}"]),
        (rewrites.repeated_functions, ["fn a() {", "}", "fn a() {}"], [("E0429", 3, a_repeated)], ["fn a() {", "}", "fn a() {}"]),
        (rewrites.clone_bounds, ["fn f<T: Debug>(x: T) {", " x.clone()"], [("E0599", 2, bounds)], ["fn f<T: Debug + Clone>(x: T) {", " x.clone()"]),
        (rewrites.clone_bounds, ["fn f<T: Debug, U, V: A + B >(x: T) {"], [("E0599", 1, bounds), ("E0599", 1, bounds)], ["fn f<T: Debug + Clone, U, V: A + B + Clone>(x: T) {"]),
        (rewrites.clone_bounds, ["fn f<T: Debug>(x: T) {", "}", "pub fn g() {", " y"], [("E0599", 4, bounds), ("E0599", 0, bounds), ("E0599", 9, bounds)], ["fn f<T: Debug>(x: T) {", "}", "pub fn g() {", " y"]),
        (rewrites.moved_options, ["fn f(v: Option<&mut T>) {", "if let Some(x) = v {"], [("E0382", 2, "use of moved value: `v`")], ["fn f(mut v: Option<&mut T>) {", "if let Some(ref mut x) = v {"]),
        (rewrites.repeated_imports, ["use a::Read;", "use b::Read;", "use b::Write;"], [("E0252", 2, "the name `Read` is defined multiple times")], ["use a::Read;", "use b::Write;"]),
        (rewrites.repeated_imports, ["use a::Read;", "use b::{Write, Read};", "pub use c::Read;"], [("E0252", 2, "the name `Read` is defined multiple times")], ["use a::Read;", "use b::{Write, Read};"]),
        (rewrites.field_prefixes, ["s.m_len", "s.m_len", "", "s.m_len"], [("E0609", 1, "no field `m_len` on type `S`")], ["s.len", "s.len", "", "s.m_len"]),
        (rewrites.free_functions, ["fn go(x: i32) {}", "self.go(1); Self::go(2)"], [("E0599", 2, "no method named `go` found")], ["fn go(x: i32) {}", "go(self, 1); go(2)"]),
        (rewrites.free_functions, ["fn go(x: i32) {}", "self.no(1)"], [("E0599", 2, "no method named `no` found")], ["fn go(x: i32) {}", "self.no(1)"]),
        (rewrites.windows_only, ["use std::os::windows::x;", "#[cfg(windows)]", "fn w() {", "}", "k"], [("E0433", 1, "no windows")], ["// R11 (non-Windows): use std::os::windows::x;", "// R11 (non-Windows): #[cfg(windows)]", "// R11: fn w() {", "// R11: }", "k"]),
        (rewrites.truncated_functions, ["}", "pub fn cut(", "  a: i32,", "// --- Module: b"], [], ["}", "// R12: truncated function stubbed at module boundary", "pub fn cut() -> bool { false }", "", "// --- Module: b"]),
        (rewrites.truncated_functions, ["}", "pub fn cut(", *["  a: i32,"] * 9, "// --- Module: b"], [], ["}", "pub fn cut(", *["  a: i32,"] * 9, "// --- Module: b"]),
        (rewrites.conflicting_impls, ["impl D for X {", "}", "impl fmt::D for X {", "}"], [("E0119", 3, d_conflicts)], ["impl D for X {", "}"]),
        (rewrites.conflicting_impls, ["impl D for X {", "}", *["x"] * 20, "impl D for X {", "}"], [("E0119", 3, d_conflicts)], ["impl D for X {", "}", *["x"] * 20, "impl D for X {", "}"]),
    ]
    for rule, rows, errors, want in cases:
        assert rewritten(spark, rule, rows, *errors) == want, rule.__name__
        assert rewritten(spark, rule, []) == []


def test_rules_run_in_order_and_close_braces(spark):
    kind = "t string, e array<struct<code:string,line:int,message:string>>"
    text = "```rust\nfn a() {\n}\nfn a() {\n}\nfn open() {\n  if x {\n```\n"
    rows = [(text, [("E0428", 3, "the name `a` is defined multiple times")]), (None, []), ("", None), ("fn a() {", None)]
    got = [r[0] for r in rewrites.apply_rules(spark.createDataFrame(rows, kind), "t", "e").collect()]
    assert got == ["fn a() {\n}\n// truncated 2 lines of incomplete code", None, "", "fn a() {\n} // auto-closed: truncated output"]


def test_limiters_take_one_key_in_parts(spark):
    prepare(spark)
    rng = random.Random(5)
    calls, at = [], 0.0
    for i in range(2500):
        at += rng.choice([0.0, 0.25, 0.5, 1.0, 3.0, 40.0 if i % 500 == 0 else 0.5])
        calls.append(("hot" if i % 7 else "other", i, at))
    rng.shuffle(calls)
    df = spark.createDataFrame(calls, "key string, seq long, at double").repartition(5)
    for most, window in ((3, 2.0),):
        want = {"sliding": set(), "anchored": set()}
        for key in ("hot", "other"):
            rows = sorted((t, i) for k, i, t in calls if k == key)
            times = [t for t, _ in rows]
            for kind, out in (("sliding", limiters.sliding(times, [], most, window)[0]), ("anchored", limiters.anchored(times, (None, 0), most, window)[0])):
                want[kind] |= {(key, i, ok) for (_, i), ok in zip(rows, out, strict=True)}
        for kind in want:
            assert set(map(tuple, limiters.limit(df, kind, most, window).collect())) == want[kind]
            assert limiters.limit(df.limit(0), kind, most, window).collect() == []


def test_folds_emit_in_order(spark):
    from sparkloom.functions.folds import emitting

    step = lambda acc, x: (acc + x, F.when(x % 3 == 0, F.array(acc, x)).otherwise(F.array().cast("array<int>")))
    values = [[], [3], list(range(10)), list(range(1000)), None]
    want = []
    for v in values:
        total, out = 0, []
        for x in v or []:
            out += [total, x] if x % 3 == 0 else []
            total += x
        want.append(None if v is None else out)
    assert column(spark, values, lambda x: emitting(x, F.lit(0), step, "int"), "array<int>") == want


def test_scanners():
    assert scanners.empty_functions("fn a() {} fn b() { todo!() } fn c() { fn d() {} }") == 2
    assert scanners.top_level_parts("a, f(b, c), , [d, e]") == ["a", "f(b, c)", "[d, e]"]


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.c").write_text("int b;")
    (tmp_path / "a.c").write_text("int a;\n")
    (tmp_path / "sub" / "c.c").write_text("int c;")
    (tmp_path / "linked_list.md").write_text("# x\n## C Pattern\n```c\nint x;\n```\n## Rust Equivalent (Vec)\n```rust\nlet x;\n```\n")
    (tmp_path / "half.md").write_text("## C Pattern\n```c\nint x;\n```\n")
    assert sorted(r["name"] for r in texts.read_sources(spark, str(tmp_path)).collect()) == ["a", "b"]
    deep = texts.read_sources(spark, str(tmp_path), recursive=True)
    assert texts.concatenated(deep.withColumn("g", F.lit(1)), ["g"]).first()["text"] == "// === a.c ===\nint a;\n\n// === b.c ===\nint b;\n// === c.c ===\nint c;"
    assert [tuple(r) for r in texts.read_patterns(spark, str(tmp_path)).collect()] == [("linked_list", "int x;", "let x;", ["linked", "list"])]
    assert texts.read_store(spark, str(tmp_path / "none.json"), "a int").collect() == []
    log = spark.createDataFrame([("error", 1), ("llm_call", 2)], "type string, n int")
    texts.append_log(log, str(tmp_path / "log"))
    texts.append_log(log, str(tmp_path / "log"), "full")
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    lines = spark.createDataFrame([("__T__{\"f\": \"x\"}",), ("noise",), ("__T__{bad",)], "line string")
    assert [r["f"] for r in texts.parse_traces(lines, "line", "__T__", "f string").collect()] == ["x"]
    texts.write_run(log, str(tmp_path / "runs"), "r1")
    texts.write_run(log.limit(1), str(tmp_path / "runs"), "r2")
    broken = log.withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    for run in ("r2", "r3"):
        with pytest.raises(Exception, match="lost"):
            texts.write_run(broken, str(tmp_path / "runs"), run)
    seen = {(r["run_id"], r["type"]) for r in texts.read_runs(spark, str(tmp_path / "runs")).collect()}
    assert {x for x in seen if x[0] == "r1"} == {("r1", "error"), ("r1", "llm_call")} and {x[0] for x in seen} == {"r1", "r2"} and len(seen) == 3
    texts.write_run(log, str(tmp_path / "runs"), "r2")
    assert texts.read_runs(spark, str(tmp_path / "runs")).count() == 4 and texts.read_runs(spark, str(tmp_path / "no")) is None
    (tmp_path / "base.json").write_text('{"summary": {"success_rate_pct": 50.5}, "results": [{"name": "a", "state": "Validated"}, {"name": "b"}]}')
    (tmp_path / "bare.json").write_text('{"results": [{"name": "c", "state": "x"}]}')
    base = texts.read_baseline(spark, [str(tmp_path / "base.json"), str(tmp_path / "bare.json")], "name string, state string")
    assert {tuple(r) for r in base.collect()} == {(50.5, 0, "a", "Validated"), (50.5, 1, "b", None), (0.0, 0, "c", "x")}


def test_header_types(spark):
    head = "#ifndef A\n#define A 1\n#define _B\n// no\ntypedef struct {\n  int x;\n\n} T;\nint f(void);\n  enum E { P };\nint (*typedef)(*);\n#endif\n"
    big = "struct S {\n" + "  int a;\n" * 8 + "};\n"
    headers = spark.createDataFrame([("d", "a.h", head), ("d", "big.h", big), ("d", "none.h", "int x;"), ("e", "a.h", "enum F { Q };"), ("d", "null.h", None)], "folder string, name string, text string")
    source = '#include <a.h>\n#include "big.h"\n  #include  "a.h"  \n#include "missing.h"\n#include "none.h"\n#include "big.h"\nint y;'
    df = spark.createDataFrame([("d", 1, source), ("e", 2, source), ("d", 3, ""), ("d", 4, None)], "folder string, id int, src string")
    got = {r["id"]: (r["included"], r["types"]) for r in texts.header_types(df, ["folder"], "id", "src", headers, 12).collect()}
    lines_of_a = "#define A 1\ntypedef struct {\n  int x;\n\n} T;\n  enum E { P };\nint (*typedef)(*);"
    assert got == {1: (["big.h", "none.h"], f"// === From big.h ===\n{big[:-1]}\n\n// === From none.h ===\n"), 2: (["a.h"], "// === From a.h ===\nenum F { Q };")}
    wide = {r["id"]: r["included"] for r in texts.header_types(df, ["folder"], "id", "src", headers, 17).collect()}
    assert wide[1] == ["big.h", "a.h", "none.h"]
    assert texts.header_types(df, ["folder"], "id", "src", headers, 17).filter("id = 1").first()["types"].split("\n\n// === From a.h ===\n")[1].startswith(lines_of_a)


def test_compiler_output_and_headers(spark):
    out = "error[E0499]: cannot `x`\n  --> f.rs:12:5\nerror: expected `;`\n --> f.rs:3:1\nerror: aborting due to 2\n --> f.rs:9:9\n"
    df = spark.createDataFrame([(1, out, '#include "a.h"\n#include "big.h"\n#include "b.h"\n')], "id int, text string, src string")
    assert [tuple(r)[2:] for r in rewrites.parse_errors(df, "text", ["id"]).orderBy("ordinal").collect()] == [("E0499", 12, "cannot `x`"), ("SYNTAX", 3, "expected `;`")]
    assert "&lt;b&gt;" in texts.html_report([{"name": "<b>", "score": 95}])


def test_generators_do_not_depend_on_partitions(spark):
    rows = lambda n: sorted(map(tuple, generators.fuzz_inputs(spark, "stdin", 40).repartition(n).collect()))
    assert rows(1) == rows(7) and len(rows(1)) == 40
    assert pd.Series([r[0] for r in rows(1)]).tolist() == list(range(40))


def test_bad_patterns_match_nothing(spark):
    assert column(spark, ["ab"], lambda x: p.name_filter(x, pattern="(")) == [False]
    assert column(spark, ["ab"], lambda x: p.name_filter(x, names=[])) == [False]


def test_scripting_values(spark):
    import zlib

    from sparkloom.functions import scripting as s

    texts = ["", "abc", "é日x", "a" * 300]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", s.djb2(F.col("t")).alias("h"), s.adler32(F.col("t")).alias("a")).collect()
    for r in rows:
        h = 5381
        for byte in r["t"].encode():
            h = (h * 33 + byte) % 2**32
        assert (r["h"], r["a"]) == (h, zlib.adler32(r["t"].encode()))
    numbers = [0.0, 1.0, -3.0, 2.5, 1 / 3, 123456.789, 0.00012345678, 1234567.25, 1e-7, 1e20, -2.75e-5, 999999.5, 100000.5]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", s.number_text(F.col("x")).alias("n")).collect()
    assert {r["x"]: r["n"] for r in got} == {x: str(int(x)) if x == int(x) and abs(x) < 1e15 else "%g" % x for x in numbers}
    pairs = spark.createDataFrame([("1", "2")], "a string, b string")
    one = pairs.select(s.add(F.col("a"), F.col("b"), True, True).alias("t"), s.add(F.lit(1.5), F.col("b"), False, True).alias("m"), s.add(F.lit(1.5), F.lit(2.0), False, False).alias("n"), s.to_number(F.lit(" -2.5e1x")).alias("v"), s.to_number(F.lit("x")).alias("w")).first()
    assert tuple(one) == ("12", "1.52", 3.5, -25.0, 0.0)


def test_long_literals_and_chains(spark):
    long = 'x = "' + "a\\n" * 400_000 + '"; {'
    df = spark.createDataFrame([(1, long), (2, '"' + "b" * 1_000_000), (3, '{ "}" // }')], "id int, text string")
    got = {r["id"]: r["depth"] for r in ordered.brace_depth(df, "text", "id").collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_order_of_modules_with_a_cycle(spark):
    levels = graph.waves(spark.range(6).toDF("m"), spark.createDataFrame([(0, 1), (2, 3), (3, 2), (3, 4)], "a long, b long"), "m", "a", "b")
    place = {r["m"]: r["place"] for r in graph.in_order(levels, "m").collect()}
    assert sorted(place, key=place.get) == [0, 5, 1, 2, 3, 4]


def test_first_of_equal_lines(spark):
    from sparkloom.operators import sets

    rows = [(1, 0, 0, "use a;"), (1, 0, 1, "use b;"), (1, 1, 0, "use a;"), (2, 0, 0, "use b;"), (2, 0, 1, "use b;")]
    df = spark.createDataFrame(rows, "id int, chunk int, pos int, line string")
    got = sets.ordered_distinct(df, "id", "line", ["chunk", "pos"]).collect()
    assert sorted(map(tuple, got)) == [rows[0], rows[1], rows[3]]
