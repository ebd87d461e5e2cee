"""Queries over texts and units: scores, rules and text functions. Each names the operators that it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text as t
from .units import WITH_UNITS, d_count, d_has, d_rows, units

c = F.col


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_report(spark, sf_dir):
    """C-04 C-05 A-01 A-02: documents by language and difficulty."""
    docs = read(spark, sf_dir, "documents").select("lang", t.token_estimate(c("text")).alias("tokens"), t.line_count(c("text")).alias("lines"), t.difficulty(c("text")).alias("difficulty"))
    return docs.groupBy("lang", "difficulty").agg(
        F.count(F.lit(1)).alias("units"), F.sum("tokens").alias("tokens"), F.sum("lines").alias("lines"), F.count_if(c("tokens") > 500).alias("large"),
        F.round(F.count_if(c("tokens") > 500) * 100.0 / F.count(F.lit(1)), 4).alias("large_pct"),
    )


D_TOKENS = (
    "CASE WHEN text = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) + len(regexp_extract_all(text, '[^\\p{L}\\p{N}_\\s\\p{Z}]'))"
    f" + len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]')) // 8 + greatest(len({d_rows('text')}) - 1, 0) // 4) END"
)


def d_difficulty(x: str) -> str:
    medium = f"((contains({x}, '*') AND NOT contains({x}, '/*'))::INT + {d_has(x, 'malloc', 'calloc')}::INT + contains({x}, ')(')::INT)"
    hard = f"({d_has(x, 'void *', 'void*', 'goto ', 'union ')} OR (contains({x}, '(*') AND contains({x}, ')(')))"
    n = f"len({d_rows(x)})"
    return f"CASE WHEN {hard} OR ({medium} >= 2 AND {n} > 50) THEN 'hard' WHEN {medium} >= 1 OR {n} > 30 THEN 'medium' ELSE 'easy' END"


UNIT_REPORT = f"""
    WITH d AS (SELECT lang, {D_TOKENS} AS tokens, len({d_rows('text')}) AS lines, {d_difficulty('text')} AS difficulty FROM documents)
    SELECT lang, difficulty, count(*) AS units, sum(tokens) AS tokens, sum(lines) AS lines, count(*) FILTER (WHERE tokens > 500) AS large,
           round(count(*) FILTER (WHERE tokens > 500) * 100.0 / count(*), 4) AS large_pct
    FROM d GROUP BY ALL"""


def unit_difficulty(spark, sf_dir):
    """C-05 over C units, with C-08 types, C-27 input mode and C-25 tags."""
    return units(spark, sf_dir).select("id", t.difficulty(c("c")).alias("difficulty"), t.c_types(c("c")).alias("types"), t.input_mode(c("c")).alias("mode"), t.pattern_tags(c("c")).alias("tags"))


UNIT_DIFFICULTY = f"""{WITH_UNITS}
    SELECT id, {d_difficulty('c')} AS difficulty,
           list_sort(list_distinct(regexp_extract_all(c, '(?:struct|enum|union|typedef\\s+\\w+\\s+)\\s*(\\w+)\\s*[{{;]', 1))) AS types,
           CASE WHEN {d_has('c', 'argc', 'argv')} THEN 'args' WHEN {d_has('c', 'scanf', 'fgets', 'getchar')} THEN 'stdin' ELSE 'none' END AS mode,
           list_sort(list_distinct(list_filter([{', '.join(f"CASE WHEN contains(c, '{k}') THEN '{tag}' END" for k, tag in t.TAG_KEYWORDS)}], lambda x: x IS NOT NULL))) AS tags
    FROM texts"""


def known_calls(spark, sf_dir):
    """J-10 C-07 U-02: distinct calls of each unit to functions that some unit defines."""
    u = units(spark, sf_dir)
    known = u.select(F.explode(t.c_functions(c("c"))).alias("callee")).distinct()
    calls = u.select("id", F.explode(t.c_calls(c("c"))).alias("callee")).distinct()
    return calls.join(known, "callee", "left_semi").select("id", "callee")


_HEAD = t.C_FUNCTION.replace("'", "''")
_NOT = ", ".join(f"'{k}'" for k in t.NOT_FUNCTIONS)
KNOWN_CALLS = f"""{WITH_UNITS},
    known AS (SELECT DISTINCT unnest(regexp_extract_all(c, '{_HEAD}', 1)) AS callee FROM texts),
    calls AS (SELECT DISTINCT id, unnest(regexp_extract_all(c, '\\b(\\w+)\\s*\\(', 1)) AS callee FROM texts)
    SELECT id, callee FROM calls WHERE callee IN (SELECT callee FROM known WHERE callee NOT IN ({_NOT}) AND callee NOT LIKE '\\_%' ESCAPE '\\')"""


def idiom_score(spark, sf_dir):
    """C-01 A-11 C-03: score and hints of each translation; functions without body count as the pattern shows them."""
    empty = F.regexp_count(c("rust"), F.lit(r"fn \w+\([^)]*\)\s*\{\s*(todo!\(\))?\s*\}"))
    return units(spark, sf_dir).select("id", t.idiom_score(c("rust"), c("c"), c("unsafe"), c("warnings"), empty).alias("score"), t.idiom_hints(c("rust")).alias("hints"), t.function_count(c("rust")).alias("functions"))


_TRIMMED = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_FILLED = "len(list_filter({0}, lambda x: " + _TRIMMED.format("x") + " <> ''))"
_FNS = "len(list_filter({0}, lambda x: contains(x, '(') AND regexp_matches(x, '^\\s*(fn|pub fn|pub\\(crate\\) fn) ')))"
_CASTS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w = 'as'))"
_INDEX = f"({d_count('rust', '[i]')} + {d_count('rust', '[j]')} + {d_count('rust', '[idx]')})"
IDIOM_SCORE = f"""{WITH_UNITS},
    f AS (SELECT *, greatest(0, 100 - unsafe * 10 - warnings * 2) AS base, {_FILLED.format('c_rows')} AS cn, {_FILLED.format('r_rows')} AS rn, {_FNS.format('r_rows')} AS fns,
            len(regexp_extract_all(rust, 'fn \\w+\\([^)]*\\)\\s*\\{{\\s*(todo!\\(\\))?\\s*\\}}')) AS hollow, {_CASTS.format('rust')} AS casts, {_INDEX} AS idx,
            {d_count('rust', '.unwrap()')} AS unwraps, {' + '.join(f"least(3, {d_count('rust', s)}) * 2" for s in t.POSITIVE_SIGNS)} AS good FROM texts),
    s AS (SELECT *, CASE WHEN (cn > 20 AND rn < cn // 4) OR (cn <= 20 AND rn < 1) THEN least(base, 15)
            WHEN fns > 3 AND hollow / fns > 0.3 THEN least(base, 20)
            ELSE greatest(0, least(100, base + good - 3 * unwraps - casts - 2 * idx + CASE WHEN cn > 5 AND rn > 0 AND rn < cn THEN 5 ELSE 0 END)) END AS points,
          list_filter([CASE WHEN casts > 5 THEN 'casts:' || casts END, CASE WHEN idx > 5 THEN 'indexing:' || idx END, CASE WHEN unwraps > 2 THEN 'unwraps:' || unwraps END], lambda x: x IS NOT NULL) AS found FROM f)
    SELECT id, points::INT AS score, CASE WHEN len(found) > 0 THEN list_prepend('keep behaviour', found) ELSE found END AS hints, fns AS functions FROM s"""


def predicate_pack(spark, sf_dir):
    """F-01 F-02 F-05..F-22: every decision rule, a row a unit."""
    u = units(spark, sf_dir)
    n_lines = t.line_count(c("c")) * 60
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("Validation", "Tool", "Agent", "NoSourceFiles", "Orchestration", "Io", "BudgetExceeded")]), (c("id") % 7 + 1).cast("int"))
    message = F.concat(F.lit("status "), (c("id") % 10 + 496).cast("string"))
    path = F.element_at(F.array(F.lit("a/b.c"), F.lit("../x.c"), F.lit("/etc/x.c"), F.lit("/tmp/x.c")), (c("id") % 4 + 1).cast("int"))
    after = p.next_state(p.validated(c("compiles"), c("score"), F.lit(60), c("same")), c("state"), c("iteration"))
    return u.select(
        "id",
        (c("state") == "Pending").alias("pending"),
        p.name_filter(c("name"), pattern=r"_\d*7$").alias("named"),
        p.name_filter(c("name"), pattern="(").alias("bad_pattern"),
        p.graduated_state(c("compiles"), c("unsafe"), c("score"), F.lit(70), c("errors")).alias("graduated"),
        p.warm_start(c("state"), c("score"), c("compiles")).alias("warm"),
        p.validated(c("compiles"), c("score"), F.lit(60), c("same")).alias("validated"),
        after["state"].alias("next_state"),
        after["iteration"].alias("next_iteration"),
        p.budget_phase(c("max_calls"), c("calls")).alias("phase"),
        p.over_budget(c("tokens"), c("budget"), c("calls"), c("max_calls")).alias("over"),
        p.adaptive_budget(c("id") % 9, c("max_calls")).cast("long").alias("adaptive"),
        p.repair_iterations(c("iteration"), n_lines, c("id") % 11 == 0).alias("iterations"),
        p.suite_repairs(c("id") % 13, n_lines).cast("long").alias("suite_iterations"),
        p.should_retranslate(c("errors"), c("iteration") % 2).alias("retranslate"),
        p.ensemble_trigger(c("id") % 2 == 0, c("state"), c("iteration"), c("score"), c("errors")).alias("ensemble"),
        p.model_tier(t.difficulty(c("c")), F.when(c("id") % 2 == 0, "analysis").otherwise("repair")).alias("tier"),
        p.error_severity(kinds).alias("severity"),
        p.error_code(kinds).alias("code"),
        t.is_transient(message).alias("transient"),
        p.safe_path(path).alias("safe"),
        p.unsafe_retry(c("unsafe"), c("warnings")).alias("unsafe_gate"),
        t.has_substance(t.filled_lines(c("c")), t.filled_lines(c("rust")), t.function_count(c("rust")), F.lit(1)).alias("substance"),
        p.score_band(c("score")).alias("band"),
    )


PREDICATE_PACK = f"""{WITH_UNITS},
    k AS (SELECT *, len(c_rows) * 60 AS n, (['Validation', 'Tool', 'Agent', 'NoSourceFiles', 'Orchestration', 'Io', 'BudgetExceeded'])[id % 7 + 1] AS kind,
            compiles AND (CASE WHEN same IS NULL THEN score >= 80 ELSE score >= 60 AND same END) AS ok, {d_difficulty('c')} AS diff,
            {_FILLED.format('c_rows')} AS cn, {_FILLED.format('r_rows')} AS rn, {_FNS.format('r_rows')} AS fns FROM texts)
    SELECT id, state = 'Pending' AS pending, regexp_matches(name, '_\\d*7$') AS named, false AS bad_pattern,
        CASE WHEN compiles AND unsafe = 0 AND score >= 70 THEN 'Validated' WHEN compiles AND unsafe > 0 AND score >= 50 THEN 'CompilesUnsafe' WHEN compiles AND score < 70 THEN 'CompilesLowScore'
             WHEN NOT compiles AND errors <= 5 AND score >= 50 THEN 'NearlyCompiles' ELSE 'FallbackUnsafe' END AS graduated,
        CASE WHEN state IN ('Validated', 'CompilesUnsafe') AND score >= 70 THEN 'Skip' WHEN state = 'NearlyCompiles' AND score >= 50 THEN 'SeedRepair' WHEN compiles AND score >= 40 THEN 'SeedRepair' ELSE 'Retranslate' END AS warm,
        ok AS validated,
        CASE WHEN ok THEN 'Validated' WHEN state = 'Repairing' AND iteration >= 5 THEN 'FallbackUnsafe' ELSE 'Repairing' END AS next_state,
        CASE WHEN ok OR (state = 'Repairing' AND iteration >= 5) THEN NULL WHEN state = 'Repairing' THEN iteration + 1 ELSE 1 END AS next_iteration,
        CASE WHEN coalesce(max_calls, 0) = 0 THEN 'Normal' WHEN calls * 100 // max_calls >= 100 THEN 'SaveAndExit' WHEN calls * 100 // max_calls >= 95 THEN 'AssembleNow' WHEN calls * 100 // max_calls >= 80 THEN 'SkipRepairs' ELSE 'Normal' END AS phase,
        (budget IS NOT NULL AND tokens > budget) OR (max_calls IS NOT NULL AND calls > max_calls + max_calls // 5) AS over,
        greatest(id % 9 * 10 + 25, coalesce(max_calls, 0)) AS adaptive,
        CASE WHEN id % 11 = 0 THEN greatest(iteration, 8) WHEN n > 5000 THEN least(iteration, 3) WHEN n > 2000 THEN least(iteration, 2) WHEN n > 1000 THEN least(iteration, 3) ELSE iteration END AS iterations,
        least(10, 5 + id % 13 // 3 + CASE WHEN n > 2000 THEN 2 WHEN n > 1000 THEN 1 ELSE 0 END) AS suite_iterations,
        errors > 100 AND iteration % 2 = 0 AS retranslate,
        id % 2 = 0 AND ((state = 'Repairing' AND iteration >= 2 AND (errors > 0 OR score < 70)) OR state = 'FallbackUnsafe') AS ensemble,
        CASE WHEN diff = 'hard' THEN 'large' WHEN diff = 'medium' OR id % 2 = 0 THEN 'medium' ELSE 'small' END AS tier,
        CASE WHEN kind IN ('Validation', 'Tool') THEN 'Low' WHEN kind IN ('Io', 'BudgetExceeded') THEN 'High' ELSE 'Medium' END AS severity,
        CASE kind WHEN 'NoSourceFiles' THEN 'E_NO_SOURCE' WHEN 'BudgetExceeded' THEN 'E_BUDGET' ELSE 'E_' || upper(kind) END AS code,
        id % 10 + 496 IN (502, 503, 504) AS transient,
        id % 4 IN (0, 3) AS safe,
        CASE WHEN unsafe <= 5 THEN 'keep' WHEN warnings < unsafe THEN 'accept' ELSE 'reject' END AS unsafe_gate,
        NOT ((cn > 20 AND rn < cn // 4) OR (fns > 3 AND 1.0 / fns > 0.3)) AS substance,
        CASE WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'mid' ELSE 'low' END AS band
    FROM k"""


def text_pack(spark, sf_dir):
    """C-09 C-10 C-11 C-12 C-23 R-10: names, signatures and line functions."""
    camel = F.element_at(F.array(*[F.lit(x) for x in ("hash_insert", "cJSON_Parse", "parseValue", "x_y", "main", "HTTPGet2Go", "aB", "readFileNow")]), (c("id") % 8 + 1).cast("int"))
    return units(spark, sf_dir).select(
        "id", t.name_prefix(camel).alias("prefix"), t.snake_case(camel).alias("snake"), t.rust_functions(c("rust")).alias("fns"), t.rust_signatures(c("rust")).alias("signatures"),
        t.unsafe_blocks(c("rust")).alias("unsafe_blocks"), t.crate_name(F.concat((c("id") % 3).cast("string"), camel, F.lit("-x"))).alias("crate"), F.sha2(t.truncated(c("c"), 10), 256).alias("head"),
    )


TEXT_PACK = f"""{WITH_UNITS},
    n AS (SELECT *, (['hash_insert', 'cJSON_Parse', 'parseValue', 'x_y', 'main', 'HTTPGet2Go', 'aB', 'readFileNow'])[id % 8 + 1] AS nm FROM texts)
    SELECT id, (['hash', 'cjson', 'parse', 'x_y', 'main', 'httpget2go', 'ab', 'read'])[id % 8 + 1] AS prefix,
        (['hash_insert', 'c_json_parse', 'parse_value', 'x_y', 'main', 'httpget2_go', 'a_b', 'read_file_now'])[id % 8 + 1] AS snake,
        regexp_extract_all(rust, '{t.RUST_FUNCTION}', 1) AS fns,
        list_transform(list_filter(list_transform(r_rows, lambda x: trim(x)), lambda x: (x LIKE 'pub fn %' OR x LIKE 'fn %') AND contains(x, '(')), lambda x: trim(string_split(x, '{{')[1])) AS signatures,
        len(list_filter(r_rows, lambda x: NOT trim(x) LIKE '//%' AND regexp_matches(x, '\\bunsafe\\s*(\\{{|fn\\b|impl\\b)'))) AS unsafe_blocks,
        '_' || id % 3 || lower(nm) || '_x' AS crate,
        sha256(CASE WHEN len(c_rows) <= 10 THEN c ELSE array_to_string(c_rows[:10], chr(10)) || chr(10) || '// ... (' || (len(c_rows) - 10) || ' more lines)' END) AS head
    FROM n"""


def content_hash_cache(spark, sf_dir):
    """C-14 S-10: documents joined to a cache keyed by the hash of their text; the cache holds what labelled documents gave."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(c("text"), 256).alias("key"))
    cache = read(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("key").agg(F.min("quality").alias("cached"))
    return docs.join(cache, "key", "left").select("doc_id", "key", "cached", c("cached").isNotNull().alias("hit"))


CONTENT_HASH = """
    WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents), k AS (SELECT key, min(quality) AS cached FROM labels JOIN d USING (doc_id) GROUP BY key)
    SELECT doc_id, key, cached, cached IS NOT NULL AS hit FROM d LEFT JOIN k USING (key)"""


def replies(spark, sf_dir):
    """Turns with fences, reviews and routing specs put around their text by turn and conversation."""
    turns = read(spark, sf_dir, "conversations").filter(c("text").isNotNull())
    k = c("conv_id") * 7 + c("turn")
    fence, nl = "```", "\n"
    body = (
        F.when(k % 5 == 0, F.concat(F.lit(f"See:{nl}{fence}rust{nl}fn a() {{}}{nl}"), c("text"), F.lit(f"{nl}{fence}{nl}done")))
        .when(k % 5 == 1, F.concat(F.lit(f"{fence}c{nl}"), c("text"), F.lit(f"{nl}{fence}{nl}{fence}text{nl}more{nl}{fence}")))
        .when(k % 5 == 2, F.concat(F.lit("### Verdict: LIKELY EQUIVALENT\n### Confidence: 87%\n### Summary\n"), c("text")))
        .when(k % 5 == 3, F.concat(F.lit("Verdict: [DIVERGENT]\nConfidence: 250\n"), c("text")))
        .otherwise(F.concat(F.lit("It looks equivalent to me.\n"), c("text")))
    )
    return turns.select("conv_id", "turn", k.alias("k"), body.alias("body"))


REPLIES = """
    replies AS (SELECT conv_id, turn, conv_id * 7 + turn AS k, CASE (conv_id * 7 + turn) % 5
        WHEN 0 THEN 'See:' || chr(10) || '```rust' || chr(10) || 'fn a() {}' || chr(10) || text || chr(10) || '```' || chr(10) || 'done'
        WHEN 1 THEN '```c' || chr(10) || text || chr(10) || '```' || chr(10) || '```text' || chr(10) || 'more' || chr(10) || '```'
        WHEN 2 THEN '### Verdict: LIKELY EQUIVALENT' || chr(10) || '### Confidence: 87%' || chr(10) || '### Summary' || chr(10) || text
        WHEN 3 THEN 'Verdict: [DIVERGENT]' || chr(10) || 'Confidence: 250' || chr(10) || text
        ELSE 'It looks equivalent to me.' || chr(10) || text END AS body FROM conversations WHERE text IS NOT NULL)"""


def fence_extract(spark, sf_dir):
    """C-15 C-18: code out of fences, and texts without fence lines."""
    return replies(spark, sf_dir).select("conv_id", "turn", F.sha2(t.fenced_code(c("body")), 256).alias("code"), F.sha2(t.without_fences(c("body")), 256).alias("bare"))


FENCE_EXTRACT = f"""
    WITH {REPLIES.strip()},
    cut AS (SELECT *, CASE k % 5 WHEN 0 THEN split_part(split_part(body, '```rust', 2), '```', 1) WHEN 1 THEN substr(split_part(body, '```', 2), 3) ELSE body END AS code FROM replies)
    SELECT conv_id, turn, sha256(regexp_replace(code, '^\\s+|\\s+$', '', 'g')) AS code,
           sha256(array_to_string(list_filter({d_rows('body')}, lambda x: NOT ltrim(x) LIKE '```%'), chr(10))) AS bare FROM cut"""


def review_parse(spark, sf_dir):
    """C-17: verdict, confidence and summary of reviews."""
    from ..functions.reviews import confidence, summary, verdict

    return replies(spark, sf_dir).select("conv_id", "turn", verdict(c("body")).alias("verdict"), confidence(c("body")).alias("confidence"), F.sha2(summary(c("body")), 256).alias("summary"))


_FIRST = "regexp_replace(list_filter({0}, lambda x: trim(x) <> '')[1], '^\\s+|\\s+$', '', 'g')"
REVIEW_PARSE = f"""
    WITH {REPLIES.strip()}
    SELECT conv_id, turn, CASE WHEN k % 5 = 2 THEN 'LIKELY EQUIVALENT' WHEN k % 5 = 3 THEN 'DIVERGENT' WHEN contains(upper(body), 'DIVERGENT') THEN 'DIVERGENT'
            WHEN contains(upper(body), 'EQUIVALENT') AND contains(upper(body), 'LIKELY') THEN 'LIKELY EQUIVALENT' WHEN contains(upper(body), 'EQUIVALENT') THEN 'EQUIVALENT' ELSE 'INSUFFICIENT DATA' END AS verdict,
        CASE k % 5 WHEN 2 THEN 87 WHEN 3 THEN 100 ELSE 50 END AS confidence,
        sha256(CASE WHEN k % 5 = 2 THEN {_FIRST.format("string_split(body, chr(10))[4:]")} ELSE list_filter({d_rows('body')}, lambda x: trim(x) <> '' AND NOT x LIKE '#%')[1] END) AS summary
    FROM replies"""


def message_simplify(spark, sf_dir):
    """C-19 C-24: error messages as patterns, and routing specs."""
    u = units(spark, sf_dir)
    message = F.concat(F.lit("the name `"), c("name"), F.lit("` (of type `Vec<u8>`) is defined [twice] at "), c("id").cast("string"), F.lit(".5%"))
    spec = F.element_at(F.array(*[F.lit(x) for x in ("repair:ollama/gemma:26b/0.2/131072", "analysis:remote", "plain", "test_gen:a//x/9", "translation:b/m/0.3")]), (c("id") % 5 + 1).cast("int"))
    return u.select("id", t.simple_message(message).alias("pattern"), t.routing_spec(spec).alias("s")).select("id", "pattern", "s.*")


MESSAGE_SIMPLIFY = f"""{WITH_UNITS}
    SELECT id, 'the name `.+` \\(of type `.+`\\) is defined \\[twice\\] at ' || id || '\\.5%' AS pattern,
        (['repair', 'analysis', NULL, 'test_gen', 'translation'])[id % 5 + 1] AS task, (['ollama', 'remote', NULL, 'a', 'b'])[id % 5 + 1] AS provider,
        (['gemma:26b', NULL, NULL, NULL, 'm'])[id % 5 + 1] AS model, ([0.2, NULL, NULL, NULL, 0.3])[id % 5 + 1] AS temperature, ([131072, NULL, NULL, 9, NULL])[id % 5 + 1] AS num_ctx
    FROM texts"""


def agg_pack(spark, sf_dir):
    """A-01 A-12 A-14 A-15 A-17: progress, signals, checks and token estimates of all units."""
    u = units(spark, sf_dir).withColumn("n", t.token_estimate(c("c"))).withColumn("rows", t.line_count(c("c")))  # once for all sums
    n = c("n")
    iterations = p.repair_iterations(F.lit(5), c("rows"), F.lit(False))
    estimate = n + 500 + (n * 2 + F.floor(n * 3 / 2)) + n * 4 * iterations + n * 3
    failed = c("state").isin("FallbackUnsafe", "CompilesUnsafe", "CompilesLowScore", "NearlyCompiles")
    return u.groupBy((c("id") % 10).alias("batch")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c("state") == "Validated").alias("validated"), F.count_if(failed).alias("failed"),
        (F.count(F.lit(1)) - F.count_if(c("state") == "Validated") - F.count_if(failed)).alias("in_progress"),
        F.sum(t.has(c("c"), "goto ").cast("int") + t.has(c("c"), "union ").cast("int")).alias("hard_signals"),
        F.coalesce(F.bool_and("same"), F.lit(True)).alias("all_same"), F.count_if(c("rust").contains("fn ") & c("rust").contains("unsafe")).alias("unsafe_fns"),
        F.sum(estimate).alias("estimate"), F.count_if(estimate > 4000).alias("warned"),
    )


AGG_PACK = f"""{WITH_UNITS},
    e AS (SELECT *, {D_TOKENS.replace('text', 'c')} AS n FROM texts), f AS (SELECT *, n + 500 + n * 2 + n * 3 // 2 + n * 20 + n * 3 AS est FROM e)
    SELECT id % 10 AS batch, count(*) AS total, count(*) FILTER (WHERE state = 'Validated') AS validated,
        count(*) FILTER (WHERE state IN ('FallbackUnsafe', 'CompilesUnsafe', 'CompilesLowScore', 'NearlyCompiles')) AS failed,
        count(*) FILTER (WHERE state IN ('Pending', 'Repairing')) AS in_progress, sum(contains(c, 'goto ')::INT + contains(c, 'union ')::INT) AS hard_signals,
        coalesce(bool_and(same), true) AS all_same, count(*) FILTER (WHERE contains(rust, 'fn ') AND contains(rust, 'unsafe')) AS unsafe_fns,
        sum(est) AS estimate, count(*) FILTER (WHERE est > 4000) AS warned
    FROM f GROUP BY 1"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (unit_report, unit_difficulty, known_calls, idiom_score, predicate_pack, text_pack, content_hash_cache, fence_extract, review_parse, message_simplify, agg_pack)
}
ORACLE_SQL = {
    "unit_report": UNIT_REPORT, "unit_difficulty": UNIT_DIFFICULTY, "known_calls": KNOWN_CALLS, "idiom_score": IDIOM_SCORE, "predicate_pack": PREDICATE_PACK, "text_pack": TEXT_PACK,
    "content_hash_cache": CONTENT_HASH, "fence_extract": FENCE_EXTRACT, "review_parse": REVIEW_PARSE, "message_simplify": MESSAGE_SIMPLIFY, "agg_pack": AGG_PACK,
}
