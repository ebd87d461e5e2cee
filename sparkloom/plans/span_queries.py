"""Queries over the spans of functions and blocks in programs (see programs.py), and the SQL that takes them apart again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detectors, outlines, reviews
from ..functions import predicates as p
from ..functions import text as t
from ..operators import chunks, graph, joins, sets, spans
from ..operators.ordered import exploded_lines
from ..sources.texts import header_types
from .programs import CONTRACT, PROGRAMS_SQL, headers, modules, parts, programs
from .unit_queries import _TRIMMED, read
from .units import WITH_UNITS, d_has, d_rows, units

c = F.col


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: A token of C, for DuckDB, whose alternatives are those of spans.C_TOKEN.
_TOKEN = r"""(?s)((?m:^)[ \t]*#(?:\\\n|[^\n])*|//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|\w+(?:\s*\()?|\n|[^\S\n]+|[(){};]|[^\w\s"'/#(){};]+|.)"""
#: Statements at depth 0 and those that are functions. A statement ends with its semicolon, its last brace, or a directive's line.
SPANS_OF_PROGRAMS = f"""
    cut AS (SELECT file, string_split(regexp_replace(c, {_quoted(_TOKEN)}, chr(1) || '\\1', 'g'), chr(1))[2:] AS p FROM programs),
    tokens AS (SELECT file, unnest(p) AS token, generate_subscripts(p, 1) AS i FROM cut),
    deep AS (SELECT *, sum(length(token)) OVER w - length(token) AS off, 1 + coalesce(sum(length(token) - length(replace(token, chr(10), ''))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line,
            sum((token = '{{')::INT - (token = '}}')::INT) OVER w AS depth, regexp_matches(token, '^[ \\t]*#') AS directive, regexp_matches(token, '^(\\s|/[/*])') AND NOT regexp_matches(token, '^[ \\t]*#') AS quiet
        FROM tokens WINDOW w AS (PARTITION BY file ORDER BY i)),
    signs AS (SELECT *, lag(token) OVER w AS last, coalesce(sum((depth = 0 AND (token IN (';', '}}') OR directive))::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS item
        FROM deep WHERE NOT quiet WINDOW w AS (PARTITION BY file ORDER BY i)),
    items AS (SELECT file, item, min(off) AS first, max(off + length(token)) AS last_at, min(line) AS first_line, max(line) AS last_line,
            arg_min(regexp_extract(token, '^\\w+'), i) FILTER (WHERE depth = 0 AND regexp_matches(token, '^\\w+\\s*\\($')) AS function, min(i) FILTER (WHERE token = '{{') AS brace, min(off) FILTER (WHERE token = '{{') AS opens,
            arg_min(last, i) FILTER (WHERE token = '{{') AS before FROM signs GROUP BY ALL),
    spans AS (SELECT file, item, (row_number() OVER (PARTITION BY file ORDER BY first))::INT AS body, function, first_line::INT AS first_line, last_line::INT AS last_line, first::INT AS first, opens::INT AS opens, last_at::INT AS last, brace
        FROM items WHERE before = ')' AND function IS NOT NULL),
    edges AS (SELECT DISTINCT s.function AS src, regexp_extract(d.token, '^\\w+') AS dst FROM signs d JOIN spans s USING (file, item) WHERE d.i > s.brace AND regexp_matches(d.token, '^\\w+\\s*\\($')
        AND regexp_extract(d.token, '^\\w+') IN (SELECT function FROM spans) AND regexp_extract(d.token, '^\\w+') <> s.function)"""
SPANS_SQL = f"{PROGRAMS_SQL}, {SPANS_OF_PROGRAMS.strip()}"


def tokens_of(spark, sf_dir):
    return spans.c_tokens(programs(spark, sf_dir), "file", "c")


def function_spans(spark, sf_dir):
    """The span table behind G-01, D-01, F-05 and P-03: functions of C files by running depth of braces over tokens."""
    return spans.c_functions(tokens_of(spark, sf_dir), "file")


FUNCTION_SPANS = f"WITH {SPANS_SQL} SELECT file, body, function, first_line, last_line, first, opens, last FROM spans"


def call_graph(spark, sf_dir):
    """G-01: which function calls which, from the bodies of all files; only functions that the files define."""
    return spans.call_graph(tokens_of(spark, sf_dir), "file", [])


CALL_GRAPH = f"WITH {SPANS_SQL} SELECT src, dst FROM edges"


def module_waves(spark, sf_dir):
    """G-03 J-12: levels of files by the calls between their functions; what cycles hold back comes last."""
    # Texts are taken apart once: what follows, and each wave, starts from names.
    named = spans.named_in_bodies(tokens_of(spark, sf_dir), ["file"]).checkpoint()
    owners = named.filter("defines").select(c("dst").alias("function"), c("file").alias("module")).distinct()
    calls = spans.edges_of(named.groupBy("src", "dst").agg(F.max("defines").alias("defines")), [])
    edges = graph.module_edges(calls, owners).checkpoint()
    return graph.waves(programs(spark, sf_dir).select(c("file").alias("module")), edges, "module", "from_module", "to_module")


MODULE_WAVES = f"""
    WITH RECURSIVE {SPANS_SQL},
    owners AS (SELECT DISTINCT function, file FROM spans),
    e AS MATERIALIZED (SELECT DISTINCT a.file AS f, b.file AS t FROM edges JOIN owners a ON a.function = src JOIN owners b ON b.function = dst WHERE a.file <> b.file),
    w AS (SELECT file AS module, 0 AS wave FROM programs WHERE file NOT IN (SELECT t FROM e) UNION SELECT e.t, w.wave + 1 FROM w JOIN e ON e.f = w.module)
    SELECT module, max(wave) AS wave FROM w GROUP BY module"""


def module_order(spark, sf_dir):
    """G-04: files one by one, none before one that calls it."""
    return graph.in_order(module_waves(spark, sf_dir), "module")


MODULE_ORDER = f"WITH levels AS ({MODULE_WAVES}) SELECT module, row_number() OVER (ORDER BY wave, module) - 1 AS place FROM levels"


def direct_dependencies(spark, sf_dir):
    """G-05: what one function calls."""
    return graph.dependencies_of(call_graph(spark, sf_dir), "src", F.lit("getItem17"))


DIRECT_DEPENDENCIES = f"WITH {SPANS_SQL} SELECT src, dst FROM edges WHERE src = 'getItem17'"


def memory_functions(spark, sf_dir):
    """D-01 U-03: the functions of each file whose body takes or gives back memory, two sets united and sorted."""
    return spans.allocating(tokens_of(spark, sf_dir), "file")


MEMORY_FUNCTIONS = f"""
    WITH {SPANS_SQL}, bodies AS (SELECT s.file, s.function, c[s.opens + 1:s.last] AS body FROM spans s JOIN programs USING (file))
    SELECT file, list_sort(list(DISTINCT function)) AS functions FROM bodies
    WHERE contains(body, 'malloc(') OR contains(body, 'calloc(') OR contains(body, 'realloc(') OR contains(body, 'free(') GROUP BY file"""


def hint_rules(table: str, key: str) -> str:
    """SQL of the hints that a text alone decides, one SELECT for each rule over column c of a table."""
    low, rx = "lower(c)", lambda p: f"regexp_matches(c, '{p}')"
    every = lambda p: f"regexp_extract_all(c, '{p}', 1)"
    orelse = lambda x, y: f"CASE WHEN len({x}) > 0 THEN {x} ELSE ['{y}'] END"
    words = lambda ws, x, suffix="": "list_filter([" + ", ".join(f"CASE WHEN contains({x}, '{w}{suffix}') THEN '{w}' END" for w in ws) + "], lambda w: w IS NOT NULL)"
    parse = "list_distinct(" + every("\\b(parse_\\w+)\\s*\\(") + ")"
    rules = [
        (rx("struct\\s+\\w+\\s*\\*\\s*next\\s*;") + " AND contains(c, '->next')", "data", "CASE WHEN contains(c, '*prev;') OR contains(c, '->prev') THEN 'doubly_linked_list' ELSE 'linked_list' END", orelse(every("(?s)struct\\s+(\\w+)\\s*\\{[^}]*\\*\\s*next\\s*;[^}]*\\}"), "(struct with ->next)")),
        ("(" + d_has("c", "**buckets", "** buckets") + " OR (" + rx("(?i)\\b(hash|djb2|fnv|murmur)\\b") + f" AND contains({low}, 'capacity') AND contains({low}, 'size'))) AND " + d_has("c", "hash", "Hash"), "data", "'hash_table'", orelse(every("struct\\s+(\\w*[Hh]ash\\w*)"), "(hash table structs)")),
        (d_has("c", "*left", "-> left") + " AND " + d_has("c", "*right", "-> right"), "data", "'tree'", orelse(every("(?s)struct\\s+(\\w+)\\s*\\{[^}]*\\*\\s*left\\s*;[^}]*\\*\\s*right\\s*;[^}]*\\}"), "(struct with left/right)")),
        (rx("\\bpush\\s*\\(") + " AND " + rx("\\bpop\\s*\\(") + " AND " + d_has(low, "top", "->sp"), "data", "'stack'", "['pop', 'push']"),
        (d_has(low, "enqueue", "queue_push") + " AND " + d_has(low, "dequeue", "queue_pop"), "data", "'queue'", "['dequeue', 'enqueue']"),
        (f"NOT contains(c, 'qsort(') AND (contains({low}, 'swap') OR contains(c, 'temp =')) AND " + rx("for\\s*\\([^)]*\\)\\s*\\{[^}]*for\\s*\\("), "algorithm", "'sort'", "['(manual sort detected)']"),
        ("contains(c, 'qsort(')", "algorithm", "'sort'", "list_prepend('qsort', " + every("int\\s+(\\w+)\\s*\\(\\s*const\\s+void") + ")"),
        (d_has(low, "low", "left") + " AND " + d_has(low, "high", "right") + " AND (" + rx("\\bmid\\b\\s*=.*[/+].*2") + " OR contains(c, '>> 1'))", "algorithm", "'binary_search'", orelse(every("(?i)\\b(\\w*search\\w*)\\s*\\("), "(binary search pattern)")),
        *[(f"len({words(ws, low)}) > 0", "algorithm", f"'{k}'", words(ws, low)) for k, ws in (("compression", detectors.COMPRESSION), ("checksum", detectors.CHECKSUM), ("crypto", detectors.CRYPTO))],
        ("(" + rx("(?i)\\bSTATE_\\w+") + " OR " + rx("enum\\s+\\w*[Ss]tate\\w*") + ") AND (" + rx("switch\\s*\\(\\s*\\w*->?\\s*state") + " OR " + rx("->?\\s*state\\s*=\\s*STATE_") + ")", "control", "'state_machine'", "[len(list_distinct(" + every("STATE_(\\w+)") + ")) || ' states detected']"),
        (f"len({parse}) >= 3 AND len(list_filter({parse}, lambda f: " + " OR ".join(f"contains(f, '{g}')" for g in detectors.GRAMMAR) + ")) >= 2", "control", "'recursive_descent_parser'", parse),
        (d_has(low, *detectors.EVENTS), "control", "'event_loop'", "['(event dispatch)']"),
        (rx("\\bgoto\\s+\\w+") + " AND " + rx("(?m)^\\w+:\\s*$"), "control", "'goto_cleanup'", "['(goto-based resource cleanup)']"),
        (f"len({words(detectors.STDIO, 'c', '(')}) >= 2", "io", "'file_readwrite'", words(detectors.STDIO, "c", "(")),
        (d_has(low, "buffer", "buf_size") + " AND " + d_has(low, "read(", "recv(") + " AND " + d_has(low, "write(", "send("), "io", "'buffer_management'", "['(buffered I/O)']"),
        (f"contains({low}, 'serialize') OR (contains({low}, 'json') AND " + d_has(low, "parse", "print") + ")", "io", "'serialization'", "['(serialization/deserialization)']"),
        (f"len({words(detectors.MUTEX, 'c')}) > 0", "concurrency", "'mutex'", words(detectors.MUTEX, "c")),
        (d_has("c", "pthread_create", "CreateThread"), "concurrency", "'thread_creation'", words(("pthread_create", "pthread_join", "CreateThread"), "c")),
        (d_has(low, *[a.lower() for a in detectors.ATOMIC]), "concurrency", "'atomic'", "list_filter([" + ", ".join(f"CASE WHEN contains({low}, '{a.lower()}') THEN '{a}' END" for a in detectors.ATOMIC) + "], lambda w: w IS NOT NULL)"),
    ]
    return " UNION ALL ".join(f"SELECT {key}, '{cat}' AS category, {kind} AS kind, list_sort({inv}) AS involved FROM {table} WHERE {when}" for when, cat, kind, inv in rules)


def program_hints(spark, sf_dir):
    """D-01..D-14 on programs: a row for each hint of each file."""
    return hint_rows(programs(spark, sf_dir), "file")


def hint_rows(texts, key):
    rows = detectors.with_memory(texts.select(key, "c"), key, "c").select(key, F.explode("hints").alias("h"))
    return rows.select(key, "h.category", "h.kind", F.array_sort("h.involved").alias("involved"))


#: Hints of `programs`, whatever that is: rules that the text alone decides, and memory by the bodies of functions.
MEMORY_RULE = """SELECT s.file, 'memory' AS category, CASE WHEN contains(any_value(c), 'realloc(') THEN 'resize' WHEN contains(any_value(c), 'malloc(') AND contains(any_value(c), 'free(') THEN 'pairs'
        WHEN contains(any_value(c), 'calloc(') THEN 'zeroed' ELSE 'ownership' END AS kind, list_sort(list(DISTINCT function)) AS involved
    FROM spans s JOIN programs USING (file) WHERE regexp_matches(c[s.opens + 1:s.last], '(malloc|calloc|realloc|free)\\(') GROUP BY s.file"""
PROGRAM_HINTS = f"WITH {SPANS_SQL} {MEMORY_RULE} UNION ALL {hint_rules('programs', 'file')}"


def semantic_hints(spark, sf_dir):
    """D-01..D-14: a row for each hint of each unit."""
    return hint_rows(units(spark, sf_dir), "id")


SEMANTIC_HINTS = f"""{WITH_UNITS}, programs AS (SELECT id AS file, c FROM texts), {SPANS_OF_PROGRAMS.strip()}
    SELECT file AS id, category, kind, involved FROM ({MEMORY_RULE}) UNION ALL {hint_rules('texts', 'id')}"""


def traceable(spark, sf_dir):
    """F-05: each function of the files with its return type and why it cannot be traced, null if it can."""
    rows = function_spans(spark, sf_dir).join(programs(spark, sf_dir).select("file", "c"), "file")
    source = F.substring("c", c("first") + 1, c("last") - c("first"))
    head = F.substring_index(source, "\n", 1)
    before = F.regexp_extract(source, r"(?s)\A(.*?)\w+\s*\(", 1)
    returns = F.regexp_replace(F.regexp_replace(before, r"[\s*]+\z", ""), r"\s+", " ")
    typed = rows.select("file", "function", head.alias("head"), returns.alias("returns"))
    return typed.select("file", "function", "returns", p.not_instrumentable(c("head"), c("returns")).alias("reason"))


def _list(values) -> str:
    return ", ".join(_quoted(v) for v in values)


_TYPE = "CASE WHEN len(w) = 1 THEN w[1] WHEN contains(p, '*') THEN array_to_string(list_filter(list_transform(w[:-2], lambda x: rtrim(x, '*')), lambda x: x <> ''), ' ') || repeat('*', length(p) - length(replace(p, '*', ''))) ELSE array_to_string(w[:-2], ' ') END"
TRACEABLE = f"""
    WITH {SPANS_SQL},
    sources AS (SELECT s.file, s.body, s.function, c[s.first + 1:s.last] AS source FROM spans s JOIN programs USING (file)),
    heads AS (SELECT file, body, function, string_split(source, chr(10))[1] AS head, regexp_replace(regexp_replace(regexp_extract(source, '(?s)^(.*?)\\w+\\s*\\(', 1), '[\\s*]+$', ''), '\\s+', ' ', 'g') AS returns FROM sources),
    inside AS (SELECT *, CASE WHEN contains(head, '(') AND contains(head, ')') THEN regexp_extract(head, '^[^(]*\\((.*)\\)', 1) ELSE '' END AS params FROM heads),
    each AS (SELECT file, body, unnest(string_split(params, ',')) AS p, generate_subscripts(string_split(params, ','), 1) AS n FROM inside WHERE trim(params) NOT IN ('void', '')),
    typed AS (SELECT file, body, n, {_TYPE} AS t FROM (SELECT *, list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '') AS w FROM each) WHERE len(w) > 0),
    faults AS (SELECT file, body, n, CASE WHEN contains(t, 'void*') OR contains(t, 'void *') THEN 'void* parameter: ' || t WHEN starts_with(t, 'struct ') OR starts_with(t, 'union ') THEN 'struct/union parameter: ' || t
        WHEN contains(t, '(*') THEN 'function pointer parameter: ' || t WHEN contains(t, 'FILE') THEN 'FILE parameter: ' || t
        WHEN t IN ({_list(p.SCALAR_TYPES)}) OR t IN ({_list(p.TEXT_TYPES)}) OR (t LIKE '%*' AND regexp_replace(trim(rtrim(t, '*')), '^const ', '') IN ({_list(p.SCALAR_TYPES)})) THEN NULL ELSE 'unsupported parameter type: ' || t END AS fault FROM typed),
    firsts AS (SELECT file, body, arg_min(fault, n) AS fault FROM faults WHERE fault IS NOT NULL GROUP BY ALL)
    SELECT i.file, function, returns, CASE WHEN contains(head, '...') THEN 'variadic function' WHEN fault IS NOT NULL THEN fault
        WHEN returns = 'void' OR returns IN ({_list(p.SCALAR_TYPES)}) OR returns IN ({_list(p.TEXT_TYPES)}) OR returns LIKE '%*' THEN NULL ELSE 'unsupported return type: ' || returns END AS reason
    FROM inside i LEFT JOIN firsts f ON f.file = i.file AND f.body = i.body"""


def missing_counterparts(spark, sf_dir):
    """J-05 C-10: C functions of a file without a counterpart in its Rust text, in lower or snake case, also within blocks."""
    names = function_spans(spark, sf_dir).select("file", c("function").alias("name")).distinct()
    texts = programs(spark, sf_dir)
    heads = texts.select("file", F.explode(t.all_matches(c("rust"), t.RUST_FUNCTION)).alias("name")).select("file", F.lower("name").alias("name"))
    known = heads.union(texts.select("file", F.explode(outlines.heads_in(c("rust"))).alias("name")))
    return joins.missing_counterparts(names, ["file", "name"], F.lower(c("name")), t.snake_case(c("name")), known)


MISSING_COUNTERPARTS = f"""
    WITH {SPANS_SQL}, names AS (SELECT DISTINCT s.file, function AS name, lower(function) AS low, lower(regexp_replace(function, '(.)([A-Z])', '\\1_\\2', 'g')) AS snake, lower(rust) AS rust FROM spans s JOIN programs USING (file))
    SELECT file, name FROM names WHERE NOT contains(rust, 'fn ' || low || '(') AND NOT contains(rust, 'fn ' || snake || '(')
        AND NOT regexp_matches(rust, '(?m)^\\s*(pub\\s+)?(pub\\(crate\\)\\s+)?(async\\s+)?fn\\s+(' || low || '|' || snake || ')\\s*\\(')"""


def error_to_function(spark, sf_dir):
    """J-07: the Rust function around every third line, valid up to the line where the function's braces are even again."""
    texts = programs(spark, sf_dir).select("file", "rust")
    found = spans.rust_functions(texts, "file", "rust")
    points = exploded_lines(texts, "rust", ["file"]).filter("pos % 3 = 0").select("file", (c("pos") + 1).alias("line"))
    return spans.functions_at(points, found, ["file"], "line")


ERROR_TO_FUNCTION = f"""
    WITH {PROGRAMS_SQL},
    l AS (SELECT file, unnest({d_rows('rust')}) AS x, generate_subscripts({d_rows('rust')}, 1) AS line FROM programs),
    s AS (SELECT *, length(x) - length(replace(x, '{{', '')) AS opened, sum((length(x) - length(replace(x, '{{', ''))) - (length(x) - length(replace(x, '}}', '')))) OVER (PARTITION BY file ORDER BY line) AS depth FROM l),
    b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY file ORDER BY line), 0) AS above FROM s),
    h AS (SELECT file, line, above, regexp_extract(x, '^\\s*(?:pub\\s+)?(?:async\\s+)?fn\\s+(\\w+)', 1) AS function FROM b WHERE regexp_matches(x, '^\\s*(pub\\s+)?(async\\s+)?fn\\s+\\w+')),
    o AS (SELECT h.*, (SELECT min(b.line) FROM b WHERE b.file = h.file AND b.line >= h.line AND b.opened > 0) AS brace FROM h),
    f AS (SELECT o.*, coalesce((SELECT min(b.line) FROM b WHERE b.file = o.file AND b.line >= o.brace AND b.depth = o.above), o.line) AS last FROM o)
    SELECT l.file, l.line::INT AS line, CASE WHEN l.line <= f.last THEN f.function END AS function
    FROM (SELECT file, line FROM l WHERE (line - 1) % 3 = 0) l ASOF LEFT JOIN f ON f.file = l.file AND f.line <= l.line"""


def module_assembly(spark, sf_dir):
    """U-07 U-01 A-08: modules of a unit assembled; repeated definitions go with their blocks, a contract's names count as defined."""
    rows = modules(spark, sf_dir)
    contracts = rows.select("unit").distinct().filter("unit % 2 = 1").withColumn("contract", F.lit(CONTRACT))
    return sets.assembled(rows, "unit", "text", contracts).select("unit", F.sha2("text", 256).alias("text"), F.length("text").alias("chars"))


_DEFINED = "regexp_extract(trim(x), '^(?:pub )?(?:struct|enum|const|type) (\\w+)', 1)"
#: Lines of a unit one by one: the names known so far, and the depth of a block that is being left out.
MODULE_ASSEMBLY = f"""
    WITH RECURSIVE {PROGRAMS_SQL},
    raw AS (SELECT unit, module, unnest({d_rows('text')}) AS x, generate_subscripts({d_rows('text')}, 1) AS pos FROM modules),
    l AS MATERIALIZED (SELECT unit, module, x, row_number() OVER (PARTITION BY unit ORDER BY module, pos) AS n, module <> coalesce(lag(module) OVER (PARTITION BY unit ORDER BY module, pos), -1) AS fresh,
            {_DEFINED} AS def, trim(x) LIKE 'use %;' AS is_use, (length(x) - length(replace(x, '{{', ''))) - (length(x) - length(replace(x, '}}', ''))) AS change FROM raw WHERE NOT trim(x) LIKE '```%'),
    scan AS (
        SELECT unit, 0::BIGINT AS n, CASE WHEN unit % 2 = 1 THEN ['Shared1', 'Id2'] ELSE []::VARCHAR[] END AS known, 0::BIGINT AS depth, '' AS kind FROM (SELECT DISTINCT unit FROM l)
        UNION ALL SELECT s.unit, l.n, CASE WHEN NOT skips AND NOT is_use AND def <> '' AND NOT list_contains(known, def) THEN list_append(known, def) ELSE known END,
            CASE WHEN skips THEN greatest(s.depth + change, 0) WHEN NOT is_use AND def <> '' AND list_contains(known, def) THEN greatest(change, 0) ELSE 0 END,
            CASE WHEN skips OR (NOT is_use AND def <> '' AND list_contains(known, def)) THEN 'gone' WHEN is_use THEN 'use' ELSE 'kept' END
        FROM scan s JOIN l ON l.unit = s.unit AND l.n = s.n + 1, LATERAL (SELECT s.depth > 0 AND NOT l.fresh AS skips)),
    judged AS (SELECT l.*, kind FROM l JOIN scan USING (unit, n)),
    u AS (SELECT DISTINCT unit, trim(x) AS line FROM judged WHERE kind = 'use'),
    io AS (SELECT unit, list_distinct(flatten(list(string_split(regexp_extract(line, '\\{{(.*)\\}}', 1), ', ')))) AS names FROM u WHERE line LIKE 'use std::io::{{%' GROUP BY unit),
    merged AS (SELECT unit, 'use std::io::{{' || array_to_string(list_sort(list_transform(names, lambda x: CASE WHEN x = 'self' THEN ' self' ELSE x END)), ', ') || '}};' AS line FROM io UNION ALL SELECT unit, line FROM u WHERE line NOT LIKE '%{{%'),
    uses AS (SELECT unit, string_agg(replace(line, '{{ self', '{{self'), chr(10) ORDER BY line) || chr(10) || chr(10) AS uses FROM merged GROUP BY unit),
    codes AS (SELECT unit, module, regexp_replace(regexp_replace(string_agg(x, chr(10) ORDER BY n), '^(?:[ \\t]*\\n)+', ''), '(?:\\n[ \\t]*)+$', '') AS code FROM judged WHERE kind = 'kept' GROUP BY ALL),
    texts AS (SELECT unit, string_agg('// --- Module: m' || module || ' ---' || chr(10) || code, chr(10) || chr(10) ORDER BY module) AS body FROM codes WHERE trim(code, ' ' || chr(10)) <> '' GROUP BY unit),
    done AS (SELECT s.unit, coalesce(uses, '') || CASE WHEN s.unit % 2 = 1 THEN {_quoted(sets.CONTRACT_HEAD + CONTRACT + sets.CONTRACT_END)} ELSE '' END || coalesce(body, '') || chr(10) AS text
        FROM (SELECT DISTINCT unit FROM modules) s LEFT JOIN uses USING (unit) LEFT JOIN texts USING (unit))
    SELECT unit, sha256(text) AS text, length(text)::INT AS chars FROM done"""


def structural_chunks(spark, sf_dir):
    """P-03 P-01: functions of the data model first, tables of data by themselves, the rest packed to forty lines."""
    out = chunks.structural_chunks(programs(spark, sf_dir).select("file", "c"), "file", "c", 40)
    return out.select("file", "chunk", "is_data", "names", "lines", F.sha2("source", 256).alias("source"))


_MODEL = " OR ".join(f"contains(lower(function), '{p}')" for p in chunks.MODEL_PARTS)
_TYPED = " OR ".join(f"contains(lower(function), '{p}')" for p in chunks.TYPED_PARTS)
STRUCTURAL_CHUNKS = f"""
    WITH RECURSIVE {SPANS_SQL},
    known AS (SELECT file, c, list_distinct(regexp_extract_all(c, '{t.C_TYPE}', 1)) AS types FROM programs),
    f AS (SELECT s.file, body, function, (last_line - first_line + 1)::BIGINT AS n, c[s.first + 1:s.last] AS source,
            len(types) > 0 AND len(string_split(c[s.opens + 1:s.last], chr(10))) < 20 AND ({_MODEL} OR (len(list_filter(types, lambda t: starts_with(lower(function), lower(t)))) > 0 AND ({_TYPED}))) AS model FROM spans s JOIN known USING (file)),
    files AS (SELECT file, coalesce(bool_or(model), false) AS structured, count(function) AS functions FROM programs LEFT JOIN f USING (file) GROUP BY file),
    l AS (SELECT file, unnest({d_rows('c')}) AS x, generate_subscripts({d_rows('c')}, 1) AS line FROM programs),
    z AS (SELECT *, sum((length(x) - length(replace(x, '{{', ''))) - (length(x) - length(replace(x, '}}', '')))) OVER (PARTITION BY file ORDER BY line) AS depth FROM l),
    b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY file ORDER BY line), 0) AS above FROM z),
    starts AS (SELECT file, line, above, trim(x) AS x FROM b WHERE regexp_matches(trim(x), '^(static|const) ') AND contains(x, '[') AND contains(x, '= {{')),
    ends AS (SELECT h.file, h.line, (SELECT min(b.line) FROM b WHERE b.file = h.file AND b.line >= h.line AND b.depth <= h.above) AS last, list_last(string_split(trim(string_split(h.x, '[')[1]), ' ')) AS name FROM starts h),
    d AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line) AS i, name, last - line + 1 AS n, array_to_string(string_split(c, chr(10))[line:last], chr(10)) || chr(10) AS source FROM ends JOIN programs USING (file) WHERE last - line + 1 > 30),
    g AS MATERIALIZED (SELECT f.*, row_number() OVER (PARTITION BY file ORDER BY body) AS i FROM f JOIN files USING (file) WHERE NOT (structured AND model)),
    p AS (SELECT file, i, n AS have, 0 AS chunk FROM g WHERE i = 1
        UNION ALL SELECT g.file, g.i, CASE WHEN p.have + g.n > 40 THEN g.n ELSE p.have + g.n END, p.chunk + (p.have + g.n > 40)::INT FROM p JOIN g ON g.file = p.file AND g.i = p.i + 1),
    members AS (
        SELECT file, 0 AS chunk, false AS is_data, body AS i, function AS name, n, source FROM f JOIN files USING (file) WHERE structured AND model
        UNION ALL SELECT file, 1, true, i, name, n, source FROM d JOIN files USING (file) WHERE structured
        UNION ALL SELECT g.file, p.chunk + structured::INT + (structured AND g.file IN (SELECT file FROM d))::INT, false, g.i, function, g.n, source FROM g JOIN p ON p.file = g.file AND p.i = g.i JOIN files x ON x.file = g.file
        UNION ALL SELECT file, 0, false, 0, NULL, len({d_rows('c')}), NULL FROM files JOIN programs USING (file) WHERE functions = 0)
    SELECT file, chunk, is_data, coalesce(list(name ORDER BY i) FILTER (WHERE name IS NOT NULL), []) AS names, sum(n)::BIGINT AS lines, sha256(coalesce(string_agg(source, chr(10) || chr(10) ORDER BY i), '')) AS source FROM members GROUP BY ALL"""


def source_summary(spark, sf_dir):
    """C-21: sections on typedefs, records, signatures and globals of each C file."""
    found = programs(spark, sf_dir).select("file", outlines.declarations(c("c")).alias("found"))
    return found.select("file", F.sha2(outlines.structural_summary(c("found")), 256).alias("summary"), F.size("found").alias("entries"))


_HEAD = _TRIMMED.format("string_split(y, '{')[1]")
#: Lines one by one: whether a record is open, and the depth of braces.
SOURCE_SUMMARY = f"""
    WITH RECURSIVE {PROGRAMS_SQL},
    r AS (SELECT file, unnest({d_rows('c')}) AS x, generate_subscripts({d_rows('c')}, 1) AS n FROM programs),
    l AS MATERIALIZED (SELECT file, n, {_TRIMMED.format('x')} AS y, (length(x) - length(replace(x, '{{', ''))) - (length(x) - length(replace(x, '}}', ''))) AS change FROM r),
    scan AS (
        SELECT DISTINCT file, 0::BIGINT AS n, false AS open, 0::BIGINT AS depth, '' AS kind, '' AS sign, '' AS y FROM l
        UNION ALL SELECT l.file, l.n, CASE WHEN s.open THEN s.depth + change > 0 WHEN record THEN change > 0 ELSE false END,
            greatest(0, CASE WHEN s.open THEN s.depth + change WHEN record THEN change WHEN starts_with(l.y, 'typedef') THEN s.depth ELSE s.depth + change END),
            CASE WHEN s.open THEN '' WHEN record THEN 'record' WHEN starts_with(l.y, 'typedef') THEN 'typedef' WHEN s.depth = 0 AND NOT starts_with(l.y, '//') AND NOT starts_with(l.y, '#') AND contains(l.y, '=') AND l.y LIKE '%;' AND NOT contains(l.y, '(') THEN 'global' ELSE '' END,
            CASE WHEN NOT s.open AND NOT record AND s.depth = 0 AND NOT regexp_matches(l.y, '^(//|#|typedef|if|while|for)') AND contains(l.y, '(') AND regexp_matches(l.y, '[{{)]$') THEN {_HEAD.replace('y,', 'l.y,')} ELSE '' END, l.y
        FROM scan s JOIN l ON l.file = s.file AND l.n = s.n + 1, LATERAL (SELECT regexp_matches(l.y, '^(struct|enum|union) ') AND contains(l.y, '{{') AS record)),
    parts AS (SELECT file, list(y ORDER BY n) FILTER (WHERE kind = 'typedef') AS ty, list({_HEAD} ORDER BY n) FILTER (WHERE kind = 'record') AS re, list('- `' || sign || '`' ORDER BY n) FILTER (WHERE sign <> '') AS fn, list(y ORDER BY n) FILTER (WHERE kind = 'global') AS gl FROM scan GROUP BY file)
    SELECT file, sha256(CASE WHEN ty IS NULL THEN '' ELSE '**Typedefs (' || len(ty) || '):** ' || array_to_string(ty, '; ') || chr(10) END
        || CASE WHEN re IS NULL THEN '' ELSE '**Structs/Enums (' || len(re) || '):** ' || array_to_string(re, ', ') || chr(10) END
        || CASE WHEN fn IS NULL THEN '' ELSE '**Functions (' || len(fn) || '):**' || chr(10) || array_to_string(fn, chr(10)) || chr(10) END
        || CASE WHEN gl IS NULL THEN '' ELSE '**Globals (' || len(gl) || '):** ' || array_to_string(gl[:10], '; ') || CASE WHEN len(gl) > 10 THEN ' ... and ' || (len(gl) - 10) || ' more' ELSE '' END || chr(10) END) AS summary,
        (coalesce(len(ty), 0) + coalesce(len(re), 0) + coalesce(len(fn), 0) + coalesce(len(gl), 0))::INT AS entries FROM parts"""


def included_types(spark, sf_dir):
    """S-15: type lines of the headers that each file includes, as far as sixty lines take them; later ones are still tried."""
    store, files = headers(spark, sf_dir)
    return header_types(files, ["folder"], "file", "c", store, 60).select("file", "included", F.sha2("types", 256).alias("types"))


_NOISE, _TYPES = "^(#pragma|#ifndef|#define _|#endif|#include|#ifdef|#else|#if )", "^(typedef |struct |enum |#define |extern )"
#: Lines of headers one by one, then includes of files one by one.
INCLUDED_TYPES = f"""
    WITH RECURSIVE {PROGRAMS_SQL},
    r AS (SELECT k, unnest({d_rows('header')}) AS x, generate_subscripts({d_rows('header')}, 1) AS n FROM functions),
    l AS MATERIALIZED (SELECT k, n, x, trim(x) AS y, (length(x) - length(replace(x, '{{', ''))) - (length(x) - length(replace(x, '}}', ''))) AS change FROM r),
    scan AS (
        SELECT DISTINCT k, 0::BIGINT AS n, 0::BIGINT AS depth, false AS kept, '' AS x FROM l
        UNION ALL SELECT l.k, l.n, CASE WHEN take THEN greatest(s.depth + change, 0) ELSE s.depth END, take, l.x FROM scan s JOIN l ON l.k = s.k AND l.n = s.n + 1,
            LATERAL (SELECT NOT regexp_matches(l.y, '{_NOISE}') AND (s.depth > 0 OR regexp_matches(l.y, '{_TYPES}') OR (contains(l.y, 'typedef') AND contains(l.y, '(*)'))) AS take)),
    held AS MATERIALIZED (SELECT k, count(*) FILTER (WHERE kept) AS n, coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (WHERE kept), '') AS t FROM scan GROUP BY k),
    wanted AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY i) AS i, k, n FROM (SELECT DISTINCT file FROM functions), range(0, 9) g(i) JOIN held ON k = file * 12 + CASE WHEN i = 8 THEN 0 ELSE i END),
    fold AS (SELECT DISTINCT file, 0::BIGINT AS i, 0::BIGINT AS total, NULL::BIGINT AS k FROM wanted
        UNION ALL SELECT w.file, w.i, CASE WHEN f.total + w.n <= 60 THEN f.total + w.n ELSE f.total END, CASE WHEN f.total + w.n <= 60 THEN w.k END FROM fold f JOIN wanted w ON w.file = f.file AND w.i = f.i + 1)
    SELECT file, list('h' || k || '.h' ORDER BY i) AS included, sha256(string_agg('// === From h' || k || '.h ===' || chr(10) || t, chr(10) || chr(10) ORDER BY i)) AS types FROM fold JOIN held USING (k) GROUP BY file"""


def ordered_uses(spark, sf_dir):
    """U-04: use lines of each unit where they first stand, over its modules in order."""
    rows = exploded_lines(modules(spark, sf_dir), "text", ["unit", "module"]).withColumn("line", t.strip(c("line"))).filter(c("line").startswith("use "))
    return sets.ordered_distinct(rows, "unit", "line", ["module", "pos"]).select("unit", "module", "pos", "line")


ORDERED_USES = f"""
    WITH {PROGRAMS_SQL}, l AS (SELECT unit, module, trim(unnest({d_rows('text')})) AS line, generate_subscripts({d_rows('text')}, 1) - 1 AS pos FROM modules)
    SELECT unit, module, pos::INT AS pos, line FROM l WHERE starts_with(line, 'use ') QUALIFY row_number() OVER (PARTITION BY unit, line ORDER BY module, pos) = 1"""

#: What stands above a part's C text, by the key.
COMMENTS = ["", "// one\n//// two of @N\n\n", "/* three\n * four\n *\n ** five */\n// six\n", "int before;\n\n/* seven */", "// eight\n/** nine\n*/\n\n"]


def documented_rust(spark, sf_dir):
    """C-28 W-04: Rust functions of each part with the comments of its C function, or a brief of their signature."""
    k = c("k")
    above = F.replace(F.element_at(F.array(*[F.lit(x) for x in COMMENTS]), (k % 5 + 1).cast("int")), F.lit("@N"), c("name"))
    rust = F.concat("rust", F.when(k % 3 == 0, "\n/// known\n\npub fn two(a: i32, b: u8) -> u8 { 1 }\n").otherwise("\npub unsafe fn three() {}"))
    rows = parts(spark, sf_dir, "k").select("k", "name", F.concat(above, "c").alias("c"), rust.alias("rust"))
    found = rows.select("k", "name", "rust", outlines.comments_above(c("c"), c("name")).alias("comments"))
    return found.select("k", "comments", F.sha2(outlines.documented(c("rust"), c("comments"), c("name")), 256).alias("rust"))


_BRIEF = "'/// Migrated from C function `' || name || '`' || CASE WHEN regexp_extract(y, {0}, 1) <> '' THEN ' with ' || array_to_string(list_transform(string_split(regexp_extract(y, {0}, 1), ','), lambda p: trim(split_part(p, ':', 1))), ', ') ELSE '' END || CASE WHEN regexp_extract(y, {0}, 2) NOT IN ('', '()') THEN ', returning `' || regexp_extract(y, {0}, 2) || '`' ELSE '' END || '.'".format(r"'fn\s+\w+\(([^)]*)\)(?:\s*->\s*(\S+))?'")
#: Lines by number: the last one above the function that is neither blank nor a line comment decides.
DOCUMENTED_RUST = f"""
    WITH {PROGRAMS_SQL},
    p AS (SELECT k, name, replace([{_list(COMMENTS)}][k % 5 + 1], '@N', name) || c AS c, rust || CASE WHEN k % 3 = 0 THEN {_quoted(chr(10) + "/// known" + chr(10) * 2 + "pub fn two(a: i32, b: u8) -> u8 { 1 }" + chr(10))} ELSE {_quoted(chr(10) + "pub unsafe fn three() {}")} END AS rust FROM functions),
    l AS (SELECT k, name, trim(unnest({d_rows('c')})) AS y, generate_subscripts({d_rows('c')}, 1) AS n FROM p),
    f AS (SELECT k, min(n) AS n FROM l WHERE contains(y, name) AND contains(y, '(') AND NOT starts_with(y, '//') GROUP BY k),
    s AS (SELECT f.k, f.n, (SELECT max(l.n) FROM l WHERE l.k = f.k AND l.n < f.n AND NOT starts_with(l.y, '//') AND l.y <> '') AS stop FROM f),
    b AS (SELECT s.*, CASE WHEN (SELECT y LIKE '%*/' FROM l WHERE l.k = s.k AND l.n = s.stop) THEN (SELECT coalesce(max(l.n) FILTER (WHERE contains(l.y, '/*')), 1) FROM l WHERE l.k = s.k AND l.n <= s.stop) END AS begin FROM s),
    marks AS (SELECT l.k, 0 AS part, -l.n AS n, trim(regexp_replace(regexp_replace(regexp_replace(y, '^(/\\*)+', ''), '(\\*/)+$', ''), '^\\*+', '')) AS x FROM l JOIN b ON b.k = l.k AND l.n BETWEEN b.begin AND b.stop
        UNION ALL SELECT l.k, 1, l.n, trim(regexp_replace(y, '^(//)+', '')) FROM l JOIN b ON b.k = l.k AND l.n > coalesce(b.stop, 0) AND l.n < b.n WHERE starts_with(y, '//')),
    notes AS (SELECT p.k, coalesce(list(x ORDER BY part, n) FILTER (WHERE part = 1 OR x <> ''), []) AS comments FROM p LEFT JOIN marks ON marks.k = p.k GROUP BY p.k),
    r AS (SELECT k, name, contains(rust, 'unsafe ') AS risky, unnest({d_rows('rust')}) AS x, generate_subscripts({d_rows('rust')}, 1) AS n FROM p),
    h AS (SELECT *, trim(x) AS y, last_value(CASE WHEN trim(x) <> '' THEN starts_with(trim(x), '///') END IGNORE NULLS) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS has FROM r),
    o AS (SELECT h.k, n, CASE WHEN regexp_matches(y, '^(pub )?(unsafe )?fn ') AND NOT coalesce(has, false) THEN CASE WHEN len(comments) > 0 THEN array_to_string(list_transform(comments, lambda c: '/// ' || c), chr(10)) ELSE {_BRIEF} END || chr(10)
        || CASE WHEN risky THEN {_quoted(chr(10).join(outlines.SAFETY_NOTE) + chr(10))} ELSE '' END ELSE '' END || x || chr(10) AS x FROM h JOIN notes ON notes.k = h.k)
    SELECT o.k, any_value(comments) AS comments, sha256(string_agg(x, '' ORDER BY n)) AS rust FROM o JOIN notes ON notes.k = o.k GROUP BY o.k"""


def routing_bands(spark, sf_dir):
    """F-17: models of each file by its lines, by the lines of an interface, and by difficulty, provider and keys."""
    rows = programs(spark, sf_dir).select("file", t.line_count(c("c")).alias("n"), t.difficulty(c("c")).alias("difficulty"))
    k = c("file")
    provider = F.element_at(F.array(F.lit("anthropic"), F.lit("deepseek"), F.lit("ollama")), (k % 3 + 1).cast("int"))
    keys = F.array_compact(F.array(F.when(k % 2 == 0, "anthropic"), F.when(k % 5 < 3, "deepseek")))
    local = F.when(k % 7 == 0, "small-coder")
    return rows.select(
        "file", p.tier_by_lines(c("n") * (k % 30), p.PROJECT_BANDS, provider, local).alias("project"), p.tier_by_lines(c("n"), p.INTERFACE_BANDS, provider, local).alias("interface"),
        p.provider_tier(c("difficulty"), F.when(k % 4 == 0, "analysis").otherwise("repair"), provider, keys).alias("unit"),
    )


def _routing_bands() -> str:
    from .unit_queries import d_difficulty

    bands = lambda n, small, large: f"CASE WHEN file % 7 = 0 THEN 'local:small-coder' WHEN file % 3 = 1 THEN 'chat' WHEN {n} <= {small} THEN 'small' WHEN {n} <= {large} THEN 'medium' ELSE 'large' END"
    two = "CASE WHEN hard = 'hard' THEN 'deepseek:reasoner' ELSE 'deepseek:chat' END"
    return f"""
        WITH {PROGRAMS_SQL}, c_texts AS (SELECT file, c, {d_rows('c')} AS c_rows FROM programs), r AS (SELECT file, len(c_rows) AS n, {d_difficulty('c')} AS hard FROM c_texts)
        SELECT file, {bands('n * (file % 30)', *p.PROJECT_BANDS)} AS project, {bands('n', *p.INTERFACE_BANDS)} AS interface,
            CASE WHEN file % 3 = 2 THEN 'ollama' WHEN file % 3 = 1 AND file % 5 < 3 THEN {two} WHEN file % 2 = 0 THEN 'anthropic:' || CASE WHEN hard = 'hard' THEN 'large' WHEN hard = 'medium' OR file % 4 = 0 THEN 'medium' ELSE 'small' END
                WHEN file % 5 < 3 THEN {two} ELSE 'ollama' END AS unit FROM r"""


def spec_lines(spark, sf_dir):
    """A-15: tests that passed and failed, from the lines of their output."""
    k = c("p_partkey")
    word = lambda i: F.element_at(F.array(*[F.lit(x) for x in ("ok", "FAILED", "ignored", "ok (slow)", "panicked")]), ((k + i * i) % 5 + 1).cast("int"))
    each = F.transform(F.sequence(F.lit(0), (k % 9).cast("int")), lambda i: F.concat(F.when((k + i) % 4 == 0, "spec ").otherwise("test "), F.lit("f"), i.cast("string"), F.lit(" ... "), word(i)))
    rows = read(spark, sf_dir, "part").select(k.alias("id"), reviews.spec_results(F.concat(F.lit("running\n"), F.array_join(each, "\n"), F.lit("\n\ntest result: FAILED\n"))).alias("r"))
    return rows.select("id", "r.passed", "r.failed", "r.failures")


SPEC_LINES = """
    WITH e AS (SELECT p_partkey AS id, i, CASE WHEN (p_partkey + i) % 4 = 0 THEN 'spec ' ELSE 'test ' END || 'f' || i || ' ... ' || (['ok', 'FAILED', 'ignored', 'ok (slow)', 'panicked'])[(p_partkey + i * i) % 5 + 1] AS x FROM part, range(0, 9) t(i) WHERE i <= p_partkey % 9)
    SELECT id, (count(*) FILTER (WHERE contains(x, 'test ') AND contains(x, '... ok')))::INT AS passed, (count(*) FILTER (WHERE contains(x, 'test ') AND contains(x, '... FAILED')))::INT AS failed,
        coalesce(list(x ORDER BY i) FILTER (WHERE contains(x, 'test ') AND contains(x, '... FAILED')), []) AS failures FROM e GROUP BY id"""


QUERIES = {
    f.__name__: f
    for f in (
        function_spans, call_graph, module_waves, module_order, direct_dependencies, memory_functions, traceable, missing_counterparts, error_to_function, module_assembly, structural_chunks, source_summary, program_hints, semantic_hints, included_types, documented_rust, routing_bands, spec_lines, ordered_uses,
    )
}
ORACLE_SQL = {
    "function_spans": FUNCTION_SPANS, "call_graph": CALL_GRAPH, "module_waves": MODULE_WAVES, "module_order": MODULE_ORDER, "direct_dependencies": DIRECT_DEPENDENCIES, "memory_functions": MEMORY_FUNCTIONS, "traceable": TRACEABLE,
    "missing_counterparts": MISSING_COUNTERPARTS, "error_to_function": ERROR_TO_FUNCTION, "module_assembly": MODULE_ASSEMBLY, "structural_chunks": STRUCTURAL_CHUNKS, "source_summary": SOURCE_SUMMARY, "program_hints": PROGRAM_HINTS, "semantic_hints": SEMANTIC_HINTS, "included_types": INCLUDED_TYPES, "documented_rust": DOCUMENTED_RUST, "routing_bands": _routing_bands(), "spec_lines": SPEC_LINES, "ordered_uses": ORDERED_USES,
}
