"""Queries over outlines of sources and answers about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outlines
from .unit_queries import read
from .units import WITH_UNITS, units

c = F.col


def abbreviated_source(spark, sf_dir):
    """C-20: C texts of more than six lines with the bodies of functions elided."""
    return units(spark, sf_dir).select("id", outlines.abbreviated(c("c"), 6).alias("outline"))


_BRACES = lambda mark: f"(length(x) - length(replace(x, '{mark}', '')))"
_ELIDED = f"CASE WHEN b = 1 THEN ['{outlines.ELIDED}'] ELSE []::VARCHAR[] END"
#: Lines one by one: the depth of braces, and whether a body is being left out.
ABBREVIATED_SOURCE = f"""{WITH_UNITS},
    l AS MATERIALIZED (SELECT id, unnest(c_rows) AS x, generate_subscripts(c_rows, 1) AS n FROM texts),
    m AS MATERIALIZED (SELECT *, {_BRACES('{')} AS up, {_BRACES('{')} - {_BRACES('}')} AS change, regexp_matches(trim(x), '^(int|void) main') AS main, regexp_matches(trim(x), '^(#include|#define|typedef|struct |enum |union )') AS kept FROM l),
    scan AS (
        SELECT DISTINCT id, 0::BIGINT AS n, 0::BIGINT AS depth, 0 AS body, []::VARCHAR[] AS out FROM m
        UNION ALL SELECT m.id, m.n, CASE WHEN enters THEN s.depth + change WHEN inside THEN greatest(s.depth + change, 0) ELSE greatest(s.depth + change, 0) END,
            CASE WHEN enters THEN 1 WHEN inside AND s.depth + change <= 0 THEN 0 WHEN inside THEN 2 ELSE b END,
            CASE WHEN inside AND s.depth + change <= 0 THEN list_append({_ELIDED}, '}}') WHEN inside THEN {_ELIDED} ELSE [m.x] END
        FROM scan s JOIN m ON m.id = s.id AND m.n = s.n + 1, LATERAL (SELECT CASE WHEN main THEN 0 ELSE s.body END AS b), LATERAL (SELECT s.depth = 0 AND up > 0 AND NOT main AND NOT kept AS enters), LATERAL (SELECT NOT enters AND b > 0 AND s.depth > 0 AS inside)),
    short AS (SELECT id, array_to_string(flatten(list(out ORDER BY n)), chr(10)) AS t FROM scan GROUP BY id)
    SELECT id, CASE WHEN len(c_rows) <= 6 THEN c ELSE t END AS outline FROM texts LEFT JOIN short USING (id)"""


def fenced_answers(spark, sf_dir):
    """C-16: answers that hold JSON in a tagged fence, in a plain one, bare, cut short, or in a fence left open."""
    k, body = c("p_partkey"), F.concat(F.lit('{"difficulty": "'), c("p_name"), F.lit('", "risks": '), c("p_size").cast("string"), F.lit("}"))
    kinds = [("Here:\n```json\n", "\n```\nBye"), ("Code ```\n", "\n``` end"), ("", "\n"), ("", ""), ("```json\n", "")]
    text = F.concat(F.lit(kinds[4][0]), body)
    for n, (before, behind) in enumerate(kinds[:4]):
        whole = body if n < 3 else F.expr("substring({0}, 1, 14)".format("concat('{\"difficulty\": \"', p_name)"))
        text = F.when(k % 5 == n, F.concat(F.lit(before), whole, F.lit(behind))).otherwise(text)
    rows = read(spark, sf_dir, "part").select(k.alias("id"), text.alias("text"))
    found = rows.select("id", outlines.parsed_json(c("text"), "difficulty string, risks int", ["difficulty", "risks"]).alias("p"))
    return found.select("id", "p.value.difficulty", "p.value.risks", "p.error")


FENCED_ANSWERS = """
    WITH b AS (SELECT p_partkey AS id, '{"difficulty": "' || p_name || '", "risks": ' || p_size || '}' AS body FROM part),
    t AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Bye'
        WHEN 1 THEN 'Code ```' || chr(10) || body || chr(10) || '``` end' WHEN 2 THEN body || chr(10) WHEN 3 THEN body[:14] ELSE '```json' || chr(10) || body END AS text FROM b),
    f AS (SELECT id, text, string_split(text, '```json') AS tagged, string_split(text, '```') AS plain FROM t),
    j AS (SELECT id, trim(CASE WHEN len(tagged) > 1 AND contains(tagged[2], '```') THEN string_split(tagged[2], '```')[1]
        WHEN len(tagged) = 1 AND len(plain) > 2 THEN plain[2] ELSE text END, ' ' || chr(10)) AS j FROM f),
    v AS (SELECT id, j, json_valid(j) AS ok FROM j)
    SELECT id, CASE WHEN ok THEN json_extract_string(j, '$.difficulty') END AS difficulty, CASE WHEN ok THEN json_extract(j, '$.risks')::INT END AS risks,
        CASE WHEN NOT ok THEN 'failed to parse analysis JSON' END AS error FROM v"""


def brief_docs(spark, sf_dir):
    """C-28: a sentence about the first function of each translation that has one."""
    rows = units(spark, sf_dir).filter(c("rust").rlike(r"fn\s+\w+\("))
    return rows.select("id", outlines.brief_of(c("rust"), F.regexp_extract("rust", r"fn\s+(\w+)\(", 1)).alias("brief"))


_HEAD = r"fn\s+\w+\(([^)]*)\)(?:\s*->\s*(\S+))?"
BRIEF_DOCS = rf"""{WITH_UNITS},
    h AS (SELECT id, regexp_extract(rust, 'fn\s+(\w+)\(', 1) AS name, regexp_extract(rust, '{_HEAD}', 1) AS given, regexp_extract(rust, '{_HEAD}', 2) AS gives
        FROM texts WHERE regexp_matches(rust, 'fn\s+\w+\('))
    SELECT id, 'Migrated from C function `' || name || '`' || CASE WHEN given <> '' THEN ' with ' || array_to_string(list_transform(string_split(given, ','), lambda p: trim(split_part(p, ':', 1))), ', ') ELSE '' END
        || CASE WHEN gives NOT IN ('', '()') THEN ', returning `' || gives || '`' ELSE '' END || '.' AS brief FROM h"""

QUERIES = {f.__name__: f for f in (abbreviated_source, fenced_answers, brief_docs)}
ORACLE_SQL = {"abbreviated_source": ABBREVIATED_SOURCE, "fenced_answers": FENCED_ANSWERS, "brief_docs": BRIEF_DOCS}
