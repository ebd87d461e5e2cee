"""Queries that join, aggregate and rank results. orders and lineitem stand in for benchmark rows, events for errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import joins, ranking
from ..operators.spread import spread
from .unit_queries import read
from .units import WITH_UNITS, units

c = F.col

STATE = "CASE o_orderkey % 4 WHEN 0 THEN 'Validated' WHEN 1 THEN 'Validated' WHEN 2 THEN 'CompilesUnsafe' ELSE 'FallbackUnsafe' END"
BENCH = f"""
    bench AS (SELECT o_orderkey, 'c' || o_custkey AS name, o_orderkey % 2 AS side, {STATE} AS state,
        CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey * 31 % 101)::INT END AS score, o_orderkey % 3 <> 0 AS compiles, o_orderkey % 3 = 1 AS tests, (o_orderkey % 7)::INT AS calls, (o_orderkey % 5)::INT AS repairs,
        (o_orderkey * 37 % 9000)::BIGINT AS ms FROM orders)"""


def bench(spark, sf_dir):
    """Orders as rows of a benchmark run: an outcome, a score that may be absent, calls, repairs and time."""
    k = c("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k, F.concat(F.lit("c"), c("o_custkey").cast("string")).alias("name"), (k % 2).alias("side"),
        F.when(k % 4 <= 1, "Validated").when(k % 4 == 2, "CompilesUnsafe").otherwise("FallbackUnsafe").alias("state"),
        F.when(k % 5 != 0, k * 31 % 101).cast("int").alias("score"), (k % 3 != 0).alias("compiles"), (k % 3 == 1).alias("tests"),
        (k % 7).cast("int").alias("calls"), (k % 5).cast("int").alias("repairs"), (k * 37 % 9000).alias("ms"),
    )


def bench_totals(spark, sf_dir):
    """A-02 A-04 A-05: rates, means and sums by label and over all, 0 where there is nothing to divide."""
    from ..functions.predicates import status_label

    rate = lambda n: F.round(n / F.nullif(F.count(F.lit(1)), F.lit(0)), 6)
    measures = [
        F.count(F.lit(1)).alias("total"), rate(F.count_if("compiles")).alias("compile_rate"), rate(F.count_if("tests")).alias("pass_rate"),
        F.round(F.coalesce(F.sum("score"), F.lit(0)) / F.count(F.lit(1)), 6).alias("mean_score"), F.sum("calls").alias("calls"), F.sum("repairs").alias("repairs"),
        F.round(F.count_if(c("state") == "Validated") * 100.0 / F.count(F.lit(1)), 6).alias("success_pct"),
    ]
    rows = bench(spark, sf_dir).withColumn("label", status_label(c("compiles"), c("tests")))
    return rows.rollup("label").agg(*measures).withColumn("label", F.coalesce("label", F.lit("ALL")))


BENCH_TOTALS = f"""
    WITH {BENCH.strip()}, l AS (SELECT *, CASE WHEN tests THEN 'PASS' WHEN compiles THEN 'BUILD_OK' ELSE 'FAIL' END AS label FROM bench)
    SELECT coalesce(label, 'ALL') AS label, count(*) AS total, round(count(*) FILTER (WHERE compiles) / count(*), 6) AS compile_rate, round(count(*) FILTER (WHERE tests) / count(*), 6) AS pass_rate,
        round(coalesce(sum(score), 0) / count(*), 6) AS mean_score, sum(calls) AS calls, sum(repairs) AS repairs, round(count(*) FILTER (WHERE state = 'Validated') * 100.0 / count(*), 6) AS success_pct
    FROM l GROUP BY ROLLUP (label)"""


def compare_baselines(spark, sf_dir):
    """J-01 U-01 A-03: the comparison's rows."""
    b = bench(spark, sf_dir)
    return joins.compare_results(b.filter("side = 0"), b.filter("side = 1"), "name", "o_orderkey", ["state", "score"])


COMPARE_BASELINES = f"""
    WITH {BENCH.strip()}, names AS (SELECT name FROM bench WHERE side = 0 UNION ALL SELECT DISTINCT name FROM bench WHERE side = 1 AND name NOT IN (SELECT name FROM bench WHERE side = 0)),
    f AS (SELECT name, side, arg_min(state, o_orderkey) AS state, arg_min({{'s': score}}, o_orderkey).s AS score FROM bench GROUP BY name, side)
    SELECT n.name, a.state AS a_state, a.score AS a_score, b.state AS b_state, b.score AS b_score
    FROM names n LEFT JOIN f a ON a.name = n.name AND a.side = 0 LEFT JOIN f b ON b.name = n.name AND b.side = 1"""


def compare_summary(spark, sf_dir):
    """A-03: averages over the comparison's rows; an absent score counts as 0."""
    rows = compare_baselines(spark, sf_dir)
    side = lambda s: [
        F.count(f"{s}_state").alias(f"{s}_count"), F.count_if(c(f"{s}_state") == "Validated").alias(f"{s}_pass"),
        F.round(F.sum(F.when(c(f"{s}_state").isNotNull(), F.coalesce(c(f"{s}_score"), F.lit(0)))) / F.nullif(F.count(f"{s}_state"), F.lit(0)), 6).alias(f"{s}_mean"),
    ]
    return rows.agg(*side("a"), *side("b"))


COMPARE_SUMMARY = f"""
    WITH rows AS ({COMPARE_BASELINES.strip()})
    SELECT count(a_state) AS a_count, count(*) FILTER (WHERE a_state = 'Validated') AS a_pass, round(sum(coalesce(a_score, 0)) FILTER (WHERE a_state IS NOT NULL) / count(a_state), 6) AS a_mean,
        count(b_state) AS b_count, count(*) FILTER (WHERE b_state = 'Validated') AS b_pass, round(sum(coalesce(b_score, 0)) FILTER (WHERE b_state IS NOT NULL) / count(b_state), 6) AS b_mean FROM rows"""


def regressions(spark, sf_dir):
    """J-02."""
    b = bench(spark, sf_dir)
    return joins.regressions(b.filter("side = 0"), b.filter("side = 1"), "name", "state", "o_orderkey")


REGRESSIONS = f"""
    WITH {BENCH.strip()}, now AS (SELECT name, arg_min(state, o_orderkey) AS s FROM bench WHERE side = 1 GROUP BY name)
    SELECT b.name, b.state AS was, n.s AS "is" FROM bench b JOIN now n USING (name) WHERE b.side = 0 AND b.state = 'Validated' AND n.s <> 'Validated'"""


def project_match(spark, sf_dir):
    """J-03 F-03: names with dashes matched exactly, else with underscores; the first 50 of those that hold a 7."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("lib-p-"), c("p_partkey").cast("string")).alias("name"))
    right = read(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(
        F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("lib-p-"), c("p_partkey").cast("string"))).otherwise(F.concat(F.lit("lib_p_"), c("p_partkey").cast("string"))).alias("name"), (c("p_partkey") * 10).alias("target")
    )
    return joins.match_with_fallback(part.filter(c("name").contains("7")), right, "name", "target").orderBy("name").limit(50)


PROJECT_MATCH = """
    WITH l AS (SELECT p_partkey, 'lib-p-' || p_partkey AS name FROM part),
    r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'lib-p-' ELSE 'lib_p_' END || p_partkey AS name, p_partkey * 10 AS target FROM part WHERE p_partkey % 3 <> 0)
    SELECT l.p_partkey, l.name, coalesce(x.target, u.target) AS target FROM l LEFT JOIN r x ON x.name = l.name LEFT JOIN r u ON u.name = replace(l.name, '-', '_')
    WHERE contains(l.name, '7') AND coalesce(x.target, u.target) IS NOT NULL ORDER BY l.name LIMIT 50"""


def unmigrated(spark, sf_dir):
    """J-04: documents without a good label."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels")
    return joins.not_migrated(docs, labels.select("doc_id", (c("quality") == 1).alias("done")), "doc_id", "done")


UNMIGRATED = "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)"


def cost_rollup(spark, sf_dir):
    """A-16: cost by provider from a price table, default prices where there is none."""
    prices = spark.createDataFrame([("p0", 3.0, 15.0), ("p1", 0.14, 0.28), ("p2", 0.0, 0.0)], "provider string, price_in double, price_out double")
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("p"), (c("doc_id") % 4).cast("string")).alias("provider"), t.token_estimate(c("text")).alias("tokens"), "n_chars")
    priced = rows.join(F.broadcast(prices), "provider", "left").fillna({"price_in": 3.0, "price_out": 15.0})
    cost = c("tokens") / 1e6 * c("price_in") + c("n_chars") / 1e6 * c("price_out")
    return priced.groupBy("provider").agg(F.count(F.lit(1)).alias("units"), F.sum("tokens").alias("tokens"), F.round(F.sum(cost), 6).alias("cost_usd"))


def _cost_rollup() -> str:
    from .unit_queries import D_TOKENS

    return f"""
        WITH r AS (SELECT 'p' || doc_id % 4 AS provider, {D_TOKENS} AS tokens, n_chars FROM documents)
        SELECT provider, count(*) AS units, sum(tokens) AS tokens,
            round(sum(tokens / 1e6 * CASE provider WHEN 'p1' THEN 0.14 WHEN 'p2' THEN 0 ELSE 3 END + n_chars / 1e6 * CASE provider WHEN 'p1' THEN 0.28 WHEN 'p2' THEN 0 ELSE 15 END), 6) AS cost_usd
        FROM r GROUP BY provider"""


ERRORS = """
    errors AS (SELECT event_id, event_type AS code, user_id, (event_id * 29 % 400)::INT AS line, event_id % 2 AS run,
        CASE event_id % 4 WHEN 0 THEN 'name `x' || event_id % 7 || '` is defined multiple times' WHEN 1 THEN 'mismatched types' WHEN 2 THEN 'cannot borrow (mut)' ELSE 'no method named `m`' END AS message FROM events)"""


def errors(spark, sf_dir):
    """Events as compiler errors of two runs."""
    k = c("event_id")
    message = F.when(k % 4 == 0, F.concat(F.lit("name `x"), (k % 7).cast("string"), F.lit("` is defined multiple times"))).when(k % 4 == 1, "mismatched types").when(k % 4 == 2, "cannot borrow (mut)").otherwise("no method named `m`")
    return read(spark, sf_dir, "events").select("event_id", c("event_type").alias("code"), "user_id", (k * 29 % 400).cast("int").alias("line"), (k % 2).alias("run"), message.alias("message"))


def fixed_errors(spark, sf_dir):
    """J-06 U-05: errors of the first run without one of their code within 5 lines in the second, by user."""
    e = errors(spark, sf_dir)
    return joins.fixed_errors(e.filter("run = 0").select("event_id", "code", "user_id", "line"), e.filter("run = 1"), ["user_id", "code"], "line")


FIXED_ERRORS = f"""
    WITH {ERRORS.strip()}
    SELECT event_id, code, user_id, line FROM errors a WHERE run = 0
        AND NOT EXISTS (SELECT 1 FROM errors b WHERE b.run = 1 AND b.user_id = a.user_id AND b.code = a.code AND abs(a.line - b.line) <= 5)"""


def nearest_start(spark, sf_dir):
    """J-07's join alone: each event with the last starting event of its user before it, valid within 3000 lines of it."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (c("event_id") % 9 == 0).alias("starts"))
    out = joins.enclosing(e, ["user_id"], "event_id", c("starts"), "event_id")
    return out.filter(~c("starts")).select("user_id", "event_id", F.when(c("event_id") - c("enclosing") <= 3000, c("enclosing")).alias("enclosing"))


NEAREST_START = """
    WITH s AS (SELECT user_id, event_id FROM events WHERE event_id % 9 = 0)
    SELECT e.user_id, e.event_id, CASE WHEN e.event_id - s.event_id <= 3000 THEN s.event_id END AS enclosing
    FROM (SELECT user_id, event_id FROM events WHERE event_id % 9 <> 0) e ASOF LEFT JOIN s ON s.user_id = e.user_id AND s.event_id <= e.event_id"""

PATTERNS = [("click", "defined multiple", 3, 1), ("click", "borrow (", 5, 0), ("click", "mis.*types", 2, 2), ("view", "^no method", 1, 3), ("view", "types", 4, 0), ("purchase", "name `x[0-3]`", 7, 1), ("purchase", "x", 0, 0), ("signup", ".", 2, 1), ("click", "multiple", 3, 0)]


def pattern_matches(spark, sf_dir):
    """J-08 F-04 R-08: every reliable pattern that an error's message holds or matches."""
    return joins.match_patterns(errors(spark, sf_dir), PATTERNS, "code", "message").select("event_id", "ordinal", "successes")


_RELIABLE = ", ".join(f"({i}, '{k}', '{p}', {g})" for i, (k, p, g, b) in enumerate(PATTERNS) if g and (not b or g / (g + b) >= 0.5) and p != "borrow (")
PATTERN_MATCHES = f"""
    WITH {ERRORS.strip()}, p(ordinal, code, pat, successes) AS (VALUES {_RELIABLE})
    SELECT event_id, ordinal, successes FROM errors JOIN p USING (code) WHERE contains(message, pat) OR regexp_matches(message, pat)
    UNION ALL SELECT event_id, 1, 5 FROM errors WHERE code = 'click' AND contains(message, 'borrow (')"""


def top_pattern(spark, sf_dir):
    """J-09: the best pattern of each user's first five errors."""
    from pyspark.sql import Window

    e = errors(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("n <= 5")
    return joins.best_match(joins.match_patterns(e, PATTERNS, "code", "message"), ["event_id"]).select("user_id", "event_id", "ordinal")


TOP_PATTERN = f"""
    WITH {ERRORS.strip()}, m AS ({PATTERN_MATCHES.replace(f"WITH {ERRORS.strip()}, p(", "WITH p(")}),
    f AS (SELECT user_id, event_id FROM errors QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5)
    SELECT user_id, event_id, ordinal FROM f JOIN m USING (event_id) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY successes DESC, ordinal) = 1"""


CANDIDATES = """
    cand AS (SELECT l_orderkey AS unit, l_linenumber AS ordinal, l_partkey % 4 <> 0 AS compiles, (l_partkey * 7 % 50)::INT AS score, (l_suppkey % 3)::INT AS unsafe, l_quantity AS cost,
        CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE (l_partkey % 4)::INT END AS specs_passed, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE (l_suppkey % 2 * 4)::INT END AS specs_total,
        l_partkey, l_suppkey FROM lineitem)"""


def candidates(spark, sf_dir):
    """Line items as candidates of their order."""
    k, s = c("l_partkey"), c("l_suppkey")
    return read(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("unit"), c("l_linenumber").alias("ordinal"), (k % 4 != 0).alias("compiles"), (k * 7 % 50).cast("int").alias("score"), (s % 3).cast("int").alias("unsafe"), c("l_quantity").alias("cost"),
        F.when(k % 3 != 0, k % 4).cast("int").alias("specs_passed"), F.when(k % 3 != 0, s % 2 * 4).cast("int").alias("specs_total"), "l_partkey", "l_suppkey",
    )


def best_candidate(spark, sf_dir):
    """R-04."""
    return ranking.best_candidate(candidates(spark, sf_dir), "unit").select("unit", "ordinal", "score")


BEST_CANDIDATE = f"""
    WITH {CANDIDATES.strip()}, r AS (SELECT *, CASE WHEN specs_total > 0 THEN specs_passed / specs_total ELSE 0.5 END AS ratio, bool_or(compiles) OVER (PARTITION BY unit) AS any_ok FROM cand)
    SELECT unit, ordinal, score FROM r WHERE compiles OR NOT any_ok
    QUALIFY row_number() OVER (PARTITION BY unit ORDER BY CASE WHEN any_ok THEN ratio END DESC, score DESC, CASE WHEN any_ok THEN unsafe END, CASE WHEN any_ok THEN ordinal ELSE -ordinal END) = 1"""


def tournament(spark, sf_dir):
    """R-06."""
    return ranking.tournament(candidates(spark, sf_dir), "unit").select("unit", "ordinal", "score")


TOURNAMENT = f"""
    WITH {CANDIDATES.strip()} SELECT unit, ordinal, score FROM cand
    QUALIFY row_number() OVER (PARTITION BY unit ORDER BY compiles DESC, score DESC, unsafe, cost, ordinal) = 1"""


def first_ok(spark, sf_dir):
    """R-05."""
    return ranking.first_that_compiles(candidates(spark, sf_dir), "unit").select("unit", "ordinal", "compiles")


FIRST_OK = f"""
    WITH {CANDIDATES.strip()} SELECT unit, coalesce(min(ordinal) FILTER (WHERE compiles), min(ordinal)) AS ordinal, bool_or(compiles) AS compiles FROM cand GROUP BY unit"""


def keep_max_upsert(spark, sf_dir):
    """A-10 R-03: the best line of each part, and the 1000 best of those."""
    rows = candidates(spark, sf_dir).withColumn("arrival", c("unit") * 10 + c("ordinal")).withColumn("score", (c("unit") * 17 % 97).cast("int"))
    return ranking.keep_capacity(ranking.keep_best(rows, "l_partkey", "score", "arrival"), "score", "arrival", "l_partkey", 1000).select("l_partkey", "arrival", "score")


KEEP_MAX = f"""
    WITH {CANDIDATES.strip()}, r AS (SELECT l_partkey, unit * 10 + ordinal AS arrival, (unit * 17 % 97)::INT AS score FROM cand),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, arrival) = 1)
    SELECT l_partkey, arrival, score FROM b ORDER BY score DESC, arrival, l_partkey LIMIT 1000"""


def merge_sum_upsert(spark, sf_dir):
    """A-09: counters added up by key."""
    rows = candidates(spark, sf_dir).select("l_partkey", c("unsafe").alias("kind"), c("compiles").cast("int").alias("good"), (~c("compiles")).cast("int").alias("bad"))
    return ranking.merge_counts(rows, ["l_partkey", "kind"], ["good", "bad"])


MERGE_SUM = f"WITH {CANDIDATES.strip()} SELECT l_partkey, unsafe AS kind, sum(compiles::INT) AS good, sum((NOT compiles)::INT) AS bad FROM cand GROUP BY 1, 2"


def order_pack(spark, sf_dir):
    """R-07 R-09 W-08: a winner that replaces, order by a dependency list, and what a wave has seen of earlier ones."""
    from ..functions.predicates import ensemble_replaces
    from ..operators.ordered import earlier_waves

    rows = candidates(spark, sf_dir)
    place = F.coalesce(F.when(c("ordinal") <= 4, F.lit(5) - c("ordinal")), F.lit(2**31 - 1))
    seen = earlier_waves(rows.withColumn("wave", (c("ordinal") / 2).cast("int")), "unit", "wave", "ordinal")
    return seen.select("unit", "ordinal", "wave", "seen", ensemble_replaces(c("compiles"), c("l_suppkey") % 2 == 0, c("score"), c("specs_passed") * 10).alias("replaces"), place.alias("place"))


ORDER_PACK = f"""
    WITH {CANDIDATES.strip()}, r AS (SELECT *, ordinal // 2 AS wave FROM cand)
    SELECT unit, ordinal, wave::INT AS wave, coalesce((SELECT list(x.ordinal ORDER BY x.ordinal) FROM r x WHERE x.unit = r.unit AND x.wave < r.wave), []) AS seen,
        (compiles AND NOT l_suppkey % 2 = 0) OR score > coalesce(specs_passed * 10, 0) AS replaces, CASE WHEN ordinal <= 4 THEN 5 - ordinal ELSE 2147483647 END AS place FROM r"""


def pattern_relevance(spark, sf_dir):
    """R-01 J-11 C-25: the three benchmark items of most relevance for each document."""
    # Dealt by document, so that neither words nor scores are shuffled again.
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", rows=1000).filter(c("text").isNotNull())
    items = read(spark, sf_dir, "benchmark").select(
        c("item_id").cast("int").alias("ordinal"), F.array(F.lit("en"), F.substring("text", 3, 4), F.lit("QU")).alias("tags"), c("text").alias("c_pattern"), (c("item_id") % 3).alias("usage")
    )
    return ranking.relevant_patterns(docs, items, "text", "doc_id", 3)


PATTERN_RELEVANCE = """
    WITH d AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL),
    dw AS (SELECT doc_id, low, list_distinct(list_filter(list_concat(regexp_split_to_array(low, '[\\s\\p{Z}]+'), regexp_split_to_array(low, '[^\\p{L}\\p{N}]')), lambda w: strlen(w) >= 2)) AS w FROM d),
    p AS (SELECT item_id, lower(text) AS low, ['en', lower(substr(text, 3, 4)), 'qu'] AS tags, item_id % 3 AS usage FROM benchmark),
    pw AS (SELECT *, list_distinct(list_filter(list_concat(regexp_split_to_array(low, '[\\s\\p{Z}]+'), regexp_split_to_array(low, '[^\\p{L}\\p{N}]')), lambda w: strlen(w) >= 2)) AS w FROM p),
    s AS (SELECT doc_id, item_id::INT AS ordinal, (10 * len(list_filter(tags, lambda x: contains(dw.low, x))) + len(list_intersect(dw.w, pw.w)) + usage)::INT AS score FROM dw, pw)
    SELECT doc_id, ordinal, score, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal))::INT AS rank FROM s QUALIFY rank <= 3"""


def signatures(spark, sf_dir):
    kinds = ["int", "void", "char *", "double", "const char *", "size_t", "unsigned int", "struct Node *"]
    k = c("p_partkey")
    pick = lambda x: F.element_at(F.array(*[F.lit(v) for v in kinds]), (x % 8 + 1).cast("int"))
    params = F.when(k % 5 == 0, F.lit("void")).when(k % 5 == 1, F.concat(pick(F.floor(k / 3)), F.lit(" a"))).otherwise(F.concat(pick(F.floor(k / 3)), F.lit(" a ,  "), pick(F.floor(k / 11)), F.lit(" b")))
    sig = F.concat(pick(k), F.lit("  f"), k.cast("string"), F.lit(" ( "), params, F.lit(" )"))
    return read(spark, sf_dir, "part").select(k.alias("ordinal"), sig.alias("sig"), (k * 13 % 101).cast("int").alias("quality"))


def signature_similarity(spark, sf_dir):
    """R-02 C-13: the three signatures of all most like each; types lose their last word as stored ones do."""
    s = signatures(spark, sf_dir).withColumn("normal", t.normal_signature(c("sig")))
    s = s.select(c("ordinal").cast("int").alias("ordinal"), t.return_type(c("normal")).alias("returns"), t.param_types(c("normal")).alias("params"), "quality", t.signature_hash(c("sig")).alias("hash"))
    return ranking.similar_signatures(s.select(c("ordinal").alias("query"), "returns", "params"), s, "query", 3)


_KINDS = "['int', 'void', 'char *', 'double', 'const char *', 'size_t', 'unsigned int', 'struct Node *']"
#: "(void a)" is "(void)" without names, thus without parameters. What a parameter of each kind becomes: its name goes first, then the last word of what is left, if there are two.
SIGNATURE_SIMILARITY = f"""
    WITH s AS (SELECT p_partkey::INT AS ordinal, {_KINDS}[p_partkey % 8 + 1] AS returns, (p_partkey * 13 % 101)::INT AS quality,
        CASE p_partkey % 5 WHEN 0 THEN [] WHEN 1 THEN CASE WHEN p_partkey // 3 % 8 <> 1 THEN [p_partkey // 3 % 8] ELSE [] END ELSE [p_partkey // 3 % 8, p_partkey // 11 % 8] END AS kinds FROM part),
    n AS (SELECT *, list_transform(kinds, lambda i: (['int', 'void', 'char *', 'double', 'const char *', 'size_t', 'unsigned', 'struct Node *'])[i + 1]) AS named FROM s),
    p AS (SELECT *, list_transform(named, lambda v: CASE WHEN v LIKE '% *' THEN v[:-3] ELSE v END) AS params FROM n),
    q AS (SELECT * FROM p), st AS (SELECT * FROM p),
    x AS (SELECT q.ordinal AS query, st.ordinal, (CASE WHEN q.returns = st.returns THEN 10 ELSE 0 END + CASE WHEN len(q.params) = len(st.params) THEN 5 ELSE 0 END
        + 3 * len(list_filter(q.params, lambda v: list_contains(st.params, v))) + st.quality // 10)::INT AS score FROM q, st)
    SELECT query, ordinal, score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, ordinal))::INT AS rank FROM x QUALIFY rank <= 3"""


def zip_compare(spark, sf_dir):
    """J-13 C-26: turns of one conversation compared line by line with the next turn, numbers within 0.5."""
    turns = read(spark, sf_dir, "conversations").filter(c("text").isNotNull()).select("conv_id", "turn", "text")
    noisy = lambda at: F.concat(F.lit("x\n1.0\n"), F.when(at % 3 == 0, "nan").when(at % 3 == 1, "1.25").otherwise("7"), F.lit("\n"), F.when(at % 5 == 0, F.lit("more\nlines")).otherwise(F.lit("end")))
    a, b = turns.select("conv_id", "turn", t.lines(noisy(c("turn"))).alias("la")), turns.select("conv_id", (c("turn") - 1).alias("turn"), t.lines(noisy(c("turn"))).alias("lb"))
    pairs = F.zip_with("la", "lb", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    same = F.forall(pairs, lambda z: F.coalesce(t.lines_match(z["x"], z["y"], 0.5), F.lit(False)))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", ((F.size("la") == F.size("lb")) & same).alias("same"))


ZIP_COMPARE = """
    WITH t AS (SELECT conv_id, turn, turn % 3 AS v, turn % 5 = 0 AS more FROM conversations WHERE text IS NOT NULL)
    SELECT a.conv_id, a.turn, a.more = b.more AND (a.v = b.v OR a.v = 0 OR b.v = 0) AS same FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""

QUERIES = {
    f.__name__: f
    for f in (
        bench_totals, compare_baselines, compare_summary, regressions, project_match, unmigrated, cost_rollup, fixed_errors, nearest_start, pattern_matches, top_pattern,
        best_candidate, tournament, first_ok, keep_max_upsert, merge_sum_upsert, order_pack, pattern_relevance, signature_similarity, zip_compare,
    )
}
ORACLE_SQL = {
    "bench_totals": BENCH_TOTALS, "compare_baselines": COMPARE_BASELINES, "compare_summary": COMPARE_SUMMARY, "regressions": REGRESSIONS, "project_match": PROJECT_MATCH, "unmigrated": UNMIGRATED,
    "cost_rollup": _cost_rollup(), "fixed_errors": FIXED_ERRORS, "nearest_start": NEAREST_START, "pattern_matches": PATTERN_MATCHES, "top_pattern": TOP_PATTERN,
    "best_candidate": BEST_CANDIDATE, "tournament": TOURNAMENT, "first_ok": FIRST_OK, "keep_max_upsert": KEEP_MAX, "merge_sum_upsert": MERGE_SUM, "order_pack": ORDER_PACK,
    "pattern_relevance": PATTERN_RELEVANCE, "signature_similarity": SIGNATURE_SIMILARITY, "zip_compare": ZIP_COMPARE,
}
