"""One query for each operator of this package, over the whole of its table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_forest, decontam, divergence, line_dedup, mixing, ngram_join, pii_crf, rans, sharding, substring_dedup, token_count, toxicity, yinyang

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduped_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return rans.packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.pii_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaked_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, num=90, den=100)


def op9_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest_embeddings(spark, table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.clustered_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduped_words(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_files": op2_token_files,
    "op3_pii_crf": op3_pii_crf,
    "op4_decontaminate": op4_decontaminate,
    "op5_mix": op5_mix,
    "op6_shard": op6_shard,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_join": op8_ngram_join,
    "op9_ann_forest": op9_ann_forest,
    "op10_token_counts": op10_token_counts,
    "op11_yinyang": op11_yinyang,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_source_divergence": op13_source_divergence,
}


def _kmeans_sql(k: int = 16, dims: int = 64, rounds: int = 3) -> str:
    """Each round as two tables: a<r> has the nearest centroid of each vector, c<r + 1> the means of that."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 1048576)) = {dims})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        near = f"SELECT v.row, v.vec_id, v.q, c.c, {distance} AS d FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY v.row ORDER BY d, c.c) = 1"
        parts.append(f"a{r} AS MATERIALIZED ({near})")
        if r < rounds:
            sums = f"SELECT c, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY c, i"
            # Division rounds toward zero; taking off the remainder, made non-negative, rounds down.
            means = f"SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM ({sums}) GROUP BY c"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c0.c, coalesce(m.q, c0.q) AS q FROM c{r} c0 LEFT JOIN ({means}) m USING (c))")
    return f"""WITH {", ".join(parts)}
        SELECT a.vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
            (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
        keyed AS (SELECT *, {ASCII_LOWER.format(f"trim(line, {SPACES})")} AS k FROM lines),
        firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
        judged AS (SELECT d.*, coalesce(doc_id > first_id, false) AS gone FROM keyed d LEFT JOIN firsts USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op8_ngram_join": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
        tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
            FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM shared WHERE 100 * c >= 90 * (nx + ny - c)),
        ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, w.y FROM reach r JOIN ways w ON w.x = r.y),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT s.doc_id, len(s.s) AS n_shingles, l.component_id FROM sets s JOIN least l ON l.x = s.doc_id""",
    "op11_yinyang": _kmeans_sql(),
    "op12_substring_dedup": """
        WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        flat AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM words),
        spans AS (SELECT doc_id, pos, x, CASE WHEN pos <= n - 12 THEN string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS k FROM flat),
        firsts AS (SELECT k, min(doc_id) AS first_id FROM spans WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) > 1),
        hits AS (SELECT s.doc_id, s.pos, s.x, coalesce(s.doc_id > f.first_id, false) AS hit FROM spans s LEFT JOIN firsts f ON s.k = f.k),
        judged AS (SELECT doc_id, pos, x, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hits),
        kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS t FROM judged GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op13_source_divergence": f"""
        WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        flat AS (SELECT row, lang, source, unnest(regexp_extract_all({ASCII_LOWER.format("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
        kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM flat GROUP BY ALL HAVING count(DISTINCT row) >= 10),
        sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM flat SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
        shares AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (g.n + 2 * s.v) AS p,
                1 + (1000000000 * (k.total + 2)) // (s.n + 2 * s.v) AS q
            FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        far AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE c > 0 AND p > q),
        ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
