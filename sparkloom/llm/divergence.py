"""Source divergence audit: how far apart the vocabularies of a language's sources are, and which terms set a source apart.

Each kept term of a language becomes one row with an array of its counts, one place for each source of the language.
Higher-order functions turn that into the contributions of all pairs of sources; partial aggregation sums them before
anything is shuffled. Everything runs in the JVM.

For a group with counts summing to n over the v kept terms, a term of count c has p = 1 + floor(SCALE (c + 2) / (n + 2 v)),
and two groups differ in it by f = floor((p - q)^2 / (p + q)). Products with SCALE are taken as decimals, since counts
of common words in large corpora do not leave room for them in a long; (p - q)^2 and sums of f do fit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, scratch, stored

#: What stands between terms, which are runs of ASCII letters and characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
TOP = 10


def share(count: str, total: str) -> str:
    """SQL of p for a count, a group's total and the number v of kept terms."""
    return f"1 + (CAST({count} + 2 AS DECIMAL(20,0)) * {SCALE}) div CAST({total} + 2 * v AS DECIMAL(20,0))"


def apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def lowered(text):
    """Only A-Z lower-cased; a text of ASCII alone takes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def numbered_groups(rows: DataFrame) -> tuple[DataFrame, Column]:
    """(g, lang, source) of all groups, stored, and the column that gives a row's g: a hash that no two groups share.

    A key of a number and a term takes less than one of three texts wherever terms are counted.
    """
    groups = stored(rows.select("lang", "source").distinct(), "groups")
    for seed in range(64):
        g = F.xxhash64(F.lit(seed), "lang", "source")
        known = groups.select(g.alias("g"), "lang", "source")
        if known.groupBy("g").count().filter("count > 1").isEmpty():
            return known, g
    raise ValueError("no hash tells all groups apart")


def term_counts(rows: DataFrame, g: Column) -> DataFrame:
    """(g, term, n, docs) of each group: occurrences, and rows that hold the term.

    Texts are split between terms, which takes a fraction of the time that matching terms one by one does.
    """
    terms = rows.select(g.alias("g"), F.array_remove(F.split(lowered(F.col("text")), BETWEEN), "").alias("terms"))
    # Each row gives all its terms, and then each distinct one again to count the row once.
    both = terms.select("g", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    each = both.select("g", "once", F.explode("terms").alias("term"))
    return each.groupBy("g", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = 10, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each pair of language and source that occurs.

    A language keeps the terms that at least `least` of its rows hold. Part `pair` has the other sources of the
    language with their distance over all kept terms; part `term` the `top` terms that are more frequent in the source
    than in the language. Ranks go by value, largest first, then by item.

    Null languages, sources and texts count as empty strings. Each row is a document, so that repeated rows count
    again. Sources without terms have pairs, of distance 0 where the language keeps no term. Texts are read whole,
    whatever their length. An empty table gives an empty one. Columns of other names are not read.

    One row of the table of vectors has as many places as its language has sources, and pairs are as many as their
    number squared, as the result is. The table of sources is broadcast where Spark knows it to be small, else joined.
    """
    spark = docs.sparkSession
    prepare(spark)
    named = [(lang_col, "lang"), (source_col, "source"), (text_col, "text")]
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in named])
    with scratch(spark):
        known, g = numbered_groups(rows)
        counts = term_counts(rows, g).join(known, "g").select("lang", "source", "term", "n", "docs")
        terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
        kept = stored(terms.filter(F.col("docs") >= least).select("lang", "term", "total", "counts"), "terms", keep=True)
        totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
        groups = known.select("lang", "source").join(totals, ["lang", "source"], "left")
        places = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("sources"))
        sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
        langs = stored(places.join(sizes, "lang", "left").select("lang", "sources", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all")), "sources", keep=True)

    wide = kept.join(langs, "lang").withColumn("by", F.map_from_entries("counts"))
    wide = wide.withColumn("wide", F.expr("transform(sources, s -> coalesce(by[s.source], 0L))"))
    shares = F.expr(f"zip_with(wide, sources, (c, s) -> {share('c', 's.n')})")
    vectors = wide.select("lang", "term", "sources", "wide", shares.alias("p"), F.expr(share("total", "all")).alias("q"))

    # Contributions of the pairs (0, 1), (0, 2), ... (1, 2), ... in turn: a pair is its place in that order.
    between = F.expr(f"flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> {apart('x', 'y')})))")
    sums = vectors.select("lang", F.posexplode(between).alias("pair", "f")).groupBy("lang", "pair").agg(F.sum("f").alias("value"))
    named = langs.select("lang", "sources", F.size("sources").alias("n"), F.posexplode("sources").alias("a", "one"))
    named = named.select("lang", "n", "a", F.col("one.source").alias("source"), F.posexplode("sources").alias("b", "other")).filter("a <> b")
    place = F.expr("least(a, b) * n - least(a, b) * (least(a, b) + 1) div 2 + abs(a - b) - 1").cast("int")
    named = named.select("lang", "source", place.alias("pair"), F.col("other.source").alias("item"))
    pairs = named.join(sums, ["lang", "pair"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    each = vectors.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "wide", "p")).alias("x")).filter("x.wide > 0 AND x.p > q")
    marks = each.select("lang", F.col("x.sources.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(apart("x.p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = marks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(ranked)


