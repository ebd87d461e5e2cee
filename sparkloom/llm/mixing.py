"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import prepare, stored

GROUP = 256
SEED = 11
#: Up to this many sources (under 10 MB of targets) the targets are broadcast; beyond it, they are joined with salt.
BROADCAST_SOURCES = 50_000
SALTS = 16


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, n, source_size, target) of each source of (source, size).

    Sources in code point order, null last, take the weights in turn and share all of the size. A target above most
    times its source's size stops there and the others share the excess by weight: with sources in the order of
    most * size / weight, those before the first whose share does not exceed its limit are the ones that stop.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    per = stored(per, "sources")
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    limit = F.col("source_size") * float(most)
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    step = (
        per.withColumn("place", F.row_number().over(order))
        .withColumn("share", (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("free", F.col("share") <= limit / F.col("weight"))
    )
    level = F.min_by(F.when(F.col("free"), F.col("share")), F.when(F.col("free"), F.col("place"))).over(everything)
    target = F.least(limit, F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return step.select("source", "n", "source_size", target.alias("target"))


def _fold() -> str:
    """SQL of one group's rounding: acc holds the open unit (id, size, p) and those decided (id, size, up).

    The open unit c and the next x trade c.size * p words: up moves words from x to c, down from c to x, each as far
    as it goes, and the choice keeps both expectations. One of the two ends at 0 or 1 and is decided.
    """
    up, down = "least(c.size * (1 - c.p), x.size * x.p)", "least(c.size * c.p, x.size * (1 - x.p))"
    u = f"((xxhash64(c.id, x.id, {SEED}) & 9007199254740991) / 9007199254740992D)"
    unit = "named_struct('id', {0}.id, 'size', {0}.size, 'p', {1})"
    state = "named_struct('c', {0}, 'out', array_append(out, named_struct('id', {1}.id, 'size', {1}.size, 'up', {2})))"
    rise = (
        f"IF(c.size * (1 - c.p) <= x.size * x.p, {state.format(unit.format('x', 'x.p - up / x.size'), 'c', 'true')}, "
        f"{state.format(unit.format('c', 'c.p + up / c.size'), 'x', 'false')})"
    )
    fall = (
        f"IF(c.size * c.p <= x.size * (1 - x.p), {state.format(unit.format('x', 'x.p + down / x.size'), 'c', 'false')}, "
        f"{state.format(unit.format('c', 'c.p - down / c.size'), 'x', 'true')})"
    )
    body = f"IF(u * (up + down) < down, {rise}, {fall})"
    for name, text in (("down", down), ("up", up), ("u", u), ("c", "acc.c"), ("out", "acc.out")):
        import re

        body = re.sub(rf"(?<![\w'.]){name}(?![\w'(])", lambda _, t=text: t, body)
    none = "CAST(NULL AS STRUCT<id: BIGINT, size: DOUBLE, p: DOUBLE>)"
    first = f"named_struct('c', {none}, 'out', CAST(array() AS ARRAY<STRUCT<id: BIGINT, size: DOUBLE, up: BOOLEAN>>))"
    start = "named_struct('c', named_struct('id', x.id, 'size', x.size, 'p', x.p), 'out', acc.out)"
    return f"aggregate(units, {first}, (acc, x) -> IF(acc.c IS NULL, {start}, {body}))"


def mix(docs: DataFrame, size_sql: str, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, copies) of each row of docs: how often the mix takes it.

    A source's rate is target / source_size. A row is taken floor(rate) times, and once more if its fraction is
    rounded up. Fractions are rounded by weighted pivots in groups of about GROUP rows dealt by a hash; the one unit
    that stays open in a group meets those of GROUP other groups on the next level, until a source has one open unit,
    which a draw decides. Groups go from large to small rows, so the unit that stays open is a small one, and a
    source's words miss its target by less than its size. No group is large (a hot source has more groups), and draws are hashes of ids: reruns agree. Rows with the same id are handled each; a
    null id counts as one id. Rows of size 0 and fractions of 0 need no draw. A null source is a source.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.expr(size_sql).cast("long").alias("size"))
    slim = stored(slim, "sizes")
    targets = stored(source_targets(slim.select("source", "size"), weights, most), "targets")
    n_sources, most_rows = targets.agg(F.count(F.lit(1)), F.max("n")).first()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select("n", "source_size", "target", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p"), F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("k"))
    slim = slim.select("id", "size", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("k"))
    if n_sources <= BROADCAST_SOURCES:
        rows = slim.join(F.broadcast(targets), "k")
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
        rows = slim.select("*", salt).join(targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["k", "salt"]).drop("salt")
    facts = ["source_size", "target"]
    settled = rows.filter((F.col("size") == 0) | (F.col("p") == 0)).select("id", "size", *facts, F.col("base").alias("copies"))
    # The rows' hash deals them; groups' numbers are divided by GROUP from level to level.
    groups = F.ceil(F.col("n") / GROUP).cast("long")
    openings = rows.filter((F.col("size") > 0) & (F.col("p") > 0)).select(
        "k", *facts, "base", F.pmod(F.xxhash64("id", F.lit(SEED + 1)), groups).alias("bucket"), F.struct((-F.col("size")).cast("double").alias("less"), F.xxhash64("id", F.lit(SEED + 2)).alias("h"), "id", F.col("size").cast("double").alias("size"), "p").alias("unit")
    )
    keys = ["k", *facts, "base", "bucket"]
    parts, most_groups, level = [settled], max(1, -(-(most_rows or 1) // GROUP)), 0
    while True:
        folded = openings.groupBy(*keys).agg(F.sort_array(F.collect_list("unit")).alias("units")).select(*keys, F.expr(_fold()).alias("acc"))
        folded = stored(folded, f"level{level}")
        parts.append(folded.select(*facts, "base", F.inline("acc.out")).select("id", F.col("size").cast("long").alias("size"), *facts, (F.col("base") + F.col("up").cast("long")).alias("copies")))
        if most_groups == 1:
            break
        most_groups, level = -(-most_groups // GROUP), level + 1
        unit = F.struct((-F.col("acc.c.size")).alias("less"), F.xxhash64("acc.c.id", F.lit(SEED + 2)).alias("h"), "acc.c.id", "acc.c.size", "acc.c.p")
        openings = folded.select("k", *facts, "base", F.expr(f"bucket div {GROUP}").alias("bucket"), unit.alias("unit"))
    draw = F.expr(f"(xxhash64(acc.c.id, {SEED + 3}) & 9007199254740991) / 9007199254740992D")
    parts.append(folded.select(F.col("acc.c.id").alias("id"), F.col("acc.c.size").cast("long").alias("size"), *facts, (F.col("base") + (draw < F.col("acc.c.p")).cast("long")).alias("copies")))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.withColumnRenamed("id", id_col)


WORDS = r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix of documents by words: weights 5, 2, 1 in turn, 100 % of all words, no source above 3 times its size."""
    out = mix(docs, WORDS)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it; rows with a null doc_id, as often as their id is taken."""
    copies = mix(docs, WORDS).groupBy(F.col("doc_id").alias("__loom_id")).agg(F.max("copies").alias("__loom_n"))
    kept = docs.join(copies, docs["doc_id"].eqNullSafe(copies["__loom_id"])).filter("__loom_n > 0")
    return kept.withColumn("__loom_n", F.explode(F.expr("sequence(1, __loom_n)"))).select(*[kept[c] for c in docs.columns])
