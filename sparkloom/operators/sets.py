"""Merges and ordered unions of imports, modules and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, strip


def merge_imports(df: DataFrame, line: str, key: str) -> DataFrame:
    """(key, line): use lines with braces merged by path, self first; simple ones that those cover go; sorted by line.

    Lines that are no use statement are left out.
    """
    text = F.regexp_replace(F.col(line), r"^\s+|\s+\z", "")
    brace = r"^use\s+([^{;]+)::\{([^}]+)\};\z"
    uses = df.select(key, text.alias("__t"))
    items = uses.filter(F.col("__t").rlike(brace)).select(key, F.trim(F.regexp_extract("__t", brace, 1)).alias("path"), F.explode(F.split(F.regexp_extract("__t", brace, 2), ",")).alias("item"))
    items = items.select(key, "path", F.trim("item").alias("item")).filter("item <> ''").distinct()
    ordered = F.array_sort(F.collect_list(F.struct((F.col("item") != "self").alias("rest"), "item")))
    merged = items.groupBy(key, "path").agg(F.array_join(F.transform(ordered, lambda x: x["item"]), ", ").alias("all"))
    merged = merged.select(key, F.concat(F.lit("use "), "path", F.lit("::{"), "all", F.lit("};")).alias("line"))
    simple = uses.filter(F.col("__t").rlike(r"^use\s+[^{]+;\z") & ~F.col("__t").rlike(brace)).distinct()
    full = F.regexp_replace(F.regexp_replace("__t", r"^use ", ""), r";+\z", "")
    covered = items.select(key, F.concat("path", F.lit("::"), "item").alias("__full"))
    rest = simple.withColumn("__full", F.trim(full)).join(covered, [key, "__full"], "left_anti").select(key, F.col("__t").alias("line"))
    return merged.union(rest)


def ordered_distinct(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Each value of a key where it first stands."""
    rank = F.row_number().over(Window.partitionBy(key, value).orderBy(*order))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def assembled_rows(df: DataFrame, key: str, module: str, pos: str, line: str) -> DataFrame:
    """(key, text): lines of all modules in order, without fences and imports; a name's first definition stays.

    For definitions of one line each: the unit of removal is the row. `assembled` has whole texts.
    """
    name = F.regexp_extract(F.trim(line), r"^(?:pub )?(?:struct|enum|const|type) (\w+)", 1)
    rows = df.withColumn("__n", F.when(name != "", name)).filter(~F.trim(line).startswith("```") & ~F.trim(line).rlike(r"^use .*;\z"))
    rank = F.row_number().over(Window.partitionBy(key, "__n").orderBy(module, pos))
    kept = rows.withColumn("__r", F.when(F.col("__n").isNotNull(), rank)).filter("__r IS NULL OR __r = 1")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(module, pos, line))), lambda x: x[line]), "\n")
    return kept.groupBy(key).agg(text.alias("text"))


#: How a line names what it defines, and the labels of an assembled text.
DEFINITION = r"^(?:pub )?(?:struct|enum|const|type) (\w+)"
CONTRACT_HEAD, CONTRACT_END = "// === P33: Type Contract (shared types) ===\n", "\n// === End Type Contract ===\n\n"


def repeated_definitions(defs: DataFrame, unit: str, contract_names: DataFrame) -> DataFrame:
    """Those of the definitions (unit, module, pos, end, name) that go: their name is known to the contract or stands earlier.

    A definition within one that goes is not looked at, so it neither goes by itself nor makes a later one go. Which
    those are depends on earlier decisions only; rounds go on until no decision changes, one more than definitions are
    nested in repeated ones, and one in all where none are nested.
    """
    place = Window.partitionBy(unit, "module").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    by_name = Window.partitionBy(unit, "name").orderBy("module", "pos").rowsBetween(Window.unboundedPreceding, -1)
    known = contract_names.select(unit, "name").distinct().withColumn("given", F.lit(True))
    rows = defs.join(known, [unit, "name"], "left").withColumn("inside", F.lit(False)).withColumn("nested", F.coalesce(F.max("end").over(place) >= F.col("pos"), F.lit(False)))
    rows = rows.checkpoint()
    any_nested = not rows.filter("nested").isEmpty()
    while True:
        earlier = F.coalesce(F.count_if(~F.col("inside")).over(by_name), F.lit(0)) > 0
        rows = rows.withColumn("goes", ~F.col("inside") & (F.coalesce("given", F.lit(False)) | earlier))
        if not any_nested:
            return rows
        within = F.coalesce(F.max(F.when(F.col("goes"), F.col("end"))).over(place) >= F.col("pos"), F.lit(False))
        rows = rows.withColumn("now", within).checkpoint()
        if rows.filter("now <> inside").isEmpty():
            return rows
        rows = rows.withColumn("inside", F.col("now")).drop("now")


def assembled(df: DataFrame, unit: str, text: str, contracts: DataFrame | None = None) -> DataFrame:
    """(unit, text): one text of the modules (unit, module, name, text) in order, under their labels.

    Fences go, and use statements are merged at the top (merge_imports). Definitions of a name that an earlier module,
    an earlier line or the unit's contract (unit, contract) has go with their whole block, up to where its braces
    close. The contract stands before the modules. Blank lines around a module go, and so does an empty module.

    Lines meet the blocks that go by an interval join: the last one that begins at or before them must end before them.
    """
    from .ordered import exploded_lines
    from .spans import asof, block_ends

    spark = df.sparkSession
    rows = exploded_lines(df.repartition(F.col(unit)), text, [unit, "module"])
    rows = rows.filter(~strip(F.col("line")).startswith("```")).withColumn("bare", strip(F.col("line")))
    rows = rows.withColumn("is_use", F.col("bare").startswith("use ") & F.col("bare").endswith(";"))
    blocks = block_ends(rows, [unit, "module"], "pos", "line", ~F.col("is_use") & F.col("bare").rlike(DEFINITION))
    defs = blocks.select(unit, "module", "pos", "end", F.regexp_extract("bare", DEFINITION, 1).alias("name"))
    if contracts is None:
        contracts = spark.createDataFrame([], f"{unit} {df.schema[unit].dataType.simpleString()}, contract string")
    named = contracts.select(unit, F.explode(lines(F.col("contract"))).alias("line")).select(unit, F.regexp_extract(strip(F.col("line")), DEFINITION, 1).alias("name"))
    gone = repeated_definitions(defs, unit, named.filter("name <> ''")).filter("goes")
    kept = asof(rows, gone, [unit, "module"], "pos", F.col("end")).filter("mark IS NULL OR mark < pos").drop("mark")

    uses = merge_imports(kept.filter("is_use"), "line", unit).groupBy(unit).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("uses"))
    code = kept.filter("NOT is_use").groupBy(unit, "module").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("v"))
    joined = F.array_join(F.transform("v", lambda x: x["line"]), "\n")
    trimmed = F.regexp_replace(F.regexp_replace(joined, r"\A(?:[^\S\n]*\n)+", ""), r"(?:\n[^\S\n]*)+\z", "")
    code = code.select(unit, "module", trimmed.alias("code")).filter(strip(F.col("code")) != "").join(df.select(unit, "module", "name"), [unit, "module"])
    labelled = F.concat(F.lit("// --- Module: "), "name", F.lit(" ---\n"), "code")
    parts = code.select(unit, "module", labelled.alias("code")).groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("module", "code"))).alias("v"))
    all_ = df.select(unit).distinct().join(uses, unit, "left").join(contracts, unit, "left").join(parts, unit, "left")
    head = F.coalesce(F.concat("uses", F.lit("\n\n")), F.lit(""))
    block = F.coalesce(F.concat(F.lit(CONTRACT_HEAD), "contract", F.lit(CONTRACT_END)), F.lit(""))
    body = F.coalesce(F.array_join(F.transform("v", lambda x: x["code"]), "\n\n"), F.lit(""))
    return all_.select(unit, F.concat(head, block, body, F.lit("\n")).alias("text"))
