"""Readers and writers of source folders, pattern files, logs and traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import emitting
from ..functions.outlines import header_type_lines
from ..functions.text import fenced_code, line_count, lines, strip

MOST_BYTES = 10 * 1024 * 1024
#: Events that a summary log keeps.
SUMMARY_EVENTS = ("migration_start", "migration_complete", "migration_failed", "error", "budget_exceeded")


def read_sources(spark: SparkSession, folder: str, pattern: str = "*.c", recursive: bool = False) -> DataFrame:
    """(path, name, text) of files up to 10 MiB; name is the file's stem. One folder only, unless recursive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.filter(F.col("length") <= MOST_BYTES).select("path", name.alias("name"), F.decode("content", "UTF-8").alias("text"))


def concatenated(sources: DataFrame, group: list[str]) -> DataFrame:
    """Texts of each group in the order of paths, each behind a marker line with its file name."""
    piece = F.concat(F.lit("// === "), F.regexp_extract("path", r"([^/]+)$", 1), F.lit(" ===\n"), "text")
    return sources.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", piece.alias("piece")))), lambda x: x["piece"]), "\n").alias("text"))


def section(text: Column, header: str) -> Column:
    """The first fenced block after a `## ` header that holds the words; null without one."""
    rows = lines(text)
    at = F.array_position(F.transform(rows, lambda x: x.startswith("## ") & x.contains(header)), F.lit(True)).cast("int")
    after = F.slice(rows, F.greatest(at + 1, F.lit(1)), F.greatest(F.size(rows) - at, F.lit(0)))
    fences = F.filter(F.transform(after, lambda x, i: F.when(x.startswith("```"), i + 1)), lambda x: x.isNotNull())
    first, last = F.try_element_at(fences, F.lit(1)), F.coalesce(F.try_element_at(fences, F.lit(2)), F.size(after) + 1)
    body = F.array_join(F.slice(after, F.coalesce(first, F.lit(0)) + 1, F.greatest(last - first - 1, F.lit(0))), "\n")
    return F.when((at > 0) & first.isNotNull() & (last - first > 1), body)


def read_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """(name, c_pattern, rust_pattern, tags) of Markdown files that have both sections; tags are the parts of the stem."""
    rows = read_sources(spark, folder, "*.md").select("name", section(F.col("text"), "C Pattern").alias("c_pattern"), section(F.col("text"), "Rust Equivalent").alias("rust_pattern"))
    return rows.filter("c_pattern IS NOT NULL AND rust_pattern IS NOT NULL").withColumn("tags", F.split("name", "_"))


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON store; a store that does not exist is empty."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def append_log(events: DataFrame, path: str, level: str = "summary") -> None:
    """Appends events as JSON lines; a summary keeps five types, other levels keep all."""
    kept = events.filter(F.col("type").isin(*SUMMARY_EVENTS)) if level == "summary" else events
    kept.write.mode("append").json(path)


def parse_traces(df: DataFrame, line: str, prefix: str, schema: str) -> DataFrame:
    """Lines with the prefix decoded from JSON; lines that do not decode go."""
    rows = df.filter(strip(F.col(line)).startswith(prefix)).select(F.from_json(F.substring(strip(F.col(line)), len(prefix) + 1, 1 << 30), schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"}).alias("t"))
    return rows.filter("t IS NOT NULL AND t._bad IS NULL").select("t.*").drop("_bad")


def split_files(df: DataFrame, text: str, key: str, names: list[str]) -> DataFrame:
    """(key, file, content): text split at `// === name ===` lines; parts under unknown names go, and so does what stands before.

    Without any known marker everything is the first file's; with one name, everything is its.
    """
    code = df.select(key, fenced_code(F.col(text)).alias("__t"))
    if len(names) == 1:
        return code.select(key, F.lit(names[0]).alias("file"), F.col("__t").alias("content"))
    rows = lines(F.col("__t"))
    marker = lambda x: x.startswith("// === ") & x.endswith(" ===")
    name = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\A(?:// === )+", ""), r"(?: ===)+\z", ""))
    marks = F.filter(F.transform(rows, lambda x, i: F.when(marker(x), F.struct((i + 1).alias("at"), name(x).alias("name")))), lambda x: x.isNotNull())
    parts = code.select(key, "__t", rows.alias("__r"), marks.alias("__m")).withColumn("__m", F.transform("__m", lambda m, i: F.struct(m["at"].alias("at"), m["name"].alias("name"), F.coalesce(F.try_element_at(F.col("__m"), i + 2)["at"], F.size("__r") + 1).alias("end"))))
    known = F.filter("__m", lambda m: m["name"].isin(*names))
    first = lambda: F.array(F.struct(F.lit(names[0]).alias("file"), F.col("__t").alias("content")))
    cut = F.transform(known, lambda m: F.struct(m["name"].alias("file"), strip(F.array_join(F.slice(F.col("__r"), m["at"] + 1, m["end"] - m["at"] - 1), "\n")).alias("content")))
    return parts.select(key, F.explode(F.when(F.size(known) > 0, cut).otherwise(first())).alias("p")).select(key, "p.file", "p.content")


#: Lines of headers that one text takes at most.
MOST_HEADER_LINES = 1500


def header_types(df: DataFrame, where: list[str], key: str, text: str, headers: DataFrame, most: int = MOST_HEADER_LINES) -> DataFrame:
    """(where..., key, included, types): the local headers of each text whose type lines still fit, and those lines.

    headers has (where..., name, text): `where` says which headers a text sees, as its folder. Includes are taken in the
    order of lines; a header whose lines would pass `most` is passed over, and later ones are still tried, so this is a
    fold over the includes and not a filter on a running sum. Headers that are not there go, those without type lines
    count 0. Texts without any have no row here.

    Includes meet the headers' numbers of lines first; only headers that are taken are joined with what they hold.
    """
    held = headers.select(*where, "name", F.array_join(header_type_lines(F.col("text")), "\n").alias("lines"))
    sizes = held.select(*where, "name", line_count(F.col("lines")).alias("n"))
    local = r"^#include\s*\"(.*)\"$"
    found = df.select(*where, key, F.posexplode(lines(F.col(text))).alias("pos", "line")).select(*where, key, "pos", F.regexp_extract(strip(F.col("line")), local, 1).alias("name"), strip(F.col("line")).rlike(local).alias("is"))
    sized = found.filter("is").join(sizes, [*where, "name"]).groupBy(*where, key).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "n"))).alias("v"))

    def step(total: Column, x: Column) -> tuple[Column, Column]:
        fits = total + x["n"] <= most
        return F.when(fits, total + x["n"]).otherwise(total), F.when(fits, F.array(x)).otherwise(F.array().cast("array<struct<pos:int,name:string,n:int>>"))

    taken = sized.select(*where, key, F.explode(emitting(F.col("v"), F.lit(0), step, "struct<pos:int,name:string,n:int>")).alias("x")).select(*where, key, "x.pos", "x.name")
    block = F.concat(F.lit("// === From "), "name", F.lit(" ===\n"), "lines")
    each = taken.join(held, [*where, "name"]).groupBy(*where, key).agg(F.array_sort(F.collect_list(F.struct("pos", "name", block.alias("block")))).alias("v"))
    own = lambda field: F.transform("v", lambda x: x[field])
    return each.select(*where, key, own("name").alias("included"), F.array_join(own("block"), "\n\n").alias("types"))


def read_baseline(spark: SparkSession, path: str, result: str) -> DataFrame:
    """A row for each of the results of saved baselines, whose fields have the DDL types of `result`, with the run's success rate.

    Fields that a baseline lacks are null; a rate that it lacks is 0.
    """
    schema = f"summary struct<success_rate_pct: double>, results array<struct<{result}>>"
    saved = spark.read.schema(schema).option("multiLine", "true").json(path)
    return saved.select(F.coalesce("summary.success_rate_pct", F.lit(0.0)).alias("base_rate"), F.posexplode("results").alias("ordinal", "r")).select("base_rate", "ordinal", "r.*")


def html_report(rows: list[dict]) -> str:
    """A page with a row for each result; scores are banded at 90 and 70. For small aggregates on the driver."""
    from html import escape

    band = lambda s: "high" if s >= 90 else "mid" if s >= 70 else "low"
    body = "".join(f'<tr class="{band(r["score"])}"><td>{escape(r["name"])}</td><td>{r["score"]}</td></tr>' for r in rows)
    return f"<!doctype html><table>{body}</table>"


MANIFEST = "version int, run_id string, at timestamp, folder string, rows long"


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """A run's artifacts: first the rows in a folder of their own, and then the manifest that makes them visible.

    A run that fails while it writes leaves a folder that no manifest names, so that read_runs does not see it. The same
    run may be written again; its newest manifest counts.
    """
    import uuid

    spark = df.sparkSession
    folder = f"{path}/data/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    rows = spark.read.parquet(folder).count()
    manifest = spark.createDataFrame([(2, run_id, folder, rows)], "version int, run_id string, folder string, rows long").withColumn("at", F.current_timestamp())
    manifest.select("version", "run_id", "at", "folder", "rows").coalesce(1).write.mode("append").json(f"{path}/manifest")


def read_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all runs that have a manifest, with their run_id; None where there is none. The driver holds one row a run."""
    manifests = read_store(spark, f"{path}/manifest", MANIFEST)
    newest = manifests.groupBy("run_id").agg(F.max_by("folder", F.struct("at", "folder")).alias("folder")).orderBy("run_id").collect()
    each = [spark.read.parquet(folder).withColumn("run_id", F.lit(run)) for run, folder in newest]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each) if each else None
