"""Rate limiters with state for each key: exact folds in batch, and the same folds over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spans import asof

OUT = "key string, seq long, allowed boolean"


def sliding(times: list[float], held: list[float], most: int, window: float) -> tuple[list[bool], list[float]]:
    """Whether each call may pass: fewer than most passed calls are younger than the window. Rejected ones are forgotten."""
    out, start = [], 0
    held = list(held)
    for now in times:
        while start < len(held) and now - held[start] >= window:
            start += 1
        out.append(len(held) - start < most)
        if out[-1]:
            held.append(now)
    return out, held[start:]


def anchored(times: list[float], state: tuple[float | None, int], most: int, window: float) -> tuple[list[bool], tuple[float | None, int]]:
    """The same for windows that begin with the first call a window's length or more after the last beginning."""
    anchor, n = state
    out = []
    for now in times:
        if anchor is None or now - anchor >= window:
            anchor, n = now, 0
        out.append(n < most)
        n += out[-1]
    return out, (anchor, n)


#: Windows of time that one task takes as a slice.
SLICE = 64
SECOND = 1_000_000


def _sliced(calls: DataFrame, window: float) -> tuple[DataFrame, int]:
    """Calls with their time in whole microseconds and the slice of time that it lies in, and the window in microseconds."""
    span = round(window * SECOND)
    at = F.round(F.col("at").cast("double") * SECOND).cast("long")
    return calls.select("key", "seq", at.alias("at")).withColumn("slice", F.floor(F.col("at") / (SLICE * span))), span


def _chain(times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ascending times: the index of the first one a window later, and the last anchor of a chain that begins there."""
    following = np.searchsorted(times, times + span)
    last = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            last[i] = last[following[i]]
    return following, last


def anchors(calls: DataFrame, window: float) -> DataFrame:
    """(key, slice, anchor) of the windows that begin with the first call a window's length or more after the last beginning.

    A key's chain of anchors is found by slices of time. In each slice, every call at which the chain may enter it (the
    first, and those less than a window after the slice begins) tells the last anchor that the chain has there, and so
    the call at which it enters a later slice. Doubling those jumps marks the entries of the real chain in as many
    rounds as the number of slices has binary digits. Slices are tasks of their own, whatever key they are of.
    """
    sliced, span = _sliced(calls, window)
    times = sliced.select("key", "slice", "at").distinct()
    entry_kind, anchor_kind = "key string, slice long, entry long, last long", "key string, slice long, anchor long"

    def entries(table: pa.Table) -> pa.Table:
        at = np.sort(table.column("at").to_numpy())
        _, last = _chain(at, span)
        begin = table.column("slice")[0].as_py() * SLICE * span
        may = np.flatnonzero(np.concatenate(([True], at[:-1] < begin + span)))
        same = lambda name: pa.repeat(table.column(name)[0], len(may))
        return pa.table({"key": same("key"), "slice": same("slice"), "entry": at[may], "last": at[last[may]]})

    found = times.groupBy("key", "slice").applyInArrow(entries, entry_kind).checkpoint()
    jumps = asof(found.withColumn("from", F.col("last") + span), found.withColumn("from", F.col("entry")), ["key"], "from", F.col("entry"), forward=True)
    jumps = jumps.filter("mark IS NOT NULL").select("key", "entry", F.col("mark").alias("to"))
    reached = found.groupBy("key").agg(F.min("entry").alias("entry")).checkpoint()
    while True:
        more = reached.join(jumps, ["key", "entry"]).select("key", F.col("to").alias("entry")).checkpoint()
        if more.isEmpty():
            break
        reached = reached.union(more)
        second = jumps.select("key", F.col("entry").alias("to"), F.col("to").alias("beyond"))
        jumps = jumps.join(second, ["key", "to"]).select("key", "entry", F.col("beyond").alias("to")).checkpoint()

    def chained(left: pa.Table, right: pa.Table) -> pa.Table:
        at = np.sort(left.column("at").to_numpy())
        following, _ = _chain(at, span)
        out = []
        i = int(np.searchsorted(at, right.column("entry")[0].as_py())) if len(right) else len(at)
        while i < len(at):
            out.append(i)
            i = int(following[i])
        same = lambda name: pa.repeat(left.column(name)[0], len(out))
        return pa.table({"key": same("key"), "slice": same("slice"), "anchor": at[out]}) if out else pa.schema([("key", pa.string()), ("slice", pa.int64()), ("anchor", pa.int64())]).empty_table()

    entered = reached.join(found, ["key", "entry"]).select("key", "slice", "entry")
    return times.groupBy("key", "slice").cogroup(entered.groupBy("key", "slice")).applyInArrow(chained, anchor_kind)


def limit_anchored(calls: DataFrame, most: int = 60, window: float = 60.0) -> DataFrame:
    """(key, seq, allowed): the first `most` calls of each window pass (see anchors). Times count to the microsecond."""
    sliced, _ = _sliced(calls.withColumn("key", F.col("key").cast("string")), window)
    known = anchors(sliced.select("key", "seq", (F.col("at") / SECOND).alias("at")), window).checkpoint()
    slices = sliced.select("key", "slice").distinct().join(known.groupBy("key", "slice").agg(F.max("anchor").alias("last")), ["key", "slice"], "left")
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("anchor", F.max("last").over(before)).filter("anchor IS NOT NULL")  # one row for each slice
    marks = known.select("key", "slice", F.col("anchor").alias("at"), "anchor").union(carried.select("key", "slice", F.lit(-(2**62)).alias("at"), "anchor"))
    placed = asof(sliced, marks, ["key", "slice"], "at", F.col("anchor"))
    rank = F.row_number().over(Window.partitionBy("key", "mark").orderBy("at", "seq"))
    return placed.select("key", "seq", (rank <= most).alias("allowed"))


def limit_sliding(calls: DataFrame, most: int = 60, window: float = 60.0) -> DataFrame:
    """(key, seq, allowed): a call passes if fewer than `most` calls that passed are younger than the window.

    What passed a window ago is forgotten, so a pause of that length makes what follows independent: calls are dealt by
    key and by runs of slices without such a pause between them, and each task takes its calls in order and in batches,
    with the times that still count carried on, at most `most` of them. Times count to the microsecond.
    """
    sliced, span = _sliced(calls.withColumn("key", F.col("key").cast("string")), window)
    edges = sliced.groupBy("key", "slice").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    in_order = Window.partitionBy("key").orderBy("slice")
    pause = F.coalesce(F.col("first") - F.lag("last").over(in_order) >= span, F.lit(True))
    runs = edges.withColumn("pause", pause).select("key", "slice", F.sum(F.col("pause").cast("int")).over(in_order).alias("run"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for b in batches:
            allowed = []
            for key, number, at in zip(*(b.column(c).to_pylist() for c in ("key", "run", "at")), strict=True):
                if (key, number) != of:
                    of, held = (key, number), []
                passed, held = sliding([at], held, most, span)
                allowed += passed
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("seq"), pa.array(allowed, pa.bool_())], ["key", "seq", "allowed"])

    dealt = sliced.join(runs, ["key", "slice"]).select("key", "run", "at", F.col("seq").cast("long").alias("seq"))
    return dealt.repartition("key", "run").sortWithinPartitions("key", "run", "at", "seq").mapInArrow(run, OUT)


def limit(calls: DataFrame, kind: str, most: int = 60, window: float = 60.0) -> DataFrame:
    """(key, seq, allowed) of calls (key, seq, at in seconds), in the order of at and seq within each key."""
    return {"sliding": limit_sliding, "anchored": limit_anchored}[kind](calls, most, window)


def limit_stream(calls: DataFrame, most: int = 60, window: float = 60.0) -> DataFrame:
    """The sliding limiter over a stream of calls; a key's state is the times of its passed calls still in the window.

    A key's state is at most `most` times; that of silent keys stays, since a timeout would run batches without end.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(batches)).sort_values(["at", "seq"])
        allowed, held = sliding(frame["at"].tolist(), held, most, window)
        state.update((held,))
        yield pd.DataFrame({"key": frame["key"], "seq": frame["seq"], "allowed": allowed})

    held = T.StructType([T.StructField("held", T.ArrayType(T.DoubleType()))])
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("allowed", T.BooleanType())])
    return calls.groupBy("key").applyInPandasWithState(run, out, held, "append", "NoTimeout")


def upsert_state(spark, batch: DataFrame, path: str, key: str, order: str) -> None:
    """Keeps the last row of each key: for foreachBatch, with the state as a table that is replaced whole.

    The new state is written beside the old one and read from the newest version, so a lost executor costs a retry only.
    """
    import uuid

    from ..operators.joins import first_by

    old = read_state(spark, path)
    rows = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
    last = first_by(rows, [key], [F.desc(order)])
    version = 0 if old is None else int(spark.read.text(f"{path}/_versions").agg(F.max(F.split("value", " ")[0].cast("int"))).first()[0]) + 1
    folder = f"{path}/v{version}-{uuid.uuid4().hex}"
    last.write.parquet(folder)
    spark.createDataFrame([(f"{version} {folder}",)], "value string").coalesce(1).write.mode("append").text(f"{path}/_versions")


def read_state(spark, path: str) -> DataFrame | None:
    """The newest version of the state, or None before the first."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    newest = spark.read.text(f"{path}/_versions").select(F.split("value", " ").alias("p")).orderBy(F.col("p")[0].cast("int").desc()).first()[0]
    return spark.read.parquet(newest[1])
