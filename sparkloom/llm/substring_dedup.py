"""Substring deduplication: words under a window of words that also starts in a document of smaller id go.

One pass counts into a count-min sketch; a second pass sends on only the windows whose estimate is above one, and those
are grouped exactly. Three things keep this small:

* A window's estimate is that of its anchor, the sub-window of ANCHOR words of least hash. A repeated window has a
  repeated anchor, so the estimate is never too low; neighbouring windows mostly share their anchor, so the sketch
  holds about a quarter as many keys.
* Texts are also cut into segments, runs of windows that begin where a window's hash has five low zero bits, so that
  copies are cut alike. If a segment stands in a document of smaller id, all its windows are repeated, and none of them
  is needed as the first of its kind: the document of smallest id that holds a window keeps it in a segment that is
  itself a first. So the windows of such segments are removed without being sent. That holds for any set of segments;
  the most frequent ones, up to a bound, are broadcast, which takes copies and hot passages out of the shuffle.
* The windows of most frequent kind are broadcast, fewer than HOT of them; the others meet by join.

Windows and segments are told by 128 bits of hash, the windows of one document by 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import countmin
from .shared import _BASE, _BASE_2, _WORD, batch, mix64, prepare, row_chunks, scratch, stored, word_bounds, word_hashes

WINDOW = 13
ANCHOR = 7
#: A window whose hash has these bits zero begins a segment.
CUT = np.uint64(31)
#: Segments that are broadcast at most, 24 bytes each.
SEGMENTS = 1 << 20
HOT = 1024
#: Mean bytes a word, to size the sketch; a wrong guess costs shuffled rows only.
WORD_BYTES = 6
OUT = "id long, text string, n_words long, n_removed long"


@dataclass
class Windows:
    """The windows of the rows lo to hi of a batch: at which word each starts, its row within the batch, its hashes and anchor."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words_at: np.ndarray
    at: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, hash, other hash) of each segment."""
        begins = (self.low & CUT) == 0
        begins[:1] = True
        begins[1:] |= self.row[1:] != self.row[:-1]
        first = np.flatnonzero(begins)
        if not len(first):
            return first, self.low, self.high
        n = np.diff(first, append=len(self.low))
        within = np.arange(len(self.low)) - np.repeat(first, n)

        def total(values: np.ndarray, base: np.uint64) -> np.ndarray:
            powers = np.full(int(n.max()), base)
            powers[0] = 1
            return mix64(np.add.reduceat(values * np.multiply.accumulate(powers)[within], first))

        return first, total(self.low, _BASE), total(self.high, _BASE_2)


def sums(words: np.ndarray, k: int, weights: np.ndarray) -> np.ndarray:
    """A hash of each k words in turn."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * weights[j]
    return mix64(out)


def windows(column: pa.Array, size: int) -> Iterator[Windows]:
    """The windows of a text column, by chunks of rows."""
    for lo, hi, data, at in row_chunks(column):
        starts, ends, words_at = word_bounds(data, at)
        one, two = word_hashes(data, starts, ends, False), word_hashes(data, starts, ends, False, True)
        low, high = sums(one, size, _WORD), sums(two, size, _WORD[32:])
        inner = min(ANCHOR, size)
        small = sums(one, inner, _WORD[16:])
        anchor = small[: len(low)].copy()
        for j in range(1, size - inner + 1):
            np.minimum(anchor, small[j : j + len(low)], out=anchor)
        row = np.repeat(np.arange(hi - lo), np.diff(words_at))[: len(low)]
        inside = np.flatnonzero(np.arange(len(low)) + size <= words_at[row + 1]) if len(low) else row
        yield Windows(lo, hi, data, starts, ends, words_at, inside, row[inside], low[inside], high[inside], anchor[inside])


def once_a_row(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) without repeats."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def sketch(known: DataFrame, size: int, bits: int) -> np.ndarray:
    """Which counters of anchors and segments are above one, each counted once a row."""

    def count(batches):
        def keys():
            for b in batches:
                for w in windows(b.column(1), size):
                    first, low, _ = w.segments()
                    yield once_a_row(np.concatenate((w.row, w.row[first])), np.concatenate((w.anchor, low)))[1]

        yield from countmin.parts(keys(), bits)

    return countmin.merged(known.mapInArrow(count, countmin.PART), bits)


def repeated_segments(known: DataFrame, size: int, bits: int, seen) -> np.ndarray:
    """(hash, other hash, smallest id) of the most frequent segments that several ids hold, ascending by hash: SEGMENTS at most."""
    schema = "low long, high long, id long"

    def suspects(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in windows(b.column(1), size):
                first, low, high = w.segments()
                hit = countmin.repeated(seen.value, low, bits)
                yield batch(schema, [low[hit].view(np.int64), high[hit].view(np.int64), ids[w.lo : w.hi][w.row[first[hit]]]])

    rows = known.mapInArrow(suspects, schema)
    found = rows.groupBy("low", "high").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last")
    found = stored(found.select("low", "high", "first", F.floor(F.log2("n")).cast("int").alias("often")), "segments")
    # Classes of frequency, most frequent first, as long as they fit together.
    classes = sorted(found.groupBy("often").count().collect(), reverse=True)
    total = np.cumsum([c["count"] for c in classes])
    taken = [c["often"] for c, t in zip(classes, total, strict=True) if t <= SEGMENTS]
    table = found.filter(F.col("often") >= min(taken)).select("low", "high", "first").toArrow() if taken else None
    out = np.stack([table.column(i).to_numpy() for i in range(3)]) if table else np.zeros((3, 0), np.int64)
    return out[:, np.argsort(out[0], kind="stable")]


def is_later(w: Windows, ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which windows lie in a segment of the table that a smaller id holds. Of segments with the same first hash, one is looked at."""
    first, low, high = w.segments()
    if not len(first) or not table.shape[1]:
        return np.zeros(len(w.low), bool)
    low, high = low.view(np.int64), high.view(np.int64)
    at = np.minimum(np.searchsorted(table[0], low), table.shape[1] - 1)
    later = (table[0][at] == low) & (table[1][at] == high) & (table[2][at] < ids[w.row[first]])
    return np.repeat(later, np.diff(first, append=len(w.low)))


def kept_text(w: Windows, gone: np.ndarray) -> pa.Array:
    """The words of each row that are not gone, with one space between."""
    keep = np.flatnonzero(~gone)
    n = w.ends[keep] - w.starts[keep] + 1
    begin = np.cumsum(n) - n
    total = int(n.sum())
    at = np.searchsorted(keep, w.words_at)
    bounds = np.append(begin, total)[at]
    source = np.arange(total) + np.repeat(w.starts[keep] - begin, n)
    out = w.data[np.minimum(source, len(w.data) - 1)] if total else np.zeros(0, np.uint8)
    out[begin + n - 1] = 32
    data = out.tobytes()
    return pa.array([data[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()).cast(pa.string())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, bits: int | None = None) -> DataFrame:
    """(id, text, n_words, n_removed): the words of each text, one space between, without those that a repeated window covers.

    A window is `size` consecutive words `[^\\x20\\x09-\\x0D]+` of one row, `size` at most 16. It is repeated if its
    words also start in a row of smaller id. All windows are judged on the input. Null and empty texts have no words.
    Rows with the same id are one document in this, each with its own words. Rows with a null id keep all words and
    remove none elsewhere. Other columns are not read. Texts of any length are read whole, in chunks of about 2 MB or
    one text. An empty table gives an empty table.

    `bits`: the sketch has two rows of 2**bits counters; by default as many as there may be windows, 2**28 at most. A
    fuller sketch makes more windows shuffle, at most all, and changes no result.
    """
    spark = docs.sparkSession
    prepare(spark)
    if not 1 <= size <= 16:
        raise ValueError("windows of 1 to 16 words")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = slim.filter("id IS NOT NULL")
    if bits is None:
        n_bytes = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = countmin.width_bits(n_bytes / WORD_BYTES)
    seen = spark.sparkContext.broadcast(sketch(known, size, bits))
    with scratch(spark):
        firsts = spark.sparkContext.broadcast(repeated_segments(known, size, bits, seen))
    schema = "low long, high long, id long"

    def suspects(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for w in windows(b.column(1), size):
                mine = ids[w.lo : w.hi]
                hit = np.flatnonzero(~is_later(w, mine, firsts.value))
                hit = hit[countmin.repeated(seen.value, w.anchor[hit], bits)]
                order = hit[np.lexsort((w.low[hit], w.row[hit]))]
                new = np.ones(len(order), bool)
                new[1:] = (w.low[order[1:]] != w.low[order[:-1]]) | (w.row[order[1:]] != w.row[order[:-1]])
                order = order[new]
                yield batch(schema, [w.low[order].view(np.int64), w.high[order].view(np.int64), mine[w.row[order]]])

    with scratch(spark):
        found = stored(known.mapInArrow(suspects, schema), "windows")
        # Partial sums make one row for each window and task, however often it occurs.
        groups = found.groupBy("low", "high").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
        repeated = stored(groups.filter("first < last").drop("last"), "repeated")
        share = max(1, found.count() // HOT)
        hot = F.broadcast(repeated.filter(F.col("n") > share).select("low", "high", "first"))
        cold = repeated.filter(F.col("n") <= share).select("low", "high", "first")
        keys = ["low", "high"]
        dropped = found.join(hot, keys).union(found.join(hot, keys, "left_anti").join(cold, keys)).filter("id > first")
        drops = stored(dropped.groupBy("id").agg(F.collect_set("low").alias("drops")), "drops", keep=True)

    def keep(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            lists = b.column(2)
            for w in windows(b.column(1), size):
                mine = ids[w.lo : w.hi]
                bad = is_later(w, mine, firsts.value) if not np.isnan(mine).any() else np.zeros(len(w.low), bool)
                cut = np.searchsorted(w.row, np.arange(w.hi - w.lo + 1))
                for r, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    if j > i and lists[w.lo + r].is_valid:
                        bad[i:j] |= np.isin(w.low[i:j].view(np.int64), lists[w.lo + r].values.to_numpy())
                marks = np.zeros(len(w.starts) + 1, np.int64)
                at = w.at[bad]
                np.add.at(marks, at, 1)
                np.add.at(marks, at + size, -1)
                gone = np.cumsum(marks[:-1]) > 0
                removed = np.concatenate(([0], np.cumsum(gone)))
                yield batch(OUT, [b.column(0).slice(w.lo, w.hi - w.lo), kept_text(w, gone), np.diff(w.words_at), np.diff(removed[w.words_at])])

    found_in = known.join(drops, "id", "left").select("id", "text", "drops")
    nameless = slim.filter("id IS NULL").withColumn("drops", F.lit(None).cast("array<long>"))
    out = found_in.union(nameless).mapInArrow(keep, OUT)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "n_removed")


def deduped_words(docs: DataFrame) -> DataFrame:
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
