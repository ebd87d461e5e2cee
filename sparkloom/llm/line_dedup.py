"""Line deduplication: two Bloom filters find suspected repeats, and only those are shuffled and confirmed."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import batch, prepare, stored

SPACES = b" \t\n\x0b\x0c\r"
FILTER_BITS = 26
HOT_KEYS = 1024


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None if it has fewer than least code points."""
    key = line.strip(SPACES).lower()
    n = len(key)
    if n < least or (n < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def keys_of(text: str, least: int) -> list[bytes]:
    """The distinct keys of a text's lines."""
    return list({k for k in (line_key(x, least) for x in text.encode().split(b"\n")) if k is not None})


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def twice_filter(docs: DataFrame, id_col: str, text_col: str, least: int, bits: int) -> dict[int, bytes]:
    """The filter of lines seen in two documents or more; a document counts a line once."""

    def scan(batches):
        yield from bloom.marks(((hashes_of(keys_of(x, least)),) for b in batches for x in pc.fill_null(b.column(0), "").to_pylist()), bits)

    known = docs.filter(F.col(id_col).isNotNull()).select(F.col(text_col).cast("string"))
    return bloom.seen_twice(known.mapInArrow(scan, bloom.MARKS))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, bits: int = FILTER_BITS) -> DataFrame:
    """(id, text, n_lines, n_dropped): each text without the lines that a document of smaller id has, too.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. A key of at least
    `least` code points that occurs in two ids or more stays in the smallest id only, there with all its lines; other
    lines stay. A null or empty text is one empty line. Rows with the same id are one document in this. Rows with a
    null id neither drop nor cost lines. An empty table gives an empty table.

    The filter has 2**bits bits at most. A larger corpus fills it, so that more lines are suspected and shuffled, at
    most all; every suspect is confirmed by the SHA-256 of its key, so that results do not depend on the filter.
    """
    spark = docs.sparkSession
    prepare(spark)
    seen = spark.sparkContext.broadcast(twice_filter(docs, id_col, text_col, least, bits))

    def suspects(batches):
        bitmap = bloom.bitmap(seen.value, bits)
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column(0).to_pylist(), pc.fill_null(b.column(1), "").to_pylist(), strict=True):
                keys = keys_of(text, least)
                if keys:
                    hit = bloom.held(bitmap, hashes_of(keys), bits)
                    found = [hashlib.sha256(keys[j]).digest() for j in np.flatnonzero(hit)]
                    ids += [i] * len(found)
                    out += found
            yield batch("id long, key binary", [ids, out])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = stored(slim.filter("id IS NOT NULL").mapInArrow(suspects, "id long, key binary"), "suspects")
    # Partial sums make one row for each key and task, however often a key occurs.
    repeated = stored(lines.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last"), "repeated")
    # Fewer than HOT_KEYS keys can have more than 1/HOT_KEYS of all rows each: those are broadcast and not shuffled.
    share = max(1, lines.count() // HOT_KEYS)
    hot = F.broadcast(repeated.filter(F.col("n") > share).select("key", "first"))
    cold = repeated.filter(F.col("n") <= share).select("key", "first")
    dropped = lines.join(hot, "key").union(lines.join(hot, "key", "left_anti").join(cold, "key")).filter("id > first")
    drops = dropped.groupBy("id").agg(F.collect_set("key").alias("drops"))

    def keep(batches):
        for b in batches:
            texts, lens, gone = [], [], []
            for text, drop in zip(pc.fill_null(b.column(1), "").to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = text.split("\n")
                lens.append(len(lines))
                if drop:
                    drop = set(drop)
                    lines = [x for x in lines if (k := line_key(x.encode(), least)) is None or hashlib.sha256(k).digest() not in drop]
                    text = "\n".join(lines)
                texts.append(text)
                gone.append(lens[-1] - len(lines))
            yield batch("id long, text string, n_lines long, n_dropped long", [b.column(0), texts, lens, gone])

    out = slim.join(drops, "id", "left").select("id", "text", "drops").mapInArrow(keep, "id long, text string, n_lines long, n_dropped long")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_dropped")


def deduped_lines(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
