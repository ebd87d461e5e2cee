"""What the operators of this package share: tables in the shared folder, and text as numpy arrays.

Words are split at the six ASCII white-space bytes (space and 0x09-0x0D). Those bytes never occur inside a
longer UTF-8 sequence, so everything here works on the bytes that Arrow hands over, without decoding.
"""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BATCH = 1000
CHUNK_BYTES = 1 << 21
#: Bytes of words hashed at a time: some 60 bytes of numbers each, which so stay in a core's cache.
HASHED_BYTES = 1 << 18


def prepare(spark: SparkSession) -> None:
    """Lets workers import this package, and bounds Arrow batches: 10,000 long texts do not fit a worker."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def give_back() -> None:
    """Returns memory that earlier tasks of this worker have freed: its allocators keep it, and the worker stays."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors see; a local one only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        import tempfile

        folder = tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, computed once into a Parquet table of the shared folder. It cuts the lineage and survives lost executors.

    Inside scratch() the table goes when that ends; one that is to be kept goes with the scratch() around it, if any.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end: for work whose result has been stored or collected by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for name in _SCRATCH.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- text as bytes

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and where each row starts; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def row_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about limit bytes at most, one row at least."""
    data, at = string_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_bounds(data: np.ndarray, at: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and at which word each row begins. A row's end ends a word; so does each cut, before a byte."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~_SPACE[data]
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = ~solid[:-1]
    first[at] = True
    if cuts is not None:
        first[:-1] |= cuts
    starts = np.flatnonzero(solid & first[:-1])
    ends = np.flatnonzero(solid & np.concatenate((~solid[1:] | first[1:-1], [True]))) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased if fold: sum of byte values at odd random weights times powers of an odd base.

    `second` gives another hash, so that both together tell words by 128 bits.
    """
    values, base = (_BYTE_2, _BASE_2) if second else (_BYTE, _BASE)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + HASHED_BYTES, "right")))
        s, n = starts[lo:hi], ends[lo:hi] - starts[lo:hi]
        begin = np.cumsum(n) - n
        within = np.arange(begin[-1] + n[-1]) - np.repeat(begin, n)
        byte = data[within + np.repeat(s, n)]
        powers = np.full(int(n.max()), base)
        powers[0] = 1
        out[lo:hi] = np.add.reduceat(values[_LOWER[byte] if fold else byte] * np.multiply.accumulate(powers)[within], begin)
        lo = hi
    return mix64(out)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words of each row, and the row of each. A row of fewer words, but some, has one of all."""
    n = np.diff(at)
    rows = np.repeat(np.arange(len(n)), n)
    if len(words) >= k:
        full = sum((words[j : len(words) - k + 1 + j] * _WORD[j] for j in range(k)), np.zeros(len(words) - k + 1, np.uint64))
        inside = np.arange(len(full)) + k <= at[rows[: len(full)] + 1]
        full, of = full[inside], rows[: len(inside)][inside]
    else:
        full, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = np.concatenate([(words[at[r] : at[r + 1]] * _WORD[: n[r]]).sum(keepdims=True) + _WORD[63 - n[r] : 64 - n[r]] for r in few])
        full, of = np.concatenate((full, short)), np.concatenate((of, few))
        order = np.argsort(of, kind="stable")
        full, of = full[order], of[order]
    return mix64(full), of


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of a text column."""
    for lo, hi, data, at in row_chunks(column):
        starts, ends, words_at = word_bounds(data, at)
        hashes, of = shingle_hashes(word_hashes(data, starts, ends), words_at, k)
        cut = np.searchsorted(of, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield lo + i, np.unique(hashes[cut[i] : cut[i + 1]])


def fingerprint(hashes: np.ndarray, salt: int = 0) -> bytes:
    """16 bytes that name a sorted set."""
    import hashlib

    return hashlib.blake2b(hashes.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string with long, int, double, string, binary, boolean and arrays of them."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def batch(schema: str, columns: list) -> pa.RecordBatch:
    types = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)
