"""A count-min sketch of 64-bit keys, built in parts by all tasks and merged in streams.

The sketch has two rows of 2**bits counters; a key adds one to the counter of its low bits in the first row and of its
high bits in the second. The smaller of its two counters is never below its true count. Only "more than once" is asked
here, so that counters stop at 2, and what tasks look keys up in holds one bit for each counter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import batch

ROWS = 2
MOST = 2
#: Counters that one merging task holds at a time.
SEGMENT_BITS = 22
#: Slots that a task gathers before it sends its part of the sketch.
HELD = 8_000_000
PART = "seg int, slots binary"
MERGED = "seg int, repeated binary"


def width_bits(keys: float, least: int = 16, most: int = 28) -> int:
    """Bits for about as many counters a row as there are keys, within bounds: two rows of the largest take 64 MB as bits."""
    return int(np.clip(round(np.log2(max(keys, 1))), least, most))


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The counters of each key, as a (2, n) array; those of the second row come after those of the first."""
    return np.stack((keys & np.uint64((1 << bits) - 1), (keys >> np.uint64(64 - bits)) + np.uint64(1 << bits)))


def packed(sorted_slots: np.ndarray) -> bytes:
    """Ascending slots of a segment as gaps, byte by byte of their places: small gaps leave the upper bytes zero."""
    gaps = np.diff(sorted_slots, prepend=np.uint64(0)).astype("<u4")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def parts(keys: Iterable[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """What one task sends: for each segment, the slots of its keys, each as often as it counts, at most MOST times."""
    held: list[np.ndarray] = []
    waiting = 0

    def sent() -> pa.RecordBatch:
        every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        held.clear()
        counts = np.ones(len(every), bool)
        counts[MOST:] = every[MOST:] != every[:-MOST]
        every = every[counts]
        seg = every >> np.uint64(SEGMENT_BITS)
        first = np.flatnonzero(np.diff(seg, prepend=np.uint64(2**63)))
        within = every & np.uint64((1 << SEGMENT_BITS) - 1)
        return batch(PART, [seg[first].astype(np.int32), [packed(x) for x in np.split(within, first[1:])] if len(first) else []])

    for some in keys:
        held.append(slots(some, bits).ravel())
        waiting += held[-1].size
        if waiting > HELD:
            waiting = 0
            yield sent()
    yield sent()


def merged(sent: DataFrame, bits: int) -> np.ndarray:
    """One bit for each counter, set where it is above 1, in a bitmap of 2**(bits + 1) / 8 bytes.

    A merging task holds the counters of one segment, however many parts there are of it.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counters = None, np.zeros(1 << SEGMENT_BITS, np.uint8)

        def done():
            return batch(MERGED, [[at], [zlib.compress(np.packbits(counters > 1, bitorder="little").tobytes(), 1)]])

        for b in batches:
            for seg, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if seg != at:
                    if at is not None:
                        yield done()
                    at = seg
                    counters[:] = 0
                where, n = np.unique(unpacked(data.as_buffer()), return_counts=True)
                counters[where] = np.minimum(counters[where] + n, MOST)
        if at is not None:
            yield done()

    out = np.zeros(max(1, (ROWS << bits) // 8), np.uint8)
    for seg, data in sent.repartition("seg").sortWithinPartitions("seg").mapInArrow(merge, MERGED).collect():
        at = seg << (SEGMENT_BITS - 3)
        part = np.frombuffer(zlib.decompress(data), np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def repeated(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which keys have an estimate above 1: all that were counted twice, and few others while the sketch is not full."""
    at = slots(keys, bits)
    return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)
