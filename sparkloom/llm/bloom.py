"""A pair of Bloom filters of bounded size for hashes seen once and seen twice, built by all tasks and merged by segments."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import batch

SEGMENT_BITS = 19
MARKS = "seg int, once binary, twice binary, kinds array<binary>"
MERGED = "seg int, twice binary"
#: Bits that a task holds before it sends them.
HELD = 4_000_000


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two filter bits of each 64-bit hash, as a (2, n) array."""
    mask = np.uint64((1 << bits) - 1)
    return np.stack((hashes & mask, (hashes >> np.uint64(64 - bits)) & mask))


def pack(at: np.ndarray) -> bytes:
    """Bit numbers of a segment as a compressed bitmap."""
    marks = np.zeros(1 << SEGMENT_BITS, bool)
    marks[at] = True
    return zlib.compress(np.packbits(marks, bitorder="little").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def marks(documents: Iterable[tuple[np.ndarray, ...]], bits: int) -> Iterator[pa.RecordBatch]:
    """What one task sends: for each segment, bits that its documents set once at least, and twice, and those of each kind.

    A document is all its hashes, which are distinct, and then those of each kind; a hash may be of several.
    """
    segments = 1 << max(0, bits - SEGMENT_BITS)
    held: list[tuple[np.ndarray, ...]] = []
    waiting = 0

    def cut(at: np.ndarray) -> list[np.ndarray]:
        ends = np.searchsorted(at, np.arange(1, segments, dtype=np.uint64) << np.uint64(SEGMENT_BITS))
        return np.split((at & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.int64), ends)

    def sent() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)] or [np.zeros(0, np.uint64)]
        at, n = np.unique(columns[0], return_counts=True)
        once, twice, kinds = cut(at), cut(at[n > 1]), [cut(np.unique(x)) for x in columns[1:]]
        some = [s for s in range(segments) if len(once[s])]
        return batch(MARKS, [some, [pack(once[s]) for s in some], [pack(twice[s]) for s in some], [[pack(x[s]) for x in kinds] for s in some]])

    for document in documents:
        if len(document[0]):
            held.append(tuple(np.unique(places(x, bits)) for x in document))
            waiting += sum(map(len, held[-1]))
        if waiting > HELD:
            yield sent()
            held.clear()
            waiting = 0
    yield sent()


def _merge(table: pa.Table) -> pa.Table:
    once = np.zeros((1 << SEGMENT_BITS) // 8, np.uint8)
    twice, kinds = once.copy(), [once.copy() for _ in table.column("kinds")[0].as_py()]
    for a, b, each in zip(*(table.column(c).to_pylist() for c in ("once", "twice", "kinds")), strict=True):
        a = unpack(a)
        twice |= unpack(b) | (once & a)
        once |= a
        for x, y in zip(kinds, each, strict=True):
            x |= unpack(y)
    for x in kinds:
        twice &= x
    return pa.Table.from_batches([batch(MERGED, [[table.column("seg")[0].as_py()], [zlib.compress(twice.tobytes(), 1)]])])


def seen_twice(sent: DataFrame) -> dict[int, bytes]:
    """The merged filter of hashes seen twice, and once of each kind, by segment, compressed: 2**bits bits at most, whatever the input."""
    return {r[0]: bytes(r[1]) for r in sent.groupBy("seg").applyInArrow(_merge, MERGED).collect()}


def bitmap(segments: dict[int, bytes], bits: int) -> np.ndarray:
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for s, data in segments.items():
        at = s << (SEGMENT_BITS - 3)
        part = unpack(data)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def held(filter_bits: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the filter may hold: all that were seen twice, and few others."""
    at = places(hashes, bits)
    return ((filter_bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)
