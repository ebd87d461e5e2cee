"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case letters and digits with one space for whatever stands between. An item of
n characters may differ by e = floor(RATE n) edits. Cut into e + 1 pieces, at least one piece stands unchanged in any
such passage, so exact hits of pieces (one automaton for all items) find all candidates. A candidate must hold enough
of the item's 4-character grams (each edit costs 4 at most), and then Myers' bit-parallel distance decides.

Items of fewer than LEAST characters have no budget: they are found as whole words only, since parts of longer words
and single edits would be found in clean texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch, prepare

RATE = 0.1
LEAST = 20
GRAM = 4
#: Items are matched in blocks of at most this many characters; each block is one more pass over the texts.
BLOCK_CHARS = 2_000_000
#: Items whose grams a worker holds as bit tables of 64 KB.
DENSE = 512
BETWEEN = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return BETWEEN.sub(" ", text.lower()).strip(" ")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces (offset, piece) of nearly equal length."""
    cut = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of pattern in text, the first such end; None beyond most."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, end = most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if end >= 0 else None


def grams(text: str) -> np.ndarray:
    """A 16-bit code of each run of GRAM characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < GRAM:
        return np.zeros(0, np.uint16)
    code = np.zeros(len(points) - GRAM + 1, np.uint32)
    for i in range(GRAM):
        code = code * np.uint32(0x9E3779B1) + points[i : len(points) - GRAM + 1 + i]
    return (code * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)


@dataclass
class Matcher:
    """All items of a block: their normal texts, error budgets, and the pieces' automaton."""

    items: list[tuple[int, str]]
    rate: float = RATE
    least: int = LEAST
    errors: list[int] = field(init=False)

    def __post_init__(self):
        import ahocorasick

        self.errors = [int(self.rate * len(t) + 1e-9) if len(t) >= self.least else 0 for _, t in self.items]
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, self.errors[i]):
                at.setdefault(piece, []).append((i, offset + len(piece)))
        self.tool = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.tool.add_word(piece, uses)
        if at:
            self.tool.make_automaton()
        self.dense: dict[int, np.ndarray] = {}
        self.enough = [len(t) - GRAM + 1 - GRAM * e for (_, t), e in zip(self.items, self.errors, strict=True)]

    def _marks(self, i: int) -> np.ndarray:
        """Which grams item i has, by code; those of the DENSE items asked last are kept."""
        if i not in self.dense:
            if len(self.dense) >= DENSE:
                del self.dense[next(iter(self.dense))]
            self.dense[i] = np.zeros(1 << 16, bool)
            self.dense[i][grams(self.items[i][1])] = True
        return self.dense[i]

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the best passage of each item in a normal text, by item id."""
        if not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for last, uses in self.tool.iter(text):
            for i, stop in uses:
                starts.setdefault(i, set()).add(last + 1 - stop)
        if not starts:
            return []
        codes, out = grams(text), {}
        for i, found in starts.items():
            (item_id, item), e = self.items[i], self.errors[i]
            tried_to, best = -1, None
            for at in sorted(found):
                if at <= tried_to:  # within the window of the candidate before
                    continue
                lo, hi = max(0, at - e), min(len(text), at + e + len(item) + e)
                tried_to = at + e
                if len(item) < self.least:
                    if (lo == 0 or text[lo - 1] == " ") and (hi == len(text) or text[hi] == " ") and best is None:
                        best = (0, lo, hi)
                    continue
                if self._marks(i)[codes[lo : max(lo, hi - GRAM + 1)]].sum() < self.enough[i]:
                    continue
                hit = myers(item, text[lo:hi], e)
                if hit is not None and (best is None or hit[0] < best[0]):
                    back = myers(item[::-1], text[lo : lo + hit[1]][::-1], e)
                    best = (hit[0], lo + hit[1] - (back[1] if back else len(item)), lo + hit[1])
            if best and (item_id not in out or best[0] < out[item_id][1]):
                out[item_id] = (item_id, *best)
        return [out[k] for k in sorted(out)]


_MATCHERS: dict[tuple, Matcher] = {}


def matcher(items: list[tuple[int, str]], rate: float, least: int) -> Matcher:
    """The last one built stays for the tasks that follow in the same worker."""
    key = (hash(tuple(items)), len(items), rate, least)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate, least)
    return _MATCHERS[key]


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Where characters start..end of the normal text stand in the text, from whole words to whole words."""
    at, first, last = 0, None, 0
    for m in re.finditer(r"[^\W_]+", text):
        size = len(m[0].lower())
        if at + size > start and first is None:
            first = m.start()
        if at < end:
            last = m.end()
        at += size + 1
    return first or 0, last


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items by blocks, of which the driver holds one at a time; a block's size bounds what a task holds."""
    held: list[tuple[int, str]] = []
    room = BLOCK_CHARS
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    for item_id, text in rows.distinct().orderBy("item", "text").toLocalIterator():
        text = normal(text or "")
        if item_id is None or not text:
            continue
        if held and room < len(text):
            yield held
            held, room = [], BLOCK_CHARS
        held.append((item_id, text))
        room -= len(text)
    if held:
        yield held


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(id, item_ids, distances, spans) of each row that holds an item, up to rate edits a character.

    item_ids go up, each once; distances are those of each item's best passage, the first of several; spans holds start
    and end of each in the text, in turn, in code points. Items of fewer than least normal characters are found without
    edits, as whole words. Items that are null or without letters and digits take no part. A null or empty text holds
    nothing, and a text of any length is searched whole. Rows are judged each, so repeated rows come repeatedly. An
    empty table of either kind gives an empty one. Results do not depend on how many blocks the items take.
    """
    spark = docs.sparkSession
    prepare(spark)
    found_schema = "item_ids array<long>, distances array<int>, spans array<int>"
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = out.select("id", "text", *[F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in found_schema.split(", "))])
    for block in blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            tool = matcher(shared.value, rate, least)
            for b in batches:
                rows = []
                for text, ids, distances, spans in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                    found = {i: (d, spans[2 * n], spans[2 * n + 1]) for n, (i, d) in enumerate(zip(ids or [], distances or [], strict=True))}
                    for i, d, start, end in tool.leaks(normal(text or "")):
                        if i not in found or d < found[i][0]:
                            found[i] = (d, *original_span(text, start, end))
                    order = sorted(found)
                    rows.append((order, [found[i][0] for i in order], [x for i in order for x in found[i][1:]]) if found else (None,) * 3)
                yield batch(f"id long, text string, {found_schema}", [b.column(0), b.column(1), *([r[c] for r in rows] for c in range(3))])

        out = out.mapInArrow(run, f"id long, text string, {found_schema}")
    return out.filter("item_ids IS NOT NULL").select(F.col("id").alias(id_col), "item_ids", "distances", "spans")


def leaked_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document that holds an item."""
    out = find_leaks(docs, benchmark)
    return out.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", F.array_min("distances").alias("distance"))


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """docs, all columns, without the rows whose text holds an item (see find_leaks)."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            tool = matcher(shared.value, rate, least)
            for b in batches:
                texts = pc.fill_null(pc.cast(b.column(at), pa.string()), "").to_pylist()
                yield b.filter(pa.array([not tool.leaks(normal(t)) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
