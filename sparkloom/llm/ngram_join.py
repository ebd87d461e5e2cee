"""Jaccard self-join of word shingles: prefixes with single tokens for rare classes and token combinations for frequent ones.

Tokens are 64-bit shingle hashes, and one order of all tokens holds for every document: rare ones first, then
frequent ones, each by hash. Which is which comes from counts of all documents' tokens in a table of fixed size, so
any two documents agree, and any error of the counts costs time but no link.

Let t be the threshold. Documents A and B with J >= t differ in D = (1-t)/t * |A| tokens at most, so their first
common token stands among the first |A| - ceil(t|A|) + 1 of A, its prefix. If that token is rare, both index it
alone. Otherwise all common tokens are frequent. In the order of frequent tokens, D + 2 common ones have D + 1
neighbouring pairs, and each token that only one document has parts one of them at most: so some common pair stands
side by side in both. Both index all pairs side by side in the first 2D + 2 frequent tokens - a prefix extended by
D and combinations of two tokens, linear in number.

Keys that few documents share give all their pairs. A key of many documents is mostly one text with small changes,
most of whose copies do not link with each other; their pairs are found by what sets them apart. All documents of such
keys are compared with one of them, and what most of them differ in is turned over, so that each document A is a
common set plus or minus X(A). Then |A ^ B| = |X(A)| + |X(B)| - 2|X(A) & X(B)|. With k(A) = |X(A)| - c|A| and
c = (1-t)/(1+t), A and B link if and only if their X share (k(A) + k(B)) / 2 tokens or more. Let m have the least k.
If A and B link without sharing any, both link with m, by sizes alone. Otherwise one of them, an outer one, has
k > -k(m), and they share more than (k(A) - k(m)) / 2 tokens of X(A): a prefix of X(A), shorter than half of it where
copies are at random, is indexed for outer documents to find. Documents too far from the one compared stay for the
next round, as do keys of X that many share. Keys that rounds do not make small are compared in blocks, by sizes and
histograms, and only pairs that may link leave a block.

Candidates that no difference has decided are verified by their whole sets, in bundles: the texts of a small component
of candidates are sent once to one task, which stops at pairs that links have joined already.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import components
from .shared import arrow_schema, batch, fingerprint, mix64, prepare, scratch, shingle_sets, stored

COUNT_BITS = 22
#: Filter bits for each key, the fewest with which a filter is of use, and the most of all keys: 128 MB in a worker.
KEY_BITS_EACH, LEAST_BITS_EACH, MOST_KEY_BITS = 8, 3, 30
SEGMENT = 1 << 16
#: Buckets of a set's histogram, and of a second one that sets of LONG tokens or more have behind it.
HISTOGRAM, FINE, LONG = 64, 1024, 800
#: Words of 64 bits of a sketch of X.
SKETCH = 16
BROADCAST_IDS = 500_000
#: Ids, and nothing else, are broadcast up to this number: about 40 MB.
BROADCAST_GONE = 2_000_000
BROADCAST_SKETCHES = 100_000
BROADCAST_BYTES = 1 << 25
#: Keys of up to this many documents give all their pairs. Those of more are compared in blocks after ROUNDS rounds,
#: or once their pairs are few beside all cells, or when a round leaves most of them.
FEW = 24
ROUNDS = 4
BLOCK = 2048
#: Candidates are verified in bundles of about this many tokens. Components of up to COMPONENT_TOKENS are in one bundle.
BUNDLE_TOKENS, COMPONENT_TOKENS, PARTNERS = 1_000_000, 3_000_000, 256
#: Documents that differ from the one compared by up to about this share of their tokens are told by their differences.
FAR_SHARE = 0.8
#: Keys of X with up to this many documents are compared by one task, without giving pairs; others go to the next round.
GROUP = 1024
_PAIR = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Threshold:
    """J >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.far = max(2, int(FAR_SHARE * num / (den - num))) if num < den else 2
        #: Tokens whose hash lies below this are counted; it covers about twice a prefix.
        self.window = np.uint64(min(0.98, 2 * (1 - num / den) + 0.05) * 2.0**64)

    def prefix(self, n: int) -> int:
        return n - -(-n * self.num // self.den) + 1

    def differ(self, n: int) -> int:
        return n * (self.den - self.num) // self.num

    def near(self, n: int) -> int:
        return self.far * self.differ(n)

    def settled(self, n: int) -> int:
        """Documents of n tokens that differ by no more than this link with none that differ by more than near()."""
        return self.far * self.differ(-(-n * self.num // self.den)) - self.differ(n)

    def excess(self, x: int, n: int) -> int:
        """k of the module's text in whole numbers: times den + num."""
        return x * (self.den + self.num) - (self.den - self.num) * n

    def overlap(self, a, b):
        return -(-(a + b) * self.num // (self.num + self.den))


def tokens_to_index(tokens: np.ndarray, frequent: np.ndarray, t: Threshold) -> np.ndarray:
    """The keys of one document, as 64-bit hashes; tokens are sorted and distinct, frequent says which are."""
    n, first = len(tokens), t.prefix(len(tokens))
    rare, often = tokens[~frequent], tokens[frequent]
    singles = rare[:first]
    if len(rare) >= first:
        return singles
    often = often[: 2 * t.differ(n) + 2]
    pairs = mix64(often[:-1] * _PAIR[0] + often[1:] * _PAIR[1])
    return np.concatenate((singles, pairs))


def _merge_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(SEGMENT, np.uint32)
    for data in table.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(data), np.uint32)
    return pa.Table.from_batches([batch("seg int, counts binary", [[table.column("seg")[0].as_py()], [zlib.compress(total.tobytes(), 1)]])])


def _histograms(tokens: np.ndarray) -> bytes:
    coarse = np.bincount((tokens >> np.uint64(58)).astype(np.int64), minlength=HISTOGRAM)
    out = np.minimum(coarse, 65535).astype(np.uint16).tobytes()
    if len(tokens) >= LONG:
        fine = np.bincount((tokens >> np.uint64(38) & np.uint64(FINE - 1)).astype(np.int64), minlength=FINE)
        out += np.minimum(fine, 255).astype(np.uint8).tobytes()
    return out


def _coarse(hists: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[: 2 * HISTOGRAM] for x in hists), np.uint16).reshape(-1, HISTOGRAM).astype(np.int32)


def _may_overlap(x: np.ndarray, y: np.ndarray, least: np.ndarray, full: int) -> np.ndarray:
    """Whether sets of these histograms can share least tokens; a bucket that is full says nothing."""
    return (np.minimum(x, y).sum(1) >= least) | (x == full).any(1) | (y == full).any(1)


def _profile(docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """Rows of documents (id, n, node, hist), and rows of token counts (seg, counts) of each task. node names the set."""
    schema = "id long, n long, node binary, hist binary, seg int, counts binary"

    def run(batches):
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        seen: set[bytes] = set()
        for b in batches:
            ids, n, nodes, hists = [], [], [], []
            for (_, tokens), i in zip(shingle_sets(b.column(1), k), b.column(0).to_pylist(), strict=True):
                ids.append(i)
                n.append(len(tokens))
                if not len(tokens):
                    nodes.append(None)
                    hists.append(None)
                    continue
                nodes.append(fingerprint(tokens))
                hists.append(_histograms(tokens))
                if nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    np.add.at(counts, (tokens[: np.searchsorted(tokens, t.window)] & np.uint64(len(counts) - 1)).astype(np.int64), 1)
            yield batch(schema, [ids, n, nodes, hists, [None] * len(ids), [None] * len(ids)])
        full = [s for s in range(len(counts) // SEGMENT) if counts[s * SEGMENT : (s + 1) * SEGMENT].any()]
        none = [None] * len(full)
        yield batch(schema, [none, none, none, none, full, [zlib.compress(counts[s * SEGMENT : (s + 1) * SEGMENT].tobytes(), 1) for s in full]])

    return docs.mapInArrow(run, schema)


def _frequent(counts: DataFrame) -> np.ndarray:
    """Which slots of the token counts are frequent: well above what a rare token shares its slot with."""
    total = np.zeros(1 << COUNT_BITS, np.uint32)
    for r in counts.groupBy("seg").applyInArrow(_merge_counts, "seg int, counts binary").collect():
        total[r[0] * SEGMENT : (r[0] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(r[1]), np.uint32)
    mean = total.mean()
    return total > mean + 6 * mean**0.5 + 8


def _keys(docs: DataFrame, k: int, t: Threshold, frequent: np.ndarray) -> DataFrame:
    """(node, rare, keys) of each document: its keys as 64-bit hashes, and how many of its tokens are rare."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent, bitorder="little").tobytes())
    schema = "node binary, rare int, keys binary"

    def run(batches):
        often = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").astype(bool)
        seen: set[bytes] = set()
        for b in batches:
            keys, nodes, rare = [], [], []
            for _, tokens in shingle_sets(b.column(0), k):
                if len(tokens) and (node := fingerprint(tokens)) not in seen:
                    seen.add(node)
                    known = np.searchsorted(tokens, t.window)
                    flags = np.ones(len(tokens), bool)
                    flags[:known] = often[(tokens[:known] & np.uint64(len(often) - 1)).astype(np.int64)]
                    keys.append(np.unique(tokens_to_index(tokens, flags, t)).tobytes())
                    nodes.append(node)
                    rare.append(int(len(tokens) - flags.sum()))
            yield batch(schema, [nodes, rare, keys])

    return docs.select("text").mapInArrow(run, schema)


class _Repeats:
    """Tells which keys may occur twice in the arrays of the column keys, by a filter sized by their number.

    Where prefixes names columns, they say how many of a row's first keys are of a kind; then a key has to occur once
    at least in each kind, too. With more keys than the largest filter is of use for, any may.
    """

    def __init__(self, rows: DataFrame, *prefixes: str):
        total = rows.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
        bits = max(20, min(MOST_KEY_BITS, math.ceil(math.log2(1 + total * KEY_BITS_EACH))))

        def documents(batches):
            for b in batches:
                for keys, *ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    keys = np.frombuffer(keys, np.uint64)
                    yield keys, *(keys[:end] for end in ends)

        def scan(batches):
            yield from bloom.marks(documents(batches), bits)

        self.bits, self.shared = bits, None
        if total * LEAST_BITS_EACH <= 1 << bits:
            self.shared = rows.sparkSession.sparkContext.broadcast(bloom.seen_twice(rows.select("keys", *prefixes).mapInArrow(scan, bloom.MARKS)))

    def tool(self):
        if self.shared is None:
            return lambda x: np.ones(len(x), bool)
        filled = bloom.bitmap(self.shared.value, self.bits)
        return lambda x: bloom.held(filled, x, self.bits)


def _cells(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, id, n, rare) of keys that may occur twice: a filter sized by the number of keys leaves the others where they are.

    What is left of a document's keys goes to its node as one row, so that copies of a set in several tasks fall
    together, and only then becomes a row for each key. More keys than the largest filter can tell apart all go.
    """
    repeats = _Repeats(keys)

    def thin(batches):
        held = repeats.tool()
        for b in batches:
            found = [x[held(x)].tobytes() for x in (np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist())]
            some = pa.array([bool(x) for x in found], pa.bool_())
            columns = [b.column(0), b.column(1), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema("node binary, rare int, keys binary")).filter(some)

    def spread(batches):
        for b in batches:
            found = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *found]))
            columns = [flat, *(b.column(c).take(of) for c in range(3))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema("key long, id long, n long, rare int"))

    rows = keys.mapInArrow(thin, "node binary, rare int, keys binary")
    rows = rows.groupBy("node").agg(F.first("rare").alias("rare"), F.first("keys").alias("keys"))
    return rows.join(nodes.select("node", "id", "n"), "node").select("id", "n", "rare", "keys").mapInArrow(spread, "key long, id long, n long, rare int")


def _near_histograms(pairs: DataFrame, nodes: DataFrame, t: Threshold) -> DataFrame:
    """pairs whose token histograms allow the overlap that the threshold asks for: an exact upper bound."""
    side = nodes.select("id", "n", "hist")
    both = pairs.join(side.toDF("a", "na", "ha"), "a").join(side.toDF("b", "nb", "hb"), "b").filter(F.least("na", "nb") * t.den >= F.greatest("na", "nb") * t.num)

    def run(batches):
        for b in batches:
            ha, hb, least = b.column(4).to_pylist(), b.column(5).to_pylist(), t.overlap(b.column(2).to_numpy(), b.column(3).to_numpy())
            ok = _may_overlap(_coarse(ha), _coarse(hb), least, 65535)
            for lo in range(0, len(ok), 256):
                long = lo + np.flatnonzero([o and len(x) == len(y) > 2 * HISTOGRAM for o, x, y in zip(ok[lo : lo + 256], ha[lo : lo + 256], hb[lo : lo + 256], strict=True)])
                x, y = (np.frombuffer(b"".join(h[i][2 * HISTOGRAM :] for i in long), np.uint8).reshape(-1, FINE) for h in (ha, hb))
                ok[long] = _may_overlap(x.astype(np.int32), y.astype(np.int32), least[long], 255)
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=["a", "b", "na", "nb"]).filter(pa.array(ok))

    return both.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(run, "a long, b long, na long, nb long").distinct()


def _each_once(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """docs (id, text) with ids; rows that come again count once. Only rows of ids that come again are shuffled."""
    known = docs.filter("id IS NOT NULL")
    counts = profile.filter("seg IS NULL AND id IS NOT NULL").groupBy("id").count()
    again = stored(counts.filter("count > 1").select("id"), "again")
    n = again.count()
    if not n:
        return known
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    return known.join(again, "id", "left_anti").union(stored(known.join(again, "id", "left_semi").distinct(), "repeated"))


def _with_texts(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, ...) with the text of each id. Few rows are broadcast, so that other texts stay where they are."""
    return known.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id")


def _token_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    return [tokens for _, tokens in shingle_sets(column, k)]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many tokens two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


class Parts:
    """Disjoint sets of what links have joined so far."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, i: int) -> int:
        while (up := self.above.setdefault(i, i)) != i:
            self.above[i] = self.above[up]
            i = up
        return i

    def join(self, i: int, j: int) -> None:
        self.above[self.root(i)] = self.root(j)


def _in_bundles(pairs: DataFrame) -> DataFrame:
    """(bundle, a, b) of pairs (a, b, na, nb): pairs of a small component of candidates share a bundle, so that each of
    its texts is sent once. In large components the pairs of a document do, in shares of about PARTNERS partners.
    """
    sizes = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("na").alias("n")), F.struct(F.col("b").alias("id"), F.col("nb").alias("n")))).alias("x")).select("x.*").distinct()
    part = stored(sizes.join(components(pairs), "id"), "candidates")
    total = part.agg(F.sum("n")).first()[0] or 0
    room = part.groupBy("component").agg((F.sum("n") <= COMPONENT_TOKENS).alias("small"))
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("shares"))
    told = pairs.join(part.select(F.col("id").alias("a"), "component"), "a").join(room, "component").join(shares, "a")
    place = F.when(F.col("small"), F.xxhash64("component")).otherwise(F.xxhash64("a", F.pmod(F.xxhash64("b"), "shares")))
    return told.select(F.pmod(place, F.lit(max(1, math.ceil(total / BUNDLE_TOKENS)))).alias("bundle"), "a", "b")


def _verified(pairs: DataFrame, known: DataFrame, k: int, t: Threshold) -> DataFrame:
    """Links (a, b) that join what those pairs (a, b, na, nb) join that link, by their whole sets."""

    def run(_, texts: pa.Table, told: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for i, tokens in zip(texts["id"].to_pylist(), _token_sets(texts["text"].combine_chunks(), k) if texts.num_rows else [], strict=True):
            sets.setdefault(i, []).append(tokens)
        parts, out = Parts(), []
        for a, b in sorted(zip(told["a"].to_pylist(), told["b"].to_pylist(), strict=True)):
            if parts.root(a) == parts.root(b):
                continue
            for x, y in ((x, y) for x in sets[a] for y in sets[b] if len(x) and len(y)):
                same = _common(x, y)
                if same * t.den >= t.num * (len(x) + len(y) - same):
                    parts.join(a, b)
                    out.append((a, b))
                    break
        return pa.table([[a for a, _ in out], [b for _, b in out]], schema=arrow_schema("a long, b long"))

    told = stored(_in_bundles(pairs), "bundles")
    wanted = stored(told.select("bundle", F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    texts = _with_texts(known, wanted).select("bundle", "id", "text")
    return texts.groupBy("bundle").cogroup(told.groupBy("bundle")).applyInArrow(run, "a long, b long")


def _differences(members: DataFrame, known: DataFrame, k: int, t: Threshold) -> DataFrame:
    """(p, id, n, apart, new, gone) of members (p, id, n, m): the tokens that id has and p lacks, and the other way round.

    n and m are the sizes of the sets meant, should an id have several. apart is the number of both kinds of tokens;
    both arrays are null where it exceeds near(n).
    """
    schema = "p long, id long, n long, apart long, new array<long>, gone array<long>"
    asked = members.select(F.col("p").alias("id"), "m").distinct()

    def whole(batches):
        for b in batches:
            yield batch("p long, m long, tp binary", [b.column(0), b.column(1), [x.tobytes() for x in _token_sets(b.column(2), k)]])

    pivots = _with_texts(known, asked).select("id", "m", "text").mapInArrow(whole, "p long, m long, tp binary")
    pivots = stored(pivots.filter(F.octet_length("tp") == F.col("m") * 8), "pivots")
    small = (pivots.agg(F.sum(F.octet_length("tp"))).first()[0] or 0) <= BROADCAST_BYTES

    def run(batches):
        for b in batches:
            rows = []
            ids = (b.column(c).to_pylist() for c in range(3))
            for p, i, n, x, y in zip(*ids, _token_sets(b.column(3), k), b.column(4).to_pylist(), strict=True):
                if len(x) != n:
                    continue
                y = np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                same = y[np.minimum(at, len(y) - 1)] == x
                apart, new, gone = len(x) + len(y) - 2 * int(same.sum()), None, None
                if apart <= t.near(n):
                    left = np.ones(len(y), bool)
                    left[at[same]] = False
                    new, gone = x[~same].view(np.int64), y[left].view(np.int64)
                rows.append((p, i, n, apart, new, gone))
            yield batch(schema, [list(x) for x in zip(*rows, strict=True)] or [[]] * 6)

    full = _with_texts(known, members).join(F.broadcast(pivots) if small else pivots, ["p", "m"])
    return full.select("p", "id", "n", "text", "tp").mapInArrow(run, schema)


def _turned(near: DataFrame) -> DataFrame:
    """(p, more, fewer): tokens that p lacks and more than half of its documents have, and the other way round."""

    def count(batches):
        seen: dict[tuple[int, int, bool], int] = {}
        for b in batches:
            for p, new, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for lacks, tokens in ((True, new), (False, gone)):
                    for x in tokens:
                        seen[p, x, lacks] = seen.get((p, x, lacks), 0) + 1
        yield batch("p long, x long, lacks boolean, n long", [*([k[i] for k in seen] for i in range(3)), list(seen.values())])

    counts = near.select("p", "new", "gone").mapInArrow(count, "p long, x long, lacks boolean, n long").groupBy("p", "x", "lacks").agg(F.sum("n").alias("n"))
    sizes = near.groupBy("p").agg(F.count(F.lit(1)).alias("all"))
    most = counts.join(sizes, "p").filter(F.col("n") * 2 > F.col("all"))
    return most.groupBy("p").agg(F.collect_set(F.when(F.col("lacks"), F.col("x"))).alias("more"), F.collect_set(F.when(~F.col("lacks"), F.col("x"))).alias("fewer"))


def _set_apart(near: DataFrame, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """(p, id, n, k, x, sketch, least, m) of near documents, and keys (key, p, id, roles) of those whose X may share enough.

    x holds the tokens of X, those of the document first; roles says whether a key stands in the short prefix (1) of
    documents to be found, in the long prefix (2) of outer ones, or in both.
    """
    schema = "p long, id long, n long, k long, x array<long>, sketch array<long>"

    def turn(batches):
        for b in batches:
            k, xs, sketches = [], [], []
            for n, new, gone, more, fewer in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                new, gone, more, fewer = (set(x or ()) for x in (new, gone, more, fewer))
                xs.append(sorted((new - more) | (fewer - gone)) + sorted((gone - fewer) | (more - new)))
                k.append(t.excess(len(xs[-1]), n))
                bits = np.zeros(64 * SKETCH, bool)
                bits[np.array(xs[-1], np.int64) & (64 * SKETCH - 1)] = True
                sketches.append(np.packbits(bits).view(np.int64))
            yield batch(schema, [b.column(0), b.column(1), b.column(2), k, xs, sketches])

    turned = near.select("p", "id", "n", "new", "gone").join(_turned(near), "p", "left").mapInArrow(turn, schema)
    turned = stored(turned, "turned")
    middle = turned.groupBy("p").agg(F.min(F.struct("k", "id")).alias("m")).select("p", F.col("m.k").alias("least"), F.col("m.id").alias("m"))
    turned = turned.join(middle, "p")
    scale = 2 * (t.den + t.num)

    def index(batches):
        for b in batches:
            keys, shorts, longs = [], [], []
            for p, n, k, x, least in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True):
                shorts.append(max(0, len(x) - max(1, (k - least) // scale + 1) + 1))
                longs.append(max(0, min(len(x), t.differ(n) + 1, len(x) - max(1, -(-(k + least) // scale)) + 1)) if k + least > 0 else 0)
                x = np.array(x[: max(shorts[-1], longs[-1])], np.int64).view(np.uint64)
                keys.append(mix64(x * _PAIR[0] + mix64(np.array([p], np.int64).view(np.uint64)) * _PAIR[1]).tobytes())
            yield batch(packed, [b.column(0), b.column(1), shorts, longs, keys])

    packed = "p long, id long, short long, long long, keys binary"
    rows = stored(turned.select("p", "id", "n", "k", "x", "least").mapInArrow(index, packed), "differences")

    # A pair has one document in the short prefix of a key and one in the long prefix.
    repeats = _Repeats(rows, "short", "long")

    def spread(batches):
        held = repeats.tool()
        for b in batches:
            keys, of, roles = [np.zeros(0, np.uint64)], [], []
            for i, (short, long, x) in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)):
                x = np.frombuffer(x, np.uint64)
                at = np.flatnonzero(held(x))
                keys.append(x[at])
                of += [i] * len(at)
                roles.append((at < short) + 2 * (at < long))
            of = pa.array(of, pa.int64())
            told = pa.array(np.concatenate([np.zeros(0, np.int64), *roles]), pa.int32())
            columns = [pa.array(np.concatenate(keys).view(np.int64)), b.column(0).take(of), b.column(1).take(of), told]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema("key long, p long, id long, roles int"))

    return turned, rows.mapInArrow(spread, "key long, p long, id long, roles int")


def _group_links(rows: DataFrame, t: Threshold) -> DataFrame:
    """Links (a, b) that join what links within each key of (key, id, n, x): |X ^ X'| against the sizes, in blocks.

    A key's rows are at most GROUP; each row of a component but its first gives one link.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, n, xs = table["id"].to_numpy(), table["n"].to_numpy(), table["x"].to_pylist()
        tokens, at, often = np.unique(np.array([v for x in xs for v in x], np.int64), return_inverse=True, return_counts=True)
        size = np.array([len(x) for x in xs])
        row = np.repeat(np.arange(len(xs)), size)
        place = np.cumsum(often > 1) - 1  # tokens of one row overlap nothing
        held = np.zeros((len(xs), int((often > 1).sum())), np.float32)
        both = often[at] > 1
        held[row[both], place[at[both]]] = 1
        part = np.arange(len(xs))
        for lo in range(0, len(xs), 256):
            apart = size[lo : lo + 256, None] + size[None] - 2 * (held[lo : lo + 256] @ held.T).astype(np.int64)
            near = apart * (t.den + t.num) <= (t.den - t.num) * (n[lo : lo + 256, None] + n[None])
            for i in range(len(near)):
                parts = np.unique(part[near[i]])
                if len(parts) > 1:
                    part[np.isin(part, parts)] = parts[0]
        linked = np.flatnonzero(part != np.arange(len(xs)))
        return pa.table([ids[linked], ids[part[linked]]], schema=arrow_schema("a long, b long"))

    return rows.groupBy("key").applyInArrow(run, "a long, b long")


def _in_range(t: Threshold, a: str, b: str):
    return F.least(a, b) * t.den >= F.greatest(a, b) * t.num


def _all_pairs(cells: DataFrame, t: Threshold) -> DataFrame:
    x, y = cells.alias("x"), cells.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & _in_range(t, "x.n", "y.n"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _role_pairs(cells: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (p, a, b) of which one stands in the short prefix and the other in the long one."""
    x, y = cells.alias("x"), cells.alias("y")
    roles = F.expr("x.roles & 1 = 1") & F.expr("y.roles & 2 = 2")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & roles & _in_range(t, "x.n", "y.n"))
    return pairs.select(F.col("x.p").alias("p"), F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _linked_apart(pairs: DataFrame, turned: DataFrame, t: Threshold) -> DataFrame:
    """Those (a, b) of pairs (p, a, b) that link, by their differences X from the common set of p.

    Each bit in which two sketches of X differ stands for one token at least that only one of the X holds.
    """

    def run(batches):
        for b in batches:
            xs, ys = ([np.sort(np.array(v, np.int64)) for v in b.column(c).to_pylist()] for c in (4, 5))
            apart = np.array([len(x) + len(y) - 2 * _common(x, y) for x, y in zip(xs, ys, strict=True)], np.int64)
            near = apart * (t.den + t.num) <= (t.den - t.num) * (b.column(2).to_numpy() + b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(near))

    side = turned.select("p", "id", "n", "sketch")
    side = F.broadcast(side) if side.count() <= BROADCAST_SKETCHES else side
    likely = pairs.join(side.toDF("p", "a", "na", "sa"), ["p", "a"]).join(side.toDF("p", "b", "nb", "sb"), ["p", "b"])
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH)))
    likely = stored(likely.filter(apart * (t.den + t.num) <= (F.col("na") + F.col("nb")) * (t.den - t.num)).select("p", "a", "b"), "likely")
    side = turned.select("p", "id", "n", "x")
    full = likely.join(side.toDF("p", "a", "na", "xa"), ["p", "a"]).join(side.toDF("p", "b", "nb", "xb"), ["p", "b"])
    return full.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long").distinct()


def _block_pairs(cells: DataFrame, nodes: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (a, b) of each key of cells whose sizes and histograms allow a link, whatever the key's size.

    A key's documents are cut by size into bands, so that those that link are of one band or of two side by side, and
    each band by hash into blocks of about BLOCK. A task compares two blocks, and only near pairs leave it.
    """
    band = F.floor(F.log("n") / math.log(t.den / t.num) + 1e-9) if t.num < t.den else F.col("n")
    coarse = F.substring("hist", 1, 2 * HISTOGRAM).alias("hist")
    rows = cells.select("key", "id").join(nodes.select("id", "n", coarse), "id").withColumn("band", band)
    blocks = rows.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    blocks = stored(blocks, "blocks")
    rows = rows.join(blocks, ["key", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), "blocks"))
    rows = stored(rows, "banded")  # read three times
    same = rows.select("key", "band", F.lit(0).alias("step"), "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "id", "n", "hist")
    same = same.select("key", "band", "step", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).alias("upper"), "id", "n", "hist")
    above = blocks.select("key", (F.col("band") - 1).alias("band"), F.col("blocks").alias("others"))
    below = blocks.select("key", (F.col("band") + 1).alias("band"), F.col("blocks").alias("others"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("other")
    low = rows.join(above, ["key", "band"]).select("key", "band", F.lit(1).alias("step"), F.col("part").alias("i"), each, F.lit(False).alias("upper"), "id", "n", "hist")
    high = rows.join(below, ["key", "band"]).select("key", (F.col("band") - 1).alias("band"), F.lit(1).alias("step"), each, F.col("part").alias("j"), F.lit(True).alias("upper"), "id", "n", "hist")
    dealt = same.union(low).union(high.select("key", "band", "step", F.col("other").alias("i"), "j", "upper", "id", "n", "hist"))

    def run(table: pa.Table) -> pa.Table:
        ids, n, upper = (table[c].to_numpy() for c in ("id", "n", "upper"))
        hist = _coarse(table["hist"].to_pylist())
        full = (hist == 65535).any(1)
        one = table["step"][0].as_py() == 0 and table["i"][0].as_py() == table["j"][0].as_py()
        left, right = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(~upper), np.flatnonzero(upper))
        out = []
        for i in left:
            to = right[right > i] if one else right
            to = to[np.minimum(n[i], n[to]) * t.den >= np.maximum(n[i], n[to]) * t.num]
            ok = np.minimum(hist[i], hist[to]).sum(1) >= t.overlap(n[i], n[to])
            to = to[ok | full[to] | full[i]]
            out.append(np.stack((np.minimum(ids[i], ids[to]), np.maximum(ids[i], ids[to]))))
        a, b = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.table([a, b], schema=arrow_schema("a long, b long")).filter(pa.array(a != b))

    return dealt.groupBy("key", "band", "step", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _sized(cells: DataFrame) -> DataFrame:
    """cells (key, id, n, rare) of keys with two documents or more, with the key's size."""
    sizes = cells.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return cells.join(sizes, "key")


def _with_pivots(many: DataFrame, turn: int) -> DataFrame:
    """many with the document p of m tokens that those of a key are compared with.

    A document whose tokens are mostly frequent has few changes of its own: it is the one to compare with.
    """
    first = F.min(F.struct("rare", F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("p"), F.col("n").alias("m"))).alias("c")
    return many.join(many.groupBy("key").agg(first).select("key", "c.p", "c.m"), "key")


def _by_differences(many: DataFrame, known: DataFrame, k: int, t: Threshold, turn: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) found by comparing each document of many's keys with the one of its key, and the cells left open."""
    differ = t.den - t.num
    reach = F.floor(F.col("n") * differ / t.num)
    asked = stored(many.select("p", "id", "n", "m").distinct(), "asked")
    within = F.abs(F.col("n") - F.col("m")) <= reach * t.far
    apart = stored(_differences(asked.filter(within), known, k, t), "apart")
    turned, keys = _set_apart(apart.filter("new IS NOT NULL"), t)
    central = turned.filter("id <> m AND k + least <= 0").select(F.col("id").alias("a"), F.col("m").alias("b"))
    keys = stored(keys, "keys")
    short, long = F.count_if(F.expr("roles & 1 = 1")).alias("short"), F.count_if(F.expr("roles & 2 = 2")).alias("long")
    sizes = keys.groupBy("key").agg(short, long, F.count(F.lit(1)).alias("size")).filter("long > 0 AND short > 0 AND size > 1")
    shared = keys.join(sizes, "key").join(turned.select("p", "id", "n"), ["p", "id"])
    shared = stored(shared.select("key", "p", "id", "n", "roles", "size"), "shared")
    likely = stored(_role_pairs(shared.filter(F.col("size") <= FEW), t), "likely")
    grouped = shared.filter((F.col("size") > FEW) & (F.col("size") <= GROUP)).join(turned.select("p", "id", "x"), ["p", "id"])
    grouped = _group_links(grouped.select("key", "id", "n", "x"), t)
    found = central.union(_linked_apart(likely, turned, t)).union(grouped).distinct()
    again = shared.filter(F.col("size") > GROUP).select("key", "id", "n", F.lit(turn).alias("rare"))
    # Documents that are not settled: beyond what links with any far one, or not compared.
    settled = F.floor(F.ceil(F.col("n") * t.num / t.den) * differ / t.num) * t.far - reach
    done = apart.filter(F.col("apart") <= settled).select("p", "id")
    open_ = stored(asked.select("p", "id").filter("id <> p").join(done, ["p", "id"], "left_anti"), "open")
    few = open_.count() <= BROADCAST_IDS
    left = many.join(F.broadcast(open_) if few else open_, ["p", "id"], "left_semi").select("key", "id", "n", "rare")
    return found, left.unionByName(again).groupBy("key", "id").agg(F.min("n").alias("n"), F.min("rare").alias("rare"))


def _labels(docs: DataFrame, profile: DataFrame, k: int, t: Threshold) -> DataFrame:
    """(node, id) where id is the smallest id that the node's links reach."""
    spark = docs.sparkSession
    sets = profile.filter("node IS NOT NULL AND id IS NOT NULL").groupBy("node")
    nodes = stored(sets.agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("hist").alias("hist")), "nodes")
    frequent = _frequent(profile.filter("seg IS NOT NULL").select("seg", "counts"))
    known = _each_once(docs, profile)
    # A document is told by its smallest id from here on.
    with scratch(spark):
        keys = stored(_keys(known, k, t, frequent), "keys")
        cells = stored(_sized(stored(_cells(keys, nodes), "cells")), "sized", keep=True)
    pairs, links, before, n_cells = [], [], None, cells.count()
    for turn in range(ROUNDS + 1):
        with scratch(spark):
            pairs.append(stored(_all_pairs(cells.filter(F.col("size") <= FEW), t), "pairs", keep=True))
            many = cells.filter(F.col("size") > FEW)
            rows, n_pairs = many.agg(F.count(F.lit(1)), F.sum((F.col("size") - 1) / 2)).first()
            if not rows:
                break
            if turn == ROUNDS or n_pairs <= n_cells / 2 or (before and rows > 0.7 * before):
                pairs.append(stored(_block_pairs(many, nodes, t), "pairs", keep=True))
                break
            before = rows
            found, left = _by_differences(stored(_with_pivots(many, turn), "many"), known, k, t, turn)
            links.append(stored(found, "links", keep=True))
            cells = stored(_sized(stored(left, "cells")), "sized", keep=True)
    every = reduce(DataFrame.union, pairs).distinct()
    if links:  # pairs that other links join already need no comparison
        links = [stored(reduce(DataFrame.union, links).distinct(), "links")]
        part = components(links[0])
        every = every.join(part.toDF("a", "pa"), "a", "left").join(part.toDF("b", "pb"), "b", "left")
        every = every.filter("pa IS NULL OR pb IS NULL OR pa <> pb").select("a", "b")
    close = stored(_near_histograms(every, nodes, t), "close")
    links.append(stored(_verified(close, known, k, t), "links"))
    parts = components(reduce(DataFrame.union, links))
    return nodes.select("node", "id").join(parts, "id", "left").select("node", F.coalesce("component", "id").alias("id"))


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row: the components of all links of Jaccard num/den or more, 4/5 at least.

    A row's set: its distinct k-word shingles, A-Z lower-cased; a text of fewer words has one of all; a null text or
    one without words has none and links with nothing. component_id is the smallest id that links reach. Equal sets
    are one node from the start. Rows that share an id are one document, which links where one of them does; rows
    with a null id link with nothing and have no component. An empty table gives an empty table. Texts of any length
    are read whole; columns beside the two named take no part.

    Every pair of different sets that links is either compared or joined through a third set that links with both, so
    components are exact; a group of near copies costs rows in proportion to its size.
    """
    if num * 5 < den * 4:
        raise ValueError("the pairs side by side are complete for thresholds of 4/5 or more")
    spark = docs.sparkSession
    prepare(spark)
    t = Threshold(num, den)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = stored(_profile(docs, k, t), "profile", keep=True)
    members = profile.filter("seg IS NULL").select("id", "n", "node")
    with scratch(spark):
        label = stored(_labels(docs, profile, k, t), "components", keep=True)
    out = members.join(label.toDF("node", "component_id"), "node", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id"))).withColumnRenamed("id", id_col)


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns: of each component, and of rows that share an id, one row of the smallest id stays.

    Rows with a null id stay, and so do rows without words. Which of several rows with one id stays is left open. An
    empty table gives an empty table; further columns come along whatever their names.
    """
    found = ngram_join(docs, k, num, den, id_col, text_col).filter(F.col(id_col).isNotNull()).groupBy(id_col)
    found = stored(found.agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n")), "groups")
    gone = found.filter(F.col("c") != F.col(id_col)).select(F.col(id_col).alias("__loom_id"))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone
    kept = docs.join(gone, docs[id_col] == gone["__loom_id"], "left_anti")
    again = found.filter("n > 1").select(F.col(id_col).alias("__loom_id"))
    n = again.count()
    if not n:
        return kept
    again = F.broadcast(again) if n <= BROADCAST_GONE else again
    several = kept.join(again, kept[id_col] == again["__loom_id"], "left_semi").dropDuplicates([id_col])
    return kept.join(again, kept[id_col] == again["__loom_id"], "left_anti").unionByName(several)
