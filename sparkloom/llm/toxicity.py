"""Toxic passages as maximal scoring segments of token log-odds, judged by extreme-value statistics.

Token scores. A token's share of toxic use is a chain of Beta (two-class Dirichlet) estimates: the prior of the whole
is the toxic share of all training tokens, the prior of each prefix of 3 to 6 characters is its shorter prefix, and
the prior of a whole word is its longest prefix. A word never seen scores as its longest known prefix. The score is
the log-odds of that share against the whole's, less DRIFT, so that neutral text has a negative mean. In a document's
evidence a token counts once; when it comes again it is neutral, since text that says one thing over and over is no
further evidence. Passages are found by the tokens' scores as they are.

Passages. One scan finds all maximal scoring segments (Ruzzo and Tompa). Under neutral text the best of n tokens has
P(S <= s) = exp(-K n exp(-rate s)); rate solves sum p exp(rate s) = 1 over neutral tokens, K is fitted to neutral
documents of a fold the counts did not use. A segment is a passage where rate S - log(K n) is positive, with rate and K
of the scores as they are. The same over scores that count once, with their own rate and K, adds up to the document's
evidence, and a logistic curve of its logarithm, fitted to that fold, turns evidence into a score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batch, prepare, row_chunks, stored, word_bounds, word_hashes

#: Bound of the labelled sample (rows with the smallest hashes), the only one: all its words and prefixes are counted.
TRAIN_ROWS = 20_000
PREFIXES = (3, 4, 5, 6)
WORD_COUNT = 5
PRIOR, CHAIN, DRIFT = 20.0, 10.0, 0.5
MARKS = ".,;:!?\"'()[]{}|<>*_-"
CACHED_WORDS = 400_000


def features(word: str) -> list[str]:
    """A word's prefixes, then itself (marked, so that it differs from a prefix); shorter words have themselves only."""
    return [word[:n] for n in PREFIXES if len(word) >= n] + ["=" + word]


class Shares:
    """Shares of features by their 64-bit hashes, in two arrays: 16 bytes each, whatever the words."""

    def __init__(self, shares: dict[str, float]):
        keys = np.array([xxhash.xxh64_intdigest(f) for f in shares], np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(shares.values()), np.float64)[order]

    def find(self, features: list[str]) -> np.ndarray:
        """The share of each feature, nan where it has none."""
        keys = np.array([xxhash.xxh64_intdigest(f) for f in features], np.uint64)
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.nan)

    def get(self, feature: str, default: float) -> float:
        share = float(self.find([feature])[0])
        return default if math.isnan(share) else share


@dataclass
class Model:
    shares: dict[str, float] | Shares
    base: float
    rate: float = 1.0
    k: float = 1.0
    #: rate and k of scores that are not discounted, for passages.
    raw_rate: float = 1.0
    raw_k: float = 1.0
    slope: float = 1.0
    at: float = 3.0

    def __post_init__(self):
        if isinstance(self.shares, dict):
            self.shares = Shares(self.shares)

    def tokens(self, raw: list[str]) -> np.ndarray:
        """Scores of words: each by its longest feature that has a share."""
        words = [features(w.strip(MARKS).lower()) for w in raw]
        found = self.shares.find([f for own in words for f in own])
        row = np.repeat(np.arange(len(words)), [len(own) for own in words])
        known = np.flatnonzero(~np.isnan(found))
        share = np.full(len(words), self.base)
        share[row[known]] = found[known]  # a word's features come from short to long, so that its longest stays
        return np.log(share / (1 - share)) - math.log(self.base / (1 - self.base)) - DRIFT

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float]]]:
        least = math.log(max(self.k * n, 1e-9))
        found = [(a, b, self.rate * s - least) for a, b, s in segments if self.rate * s > least]
        return sum(x for _, _, x in found), found

    def passages(self, segments: list[tuple[int, int, float]], n: int) -> list[tuple[int, int]]:
        """Start and end of the significant ones among segments of scores that are not discounted."""
        least = math.log(max(self.raw_k * n, 1e-9))
        return [(a, b) for a, b, s in segments if self.raw_rate * s > least]

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * (math.log1p(evidence) - self.at)))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time: candidates are the positive tokens."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.cumsum(scores)
    rights = total[up].tolist()
    lefts = (total[up] - scores[up]).tolist()
    stack: list[list] = []  # start, end, left sum, right sum, index of the nearest with a smaller left sum
    for i, left, right in zip(up.tolist(), lefts, rights, strict=True):
        new = [i, i + 1, left, right]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Callable[[int], str]]]:
    """(first row, end row, word hashes, word at which each row begins, the text of a word) of chunks of rows.

    Words are runs without ASCII white space; those that differ in the case of A-Z only share their hash.
    """
    for lo, hi, data, at in row_chunks(column):
        starts, ends, words_at = word_bounds(data, at)
        yield lo, hi, word_hashes(data, starts, ends), words_at, lambda i, d=data, s=starts, e=ends: d[s[i] : e[i]].tobytes().decode("utf-8", "replace")


class Scanner:
    """Token scores of texts, each word looked up once."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _looked_up(self, hashes: np.ndarray, word: Callable[[int], str]) -> np.ndarray:
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        fresh = [n for n, key in enumerate(keys) if key not in self.known]
        if fresh:
            if len(self.known) + len(fresh) > CACHED_WORDS:
                self.known = {key: self.known[key] for key in keys if key in self.known}
            values = self.model.tokens([word(i) for i in first[fresh].tolist()])
            self.known.update(zip([keys[n] for n in fresh], values.tolist(), strict=True))
        return np.array([self.known[key] for key in keys], np.float64)[of]

    def rows(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each row: scores as they are, and those for evidence, where a positive word counts where it first stands."""
        for lo, hi, hashes, at, word in words_of(column):
            values = self._looked_up(hashes, word)
            for i in range(hi - lo):
                raw, own = values[at[i] : at[i + 1]], hashes[at[i] : at[i + 1]]
                up = np.flatnonzero(raw > 0)
                again = np.ones(len(up), bool)
                again[np.unique(own[up], return_index=True)[1]] = False
                counted = raw.copy()
                counted[up[again]] = -DRIFT
                yield raw, counted

    def both(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return list(self.rows(pa.array(texts, pa.string())))

    def scores(self, texts: list[str]) -> list[np.ndarray]:
        """For evidence."""
        return [counted for _, counted in self.both(texts)]


def held_out(id_col: str = "doc_id"):
    """The remainder that splits labelled rows: 0 is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(fold, toxic, text) of at most TRAIN_ROWS labelled documents, none of fold 0."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).withColumn("fold", held_out()).filter("fold != 0")
    rows = rows.select("doc_id", "toxic", "fold").orderBy(F.xxhash64("doc_id"), "toxic").limit(TRAIN_ROWS)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    return stored(texts.join(F.broadcast(rows), F.col("id") == F.col("doc_id")).select("fold", "toxic", F.coalesce("text", F.lit("")).alias("text")), "labelled")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts come from folds 1 to 3, the null model and the curve from fold 4. Without both labels, no text is toxic."""
    spark = docs.sparkSession
    prepare(spark)
    rows = sample(docs, labels)

    def count(batches):
        seen: dict[str, list[int]] = {}
        for b in batches:
            for lo, hi, hashes, at, word in words_of(b.column(1)):
                toxic = np.repeat(b.column(0).to_numpy()[lo:hi], np.diff(at)).astype(np.float64)
                _, first, of, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                for i, y1, all_ in zip(first.tolist(), np.bincount(of, toxic).tolist(), n.tolist(), strict=True):
                    if plain := word(i).strip(MARKS).lower():
                        y = seen.setdefault(plain, [0, 0])
                        y[0] += all_ - int(y1)
                        y[1] += int(y1)
        yield batch("word string, y0 long, y1 long", [list(seen), [x[0] for x in seen.values()], [x[1] for x in seen.values()]])

    words = stored(rows.filter("fold != 4").select("toxic", "text").mapInArrow(count, "word string, y0 long, y1 long").groupBy("word").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1")), "words")
    n0, n1 = (x or 0 for x in words.agg(F.sum("y0"), F.sum("y1")).first())
    if not n0 or not n1:
        return Model({}, 0.5)
    base = (n1 + 1) / (n0 + n1 + 2)
    # Prefixes of characters, as Python cuts them: Spark's substring counts code points, too.
    keys = F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in PREFIXES], F.when(F.col("y0") + F.col("y1") >= WORD_COUNT, F.concat(F.lit("="), "word")))
    table = words.select(F.explode(F.array_compact(keys)).alias("f"), "y0", "y1").groupBy("f").agg(F.sum("y0").alias("y0"), F.sum("y1").alias("y1"))
    kept = table.toArrow()
    counts = dict(zip(kept["f"].to_pylist(), zip(kept["y0"].to_pylist(), kept["y1"].to_pylist(), strict=True), strict=True))
    shares: dict[str, float] = {}
    for f in sorted(counts, key=lambda x: (x[0] == "=", len(x), x)):
        parent, weight = base, PRIOR
        for p in [f[:n] for n in PREFIXES if n < len(f)] if f[0] != "=" else features(f[1:])[:-1]:
            if p in shares:
                parent, weight = shares[p], CHAIN
        y0, y1 = counts[f]
        shares[f] = (y1 + weight * parent) / (y0 + y1 + weight)
    model = Model(Shares(shares), base)
    _calibrate(model, rows.filter("fold = 4"))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """The null model, then the curve. Of each labelled row one row comes to the driver, and counts of rounded scores."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = "raw boolean, at double, count long, n long, best double"

    def scan(batches):
        scanner = Scanner(shared.value)
        tally: dict[tuple[bool, float], int] = {}
        for b in batches:
            out = []
            for both in scanner.rows(b.column(1)):
                for kind, s in zip((True, False), both, strict=True):
                    out.append((kind, len(s), max((x for _, _, x in segments(s)), default=0.0)))
                    at, n = np.unique(np.round(s, 2), return_counts=True)
                    for a, m in zip(at.tolist(), n.tolist(), strict=True):
                        tally[kind, a] = tally.get((kind, a), 0) + m
            none = [None] * len(out)
            yield batch(schema, [[x[0] for x in out], none, none, [x[1] for x in out], [x[2] for x in out]])
        none = [None] * len(tally)
        yield batch(schema, [[k for k, _ in tally], [a for _, a in tally], list(tally.values()), none, none])

    got = rows.filter("toxic = 0").select("toxic", "text").mapInArrow(scan, schema).groupBy("raw", "at", "n", "best").agg(F.sum(F.coalesce("count", F.lit(1))).alias("count")).collect()
    for raw in (True, False):
        tally = {r["at"]: r["count"] for r in got if r["raw"] == raw and r["at"] is not None}
        calm = [(r["n"], r["best"], r["count"]) for r in got if r["raw"] == raw and r["n"]]
        if raw:
            model.raw_rate, model.raw_k = _null(tally, calm, model.raw_rate, model.raw_k)
        else:
            model.rate, model.k = _null(tally, calm, model.rate, model.k)
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches):
        scanner = Scanner(shared.value)
        for b in batches:
            found = [(len(s), scanner.model.evidence(segments(s), len(s))[0]) for _, s in scanner.rows(b.column(1))]
            yield batch("toxic long, n long, evidence double", [b.column(0).cast(pa.int64()), [n for n, _ in found], [x for _, x in found]])

    docs = rows.select("toxic", "text").mapInArrow(weigh, "toxic long, n long, evidence double").filter("n > 0").select("toxic", "evidence").collect()
    model.slope, model.at = _curve(np.log1p(np.array([r["evidence"] for r in docs])), np.array([r["toxic"] for r in docs], float))


def _null(tally: dict[float, int], calm: list[tuple[int, float, int]], rate: float, k: float) -> tuple[float, float]:
    """rate and K of neutral scores and of (words, best segment, how often) of neutral documents; as given without any."""
    s, p = np.array(list(tally), float), np.array(list(tally.values()), float)
    if len(s) and (s > 0).any() and (s < 0).any():
        p /= p.sum()
        lo, hi = 1e-3, 50.0
        for _ in range(60):  # the sum is below 1 up to the rate, if the mean score is negative
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 600))).sum() < 1 else (lo, mid)
        rate = lo
    if calm:
        k = 1 / max(np.average([n * math.exp(-min(600, rate * best)) for n, best, _ in calm], weights=[m for *_, m in calm]), 1e-12)
    return rate, k


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and midpoint of a logistic curve by Newton steps, with a weak prior on the slope."""
    if not len(x) or y.min() == y.max():
        return 1.0, 3.0
    w = np.array([0.0, 0.1])
    a = np.stack((np.ones_like(x), x), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        grad = a.T @ (p - y) + 0.01 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), grad)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    slope = max(w[1], 1e-3)
    return float(slope), float(-w[0] / slope)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, n_passages, passages) of each row; passages holds first and end word of each, in turn.

    A null or empty text has no passage and the score of no evidence. Rows are scored each, whatever their id. Texts of
    any length are scanned whole, in time that grows with their words; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "id long, score double, predicted int, n_passages long, passages array<long>"

    def run(batches):
        scanner = Scanner(shared.value)
        for b in batches:
            score, spans = [], []
            for raw, counted in scanner.rows(b.column(1)):
                evidence, _ = scanner.model.evidence(segments(counted), len(counted))
                score.append(scanner.model.score(evidence))
                spans.append([x for span in scanner.model.passages(segments(raw), len(raw)) for x in span])
            yield batch(schema, [b.column(0), score, [int(x >= 0.5) for x in score], [len(x) // 2 for x in spans], spans])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text scores 0.5 or more. A null text scores as an empty one."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scanner = Scanner(shared.value)
        for b in batches:
            scores = scanner.rows(pc.cast(b.column(at), pa.string()))
            keep = [scanner.model.score(scanner.model.evidence(segments(s), len(s))[0]) < 0.5 for _, s in scores]
            yield b.filter(pa.array(keep, pa.bool_()))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of the labelled ones that are not held out."""
    return score_texts(docs, fit(docs, labels))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = toxicity(docs, labels)
    return out.select("doc_id", F.coalesce(held_out() == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_passages")
