"""Nearest neighbours by a forest of random-projection trees with one priority queue for all trees of a query.

Trees are fitted to a sample; all vectors are indexed. The queue gives leaves in the order of the largest margin by
which their path leaves the query's side of a plane. A neighbour at distance d lies beyond a plane at margin m with the
probability that a normal of deviation d / sqrt(dimensions) exceeds m, so a query's queue ends at the margin
SLACK d / sqrt(dimensions), where d is the distance of its last neighbour as the sample tells it. Where vectors form
clusters that is a small part of all leaves; where they lie evenly in many dimensions no index can leave much out, and
most leaves are taken. With an endless slack the search is exhaustive and exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, prepare, stored

#: Planes are fitted to at most this many vectors, those with the smallest hashes; all vectors are indexed.
SAMPLE = 20_000
TREES = 8
LEAF = 64
SLACK = 0.65
#: Neighbouring leaves that one task searches. Points and queries of such a region go in blocks of about this many.
REGION = 16
BLOCK, QUERIES = 8192, 2048
TOP = 20
#: A queue ends when it has met top of the sample's NEAR * top nearest, at the earliest.
NEAR = 4


class Tree:
    """Inner nodes hold a plane (unit normal, offset) and two children; a child below zero is the leaf of its complement."""

    def __init__(self, points: np.ndarray, rng: np.random.Generator, leaf: int):
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        self.sizes: list[int] = []
        self.root = self._grow(points, rng, leaf)
        self.planes = np.array(self.normals) if self.normals else np.zeros((0, points.shape[1]))

    def _leaf(self, n: int) -> int:
        self.sizes.append(n)
        return -len(self.sizes)

    def _grow(self, points: np.ndarray, rng: np.random.Generator, leaf: int) -> int:
        todo = [(points, None)]
        root = 0
        while todo:
            at, parent = todo.pop()
            node = None
            if len(at) > leaf:
                normal = rng.standard_normal(at.shape[1])
                normal /= np.linalg.norm(normal)
                along = at @ normal
                offset = float(np.median(along))
                right = along > offset
                if right.any() and not right.all():
                    node = len(self.normals)
                    self.normals.append(normal)
                    self.offsets.append(offset)
                    self.children.append([0, 0])
                    todo += [(at[~right], (node, 0)), (at[right], (node, 1))]
            if node is None:
                node = self._leaf(len(at))
            if parent is None:
                root = node
            else:
                self.children[parent[0]][parent[1]] = node
        return root

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x."""
        at = np.full(len(x), self.root)
        kids, offsets = np.array(self.children).reshape(-1, 2), np.array(self.offsets)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = (x[inner] * self.planes[node]).sum(1) > offsets[node]
            at[inner] = kids[node, right.astype(int)]
        return -at - 1


class Forest:
    """Trees over vectors with one more coordinate, which makes all as long as the longest of the sample.

    So the nearest by angle is the one of the largest inner product. A longer vector gets 0 there; it is indexed like
    any other.
    """

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5):
        self.reach = float((sample**2).sum(1).max()) if len(sample) else 1.0
        rng = np.random.default_rng(seed)
        lifted = self.lift(sample)
        self.trees = [Tree(lifted, rng, leaf) for _ in range(trees)]

    def lift(self, x: np.ndarray) -> np.ndarray:
        length = np.sqrt(self.reach) or 1.0
        return np.concatenate((x / length, np.sqrt(np.maximum(self.reach - (x**2).sum(1), 0))[:, None] / length), 1)

    def index(self, x: np.ndarray) -> np.ndarray:
        x = self.lift(x)
        return np.stack([t.leaves(x) for t in self.trees], 1)

    def probes(self, q: np.ndarray, most: float, must: dict[tuple[int, int], list[int]] | None = None, least: int = 0) -> list[tuple[int, int]]:
        """(tree, leaf) pairs of margin most or less, in the order of one queue for all trees: the least margin first.

        must names vectors by their leaves; the queue goes on until it has met least of them.
        """
        q = np.append(q / (np.linalg.norm(q) or 1.0), 0.0)
        margins = [t.planes @ q - np.array(t.offsets) for t in self.trees]
        queue = [(0.0, i, t.root) for i, t in enumerate(self.trees)]
        out: list[tuple[int, int]] = []
        met: set[int] = set()
        while queue and (queue[0][0] <= most or len(met) < least):
            key, i, node = heapq.heappop(queue)
            t = self.trees[i]
            while node >= 0:
                m = float(margins[i][node])
                heapq.heappush(queue, (max(key, abs(m)), i, t.children[node][m <= 0]))
                node = t.children[node][m > 0]
            out.append((i, -node - 1))
            met.update((must or {}).get(out[-1], ()))
        return out

    def distance(self, q: np.ndarray, score: float) -> float:
        """Of the query and a vector of this inner product with it, both lifted."""
        most = np.linalg.norm(q) * (math.sqrt(self.reach) or 1.0)
        return math.sqrt(max(0.0, 2 - 2 * score / most)) if most else 0.0


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a binary column of numbers of a kind, as doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _pick(query: np.ndarray, vec: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Positions of each query's best: score from high to low, then the smaller id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    within = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[within < top]


def _clean(vectors: DataFrame, id_col: str, vector_col: str, kind: type) -> DataFrame:
    """(id, v) of vectors that take part, v as bytes of numbers of a kind."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = v.values
                if i is None or v is None or v.null_count or not len(v):
                    continue
                x = v.cast(pa.float64()).to_numpy()
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append((x + 0.0).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], schema=arrow_schema("id long, v binary"))

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(run, "id long, v binary").distinct()


def _by_leaf(points: pa.Table, asked: pa.Table, kind: type, top: int) -> pa.Table:
    """(query, vec, score) of each query's best points in the leaves of a region that its queue took."""
    out = [pa.table([[], [], []], schema=arrow_schema("query long, vec long, score double"))]
    if not points.num_rows or not asked.num_rows:
        return out[0]
    x, ids, of_leaf = matrix(points["v"].combine_chunks(), kind), points["ids"].to_pylist(), points["leaf"].to_numpy()
    q, query, bar = matrix(asked["v"].combine_chunks(), kind), asked["query"].to_numpy(), asked["bar"].to_numpy()
    wanted = asked["leaves"].combine_chunks()
    leaf_at, row_at = wanted.flatten().to_numpy(), np.repeat(np.arange(asked.num_rows), np.diff(wanted.offsets.to_numpy()))
    for leaf in np.unique(of_leaf).tolist():
        rows, held = row_at[leaf_at == leaf], np.flatnonzero(of_leaf == leaf)
        if not len(rows):
            continue
        rough = q[rows] @ x[held].T
        # The best distinct vectors by a product, and those that rounding could put among them; then exact scores.
        least = bar[rows]
        if len(held) > top + 1:
            least = np.maximum(least, np.partition(rough, len(held) - top - 1, 1)[:, len(held) - top - 1])
        a, c = np.nonzero(rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
        score = inner_products(q[rows[a]], x[held[c]])
        n = np.array([len(ids[i]) for i in held[c].tolist()], np.int64)
        vec = np.array([j for i in held[c].tolist() for j in ids[i]], np.int64)
        a, score = np.repeat(query[rows[a]], n), np.repeat(score, n)
        other = vec != a
        best = _pick(a[other], vec[other], score[other], top)
        out.append(pa.table([a[other][best], vec[other][best], score[other][best]], schema=out[0].schema))
    return pa.concat_tables(out)


def search(
    vectors: DataFrame, every: int, top: int = TOP, trees: int = TREES, slack: float = SLACK, leaf: int = LEAF, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by every, the top other vectors by inner product found.

    Ranks go by score from high to low, then by the smaller id; scores are inner products of the original vectors in
    double precision. slack says how far a query's queue goes (see the module's text); math.inf finds the exact result.
    Vectors that are null, of length zero, of another dimension than most of the sample's, or hold a null or a number
    that is not finite, take no part. Fewer candidates give fewer rows, an empty table none. Equal vectors are indexed
    once, with the top + 1 smallest of their ids: no other can be among the nearest. Rows with the same id and vector
    count once; a vector's best score counts where an id has several. Columns beside the two named take no part.

    Trees are fitted to a sample of SAMPLE vectors; each vector goes to its leaf of each tree. A region of neighbouring
    leaves is searched by one task, or by several in blocks of its points and of the queries that ask for it.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kind = np.float32 if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64
    width_of = np.dtype(kind).itemsize
    rows = stored(_clean(vectors, id_col, vector_col, kind), "vectors")
    drawn = rows.select("id", "v", F.xxhash64("v", "id").alias("h")).orderBy("h").limit(SAMPLE).select("id", "v").collect()
    sample = list({r[0]: bytes(r[1]) for r in drawn}.values())
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [len(x) for x in sample]
    width = max(set(sizes), key=sizes.count)
    points = np.array([np.frombuffer(x, kind) for x in sample if len(x) == width]).astype(np.float64)
    rows = rows.filter(F.octet_length("v") == width)
    forest = Forest(points, trees, leaf)
    shared = spark.sparkContext.broadcast((forest, points, forest.index(points)))
    # A neighbour's rank among the sample, which also holds the query now and then.
    last = max(1, round(top * min(1.0, len(points) / rows.count())))
    reach = slack / math.sqrt(width // width_of + 1)

    # The smallest ids of each vector: first of each of many shares of its rows, then of those.
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    alone = Window.partitionBy("v").orderBy("id")
    least_ids = rows.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= top + 1).withColumn("r", F.row_number().over(alone)).filter(F.col("r") <= top + 1)
    distinct = stored(least_ids.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct")

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            leaves = shared.value[0].index(matrix(b.column(0), kind))
            n = leaves.shape[1]
            take = pa.array(np.repeat(np.arange(len(leaves)), n))
            regions = np.tile(np.arange(n), len(leaves)) << 32 | leaves.ravel() // REGION
            columns = [pa.array(regions), pa.array(leaves.ravel().astype(np.int64)), b.column(0).take(take), b.column(1).take(take)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema("region long, leaf long, v binary, ids array<long>"))

    def ask(batches):
        forest, known, known_leaves = shared.value
        for b in batches:
            regions, of, bars, leaves = [], [], [], []
            for i, q in enumerate(matrix(b.column(1), kind) if b.num_rows else []):
                scores = known @ q
                near = np.argpartition(-scores, NEAR * top)[: NEAR * top] if len(scores) > NEAR * top else np.arange(len(scores))
                near = near[np.argsort(-scores[near])]
                scores = scores[near]
                must: dict[tuple[int, int], list[int]] = {}
                for n, own in zip(near.tolist(), known_leaves[near].tolist(), strict=True):
                    for at in enumerate(own):
                        must.setdefault(at, []).append(n)
                most = reach * forest.distance(q, scores[min(last, len(scores) - 1)]) if math.isfinite(reach) else math.inf
                taken: dict[int, list[int]] = {}
                for t, n in forest.probes(q, most, must, min(top + 1, len(near))):
                    taken.setdefault(t << 32 | n // REGION, []).append(n)
                regions += taken
                leaves += taken.values()
                of += [i] * len(taken)
                # The leaves taken hold top others at least that score this, so that nothing below it is among those found.
                bars += [scores[-1] if len(scores) == NEAR * top else -math.inf] * len(taken)
            columns = [pa.array(regions, pa.int64()), b.column(0).take(pa.array(of, pa.int64())), pa.array(bars, pa.float64()), pa.array(leaves, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema("region long, query long, bar double, leaves array<long>"))

    queries = rows.filter(F.col("id") % every == 0).select("id", "v")
    asked = stored(queries.mapInArrow(ask, "region long, query long, bar double, leaves array<long>"), "asked")
    placed = distinct.mapInArrow(place, "region long, leaf long, v binary, ids array<long>")
    # At most as many rows as the forest has regions.
    blocks = placed.groupBy("region").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("long").alias("blocks"))
    turns = asked.groupBy("region").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / QUERIES)).cast("long").alias("turns"))
    cuts = stored(blocks.join(turns, "region"), "blocks")
    # An id with several vectors asks for what any of them takes, with each.
    asked = asked.join(queries.select(F.col("id").alias("query"), "v"), "query").distinct()
    asked = asked.join(F.broadcast(cuts), "region").withColumn("turn", F.pmod(F.xxhash64("query"), "turns"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = placed.join(F.broadcast(cuts), "region").withColumn("block", F.pmod(F.xxhash64("v"), "blocks"))
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        return _by_leaf(left, right, kind, top)

    by = ["region", "block", "turn"]
    held, asked = held.select(*by, "leaf", "v", "ids"), asked.select(*by, "query", "v", "bar", "leaves")
    found = held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, "query long, vec long, score double")
    best = found.groupBy("query", "vec").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec"))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")


def nearest_embeddings(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return search(embeddings.select("vec_id", "embedding"), every=20)
