"""Centroid clustering by Yinyang bounds, in exact whole numbers.

Centroids are put into groups once. Each vector keeps an upper bound of the distance to its own centroid and, for each
group, a lower bound of the distances to the group's other centroids. When centroids have moved, the bounds move with
them; a vector whose upper bound stays below all lower bounds keeps its centroid, and else only groups whose lower
bound is reached are scanned exactly. Bounds are floating numbers with a margin on the safe side, and ties are always
scanned, so the result is that of comparing all.

Vectors with their bounds are a table of the shared folder, written anew each round. Tasks sum their vectors by
centroid before anything is shuffled. The driver holds centroids only, k times the number of components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import batch, prepare, scratch, stored

SCALE = 64
#: Components of this size and more are left out: squared distances of 64 of them would pass a long.
LARGEST = float(1 << 20)
#: Relative margin of bounds, far above the rounding of square roots and sums.
MARGIN = 1e-9
#: Whole numbers up to this size have exact products and sums in doubles, for up to 64 components.
EXACT_IN_DOUBLE = 1 << 22
STATE = "id long, vector array<int>, cluster int, distance long, upper double, lower array<double>, scanned int"
SUMS = "cluster int, n long, total array<long>"


def usable(v: Column, dims: int) -> Column:
    """Exactly dims components, none null, not a number, infinite or of LARGEST size."""
    return (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid, by a few plain rounds from evenly spaced starts."""
    points = centroids.astype(float)
    at = points[np.linspace(0, len(points) - 1, groups).astype(int)]
    for _ in range(5):
        own = ((points[:, None] - at[None]) ** 2).sum(2).argmin(1)
        at = np.stack([points[own == g].mean(0) if (own == g).any() else at[g] for g in range(groups)])
    return own


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all centroids."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if most <= EXACT_IN_DOUBLE and x.shape[1] <= 64:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def vectors_of(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy().astype(np.int64)
    return values.reshape(len(column), -1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width).copy()


def least_others(distances: np.ndarray, own: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """For each row and group, the least distance to a centroid of the group that is not its own."""
    other = np.sqrt(distances.astype(float))
    other[np.arange(len(own)), own] = np.inf
    return np.stack([other[:, group == g].min(1, initial=np.inf) for g in range(groups)], 1)


def state(ids, vectors, own, distance, upper, lower, scanned) -> pa.RecordBatch:
    flat = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), kind))
    return batch(STATE, [ids, flat(vectors, pa.int32()), own, distance, upper, flat(lower, pa.float64()), scanned])


def first_round(points: DataFrame, centroids: np.ndarray, group: np.ndarray) -> DataFrame:
    """Each vector with its nearest centroid of all, the smaller number in ties, and its bounds."""
    groups = int(group.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = vectors_of(b.column(1))
                d = squared(x, centroids)
                own = d.argmin(1)
                near = d[np.arange(len(own)), own]
                lower = least_others(d, own, group, groups) * (1 - MARGIN)
                yield state(b.column(0), x, own, near, np.sqrt(near.astype(float)) * (1 + MARGIN), lower, np.full(len(own), len(centroids)))

    return points.mapInArrow(run, STATE)


def next_round(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray, group: np.ndarray) -> DataFrame:
    """Each vector with its nearest centroid after centroids have moved; `scanned` counts the distances that this took."""
    groups = int(group.max()) + 1
    drift = np.array([moved[group == g].max(initial=0) for g in range(groups)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, own = vectors_of(b.column(1)), b.column(2).to_numpy().copy()
            upper = (b.column(4).to_numpy() + moved[own]) * (1 + MARGIN)
            lower = np.maximum(matrix(b.column(5), groups) - drift, 0) * (1 - MARGIN)
            scanned = np.zeros(len(own), np.int64)
            near = np.full(len(own), -1, np.int64)
            # Globally: only where a group may hold a centroid as near as the own one. There, the own distance is taken.
            open_ = np.flatnonzero(lower.min(1) <= upper)
            for c in np.unique(own[open_]):
                at = open_[own[open_] == c]
                near[at] = squared(x[at], centroids[c : c + 1])[:, 0]
            scanned[open_] += 1
            upper[open_] = np.sqrt(near[open_].astype(float)) * (1 + MARGIN)
            before, own_near = own.copy(), near.copy()
            best, best_at = near.copy(), own.copy()
            second = lower.copy()
            # By groups: those whose bound is reached are scanned.
            reached = np.zeros(lower.shape, bool)
            reached[open_] = lower[open_] <= upper[open_, None]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for g in range(groups):
                at, members = np.flatnonzero(reached[:, g]), np.flatnonzero(group == g)
                d = squared(x[at], centroids[members])
                scanned[at] += len(members)
                low = d.argmin(1) if len(at) else np.zeros(0, int)
                least, which = d[np.arange(len(at)), low], members[low]
                wins = (least < best[at]) | ((least == best[at]) & (which < best_at[at]))
                best[at[wins]], best_at[at[wins]] = least[wins], which[wins]
                found.append((at, members, d))
            own = best_at
            for g, (at, members, d) in enumerate(found):
                other = np.where(members[None] == own[at, None], np.inf, np.sqrt(d.astype(float)))
                second[at, g] = other.min(1, initial=np.inf) * (1 - MARGIN)
            # A centroid that a vector has left counts in its group, if that was not scanned.
            left = np.flatnonzero(own != before)
            g = group[before[left]]
            second[left, g] = np.minimum(second[left, g], np.sqrt(own_near[left].astype(float)) * (1 - MARGIN))
            upper[open_] = np.sqrt(best[open_].astype(float)) * (1 + MARGIN)
            yield state(b.column(0), x, own, best, upper, second, scanned)

    return rows.mapInArrow(run, STATE)


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each centroid's vectors; a centroid without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            own = b.column(0).to_numpy()
            n += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.diff(own[order], prepend=-1))
            if len(first):
                total[own[order][first]] += np.add.reduceat(vectors_of(b.column(1))[order], first)
        some = np.flatnonzero(n)
        yield batch(SUMS, [some, n[some], total[some].tolist()])

    parts = rows.select("cluster", "vector").mapInArrow(run, SUMS)
    every = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))
    out = centroids.copy()
    for c, n, total in every.collect():
        out[c] = np.array(total) // n
    return out


def kmeans(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, dims: int = 64, rounds: int = 3, groups: int | None = None, seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, scanned) of each usable vector after `rounds` rounds.

    Components x count as floor(64 x). Centroids start as the k vectors of smallest SHA-256 of `<seed>:<id>`; equal ids
    come in the order of their components, null ids last. A round gives each vector to its nearest centroid by squared
    Euclidean distance, the smaller number in ties, and replaces each centroid that has vectors by their mean, rounded
    down. Vectors are then given to centroids once more. `scanned` is how many distances the last of these took.

    Vectors without exactly dims components, and those with a component that is null, not finite or of size 2**20 and
    more (whose distances a long may not hold), take no part and are not returned. Fewer than k vectors give fewer
    centroids; an empty table gives an empty one. Rows with the same or a null id are vectors of their own. Columns of
    other names are not read. `groups` is the number of groups of centroids, by default a quarter of k.
    """
    spark = vectors.sparkSession
    prepare(spark)
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    points = named.filter(usable(F.col("v"), dims)).select("id", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("v"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = [r["v"] for r in points.orderBy(key.asc_nulls_last(), "v").limit(k).collect()]
    centroids = np.array(start, np.int64).reshape(-1, dims)
    if not len(centroids):
        centroids = np.zeros((1, dims), np.int64)
    group = grouped(centroids, min(groups or max(1, k // 4), len(centroids)))
    group = np.unique(group, return_inverse=True)[1]
    with scratch(spark):
        rows = stored(first_round(points, centroids, group), "round-0", keep=rounds == 0)
        for r in range(rounds):
            after = means(rows, centroids)
            moved = np.sqrt(((after - centroids).astype(float) ** 2).sum(1)) * (1 + MARGIN)
            rows = stored(next_round(rows, after, moved, group), f"round-{r + 1}", keep=r == rounds - 1)
            centroids = after
    rows = exact_distances(rows, centroids)
    parts = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    table = [(c, t, sum(x[1] for x in parts), centroids[c].tolist()) for c, t in parts]
    known = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    out = rows.join(F.broadcast(known), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "scanned")


def exact_distances(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance, scanned); a distance that no round has taken is taken now."""
    schema = "id long, cluster int, distance long, scanned int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, near = b.column(2).to_numpy(), b.column(3).to_numpy().copy()
            at = np.flatnonzero(near < 0)
            if len(at):
                near[at] = ((vectors_of(b.column(1))[at] - centroids[own[at]]) ** 2).sum(1)
            yield batch(schema, [b.column(0), b.column(2), near, b.column(4)])

    return rows.select("id", "vector", "cluster", "distance", "scanned").mapInArrow(run, schema)


def clustered_vectors(vectors: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return kmeans(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(text, 256).alias("centroid_sha256"))
