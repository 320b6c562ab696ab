"""Clustering of vectors around centroids, nearest centroids found by equal-average equal-variance search."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.workspace import write_through
from .frames import named, pieces

#: Vectors searched at once; scaled components stay below LIMIT, so a squared distance of 64 of them fits in a long.
ROWS, LIMIT = 2048, 1 << 27
#: How far a bound in doubles must be above the best distance before it counts.
SAFE = 1 + 1e-9
MOST = (1 << 63) - 1


@dataclass
class Centroids:
    """Centroids in the order of their component sums, with what the two inequalities need."""
    points: np.ndarray

    def __post_init__(self):
        self.numbers = np.lexsort((np.arange(len(self.points)), self.points.sum(1)))
        self.sorted = self.points[self.numbers]
        self.sums, self.deviations = spread(self.sorted)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid (ties: the smaller number) and the squared distance.

        With d components, sums S and deviations V (the length of a vector less its
        mean), a squared distance is at least (S_x - S_c)**2 / d + (V_x - V_c)**2.
        Centroids are visited outward from the vector's own sum.  If the first
        term of the nearer side is above the best distance, no centroid is left
        that could be nearer; if both terms are, this one is passed over.  What
        remains is measured in integers.
        """
        n, d, k = len(vectors), vectors.shape[1], len(self.sorted)
        sums, deviations = spread(vectors)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best, label = np.full(n, MOST), np.full(n, k)
        rows = np.arange(n)
        while len(rows):
            at = sums[rows]
            below = np.where(left[rows] >= 0, at - self.sums[np.maximum(left[rows], 0)], np.inf)
            above = np.where(right[rows] < k, self.sums[np.minimum(right[rows], k - 1)] - at, np.inf)
            up = above < below
            gap = np.minimum(above, below)
            by_mean = gap * gap / d
            open_ = np.isfinite(gap) & (by_mean <= best[rows] * SAFE)
            rows, up, by_mean = rows[open_], up[open_], by_mean[open_]
            place = np.where(up, right[rows], left[rows])
            right[rows] += up
            left[rows] -= ~up
            by_both = by_mean + (deviations[rows] - self.deviations[place]) ** 2
            near = by_both <= best[rows] * SAFE
            own, place = rows[near], place[near]
            step = vectors[own] - self.sorted[place]
            distance = np.einsum("ij,ij->i", step, step).astype(np.int64)
            number = self.numbers[place]
            better = (distance < best[own]) | ((distance == best[own]) & (number < label[own]))
            best[own[better]], label[own[better]] = distance[better], number[better]
        return label, best


def spread(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component sums, and lengths of the vectors less their means, in doubles."""
    exact = vectors.astype(np.float64)
    sums = exact.sum(1)
    return sums, np.sqrt(((exact - (sums / exact.shape[1])[:, None]) ** 2).sum(1))


def scaled(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """id and integer components floor(scale * x) of the vectors that take part."""
    rows = vectors.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("v"))
    inside = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(LIMIT) / scale))
    return rows.filter((F.size("v") == dims) & inside).select(
        "id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integers of 32 bits where squared distances fit into them, else of 64."""
    found = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return found.astype(np.int32 if np.abs(found).max(initial=0) < 1 << 11 and dims < 128 else np.int64)


def _searched(batches: Iterator[pa.RecordBatch], points: np.ndarray) -> Iterator[tuple]:
    known = Centroids(points)
    narrow = np.abs(points).max(initial=0) < 1 << 11
    small = Centroids(points.astype(np.int32)) if narrow else None
    for batch in pieces(batches, ROWS):
        vectors = _matrix(batch.column(1), points.shape[1])
        if vectors.dtype == np.int32 and not narrow:
            vectors = vectors.astype(np.int64)
        yield batch, vectors, *(small if vectors.dtype == np.int32 else known).nearest(vectors)


def cluster_sums(rows: DataFrame, points: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sums of components per non-empty cluster: one row per cluster comes to the driver."""
    k, dims = points.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, vectors, label, _ in _searched(batches, points):
            order = np.argsort(label, kind="stable")
            own, starts = np.unique(label[order], return_index=True)
            sums[own] += np.add.reduceat(vectors[order].astype(np.int64), starts)
            counts += np.bincount(label, minlength=k)
        own = np.flatnonzero(counts)
        if len(own):
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(counts[own]), *[pa.array(c) for c in np.ascontiguousarray(sums[own].T)]], names)

    names = ["cluster", "n", *[f"s{i}" for i in range(dims)]]
    parts = rows.mapInArrow(summed, ", ".join(f"{c} long" for c in names))
    total = parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names[1:]])
    return {r[0]: (r[1], list(r[2:])) for r in total.collect()}


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dims: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector of ``dims`` finite components: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become integers floor(scale * x).  The ``k`` vectors with the
    smallest SHA-256 of ``seed:id`` are the first centroids, in that order.  Each
    round assigns all vectors and moves every non-empty centroid to the floored
    mean of its vectors; then vectors are assigned once more.  Distances are
    squared; a tie goes to the smaller number.  ``cluster_inertia`` and
    ``inertia`` sum the distances of the cluster and of all.

    Vectors are written once as integers and read in every round.  A task adds up
    its own vectors, so one row per task and cluster is shuffled and one per
    cluster reaches the driver, however large a cluster is.

    Null vectors, and vectors of another length or with a null, non-finite or
    huge component (2**27 or more after scaling, for which a squared distance
    might not fit in a long) take no part.  A vector without an id is clustered,
    but starts no cluster.  Rows with equal ids are separate vectors.  Fewer than
    ``k`` vectors make as many clusters; without vectors the result is empty.  An
    inertia that doesn't fit in a long is null.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = write_through(scaled(vectors, id_col, vector_col, dims, scale), "scaled_vectors")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.filter("id IS NOT NULL").select(place.alias("place"), "v").orderBy("place", "v").limit(k).collect()
    points = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    schema = f"`{id_col.replace('`', '``')}` long, cluster int, distance long"
    if not first:
        none = "cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"{schema}, {none}")
    for _ in range(rounds):
        for number, (n, sums) in cluster_sums(rows, points).items():
            points[number] = [s // n for s in sums]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, label, distance in _searched(batches, points):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label.astype(np.int32)), pa.array(distance)], [id_col, "cluster", "distance"])

    out = write_through(rows.mapInArrow(assigned, schema), "assigned_vectors")
    inertia = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fitting = lambda total: total if total <= MOST else None
    digest = lambda point: hashlib.sha256(",".join(map(str, point.tolist())).encode()).hexdigest()
    facts = [(number, fitting(own), fitting(sum(inertia.values())), digest(points[number])) for number, own in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(named(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
