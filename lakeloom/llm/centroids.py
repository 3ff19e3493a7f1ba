"""Centroid clustering by a bisector tournament.

A vector x is nearer to centroid j than to centroid i exactly when
2 (c_j - c_i) . x > |c_j|^2 - |c_i|^2. Normals and thresholds of all pairs
i < j are made once per round from the integer centroids. Each vector then plays
k - 1 sign tests: the winner so far against the next centroid, whose loser is
out. Zero lets the smaller number win, and the winner so far is always the
smaller number, so the result is the nearest centroid with ties to the smaller
number. Only the winner's distance is then computed. All of it is integer
arithmetic (in floating point where every value stays below 2^53, which is
exact too).

A round's sums and counts are added up inside each task, so k * (dims + 1) rows
per task are shuffled and k * (dims + 1) numbers reach the driver, however many
vectors there are. The integer vectors are written once to the shared folder and
read by every round; a lost executor costs its own tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .vectors import ID, VEC, drop, integers, kept, matrix, slot_sums


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        c = centroids.astype(np.int64)
        self.centroids, self.size = c, int(np.abs(c).max(initial=0))
        self.normals = 2 * (c[None, :, :] - c[:, None, :])
        square = (c * c).sum(axis=1)
        self.thresholds = square[None, :] - square[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of every row of ``x``."""
        most = max(self.size, int(np.abs(x).max(initial=0)))
        kind = np.float64 if 8 * x.shape[1] * (most + 1) ** 2 < 1 << 53 else np.int64
        y, normals, thresholds = x.astype(kind), self.normals.astype(kind), self.thresholds.astype(kind)
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", y, normals[best, j]) - thresholds[best, j]
            best[side > 0] = j
        return best

    def distances(self, x: np.ndarray, best: np.ndarray) -> np.ndarray:
        gap = x - self.centroids[best]
        return (gap * gap).sum(axis=1)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose ``salt:id`` has the ``k`` smallest SHA-256 digests, in
    that order. Rows alike in id go by their components, rows without an id
    come last; fewer than ``k`` vectors give as many centroids."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(ID).cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), F.col(VEC)).limit(k).select(VEC).collect()
    return np.array([r[0] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes floor(sum / count)."""
    k, dims = centroids.shape
    pairs = Bisectors(centroids)

    def count(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0), dims)
        best, total = pairs.winners(x), np.zeros((k, dims + 1), np.int64)
        np.add.at(total[:, :dims], best, x)
        total[:, dims] = np.bincount(best, minlength=k)
        return total.ravel()

    got, out = slot_sums(vectors.select(VEC), count), centroids.copy()
    for c in range(k):
        n = got.get(c * (dims + 1) + dims, 0)
        if n:
            out[c] = [got.get(c * (dims + 1) + d, 0) // n for d in range(dims)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims, pairs = centroids.shape[1], Bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dims)
            best = pairs.winners(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(pairs.distances(x, best))],
                                             names=[id_col, "cluster", "distance"])

    rows = vectors.select(F.col(ID).alias(id_col), VEC)
    schema = rows.drop(VEC).schema.add("cluster", "integer").add("distance", "long")
    return rows.mapInArrow(run, schema)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 64,
            k: int = 16, rounds: int = 3, salt: str = "1") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector that is kept, and the centroids.

    Dropped are rows whose vector is null, has another length than ``dims`` or
    holds a null or non-finite component. Repeated rows count as often as they
    occur; a null id is kept. Only the two named columns are read, so others may
    have any name. A table without a usable vector gives an empty result and no
    centroids. A component beyond the limit of ``vectors`` raises.
    """
    prepare(df.sparkSession)
    vectors, folder = kept(integers(df, [F.col(id_col).alias(ID)], vec_col, dims, scale), "op11-vectors")
    centroids = first_centroids(vectors, k, salt)
    if not len(centroids):
        return vectors.select(F.col(ID).alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    out, _ = kept(assigned(vectors, centroids, id_col), "op11-clusters")
    drop(vectors, folder)
    return out, centroids.tolist()


def digest(numbers: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def with_inertia(clusters: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``cluster``'s result with cluster_inertia, inertia and centroid_sha256.
    The join's other side has one row per centroid."""
    spark, schema = clusters.sparkSession, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    per = {r.cluster: int(r.d) for r in clusters.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    rows = [(c, per[c], sum(per.values()), digest(centroids[c])) for c in sorted(per)]
    return clusters.join(F.broadcast(spark.createDataFrame(rows, schema)), "cluster")
