"""Exact k-means on integers by Sort-means: centroids are scanned in order of their distance from a vector's last one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

#: Components are scaled by this and rounded down.
SCALE = 1024
#: Largest magnitude of a scaled component: squared distances of 64 of them stay below 2^63.
LARGEST = 1 << 27
#: Most centroids: the driver and each task hold them, and their order from each one.
MOST_CENTROIDS = 1024


def whole_vectors(vectors: DataFrame, dimensions: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the components as integers floor(SCALE * component), of the rows that take part.

    Vectors that are null, of another length, or hold a null or non-finite component take no part, nor do those with a
    component beyond LARGEST, whose squared distances a long could not hold.
    """
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE))
    fit = F.forall(F.col(vector_col), lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= LARGEST / SCALE))  # NaN is above all numbers
    rows = vectors.filter((F.size(vector_col) == dimensions) & fit)
    return rows.select(F.col(id_col).alias("vec_id"), x.cast("array<int>").alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: int = 3) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order; ties by their components, a null id has no digits."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in rows.orderBy(key, "x").limit(k).collect()], np.int64)


class SortMeans:
    """Centroids with their squared distances from each other, and the order of the others from each."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.apart = np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        self.order = np.argsort(self.apart, axis=1, kind="stable")

    def assign(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row of x (ties: the smaller number) and its squared distance; last: each row's centroid so far.

        A centroid more than twice as far from the last one as the vector is can't be nearer, by the triangle
        inequality, so the scan of a vector stops strictly beyond that: squared, beyond 4 times its squared distance.
        """
        best, near = last.copy(), np.empty(len(x), np.int64)
        for c in np.unique(last):
            rows = np.nonzero(last == c)[0]
            distance = ((x[rows] - self.centroids[c]) ** 2).sum(axis=1)
            farthest_first = np.argsort(-distance, kind="stable")
            rows, reach = rows[farthest_first], 4 * distance[farthest_first].astype(object if distance.max(initial=0) >= 1 << 60 else np.int64)
            near[rows] = distance[farthest_first]
            for other in self.order[c]:
                scanning = rows[: np.searchsorted(-reach, -self.apart[c, other], side="right")]
                if not len(scanning):
                    break
                if other == c:
                    continue
                d = ((x[scanning] - self.centroids[other]) ** 2).sum(axis=1)
                nearer = (d < near[scanning]) | ((d == near[scanning]) & (other < best[scanning]))
                best[scanning[nearer]], near[scanning[nearer]] = other, d[nearer]
        return best, near


def _assigner(model: SortMeans) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, x, cluster, distance of each row; the first row of a batch also has its clusters' sums and counts."""
        k, width = model.centroids.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, width)
            cluster, distance = model.assign(x, batch.column(2).to_numpy().astype(np.int64))
            found, at = np.unique(cluster, return_inverse=True)
            sums = np.zeros((len(found), width + 1), np.int64)
            np.add.at(sums, at, np.column_stack([x, np.ones(len(x), np.int64)]))
            told = [[{"cluster": int(c), "sums": s} for c, s in zip(found, sums.tolist(), strict=True)], *[None] * (len(x) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()),
                pa.array(told, pa.list_(pa.struct([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))])))], ["vec_id", "x", "cluster",
                "distance", "told"])

    return assigned


def _moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by floor(sum / count) of its vectors, where it has any. Only the batches' sums are read."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.column(0).to_pylist():
                for part in row:
                    totals[part["cluster"]] = totals.get(part["cluster"], 0) + np.array(part["sums"], np.int64)
        for cluster, sums in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([cluster] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array(sums,
                pa.int64())], ["cluster", "at", "s"])

    parts = table.filter("told IS NOT NULL").select("told").mapInArrow(summed, "cluster int, at int, s long")
    new: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        new.setdefault(r.cluster, {})[r["at"]] = int(r.s)
    width = centroids.shape[1]
    out = centroids.copy()
    for cluster, sums in new.items():
        out[cluster] = [sums[i] // sums[width] for i in range(width)]
    return out


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, seed: int = 3, id_col: str = "vec_id",
        vector_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors are those of whole_vectors(), the first centroids those of first_centroids(). Each of the rounds assigns all
    vectors and moves the centroids; then vectors are assigned once more. All numbers are exact integers, so results
    don't depend on how rows are dealt. A round reads the table of the last one, whose clusters start its scans, and
    writes the next; sums travel with the first row of a batch, so that moving centroids reads that column alone. The
    driver holds k centroids and sums (MOST_CENTROIDS at most). Repeated rows are vectors like others, also as first
    centroids. Fewer vectors than k make as many centroids; none gives an empty result. Other columns are not read.
    """
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"k must be from 1 to {MOST_CENTROIDS}")
    spark = vectors.sparkSession
    small_batches(spark)
    rows = whole_vectors(vectors, dimensions, id_col, vector_col)
    kind = rows.dtypes[0][1]
    schema = f"vec_id {kind}, x array<int>, cluster int, distance long, told array<struct<cluster:int,sums:array<bigint>>>"
    table = written(rows.withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(table, k, seed)
    if not len(centroids):
        return table.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias(
            "inertia"), F.lit("").alias("centroid_sha256"))
    for n in range(rounds + 1):
        last, table = table, written(table.select("vec_id", "x", "cluster").mapInArrow(_assigner(SortMeans(centroids)), schema), f"assigned{n}")
        discard(last)
        if n < rounds:
            centroids = _moved(table, centroids)
    inertia = {r.cluster: int(r.d) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        "centroid_sha256")
