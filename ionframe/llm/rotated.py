"""Centroid clustering of integer vectors, exact, with centroids ruled out by PCA-rotated coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionframe.llm import common

#: Rotated coordinates that are stored; the rest of a vector is one norm.
LEADING = 16
#: Components lie in [-LARGEST, LARGEST): squared distances of up to 64 of them fit 64 bits.
LARGEST = 1 << 27
#: What rounding may take from a lower bound, as a share of the squared lengths.
SLACK = 1e-9
#: Vectors whose bounds are in memory at a time.
ROWS = 2048


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of the vectors with exactly `dims` components, none null or non-finite."""
    x = F.col(embedding).cast("array<double>")
    sound = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & (F.floor(v * scale) >= -LARGEST) & (v * scale < LARGEST))
    # A null or NaN component makes the condition null or false.
    return vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("vector")
    )


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind)


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthonormal columns, the directions of most variance first, from the sums and products of all vectors."""

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column(1), dims, float)])
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "total"])

    found = vectors.mapInArrow(moments, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
    total = np.zeros((dims + 1) ** 2)
    for row in found:
        total[row.place] = row.total
    total = total.reshape(dims + 1, dims + 1)
    mean = total[0, 1:] / max(total[0, 0], 1)
    _, axes = np.linalg.eigh(total[1:, 1:] / max(total[0, 0], 1) - np.outer(mean, mean))
    return axes[:, ::-1].copy()


class Filter:
    """Centroids as integers, and rotated: leading coordinates and the norm of the rest."""

    def __init__(self, centroids: list[list[int]], axes: np.ndarray, leading: int):
        self.exact = np.array(centroids, np.int64)
        self.lead, self.rest = rotated(self.exact, axes, leading)
        self.length = (self.exact.astype(float) ** 2).sum(1)

    def bounds(self, lead: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """For each vector and centroid: squared distance of leading coordinates plus squared difference of the rests' norms, no
        more than the squared distance."""
        near = (lead**2).sum(1)[:, None] + (self.lead**2).sum(1) - 2 * lead @ self.lead.T
        return near + (rest[:, None] - self.rest) ** 2

    def nearest(self, vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid, ties to the smaller number, and how many distances were
        taken in integers."""
        clusters, distances, verified = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64), 0
        for start in range(0, len(vectors), ROWS):
            part = slice(start, start + ROWS)
            x, bound = vectors[part], self.bounds(lead[part], rest[part])
            guess = bound.argmin(1)
            known = ((x - self.exact[guess]) ** 2).sum(1)
            slack = SLACK * ((lead[part] ** 2).sum(1) + rest[part] ** 2 + self.length.max() + 1)
            rows, columns = np.nonzero(bound <= (known + slack)[:, None])
            exact = np.full(bound.shape, np.iinfo(np.int64).max)
            exact[rows, columns] = ((x[rows] - self.exact[columns]) ** 2).sum(1)
            clusters[part] = exact.argmin(1)  # of equal ones the first
            distances[part] = exact.min(1)
            verified += len(rows) + len(x)
        return clusters, distances, verified


def rotated(vectors: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    turned = vectors @ axes
    return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(1))


def stored(vectors: DataFrame, axes: np.ndarray, leading: int) -> DataFrame:
    """(vec_id, vector, lead, rest), written to the shared folder: every round reads it."""
    dims = len(axes)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotated(_matrix(batch.column(1), dims, float), axes, leading)
            lead = pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), lead.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), batch.column(1), lead, pa.array(rest)], names=["vec_id", "vector", "lead", "rest"])

    return common.staged(vectors.mapInArrow(rows, "vec_id long, vector array<int>, lead array<double>, rest double"))


def _assigned(batch: pa.RecordBatch, to: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vectors = _matrix(batch.column("vector"), to.exact.shape[1], np.int64)
    lead = _matrix(batch.column("lead"), to.lead.shape[1], float)
    clusters, distances, _ = to.nearest(vectors, lead, batch.column("rest").to_numpy())
    return vectors, clusters, distances


def sums(table: DataFrame, to: Filter) -> DataFrame:
    """(cluster, place, total, n): per task the sums of each cluster's components, added up exactly."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(to.exact.shape, np.int64), np.zeros(len(to.exact), np.int64)
        for batch in batches:
            vectors, clusters, _ = _assigned(batch, to)
            np.add.at(total, clusters, vectors)
            n += np.bincount(clusters, minlength=len(n))
        used = np.flatnonzero(n)
        dims = total.shape[1]
        columns = [np.repeat(used, dims), np.tile(np.arange(dims), len(used)), total[used].ravel(), np.repeat(n[used], dims)]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["cluster", "place", "total", "n"])

    made = table.mapInArrow(rows, "cluster long, place long, total long, n long")
    return made.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def distances(table: DataFrame, to: Filter) -> DataFrame:
    """(vec_id, cluster, distance)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, clusters, found = _assigned(batch, to)
            yield pa.record_batch(
                [batch.column("vec_id"), pa.array(clusters, pa.int32()), pa.array(found)], names=["vec_id", "cluster", "distance"]
            )

    return table.mapInArrow(rows, "vec_id long, cluster int, distance long")


_RESULT = T.StructType([
    T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()),
    T.StructField("centroid_sha256", T.StringType()),
])


def cluster(
    spark: SparkSession, vectors: DataFrame, clusters: int = 40, rounds: int = 5, seed: str = "2:", scale: int = 256, dims: int = 64,
    vec_id: str = "vec_id", embedding: str = "embedding", leading: int = LEADING,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors with exactly `dims` components, none null or non-finite; a component becomes floor(scale * x). The first
    centroids are the `clusters` kept vectors with the smallest SHA-256 of seed and vec_id, in the order of that hash; equal ids (a null one
    counts as an empty text) follow the order of their components. In each round every vector goes to the nearest
    centroid, ties to the smaller number, and every centroid with vectors becomes the floor of their mean; after the
    last one all are assigned once more. All that is integer arithmetic.

    The rotation comes from the sums and products of all kept vectors. Stored are the leading rotated coordinates and the norm of the
    rest, which bound every distance from below; only centroids whose bound reaches the distance to the most promising one are compared in integers. The
    driver holds the centroids and their sums (clusters x dims numbers), tasks return no more than that; the clusters' own figures
    join as a table of at most `clusters` rows.

    No kept vector, no rows; fewer vectors than clusters, fewer centroids. Repeated rows count each. Other columns are not read. Components
    outside [-2**27, 2**27) after scaling are not kept, because squared distances would not fit 64 bits; an inertia that does not is
    null."""
    table = integer_vectors(vectors, vec_id, embedding, dims, scale)
    axes = rotation(table, dims)
    table = stored(table, axes, leading)
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.vector) for r in table.orderBy(name, "vector").limit(clusters).select("vector").collect()]
    if centroids:
        for _ in range(rounds):
            for row in sums(table, Filter(centroids, axes, leading)).collect():
                centroids[row.cluster][row.place] = int(row.total) // row.n
        table = common.staged(distances(table, Filter(centroids, axes, leading)))
        own = {r.cluster: int(r.total) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    else:
        table, own = spark.createDataFrame([], "vec_id long, cluster int, distance long"), {}
    fits = lambda n: n if n < 1 << 63 else None
    figures = [
        (k, fits(total), fits(sum(own.values())), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())
        for k, total in own.items()
    ]
    return table.join(F.broadcast(spark.createDataFrame(figures, _RESULT)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
