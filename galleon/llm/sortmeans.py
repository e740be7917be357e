"""Centroid clustering of vectors by sort-means, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleon.llm.common import stored

#: Integer components are below this in size, so that every squared distance of 64 places fits in a long.
LARGEST = 1 << 27


def integer_vectors(rows: DataFrame, places: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of exactly ``places`` finite components, each as floor(scale * x)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    largest = float(LARGEST // scale)
    # A NaN is larger than every number here, so it fails the comparison like an infinity.
    usable = (F.size(v) == places) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < largest))
    return rows.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"))


def centroid_order(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all centroids by squared distance from it, itself first, and those distances."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(apart, -1)  # a twin of a centroid must not come before it
    order = np.argsort(apart, axis=1, kind="stable")
    apart = np.take_along_axis(apart, order, 1)
    apart[:, :1] = 0
    return order, apart


def assign(v: np.ndarray, before: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector, its squared distance, and the number of distances computed.

    A vector at distance d from the centroid it had before scans the others in
    their order from that one. One that is strictly more than 2d away from it is
    farther than d from the vector, and so are all that follow. One at exactly 2d
    may tie, and a tie goes to the smaller number.
    """
    best, least, computed = before.copy(), np.zeros(len(v), np.int64), 0
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        start = ((v[rows] - centroids[c]) ** 2).sum(1)
        computed += len(rows)
        far = np.argsort(-start, kind="stable")
        rows, start = rows[far], start[far]
        own, near = np.full(len(rows), c, before.dtype), start.copy()
        # Vectors from far to near: those still scanning are a prefix that shrinks.
        active = np.searchsorted(-start, -((apart[c] + 3) // 4), "right")
        for other, n in zip(order[c, 1:], active[1:], strict=True):
            if not n:
                break
            d = ((v[rows[:n]] - centroids[other]) ** 2).sum(1)
            computed += int(n)
            closer = (d < near[:n]) | (d == near[:n]) & (other < own[:n])
            near[:n][closer], own[:n][closer] = d[closer], other
        best[rows], least[rows] = own, near
    return best, least, computed


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vectors`` (vec_id, v, cluster) with the nearest centroid, and its distance."""
    order, apart = centroid_order(centroids)
    places = centroids.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).flatten(), np.int64).reshape(batch.num_rows, places)
            best, least, _ = assign(v, np.array(batch.column(2)), centroids, order, apart)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int32()), pa.array(least, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(scan, f"vec_id {dict(vectors.dtypes)['vec_id']}, v array<int>, cluster int, distance long")


def sort_means(rows: DataFrame, clusters: int = 16, rounds: int = 3, places: int = 64, scale: int = 64, salt: str = "1:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cluster integer vectors: ``rounds`` of assignment and update by sort-means, then a last assignment.

    Centroids start as the ``clusters`` vectors with the smallest sha256 of
    ``salt`` and the id. In each round every vector is assigned to its nearest
    centroid, by scanning from the one it had, and every centroid that has
    vectors moves to the floor of their mean. Each round reads and writes the
    vectors with their assignment once, without a shuffle; sums of a cluster are
    made by partial aggregation, so only ``clusters`` rows of sums reach the
    driver, whatever the size of the table or of a cluster.

    Returns (vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256), a row for each kept vector. Null vectors, vectors with
    another number of components, and those with a null or non-finite component
    are left out, and so are those with an integer component of 2^27 or more,
    whose squared distance need not fit in a long. A null id is written as
    ``null`` in the hash; of repeated rows each is a row, and ties of the hash go
    to the smaller vector. With fewer vectors than ``clusters`` each is a
    centroid; an empty table gives no row. A sum that exceeds a long is null.
    """
    spark = rows.sparkSession
    vectors = stored(integer_vectors(rows, places, scale, id_col, vector_col).withColumn("cluster", F.lit(0)), "vectors")
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = vectors.select(named.alias("name"), "v").orderBy("name", "v").limit(clusters).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, places)
    if not len(centroids):
        none = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in none.split(", ")]).limit(0)
    for _ in range(rounds):
        vectors = stored(_assigned(vectors, centroids), "assigned")
        sums = vectors.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[k].cast("long")) for k in range(places)]).alias("sums"))
        centroids = centroids.copy()
        for r in sums.collect():
            centroids[r.cluster] = [s // r.n for s in r.sums]
    found = stored(_assigned(vectors, centroids).select("vec_id", "cluster", "distance"), "assigned")
    inertia = {r.cluster: int(r.inertia) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia")).collect()}
    total = sum(inertia.values())
    as_long = lambda x: x if x < 1 << 63 else None
    about = [(k, as_long(x), as_long(total), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, x in sorted(inertia.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
