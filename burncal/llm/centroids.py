"""Centroid clustering: sort-means.

Each round the other centroids are sorted by their distance from each centroid. A vector starts at the centroid that it was assigned to and looks at
the others in that order, up to the first that lies strictly beyond twice its distance from its own: by the triangle inequality none from there on is as
near. So distances to far centroids are never computed, and ties still find the smaller number. All arithmetic is on integers, so sums don't
depend on their order.

Scale. A vector is a row of integers and the number of its cluster, written anew each round with the new number, so that a lost executor costs
a read and no lineage grows; the table of the round before is removed. Nothing is shuffled but the sums of each task's vectors, one row for each cluster
and task; the driver has the centroids. So it makes no difference how large a cluster is or how often a vector is repeated.

Cases: vectors that are null, have another number of components, or null or non-finite ones are left out; of rows with one vec_id the one with the
smaller components comes first; a null vec_id can't start a centroid while there are others; with fewer vectors than k each starts one;
vectors that are alike, centroids too, go to the smaller number; clusters without vectors keep their centroid; an empty table, or one without any
vector that is kept, gives an empty result; further columns are ignored. A component of 2**17 or more in magnitude is refused with an error, as squared
distances would not fit in a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burncal.llm.common import small_batches
from burncal.session import discard, table_of

SIZE, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
LIMIT = 1 << 27  # of a component's integer
BATCH = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (of equals the smallest number), its squared distance, and how many distances were computed."""
    between = squared(centroids[:, None], centroids[None])
    best, least, tested = before.copy(), np.zeros(len(x), np.int64), 0
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        own = squared(x[rows], centroids[a])
        number, distance = np.full(len(rows), a), own.copy()
        tested += len(rows)
        left = np.arange(len(rows))
        for c in np.argsort(between[a], kind="stable"):
            if c == a:
                continue
            left = left[between[a, c] <= 4 * own[left]]  # the others are done: all that follow are further away
            if not len(left):
                break
            d = squared(x[rows[left]], centroids[c])
            tested += len(left)
            nearer = (d < distance[left]) | ((d == distance[left]) & (c < number[left]))
            number[left[nearer]], distance[left[nearer]] = c, d[nearer]
        best[rows], least[rows] = number, distance
    return best, least, tested


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, v (integers), cluster 0: the vectors that count."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    v = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).filter((F.size("x") == size) & F.forall("x", finite))
    held = F.transform("x", lambda x: F.when(F.abs(x) < LIMIT / scale, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("component too large")).cast("int")))
    return good.select("vec_id", held.alias("v"), F.lit(0).alias("cluster"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)


def assigned(rows: DataFrame, centroids: np.ndarray, distance: bool = False) -> DataFrame:
    """The rows with the number of the nearest centroid, and its distance."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                number, least, _ = assign(_matrix(batch), batch.column("cluster").to_numpy().astype(np.int64), centroids)
                found = [batch.column("vec_id"), batch.column("v"), pa.array(number.astype(np.int32))]
                yield pa.record_batch([*found, pa.array(least)][: 4 if distance else 3], ["vec_id", "v", "cluster", "distance"][: 4 if distance else 3])

    small_batches(rows.sparkSession, BATCH)
    return rows.mapInArrow(run, "vec_id long, v array<int>, cluster int" + (", distance long" if distance else ""))


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; those without vectors stay."""

    def run(batches):
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            number = batch.column("cluster").to_numpy()
            np.add.at(sums, number, _matrix(batch)) if batch.num_rows else None
            counts += np.bincount(number, minlength=len(counts))
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    small_batches(rows.sparkSession, BATCH)
    partial = rows.select("v", "cluster").mapInArrow(run, "cluster int, n long, s array<long>")
    each = partial.select("cluster", "n", F.posexplode("s").alias("k", "s"))  # k * size rows for each task
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = centroids.copy()
    for r in each.groupBy("cluster", "k").agg(exact("n").alias("n"), exact("s").alias("s")).collect():
        found[r.cluster, r.k] = int(r.s) // int(r.n)
    return found


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), len(first[0].v) if first else 0)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, v, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows, path = table_of(kept(vectors, id_col, vector_col, size, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        rows, after = table_of(assigned(rows, centroids), "vectors")
        discard(spark, path)
        path, centroids = after, moved(rows, centroids)
    found, last = table_of(assigned(rows, centroids, True), "vectors")
    discard(spark, path)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(sums.values())
    named = [(i, sums[i], whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist()) if i in sums]
    told = F.broadcast(spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return found.join(told, "cluster").select("vec_id", "v", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
