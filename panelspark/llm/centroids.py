"""Centroid clustering in integers, each vector's nearest centroid found by Orchard's search.

Every centroid has a list of the others, nearest first. A vector follows the list of the nearest centroid
it knows, jumps to the list of a closer one as soon as it finds it, never measures a centroid twice, and
stops where the list's centroid is strictly more than twice as far from the current one as the vector is:
none behind it can be as near. Distances are exact integers, so ties have a defined winner.

Tasks hold one Arrow batch and the centroids; a round sends one row of sums per task and centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import ship, stored

SCALE = 256
#: Components beyond this have squared distances that a long cannot hold.
LARGEST = 1 << 27


def quantise(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(id, components as little-endian int32) of the vectors that count."""
    for batch in batches:
        column = batch.column(1)
        kept = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
        ids, column = batch.column(0).filter(kept), column.filter(kept)
        flat = pc.cast(column.flatten(), pa.float64())
        x = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).reshape(-1, size))
        fine = np.all(np.isfinite(x) & (np.abs(x) <= LARGEST), axis=1)
        if flat.null_count:
            fine &= np.asarray(flat.is_valid()).reshape(-1, size).all(axis=1)
        data = x[fine].astype("<i4")
        rows = pa.array([r.tobytes() for r in data], pa.binary())
        yield pa.RecordBatch.from_arrays([ids.filter(pa.array(fine)), rows], names=["_id", "_q"])


class Orchard:
    """Centroids with their sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        k = len(centroids)
        gap = np.stack([((self.centroids - c) ** 2).sum(axis=1) for c in self.centroids]) if k else np.zeros((0, 0), np.int64)
        order = np.array([[j for j in np.lexsort((np.arange(k), gap[i])) if j != i] for i in range(k)], np.int64).reshape(k, max(k - 1, 0))
        #: a quarter of the squared distance, rounded up: at most the vector's own unless the centroid is more than twice as far
        self.order, self.quarter = order, -(-np.take_along_axis(gap, order, axis=1) // 4)
        self.start = int(gap.sum(axis=1, dtype=np.float64).argmin()) if k else 0
        #: vectors measured against centroids so far, for tests and figures
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row; ties go to the smaller number."""
        n, k = len(x), len(self.centroids)
        small = max(int(np.abs(x).max(initial=0)), int(np.abs(self.centroids).max(initial=0))) <= 1 << 22
        kind = np.float64 if small else np.int64  # below 2^22 every sum of 64 squares is a whole number below 2^53
        x, centroids = x.astype(kind), self.centroids.astype(kind)

        def squared(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
            step = x[rows] - centroids[numbers]
            return np.einsum("ij,ij->i", step, step).astype(np.int64)

        now, at = np.full(n, self.start, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        best = squared(live, now)
        seen = np.zeros((n, k), bool)
        seen[:, self.start] = True
        self.measured += n
        while k > 1 and live.size:
            live = live[at[live] < k - 1]
            live = live[self.quarter[now[live], at[live]] <= best[live]]
            found = self.order[now[live], at[live]]
            at[live] += 1
            fresh = ~seen[live, found]
            rows, found = live[fresh], found[fresh]
            seen[rows, found] = True
            gap = squared(rows, found)
            self.measured += len(rows)
            closer = (gap < best[rows]) | ((gap == best[rows]) & (found < now[rows]))
            rows = rows[closer]
            now[rows], best[rows], at[rows] = found[closer], gap[closer], 0
        return now, best


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


def assigned(batches: Iterator[pa.RecordBatch], tree: Orchard, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        now, best = tree.nearest(_vectors(batch, size))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(now.astype(np.int32)), pa.array(best)],
                                         names=["_id", "cluster", "distance"])


def summed(batches: Iterator[pa.RecordBatch], tree: Orchard, size: int) -> Iterator[pa.RecordBatch]:
    """One row of counts and component sums per centroid of the task."""
    k = len(tree.centroids)
    count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
    for batch in batches:
        x = _vectors(batch, size)
        now, _ = tree.nearest(x)
        order = np.argsort(now, kind="stable")
        first = np.flatnonzero(np.diff(now[order], prepend=-1))
        if len(first):
            total[now[order][first]] += np.add.reduceat(x[order], first, axis=0)
        count += np.bincount(now, minlength=k)
    held = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), *[pa.array(total[held, i]) for i in range(size)]],
                                     names=["cluster", "n", *[f"s{i}" for i in range(size)]])


def first_centroids(vectors: DataFrame, k: int, seed: str, size: int) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of seed and id; missing ids last, equal ids by components."""
    name = F.sha2(F.concat(F.lit(seed), F.col("_id").cast("string")), 256)
    rows = vectors.orderBy(name.asc_nulls_last(), "_q").limit(k).select("_q").collect()
    return np.frombuffer(b"".join(bytes(r[0]) for r in rows), "<i4").reshape(-1, size).astype(np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:", size: int = 64,
                    key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts.

    A vector counts if it has ``size`` components, none missing or not finite, and none beyond
    2^27 / 256 = 524288 in size, whose squared distance no long could hold. Every row is a vector of
    its own: repeated rows and rows without an id are kept and weigh as often as they stand there. With fewer
    than ``k`` vectors there are as many centroids; an empty table gives no rows. Other columns are not read.
    The driver holds ``k`` centroids, and between rounds ``k`` rows of sums.
    """
    spark = ship(vectors.sparkSession)
    kind = vectors.schema[key].dataType
    shape = T.StructType([T.StructField("_id", kind), T.StructField("_q", T.BinaryType())])
    rows = stored(vectors.select(F.col(key).alias("_id"), F.col(column)).mapInArrow(partial(quantise, size=size), shape), "vectors")
    centroids = first_centroids(rows, k, seed, size)
    if not len(centroids):
        return spark.createDataFrame([], T.StructType([T.StructField(key, kind)]).add("cluster", T.IntegerType()).add("distance", T.LongType())
                                     .add("cluster_inertia", T.LongType()).add("inertia", T.LongType()).add("centroid_sha256", T.StringType()))
    sums = "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(size))
    for _ in range(rounds):
        moved = rows.mapInArrow(partial(summed, tree=Orchard(centroids), size=size), sums).groupBy("cluster").agg(
            F.sum("n").alias("n"), *[F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)])
        for row in moved.collect():  # at most k rows
            centroids[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(size)]
    shape = T.StructType([T.StructField("_id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    found = stored(rows.mapInArrow(partial(assigned, tree=Orchard(centroids), size=size), shape), "assigned")
    names = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())], "cluster int, parts string")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = each.join(names, "cluster").select("cluster", "cluster_inertia", F.sha2("parts", 256).alias("centroid_sha256"))
    each = each.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))  # k rows
    return (found.join(F.broadcast(each), "cluster")  # at most k rows
            .select(F.col("_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
