"""Centroid clustering of quantised vectors, on distinct vectors with their multiplicities.

1. Vectors become integers, floor(1024 x), and equal ones are grouped and counted;
   counts are combined before the shuffle, so a vector that a third of all rows
   have is one row per task.
2. Lloyd's rounds run on the distinct vectors. A task adds up count times vector for
   each centroid in 64-bit integers; Spark adds up the tasks' sums, and the driver
   gets one number per centroid and component. All arithmetic is exact.
3. The clusters of distinct vectors are joined back to the rows. Of a vector that
   very many rows have, adaptive execution splits the rows' side.

Defined cases: a vector that is null, has another number of components than
``DIMENSIONS``, or one that is null or not finite, is left out; equal distances go to the
centroid with the smaller number; a centroid without vectors stays where it is;
of fewer vectors than centroids each begins one; rows with equal ids are all
kept, and their vectors order them where hashes are equal; rows with a null id come
last in that order; other columns are ignored; an empty table gives no rows. A component
of 131,072 or more is an error, since distances need not fit into 64 bits then.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import col, stored

DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
#: Components from here on are an error: 64 squares of twice as much still fit into 64 bits.
MOST = 1 << 27


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors that are whole and finite, as integers."""
    x = col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.where(F.coalesce((F.size(x) == DIMENSIONS) & finite, F.lit(False)))

    def integer(c: Column) -> Column:
        big = F.floor(F.lit(float(SCALE)) * c.cast("double"))
        return F.when((big < MOST) & (big >= -MOST), big.cast("int")).otherwise(F.raise_error(F.lit("a component of a vector is too large to cluster by")).cast("int"))

    return whole.select(col(id_col).alias("vec_id"), F.transform(x, integer).alias("v"))


def first_centroids(rows: DataFrame, n: int = CENTROIDS) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    named = rows.select(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v")
    return np.array([r["v"] for r in named.orderBy(F.asc_nulls_last("h"), "v").limit(n).collect()], np.int64).reshape(-1, DIMENSIONS)


def _nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector, and its squared distance."""
    apart = np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = apart.argmin(axis=1)
    return at, apart[np.arange(len(v)), at]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the centroids at the floor of the mean of their vectors."""

    def run(batches):
        sums = np.zeros((len(centroids), DIMENSIONS + 1), np.int64)
        for batch in batches:
            v, n = _matrix(batch.column(0)), batch.column(1).to_numpy()
            at, _ = _nearest(v, centroids)
            np.add.at(sums, at, np.concatenate([v * n[:, None], n[:, None]], axis=1))
        k, i = np.divmod(np.arange(sums.size), DIMENSIONS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(sums.ravel())], names=["k", "i", "s"])

    out = centroids.copy()
    found = {(r["k"], r["i"]): r["s"] for r in distinct.select("v", "n").mapInArrow(run, "k int, i int, s long").groupBy("k", "i").agg(F.sum("s").alias("s")).collect()}
    for k in range(len(centroids)):
        if n := found.get((k, DIMENSIONS)):
            out[k] = [found[k, i] // n for i in range(DIMENSIONS)]
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """v, n, cluster, distance of each distinct vector."""

    def run(batches):
        for batch in batches:
            at, apart = _nearest(_matrix(batch.column(0)), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.list_(pa.int32())), batch.column(1), pa.array(at, pa.int32()), pa.array(apart)], names=["v", "n", "cluster", "distance"])

    return distinct.select("v", "n").mapInArrow(run, "v array<int>, n long, cluster int, distance long")


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is not left out."""
    spark, rows = vectors.sparkSession, quantised(vectors, id_col, vector_col)
    distinct = stored(rows.groupBy("v").agg(F.count("*").alias("n")), "distinct-vectors")
    at = first_centroids(rows, centroids)
    if not len(at):
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        at = moved(distinct, at)
    found = stored(assigned(distinct, at), "assigned-vectors")
    # one row per centroid
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance")).alias("s")).collect()}
    total = sum(sums.values())
    told = [(k, sums.get(k, 0), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(at)]
    table = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    each = rows.join(found.select("v", "cluster", "distance"), "v")
    return each.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
