"""Lloyd's clustering of quantised vectors, each distinct vector once with its multiplicity.

Vectors are turned into integers and grouped, so that a vector that repeats costs one row with a weight.
Rounds run over the distinct vectors: a task adds weighted integer sums for each centroid, Spark adds the
tasks' sums, and only k x (dims + 1) exact totals come to the driver.  The last assignment is joined back to
the ids on a digest of the vector, salted, so that a vector with many rows is not one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed, hot_lookup, named, shared_path

#: Up to here doubles hold all sums of products of up to 512 components without rounding.
EXACT = 1 << 21
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component, for vectors of ``dims`` finite components; others are left out."""
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), F.transform(named(vector_col), lambda x: x.cast("double")).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("x") == dims) & finite).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("q"))


def seeds(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:id``; ids that repeat go by vector, null ids come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.q for r in rows.orderBy(digest.asc_nulls_last(), "q").limit(k).select("q").collect()]


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the smaller number among equals) and the squared distance, exactly."""
    if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT and q.shape[1] <= 512:
        a, c = q.astype("f8"), centroids.astype("f8")
        apart = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
        at = apart.argmin(1)
        return at, apart[np.arange(len(a)), at].astype("i8")
    a, c = q.astype(object), centroids.astype(object)  # whole numbers of any size
    apart = np.stack([((a - x) ** 2).sum(1) for x in c], 1)
    at = np.array([min(range(len(c)), key=lambda j: (d[j], j)) for d in apart], "i8")
    return at, apart[np.arange(len(a)), at]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def totals(distinct: DataFrame, centroids: list[list[int]], dims: int) -> dict[tuple[int, int], int]:
    """Weighted sums by (centroid, component), and weights with component -1, of each centroid's vectors."""
    sent = np.array(centroids, object if max(abs(x) for c in centroids for x in c) > LONG else "i8")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not len(batch):
                continue
            q, weight = matrix(batch["q"], dims), batch["weight"].to_numpy()
            at, _ = nearest(q, sent)
            small = float(np.abs(q).max(initial=0)) * float(weight.sum()) < float(1 << 62)
            q, weight = (q, weight) if small else (q.astype(object), weight.astype(object))
            for c in np.unique(at).tolist():
                own = at == c
                added = [weight[own].sum(), *(q[own] * weight[own][:, None]).sum(0)]
                for j, x in enumerate(added):
                    sums[c, j - 1] = sums.get((c, j - 1), 0) + int(x)
        keys = list(sums)
        yield pa.record_batch(
            [pa.array([c for c, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([Decimal(sums[x]) for x in keys], pa.decimal128(38, 0))],
            names=["cluster", "place", "total"],
        )

    parts = distinct.select("q", "weight").mapInArrow(add, "cluster int, place int, total decimal(38,0)")
    return {(r.cluster, r.place): int(r.total) for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()}


def fitted(distinct: DataFrame, centroids: list[list[int]], rounds: int, dims: int) -> list[list[int]]:
    """The centroids after so many rounds: floor(sum / count) of each one's vectors; one without vectors stays."""
    for _ in range(rounds if centroids else 0):
        sums = totals(distinct, centroids, dims)
        centroids = [[sums[c, j] // sums[c, -1] for j in range(dims)] if (c, -1) in sums else old for c, old in enumerate(centroids)]
    return centroids


def assigned(distinct: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(digest, weight, cluster, distance) of each distinct vector; a distance beyond 64 bits is null."""
    sent = np.array(centroids, object if any(abs(x) > LONG for c in centroids for x in c) else "i8")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, apart = nearest(matrix(batch["q"], dims), sent)
            apart = pa.array([x if x <= LONG else None for x in apart.tolist()], pa.int64())
            yield pa.record_batch([batch["digest"], batch["weight"], pa.array(at, pa.int32()), apart], names=["digest", "weight", "cluster", "distance"])

    if not centroids:
        return distinct.select("digest", "weight", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    return distinct.mapInArrow(put, "digest binary, weight long, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector, and the centroids.

    Vectors that are null, of another length, or with null or non-finite components are left out.  Rows that repeat
    count and are returned each; null ids take part (as seeds only where others don't suffice); with fewer than k
    vectors there are as many centroids; an empty table gives no rows and no centroids.  Distances are squared;
    ties go to the smaller centroid.  Components beyond 64 bits count as the largest, distances beyond are null.
    """
    spark, path = vectors.sparkSession, shared_path(vectors.sparkSession, "vectors")
    digest = F.unhex(F.sha2(F.array_join("q", ","), 256))
    rows = quantised(vectors, dims, scale, id_col, vector_col)
    rows.groupBy("q").agg(F.count(F.lit(1)).alias("weight")).withColumn("digest", digest).write.parquet(path)
    distinct = spark.read.parquet(path)
    centroids = fitted(distinct, seeds(rows, k, seed), rounds, dims)
    table = checkpointed(assigned(distinct, centroids, dims))
    found = hot_lookup(rows.select("vec_id", digest.alias("digest")), table.select("digest", "cluster", "distance"), "digest", F.col("vec_id"))
    return found.select("vec_id", "cluster", "distance"), centroids


def cluster_digests(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """cluster_vectors with each cluster's and the whole inertia (null beyond 64 bits) and the centroid's sha256."""
    found, centroids = cluster_vectors(vectors, k, rounds, dims, scale, seed, id_col, vector_col)
    found = checkpointed(found)
    inertia = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    within = lambda x: int(x) if x is not None and x <= LONG else None
    whole = within(sum(x for x in inertia.values() if x is not None)) if None not in inertia.values() else None
    told = [(c, within(inertia.get(c)), whole, hashlib.sha256(",".join(map(str, q)).encode()).hexdigest()) for c, q in enumerate(centroids)]
    table = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
