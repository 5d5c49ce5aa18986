"""A vector index of cells: every row is indexed, searches read the cells nearest to each query.

Centres are fitted on a bounded sample (the ``sample`` rows of least hash, a parameter).  Rows of a cell are cut into
chunks of about ``chunk`` rows, so that no task holds a whole cell, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.retrieval import Best, _one, unit_rows


def fitted_centres(corpus: DataFrame, cells: int, sample: int = 20_000, rounds: int = 15, seed: int = 1) -> np.ndarray:
    """Unit centres of the cells by spherical k-means over the sample of (id, vector)."""
    rows = corpus.where("vector is not null").select("vector", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(sample)
    unit = unit_rows(_one(rows.select("vector").toArrow()["vector"]), None)
    centres = unit[np.random.default_rng(seed).permutation(len(unit))[:cells]]
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1e-300), centres)
    return centres


def in_cells(rows: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """(cell, id, vector): each row in its ``probes`` nearest cells."""
    if centres.nbytes > 64 << 20:
        raise ValueError("centres of more than 64 MB aren't sent to tasks: fit fewer cells")
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    n = min(probes, len(centres))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 4096):
                some = batch.slice(begin, 4096)
                near = np.argsort(-(unit_rows(some["vector"], None) @ shared.value.T), axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(len(some)), n))
                yield pa.record_batch({"cell": near.ravel().astype("i4"), "id": some["id"].take(at), "vector": some["vector"].take(at)})

    plain = rows.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return plain.mapInArrow(nearest, "cell int, id long, vector array<double>")


def index_top_k(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, probes: int, chunk: int = 8192, block: int = 2048) -> DataFrame:
    """(qid, doc_id, score, rank) of the k nearest rows of each query's ``probes`` cells; index: in_cells of the corpus."""
    asked = in_cells(queries, centres, probes)
    chunks = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))  # one row a cell
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    size = chunks.join(blocks, "cell")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = asked.join(size, "cell").withColumn("b", place("blocks")).select("cell", "b", spread("chunks").alias("c"), "id", "vector")
    right = index.join(size, "cell").withColumn("c", place("chunks")).select("cell", spread("blocks").alias("b"), "c", "id", "vector")

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        best = Best(len(asked), k)
        if len(asked) and len(held):
            best.add(0, np.round(unit_rows(_one(asked["vector"]), None) @ unit_rows(_one(held["vector"]), None).T, 9), held["id"].to_numpy())
        qids = asked["id"].to_numpy()
        return pa.table({"qid": pa.array(qids[best.rows], pa.int64()), "doc_id": pa.array(best.ids, pa.int64()), "score": pa.array(best.scores, pa.float64())})

    met = left.groupBy("cell", "b", "c").cogroup(right.groupBy("cell", "b", "c")).applyInArrow(compare, "qid long, doc_id long, score double")
    by = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
