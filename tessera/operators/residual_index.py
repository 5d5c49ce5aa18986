"""A vector index of residual codes: cells, a few bytes for each vector, tables of products for each query, exact reranking.

Centres and codebooks are fitted on a bounded sample (``sample`` rows of least hash); every row is indexed.  The number of
cells grows with the root of the rows, so a search with a fixed number of probes scans a number of codes that
grows with the root too.  A code stands for the vector less its cell's centre, in ``bytes_each`` parts of one of 256 words
each; its product with a query is the query's with the centre plus one table entry for each part.  Only the
``rerank`` best by codes are compared as vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.retrieval import Best, _one, unit_rows
from tessera.operators.skew import salted_lookup

#: Most bytes of centres and codebooks that are sent to tasks.
MODEL_BYTES = 64 << 20


@dataclass(frozen=True)
class Model:
    """Unit centres (cells x dims) and words (parts x 256 x dims of a part) of residuals."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.words)

    def cells(self, unit: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")[:, :n]

    def codes(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest, width = unit - self.centres[cell], self.words.shape[2]
        out = np.zeros((len(unit), self.parts), "u1")
        for j, words in enumerate(self.words):
            part = rest[:, j * width : (j + 1) * width]
            out[:, j] = np.argmin((words * words).sum(1) - 2 * part @ words.T, axis=1)
        return out

    def products(self, asked: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of unit queries (rows) with the vectors that the codes of one cell stand for (columns)."""
        width = self.words.shape[2]
        out = np.repeat((asked @ self.centres[cell])[:, None], len(codes), axis=1)
        for j, words in enumerate(self.words):
            out += (asked[:, j * width : (j + 1) * width] @ words.T)[:, codes[:, j]]
        return out


def _means(rows: np.ndarray, k: int, rounds: int, seed: int, unit: bool) -> np.ndarray:
    """k means of the rows (of length 1, if asked for); with fewer rows than k some repeat."""
    means = rows[np.resize(np.random.default_rng(seed).permutation(len(rows)), k)] if len(rows) else np.zeros((k, rows.shape[1]))
    for _ in range(rounds if len(rows) else 0):
        own = np.argmin((means * means).sum(1) - 2 * rows @ means.T, axis=1)
        sums, n = np.zeros_like(means), np.bincount(own, minlength=k)[:, None]
        np.add.at(sums, own, rows)
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300) if unit else sums / np.maximum(n, 1)
        means = np.where(n > 0, new, means)
    return means


def fit(corpus: DataFrame, bytes_each: int = 16, sample: int = 20_000, rounds: int = 12, seed: int = 1) -> Model:
    """A model from the sample of (id, vector): about the root of all rows' number as cells, at most a quarter of the sample.

    ``bytes_each`` must divide the number of dimensions.
    """
    held = corpus.where("vector is not null")
    n = held.count()
    rows = held.select("vector", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(sample)
    unit = unit_rows(_one(rows.select("vector").toArrow()["vector"]), None)
    dims = unit.shape[1]
    if len(unit) and dims % bytes_each:
        raise ValueError(f"{dims} dimensions aren't {bytes_each} equal parts")
    cells = max(1, min(math.isqrt(max(0, n - 1)) + 1, sample // 4, len(unit), MODEL_BYTES // 16 // max(1, dims)))
    centres = _means(unit, cells, rounds, seed, unit=True)
    rest = unit - centres[np.argmax(unit @ centres.T, axis=1)] if len(unit) else unit
    width = max(1, dims // bytes_each)
    words = np.stack([_means(rest[:, j * width : (j + 1) * width], 256, rounds, seed + j, unit=False) for j in range(bytes_each)]) if len(unit) else np.zeros((bytes_each, 256, width))
    return Model(centres, words)


def write_index(corpus: DataFrame, model: Model, path: str) -> None:
    """Codes (cell, id, code) of all (id, vector) rows as Parquet, a folder for each cell; rows without a vector are left out."""
    shared = corpus.sparkSession.sparkContext.broadcast(model)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for begin in range(0, len(batch), 4096):
                some = batch.slice(begin, 4096)
                unit = unit_rows(some["vector"], None)
                cell = model.cells(unit, 1)[:, 0]
                codes = model.codes(unit, cell)
                yield pa.record_batch({"cell": cell.astype("i4"), "id": some["id"], "code": pa.array([c.tobytes() for c in codes], pa.binary())})

    rows = corpus.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    rows.mapInArrow(coded, "cell int, id long, code binary").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(path)


def code_top(spark: SparkSession, path: str, model: Model, queries: DataFrame, probes: int, rerank: int, chunk: int = 8192, block: int = 512) -> DataFrame:
    """(qid, doc_id): the ``rerank`` rows of each query's ``probes`` nearest cells that are best by their codes.

    Cells and queries meet in chunks of about ``chunk`` codes and ``block`` queries, whatever the size of a cell.
    """
    shared = spark.sparkContext.broadcast(model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.cells(unit_rows(batch["vector"], None), min(probes, len(model.centres)))
            at = pa.array(np.repeat(np.arange(len(batch)), cells.shape[1]))
            yield pa.record_batch({"cell": cells.ravel().astype("i4"), "id": batch["id"].take(at), "vector": batch["vector"].take(at)})

    asked = queries.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(near, "cell int, id long, vector array<double>")
    index = spark.read.schema("id long, code binary, cell int").parquet(path)
    chunks = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))  # one row a cell
    blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    size = chunks.join(blocks, "cell")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = asked.join(size, "cell").withColumn("b", place("blocks")).select("cell", "b", spread("chunks").alias("c"), "id", "vector")
    right = index.join(size, "cell").withColumn("c", place("chunks")).select("cell", spread("blocks").alias("b"), "c", "id", "code")

    def compare(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        best, model = Best(len(asked), rerank), shared.value
        if len(asked) and len(held):
            codes = np.frombuffer(b"".join(held["code"].to_pylist()), "u1").reshape(len(held), model.parts)
            best.add(0, np.round(model.products(unit_rows(_one(asked["vector"]), None), key[0].as_py(), codes), 12), held["id"].to_numpy())
        qids = asked["id"].to_numpy()
        return pa.table({"qid": pa.array(qids[best.rows], pa.int64()), "doc_id": pa.array(best.ids, pa.int64()), "guess": pa.array(best.scores, pa.float64())})

    met = left.groupBy("cell", "b", "c").cogroup(right.groupBy("cell", "b", "c")).applyInArrow(compare, "qid long, doc_id long, guess double")
    by = W.partitionBy("qid").orderBy(F.desc("guess"), "doc_id")
    return met.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= rerank).select("qid", "doc_id")


def search(corpus: DataFrame, path: str, model: Model, queries: DataFrame, k: int, probes: int = 24, rerank: int = 100) -> DataFrame:
    """(qid, doc_id, score, rank) of the k best by cosine among the ``rerank`` best by codes, ties by doc_id.

    corpus and queries: (id, vector).  An approximate search: rows outside the probed cells, or with poor codes, are not found.
    """
    found = code_top(corpus.sparkSession, path, model, queries, probes, rerank).distinct()
    side = lambda df, key, name: df.where("vector is not null").select(F.col("id").cast("long").alias(key), F.transform("vector", lambda x: x.cast("double")).alias(name))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = salted_lookup(found.join(side(queries, "qid", "q"), "qid"), side(corpus, "doc_id", "d").dropDuplicates(["doc_id"]), ["doc_id"], F.col("qid"), how="inner")
    lengths = F.sqrt(dot("q", "q") * dot("d", "d"))
    rows = both.select("qid", "doc_id", F.round(F.when(lengths > 0, dot("q", "d") / lengths).otherwise(0.0), 9).alias("score"))
    by = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
