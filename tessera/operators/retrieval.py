"""Exact vector and TF-IDF search and ranking metrics.

Vector searches read the corpus as it lies.  What is asked for goes to the tasks as matrices of a checked size, in
waves if it is larger; a task multiplies each Arrow batch with them and keeps its k best, so only k rows
a query and partition are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import inverted_index
from tessera.sources.scratch import scratch

#: Most bytes that one wave of queries sends to the tasks.
WAVE_BYTES = 64 << 20
#: Queries and corpus rows that are multiplied at once.
BLOCK_QUERIES, BLOCK_ROWS = 1024, 4096


def unit_rows(vectors: pa.Array, dims: int | None) -> np.ndarray:
    """The first ``dims`` numbers of each vector (all if None), at length 1."""
    raw = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(vectors), -1) if len(vectors) else np.zeros((0, dims or 1))
    raw = raw[:, :dims] if dims else raw
    return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-300)


class Best:
    """The k best (score, id) of each query so far, ties by id."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows, self.scores, self.ids = k, np.zeros(0, "i8"), np.zeros(0), np.zeros(0, "i8")
        self.least = np.full(queries, -np.inf)  # the k-th score, once there are k

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from ``first`` on (rows) for the ids (columns)."""
        k, n = self.k, scores.shape[1]
        bar = self.least[first : first + len(scores)]
        if n > k:
            bar = np.maximum(bar, np.partition(scores, n - k, axis=1)[:, n - k])
        row, column = np.nonzero(scores >= bar[:, None])
        rows, found, own = np.concatenate([self.rows, row + first]), np.concatenate([self.scores, scores[row, column]]), np.concatenate([self.ids, ids[column]])
        order = np.lexsort((own, -found, rows))
        rows, found, own = rows[order], found[order], own[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        self.least[rows[place == k - 1]] = found[place == k - 1]
        kept = place < k
        self.rows, self.scores, self.ids = rows[kept], found[kept], own[kept]


def waves(rows: DataFrame, key: str, row_bytes: int) -> Iterator[pa.Table]:
    """The rows in parts of about WAVE_BYTES each, dealt by a hash of the key."""
    parts = max(1, -(-rows.count() * row_bytes // WAVE_BYTES))
    for k in range(parts):
        yield rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k).toArrow().combine_chunks()


def over_waves(corpus: DataFrame, parts: Iterator[pa.Table], task: Callable[[pa.Table], Callable], schema: str) -> DataFrame:
    """What ``task(wave)`` makes of the corpus for each wave: with several, each is written before the next one is sent."""
    spark, path, n, last = corpus.sparkSession, None, 0, None
    for part in parts:
        if last is not None:
            path = path or scratch(spark, "waves")
            last.write.mode("append").parquet(path)
        last, n = corpus.mapInArrow(task(part), schema), n + 1
    if path is None:
        return last
    last.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int, dims: int | None = None) -> DataFrame:
    """(qid, doc_id, score, rank) of the k nearest corpus rows for each query, ties by doc_id.

    Both sides have (id, vector); rows without a vector are left out.
    """
    asked = queries.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    width = asked.select(F.size("vector")).first()

    def task(wave: pa.Table) -> Callable:
        qids, sent = wave["id"].to_numpy(), unit_rows(_one(wave["vector"]), dims)
        shared = corpus.sparkSession.sparkContext.broadcast((qids, sent))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            best = Best(len(q), k)
            for batch in batches:
                for begin in range(0, len(batch), BLOCK_ROWS):
                    some = batch.slice(begin, BLOCK_ROWS)
                    d, ids = unit_rows(some["vector"], dims), some["id"].to_numpy()
                    for a in range(0, len(q), BLOCK_QUERIES):
                        best.add(a, np.round(q[a : a + BLOCK_QUERIES] @ d.T, 9), ids)
            yield pa.record_batch({"qid": qids[best.rows], "doc_id": best.ids, "score": best.scores})

        return multiply

    rows = corpus.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    met = over_waves(rows, waves(asked, "id", 8 * (2 + (width[0] if width else 1))), task, "qid long, doc_id long, score double")
    by = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if not isinstance(whole, pa.ChunkedArray) else whole.chunk(0) if whole.num_chunks else pa.array([], whole.type)


def tfidf_top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(qid, doc_id, score, rank) with idf = ln((N + 1) / (df + 1)) + 1, query words with repetition, ties by doc_id.

    queries: (qid, words), corpus: (doc_id, words), words being arrays.  The corpus is indexed once, whatever the
    number of queries; see ``inverted_index``, which also keeps an index for later searches.
    """
    path = scratch(corpus.sparkSession, "index")
    inverted_index.write_index(corpus, path)
    return inverted_index.search(corpus.sparkSession, path, queries, k)


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row: macro-averaged nDCG@k, recall@k, MRR and MAP over queries that both sides have.

    run: (qid, doc_id, rank); qrels: (qid, doc_id, rel).  MRR and MAP go as far down as the run.
    """
    return ranking_metrics_at(run, qrels, [k]).withColumnsRenamed({f"ndcg_{k}": "ndcg", f"recall_{k}": "recall"})


def ranking_metrics_at(run: DataFrame, qrels: DataFrame, cuts: list[int]) -> DataFrame:
    """ranking_metrics with ndcg_k and recall_k for each of the cuts."""
    judged = run.join(qrels.select("qid").distinct(), "qid", "left_semi").join(qrels.where("rel > 0"), ["qid", "doc_id"], "left")
    ideal = qrels.where("rel > 0").withColumn("i", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")))
    ideal = ideal.groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"), *[F.sum(F.when(F.col("i") <= k, F.col("rel") / F.log2(F.col("i") + 1.0))).alias(f"idcg_{k}") for k in cuts])
    return _averaged(judged, ideal, cuts)


def label_ranking_metrics(run: DataFrame, labels: DataFrame, cuts: list[int]) -> DataFrame:
    """ranking_metrics_at where a document is relevant if it has the query's label and isn't the query itself.

    labels: (id, label).  Only the run's rows meet labels; how many rows are relevant is a count for each label.
    """
    of = lambda key, name: labels.select(F.col("id").alias(key), F.col("label").alias(name))
    same = (F.col("asked") == F.col("found")) & (F.col("qid") != F.col("doc_id"))
    judged = run.join(of("qid", "asked"), "qid").join(of("doc_id", "found"), "doc_id").withColumn("rel", F.when(same, 1))
    counts = labels.groupBy(F.col("label").alias("asked")).agg((F.count(F.lit(1)) - 1).alias("relevant"))
    gains = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    ideal = of("qid", "asked").join(run.select("qid").distinct(), "qid", "left_semi").join(F.broadcast(counts), "asked").where("relevant > 0")  # one row a label
    return _averaged(judged, ideal.select("qid", "relevant", *[gains(k).alias(f"idcg_{k}") for k in cuts]), cuts)


def _averaged(judged: DataFrame, ideal: DataFrame, cuts: list[int]) -> DataFrame:
    """judged: (qid, rank, rel), rel null where a row isn't relevant; ideal: (qid, relevant, idcg_k...)."""
    hit = F.col("rel").isNotNull()
    upto = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = judged.withColumn("hits", F.count("rel").over(upto))
    within = lambda k: hit & (F.col("rank") <= k)
    gains = [F.sum(F.when(within(k), F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}") for k in cuts]
    found = [F.count(F.when(within(k), 1)).alias(f"found_{k}") for k in cuts]
    per = rows.groupBy("qid").agg(*gains, *found, F.max(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("rr"), F.sum(F.when(hit, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"))
    both = per.join(ideal, "qid")
    ndcg = [F.avg(F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).alias(f"ndcg_{k}") for k in cuts]
    recall = [F.avg(F.col(f"found_{k}") / F.col("relevant")).alias(f"recall_{k}") for k in cuts]
    return both.agg(F.count(F.lit(1)).alias("n_queries"), *ndcg, *recall, F.avg("rr").alias("mrr"), F.avg(F.col("precisions") / F.col("relevant")).alias("map"))


def rerank(recalled: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k of each query's recalled rows with the best cosine over whole vectors, ties by doc_id."""
    side = lambda key, name: corpus.select(F.col("id").alias(key), F.transform("vector", lambda x: x.cast("double")).alias(name))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = recalled.select("qid", "doc_id").join(side("qid", "q"), "qid").join(side("doc_id", "d"), "doc_id")
    scored = both.select("qid", "doc_id", F.round(dot("q", "d") / F.sqrt(dot("q", "q") * dot("d", "d")), 9).alias("score"))
    by = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def rank_of_gold(run: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, rank) of each query's gold document, null if it isn't in the run."""
    return gold.join(run, ["qid", "doc_id"], "left").select("qid", "rank")


def whole_rank_of_gold(queries: DataFrame, corpus: DataFrame, gold: DataFrame, dims: int | None = None) -> DataFrame:
    """(qid, doc_id, rank) of each gold document among all corpus rows, null if it or its query has no vector.

    The rank is one more than the number of rows that score above the gold row, ties by doc_id: each corpus
    partition counts its own, so one number per gold row and partition is shuffled.
    """
    vectors = lambda df, key, name: df.where("vector is not null").select(F.col("id").cast("long").alias(key), F.col("vector").alias(name))
    pairs = gold.select(F.col("qid").cast("long").alias("qid"), F.col("doc_id").cast("long").alias("doc_id")).distinct()
    asked = pairs.join(vectors(queries, "qid", "q"), "qid").join(vectors(corpus, "doc_id", "g"), "doc_id").select("qid", "doc_id", "q", "g")
    width = asked.select(F.size("q")).first()

    def task(wave: pa.Table) -> Callable:
        q, g = (unit_rows(_one(wave[c]), dims) for c in ("q", "g"))
        shared = corpus.sparkSession.sparkContext.broadcast((wave["qid"].to_numpy(), wave["doc_id"].to_numpy(), q, np.round((q * g).sum(1), 9)))

        def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, own, q, least = shared.value
            ahead = np.zeros(len(q), "i8")
            for batch in batches:
                for begin in range(0, len(batch), BLOCK_ROWS):
                    some = batch.slice(begin, BLOCK_ROWS)
                    d, ids = unit_rows(some["vector"], dims), some["id"].to_numpy()
                    for a in range(0, len(q), BLOCK_QUERIES):
                        scores, bar, mine = np.round(q[a : a + BLOCK_QUERIES] @ d.T, 9), least[a : a + BLOCK_QUERIES, None], own[a : a + BLOCK_QUERIES, None]
                        ahead[a : a + BLOCK_QUERIES] += (((scores > bar) | ((scores == bar) & (ids < mine))) & (ids != mine)).sum(1)
            yield pa.record_batch({"qid": qids, "doc_id": own, "above": ahead})

        return above

    rows = corpus.where("vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    met = over_waves(rows, waves(asked, "qid", 16 * (2 + (width[0] if width else 1))), task, "qid long, doc_id long, above long")
    ranks = met.groupBy("qid", "doc_id").agg((F.sum("above") + 1).alias("rank"))
    return gold.select("qid", "doc_id").join(ranks, ["qid", "doc_id"], "left")


def rank_delta(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """One row: queries whose gold rank improved, stayed or got worse, and the mean change."""
    both = base.withColumnRenamed("rank", "b").join(tuned.withColumnRenamed("rank", "t"), "qid").select((F.col("b") - F.col("t")).alias("d"))
    return both.agg(F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") == 0).alias("unchanged"), F.count_if(F.col("d") < 0).alias("worse"), F.avg("d").alias("mean_change"))


def twin_expand(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """Relevant documents and all with the same text (by digest)."""
    digests = corpus.select("doc_id", F.sha2("text", 256).alias("h"))
    return qrels.join(digests, "doc_id").select("qid", "rel", "h").join(digests, "h").groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))
