"""TF-IDF search in an inverted index whose blocks carry the greatest weight of each word.

Documents are dealt into blocks of about ``block_docs`` by bands of length, so that documents of a block are alike
in how much they can score.  A word's postings lie in one row for each block, with the greatest count in it.  A search
first adds up bounds for (query, block) pairs, without reading postings; scores the most promising blocks of each query;
and then only those blocks whose bound reaches the k-th best score so far.  The corpus is read once, when the index is
written, whatever the number of queries; queries and index meet in joins by word and by block, nothing is broadcast.
A block's documents are shuffled once, as lists of words, and its postings as arrays of small numbers; a block scores
all queries that ask for it at once and hands on only documents that can be among a query's k best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch

TERMS = "doc_id long, length long, terms array<struct<w:string,tf:int>>"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct words with their counts."""
    for batch in batches:
        lists = batch["words"]
        words = lists.flatten()
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        held = words.is_valid()
        words, doc = words.filter(held).dictionary_encode(), doc[held.to_numpy(zero_copy_only=False)]
        width = max(1, len(words.dictionary))
        keys, tf = np.unique(doc * width + words.indices.to_numpy(), return_counts=True)
        starts = np.searchsorted(keys, np.arange(len(lists) + 1) * width)
        pairs = pa.StructArray.from_arrays([words.dictionary.take(pa.array(keys % width)).cast(pa.string()), pa.array(tf.astype("i4"))], ["w", "tf"])
        yield pa.record_batch([batch["doc_id"], pa.array(np.bincount(doc, minlength=len(lists))), pa.ListArray.from_arrays(pa.array(starts.astype("i4")), pairs)], names=["doc_id", "length", "terms"])


POSTINGS = "block long, w array<string>, top array<int>, n array<int>, at array<int>, tf array<int>, place array<long>, doc_id array<long>"
#: Products of weights and counts that a task holds at once.
PRODUCTS = 1 << 22


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if not isinstance(whole, pa.ChunkedArray) else whole.chunk(0) if whole.num_chunks else pa.array([], whole.type)


def _postings(table: pa.Table) -> pa.Table:
    """A block as one row: words with their numbers of postings, which name documents by their places in the order of (doc_id, place)."""
    ids, places = _one(table["doc_id"]), _one(table["place"]).to_numpy()
    table = table.take(pa.array(np.lexsort((places, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)))))
    lists = _one(table["terms"])
    pairs, doc = lists.flatten(), np.repeat(np.arange(len(lists), dtype="i4"), lists.value_lengths().to_numpy())
    words = pairs.field("w").dictionary_encode()
    codes, tf = words.indices.to_numpy(), pairs.field("tf").to_numpy()
    order = np.lexsort((doc, codes))
    n = np.bincount(codes, minlength=len(words.dictionary))
    starts = np.cumsum(n) - n
    top = np.maximum.reduceat(tf[order], starts) if len(n) else np.zeros(0, "i4")
    held = lambda values, kind: pa.array([values], pa.list_(kind))
    whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.table({
        "block": table["block"].slice(0, 1), "w": whole(words.dictionary.cast(pa.string())), "top": held(top, pa.int32()), "n": held(n, pa.int32()),
        "at": held(doc[order], pa.int32()), "tf": held(tf[order], pa.int32()), "place": whole(_one(table["place"])), "doc_id": whole(_one(table["doc_id"])),
    })


def _scores(k: int, digits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(asked, postings) of a block to (qid, place, doc_id, score): all that can be among a query's k best once scores are rounded."""

    def score(asked: pa.Table, postings: pa.Table) -> pa.Table:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(asked) and len(postings):
            words, lengths, at, tf, place, doc_id = (_one(postings[c]).flatten() for c in ("w", "n", "at", "tf", "place", "doc_id"))
            width, lengths, at, tf = len(place), lengths.to_numpy(), at.to_numpy(), tf.to_numpy()
            row = pc.index_in(_one(asked["w"]), words)
            found = row.is_valid().to_numpy(zero_copy_only=False)
            row, qid, x = row.drop_null().to_numpy(), asked["qid"].to_numpy()[found], asked["x"].to_numpy()[found]
            starts = np.cumsum(lengths) - lengths
            order = np.argsort(qid, kind="stable")
            row, qid, x = row[order], qid[order], x[order]
            asks, first = np.unique(qid, return_index=True)
            ends, done = np.append(first[1:], len(qid)), np.cumsum(lengths[row])
            i = 0
            while i < len(asks):  # as many queries at once as memory is given for
                past = done[first[i] - 1] if first[i] else 0
                j = max(i + 1, int(np.searchsorted(done[ends - 1], past + PRODUCTS, "right")))
                part = slice(first[i], ends[j - 1])
                n = lengths[row[part]]
                places = np.repeat(starts[row[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                which = np.repeat(np.searchsorted(asks[i:j], qid[part]), n)
                sums = np.bincount(which * width + at[places], np.repeat(x[part], n) * tf[places], (j - i) * width).reshape(j - i, width)
                for q, s in zip(asks[i:j], sums, strict=True):
                    best = np.lexsort((np.arange(width), -s))
                    if width > k:
                        best = best[s[best] >= s[best[k - 1]] - 1.01 * 10.0**-digits]
                        fresh = np.flatnonzero(np.append(True, np.diff(s[best]) != 0))  # of equal sums the first k
                        best = best[np.arange(len(best)) - np.repeat(fresh, np.diff(np.append(fresh, len(best)))) < k]
                    best = best[s[best] > 0]
                    kept.append((np.full(len(best), q), best, s[best]))
                i = j
        if not kept:
            return pa.table({"qid": pa.array([], pa.int64()), "place": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qids, best, sums = (np.concatenate(c) for c in zip(*kept, strict=True))
        return pa.table({"qid": pa.array(qids, pa.int64()), "place": place.take(pa.array(best)), "doc_id": doc_id.take(pa.array(best)), "score": pa.array(sums)})

    return score


def write_index(corpus: DataFrame, path: str, block_docs: int = 128) -> None:
    """An index of (doc_id, words array<string>) as Parquet: documents, a row of postings for each block, words with their document counts.

    Documents without a word array are left out, those with an empty one count but are never found; rows that
    repeat are documents of their own; null words are no words.
    """
    spark = corpus.sparkSession
    rows = corpus.where("words is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("words").cast("array<string>").alias("words"))
    rows.mapInArrow(_terms, TERMS).withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    band = F.floor(2 * F.log2(F.greatest("length", F.lit(1)))).cast("int")
    counts = sorted((r.band, r["count"]) for r in docs.where("length > 0").groupBy(band.alias("band")).count().collect())  # one row for each half octave of length
    blocks, base = [], 0
    for b, n in counts:
        blocks.append((b, base, -(-n // block_docs)))
        base += blocks[-1][2]
    pick = lambda at: F.coalesce(*[F.when(band == x[0], F.lit(x[at])) for x in blocks], F.lit(1)).cast("long")
    dealt = docs.where("length > 0").withColumn("block", pick(1) + F.pmod(F.xxhash64("place"), pick(2)))
    dealt.select("block", "place", "doc_id", "terms").groupBy("block").applyInArrow(_postings, POSTINGS).write.parquet(f"{path}/postings")  # about block_docs documents at once
    spark.read.parquet(f"{path}/postings").select(F.explode(F.arrays_zip("w", "n")).alias("t")).groupBy("t.w").agg(F.sum("t.n").alias("df")).write.parquet(f"{path}/words")


def query_weights(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(qid, w, x): how often a query has a word, times idf = ln((N + 1) / (df + 1)) + 1; words that no document has are left out."""
    n = spark.read.parquet(f"{path}/docs").count()
    wanted = queries.select(F.col("qid").cast("long").alias("qid"), F.explode("words").alias("w")).groupBy("qid", "w").agg(F.count(F.lit(1)).alias("q"))
    words = spark.read.parquet(f"{path}/words")
    return wanted.join(words, "w").select("qid", "w", (F.col("q") * (F.log((n + 1.0) / (F.col("df") + 1)) + 1)).alias("x"))


def bounds(spark: SparkSession, path: str, weights: DataFrame, salts: int = 16) -> DataFrame:
    """(qid, block, bound, place): no document of the block scores more; blocks in the order of their bounds.

    A word that most queries have meets the blocks in ``salts`` parts.
    """
    tops = spark.read.parquet(f"{path}/postings").select("block", F.explode(F.arrays_zip("w", "top")).alias("t")).select("block", "t.w", "t.top").withColumn("_salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    asked = weights.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = tops.join(asked, ["w", "_salt"]).groupBy("qid", "block").agg(F.sum(F.col("x") * F.col("top")).alias("bound"))
    return sums.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("bound"), "block")))


def scored(spark: SparkSession, path: str, pairs: DataFrame, weights: DataFrame, digits: int, k: int) -> DataFrame:
    """(qid, place, doc_id, score) in the (qid, block) pairs: of each pair at least the k best documents that have a word of the query."""
    postings = spark.read.parquet(f"{path}/postings").select("block", "w", "n", "at", "tf", "place", "doc_id")
    asked = pairs.select("qid", "block").join(weights, "qid").select("block", "qid", "w", "x")
    sums = asked.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(_scores(k, digits), "qid long, place long, doc_id long, score double")
    return sums.withColumn("score", F.round("score", digits)).where("score > 0")


def best(rows: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "place")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _reaches(digits: int) -> Column:
    """Whether a block can hold a document that, rounded, scores no less than the k-th best; the sums' own rounding is far below."""
    return F.col("kth").isNull() | (F.col("bound") * (1 + 1e-12) + 0.5 * 10.0**-digits + 1e-9 >= F.col("kth"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, lead: int = 2, digits: int = 3, pairs_path: str | None = None) -> DataFrame:
    """(qid, doc_id, score, rank) of the k best documents with a score above 0, rounded to ``digits``, ties by doc_id.

    queries: (qid, words).  ``lead`` blocks are scored for each query before bounds decide.  At ``pairs_path`` the
    (qid, block, bound, place) pairs are kept, with ``scored``, whether the block's postings were asked for.
    """
    work = pairs_path or scratch(spark, "search")
    query_weights(spark, path, queries).write.parquet(f"{work}/weights")
    weights = spark.read.parquet(f"{work}/weights")
    bounds(spark, path, weights).write.parquet(f"{work}/bounds")
    pairs = spark.read.parquet(f"{work}/bounds")
    best(scored(spark, path, pairs.where(F.col("place") <= lead), weights, digits, k), k).write.parquet(f"{work}/first")
    first = spark.read.parquet(f"{work}/first")
    kth = first.where(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
    told = pairs.join(kth, "qid", "left").withColumn("scored", (F.col("place") <= lead) | _reaches(digits))
    if pairs_path:
        told.write.parquet(f"{work}/told")
    rest = told.where((F.col("place") > lead) & F.col("scored"))
    found = first.drop("rank").unionByName(scored(spark, path, rest, weights, digits, k))
    return best(found, k).select("qid", "doc_id", "score", "rank")
