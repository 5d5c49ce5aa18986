import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import inverted_index as X
from tessera.operators import retrieval


def plain(queries, corpus, k):
    held = [(d, Counter(w for w in words if w is not None)) for d, words in corpus if words is not None]
    df = Counter(w for _, c in held for w in c)
    out = []
    for qid, words in queries:
        weights = {w: n * (math.log((len(held) + 1) / (df[w] + 1)) + 1) for w, n in Counter(words or []).items() if w in df}
        scores = [(-round(s, 3), d) for d, c in held if round(s := sum(x * c[w] for w, x in weights.items()), 3) > 0]
        out += [(qid, d, -s, rank) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus_of(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(20_000)]
    return [(d, [rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 300 if d % 40 == 0 else 8]))]) for d in range(n)], [(q, [rng.choice(words) for _ in range(rng.randrange(1, 9))]) for q in range(25)]


def rows_of(df):
    return sorted((r.qid, r.doc_id, r.score, r.rank) for r in df.collect())


def test_search_equals_scores_of_all_documents_and_skips_blocks(spark, tmp_path):
    corpus, queries = corpus_of(1, 3000)
    corpus += [(7000, None), (7001, []), (7002, ["only", None]), (7003, ["only"])]
    queries += [(100, ["only", "nowhere"]), (101, ["nowhere"]), (102, []), (103, None)]
    docs, asked = spark.createDataFrame(corpus, "doc_id long, words array<string>").repartition(3), spark.createDataFrame(queries, "qid long, words array<string>")
    X.write_index(docs, str(tmp_path / "index"), block_docs=32)
    got = X.search(spark, str(tmp_path / "index"), asked, 5, pairs_path=str(tmp_path / "search"))
    assert rows_of(got) == plain(queries, corpus, 5)
    told = spark.read.parquet(str(tmp_path / "search/told"))
    assert told.where("scored").count() < 0.5 * told.count() and told.where("not scored").count() > 500
    best = told.where("scored").groupBy("qid").agg(F.min("bound").alias("least"))
    assert told.where("not scored").join(best, "qid").where("bound > kth").count() == 0
    again = [(q + 1000, words) for q, words in corpus_of(2, 1)[1]]  # the corpus isn't asked for again
    assert rows_of(X.search(spark, str(tmp_path / "index"), spark.createDataFrame(again, "qid long, words array<string>"), 3)) == plain(again, corpus, 3)


def test_no_skipping_where_bounds_are_equal(spark):
    corpus, queries = [(d, ["a", "b"]) for d in range(300)], [(1, ["a"]), (2, ["b", "b"])]
    got = retrieval.tfidf_top_k(spark.createDataFrame(queries, "qid long, words array<string>"), spark.createDataFrame(corpus, "doc_id long, words array<string>"), 4)
    assert rows_of(got) == plain(queries, corpus, 4)


def test_repeated_documents_stay_apart_and_empty_tables(spark):
    corpus = [(1, ["a", "b"]), (1, ["a", "b"]), (2, ["a"]), (None, ["a", "a"])]
    docs, asked = spark.createDataFrame(corpus, "doc_id long, words array<string>"), spark.createDataFrame([(1, ["a"])], "qid long, words array<string>")
    got = retrieval.tfidf_top_k(asked, docs, 10).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2] and len({r.score for r in got[1:]}) == 1
    assert retrieval.tfidf_top_k(asked, docs.where("doc_id = 99"), 3).count() == 0
    assert retrieval.tfidf_top_k(asked.where("qid = 99"), docs, 3).count() == 0


def test_the_corpus_is_read_once(spark, tmp_path):
    corpus, queries = corpus_of(3, 200)
    spark.createDataFrame(corpus, "doc_id long, words array<string>").coalesce(1).write.parquet(str(tmp_path / "corpus"))
    reads = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    docs = spark.read.parquet(str(tmp_path / "corpus")).mapInArrow(passed, "doc_id long, words array<string>")
    got = rows_of(retrieval.tfidf_top_k(spark.createDataFrame(queries, "qid long, words array<string>"), docs, 5))
    assert got == plain(queries, corpus, 5) and reads.value == 200


def test_a_block_hands_on_the_best_documents_of_a_query_only(spark, tmp_path):
    corpus = [(d, ["a"] * (1 + d % 40) + ["b"]) for d in range(2000)] + [(None, ["a"] * 50), (5, ["a"] * 40)]
    queries, k = [(1, ["a"]), (2, ["b", "a", "a"])], 3
    docs, asked = (spark.createDataFrame(rows, f"{name} long, words array<string>").repartition(3) for rows, name in ((corpus, "doc_id"), (queries, "qid")))
    X.write_index(docs, str(tmp_path / "i"))
    blocks = spark.read.parquet(str(tmp_path / "i/postings"))
    assert blocks.count() == blocks.select("block").distinct().count()  # a row for each
    weights = X.query_weights(spark, str(tmp_path / "i"), asked)
    pairs = asked.select("qid").crossJoin(blocks.select("block"))
    assert X.scored(spark, str(tmp_path / "i"), pairs, weights, 3, k).groupBy("qid").count().agg(F.max("count")).first()[0] <= k * blocks.count()
    got = [(r.qid, r.doc_id, r.score) for r in X.search(spark, str(tmp_path / "i"), asked, k).orderBy("qid", "rank").collect()]
    assert [d for _, d, _ in got] == [None, 5, 39, None, 39, 79]  # the second asks for b too, which the row 5 lacks
