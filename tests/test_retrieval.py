import numpy as np

from tessera.operators import retrieval as S
from tessera.plans import catalogue


def test_gold_rows_far_down_have_ranks(spark, sf):
    drawn = np.random.default_rng(4).normal(size=(300, 8)).round(2)
    drawn[200:] = drawn[100:200]  # ties
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(drawn)], "id long, vector array<double>")
    pairs = [(q, (q * 37 + 150) % 300) for q in range(0, 300, 7)] + [(0, 299), (0, 5000), (9000, 1)]
    unit = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
    want = {}
    for q, g in pairs:
        if max(q, g) < 300:
            order = np.lexsort((np.arange(300), -np.round(unit @ unit[q], 9)))
            want[q, g] = int(np.flatnonzero(order == g)[0]) + 1
    got = {(r.qid, r.doc_id): r.rank for r in S.whole_rank_of_gold(corpus, corpus.repartition(5), spark.createDataFrame(pairs, "qid long, doc_id long")).collect()}
    assert got == {p: want.get(p) for p in pairs} and max(want.values()) > 250
    ranks = [r.rank for r in catalogue.QUERIES["rank_of_gold_whole"](spark, sf).collect()]
    assert ranks and None not in ranks


def test_metrics_count_hits_beyond_place_50(spark, sf):
    row = catalogue.QUERIES["ranking_metrics_10_100"](spark, sf).first()
    assert set(row.asDict()) == {"n_queries", "ndcg_10", "ndcg_100", "recall_10", "recall_100", "mrr_100", "map_100"}
    run = spark.createDataFrame([(0, 100 + r, r) for r in range(1, 101)], "qid long, doc_id long, rank int")
    qrels = spark.createDataFrame([(0, 160, 1), (0, 190, 1), (0, 5, 1)], "qid long, doc_id long, rel int")
    got = S.ranking_metrics_at(run, qrels, [10, 100]).first()
    ideal = 1 + 1 / np.log2(3) + 0.5
    want = {"n_queries": 1, "ndcg_10": 0, "ndcg_100": (1 / np.log2(61) + 1 / np.log2(91)) / ideal, "recall_10": 0, "recall_100": 2 / 3, "mrr": 1 / 60, "map": (1 / 60 + 2 / 90) / 3}
    assert {k: round(v, 9) for k, v in got.asDict().items()} == {k: round(float(v), 9) for k, v in want.items()}


def test_waves_and_ties(spark, monkeypatch):
    drawn = np.random.default_rng(6).integers(-2, 3, (400, 4)).astype(float)
    drawn[7] = 1.0
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(drawn)] + [(999, None)], "id long, vector array<double>")
    unit = drawn / np.maximum(np.linalg.norm(drawn, axis=1, keepdims=True), 1e-300)
    want = {}
    for q in range(0, 400, 9):
        want[q] = np.lexsort((np.arange(400), -np.round(unit @ unit[q], 9)))[:5].tolist()
    asked = corpus.where("id % 9 = 0")
    for size in (S.WAVE_BYTES, 400):
        monkeypatch.setattr(S, "WAVE_BYTES", size)
        got = S.cosine_top_k(asked, corpus.repartition(3), 5).collect()
        assert {q: [r.doc_id for r in sorted(got, key=lambda r: r.rank) if r.qid == q] for q in want} == want
    plan = S.cosine_top_k(asked, corpus, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert S.cosine_top_k(asked.limit(0), corpus, 5).count() == 0 and S.cosine_top_k(asked, corpus.limit(0), 5).count() == 0


def test_tfidf_waves(spark, monkeypatch):
    docs = [(i, [f"w{(i * j) % 13}" for j in range(i % 7)]) for i in range(80)] + [(100, None)]
    queries = [(q, [f"w{q % 13}", f"w{q % 5}", "nowhere"]) for q in range(30)]
    corpus, asked = spark.createDataFrame(docs, "doc_id long, words array<string>"), spark.createDataFrame(queries, "qid long, words array<string>")
    df = {w: sum(w in (ws or []) for _, ws in docs) for w in {f"w{k}" for k in range(13)}}
    want = set()
    for q, ws in queries:
        score = lambda d: round(sum(d.count(w) * (np.log((len(docs) + 1) / (df[w] + 1)) + 1) for w in ws if w in df), 3)
        ranked = sorted((-score(d or []), i) for i, d in docs if score(d or []) > 0)[:4]
        want |= {(q, i, k + 1) for k, (_, i) in enumerate(ranked)}
    for size in (S.WAVE_BYTES, 300):
        monkeypatch.setattr(S, "WAVE_BYTES", size)
        assert {(r.qid, r.doc_id, r["rank"]) for r in S.tfidf_top_k(asked, corpus.repartition(3), 4).collect()} == want


def test_label_metrics_equal_those_of_pairs(spark):
    labels = spark.createDataFrame([(i, i % 3 if i < 20 else 9) for i in range(21)], "id long, label long")
    run = spark.createDataFrame([(q, d, k) for q in (0, 3, 20) for k, d in enumerate([d for d in range(1, 12) if d != q], 1)], "qid long, doc_id long, rank int")
    pairs = [(q, d, 1) for q in (0, 3) for d in range(20) if d % 3 == 0 and d != q]
    a, b = S.label_ranking_metrics(run, labels, [3, 10]).first(), S.ranking_metrics_at(run, spark.createDataFrame(pairs, "qid long, doc_id long, rel int"), [3, 10]).first()
    assert {k: round(v, 9) for k, v in a.asDict().items()} == {k: round(v, 9) for k, v in b.asDict().items()}
