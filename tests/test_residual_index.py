from pathlib import Path

import numpy as np
import pytest

from tessera.operators import residual_index as X
from tessera.operators.retrieval import cosine_top_k
from tessera.plans import catalogue
from tessera.plans.episode_queries import vectors

BIG = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(BIG).exists(), reason="no larger tables")
def test_recall_with_a_twentieth_of_the_vectors_compared(spark, tmp_path):
    e = vectors(spark, BIG)
    n = e.count()
    model = X.fit(e)
    assert len(model.centres) == int(np.ceil(np.sqrt(n)))
    X.write_index(e, model, str(tmp_path / "index"))
    asked = e.where("id % 20 = 0")
    found = X.code_top(spark, str(tmp_path / "index"), model, asked, 24, 100)
    compared = found.groupBy("qid").count().agg({"count": "max"}).first()[0]
    assert compared <= 0.05 * n
    got = {(r.qid, r.doc_id) for r in X.search(e, str(tmp_path / "index"), model, asked, 5).collect()}
    want = {(r.qid, r.doc_id) for r in cosine_top_k(asked, e, 5).collect()}
    assert len(got & want) >= 0.9 * len(want), len(got & want) / len(want)


def test_codes_come_close_to_products_and_every_row_is_indexed(spark, tmp_path):
    drawn = np.random.default_rng(3).normal(size=(900, 16)) + np.repeat(np.random.default_rng(4).normal(size=(9, 16)) * 3, 100, axis=0)
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(drawn)] + [(5000, None, "y"), (5001, [0.0] * 16, "z")], "id long, vector array<double>, cell string").repartition(3)
    model = X.fit(rows, bytes_each=8)
    X.write_index(rows, model, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 901 and index.select("id").distinct().count() == 901
    unit = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
    cell = model.cells(unit, 1)[:, 0]
    codes = model.codes(unit, cell)
    off = [np.abs(model.products(unit[:20], c, codes[cell == c]) - unit[:20] @ unit[cell == c].T).max() for c in set(cell.tolist())]
    assert max(off) < 0.1 and np.mean(off) < 0.03
    everything = X.search(rows, str(tmp_path / "index"), model, rows.where("id < 40"), 4, probes=99, rerank=901)
    exact = cosine_top_k(rows.where("id < 40"), rows, 4)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))


def test_empty_and_tiny_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, vector array<double>")
    model = X.fit(empty)
    X.write_index(empty, model, str(tmp_path / "none"))
    assert X.search(empty, str(tmp_path / "none"), model, empty, 3).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 16), (2, [-1.0] * 16)], "id long, vector array<double>")
    model = X.fit(two)
    X.write_index(two, model, str(tmp_path / "two"))
    assert [(r.qid, r.doc_id) for r in X.search(two, str(tmp_path / "two"), model, two, 1).collect()] in ([(1, 1), (2, 2)], [(2, 2), (1, 1)])
    with pytest.raises(ValueError, match="equal parts"):
        X.fit(two, bytes_each=5)


def test_query_recall(spark, sf):
    got = {(r.qid, r.doc_id) for r in catalogue.QUERIES["vector_residual_top_k"](spark, sf).collect()}
    e = vectors(spark, sf)
    want = {(r.qid, r.doc_id) for r in cosine_top_k(e.where("id % 100 = 0"), e, 5).collect()}
    assert len(got & want) >= 0.9 * len(want)
