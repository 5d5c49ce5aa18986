import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, sinks


def test_jsonl_modes(spark, tmp_path):
    good, bad = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    bad.write_text('{"a": 1}\nnot json\n')
    assert [r.a for r in readers.jsonl(spark, str(good), "a long").collect()] == [1, 2]
    assert readers.jsonl(spark, str(bad), "a long", strict=False).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(bad), "a long").collect()
    assert readers.jsonl(spark, str(tmp_path / "none"), "a long", missing_ok=True).count() == 0
    rows = readers.jsonl_with_index(spark, str(good), "a long", most=1).collect()
    assert [(r.row_index, r.n_bytes, r.a) for r in rows] == [(0, 9, 1)]
    digest = hashlib.sha256(good.read_bytes()).hexdigest()
    assert readers.pinned_jsonl(spark, str(good), "a long", digest, 2).count() == 2
    with pytest.raises(ValueError, match="digest"):
        readers.pinned_jsonl(spark, str(good), "a long", "0", 2)


def test_qrels_and_csv_round_trip(spark, tmp_path):
    rel = spark.createDataFrame([("q1", "d1", 1), ("q1", "d2", 0)], "qid string, doc_id string, rel int")
    sinks.write_qrels(rel, str(tmp_path / "q"))
    (tmp_path / "q" / "part-zz.txt").write_text("q1 0 d3 2\nq1 0 d3 5\nbroken line\n")
    assert {(r.qid, r.doc_id, r.rel) for r in readers.qrels(spark, str(tmp_path / "q")).collect()} == {("q1", "d1", 1), ("q1", "d2", 0), ("q1", "d3", 5)}
    sinks.write_csv(rel, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c"), rel.schema).count() == 2
    sinks.write_jsonl(rel.withColumn("x", F.lit(None).cast("string")), str(tmp_path / "j"))
    assert '"x":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))


def test_json_array_strings_and_binary(spark, tmp_path):
    (tmp_path / "arr.json").write_text('[{"a": 1, "b": [1, 2]}, {"a": 2, "b": []}]')
    assert readers.json_array(spark, str(tmp_path / "arr.json"), "a long, b array<long>").count() == 2
    texts = readers.all_strings(readers.json_array(spark, str(tmp_path / "arr.json"), "a long, b array<long>"))
    assert sorted(map(tuple, texts.collect())) == [("1", "[1,2]"), ("2", "[]")]
    files = readers.binary_files(spark, str(tmp_path), "*.json")
    assert readers.data_uris(files, "application/json").first().uri.startswith("data:application/json;base64,")


def test_upsert_status_preview_finite(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, status string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, status string, at long")
    assert {(r.k, r.status) for r in sinks.upsert(old, new, "k", "at").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {(r.k, r.status) for r in sinks.update_status(old, new.where("at = 2"), "k", "status").collect()} == {(1, "a"), (2, "d")}
    rows = spark.createDataFrame([("w1", 1), ("w1", 2), ("w2", 3)], "w string, n long")
    assert [r.n for r in sinks.preview(rows, "w", "n", 2).collect()] == [1, 3]
    assert sinks.finite(spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 2.0)], "a double, b double")).where("a is not null").count() == 0


def test_series_pairs_sql_quarantine(spark):
    series = spark.sql("select array(named_struct('labels', map('id', 'x'), 'values', array(named_struct('timestamp', 0L, 'value', '1.5'), named_struct('timestamp', 60L, 'value', '2')))) as series")
    assert [(r.id, r.used) for r in readers.usage_series(series).collect()] == [("x", 3.5)]
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b")], "q string, p string")
    assert readers.pairs(df, "q", "p").count() == 1
    assert readers.sql(spark, "select * from t where q = :q", {"t": df}, cap=5, q="a").count() == 1
    assert readers.describe({"t": df}, spark).first().columns == "q string, p string"
    good, bad = readers.strict_or_quarantine(df, F.filter(F.array(F.when(F.col("q").isNull(), F.lit("null"))), lambda x: x.isNotNull()))
    assert good.count() == 2 and bad.first().errors == ["null"]


def test_scratch_tables_are_removed(spark):
    from pathlib import Path

    from tessera.sources import scratch

    held, scratch.GIVEN[:] = list(scratch.GIVEN), []
    path = scratch.scratch(spark, "some")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and scratch.GIVEN == [path]
    scratch.remove_scratch(spark)
    assert not Path(path).exists() and scratch.GIVEN == []
    scratch.GIVEN[:] = held
