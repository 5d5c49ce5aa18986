import threading

import pytest
from pyspark.sql import functions as F

from tessera.sources.table_log import Conflict, TableLog


@pytest.fixture
def log(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") % 7).cast("int").alias("kind"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("n"), "id")).alias("name"), F.lit("clash").alias("file"))
    t = TableLog(spark, str(tmp_path / "t"))
    assert t.create(rows, ["id", "name"], cluster_by=["id"]) == 0
    return t


def rows_of(df):
    return sorted(tuple(r) for r in df.select("id", "kind").collect())


def test_update_reads_and_writes_only_files_that_can_match(log):
    before = {r.file for r in log.files().collect()}
    assert len(before) == 4
    possible = {r.file for r in log.candidates({"id": (100, 120)}).collect()}
    assert len(possible) == 1
    assert log.update({"id": (100, 120)}, {"kind": F.col("kind") + 100}, where=F.col("kind") == 3) == 1
    after = {r.file for r in log.files().collect()}
    assert before - after == possible and len(after & before) == 3
    assert rows_of(log.read()) == [(i, i % 7 + (100 if 100 <= i <= 120 and i % 7 == 3 else 0)) for i in range(1000)]
    assert rows_of(log.read(0)) == [(i, i % 7) for i in range(1000)]
    # a file outside the bounds is not opened: it may be gone
    other = next(iter(after & before))
    stats = log.files().where(F.col("file") == other).first()
    import os

    os.rename(f"{log.path}/{other}", f"{log.path}/{other}.away")
    low = 100 if not int(stats.least["id"]) <= 100 <= int(stats.greatest["id"]) else 900
    assert log.update({"id": (low, low)}, {"kind": F.lit(-1)}) == 2
    os.rename(f"{log.path}/{other}.away", f"{log.path}/{other}")
    assert (low, -1) in rows_of(log.read())


def test_nothing_is_written_where_nothing_matches(log):
    assert log.update({"id": (2000, None)}, {"kind": F.lit(0)}) == 0
    assert log.update({"id": (0, 10)}, {"kind": F.lit(0)}, where=F.col("kind") == 99) == 0
    assert log.delete({}, where=F.lit(None).cast("boolean")) == 0 and log.latest() == 0


def test_delete_append_and_versions(log, spark):
    assert log.delete({"id": (None, 499)}, where=F.col("kind") == 0) == 1
    assert log.append(spark.createDataFrame([(5000, "x", 1)], "id int, name string, kind long").withColumn("file", F.lit(None).cast("string"))) == 2
    want = [(i, i % 7) for i in range(1000) if i > 499 or i % 7]
    assert rows_of(log.read(1)) == want and rows_of(log.read()) == [*want, (5000, 1)]
    assert {r.file for r in log.candidates({"id": (5000, 5000)}).collect()} <= {r.file for r in log.files().collect()} and log.candidates({"id": (5000, 5000)}).count() == 1
    with pytest.raises(ValueError, match="no version"):
        log.read(3)
    assert log.update({}, {"kind": F.lit(1)}, where=F.col("name").isNull()) == 3  # null names have no bounds and are found
    assert log.read().where("name is null and kind <> 1").count() == 0


def test_the_second_of_two_writers_fails_and_changes_nothing(log, spark):
    base = log.latest()
    assert log.update({"id": (0, 0)}, {"kind": F.lit(50)}, base=base) == 1
    with pytest.raises(Conflict):
        log.update({"id": (1, 1)}, {"kind": F.lit(60)}, base=base)
    assert dict(rows_of(log.read()))[0] == 50 and dict(rows_of(log.read()))[1] == 1
    assert log.update({"id": (1, 1)}, {"kind": F.lit(60)}) == 2  # again, on what the other wrote
    assert dict(rows_of(log.read()))[0] == 50 and dict(rows_of(log.read()))[1] == 60


def test_writers_at_once(log):
    """Each tries again after a conflict; no update is lost and each version has one writer."""
    made, lost = [], []

    def write(k):
        while True:
            try:
                made.append(log.update({"id": (k * 300, k * 300)}, {"kind": F.col("kind") + 1000}))
                return
            except Conflict:
                lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [1, 2, 3] and log.latest() == 3
    got = dict(rows_of(log.read()))
    assert [got[k * 300] for k in range(3)] == [k * 300 % 7 + 1000 for k in range(3)] and sum(v >= 1000 for v in got.values()) == 3


def test_empty_tables_and_tables_without_kept_values(spark, tmp_path):
    t = TableLog(spark, str(tmp_path / "e"))
    t.create(spark.createDataFrame([], "id long, kind int"), ["id"])
    assert t.read().count() == 0 and t.update({"id": (0, 9)}, {"kind": F.lit(1)}) == 0
    u = TableLog(spark, str(tmp_path / "u"))
    u.create(spark.range(5).withColumn("kind", F.lit(0)), [])
    assert u.update({"id": (2, 2)}, {"kind": F.lit(1)}) == 1 and rows_of(u.read()) == [(0, 0), (1, 0), (2, 1), (3, 0), (4, 0)]
    with pytest.raises(Conflict):
        u.create(spark.range(5), [])
