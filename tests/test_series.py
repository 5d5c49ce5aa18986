import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import series


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(k, i, rng.choice([None, 1.0, 2.0, 5.0]), rng.random() < 0.4) for k in "abc" for i in range(97 if k == "a" else 11)] + [("z", 0, 1.0, True)]


@pytest.mark.parametrize("chunk", [1 << 16, 25])
def test_windows_over_chunks_equal_those_over_keys(spark, rows, chunk):
    df = spark.createDataFrame(rows, "k string, i int, v double, bad boolean").repartition(3)
    by = {}
    for k, i, v, bad in rows:
        by.setdefault(k, []).append((i, v, bad))
    moving, changed, tripped, mean = {}, set(), {}, {}
    for k, xs in by.items():
        for n, (i, v, bad) in enumerate(xs):
            last = [x[1] for x in xs[max(0, n - 2) : n + 1] if x[1] is not None]
            moving[k, i] = sum(last) / len(last) if last else None
            if n == 0 or xs[n - 1][1] != v:
                changed.add((k, i))
            some = [x[2] for x in xs[max(0, n - 19) : n + 1]]
            row = [x[2] for x in xs[max(0, n - 4) : n + 1]]
            if bad and k not in tripped and ((len(row) == 5 and all(row)) or (len(some) >= 10 and sum(some) / len(some) >= 0.5)):
                tripped[k] = i
        spans = [(v, b - a) for (a, v, _), (b, _, _) in zip(xs, xs[1:]) if v is not None]
        mean[k] = sum(v * d for v, d in spans) / sum(d for _, d in spans) if spans else None
    assert {(r.k, r.i): r.moving for r in series.moving_average(df, "k", "i", "v", chunk=chunk).collect()} == pytest.approx(moving)
    got = series.change_points(df, "k", "i", "v", chunk=chunk).collect()
    assert {(r.k, r.i) for r in got} == changed and len(got) == len(changed)
    found = {r.k: (r.tripped_at, r.failures) for r in series.circuit_breaker(df, "k", "i", F.col("bad"), chunk=chunk).collect()}
    assert found == {k: (tripped.get(k), sum(x[2] for x in xs)) for k, xs in by.items()}
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("i") * 10))
    assert {r.k: r.mean for r in series.time_weighted_mean(timed, "k", "ts", "v", chunk=chunk).collect()} == pytest.approx({k: m for k, m in mean.items() if m is not None})


def test_cursor_of_a_hot_key_in_many_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 15_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.when(F.col("id") < 15_000, F.col("id") + (F.col("id") > 9_000).cast("int")).otherwise(F.floor((F.col("id") - 15_000) / 50)).alias("i"))
    rows = df.unionByName(df.limit(100)).unionByName(spark.createDataFrame([("hot", None), ("hot", -1), (None, 0), (None, 2)], "k string, i long"))
    got = {r.k: (r.cursor, r.resolved) for r in series.contiguous_cursor(rows, "k", "i").collect()}
    assert got["hot"] == (9_001, 15_000) and got[None] == (1, 2)
    assert all(got[f"k{j}"] == (100, 100) for j in range(50))
