import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import groups, ordering, scans


def returns(rows, gamma):
    """rows: [(key, turn, value)] -> {(key, turn): return}, one row at a time."""
    out, by = {}, {}
    for k, t, v in rows:
        by.setdefault(k, []).append((t, v))
    for k, xs in by.items():
        acc = 0.0
        for t, v in sorted(xs, reverse=True):
            out[k, t] = None if v is None else v + gamma(k, t) * acc
            acc = out[k, t] or 0.0
    return out


def packs(rows, capacity):
    out, by = {}, {}
    for k, o, n in rows:
        if n is not None and 0 <= n <= capacity:
            by.setdefault(k, []).append((o, n))
    for k, xs in by.items():
        pack, used = 0, 0
        for o, n in sorted(xs):
            over = used + n > capacity
            pack, used = pack + over, n if over else used + n
            out[k, o] = pack
    return out


def rows_of_keys(seed, value):
    rng = random.Random(seed)
    return [(k, t, value(rng)) for k, n in [("a", 400), ("b", 1), (None, 30), *[(f"k{i}", rng.randrange(1, 5)) for i in range(60)], ("z", 700)] for t in range(n)]


@pytest.mark.parametrize("batch", [7, 10_000])
def test_returns_equal_a_plain_fold(spark, batch):
    rows = rows_of_keys(1, lambda rng: rng.choice([None, *[rng.uniform(-1, 1)] * 12]))
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for gamma, plain in ((0.95, lambda k, t: 0.95), (0.0, lambda k, t: 0.0), (F.when(F.col("t") % 5 == 0, 0.0).otherwise(1.5 - F.col("t") % 3), lambda k, t: 0.0 if t % 5 == 0 else 1.5 - t % 3)):
            got = {(r.k, r.t): r.ret for r in groups.discounted_returns(df, "k", "t", "v", gamma).collect()}
            want = returns(rows, plain)
            assert got.keys() == want.keys()
            assert all((got[x] is None) == (want[x] is None) and (want[x] is None or abs(got[x] - want[x]) <= 1e-9 * max(1, abs(want[x]))) for x in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_rollout_of_ten_million_turns(spark):
    n, gamma = 10_000_000, 0.999
    df = spark.range(n).select(F.lit(7).alias("rollout"), F.col("id").alias("turn"), F.lit(1.0).alias("r"))
    got = groups.discounted_returns(df, "rollout", "turn", "r", gamma)
    assert got.rdd.getNumPartitions() >= 4
    want = (1 - F.pow(F.lit(gamma), F.lit(n) - F.col("turn"))) / (1 - gamma)
    r = got.withColumn("part", F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("ret") - want)).alias("off"), F.count_distinct("part").alias("parts")).first()
    assert r.n == n and r.off < 1e-6 and r.parts >= 4


def test_folds_forget_infinities():
    assert scans.folded([0.5, 0.0, 2.0, 1.0], [np.inf, 1.0, 1.0, 1.0], 3.0) == [np.inf, 1, 3, 4]


@pytest.mark.parametrize("batch", [7, 10_000])
@pytest.mark.parametrize("sizes", [(0, 1, 5, 20, 50), (1, 1, 1), (0, 0, 100, 101, -3, None)])
def test_packs_equal_a_plain_loop(spark, batch, sizes):
    rows = rows_of_keys(2, lambda rng: rng.choice(sizes))
    df = spark.createDataFrame(rows, "k string, t int, n long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.k, r.t): r.pack for r in ordering.greedy_pack(df, "k", "t", "n", 100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == packs(rows, 100)


def test_maps_of_packs_compose_like_one_map():
    rng = np.random.default_rng(4)
    for _ in range(300):
        sizes, cap = rng.integers(0, 12, rng.integers(1, 60)), int(rng.integers(11, 30))
        begins = (rng.random(len(sizes)) < 0.05) & (np.arange(len(sizes)) > 0)
        at = int(rng.integers(0, len(sizes) + 1))
        whole, two = scans.breaks_of(sizes, begins, cap), scans.breaks_of(sizes[:at], begins[:at], cap).then(scans.breaks_of(sizes[at:], begins[at:], cap))
        fills = np.arange(cap + 1)
        assert all((x == y).all() for x, y in zip(whole.after(fills), two.after(fills), strict=True))
        assert len(two.least) <= cap + 2
        assert scans.Breaks.heard(two.told()).after(fills)[0].tolist() == two.after(fills)[0].tolist()


def test_a_shard_with_all_rows_is_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("one").alias("s"), "id", (F.col("id") * 7919 % 1000).alias("n"))
    out = ordering.greedy_pack(df, "s", "id", "n", 4096)
    assert out.select(F.spark_partition_id()).distinct().count() >= 4
    got = [r.pack for r in out.orderBy("id").select("pack").collect()]
    want = packs([("one", i, i * 7919 % 1000) for i in range(200_000)], 4096)
    assert got == [want["one", i] for i in range(200_000)]


def test_begins_over_batches():
    batches = [pa.record_batch({"k": pa.array(x, pa.string())}) for x in (["a", "a"], [], ["a", None], [None, "b"], ["c"])]
    assert [b.tolist() for _, b in scans.with_begins(iter(batches), "k")] == [[False, False], [False, True], [False, True], [True]]


def test_group_statistics_split_hot_groups(spark):
    rng = random.Random(6)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 40}", i, rng.choice([0.0, 1.0, 1.0])) for i in range(900)] + [("lone", 900, 1.0), ("flat", 901, 2.0), ("flat", 902, 2.0)]
    df = spark.createDataFrame(rows, "grp string, run int, reward double")
    by = {}
    for g, _, r in rows:
        by.setdefault(g, []).append(r)
    got = {r.run: r.advantage for r in groups.group_advantage_safe(df, "grp", "reward").collect()}
    dropped = {r.run: r.advantage for r in groups.group_advantage(df, "grp", "reward").collect()}
    z = {r.run: r.z for r in groups.z_scores(df, {"z": "reward"}, ["grp"]).collect()}
    for g, i, r in rows:
        xs = np.array(by[g])
        sd = xs.std(ddof=1) if len(xs) > 1 else 0.0
        want = 0.0 if len(xs) == 1 else (r - xs.mean()) / ((1.0 if sd < 1e-8 else sd) + 1e-8)
        assert abs(got[i] - want) < 1e-9 and abs(z[i] - (0.0 if xs.std() < 1e-6 else (r - xs.mean()) / xs.std())) < 1e-9
    assert got.keys() == {i for _, i, _ in rows} and dropped.keys() == got.keys() - {900}
    plan = groups.group_advantage_safe(df, "grp", "reward")._jdf.queryExecution().toString()
    assert "Window" not in plan and "_salt" in plan


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, t int, v double, n long")
    assert groups.discounted_returns(empty, "k", "t", "v", 0.9).count() == 0
    assert ordering.greedy_pack(empty, "k", "t", "n", 10).count() == 0
    assert groups.group_advantage(empty, "k", "v").count() == 0
