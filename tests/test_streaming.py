from tessera.streaming import assembler


def run(spark, df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_groups_close_by_count_over_batches(spark, tmp_path):
    schema = "grp long, run long, reward double, version long"
    for i, rows in enumerate([[(1, 1, 0.5, 3), (1, 2, None, 1), (2, 1, 1.0, 1)], [(1, 3, 1.5, 2), (2, 2, None, 1), (2, 3, None, 1), (3, 1, 1.0, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.grp: r for r in run(spark, assembler.assemble_groups(stream, expected=3, smallest=2), "closed")}
    assert got.keys() == {1, 2}
    assert (got[1].n_runs, got[1].n_dropped, got[1].mean_reward, got[1].min_version, got[1].kept) == (2, 1, 1.0, 2, True)
    assert (got[2].n_runs, got[2].n_dropped, got[2].kept) == (1, 2, False)


def test_closed_groups_leave_no_state(spark, tmp_path):
    from tessera.streaming import runs

    schema = "grp long, run long, reward double, version long"
    rows = [(g, r, None if r % 5 == 0 else float(r), r % 3) for g in range(6) for r in range(1000 if g == 0 else 4 + g % 2)]
    for part in (0, 1):
        spark.createDataFrame([x for x in rows if (x[1] >= 500) == bool(part)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = assembler.assemble_groups(runs.source(spark, str(tmp_path / "in"), schema), expected=4)
    closed = runs.drained(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    assert {r.grp: r["count"] for r in closed.groupBy("grp").count().collect()} == {0: 250, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    assert closed.agg({"n_runs": "sum", "n_dropped": "sum"}).first().asDict() == {"sum(n_runs)": sum(x[2] is not None for x in rows) - 3, "sum(n_dropped)": sum(x[2] is None for x in rows)}
    assert runs.snapshot(spark, str(tmp_path / "c")).count() == 3  # groups 1, 3 and 5 wait with one run each


def test_batches_and_admission(spark):
    rows = assembler.optimizer_batches(spark.range(10), "id", 4, 2).collect()
    assert {r.id: (r.batch, r.chunk) for r in rows}[7] == (1, 1) and len(rows) == 10
    caps = assembler.admission(spark.createDataFrame([(0, 0, 0, 0), (1, 9, 9, 9)], "version long, offset long, accepted long, reserved long"), 4, 1, 6).collect()
    assert [r.capacity for r in caps] == [6, 0]


def test_upserts_follow_micro_batches_and_repeats_change_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming import runs

    for rows in ([(1, 1), (2, 2)], [(1, 5), (3, 3)], [(1, 4)]):
        spark.createDataFrame(rows, "k long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = runs.source(spark, str(tmp_path / "in"), "k long, n long")
    table = runs.upsert_on_change(stream, "k", "n", lambda df: df.withColumn("twice", F.col("n") * 2), str(tmp_path / "t"), str(tmp_path / "c"))
    got = {r.k: r.twice for r in table.collect()}
    assert got.keys() == {1, 2, 3} and (got[2], got[3]) == (4, 6) and got[1] in (8, 10)
    spark.createDataFrame([(2, 9)], "k long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # goes on from its checkpoint; with nothing new the table stays
        table = runs.upsert_on_change(stream, "k", "n", lambda df: df.withColumn("twice", F.col("n") * 2), str(tmp_path / "t"), str(tmp_path / "c"))
        assert {r.k: r.twice for r in table.collect()} == got | {2: 18}
    out = runs.drained(runs.source(spark, str(tmp_path / "in"), "k long, n long"), str(tmp_path / "o"), str(tmp_path / "p"))
    assert out.count() == 6
    again = runs.drained(runs.source(spark, str(tmp_path / "in"), "k long, n long"), str(tmp_path / "o"), str(tmp_path / "p"))
    assert again.count() == 6


def test_upserts_write_changed_buckets_only(spark, tmp_path):
    from tessera.streaming import runs

    for rows in ([(k, 1) for k in range(200)], [(7, 5)]):
        spark.createDataFrame(rows, "k long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = runs.source(spark, str(tmp_path / "in"), "k long, n long")
        table = runs.upsert_on_change(stream, "k", "n", lambda df: df, str(tmp_path / "t"), str(tmp_path / "c"), buckets=8)
    assert {r.k: r.n for r in table.collect()} == {k: 5 if k == 7 else 1 for k in range(200)}
    assert len(list((tmp_path / "t" / "version=1").glob("bucket=*"))) == 1 and len(runs.newest(spark, str(tmp_path / "t"))) == 8


def test_groups_close_in_order_of_runs_over_arrow_batches(spark, tmp_path):
    from tessera.streaming import runs

    schema = "grp long, run long, reward double, version long"
    spark.createDataFrame([(1, r, float(r), r) for r in reversed(range(100))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        got = runs.drained(assembler.assemble_groups(runs.source(spark, str(tmp_path / "in"), schema), expected=4), str(tmp_path / "out"), str(tmp_path / "c")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.min_version, r.mean_reward) for r in got) == [(4 * k, 4 * k + 1.5) for k in range(25)]


def test_parts_are_micro_batches_however_many_files_they_have(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming import runs

    rows = spark.range(200).select("id", F.when(F.col("id") < 199, F.floor(F.col("id") / 100)).otherwise(2).alias("part"))  # the last part has one row
    runs.write_in_order(rows, "part", "id", 3, str(tmp_path / "in"), split=4)
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 12
    done = runs.publish(runs.source(spark, str(tmp_path / "in"), "id long", files=4), str(tmp_path / "out"), str(tmp_path / "c"))
    assert {r.batch: (r.n, r.least) for r in done.groupBy("batch").agg(F.count("id").alias("n"), F.min("id").alias("least")).collect()} == {0: (100, 0), 1: (99, 100), 2: (1, 199)}


ROLLOUTS = "grp long, run long, reward double, version long"


def groups_of(spark, path, batches, expected, end=True, schema=ROLLOUTS, **how):
    """Closed groups of a stream with a micro-batch for each list of rows."""
    import os

    from tessera.streaming import runs

    for k, rows in enumerate(batches):
        before = set((path / "in").glob("*.parquet"))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        for new in set((path / "in").glob("*.parquet")) - before:
            os.utime(new, (1_000_000 + k, 1_000_000 + k))
    if end:
        runs.end(spark, str(path / "in"), schema)
    stream = assembler.assemble_groups(runs.source(spark, str(path / "in"), schema), expected, ends=end, **how)
    return runs.drained(stream, str(path / "out"), str(path / "c"))


def test_groups_that_wait_at_the_end_are_drained(spark, tmp_path):
    from tessera.streaming import runs

    batches = [[(1, 1, 1.0, 5), (2, 2, 1.0, 7)], [(1, 3, None, 2), (2, 4, 3.0, 9)], [(3, 5, 1.0, 1)], [(1, 6, 4.0, 8), (1, 7, 5.0, 8), (1, 8, 6.0, 6)], [(4, 9, None, 1)], [(1, 10, 8.0, 7)]]
    got = {(r.grp, r.drained): r for r in groups_of(spark, tmp_path, batches, expected=4, smallest=2).collect()}
    assert got.keys() == {(1, False), (1, True), (2, True)}  # 3 has one run, 4 has none: gone without a row
    whole, rest, two = got[1, False], got[1, True], got[2, True]
    assert (whole.runs, whole.rewards, whole.n_dropped, whole.kept) == ([1, 6, 7], [1.0, 4.0, 5.0], 1, True)
    assert (whole.min_version, whole.min_submit_version) == (5, 2)  # the oldest run that was begun was dropped
    assert (rest.runs, rest.n_runs, rest.n_dropped, rest.mean_reward, rest.min_submit_version) == ([8, 10], 2, 0, 7.0, 6)
    assert (two.runs, two.min_submit_version) == ([2, 4], 7)
    assert runs.snapshot(spark, str(tmp_path / "c")).count() == 0


def test_without_an_end_groups_wait(spark, tmp_path):
    from tessera.streaming import runs

    assert groups_of(spark, tmp_path, [[(1, 1, 1.0, 1), (1, 2, 2.0, 1)]], expected=3, end=False).count() == 0
    assert runs.snapshot(spark, str(tmp_path / "c")).count() == 1


def test_groups_get_advantages_when_they_close(spark, tmp_path):
    import numpy as np
    import pytest
    from pyspark.sql import functions as F

    rewards = {1: [1.0, 2.0, 4.0], 2: [3.0, 3.0, 3.0], 3: [1.0, None, None], 4: [1.0, float("nan"), 2.0], 5: [1.0, float("inf"), 2.0], 6: [None, None, None]}
    rows = [(g, 10 * g + k, r, 1) for g, rs in rewards.items() for k, r in enumerate(rs)]
    got = {r.grp: r for r in groups_of(spark, tmp_path, [rows[:8], rows[8:]], expected=3, end=False).collect()}
    assert {g: r.kept for g, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}  # one run has no deviation
    x = np.array(rewards[1])
    assert np.allclose(got[1].advantages, (x - x.mean()) / (x.std(ddof=1) + 1e-8)) and got[2].advantages == [0.0, 0.0, 0.0]
    assert [got[g].advantages for g in (3, 4, 5, 6)] == [None] * 4
    assert [(got[g].n_runs, got[g].n_dropped) for g in (3, 4, 6)] == [(1, 2), (3, 0), (0, 3)] and np.isnan(got[4].rewards[1])
    own = {r.grp: r.advantages for r in groups_of(spark, tmp_path / "own", [rows], expected=3, end=False, advantages=lambda r: r).collect()}
    assert own[3] == [1.0] and own[4] is None
    with pytest.raises(Exception, match="one advantage for each run"):
        groups_of(spark, tmp_path / "few", [rows], expected=3, end=False, advantages=lambda r: F.slice(r, 1, 1)).collect()
    with pytest.raises(ValueError, match="at least 1"):
        groups_of(spark, tmp_path / "none", [rows], expected=3, end=False, smallest=0)


def test_groups_with_nulls(spark, tmp_path):
    far = 2**60 + 1  # no float has it
    rows = [(None, far, 1.0, None), (None, far + 2, 2.0, far), (None, None, 4.0, far + 2), (7, 1, 1.0, None), (7, 2, None, None)]
    got = {r.grp: r for r in groups_of(spark, tmp_path, [rows], expected=2, end=False).collect()}
    assert (got[None].runs, got[None].min_version, got[None].min_submit_version) == ([far, far + 2], far, far)
    assert (got[7].runs, got[7].min_version, got[7].min_submit_version) == ([1], None, None)
    ended = {r.grp: r for r in groups_of(spark, tmp_path / "e", [[r for r in rows if r[0] or r[1]]], expected=3, smallest=2).collect()}
    assert ended.keys() == {None} and ended[None].drained and ended[None].runs == [far, far + 2]


def test_groups_are_packed_for_training(spark, tmp_path):
    import json

    import pytest

    from tessera.operators.episodes import pack_groups

    def segment(tokens, mask, **more):
        return {"tokens": tokens, "logprobs": [-x / 4 for x in tokens], "loss_mask": mask} | more

    two = [segment([1, 2, 3, 4], [0, 0, 1, 1], raw_logprobs=[0.0, -1.0, -2.0, -3.0], routing=["a", "b", "c"], finish_reason="length"), segment([5, 6], [0, 1])]
    one = [segment([7, 8, 9, 9], [0, 1, 0, 1], routing=["b", "b", "c"])]
    rows = [(1, 1, None, 1, None, "first"), (1, 2, 1.0, 1, json.dumps(two), "second"), (1, 3, 3.0, 1, json.dumps(one), None), (2, 4, 1.0, 1, None, None), (2, 5, None, 1, None, None)]
    schema = ROLLOUTS + ", payload string, meta string"
    closed = groups_of(spark, tmp_path, [rows[:1], rows[1:]], expected=3, smallest=2, end=True, schema=schema)
    assert [r.grp for r in closed.collect()] == [1]
    r = pack_groups(closed, with_reference=True).first()
    a, b, c = r.data
    assert (r.meta, r.trainable_tokens) == ("first", [3, 2])
    assert [d.run for d in r.data] == [2, 2, 3] and a.advantage == b.advantage == -c.advantage == r.advantages[0] < 0
    assert (a.tokens, a.target_tokens, a.weights, a.inf_logprobs, a.raw_inf_logprobs) == ([1, 2, 3], [2, 3, 4], [0, 1, 1], [-0.5, -0.75, -1.0], [-1.0, -2.0, -3.0])
    assert [(d.prompt_len, d.completion_len, d.truncated) for d in r.data] == [(2, 2, True), (1, 1, False), (1, 2, False)]
    assert (a.routing, b.routing, c.routing) == (["a", "b", "c"], None, ["b", "b", "c"]) and b.raw_inf_logprobs == []
    assert [(d.tokens, d.target_tokens, d.loss_mask) for d in r.ref_data] == [(d.tokens, d.target_tokens, d.weights) for d in r.data]
    blank = pack_groups(closed, completion_only=True).first().data
    assert (blank[0].routing, blank[2].routing) == (["", "b", "c"], ["b", "b", "c"])
    parts = {"no segments": [None, "[]"], "unlike lengths": [segment([1, 2], [0, 1, 1])], "fewer than two": [segment([1], [1])], "trains no token": [segment([1, 2], [0, 0])]}
    for why, wrong in parts.items():
        for x in wrong:
            payload = x if x is None or isinstance(x, str) else json.dumps([x])
            bad = spark.createDataFrame([(1, True, [1], [0.5], [payload])], "grp long, kept boolean, runs array<long>, advantages array<double>, payloads array<string>")
            with pytest.raises(Exception, match=why):
                pack_groups(bad).collect()
