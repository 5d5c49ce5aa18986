import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import trees as T

SCHEMA = "node long, parent long, prompt_ids array<long>, output_ids array<long>, logs array<double>, leaf string, begin int"


def plain(turns, limit):
    """{(leaf, end): (begin, n_turns, split, prompt, response, mask, values)}, path by path as they come."""
    by = {t[0]: t for t in turns}
    parents = {t[1] for t in turns if t[1] in by}
    trained, out = set(), {}
    for leaf in sorted(n for n in by if n not in parents):
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = by[at][1] if by[at][1] in by else None
        parts = []
        for n in reversed(path):
            prompt, output = by[n][2] or [], by[n][3] or []
            if parts:
                base, tokens = parts[-1][1], parts[-1][2]
                if prompt[: len(tokens)] == tokens:
                    parts[-1][2], parts[-1][3] = prompt + output, [*parts[-1][3], n]
                    continue
            split = None if not parts else "base" if prompt[: len(base)] != base else "suffix"
            parts.append([split, prompt, prompt + output, [n]])
        for split, base, tokens, nodes in parts:
            response = tokens[len(base) :]
            if not response or (limit and len(tokens) > limit):
                continue
            mask, values = [0] * len(response), [0.0] * len(response)
            own = [n for n in nodes if n not in trained and by[n][3]]
            for n in own:
                a = len(by[n][2] or []) - len(base)
                mask[a : a + len(by[n][3])] = [1] * len(by[n][3])
                values[a : a + len(by[n][3])] = by[n][4]
            if own:
                out[leaf, nodes[-1]] = (nodes[0], len(nodes), split, base, response, mask, values)
                trained |= set(own)
    return out


def random_turns(seed, n):
    rng, turns = random.Random(seed), []
    for i in range(n):
        parent = rng.choice([None, 5000, *[t[0] for t in turns[-6:]], *[t[0] for t in turns[:2]]]) if turns else None
        above = next((t for t in turns if t[0] == parent), None)
        said = (above[2] or []) + (above[3] or []) if above else [rng.randrange(9) for _ in range(rng.randrange(4))]
        prompt = said + [rng.randrange(9) for _ in range(rng.randrange(3))]
        if rng.random() < 0.15 and prompt:
            prompt[rng.randrange(len(prompt))] += 10
        if rng.random() < 0.05:
            prompt = prompt[:-1]
        output = [rng.randrange(9) for _ in range(rng.randrange(4))]
        turns.append((i * 7 % n if n % 7 else i, parent, prompt or None, output or None, [float(x) / 4 for x in range(len(output))] or None))
    return turns


@pytest.mark.parametrize(("seed", "limit"), [(1, 0), (2, 12), (3, 6)])
def test_segments_equal_paths_taken_one_by_one(spark, seed, limit):
    turns = random_turns(seed, 120)
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], SCHEMA).repartition(3)
    segments = T.owned_segments(df, limit, values="logs")
    rows = {(r.leaf, r.end): r for r in T.training_rows(segments, df).collect()}
    got = {(s.leaf, s.end): (s.begin, s.n_turns, s.split, (r := rows[s.leaf, s.end]).prompt_ids, r.response_ids, r.loss_mask, r.response_values) for s in segments.collect()}
    want = plain(turns, limit)
    assert got == want and len(want) > 5 and any(len(w[5]) > sum(w[5]) for w in want.values())
    if not limit:
        assert sum(sum(w[5]) for w in want.values()) == sum(len(t[3] or []) for t in turns)  # each output is learned once


def test_a_chain_of_100000_turns(spark):
    n = 100_000
    nodes = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.when(F.col("id") == n - 1, 5).alias("value"))
    roots = T.chain_roots(nodes)
    assert roots.where("root = 0 and depth = node").count() == n
    assert T.subtree_min(nodes).where("least = 5").count() == n


def test_a_root_with_a_million_leaves(spark):
    n = 1_000_000
    nodes = spark.range(n + 1).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.lit(0)).alias("up"), F.when(F.col("id") > 0, F.col("id")).alias("value"))
    least = T.subtree_min(nodes)
    assert least.where("node = 0").first().least == 1 and least.where("node > 0 and least = node").count() == n
    tree = spark.range(n + 1).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.lit(0)).alias("parent"), F.array(F.lit(1), *[F.lit(2), F.lit(3)]).alias("p"), F.array("id").alias("o"))
    turns = tree.select("node", "parent", F.when(F.col("node") == 0, F.slice("p", 1, 1)).otherwise(F.array(F.lit(1), F.lit(0))).cast("array<long>").alias("prompt_ids"), F.col("o").alias("output_ids"))
    segments = T.owned_segments(turns)
    assert segments.count() == n and segments.where(F.size("spans") == 2).select("leaf").collect()[0].leaf == 1
    assert segments.agg(F.sum(F.size("spans"))).first()[0] == n + 1


def test_cycles_are_refused_and_empty_trees(spark):
    with pytest.raises(ValueError, match="own ancestor"):
        T.chain_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, up long"))
    empty = spark.createDataFrame([], SCHEMA)
    assert T.owned_segments(empty).count() == 0
    lone = spark.createDataFrame([(1, 99, None, None, None, "", 0), (2, 98, None, [4], [0.5], "", 0)], SCHEMA)
    assert [(s.leaf, s.n_prompt, s.n_tokens) for s in T.owned_segments(lone).collect()] == [(2, 0, 1)]


def test_rounds_write_no_more_rows_than_a_few_times_the_nodes(spark, monkeypatch):
    monkeypatch.setattr(T, "SMALL", 50, raising=False)
    n, written, plain_written = 3000, [], T.Rounds.written

    def counted(rounds, df):
        out = plain_written(rounds, df)
        written.append(out.count())
        return out

    monkeypatch.setattr(T.Rounds, "written", counted)
    nodes = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 3)).alias("up"), (-F.col("id")).alias("value"))
    least = {r.node: r.least for r in T.subtree_min(nodes).collect()}
    last = lambda k: k if 3 * k + 1 >= n else max(last(c) for c in range(3 * k + 1, min(n, 3 * k + 4)))
    assert least == {k: -last(k) for k in range(n)} and sum(written) <= 2 * n
    written.clear()
    depth = lambda k: 0 if k == 0 else 1 + depth((k - 1) // 3)
    assert {(r.node, r.root, r.depth) for r in T.chain_roots(nodes).collect()} == {(k, 0, depth(k)) for k in range(n)} and sum(written) <= 3 * n


def test_segments_of_layers_equal_paths_taken_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(T, "SMALL", 5, raising=False)
    turns = random_turns(2, 120)
    segments = T.owned_segments(spark.createDataFrame([(*t, "x", 1) for t in turns], SCHEMA), 12)
    assert {(s.leaf, s.end): (s.begin, s.n_turns, s.split) for s in segments.collect()} == {k: v[:3] for k, v in plain(turns, 12).items()}
