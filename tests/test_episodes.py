from pyspark.sql import functions as F

from tessera.operators import episodes as E
from tessera.operators import ordering as O

CALLS = "e long, t long, p array<long>, c array<long>, lp array<double>, r double"


def test_later_calls_win_and_short_episodes_go(spark):
    rows = [(1, 0, [5], [6, 7], [-0.1, -0.2], 0.0), (1, 1, [5, 6], [8, 9], [-0.3, -0.4], 2.0), (2, 0, [1], [], [], 1.0), (3, 0, [], [4, 4], [-1.0, -2.0], None)]
    out = {r.e: r for r in E.training_rows(spark.createDataFrame(rows, CALLS), "e", "t", "p", "c", "lp", "r", binary=True).collect()}
    assert out.keys() == {1, 3}
    assert (out[1].tokens, out[1].mask, out[1].logprobs, out[1].reward) == ([5, 6, 8, 9], [1, 1, 1], [-0.1, -0.3, -0.4], 1.0)
    assert (out[3].mask, out[3].logprobs, out[3].reward) == ([1], [-1.0], 0.0)


def test_calls_extend_their_predecessor_up_to_a_trim(spark):
    rows = [(1, 0, [1], [2, 3], [], 0.0), (1, 1, [1, 2, 3, 9], [4], [], 0.0), (1, 2, [1, 2, 3, 9, 5, 6], [7], [], 0.0), (2, 0, [1], [2], [], 0.0), (2, 1, [1, 2], [3], [], 0.0)]
    calls = spark.createDataFrame(rows, CALLS)
    strict = {(r.e, r.t): (r.extends, r.gap) for r in E.assemble_calls(calls, "e", "t", "p", "c").collect()}
    assert strict == {(1, 0): (True, [1]), (1, 1): (True, [9]), (1, 2): (False, None), (2, 0): (True, [1]), (2, 1): (False, None)}
    loose = {(r.e, r.t): (r.extends, r.gap) for r in E.assemble_calls(calls, "e", "t", "p", "c", trim=1).collect()}
    assert loose[1, 2] == (True, [5, 6]) and loose[2, 1] == (True, [2])
    whole = E.trajectories(E.assemble_calls(calls.where("e = 1 and t < 2"), "e", "t", "p", "c"), "e", "t", "c").first()
    assert (whole.tokens, whole.mask) == ([1, 2, 3, 9, 4], [0, 1, 1, 0, 1])


def test_turn_boundaries_without_tags_and_at_edges(spark):
    rows = spark.createDataFrame([("abc", 2, 10), ("<t>ab", 0, 5), ("", 3, 3), ("ab<t>", 0, 5)], "x string, p int, n int")
    got = [[(s.start, s.end) for s in r[0]] for r in rows.select(E.turn_boundaries(F.col("x"), F.col("p"), F.col("n"), "<t>")).collect()]
    assert got == [[(2, 10)], [(0, 5)], [(3, 3)], [(0, 2), (2, 5)]]


def test_row_numbers_are_dense_over_more_rows_than_range_samples(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_013).alias("k"))
    out = O.with_row_number(df, "k").agg(F.min("row"), F.max("row"), F.count_distinct("row")).first()
    assert tuple(out) == (0, 59_999, 60_000)
    assert O.with_row_number(df.limit(0), "k").count() == 0


def test_drawn_places_are_in_range_and_repeatable(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    one, two = ([tuple(r) for r in O.drawn_places(df, 3, "k", 4, 7).orderBy("k", "slot").collect()] for _ in range(2))
    assert one == two and len(one) == 80 and {p for _, _, p in one} <= set(range(7))
