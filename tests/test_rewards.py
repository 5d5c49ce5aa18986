from pyspark.sql import functions as F

from tessera.functions import rewards as R
from tessera.operators import messages as M


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(column(F.col("t"))).collect()]


def test_number_cascade_takes_the_first_form_that_holds_a_number(spark):
    texts = ["[RESULT] none [/RESULT] <answer>3</answer>", "So 0.5 it is. Altogether 0.2", "x", "", None, "a 1,234.50 b", "[RESULT]7[/RESULT] 9", "0. 0. The end"]
    assert values(spark, texts, R.number_cascade) == ["3", "0.5", None, None, None, "1234.5", "7", "0"]


def test_equations(spark):
    texts = ["1+2*3", "(1+2)*3", "-(4/8)", "2 - -1", "1/0", "2**3", "4//2", "(1", "1)", "05", "1.5.2", "", "3(2)", "__import__", "--1", None]
    assert values(spark, texts, R.equation_value) == [7, 9, -0.5, 3, None, None, None, None, None, None, None, None, None, None, 1, None]


def test_numbers_with_six_digits(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.5, 100.0, 0.1234567, 123456.7, 2.0000001, 0.0, -3.25)], "x double").select(R.six_digits(F.col("x")))
    assert [r[0] for r in df.collect()] == ["1", "1.5", "100", "0.123457", "123457", "2", "0", "-3.25"]


def test_verdicts_need_each_index_once(spark):
    ok, gap, twice, text = ('{"verdicts": [%s]}' % ", ".join('{"index": %d, "pass": %s}' % p for p in ps) for ps in ([(2, "true"), (1, "false")], [(1, "true")], [(1, "true"), (1, "true")], [(1, "true"), (2, '"x"')]))
    assert values(spark, [ok, gap, twice, text, "no", None], lambda t: R.judge_verdicts(t, F.lit(2))) == [[False, True], None, None, None, None, None]


def test_leaf_sets_of_any_depth(spark):
    deep = '{"a": ' * 60 + '{"k": "V 1"}' + "}" * 60
    assert values(spark, [deep, "[1, [2, 1]]", "{", "null"], R.leaf_pairs) == [["k\x1fv1"], ["None\x1f1", "None\x1f2"], None, []]


def test_mixed_messages(spark):
    raw = '[{"role": "user", "content": null}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, "b", {"image": "i"}], "thinking": "t", "reasoning": "r", "trainable": false}, {"role": "assistant", "content": "c"}]'
    rows = spark.createDataFrame([(raw,), ('[{"content": "x"}]',), ("[]",)], "t string").select(M.normalize_messages(F.parse_json("t")).alias("m")).collect()
    first = rows[0].m
    assert [[(p.type, p.value) for p in m.parts] for m in first] == [[], [("thinking", "t"), ("text", "a"), ("text", "b"), ("image", "i")], [("text", "c")]]
    assert [m.trainable for m in first] == [False, False, True]
    assert rows[1].m is None and rows[2].m == []


def test_broken_rubric_rows_say_why(spark):
    rows = ['{"id": "a", "conversation": {"messages": [{"role": "user", "content": "q"}]}, "rubric_items": [{"criterion_text": "", "points": 1}]}', "{}", "3"]
    out = spark.createDataFrame([(x,) for x in rows], "t string").select(M.rubric_row(F.parse_json("t")).alias("r")).collect()
    assert [r.r.errors for r in out] == [["rubric"], ["id", "conversation", "rubric"], ["id", "conversation", "rubric"]]
    assert all(r.r.row is None for r in out)
