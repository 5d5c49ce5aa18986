"""Queries over answers, rewards, judge replies and chat messages of mixed shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rewards as R
from tessera.functions import text as T
from tessera.operators import messages as M
from tessera.plans.registry import query, table
from tessera.plans.rollout_queries import rounded


def said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def by_case(key: Column, forms: list[Column]) -> Column:
    out = forms[-1]
    for i, form in enumerate(forms[:-1]):
        out = F.when(key == i, form).otherwise(out)
    return out


def event() -> Column:
    return F.col("event_id")


def small() -> Column:
    return event() % 23


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat(event_id % 23, '000') WHEN 1 THEN concat(event_id % 23, '.5') WHEN 2 THEN (event_id % 23)::VARCHAR WHEN 3 THEN concat(event_id % 23, '1') END AS number FROM events")
def answer_cascade_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = [said("Steps 1, 2. [RESULT] $", small(), ",000 apples [/RESULT]"), said("<answer> about ", small(), ".50 </answer> 7"), said("so \\boxed{", small(), "} of 99"), said("we get 3, then ", small(), "1 left."), F.lit("none at all")]
    return table(spark, sf_dir, "events").select("event_id", R.number_cascade(by_case(event() % 5, forms)).alias("number"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat(event_id % 23, '.5') WHEN 1 THEN concat('-', event_id % 23 + 1) ELSE 'hello world' END AS answer, CASE WHEN event_id % 3 = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM events")
def boxed_or_last_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = by_case(event() % 3, [said("x \\boxed{ ", small(), ".50 } y"), said("first 4 is -", small() + 1, " apples"), F.lit(" Hello   World ")])
    found = R.comparable_answer(R.boxed_or_last_number(text))
    return table(spark, sf_dir, "events").select("event_id", found.alias("answer"), R.binary_reward(found, R.comparable_answer(F.lit("HELLO world"))).alias("reward"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM events")
def binary_answer_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = said("<answer>it is ", small(), "</answer>")
    return table(spark, sf_dir, "events").select("event_id", R.first_answer_reward(text, (small() + event() % 2).cast("string")).alias("reward"))


@query("SELECT event_id, event_id % 4 = 0 AS kept FROM events")
def teacher_filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = said(F.when(event() % 2 == 0, "<think>a</think>").otherwise(""), "<answer> ", small(), " </answer>")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(R.tagged_match(text, F.when(event() % 4 == 0, small()).otherwise(small() + 1).cast("string")), F.lit(False)).alias("kept"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 3 THEN 0.0 ELSE 0.5 END::DOUBLE AS format, CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.1 WHEN 2 THEN 0.3 ELSE 0.0 END::DOUBLE AS composite FROM events")
def countdown_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = event() % 7 + 1, event() % 5 + 1, event() % 3 + 1
    text = by_case(event() % 4, [said("<THINK>t</THINK><answer>9</answer><answer>(", a, " + ", b, ") *-", c, "</answer>"), said("<answer>", a, "+", b, "</answer>"), said("<answer>", a, "-", b, "/", c, "</answer>"), F.lit("I don't know")])
    target = F.when(event() % 4 == 0, -(a + b) * c).otherwise(1000)
    return rounded(table(spark, sf_dir, "events").select("event_id", R.countdown_rewards(text, F.array(a, b, c), target).alias("r")).select("event_id", "r.*"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 0.0 WHEN event_id % 2 = 0 THEN 1.0 ELSE round(1 / 3.0, 6) END::DOUBLE AS reward FROM events")
def result_set_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda n, x, y: said('[[ROWS]] [["old"]] then [[ROWS]] [["x ", ', n, ", ", x, ', true, null], ["y", ', y, "]]")
    pred = F.when(event() % 5 == 4, said("Error executing SQL query")).otherwise(shown(small(), "1.50", "2"))
    score = T.multiset_jaccard(R.result_rows(pred), R.result_rows(shown(small() + event() % 2, "1.5", "2.0000001")))
    return rounded(table(spark, sf_dir, "events").select("event_id", F.coalesce(score, F.lit(0.0)).alias("reward")))


@query("SELECT event_id, event_id % 3 < 2 AS parsed, CASE WHEN event_id % 3 < 2 THEN event_id % 2 = 0 END AS met, CASE WHEN event_id % 3 < 2 THEN concat('n', event_id) END AS why FROM events")
def judge_verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = said('{"explanation": "n', event(), '", "criteria_met": ', F.when(event() % 3 == 2, '"yes"').when(event() % 2 == 0, "true").otherwise("false"), "}")
    text = F.when(event() % 2 == 0, said("```json\n", body, "\n```")).otherwise(body)
    v = table(spark, sf_dir, "events").select("event_id", R.judge_verdict(text).alias("v"))
    return v.select("event_id", F.col("v").isNotNull().alias("parsed"), F.col("v.criteria_met").alias("met"), F.col("v.explanation").alias("why"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN [false, true] END AS passed FROM events")
def judge_verdict_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = by_case(event() % 3, [F.lit('{"index": 1, "pass": false}'), F.lit('{"index": 2, "pass": false}'), F.lit('{"index": 1, "pass": "no"}')])
    return table(spark, sf_dir, "events").select("event_id", R.judge_verdicts(said('{"verdicts": [{"index": 2, "pass": true}, ', last, "]}"), F.lit(2)).alias("passed"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round(2 / 3.0, 6) ELSE 0.0 END::DOUBLE AS f1, CASE WHEN event_id % 3 < 2 THEN 3 END AS n_leaves FROM events")
def leaf_pair_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda n: said('{"a": {"b": [', n, ', "$1,0', n, '"]}, "c": " X y", "d": null, "e": ""}')
    pred = F.when(event() % 3 == 2, F.lit("{broken")).otherwise(F.when(event() % 3 == 1, said('{"a": {"b": [', small(), ', "$9,0"]}, "c": " X y"}')).otherwise(made(small())))
    rows = table(spark, sf_dir, "events").select("event_id", R.leaf_pairs(pred).alias("p"), R.leaf_pairs(made(small())).alias("g"))
    return rounded(rows.select("event_id", R.set_f1(F.col("p"), F.col("g")).alias("f1"), F.when(F.col("p").isNotNull(), F.size("p")).alias("n_leaves")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('{\"k\": ', event_id, '}') END AS body FROM events")
def json_object_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = said("Sure: {", F.when(event() % 2 == 0, '"k": ').otherwise('"k" '), event(), "} ok")
    return table(spark, sf_dir, "events").select("event_id", T.json_between_braces(text).alias("body"))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages VARIANT): content as a string, a list of parts or an object by turn, some with thoughts, calls and flags."""
    quoted = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    bare = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    turn = F.col("turn")
    content = F.when(turn % 3 == 0, bare).when(turn % 3 == 1, said('[{"type": "text", "text": ', bare, '}, {"type": "image_url", "image_url": {"url": "u"}}]')).otherwise(said('{"type": "text", "text": ', bare, "}"))
    more = said(
        F.when(F.col("role") == "assistant", ', "reasoning": "", "reasoning_content": "why"').otherwise(""),
        F.when(turn % 4 == 1, ', "tool_calls": [{"name": "f", "args": {"x": 1}}, {"function": {"name": "g", "arguments": "{\\"y\\": 2}"}, "id": "i"}]').otherwise(""),
        F.when((F.col("conv_id") % 2 == 0) & (turn == 1), ', "weight": 0').otherwise(""),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said('{"role": "', F.col("role"), '", "content": ', content, more, "}").alias("m"))
    one = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]), ",").alias("ms"))
    return one.select("conv_id", F.parse_json(said("[", F.col("ms"), "]")).alias("messages"))


@query("""WITH f AS (SELECT conv_id, bool_or(conv_id % 2 = 0 AND turn = 1) AS flagged FROM conversations GROUP BY conv_id)
SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, CASE WHEN role = 'assistant' THEN 'thinking' ELSE 'text' END AS first_kind, (1 + (role = 'assistant')::INT + (turn % 3 = 1)::INT) AS n_parts,
 CASE WHEN turn % 4 = 1 THEN 'f{"x":1} g{"y":2}i' END AS calls, CASE WHEN flagged THEN CASE WHEN turn = 1 THEN false ELSE role = 'assistant' END END AS trainable FROM conversations JOIN f USING (conv_id)""")
def normalize_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_messages(spark, sf_dir).select("conv_id", F.posexplode(M.normalize_messages(F.col("messages"))).alias("place", "m"))
    calls = F.array_join(F.transform("m.tool_calls", lambda c: F.concat(c["name"], c["arguments"], F.coalesce(c["id"], F.lit("")))), " ")
    return rows.select("conv_id", "m.role", "place", F.col("m.parts")[0]["type"].alias("first_kind"), F.size("m.parts").alias("n_parts"), calls.alias("calls"), "m.trainable")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN coalesce(nullif(text, ''), '') ELSE concat('<|user|>', chr(10), coalesce(text, '')) END AS body FROM conversations")
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    messages = F.when(F.col("turn") % 2 == 1, F.array(F.struct(F.lit(None).cast("string").alias("role"), F.col("text").alias("content"))))
    return t.select("conv_id", "turn", M.extract_text(F.when(F.col("turn") % 2 == 0, F.col("text")), messages).alias("body"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE concat('p ', text) END AS first, 1 AS n FROM conversations")
def teacher_messages_for_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = lambda c: F.struct(F.lit("user").alias("role"), c.alias("content"))
    reply = F.struct(F.lit("assistant").alias("role"), F.lit("r").alias("content"))
    own = F.when(F.col("turn") % 3 != 0, F.array(user(said("p ", F.col("text"))), reply))
    picked = M.teacher_messages(own, F.slice(F.array(user(F.lit("x"))), 1, 0), F.array(user(F.col("text")), reply, reply))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", picked.alias("m")).select("conv_id", "turn", F.col("m")[0]["content"].alias("first"), F.size("m").alias("n"))


@query("SELECT doc_id, concat('[', lang, '] ', source, '!') AS shown FROM documents")
def jinja_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", M.mustache("[{{ lang }}] {{source}}!").alias("shown"))


@query("SELECT doc_id, n_chars * 2 + 1 AS v FROM documents WHERE n_chars > 400")
def lambda_and_sequential_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [lambda d: d.where("n_chars > 400"), lambda d: d.withColumn("v", F.expr("n_chars * 2")), lambda d: d.select("doc_id", (F.col("v") + 1).alias("v"))]
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    for step in steps:
        df = df.transform(step)
    return df


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['id'] WHEN 2 THEN ['conversation'] ELSE ['rubric'] END AS errors, CASE WHEN event_id % 4 = 0 THEN 2.5 END::DOUBLE AS points FROM events")
def rubric_row_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = event() % 4
    record = said('{"id": "', F.when(k == 1, "").otherwise("e"), '", "canary": "c", "conversation": {"messages": [', F.when(k == 2, "").otherwise('{"role": "user", "content": "q"}'), ']}, "rubric_items": [{"criterion_text": "t", "points": ', F.when(k == 3, "null").otherwise("2.5"), "}]}")
    rows = table(spark, sf_dir, "events").select("event_id", M.rubric_row(F.parse_json(record)).alias("r"))
    return rows.select("event_id", F.col("r.errors").alias("errors"), F.col("r.row.rubric_items")[0]["points"].alias("points"))


@query("SELECT event_id, concat('q', event_id) AS query, concat('d', i, ' ', event_id) AS document, CASE WHEN i = 0 THEN 9 ELSE 1 END AS score FROM events, range(3) AS r(i) WHERE event_id % 4 <> 0")
def natural_questions_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = said(F.when(event() % 4 == 0, "Query:").otherwise("Question:"), " q", event(), "\nAnswer: a\nDocument: d0 ", event(), "\nDocument: d1 ", event(), "\nDocument: d2 ", event())
    rows = table(spark, sf_dir, "events").select("event_id", M.question_documents(blob).alias("q")).where("q is not null")
    flat = rows.select("event_id", "q.query", F.posexplode("q.documents").alias("i", "document"))
    return flat.select("event_id", "query", "document", F.when(F.col("i") == 0, 9).otherwise(1).alias("score"))


@query("SELECT o_custkey, k AS code, concat('p', k) AS name FROM (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 10")
def api_response_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("o_orderkey").alias("k"), F.struct(said("p", F.col("o_orderkey")).alias("name"), F.lit(1).alias("rest")).alias("v"))
    replies = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    first = F.transform(F.slice(F.map_entries("m"), 1, 10), lambda e: F.struct(e["key"].alias("code"), e["value"]["name"].alias("name")))
    return replies.select("o_custkey", F.inline(first))
