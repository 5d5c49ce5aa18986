"""Queries over episodes of model calls, token tables, and searches in two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import episodes as E
from tessera.operators import evaluation as V
from tessera.operators import retrieval as S
from tessera.plans import derived as D
from tessera.plans.registry import query, table
from tessera.plans.rollout_queries import rounded

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
CALLS_SQL = f"""SELECT l_orderkey AS episode, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) - 1 AS turn, count(*) OVER (PARTITION BY l_orderkey) AS n,
 -l_discount - 0.01 AS lp0, -l_tax - 0.01 AS lp1, l_quantity AS q FROM lineitem"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode, turn, prompt, completion, logprobs, reward): each line is a call; its prompt is the calls before it, two tokens each, and a 7 after each."""
    li = table(spark, sf_dir, "lineitem")
    by = W.partitionBy("l_orderkey").orderBy(*ORDER)
    before = F.flatten(F.collect_list(F.array("l_partkey", "l_suppkey", F.lit(7).cast("long"))).over(by.rowsBetween(W.unboundedPreceding, -1)))
    return li.select(
        F.col("l_orderkey").alias("episode"), (F.row_number().over(by) - 1).alias("turn"), F.concat(F.array("l_orderkey"), before).alias("prompt"), F.array("l_partkey", "l_suppkey").alias("completion"),
        F.array(-F.col("l_discount") - 0.01, -F.col("l_tax") - 0.01).alias("logprobs"), F.col("l_quantity").alias("reward"),
    )


@query(f"WITH c AS ({CALLS_SQL}) SELECT episode, turn, 1 + 3 * turn AS start, 2 AS length FROM c")
def episode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.output_spans(calls(spark, sf_dir), "episode", "turn", "prompt", "completion")


@query(f"WITH c AS ({CALLS_SQL}) SELECT episode, 3 * max(n) AS n_tokens, 2 * max(n) AS n_trained, round(sum(lp0 + lp1), 6) + 0.0 AS total, max_by(q, turn) AS reward FROM c GROUP BY episode")
def episode_to_training_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.training_rows(calls(spark, sf_dir), "episode", "turn", "prompt", "completion", "logprobs", "reward")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.select("episode", F.size("tokens").alias("n_tokens"), F.size(F.filter("mask", lambda m: m > 0)).alias("n_trained"), add("logprobs").alias("total"), "reward"))


def broken_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth episode's third prompt begins with another token."""
    wrong = (F.col("episode") % 10 == 0) & (F.col("turn") == 2)
    return calls(spark, sf_dir).withColumn("prompt", F.when(wrong, F.transform("prompt", lambda x, i: F.when(i == 0, F.lit(-1).cast("long")).otherwise(x))).otherwise(F.col("prompt")))


@query(f"WITH c AS ({CALLS_SQL}) SELECT episode, turn, NOT (episode % 10 = 0 AND turn IN (2, 3)) AS extends, CASE WHEN NOT (episode % 10 = 0 AND turn IN (2, 3)) THEN 1 END AS n_gap FROM c")
def multi_turn_assembler(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.assemble_calls(broken_calls(spark, sf_dir), "episode", "turn", "prompt", "completion")
    return rows.select("episode", "turn", "extends", F.when(F.col("extends"), F.size("gap")).alias("n_gap"))


@query(f"WITH c AS ({CALLS_SQL}) SELECT episode, 3 * max(n) AS n_tokens, 2 * max(n) AS n_trained FROM c GROUP BY episode HAVING NOT (episode % 10 = 0 AND max(n) > 2)")
def assembled_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.trajectories(E.assemble_calls(broken_calls(spark, sf_dir), "episode", "turn", "prompt", "completion", trim=1), "episode", "turn", "completion")
    return rows.select("episode", F.size("tokens").alias("n_tokens"), F.size(F.filter("mask", lambda m: m > 0)).alias("n_trained"))


@query("WITH p AS (SELECT event_id, event_id % 50 AS a, event_id % 50 + 48 AS n FROM events), s AS (SELECT event_id, 10 + a * 100 // n AS s1, 10 + (a + 31) * 100 // n AS s2 FROM p) SELECT event_id, CASE WHEN s1 = 10 THEN [10, s2] ELSE [10, s1, s2] END AS starts FROM s")
def turn_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.repeat(F.lit("x"), (F.col("event_id") % 50).cast("int")), F.lit("<tool_call>" + "y" * 20 + "</tool_call>zzzzz"))
    spans = E.turn_boundaries(text, F.lit(10), F.lit(110), "</?tool_call>")
    return table(spark, sf_dir, "events").select("event_id", F.transform(spans, lambda s: s["start"]).alias("starts"))


@query(f"WITH t AS ({D.TOKENS_SQL}) SELECT sample, pos, round(adv * CASE WHEN mask > 0.5 THEN least(exp(old - inf), 1.02) ELSE 0.0 END, 6) + 0.0 AS advantage FROM t")
def build_grpo_datums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.token_advantages(D.tokens(spark, sf_dir), cap=1.02))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['', '', 'c', 'd'] ELSE ['', '', 'a', 'b'] END AS routing FROM events")
def r3_validate_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = lambda s: F.array(*[F.lit(x) for x in s])
    return table(spark, sf_dir, "events").select("event_id", E.align_routing(F.when(F.col("event_id") % 2 == 0, letters("abcd")).otherwise(letters("ab")), F.lit(2), F.lit(4)).alias("routing"))


@query(f"WITH c AS ({CALLS_SQL}), p AS (SELECT episode, exp(lp0) + exp(lp1) AS mass, -exp(lp0) * lp0 - exp(lp1) * lp1 AS h FROM c) SELECT episode, round(avg(h), 6) + 0.0 AS entropy, round(min(mass), 6) + 0.0 AS least, round(max(mass), 6) + 0.0 AS most, 2 * count(*) AS slots FROM p GROUP BY episode")
def teacher_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("turn", "completion", "logprobs")))
    g = calls(spark, sf_dir).groupBy("episode").agg(rows.alias("r"))
    candidates = E.teacher_candidates(F.transform("r", lambda x: x["completion"]), F.transform("r", lambda x: x["logprobs"]))
    return rounded(g.select("episode", E.teacher_mass(candidates).alias("t")).select("episode", "t.*"))


@query(f"WITH t AS ({D.TOKENS_SQL}) SELECT count(DISTINCT sample) AS n_samples, count(*) - count(DISTINCT sample) AS target_tokens, sum(mask)::BIGINT AS trainable FROM t")
def total_target_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = D.tokens(spark, sf_dir).groupBy("sample").agg((F.count(F.lit(1)) - 1).alias("targets"), F.sum("mask").alias("trained"))
    return per.agg(F.count(F.lit(1)).alias("n_samples"), F.sum("targets").alias("target_tokens"), F.sum("trained").alias("trainable"))


@query(f"WITH t AS ({D.TOKENS_SQL}) SELECT mask AS part, round(sum(-pi) / nullif(sum(CASE WHEN mask > 0 THEN 1 ELSE 0 END), 0), 6) + 0.0 AS loss, count(*) FILTER (mask > 0) AS tokens, round(exp(sum(-pi) / nullif(sum(CASE WHEN mask > 0 THEN 1 ELSE 0 END), 0)), 6) + 0.0 AS perplexity FROM t GROUP BY mask")
def eval_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By mask value: null where no token has weight."""
    t = D.tokens(spark, sf_dir).groupBy(F.col("mask").alias("part")).agg(F.sum(-F.col("pi")).alias("nll"), F.count_if(F.col("mask") > 0).alias("tokens"))
    loss = F.try_divide("nll", F.nullif(F.col("tokens"), F.lit(0)))
    return rounded(t.select("part", loss.alias("loss"), "tokens", F.exp(loss).alias("perplexity")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


STAGES_SQL = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, embedding[1:16]::DOUBLE[] AS s FROM embeddings),
a AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_cosine_similarity(q.s, d.s), 9) AS coarse, round(list_cosine_similarity(q.v, d.v), 9) AS fine FROM e q, e d WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coarse DESC, doc_id) AS c, row_number() OVER (PARTITION BY qid ORDER BY fine DESC, doc_id) AS f FROM a)"""


@query(f"WITH {STAGES_SQL}, k AS (SELECT qid, doc_id, fine, row_number() OVER (PARTITION BY qid ORDER BY fine DESC, doc_id) AS rank FROM r WHERE c <= 20) SELECT qid, doc_id, round(fine, 6) + 0.0 AS score, rank FROM k WHERE rank <= 5")
def two_stage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir)
    recalled = S.cosine_top_k(e.where("id % 100 = 0"), e, 20, dims=16)
    return rounded(S.rerank(recalled, e, 5))


GOLD_SQL = f"WITH {STAGES_SQL} SELECT qid, f AS rank FROM r WHERE doc_id = qid + 1"


@query(GOLD_SQL)
@query(GOLD_SQL, name="rank_of_gold_whole")
def rank_of_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each query's gold row among all rows."""
    e = vectors(spark, sf_dir)
    q = e.where("id % 100 = 0")
    gold = q.select(F.col("id").alias("qid"), (F.col("id") + 1).alias("doc_id"))
    return S.whole_rank_of_gold(q, e, gold).where("rank is not null").select("qid", "rank")


@query(f"WITH {STAGES_SQL}, g AS (SELECT c - f AS d FROM r WHERE doc_id = qid + 1) SELECT count(*) FILTER (d > 0) AS improved, count(*) FILTER (d = 0) AS unchanged, count(*) FILTER (d < 0) AS worse, round(avg(d), 6) + 0.0 AS mean_change FROM g")
def rank_delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir)
    q = e.where("id % 100 = 0")
    gold = q.select(F.col("id").alias("qid"), (F.col("id") + 1).alias("doc_id"))
    ranks = [S.whole_rank_of_gold(q, e, gold, dims=d).select("qid", "rank") for d in (16, None)]
    return rounded(S.rank_delta(*ranks))


@query("SELECT o_orderpriority, max(o_totalprice) > 400000 AS over, count(*) AS returned, count(*) FILTER (o_orderstatus = 'P') AS cut, count(*) >= 10 AND count(*) FILTER (o_orderstatus = 'P') = 0 AS complete FROM orders GROUP BY o_orderpriority")
def eval_completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg((F.max("o_totalprice") > 400000).alias("over"), F.count(F.lit(1)).alias("returned"), F.count_if(F.col("o_orderstatus") == "P").alias("cut"))
    return g.withColumn("complete", V.complete(F.col("returned"), F.lit(10), F.col("cut")))


@query("SELECT doc_id, strlen(text) // 3 * 4 + CASE WHEN strlen(text) % 3 > 0 THEN 4 ELSE 0 END AS size FROM documents WHERE strlen(text) // 3 * 4 + CASE WHEN strlen(text) % 3 > 0 THEN 4 ELSE 0 END <= 4000")
def doc_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", (F.floor((n + 2) / 3) * 4).alias("size")).where("size <= 4000")


@query("SELECT item_id, count(*) FILTER (x = 'a') AS n FROM (SELECT item_id, unnest(string_split(text, '')) AS x FROM benchmark) GROUP BY item_id")
def character_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_count("text", F.lit("a")).cast("long").alias("n"))


@query("SELECT user_id, round(sum(value), 4) + 0.0 AS total, round(max(value), 4) + 0.0 AS top, round(sum(value) / 30, 4) + 0.0 AS per_day, count(DISTINCT ts::DATE) AS days FROM events GROUP BY user_id")
def daily_usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("total"), F.max("value").alias("top"), (F.sum("value") / 30).alias("per_day"), F.count_distinct(F.to_date("ts")).alias("days"))
    return rounded(g, 4)


@query("SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS last, round(avg((o_orderstatus = 'F')::INT), 6) + 0.0 AS accuracy, count(*) AS n FROM orders GROUP BY o_custkey")
def accuracy_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("last"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return rounded(g.orderBy(F.desc("accuracy"), "o_custkey"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value WHEN event_id % 2 = 0 THEN value + 1 END AS norm FROM events")
def optimizer_metric_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("event_id"), F.col("value")
    metrics = F.map_filter(F.map_from_arrays(F.array(F.lit("norm"), F.lit("norm:last")), F.array(F.when(k % 3 != 0, v), F.when(k % 2 == 0, v + 1))), lambda _, x: x.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(metrics, F.lit("norm")), F.try_element_at(metrics, F.lit("norm:last"))).alias("norm"))
