"""Row builders and expanders: training rows from questions, rankings, rubrics and episodes."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.skew import salted_lookup
from tessera.sources.scratch import scratch


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def question_row(question: Column, truth: Column, system: str | None = None) -> Column:
    """(messages, ground_truth) with an optional system message before the question."""
    head = [message("system", F.lit(system))] if system else []
    return F.struct(F.array(*head, message("user", question)).alias("messages"), truth.alias("ground_truth"))


def privileged_row(messages: Column, answer: Column) -> Column:
    """(messages, teacher_messages, expected_answer): the teacher also sees the answer; system turns go."""
    plain = F.filter(messages, lambda m: m["role"] != "system")
    hint = F.array(message("system", F.concat(F.lit("The answer is "), answer)))
    return F.struct(plain.alias("messages"), F.concat(hint, plain).alias("teacher_messages"), answer.alias("expected_answer"))


def trimmed_preference(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """(prompt, chosen, rejected) trimmed; null if any is empty or both sides are the same."""
    p, c, r = F.trim(prompt), F.trim(chosen), F.trim(rejected)
    return F.when((p != "") & (c != "") & (r != "") & (c != r), F.struct(p.alias("prompt"), c.alias("chosen"), r.alias("rejected")))


def ranked_expand(positives: Column, negatives: Column, limit: int) -> Column:
    """Array of (document, score): positives score 9 up to the limit, negatives 1 for what is left of it."""
    pos = F.slice(positives, 1, limit)
    neg = F.slice(negatives, F.lit(1), F.greatest(F.lit(0), limit - F.size(pos)))
    scored = lambda xs, s: F.transform(xs, lambda d: F.struct(d.alias("document"), F.lit(s).alias("score")))
    return F.concat(scored(pos, 9), scored(neg, 1))


def rl_record(prompt: Column, completion: Column, logprobs: Column, reward: Column) -> Column:
    """(tokens, logprobs, mask, reward) with zeros for the prompt."""
    zeros = lambda v: F.transform(prompt, lambda _: F.lit(v))
    return F.struct(F.concat(prompt, completion).alias("tokens"), F.concat(zeros(0.0), logprobs).alias("logprobs"), F.concat(zeros(0), F.transform(completion, lambda _: F.lit(1))).alias("mask"), reward.alias("reward"))


def align_logprobs(values: Column, n: Column, prompt: Column) -> Column:
    """Log-probabilities for all n positions: completion-only ones are left-padded, echoed ones have null prompts made 0."""
    return F.when(F.size(values) == n - prompt, F.concat(F.array_repeat(F.lit(0.0), prompt.cast("int")), values)).when(F.size(values) == n, F.transform(values, lambda x, i: F.when(i < prompt, F.coalesce(x, F.lit(0.0))).otherwise(x)))


def validate(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], rules: dict[str, Column]) -> DataFrame:
    """df through the steps, with ``errors`` and ``valid``; every record stays."""
    for step in steps:
        df = df.transform(step)
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def field_errors(name: str, required: bool = True) -> Column:
    """'missing' or 'empty', null if neither."""
    c = F.col(name)
    return F.when(c.isNull() & F.lit(required), "missing").when(F.trim(c.cast("string")) == "", "empty")


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's last row in the order (a later one replaces an earlier)."""
    by = W.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def blend_top_k(df: DataFrame, by: str, mass: str, order: str, k: int) -> DataFrame:
    """The k largest masses of each position, earlier ones first among equals, renormalised."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(mass), order))).where(F.col("rank") <= k)
    return ranked.withColumn("p", F.col(mass) / F.sum(mass).over(W.partitionBy(by)))


def recall_by_query(df: DataFrame, query: str, score: str, order: str, label: str, k: int) -> DataFrame:
    """Per query with at least k rows: recall of the k best among the top label, over min(number of those, k)."""
    q = W.partitionBy(query)
    rows = df.withColumn("_r", F.row_number().over(q.orderBy(score, order))).withColumn("_n", F.count(F.lit(1)).over(q)).withColumn("_top", F.max(label).over(q)).where(F.col("_n") >= k)
    gold = F.col(label) == F.col("_top")
    return rows.groupBy(query).agg((F.count_if(gold & (F.col("_r") <= k)) / F.least(F.count_if(gold), F.lit(k))).alias("recall"), (F.lit(k) / F.max("_n")).alias("random"))


def turn_values(spans: DataFrame, key: str, start: str, end: str, turn: str, value: str, lengths: DataFrame, n: str) -> DataFrame:
    """(key, pos, value): each turn's value on positions [start - 1, end - 1), later turns over earlier ones; 0 elsewhere."""
    at = spans.select(key, turn, value, F.explode(F.sequence(F.greatest(F.col(start) - 1, F.lit(0)), F.greatest(F.col(end) - 2, F.lit(0)))).alias("pos")).where(F.col(end) - 1 > F.greatest(F.col(start) - 1, F.lit(0)))
    last = at.groupBy(key, "pos").agg(F.max_by(value, turn).alias("value"))
    every = lengths.select(key, F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)).alias("pos"))
    return every.join(last, [key, "pos"], "left").select(key, "pos", F.coalesce("value", F.lit(0.0)).alias("value"))


def judge_pairs(first: Column, swapped: Column) -> Column:
    """A or B only if the verdict in swapped order agrees, else tie."""
    flipped = F.when(swapped == "A", "B").when(swapped == "B", "A").otherwise("tie")
    return F.when(first == flipped, first).otherwise("tie")


def classify_turns(df: DataFrame, key: str, order: str, fingerprint: str) -> DataFrame:
    """NEW for a key's first turn, APPEND if the turn before is a prefix of the fingerprint, else WIPE."""
    before = F.lag(fingerprint).over(W.partitionBy(key).orderBy(order))
    prefix = F.slice(fingerprint, F.lit(1), F.size(before)) == before
    return df.withColumn("kind", F.when(before.isNull(), "NEW").when(prefix & (F.size(fingerprint) >= F.size(before)), "APPEND").otherwise("WIPE"))


def tree_paths(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(leaf, position, node): the path from the root to each leaf, of any depth.

    Each node's known ancestors double in each round (a join of the table with itself, written to cut the
    lineage), so a tree of depth d takes about log2(d) of them.  A shared node is owned (``owns``) by the first
    leaf below it.  A parent that is no node itself is a root; nodes that are their own ancestors raise.
    """
    spark, path = nodes.sparkSession, scratch(nodes.sparkSession, "tree")
    known = nodes.select(F.col(node).alias("_n"), F.array(F.col(node)).alias("path"), F.col(parent).alias("up"))
    inner = nodes.select(F.col(parent).alias("_n")).where("_n is not null").distinct()
    for k in count():
        known.write.parquet(f"{path}/{k}")
        known = spark.read.parquet(f"{path}/{k}")
        open_ones = known.where("up is not null")
        if open_ones.isEmpty():
            break
        if not open_ones.where(F.array_contains("path", F.col("up"))).isEmpty():
            raise ValueError("a node is its own ancestor")
        above = known.select(F.col("_n").alias("_a"), F.col("path").alias("_above"), F.col("up").alias("_next"))
        met = known.join(above, F.col("up") == F.col("_a"), "left")
        longer = F.concat(F.coalesce("_above", F.array("up")), "path")
        known = met.select("_n", F.when(F.col("up").isNull(), F.col("path")).otherwise(longer).alias("path"), F.col("_next").alias("up"))
    leaves = known.join(inner, "_n", "left_anti")
    flat = leaves.select(F.col("_n").alias("leaf"), F.posexplode("path").alias("position", "node"))
    owner = flat.groupBy("node").agg(F.min("leaf").alias("_owner"))  # in part before the shuffle: a root is on every path
    return salted_lookup(flat, owner, ["node"], F.col("leaf")).withColumn("owns", F.col("leaf") == F.col("_owner")).drop("_owner").select("leaf", "position", "node", "owns")


def matching(df: DataFrame, wanted: dict[str, str], defaults: dict[str, bool]) -> DataFrame:
    """Rows that have the wanted values ('all' passes everything) and whose flags hold, null flags by default."""
    for column, value in wanted.items():
        if value != "all":
            df = df.where(F.col(column) == value)
    for column, value in defaults.items():
        df = df.where(F.coalesce(F.col(column), F.lit(value)))
    return df


def rubric_share(points: Column, verdicts: Column) -> Column:
    """Points of met criteria over the sum of positive points, both by position; an error if there are more of one."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    met = add(F.zip_with(points, verdicts, lambda p, v: F.when(v, p).otherwise(0.0)))
    share = F.try_divide(met, add(F.transform(points, lambda p: F.greatest(p, F.lit(0.0)))))
    return F.when(F.size(points) == F.size(verdicts), share).otherwise(F.raise_error(F.lit("points and verdicts differ in number")).cast("double"))
