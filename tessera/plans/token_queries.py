"""Queries over flags, length filters, aligned arrays, shuffles and first-document schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import objectives as O
from tessera.functions import text as T
from tessera.operators import chat as C
from tessera.operators import ordering as R
from tessera.operators import rows as X
from tessera.plans import derived as D
from tessera.plans.registry import query, table
from tessera.plans.rollout_queries import rounded
from tessera.plans.stream_queries import run_stream
from tessera.sources import readers
from tessera.sources.scratch import scratch
from tessera.sources.table_log import TableLog
from tessera.streaming import assembler, runs


@query("WITH f AS (SELECT conv_id, bool_or(turn = 1 AND conv_id % 3 = 0) AS flagged FROM conversations GROUP BY conv_id) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, CASE WHEN flagged AND turn = 1 THEN conv_id % 2 = 0 ELSE role = 'assistant' END AS trainable FROM conversations JOIN f USING (conv_id)")
def resolve_trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = (F.col("turn") == 1) & (F.col("conv_id") % 3 == 0)
    m = F.struct("turn", "role", F.when(flag & (F.col("conv_id") % 2 == 0), True).alias("trainable"), F.when(flag & (F.col("conv_id") % 2 == 1), 0).alias("weight"))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    return chats.select("conv_id", F.posexplode(C.resolve_trainable(F.col("m"))).alias("place", "trainable"))


@query("WITH c AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n, lead(len(string_split(text, ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM conversations) SELECT conv_id, turn, n AS chosen, m AS rejected FROM c WHERE n BETWEEN 2 AND 40 AND m BETWEEN 2 AND 40")
def preference_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("text", " ")).cast("long")
    pairs = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("chosen"), F.lead(n).over(W.partitionBy("conv_id").orderBy("turn")).alias("rejected"))
    return pairs.where("chosen between 2 and 40 and rejected between 2 and 40")


@query("SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE len(string_split(text, ' ')) <= 200")
def token_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n")).where("n <= 200")


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND coalesce(l.quality = 1, true)")
def attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language and difficulty ('all' passes everything); documents without a label count as good."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id", "left")
    return X.matching(rows, {"lang": "en", "doc_id": "all"}, {"good": True}).select("doc_id", "lang")


@query("SELECT event_id FROM events WHERE event_id % 4 = 0")
def tool_alignment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    reply = F.when(k == 0, '{"tool_alignment": {"eligible": true}}').when(k == 1, '{"tool_alignment": {"eligible": "true"}}').when(k == 2, '{"tool_alignment": {"eligible": 1}}').otherwise("{}")
    v = F.try_variant_get(F.parse_json(reply), "$.tool_alignment.eligible", "variant")
    return table(spark, sf_dir, "events").where((F.schema_of_variant(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean")).select("event_id")


@query("SELECT conv_id, turn, n FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM conversations) WHERE n <= 600")
def drop_over_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(by).alias("n")).where("n <= 600")


@query("WITH r AS (SELECT l_orderkey, l_quantity, l_discount, l_returnflag FROM lineitem) SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) + 0.0 AS score, count(*) AS n FROM r GROUP BY l_orderkey")
def gold_pred_align_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rubric points and verdicts zipped by position: points of met criteria over all points."""
    both = F.array_sort(F.collect_list(F.struct(*[c for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], F.col("l_quantity").alias("points"), (F.col("l_returnflag") == "R").alias("met"))))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(both.alias("b"))
    points, verdicts = F.transform("b", lambda x: x["points"]), F.transform("b", lambda x: x["met"])
    return rounded(g.select("l_orderkey", X.rubric_share(points, verdicts).alias("score"), F.size("b").cast("long").alias("n")))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(concat('5:', o_custkey, ':', o_orderkey)), o_orderkey) - 1 AS place, o_orderpriority AS label FROM orders")
def aligned_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of each customer in one random order."""
    item = F.struct(R.hash_key(5, "o_custkey", "o_orderkey").alias("h"), "o_orderkey", "o_orderpriority")
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("r"))
    keys, labels = F.transform("r", lambda x: x["o_orderkey"]), F.transform("r", lambda x: x["o_orderpriority"])
    flat = lists.select("o_custkey", F.posexplode(F.arrays_zip(keys.alias("k"), labels.alias("l"))).alias("place", "z"))
    return flat.select("o_custkey", F.col("z.k").alias("o_orderkey"), "place", F.col("z.l").alias("label"))


@query("SELECT event_id, [event_id, -event_id, event_id + 1, -event_id - 1] AS datums, [0.5, 0.25, 0.0]::DOUBLE[] AS padded, [0.5]::DOUBLE[] AS trimmed, 2 AS trained FROM events")
def interleave_pad_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, lp = F.col("event_id"), F.array(F.lit(0.5), F.lit(0.25))
    return table(spark, sf_dir, "events").select("event_id", A.interleave(F.array(k, k + 1), F.array(-k, -k - 1)).alias("datums"), A.pad_or_trim(lp, 3).alias("padded"), A.pad_or_trim(lp, 1).alias("trimmed"), A.count_trainable(F.array(F.lit(0), F.lit(1), F.lit(1))).alias("trained"))


@query("SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN [0.0, 0.0, -1.5, -2.5] ELSE [0.0, -0.5, -1.5, -2.5] END)::DOUBLE[] AS logprobs FROM events")
def logprob_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    echoed = F.array(F.lit(None).cast("double"), F.lit(-0.5), F.lit(-1.5), F.lit(-2.5))
    own = F.array(F.lit(-1.5), F.lit(-2.5))
    return table(spark, sf_dir, "events").select("event_id", X.align_logprobs(F.when(F.col("event_id") % 2 == 0, own).otherwise(echoed), F.lit(4), F.lit(2)).alias("logprobs"))


@query("SELECT event_id, [1, 2, event_id] AS tokens, [0.0, 0.0, -0.5]::DOUBLE[] AS logprobs, [0, 0, 1] AS mask, value AS reward FROM events")
def rl_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.rl_record(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.array("event_id"), F.array(F.lit(-0.5)), F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", "r.*")


@query("SELECT event_id, 3 + event_id % 4 AS start, 2 AS length FROM events")
def final_answer_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the answer's tokens stand last among the completion's; tokens are characters here."""
    answer = F.array(F.lit(7), F.lit(8))
    tokens = F.concat(answer, F.array(F.lit(1)), F.array_repeat(F.lit(0), (F.col("event_id") % 4).cast("int")), answer, F.array(F.lit(9)))
    return table(spark, sf_dir, "events").select("event_id", A.last_subsequence(tokens, answer).cast("long").alias("start"), F.size(answer).alias("length"))


@query("SELECT event_id, event_id % 3 = 0 AS matched, CASE WHEN event_id % 2 = 0 THEN round(exp(value / 100), 6) + 0.0 END AS perplexity FROM events")
def perplexity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("event_id") % 3 == 0, "  It is YES. ").otherwise("no")
    nll = F.when(F.col("event_id") % 2 == 0, F.col("value") / 100)
    return rounded(table(spark, sf_dir, "events").select("event_id", F.contains(F.lower(F.trim(reply)), F.lower(F.lit("Yes"))).alias("matched"), F.exp(nll).alias("perplexity")))


@query("SELECT 'a' AS field, 'BIGINT' AS kind UNION ALL SELECT 'b', 'STRING' UNION ALL SELECT 'c', 'ARRAY<BOOLEAN>'")
def schema_infer_first_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.to_json(F.struct(F.lit(1).alias("a"), F.lit("x").alias("b"), F.array(F.lit(True)).alias("c")))
    docs = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") == F.lit(0), first).otherwise(first).alias("doc"))
    return readers.first_schema(docs, "item_id", "doc")


@query("SELECT event_id, lower(trim(event_type)) AS plain FROM events")
def string_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.lower(F.trim(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))).alias("plain"))


@query("SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN concat('A: ', text, '</s>') ELSE concat('[', role, '] ', text) END, chr(10) ORDER BY turn) AS rendered, sum(CASE WHEN role = 'assistant' THEN length(text) + 4 ELSE 0 END)::BIGINT AS trained FROM conversations GROUP BY conv_id")
def chat_render_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat format given as data: text before and after each role's content, and how much of it is trained."""
    formats = {"assistant": ("A: ", "</s>", True), "user": ("[user] ", "", False), "system": ("[system] ", "", False)}
    chats = C.to_chats(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    parts = C.formatted(F.col("messages"), formats)
    trained = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.when(p["trained"], F.length(p["content"])).otherwise(0))
    return chats.select("conv_id", F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["content"])), "\n").alias("rendered"), trained.alias("trained"))


IGPO_SQL = f"""WITH t AS ({D.TOKENS_SQL}), u AS (SELECT *, max(mask) OVER (PARTITION BY sample) AS live, adv * (pos + 1) / 10 AS a FROM t),
x AS (SELECT mask, pi - ref AS gap, (greatest(-exp(pi - old) * a, -greatest(0.8, least(1.2, exp(pi - old))) * a) * exp(old - inf) + 0.001 * (pi - ref)) * mask AS loss FROM u WHERE live > 0)
SELECT round(sum(loss), 4) + 0.0 AS loss, round(sum(gap * mask) / sum(mask), 4) + 0.0 AS mean_kl, sum(mask)::BIGINT AS active_tokens, count(*) AS total_tokens, round(sum(mask) / count(*), 4) + 0.0 AS mask_ratio FROM x"""


@query(IGPO_SQL)
def igpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.tokens(spark, sf_dir).withColumn("adv", F.col("adv") * (F.col("pos") + 1) / 10)
    return rounded(O.turn_policy_loss(t), 4)


@query("SELECT grp, count(*) % 4 AS waiting FROM (SELECT user_id AS grp FROM events) GROUP BY grp")
def stream_state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an assembler's stopped stream still holds: runs and drops of each open group."""
    progress = scratch(spark, "progress")
    closed = runs.drained(assembler.assemble_groups(run_stream(spark, sf_dir), expected=4), scratch(spark, "groups"), progress)
    state = runs.snapshot(spark, progress)
    count = lambda f: F.coalesce(F.get_json_object("value", f"$.groupState.{f}"), F.get_json_object("value", f"$.{f}")).cast("long")
    held = state.select(F.regexp_extract("key", r"(-?[0-9]+)", 1).cast("long").alias("grp"), (count("n") + count("dropped")).alias("waiting"))
    seen = closed.select("grp").distinct().select("grp", F.lit(0).cast("long").alias("waiting"))  # closed groups without a rest hold no state
    return held.unionByName(seen).groupBy("grp").agg(F.max("waiting").alias("waiting"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def warehouse_sql_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of a table with a log: files without a balance below zero stay as they are."""
    customers = TableLog(spark, scratch(spark, "customers"))
    customers.create(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_acctbal"], cluster_by=["c_acctbal"])
    customers.update({"c_acctbal": (None, 0)}, {"c_mktsegment": F.lit("low")}, where=F.col("c_acctbal") < 0)
    return customers.read().select("c_custkey", "c_mktsegment")


@query("SELECT 'old' AS version, count(*) AS n, round(sum(c_acctbal), 2) + 0.0 AS balance FROM customer UNION ALL SELECT 'new', count(*), round(sum(CASE WHEN c_custkey BETWEEN 100 AND 200 THEN 0 ELSE c_acctbal END), 2) + 0.0 FROM customer WHERE c_nationkey <> 3 OR c_custkey > 50")
def warehouse_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after an update and a deletion, and as it was before."""
    customers = TableLog(spark, scratch(spark, "versions"))
    customers.create(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_custkey"], cluster_by=["c_custkey"])
    customers.update({"c_custkey": (100, 200)}, {"c_acctbal": F.lit(0.0)})
    customers.delete({"c_custkey": (None, 50)}, where=F.col("c_nationkey") == 3)
    told = lambda name, version: customers.read(version).agg(F.lit(name).alias("version"), F.count(F.lit(1)).alias("n"), (F.round(F.sum("c_acctbal"), 2) + 0.0).alias("balance"))
    return told("old", 0).unionByName(told("new", None))


@query("SELECT 'good' AS name, 5::BIGINT AS n_rows, NULL AS error UNION ALL SELECT 'broken', 0, 'error'")
def sqlite_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as a tool runs them: at most 200 rows, and errors as results."""
    views = {"regions_now": table(spark, sf_dir, "region")}
    found = {n: readers.sql_or_error(spark, q, views, 200) for n, q in {"good": "SELECT * FROM regions_now", "broken": "SELECT nothing FROM nowhere"}.items()}
    one = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows", F.lit(None if e is None else "error").cast("string").alias("error")) for n, (df, e) in found.items()]
    return one[0].unionByName(one[1])
