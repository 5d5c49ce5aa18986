"""Queries over usage series, gauges, batches, splits and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import ordering as R
from tessera.operators import series as S
from tessera.plans import derived as D
from tessera.plans.registry import query, table
from tessera.plans.rollout_queries import rounded


@query("WITH e AS (SELECT event_type, value, epoch_us(lead(ts) OVER (PARTITION BY event_type ORDER BY ts, value)) - epoch_us(ts) AS dt FROM events) SELECT event_type, round(sum(value * dt) / nullif(sum(dt), 0), 6) + 0.0 AS mean, round(sum(dt) / 1e6, 3) + 0.0 AS seconds FROM e WHERE dt IS NOT NULL AND value IS NOT NULL GROUP BY event_type")
def time_weighted_gauge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.time_weighted_mean(table(spark, sf_dir, "events"), "event_type", "ts", "value")
    return rounded(out).withColumn("seconds", F.round("seconds", 3))


@query("SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) + 0.0 AS moving FROM events")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.moving_average(table(spark, sf_dir, "events"), "event_type", "event_id", "value").select("event_type", "event_id", "moving"))


@query("WITH r AS (SELECT DISTINCT user_id, event_id % 40 AS idx FROM events WHERE event_type <> 'error'), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1 AS n FROM r) SELECT user_id, count(*) FILTER (idx = n) AS cursor, count(*) AS resolved FROM n GROUP BY user_id")
def contiguous_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", (F.col("event_id") % 40).alias("idx"))
    return S.contiguous_cursor(rows, "user_id", "idx")


@query("""WITH e AS (SELECT event_id % 4 AS worker, event_id, (event_type IN ('error', 'click'))::INT AS f FROM events),
a AS (SELECT *, sum(1 - f) OVER (PARTITION BY worker ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ok FROM e),
b AS (SELECT *, sum(f) OVER (PARTITION BY worker, ok ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run, count(f) OVER w AS n, avg(f) OVER w AS share FROM a WINDOW w AS (PARTITION BY worker ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT worker, min(CASE WHEN f = 1 AND (run >= 5 OR (n >= 10 AND share >= 0.5)) THEN event_id END) AS tripped_at, sum(f)::BIGINT AS failures FROM b GROUP BY worker""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("worker"), "event_id", "event_type")
    return S.circuit_breaker(rows, "worker", "event_id", F.col("event_type").isin("error", "click"))


USED_SQL = "SELECT user_id, ts::DATE AS day, sum(value) AS used FROM events GROUP BY user_id, ts::DATE"


@query(f"WITH u AS ({USED_SQL}) SELECT user_id, day, round(used, 6) + 0.0 AS used FROM u")
def usage_daily_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.daily_usage(table(spark, sf_dir, "events"), "user_id", "ts", "value"))


@query("WITH a AS (SELECT user_id, ts::DATE AS day, sum(value) AS used FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT user_id, ts::DATE AS day, sum(value) AS used FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, round(coalesce(a.used, 0) + coalesce(b.used, 0), 6) + 0.0 AS used FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day")
def usage_full_outer_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sides = [S.daily_usage(e.where(F.col("event_type") == k), "user_id", "ts", "value") for k in ("click", "view")]
    return rounded(S.full_outer_sum(*sides, ["user_id", "day"], "used"))


@query(f"WITH u AS ({USED_SQL}), k AS (SELECT DISTINCT user_id FROM events), d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-14', INTERVAL 1 DAY))::DATE AS day), f AS (SELECT k.user_id, d.day, coalesce(u.used, 0) AS used FROM k CROSS JOIN d LEFT JOIN u ON u.user_id = k.user_id AND u.day = d.day) SELECT user_id, round(sum(used), 6) + 0.0 AS total, round(max(used), 6) + 0.0 AS largest, round(avg(used), 6) + 0.0 AS mean, count(*) AS days, max(used) < 60 AS low_max, avg(used) < 60 AS low_mean FROM f GROUP BY user_id")
def usage_calendar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = S.daily_usage(table(spark, sf_dir, "events"), "user_id", "ts", "value")
    keys = table(spark, sf_dir, "events").select("user_id").distinct()
    filled = S.calendar_fill(keys.join(used, "user_id", "left"), "user_id", "day", "used", "2024-01-01", "2024-01-14")
    return rounded(S.usage_summary(filled, "user_id", "used", 60))


@query("WITH y AS (SELECT o_orderpriority AS entity, year(o_orderdate)::INT AS year, sum(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT entity, year, round(100 * (v - lag(v) OVER w) / nullif(lag(v) OVER w, 0), 4) + 0.0 AS growth FROM y WINDOW w AS (PARTITION BY entity ORDER BY year)")
def yoy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("entity"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(S.year_growth(yearly, "entity", "year", "v").select("entity", "year", "growth"), 4)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def argmax_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_so_far(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def producer_telemetry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.change_points(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


SHUFFLED_SQL = "SELECT doc_id, row_number() OVER (ORDER BY md5(concat('{0}:', doc_id)), doc_id) - 1 AS row FROM documents"


@query(SHUFFLED_SQL.format(7))
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id")


@query(f"WITH s AS ({SHUFFLED_SQL.format(3)}) SELECT doc_id, CASE WHEN row < greatest(1, floor((SELECT count(*) FROM documents) * 0.1)) THEN 'eval' ELSE 'train' END AS split FROM s")
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.random_split(table(spark, sf_dir, "documents").select("doc_id"), 3, "doc_id", 0.1)


@query(f"WITH s AS ({SHUFFLED_SQL.format(4)}) SELECT doc_id, CASE WHEN row < least(floor((SELECT count(*) FROM documents) * 0.05), 16) THEN 'eval' ELSE 'train' END AS split FROM s")
def eval_carveout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.eval_carveout(table(spark, sf_dir, "documents").select("doc_id"), 4, "doc_id", 0.05, 16)


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 25) THEN 'eval' ELSE 'train' END AS split FROM documents")
def tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tail_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 25)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 32) AS batch FROM documents")
def batch_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_slices(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32)


EPOCHS_SQL = "WITH r AS (SELECT doc_id, e.epoch FROM documents, (VALUES (0), (1), (2)) AS e(epoch)), n AS (SELECT epoch, doc_id, row_number() OVER ({0} ORDER BY epoch, md5(concat('5:', epoch, ':', doc_id)), doc_id) - 1 AS row FROM r) SELECT epoch, doc_id, (row // 24) AS batch FROM n"


@query(EPOCHS_SQL.format(""))
def batch_across_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.epoch_batches(table(spark, sf_dir, "documents"), "doc_id", 3, 24, 5, carry=True)


@query(EPOCHS_SQL.format("PARTITION BY epoch") + " WHERE row < (SELECT count(*) FROM documents) // 24 * 24")
def batch_per_epoch_drop_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.epoch_batches(table(spark, sf_dir, "documents"), "doc_id", 3, 24, 5, carry=False)


@query("""WITH s AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5(concat('9:', doc_id)), doc_id) - 1 AS row FROM documents),
m AS (SELECT *, row // 80 AS mega FROM s), i AS (SELECT *, row_number() OVER (PARTITION BY mega ORDER BY n_chars DESC, row) - 1 AS k FROM m), b AS (SELECT doc_id, (mega * 80 + k) // 16 AS batch FROM i),
o AS (SELECT batch, row_number() OVER (ORDER BY CASE WHEN batch = (SELECT count(*) FROM documents) // 16 THEN '~' ELSE md5(concat('9:', batch)) END, batch) - 1 AS slot FROM (SELECT DISTINCT batch FROM b))
SELECT doc_id, batch, slot FROM b JOIN o USING (batch)""")
def length_grouped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.length_grouped_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 16, 5, 9)


@query("SELECT doc_id, ntile(7) OVER (PARTITION BY lang ORDER BY doc_id)::INT - 1 AS chunk FROM documents")
def balanced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.balanced_chunks(table(spark, sf_dir, "documents"), "lang", "doc_id", 7).select("doc_id", "chunk")


@query("""WITH RECURSIVE f AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE n_chars <= 8192),
p AS (SELECT source, k, doc_id, n_chars, 0 AS pack, n_chars AS used FROM f WHERE k = 1 UNION ALL
SELECT f.source, f.k, f.doc_id, f.n_chars, CASE WHEN p.used + f.n_chars > 8192 THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.used + f.n_chars > 8192 THEN f.n_chars ELSE p.used + f.n_chars END FROM p JOIN f ON f.source = p.source AND f.k = p.k + 1)
SELECT source, doc_id, n_chars, pack FROM p""")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.greedy_pack(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 8192)


@query("WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('8:', doc_id)), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, t.t * n + r AS row FROM s, (SELECT unnest(range(0, 4)) AS t) t WHERE t.t * n + r < 350")
def cycle_to_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cycle_to(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 350, 8)


@query("SELECT doc_id, 'en' AS origin FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('2:', doc_id)), doc_id) AS r FROM documents WHERE lang = 'en') WHERE r <= 40 UNION ALL SELECT doc_id, 'de' FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('2:', doc_id)), doc_id) AS r FROM documents WHERE lang = 'de') WHERE r <= 40")
def dataset_concat_max_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.capped_concat([(k, docs.where(F.col("lang") == k)) for k in ("en", "de")], "doc_id", 40, 2).select("doc_id", "origin")


@query("""WITH u AS (SELECT doc_id, n_chars::DOUBLE AS w, (('0x' || substr(md5(concat('6:', doc_id)), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0 AS u FROM documents)
SELECT doc_id FROM u ORDER BY -ln(u) / w, doc_id LIMIT 30""")
def weighted_sample_no_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return R.weighted_sample(docs, "doc_id", F.col("n_chars").cast("double"), 30, 6).select("doc_id")


@query("""WITH e AS (SELECT event_id, (value >= 50)::INT AS ok, row_number() OVER (ORDER BY event_id) - 1 AS row FROM events), h AS (SELECT *, sum(ok) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) - ok AS b FROM e)
SELECT (b // 8)::BIGINT AS "window", count(*) AS consumed, sum(ok)::BIGINT AS accepted, sum(ok) < 8 AS partial FROM h GROUP BY b // 8""")
def collect_until_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.collect_until(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", F.col("value") >= 50, 8)


TRIALS_SQL = "SELECT o_custkey AS task, o_orderpriority AS model, o_totalprice / 200000 AS score FROM orders"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("model"), (F.col("o_totalprice") / 200000).alias("score"))


@query(f"WITH t AS ({TRIALS_SQL}) SELECT task, model, round(greatest(0.0, least(1.0, avg(score))) + 1e-11, 9) + 0.0 AS score, count(*) AS n_samples FROM t GROUP BY task, model")
def mean_then_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.mean_then_clip(trials(spark, sf_dir), ["task", "model"], "score"), 9, 1e-11)


@query(f"WITH t AS ({TRIALS_SQL}) SELECT coalesce(model, '(all)') AS model, round(greatest(0.0, least(1.0, avg(score))), 9) + 0.0 AS score, count(*) AS n_samples FROM t GROUP BY GROUPING SETS ((), (model))")
def aggregate_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.by_model_and_overall(trials(spark, sf_dir), "model", "score"), 9)


@query(f"WITH t AS ({TRIALS_SQL}) SELECT task, count(*) AS attempts FROM t GROUP BY task HAVING count(*) <> 10")
def completeness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.completeness(trials(spark, sf_dir), "task", 10)


@query("SELECT event_type, round(avg(value), 6) + 0.0 AS raw_reward, round(avg(value) FILTER (value > 20), 6) + 0.0 AS filtered_reward, round(1 - count(*) FILTER (value > 20) / count(*), 6) + 0.0 AS filter_ratio FROM events GROUP BY event_type")
def rollout_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.rollout_quality(table(spark, sf_dir, "events"), "event_type", F.col("value"), F.col("value") > 20))


@query(f"WITH t AS ({TRIALS_SQL}) SELECT model, round(sum(score) / 400, 6) + 0.0 AS fixed_mean, round(avg(score), 6) + 0.0 AS returned_mean, count(score) AS returned FROM t GROUP BY model")
def fixed_denominator_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.fixed_denominator(trials(spark, sf_dir), "model", "score", 400))


RUBRIC_SQL = "SELECT l_orderkey AS item, l_quantity > 25 AS ok, l_discount * 10 AS weight, l_returnflag = 'R' AS critical, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity / 5 END AS points FROM lineitem"


def rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(-F.col("l_quantity") / 5)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_quantity") > 25).alias("ok"), (F.col("l_discount") * 10).alias("weight"), (F.col("l_returnflag") == "R").alias("critical"), points.alias("points"))


@query(f"WITH r AS ({RUBRIC_SQL}), s AS (SELECT item, CASE WHEN sum(greatest(weight, 0)) > 0 THEN sum(greatest(weight, 0) * ok::INT) / sum(greatest(weight, 0)) ELSE avg(ok::INT) END AS score, avg(ok::INT) FILTER (critical) AS cf, coalesce(bool_and(ok) FILTER (critical), true) AS passed FROM r GROUP BY item) SELECT item, round(score, 6) + 0.0 AS score, round(coalesce(cf, score), 6) + 0.0 AS critical_fraction, passed, round(greatest(0.0, least(1.0, 0.5 * score + 0.5 * coalesce(cf, score))), 6) + 0.0 AS reward FROM s")
def weighted_rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.weighted_rubric(rubric(spark, sf_dir), "item", "ok", "weight", "critical"))


@query(f"WITH r AS ({RUBRIC_SQL}) SELECT item, round(sum(CASE WHEN ok THEN points ELSE 0 END) / nullif(sum(CASE WHEN points > 0 THEN points ELSE 0 END), 0), 6) + 0.0 AS score FROM r GROUP BY item")
def signed_rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.signed_rubric(rubric(spark, sf_dir), "item", "points", "ok"))


@query("SELECT doc_id, round(0.5 - 0.0147 * ((n_chars - 2000) / 500.0), 6) + 0.0 AS adjusted FROM documents")
def length_adjusted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "documents").select("doc_id", E.length_adjusted(F.lit(0.5), F.col("n_chars")).alias("adjusted")))


@query("WITH s AS (SELECT 'o_orderpriority_' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') AS slice, o_totalprice FROM orders UNION ALL SELECT 'o_orderstatus_' || regexp_replace(lower(o_orderstatus), '[^a-z0-9]+', '_', 'g'), o_totalprice FROM orders) SELECT slice, round(avg(o_totalprice), 4) + 0.0 AS mean, count(*) AS n FROM s GROUP BY slice")
def slice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.slice_metrics(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice"), 4)


@query("SELECT l_returnflag, count(*) FILTER (l_discount > l_tax) AS a_wins, count(*) FILTER (l_tax > l_discount) AS b_wins, count(*) FILTER (l_tax = l_discount) AS ties, count(*) FILTER (l_tax IS NULL OR l_discount IS NULL) AS invalid, round(avg((l_discount > l_tax)::INT), 6) + 0.0 AS a_rate FROM lineitem GROUP BY l_returnflag")
def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.win_rate(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_discount", "l_tax"))


@query(f"WITH t AS ({TRIALS_SQL}) SELECT model, round(avg((score >= 1 - 1e-6)::INT), 6) + 0.0 AS solve_rate, count(*) AS n FROM t GROUP BY model")
def solve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.solve_rate(trials(spark, sf_dir), "model", "score"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM events GROUP BY event_type")
def value_counts_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.value_shares(table(spark, sf_dir, "events"), "event_type"))


@query("SELECT round(avg((l_returnflag = l_linestatus)::INT), 6) + 0.0 AS l_returnflag_accuracy, round(avg((l_tax = l_discount)::INT), 6) + 0.0 AS l_tax_accuracy, round(avg((l_returnflag = l_linestatus AND l_tax = l_discount)::INT), 6) + 0.0 AS exact, round((avg((l_returnflag = l_linestatus)::INT) + avg((l_tax = l_discount)::INT)) / 2, 6) + 0.0 AS grand_mean FROM lineitem")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.field_accuracy(table(spark, sf_dir, "lineitem"), [("l_returnflag", "l_linestatus"), ("l_tax", "l_discount")]))


@query("SELECT l_linestatus, round(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1), 6) + 0.0 AS nll, round(exp(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1)), 6) + 0.0 AS perplexity, sum(l_quantity) + 0.0 AS n_tokens FROM lineitem GROUP BY l_linestatus")
def token_weighted_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.token_weighted_nll(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_discount", "l_quantity"))


@query(f"WITH t AS ({D.TOKENS_SQL}), c AS (SELECT sample, pos + 1 AS n, exp(avg(-pi) OVER (PARTITION BY sample ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS p FROM t) SELECT n, round(avg(p), 6) + 0.0 AS perplexity, count(*) AS n_samples FROM c WHERE n % 2 = 0 AND n <= 8 GROUP BY n")
def perplexity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.perplexity_curve(D.tokens(spark, sf_dir), "sample", "pos", "pi", 2, 8))


@query("SELECT user_id, round(avg(value), 6) + 0.0 AS mean, round(coalesce(var_samp(value), 0), 6) + 0.0 AS variance, round(coalesce(var_samp(value), 0) / count(*), 6) + 0.0 AS variance_of_mean, round(sqrt(coalesce(var_samp(value), 0) / count(*)), 6) + 0.0 AS std_error FROM events GROUP BY user_id")
def pg_variance_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.coefficient_variance(table(spark, sf_dir, "events"), "user_id", "value"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("""WITH m AS (SELECT event_id // 50 AS step, CASE event_id % 4 WHEN 0 THEN 'tokens:sum' WHEN 1 THEN 'loss' WHEN 2 THEN 'grad:max' ELSE 'lr:last' END AS key, value FROM events)
SELECT step, 'tokens' AS metric, 'sum' AS reducer, round(sum(value), 6) + 0.0 AS value FROM m WHERE key = 'tokens:sum' GROUP BY step UNION ALL SELECT step, 'loss', 'mean', round(avg(value), 6) + 0.0 FROM m WHERE key = 'loss' GROUP BY step UNION ALL SELECT step, 'grad', 'max', round(max(value), 6) + 0.0 FROM m WHERE key = 'grad:max' GROUP BY step""")
def step_metrics_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.create_map(F.lit(0), F.lit("tokens:sum"), F.lit(1), F.lit("loss"), F.lit(2), F.lit("grad:max"), F.lit(3), F.lit("lr:last")), (F.col("event_id") % 4).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("step"), key.alias("key"), "value")
    return rounded(E.step_metrics(rows, "step", "key", "value"))


@query("SELECT event_id, CASE WHEN s IS NULL OR s IN (408, 429) OR s BETWEEN 500 AND 599 THEN 'recoverable' ELSE 'fatal' END AS error_class FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 400 + event_id % 130 END AS s FROM events)")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_id") % 9 == 0, None).otherwise(400 + F.col("event_id") % 130)
    return table(spark, sf_dir, "events").select("event_id", E.error_class(status).alias("error_class"))


@query("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS n, count(*) OVER (PARTITION BY c_custkey) AS k FROM customer JOIN orders ON c_custkey = o_custkey) WHERE n <= 3 AND k >= 3")
def top_docs_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best three by (score desc, index desc); queries with fewer are skipped."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    by = W.partitionBy("c_custkey")
    ranked = joined.withColumn("n", F.row_number().over(by.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")))).withColumn("k", F.count(F.lit(1)).over(by))
    return ranked.where("n <= 3 and k >= 3").select("c_custkey", "o_orderkey")


