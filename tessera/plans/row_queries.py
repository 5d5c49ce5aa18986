"""Queries over scans, sinks, row builders, filters, joins and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import objectives as O
from tessera.functions import text as T
from tessera.operators import ordering as R
from tessera.operators import retrieval as V
from tessera.operators import rows as X
from tessera.plans import derived as D
from tessera.plans.registry import query, table
from tessera.plans.rollout_queries import rounded
from tessera.sources import lines, readers, sinks
from tessera.sources.scratch import scratch


def written(spark: SparkSession, df: DataFrame, name: str, write) -> str:
    path = scratch(spark, name)
    write(df, path)
    return path


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return readers.jsonl(spark, written(spark, docs, "jsonl", sinks.write_jsonl), "doc_id long, text string, lang string")


@query("SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS row_index, strlen(concat('{\"item_id\":', item_id, '}')) + 1 AS n_bytes, true AS adds_up FROM benchmark")
def jsonl_offset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written in order, indexed by byte ranges of 512 bytes, and read again by offset; offsets are sums of the sizes before."""
    path = written(spark, table(spark, sf_dir, "benchmark").select("item_id").orderBy("item_id"), "index", sinks.write_jsonl)
    lines.write_offsets(spark, path, f"{path}-offsets", range_bytes=512)
    index = lines.offsets(spark, f"{path}-offsets")
    first = index.groupBy("file").agg(F.min("row_index").alias("first"), F.min("offset").alias("zero"), F.max(F.col("offset") + F.col("n_bytes")).alias("end"), F.sum("n_bytes").alias("bytes"))
    rows = lines.read_at(index, path).join(first, "file")
    return rows.select(F.get_json_object("line", "$.item_id").cast("long").alias("item_id"), "row_index", "n_bytes", ((F.col("zero") == 0) & (F.col("end") == F.col("bytes"))).alias("adds_up"))


@query("WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents) SELECT row_index, doc_id, strlen(text) AS n_chars FROM r WHERE row_index % 100 = 0")
def jsonl_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth line is looked up in the index and read where it lies."""
    path = written(spark, table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id"), "access", sinks.write_jsonl)
    lines.write_offsets(spark, path, f"{path}-offsets")
    found = lines.read_at(lines.offsets(spark, f"{path}-offsets").where("row_index % 100 = 0"), path)
    row = F.from_json("line", "doc_id long, text string")
    return found.select("row_index", row.alias("r")).select("row_index", "r.doc_id", F.octet_length("r.text").cast("long").alias("n_chars"))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return readers.csv(spark, written(spark, orders, "csv", sinks.write_csv), "o_orderkey long, o_custkey long, o_orderpriority string")


@query("SELECT doc_id, quality, toxic FROM labels")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")


@query("SELECT item_id::VARCHAR AS item_id, to_json(string_split(text, ' ')) AS words FROM benchmark")
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("words"))
    path = written(spark, rows, "array", sinks.write_json_array)
    return readers.all_strings(readers.json_array(spark, path, "item_id long, words array<string>").drop("share"))


@query("SELECT lang, count(*) AS n FROM documents WHERE n_chars > 1000 GROUP BY lang")
def warehouse_sql_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.sql(spark, "SELECT lang, count(*) AS n FROM docs_view WHERE n_chars > :least GROUP BY lang", {"docs_view": table(spark, sf_dir, "documents")}, least=1000)


@query("SELECT 'labels' AS \"table\", 'doc_id bigint, quality int, toxic int' AS columns UNION ALL SELECT 'region', 'r_regionkey int, r_name string'")
def schema_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.describe({n: table(spark, sf_dir, n) for n in ("region", "labels")}, spark)


@query("SELECT event_id, ts FROM events WHERE value IS NOT NULL AND ts > TIMESTAMP '2024-01-05' ORDER BY event_id LIMIT 20")
def doc_store_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value is not null and ts > timestamp_ntz '2024-01-05'").orderBy("event_id").limit(20).select("event_id", "ts")


@query("SELECT DISTINCT ON (o_custkey, o_orderpriority) o_custkey::VARCHAR AS qid, o_orderpriority AS doc_id, (o_orderkey % 4)::INT AS rel FROM orders WHERE o_orderpriority NOT LIKE '% %' ORDER BY o_custkey, o_orderpriority, o_orderkey")
def qrels_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    one = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(first)).where("n = 1")
    rel = one.select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("doc_id"), (F.col("o_orderkey") % 4).cast("int").alias("rel"))
    return readers.qrels(spark, written(spark, rel, "qrels", sinks.write_qrels))


@query("SELECT count(*) AS n_files, min(strlen(text))::BIGINT AS least FROM benchmark")
def binary_files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    path = written(spark, rows, "files", lambda df, p: df.repartition(4).write.partitionBy("item_id").text(p))
    return readers.binary_files(spark, path, "*.txt").agg(F.count(F.lit(1)).alias("n_files"), (F.min("length") - 1).alias("least"))


@query("SELECT user_id::VARCHAR AS id, ts::DATE AS day, round(sum(event_id % 7), 6) + 0.0::DOUBLE AS used FROM events GROUP BY ALL")
def usage_series_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), (F.col("event_id") % 7).cast("string").alias("value"))
    events = table(spark, sf_dir, "events")
    pages = max(4, events.count() // 10_000)  # of some ten thousand points each
    nested = events.groupBy("user_id", (F.col("event_id") % pages).alias("page")).agg(F.collect_list(point).alias("values"))
    series = nested.groupBy("page").agg(F.collect_list(F.struct(F.create_map(F.lit("id"), F.col("user_id").cast("string")).alias("labels"), "values")).alias("series"))
    return rounded(readers.usage_series(series))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'done' ELSE o_orderstatus END AS status FROM orders")
def batch_status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return sinks.update_status(old, old.where("o_orderkey % 5 = 0").withColumn("status", F.lit("done")), "o_orderkey", "status")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'new'")
def doc_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = old.where("c_custkey % 3 = 0").select("c_custkey").unionAll(spark.range(1).select(F.lit(-1).cast("long"))).withColumn("c_name", F.lit("new"))
    return sinks.upsert(old, new, "c_custkey")


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events")
def metrics_sink_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 20 == 0, float("nan")).when(F.col("event_id") % 10 == 0, float("inf")).otherwise(F.col("value"))
    return sinks.finite(table(spark, sf_dir, "events").select("event_id", v.alias("value")))


@query("SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) ORDER BY n, lang LIMIT 10")
def render_samples_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.preview(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 10).select("doc_id")


@query("SELECT item_id, 2 AS n_messages, text AS question, concat('#', item_id) AS ground_truth, concat('The answer is #', item_id) AS hint FROM benchmark")
def to_chat_and_privileged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.concat(F.lit("#"), F.col("item_id").cast("string"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", X.question_row(F.col("text"), truth, "Think.").alias("r"))
    both = rows.select("item_id", "r", X.privileged_row(F.col("r.messages"), F.col("r.ground_truth")).alias("p"))
    return both.select("item_id", F.size("r.messages").alias("n_messages"), F.element_at("p.messages", 1)["content"].alias("question"), F.col("r.ground_truth").alias("ground_truth"), F.element_at("p.teacher_messages", 1)["content"].alias("hint"))


@query("SELECT conv_id, turn, trim(text) AS chosen, 'no' AS rejected FROM conversations WHERE trim(text) NOT IN ('', 'no')")
def ultrafeedback_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.trimmed_preference(F.lit(" ask "), F.concat(F.lit(" "), "text"), F.lit("no "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", p.alias("p")).where("p is not null").select("conv_id", "turn", "p.chosen", "p.rejected")


@query("WITH r AS (SELECT o_custkey, o_orderkey AS document, CASE WHEN o_orderstatus = 'F' THEN 9 ELSE 1 END AS score, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS pos FROM orders) SELECT o_custkey, document, score FROM r WHERE (score = 9 AND n <= 4) OR (score = 1 AND n <= 4 - least(pos, 4))")
def msmarco_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("o_orderkey"))))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(side(F.col("o_orderstatus") == "F").alias("pos"), side(F.col("o_orderstatus") != "F").alias("neg"))
    return g.select("o_custkey", F.inline(X.ranked_expand(F.col("pos"), F.col("neg"), 4)))


@query("SELECT o_custkey, unnest(list(o_orderkey ORDER BY o_orderkey)) AS k, unnest(list(o_orderpriority ORDER BY o_orderkey)) AS p FROM orders GROUP BY o_custkey")
def flatten_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(rows.alias("r")).select("o_custkey", F.col("r.o_orderkey").alias("k"), F.col("r.o_orderpriority").alias("p"))
    return g.select("o_custkey", F.inline(F.arrays_zip("k", "p")))


@query("SELECT doc_id, trim(x) AS item FROM (SELECT doc_id, unnest(string_split(text, ',')) AS x FROM documents) WHERE trim(x) <> ''")
def evidence_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", ","), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(parts).alias("item"))


@query("SELECT text, max(doc_id) AS doc_id FROM (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, text FROM documents) GROUP BY text")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.where("doc_id % 2 = 0").unionByName(docs)
    return both.groupBy(F.sha2("text", 256).alias("h")).agg(F.max(F.struct("doc_id", "text")).alias("r")).select("r.text", "r.doc_id")


@query("SELECT doc_id, list_filter([CASE WHEN n_chars < 400 THEN 'short' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang' END], lambda x: x IS NOT NULL) AS errors, n_chars >= 400 AND lang IN ('en', 'de', 'fr') AS valid FROM documents")
def transform_validate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [lambda d: d.withColumn("n", F.col("n_chars")), lambda d: d.withColumn("lang", F.lower("lang"))]
    rules = {"short": F.col("n") < 400, "lang": ~F.col("lang").isin("en", "de", "fr")}
    return X.validate(table(spark, sf_dir, "documents"), steps, rules).select("doc_id", "errors", "valid")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 4 = 1 THEN 'empty' END AS problem FROM documents")
def field_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "  ").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("field")).select("doc_id", X.field_errors("field").alias("problem"))


@query("WITH t AS (SELECT l_orderkey, count(*) AS n, max((l_returnflag <> 'N')::INT) AS w FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, n FROM t WHERE n BETWEEN 2 AND 6 AND w > 0")
def trainable_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("l_returnflag") != "N").cast("int")).alias("w"))
    return t.where("n between 2 and 6 and w > 0").select("l_orderkey", "n")


@query("SELECT doc_id FROM documents WHERE n_chars > 2000 ORDER BY md5(concat('1:', doc_id)), doc_id LIMIT 25")
def min_length_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("n_chars > 2000").orderBy(R.hash_key(1, "doc_id"), "doc_id").limit(25).select("doc_id")


@query("WITH b AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents) SELECT batch, count(*) AS n FROM b WHERE n_chars >= 900 GROUP BY batch")
def drop_none_after_batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = R.batch_slices(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 16)
    return b.where("n_chars >= 900").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("WITH u AS (SELECT user_id, max(value) AS m, avg(value) AS a, bool_and(value < 500) AS w FROM events GROUP BY user_id) SELECT user_id, m < 200 AS low_max, a < 50 AS low_avg, w AS low_all FROM u")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.max("value") < 200).alias("low_max"), (F.avg("value") < 50).alias("low_avg"), F.bool_and(F.col("value") < 500).alias("low_all"))


POOL_SQL = """WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents), t AS (SELECT count(*) AS total, count(*) * 618 // 1000 AS low FROM documents), u AS (SELECT min(x) AS stride FROM (SELECT unnest(range(greatest(low, 1), total + 2)) AS x, total FROM t) WHERE gcd(x, total) = 1),
q AS (SELECT item_id, unnest(range(8)) AS slot FROM benchmark), d AS (SELECT item_id, slot, ('0x' || substr(md5(concat('3:', item_id, ':', slot)), 1, 12))::BIGINT % (SELECT count(*) FROM documents) AS place FROM q),
w AS (SELECT item_id, place AS start, unnest(range(total)) AS step FROM d, t WHERE slot = 0), a AS (SELECT item_id, slot, place FROM d UNION ALL SELECT item_id, 8 + step, (start + step * stride) % total FROM w, u, t),
f AS (SELECT item_id, doc_id, min(slot) AS slot FROM a JOIN c USING (place) WHERE doc_id % 10 <> item_id % 10 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY slot) AS n FROM f) SELECT item_id, doc_id FROM r WHERE n <= 5"""


@query(POOL_SQL)
@query(POOL_SQL, name="distractor_anti_join")
def distractor_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents for each item that aren't its own, or all if there are fewer: drawn by place, then step by step."""
    return R.filled_pools(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", "doc_id % 10 <> item_id % 10", 5, 3)


@query("WITH p AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY event_type) SELECT event_type, round(n / 60.0, 6) + 0.0::DOUBLE AS per_second, round(CASE WHEN m > 0 THEN n / m END, 6) + 0.0 AS ratio FROM p")
def throughput_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return rounded(p.select("event_type", (F.col("n") / 60.0).alias("per_second"), F.when(F.col("m") > 0, F.try_divide("n", "m")).alias("ratio")))


@query("SELECT o_orderpriority, count(*) AS attempted, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS no_trajectory, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) + 0.0 AS mean_reward FROM orders GROUP BY o_orderpriority")
def evaluate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    out = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(s == "F").alias("completed"), F.count_if(s == "O").alias("failed"), F.count_if(s == "P").alias("no_trajectory"), F.avg(F.when(s == "F", F.col("o_totalprice"))).alias("mean_reward"))
    return rounded(out, 4)


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("WITH r AS (SELECT o_custkey AS q, o_totalprice AS s, o_orderkey AS o, o_orderkey % 3 AS l, row_number() OVER w AS r, count(*) OVER p AS n, max(o_orderkey % 3) OVER p AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey)) SELECT q, round(count(*) FILTER (l = top AND r <= 5) / least(count(*) FILTER (l = top), 5), 6) + 0.0 AS recall, round(5 / max(n), 6) + 0.0 AS random FROM r WHERE n >= 5 GROUP BY q")
def recall_at_k_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_totalprice").alias("s"), F.col("o_orderkey").alias("o"), (F.col("o_orderkey") % 3).alias("l"))
    return rounded(X.recall_by_query(rows, "q", "s", "o", "l", 5))


@query(f"WITH t AS ({D.TOKENS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY exp(pi) DESC, pos) AS rank FROM t) SELECT sample, pos, rank, round(exp(pi) / sum(exp(pi)) OVER (PARTITION BY sample), 6) + 0.0 AS p FROM r WHERE rank <= 3")
def rank_blend_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.tokens(spark, sf_dir).select("sample", "pos", F.exp("pi").alias("mass"))
    return rounded(X.blend_top_k(rows, "sample", "mass", "pos", 3).select("sample", "pos", "rank", "p"))


@query(f"WITH t AS ({D.TURNS_SQL}), s AS (SELECT rollout, turn, turn * 3 + 1 AS a, turn * 3 + 6 AS b, ig FROM t), n AS (SELECT rollout, max(turn) * 3 + 6 AS n FROM t GROUP BY rollout), p AS (SELECT rollout, unnest(range(0, n)) AS pos FROM n) SELECT p.rollout, p.pos, round(coalesce(arg_max(ig, turn), 0), 6) + 0.0 AS value FROM p LEFT JOIN s ON s.rollout = p.rollout AND p.pos >= greatest(a - 1, 0) AND p.pos < b - 1 GROUP BY ALL")
def expand_turn_to_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir)
    spans = t.select("rollout", "turn", (F.col("turn") * 3 + 1).alias("a"), (F.col("turn") * 3 + 6).alias("b"), "ig")
    lengths = t.groupBy("rollout").agg((F.max("turn") * 3 + 6).alias("n"))
    return rounded(X.turn_values(spans, "rollout", "a", "b", "turn", "ig", lengths, "n"))


@query("SELECT epoch, doc_id, row_number() OVER (ORDER BY epoch, doc_id) - 1 AS place FROM documents, (VALUES (0), (1)) AS e(epoch)")
def epoch_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    return R.with_row_number(rows, "epoch", "doc_id", name="place").select("epoch", "doc_id", "place")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5(concat('2:', conv_id, ':', turn)), turn) - 1 AS place FROM conversations")
def within_group_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("conv_id").orderBy(R.hash_key(2, "conv_id", "turn"), "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(by) - 1).alias("place"))


@query("WITH o AS (SELECT event_id, unnest(['right', 'w1', 'w2', 'w3']) AS opt FROM events), r AS (SELECT event_id, opt, row_number() OVER (PARTITION BY event_id ORDER BY md5(concat(event_id, ':', opt)), opt) AS n FROM o) SELECT event_id, chr((64 + n)::INT) AS letter FROM r WHERE opt = 'right'")
def option_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array(*[F.lit(o) for o in ("right", "w1", "w2", "w3")])
    keyed = F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":"), o)).alias("h"), o.alias("o"))))
    at = F.array_position(F.transform(keyed, lambda k: k["o"]), F.lit("right"))
    return table(spark, sf_dir, "events").select("event_id", F.char((64 + at).cast("long")).alias("letter"))


@query("SELECT event_id, coalesce(nullif(regexp_replace(regexp_replace(trim(event_type), '\\s+', ' ', 'g'), '\\.+$', ''), ''), NULL) AS expected FROM events")
def expected_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.expected_answer(F.lit(None).cast("string"), F.concat(F.lit(" "), "event_type", F.lit("."))).alias("expected"))


@query("SELECT event_id, concat('\\frac{', event_id, '}{2}=x') AS plain, event_id % 2 = 0 AS same FROM events")
def latex_and_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    shown = F.concat(F.lit("$\\dfrac{"), k, F.lit("}{2} = \\text{x}$"))
    left, right = F.concat(F.lit("<think>hm</think> A  "), (F.col("event_id") % 2).cast("string")), F.lit("a 0")
    return table(spark, sf_dir, "events").select("event_id", T.latex_normalize(shown).alias("plain"), T.exact_match(left, right).alias("same"))


@query("SELECT event_id, round(ln(1 - exp(-(value + 0.01))), 6) + 0.0 AS log1mexp, round(-ln(1 + exp(-(value - 50) / 10)), 6) + 0.0 AS log_sigmoid FROM events")
def log1mexp_logsigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return rounded(table(spark, sf_dir, "events").select("event_id", O.log1mexp(-(v + 0.01)).alias("log1mexp"), O.log_sigmoid((v - 50) / 10).alias("log_sigmoid")))


@query("SELECT event_id, CASE event_id % 9 WHEN 1 THEN 'A' WHEN 3 THEN 'B' ELSE 'tie' END AS verdict FROM events")
def pairwise_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda k: F.when(k == 0, "A").when(k == 1, "B").otherwise("tie")
    k = F.col("event_id") % 9
    return table(spark, sf_dir, "events").select("event_id", X.judge_pairs(pick(F.floor(k / 3)), pick(k % 3)).alias("verdict"))


@query("WITH c AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'NEW' WHEN turn % 3 = 2 THEN 'WIPE' ELSE NULL END AS k FROM conversations) SELECT conv_id, turn, CASE WHEN turn = first THEN 'NEW' WHEN turn % 3 = 2 THEN 'WIPE' ELSE 'APPEND' END AS kind FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM c)")
def turn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    base = F.floor((turn + 1) / 3)  # a new history begins at each turn that leaves 2 on division by 3
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.sequence(base * 3 - 1, turn), lambda i: F.sha2(F.concat(base.cast("string"), F.lit(":"), i.cast("string")), 256)).alias("f"))
    return X.classify_turns(rows, "conv_id", "turn", "f").select("conv_id", "turn", "kind")


@query("""WITH RECURSIVE n AS (SELECT event_id AS node, CASE WHEN event_id >= 3 THEN event_id // 3 END AS parent FROM events), leaf AS (SELECT node FROM n WHERE node NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL)),
p AS (SELECT l.node AS leaf, n.node, n.parent, 0 AS up FROM leaf l JOIN n ON n.node = l.node UNION ALL SELECT p.leaf, n.node, n.parent, p.up + 1 FROM p JOIN n ON n.node = p.parent)
SELECT leaf, (max(up) OVER (PARTITION BY leaf) - up)::INT AS position, node, leaf = min(leaf) OVER (PARTITION BY node) AS owns FROM p""")
def trajectory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "events").select(F.col("event_id").alias("node"), F.when(F.col("event_id") >= 3, F.floor(F.col("event_id") / 3)).alias("parent"))
    return X.tree_paths(nodes, "node", "parent")


@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM e q, e d WHERE q.vec_id % 100 = 0 AND d.label = 3), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) SELECT qid, doc_id, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= 4")
def filtered_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return rounded(V.cosine_top_k(e.where("id % 100 = 0").select("id", "vector"), e.where("label = 3").select("id", "vector"), 4))


@query("WITH g AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS used FROM lineitem GROUP BY ALL) SELECT *, least(greatest(sum(used) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING), 0), 100) AS cursor FROM g")
def raw_row_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("used"))
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(W.unboundedPreceding, 0)
    return g.withColumn("cursor", F.least(F.greatest(F.sum("used").over(by), F.lit(0.0)), F.lit(100.0)))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 2")
def sort_by_key_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(by)).where("n <= 2").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 30")
def ordered_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").orderBy("doc_id").limit(30).select("doc_id")


@query("SELECT concat('instruct: find', chr(10), 'query: ', text) AS prompted, item_id FROM benchmark")
def instruction_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("instruct: find\nquery: "), "text").alias("prompted"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS words FROM documents")
def distinct_sorted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("words"))
