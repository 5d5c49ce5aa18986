"""Queries over scans and sinks: rows are written, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chat as C
from tessera.operators.ordering import with_row_number
from tessera.plans.registry import query, table
from tessera.plans.row_queries import written
from tessera.sources import lines, readers, sinks
from tessera.sources.scratch import scratch


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents")
def row_index_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_number(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", name="row_index")


@query("SELECT o_orderkey, strlen(concat('{\"o_orderkey\":', o_orderkey, ',\"o_orderpriority\":\"', o_orderpriority, '\"}')) + 1 AS n_bytes FROM orders")
def row_size_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "sizes", sinks.write_jsonl)
    return lines.lines(spark, path).select(F.get_json_object("line", "$.o_orderkey").cast("long").alias("o_orderkey"), "n_bytes")


@query("SELECT 0::BIGINT AS n_missing, count(*) AS n_there FROM benchmark")
def jsonl_scan_missing_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, table(spark, sf_dir, "benchmark").select("item_id"), "there", sinks.write_jsonl)
    n = lambda p, name: readers.jsonl(spark, p, "item_id long", missing_ok=True).agg(F.count(F.lit(1)).alias(name))
    return n(scratch(spark, "absent"), "n_missing").join(F.broadcast(n(path, "n_there")))  # one row each


PREFERENCE = "id long, samples array<struct<text:string,score:double,evals_score:double>>"


def preference_file(spark: SparkSession, sf_dir: str) -> str:
    """A third of the rows has a chosen and a rejected sample, a third two chosen ones, a third none."""
    k = F.col("event_id")
    s = lambda text, score: F.struct(text.alias("text"), score.alias("score"), F.lit(None).cast("double").alias("evals_score"))
    label = lambda p: F.concat(F.lit(p), k.cast("string"))
    good, bad, more = s(label("g"), F.lit(1.0)), s(label("b"), F.lit(0.0)), s(label("m"), F.lit(1.0))
    samples = F.when(k % 3 == 0, F.array(good, bad)).when(k % 3 == 1, F.array(good, more, bad)).otherwise(F.array(good, s(label("x"), F.lit(0.5))))
    return written(spark, table(spark, sf_dir, "events").select(k.alias("id"), samples.alias("samples")), "preferences", sinks.write_jsonl)


@query("SELECT event_id AS id, concat(CASE WHEN event_id % 3 = 0 THEN 'g' ELSE 'm' END, event_id) AS chosen, concat('b', event_id) AS rejected FROM events WHERE event_id % 3 < 2")
def preference_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient: rows without both sides are skipped, of several chosen ones the last counts."""
    rows = readers.jsonl(spark, preference_file(spark, sf_dir), PREFERENCE, strict=False).select("id", C.preference_from_samples(F.col("samples")).alias("p"))
    return rows.where("p is not null").select("id", "p.chosen", "p.rejected")


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['several chosen'] ELSE ['no rejected', 'graded'] END AS errors FROM events")
def preference_load_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict: every row with what is wrong with it."""
    rows = readers.jsonl(spark, preference_file(spark, sf_dir), PREFERENCE)
    n = lambda score: F.size(F.filter("samples", lambda x: x["score"] == score))
    rules = {"no chosen": n(1.0) == 0, "several chosen": n(1.0) > 1, "no rejected": n(0.0) == 0, "graded": F.exists("samples", lambda x: F.coalesce(~x["score"].isin(0.0, 1.0), F.lit(True)))}
    return C.audit(rows, "id", rules)


@query("SELECT text AS query, item_id::VARCHAR AS positive FROM benchmark WHERE text <> '' AND item_id % 3 <> 0")
def pairs_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("item_id") % 3 != 0, F.col("item_id").cast("string")).when(F.col("item_id") % 2 == 0, F.lit(""))
    rows = table(spark, sf_dir, "benchmark").select("text", side.alias("positive"))
    path = written(spark, rows, "pairs", sinks.write_jsonl)
    return readers.pairs(readers.jsonl(spark, path, "text string, positive string"), "text", "positive")


@query("SELECT count(*) AS n_rows, sum(item_id)::BIGINT AS total FROM benchmark")
def pinned_artifact_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id")
    path = written(spark, rows, "pinned", lambda df, p: sinks.write_jsonl(df.coalesce(1), p))
    files = readers.binary_files(spark, path, "*.json")
    pinned = readers.pinned_jsonl(spark, files.first().path, "item_id long", files.first().sha256, rows.count())
    return pinned.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("item_id").alias("total"))


@query("SELECT item_id, concat('data:text/plain;base64,', to_base64(encode(text || chr(10)))) AS uri FROM benchmark")
def image_base64_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, table(spark, sf_dir, "benchmark").select("item_id", "text"), "images", lambda df, p: df.repartition(4, "item_id").write.partitionBy("item_id").text(p))
    uris = readers.data_uris(readers.binary_files(spark, path, "*.txt"), "text/plain")
    return uris.select(F.regexp_extract("path", r"item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.regexp_replace("uri", r"\s", "").alias("uri"))


@query("SELECT concat('run', item_id % 4) AS run, count(*) AS n FROM benchmark GROUP BY run")
def trajectory_file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files below any folder, with the folder's name; a path that is found twice is an error."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("run"), (F.col("item_id") % 4).cast("string")).alias("run"))
    path = written(spark, rows, "trajectories", lambda df, p: df.write.partitionBy("run").json(p))
    found = readers.discovered(spark, path, "*.json", "item_id long")
    return found.groupBy(F.regexp_extract("path", r"run=([^/]+)/", 1).alias("run")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def jsonl_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    path = scratch(spark, "twice")
    sinks.write_jsonl(rows.where("o_orderstatus = 'F'"), path)
    sinks.write_jsonl(rows.where("o_orderstatus <> 'F'"), path, mode="append")
    return readers.jsonl(spark, path, "o_orderkey long, o_orderpriority string")


@query("SELECT c_custkey, c_name, count(*) OVER () AS n_written FROM customer")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "export")
    n = sinks.write_counted(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path, sinks.write_csv)
    return readers.csv(spark, path, "c_custkey long, c_name string").withColumn("n_written", F.lit(n).cast("long"))


@query("SELECT r_regionkey, r_name FROM region")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, table(spark, sf_dir, "region"), "array", sinks.write_json_array)
    return readers.json_array(spark, path, "r_regionkey int, r_name string").select("r_regionkey", "r_name")


@query("SELECT concat(o_custkey, chr(9), '0', chr(9), o_orderkey, chr(9), 1) AS line FROM orders")
def qrels_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("rel"))
    return spark.read.text(written(spark, rows, "qrels", sinks.write_qrels)).select(F.col("value").alias("line"))


@query("SELECT segment, count(*) AS n FROM (SELECT event_id % 3 AS segment FROM events) GROUP BY segment")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are appended one after the other; the log can be read only when it is sealed."""
    log = sinks.AppendLog(scratch(spark, "log"))
    for k in range(3):
        log.append(table(spark, sf_dir, "events").select("event_id", F.lit(k).cast("long").alias("segment")).where(F.col("event_id") % 3 == k))
    log.seal()
    return log.read(spark).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
