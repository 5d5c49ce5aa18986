"""Queries that run a stream over written files until they are used up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.episodes import pack_groups
from tessera.operators.ordering import with_row_number
from tessera.plans.registry import query, table
from tessera.plans.rollout_queries import rounded
from tessera.sources.scratch import scratch
from tessera.streaming import assembler, runs, stateful

RUNS = "grp long, run long, reward double, version long"
RUNS_SQL = "SELECT user_id AS grp, event_id AS run, CASE WHEN event_id % 7 <> 0 THEN value END AS reward, event_id % 5 AS version FROM events"


#: Rows of a written file, at most on average.
FILE_ROWS = 1_000_000


def run_rows(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("run"), v.alias("reward"), (F.col("event_id") % 5).alias("version"), *more)


def write_parts(rows: DataFrame, order: str, parts: int, path: str) -> int:
    """Rows in order of their id in parts of increasing ids; how many files a part has. Their number alone grows with the rows."""
    last, n = rows.agg(F.coalesce(F.max(order), F.lit(0)), F.count(F.lit(1))).first()
    split = max(1, -(-n // (parts * FILE_ROWS)))
    part = F.least(F.floor(F.col(order) * parts / F.lit(last + 1)), F.lit(parts - 1))
    runs.write_in_order(rows.withColumn("part", part), "part", order, parts, path, split)
    return split


def run_stream(spark: SparkSession, sf_dir: str, parts: int = 4, at_once: int = 1) -> DataFrame:
    """Rollouts in order of their run id; a micro-batch takes ``at_once`` of the parts, whatever their size."""
    path = scratch(spark, "runs")
    return runs.source(spark, path, RUNS, files=at_once * write_parts(run_rows(spark, sf_dir), "run", parts, path))


def text_segments() -> Column:
    """A run's segments as JSON: the letters of an event's type, answered by its properties, and in each third run the other way round too."""
    codes = lambda text: F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    cut = F.when(F.col("event_id") % 10 == 0, "length").otherwise("stop").alias("finish_reason")

    def segment(prompt: str, answer: str) -> Column:
        tokens = F.concat(codes(prompt), codes(answer))
        mask = F.concat(F.transform(codes(prompt), lambda _: F.lit(0)), F.transform(codes(answer), lambda _: F.lit(1)))
        return F.struct(tokens.alias("tokens"), F.transform(tokens, lambda t: -t / 200.0).alias("logprobs"), mask.alias("loss_mask"), cut)

    asked, back = segment("event_type", "props"), segment("props", "event_type")
    return F.to_json(F.when(F.col("event_id") % 3 == 0, F.array(asked, back)).otherwise(F.array(asked)))


GROUPS_SQL = """WITH r AS (@@runs), n AS (SELECT r.*, event_type AS meta, length(props) + CASE WHEN run % 3 = 0 THEN length(event_type) ELSE 0 END AS trained, (row_number() OVER (PARTITION BY grp ORDER BY run) - 1) // 4 AS k FROM r JOIN events ON event_id = run),
g AS (SELECT grp, k, count(reward) AS n_runs, count(*) - count(reward) AS n_dropped, avg(reward) AS m, stddev_samp(reward) AS sd, min(CASE WHEN reward IS NOT NULL THEN version END) AS min_version, min(version) AS min_submit_version, count(*) < 4 AS drained, arg_min(meta, run) AS meta, list(trained ORDER BY run) FILTER (reward IS NOT NULL) AS trained,
 coalesce(list(run ORDER BY run) FILTER (reward IS NOT NULL), []) AS runs, coalesce(list(reward ORDER BY run) FILTER (reward IS NOT NULL), []) AS rewards FROM n GROUP BY grp, k HAVING count(*) = 4 OR count(reward) >= 3),
a AS (SELECT grp, k, run, round((reward - m) / (CASE WHEN sd < 1e-8 THEN 1.0 ELSE sd END + 1e-8), 6) + 0.0 AS advantage FROM n JOIN g USING (grp, k) WHERE reward IS NOT NULL AND n_runs >= 3),
s AS (SELECT event_id AS run, 1 AS part, event_type AS p, props AS c FROM events UNION ALL SELECT event_id, 2, props, event_type FROM events WHERE event_id % 3 = 0),
x AS (SELECT grp, k, list(advantage ORDER BY run) FILTER (part = 1) AS advantages, list(run ORDER BY run, part) AS segment_runs, list(advantage ORDER BY run, part) AS segment_advantages, list(length(p) ORDER BY run, part) AS prompt_lens, list(length(c) ORDER BY run, part) AS completion_lens,
 list(run % 10 = 0 ORDER BY run, part) AS truncated, list(array_to_string([ascii(t) for t in string_split(substr(p || c, 2), '')], ' ') ORDER BY run, part) AS targets, list(round(-list_sum([ascii(t) for t in string_split(c, '')]) / 200.0, 6) + 0.0 ORDER BY run, part) AS trained_logprobs FROM a JOIN s USING (run) GROUP BY grp, k)
SELECT grp, n_runs, n_dropped, round(m, 6) + 0.0 AS mean_reward, min_version, min_submit_version, n_runs >= 3 AS kept, drained, meta, runs, rewards, advantages, CASE WHEN n_runs >= 3 THEN trained END AS trainable_tokens, segment_runs, segment_advantages, prompt_lens, completion_lens, truncated, targets, trained_logprobs
FROM g LEFT JOIN x USING (grp, k)""".replace("@@runs", RUNS_SQL)


@query(GROUPS_SQL)
def group_assembler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs a group, three at least; groups that wait at the stream's end are drained; kept ones are packed for training."""
    path, kind = scratch(spark, "runs"), f"{RUNS}, payload string, meta string"
    split = write_parts(run_rows(spark, sf_dir, text_segments().alias("payload"), F.col("event_type").alias("meta")), "run", 4, path)
    runs.end(spark, path, kind)
    stream = assembler.assemble_groups(runs.source(spark, path, kind, split), expected=4, smallest=3, ends=True)
    groups = runs.drained(pack_groups(stream), scratch(spark, "groups"), scratch(spark, "progress"))
    each = lambda name, of: F.transform("data", of).alias(name)
    near = lambda x: F.round(x, 6) + 0.0
    trained = lambda d: F.aggregate(F.zip_with(d["weights"], d["inf_logprobs"], lambda w, x: w * x), F.lit(0.0), lambda a, x: a + x)
    return groups.select(
        "grp", "n_runs", "n_dropped", near(F.col("mean_reward")).alias("mean_reward"), "min_version", "min_submit_version", "kept", "drained", "meta", "runs", "rewards", F.transform("advantages", near).alias("advantages"), F.col("trainable_tokens").cast("array<long>").alias("trainable_tokens"),
        each("segment_runs", lambda d: d["run"]), each("segment_advantages", lambda d: near(d["advantage"])), each("prompt_lens", lambda d: d["prompt_len"].cast("long")), each("completion_lens", lambda d: d["completion_len"].cast("long")),
        each("truncated", lambda d: d["truncated"]), each("targets", lambda d: F.array_join(d["target_tokens"], " ")), each("trained_logprobs", lambda d: near(trained(d))),
    )


@query(f"WITH r AS ({RUNS_SQL}) SELECT grp, run FROM r WHERE reward IS NOT NULL AND version >= 2")
def rollout_producer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission by micro-batch; dropped and stale rollouts are rejected."""
    fresh = run_stream(spark, sf_dir, at_once=2).where("reward is not null and version >= 2").select("grp", "run")
    return runs.drained(fresh, scratch(spark, "accepted"), scratch(spark, "progress"))


@query(f"WITH r AS ({RUNS_SQL}) SELECT version, least(greatest((version + 2) * 8 - (grp % 40), 0), 6) AS capacity, count(*) AS n FROM r GROUP BY ALL")
def staleness_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("event_id") % 5).alias("version")
    rows = table(spark, sf_dir, "events").select(v, (F.col("user_id") % 40).alias("offset"), F.lit(0).alias("accepted"), F.lit(0).alias("reserved"))
    return assembler.admission(rows, batch=8, stale=1, most=6).groupBy("version", "capacity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH r AS ({RUNS_SQL}), a AS (SELECT run, row_number() OVER (ORDER BY run) - 1 AS n FROM r WHERE reward IS NOT NULL), b AS (SELECT n // 32 AS batch, (n % 32) // 8 AS chunk FROM a) SELECT batch, chunk, count(*) AS n, count(*) < 8 AS partial FROM b GROUP BY ALL")
def optimizer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_id % 7 <> 0").select(F.col("event_id").alias("run"))
    g = assembler.optimizer_batches(rows, "run", 32, 8).groupBy("batch", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("partial", F.col("n") < 8)


@query(f"WITH r AS ({RUNS_SQL}), m AS (SELECT max(run) + 1 AS m FROM r) SELECT least(run * 4 // m, 3)::INT AS batch, count(*) AS n, max(run) AS last FROM r, m GROUP BY ALL")
def publish_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = run_stream(spark, sf_dir)
    done = runs.publish(stream, scratch(spark, "published"), scratch(spark, "progress"))
    return done.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("last"))


@query("SELECT user_id, max(event_id) AS event_id, (max(event_id) % 11) * 2 AS derived FROM events GROUP BY user_id")
def embed_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = run_stream(spark, sf_dir).select(F.col("grp").alias("user_id"), F.col("run").alias("event_id"))
    derive = lambda df: df.withColumn("derived", F.col("event_id") % 11 * 2)
    return runs.upsert_on_change(changes, "user_id", "event_id", derive, scratch(spark, "table"), scratch(spark, "progress")).select("user_id", "event_id", "derived")


@query("WITH n AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS chunk FROM events) SELECT user_id, chunk, count(*) AS n, min(event_id) AS first FROM n GROUP BY ALL")
def audio_chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.chunks(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 16)


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_segment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query(f"WITH r AS ({RUNS_SQL}) SELECT count(*) AS n, count(DISTINCT run) AS runs, max(run) AS last FROM r")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream stops, more files arrive, and it goes on from its checkpoint: each row once."""
    half, out, progress = run_rows(spark, sf_dir), scratch(spark, "resumed"), scratch(spark, "progress")
    middle = half.agg(F.max("run")).first()[0] // 2
    first, second = scratch(spark, "in"), half.where(F.col("run") > middle)
    half.where(F.col("run") <= middle).write.parquet(first)
    runs.drained(runs.source(spark, first, RUNS), out, progress)
    second.write.mode("append").parquet(first)
    done = runs.drained(runs.source(spark, first, RUNS), out, progress)
    return done.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run").alias("runs"), F.max("run").alias("last"))


@query(f"WITH r AS ({RUNS_SQL}), a AS (SELECT run, reward, row_number() OVER (ORDER BY run) - 1 AS n FROM r WHERE reward IS NOT NULL) SELECT n // 50 AS step, count(*) AS trained, round(avg(reward), 4) + 0.0 AS mean_reward FROM a GROUP BY step HAVING count(*) = 50")
def pipeline_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50 accepted rollouts make a training step; the rest waits."""
    rows = table(spark, sf_dir, "events").where("event_id % 7 <> 0").select(F.col("event_id").alias("run"), F.col("value").alias("reward"))
    g = with_row_number(rows.where("reward is not null"), "run", name="n").groupBy(F.floor(F.col("n") / 50).alias("step")).agg(F.count(F.lit(1)).alias("trained"), F.avg("reward").alias("mean_reward"))
    return rounded(g.where("trained = 50"), 4)


@query("""WITH f AS (SELECT user_id AS session, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, count(*) OVER (PARTITION BY user_id) AS frames FROM events),
x AS (SELECT session, seq * 6 + j AS k, value + j / 2.0 AS v, frames * 6 AS n FROM f, (SELECT unnest(range(6)) AS j)),
m AS (SELECT session, unnest(range(max(n) * 2)) AS m, max(n) * 2 AS total FROM x GROUP BY session),
y AS (SELECT m.session, m.m, max(total) AS total, sum(v * CASE WHEN 2 * k = m.m THEN 1.0 ELSE sin(pi() * (k - m.m / 2.0)) / (pi() * (k - m.m / 2.0)) * power(cos(pi() * (k - m.m / 2.0) / 12), 2) END) AS y FROM m JOIN x ON x.session = m.session AND x.k BETWEEN m.m // 2 - 6 AND m.m // 2 + 7 AND abs(k - m.m / 2.0) < 6 GROUP BY ALL)
SELECT session, m // 25 AS chunk, count(*) AS n, round(sum(y), 4) + 0.0 AS loudness, max(m) + 1 = max(total) AS last FROM y GROUP BY session, m // 25""")
def audio_resampled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels mixed to one, 8 kHz made 16 kHz, in chunks of 25 samples that micro-batches don't cut."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.array(F.col("value") + j, F.col("value"))))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"), place.cast("long").alias("seq"), pairs.alias("samples"), F.lit(2).alias("channels"), F.lit(8000).alias("rate"), (F.lead("event_id").over(W.partitionBy("user_id").orderBy("event_id")).isNull()).alias("last"))
    path = scratch(spark, "frames")
    split = write_parts(rows, "event_id", 4, path)
    frames = "session long, seq long, samples array<double>, channels int, rate int, last boolean"
    with stateful.rocks(spark):
        chunks = runs.drained(stateful.audio_chunks(runs.source(spark, path, frames, split), size=25), scratch(spark, "chunks"), scratch(spark, "progress"))
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    return chunks.select("session", "chunk", F.size("samples").cast("long").alias("n"), (F.round(total, 4) + 0.0).alias("loudness"), "last")


@query(f"WITH r AS ({RUNS_SQL}), n AS (SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY run) - 1) // 5 AS k FROM r) SELECT grp, count(reward) AS n_runs, count(*) - count(reward) AS n_dropped, round(avg(reward), 6) + 0.0 AS mean_reward, min(CASE WHEN reward IS NOT NULL THEN run END) AS first_run FROM n GROUP BY grp, k HAVING count(*) = 5")
def stream_state_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream stops, its state is saved, and another stream begins with it: together what one stream gives."""
    rows, paths = run_rows(spark, sf_dir), [scratch(spark, f"half{k}") for k in (1, 2)]
    middle = rows.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0] // 2
    halves = [runs.source(spark, path, RUNS, write_parts(half, "run", 3, path)) for path, half in zip(paths, (rows.where(F.col("run") <= middle), rows.where(F.col("run") > middle)), strict=True)]
    progress, saved = scratch(spark, "progress"), scratch(spark, "saved")
    with stateful.rocks(spark):
        first = runs.drained(stateful.grouped_runs(halves[0], 5), scratch(spark, "first"), progress)
        stateful.save_state(stateful.open_state(spark, progress), saved, version=1)
        initial = stateful.loaded(spark, saved, "grp long, " + stateful.GROUP, 1)
        second = runs.drained(stateful.grouped_runs(halves[1], 5, initial), scratch(spark, "second"), scratch(spark, "progress"))
    return rounded(first.unionByName(second))
