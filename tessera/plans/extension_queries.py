"""Queries over templates, plugged-in functions, grids, an index and streams of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.templates import rendered
from tessera.operators import chat as C
from tessera.operators import extensions as X
from tessera.operators import grids, residual_index, vector_index
from tessera.plans import derived as D
from tessera.plans.registry import query, table
from tessera.plans.rollout_queries import rounded
from tessera.plans.episode_queries import vectors
from tessera.sources import sinks
from tessera.sources.scratch import scratch
from tessera.streaming import runs


@query("SELECT conv_id, concat('train', chr(10), string_agg(concat(CASE WHEN role = 'user' THEN 'U' ELSE upper(role) END, ': ', trim(text), chr(10)), '' ORDER BY turn), CASE WHEN count(*) > 4 THEN 'long' WHEN count(*) = 4 AND true THEN 'four' ELSE 'short' END) AS shown FROM conversations GROUP BY conv_id")
def template_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = C.to_chats(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    pattern = "{{ mode }}\n{% for m in messages %}{% if m.role == 'user' %}U{% else %}{{ m.role | upper }}{% endif %}: {{ m.content | trim }}\n{% endfor %}{# size #}{% if messages | length > 4 %}long{% elif messages | length == 4 and not none %}four{% else %}short{% endif %}"
    return chats.select("conv_id", rendered(chats, pattern, mode="train").alias("shown"))


@query("SELECT conv_id, concat(string_agg(concat(n, '. ', upper(role), CASE WHEN role = 'user' THEN '?' ELSE '' END), ', ' ORDER BY turn), ' (', count(*) FILTER (role = 'user'), ' of ', count(*), ', ', sum(length(text)), ' characters)') AS shown FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def template_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros, a namespace that a loop carries along, loop variables and an included template."""
    chats = C.to_chats(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    pattern = """{%- macro line(m, mark='') -%} {{ loop.index }}. {{ m.role | upper }}{{ mark }} {%- endmacro -%}
    {%- set ns = namespace(users=0, size=0) -%}
    {%- for m in messages -%}
        {%- set ns.size = ns.size + m.content | length -%}
        {%- if m.role == 'user' -%} {%- set ns.users = ns.users + 1 -%} {{ line(m, mark='?') }} {%- else -%} {{ line(m) }} {%- endif -%}
        {%- if not loop.last %}, {% endif -%}
    {%- endfor -%} {%- include 'tail' -%}"""
    return chats.select("conv_id", rendered(chats, pattern, {"tail": "{% set all = messages | length %} ({{ ns.users }} of {{ all }}, {{ ns.size }} characters)"}).alias("shown"))


@query("SELECT conv_id, turn, part, CASE part WHEN 0 THEN text ELSE concat('> ', text) END AS shown FROM conversations, (VALUES (0), (1)) v(part) WHERE role <> 'system' AND part <= (role = 'assistant')::INT")
def render_flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns give one row, assistant turns two, system turns none."""
    item = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("shown"))
    role, text = F.col("role"), F.col("text")
    items = F.when(role == "assistant", F.array(item(0, text), item(1, F.concat(F.lit("> "), text)))).when(role != "system", F.array(item(0, text)))
    return X.rendered_rows(table(spark, sf_dir, "conversations"), items, ["conv_id", "turn"])


def _doubled(row: dict) -> object:
    """A row, a list of rows or nothing, by the row."""
    if row["item_id"] % 3 == 0:
        return None
    made = {"item_id": row["item_id"], "n_chars": len(row["text"])}
    return made if row["item_id"] % 3 == 1 else [made, {**made, "n_chars": -made["n_chars"]}]


@query("WITH r AS (SELECT item_id, length(text) * s AS n_chars FROM benchmark, (VALUES (1), (-1)) v(s) WHERE item_id % 3 = 2 OR (item_id % 3 = 1 AND s = 1)), o AS (SELECT *, (row_number() OVER (ORDER BY item_id, n_chars) - 1) // 16 AS batch FROM r) SELECT batch, count(*) AS n, count(DISTINCT item_id) AS items FROM o GROUP BY batch")
def render_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.render_stream(table(spark, sf_dir, "benchmark"), _doubled, "item_id long, n_chars long", "item_id", 16)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items"))


@query("SELECT doc_id, n_chars * 2 AS v FROM documents WHERE n_chars > 400")
def registered_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("where", {"condition": "n_chars > 400"}), ("with", {"v": "n_chars * 2"}), ("keep", {"columns": ["doc_id", "v"]})]
    return X.transformed(table(spark, sf_dir, "documents"), steps)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 BETWEEN 1 AND 5 THEN (o_orderkey % 7)::DOUBLE END AS parsed, round(exp(o_totalprice / 100000 / nullif(o_orderkey % 4, 0)), 6) + 0.0 AS ppl FROM orders")
def registered_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("score: "), (k % 7).cast("string")).alias("reply"), (F.col("o_totalprice") / 100000).alias("nll"), (k % 4).alias("n"))
    both = X.scored(X.scored(rows, "number", "parsed", text="reply", low=1, high=5), "perplexity", "ppl", nll="nll", tokens="n")
    return rounded(both.select("o_orderkey", "parsed", "ppl"))


@query(f"""WITH t AS ({D.TOKENS_SQL}), g AS (SELECT sample, -avg((ref - pi) * 0.5) AS loss, count(*) AS active FROM t WHERE mask > 0 GROUP BY sample), s AS (SELECT *, (row_number() OVER (ORDER BY sample) - 1) // 64 AS step FROM g)
SELECT step, count(*) AS samples, sum(active)::BIGINT AS active, round(sum(loss * active) / sum(active), 6) + 0.0 AS loss FROM s GROUP BY step""")
def distillation_reverse_kl_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = D.tokens(spark, sf_dir).select("sample", F.col("pi").alias("student"), F.col("ref").alias("teacher"), "mask")
    return rounded(X.distillation_steps(tokens, X.OBJECTIVES["sampled_reverse_kl"](scale=0.5), 64))


@query(f"""WITH t AS ({D.TOKENS_SQL}), r AS (SELECT sample, pos // 3 AS spot, ref AS teacher, pi AS student FROM t), x AS (SELECT *, exp(teacher) / sum(exp(teacher)) OVER (PARTITION BY sample, spot) AS p FROM r), c AS (SELECT sample, spot, -sum(p * student) AS ce FROM x GROUP BY ALL),
g AS (SELECT sample, avg(ce) AS loss, count(*) AS active FROM c GROUP BY sample), s AS (SELECT *, (row_number() OVER (ORDER BY sample) - 1) // 64 AS step FROM g)
SELECT step, count(*) AS samples, sum(active)::BIGINT AS active, round(sum(loss * active) / sum(active), 6) + 0.0 AS loss FROM s GROUP BY step""")
def distillation_forward_kl_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = D.tokens(spark, sf_dir).select("sample", F.floor(F.col("pos") / 3).alias("spot"), F.col("ref").alias("teacher"), F.col("pi").alias("student"))
    return rounded(X.distillation_steps(tokens, X.OBJECTIVES["topk_forward_kl"](), 64))


@query("(SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def multiset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key as often as the side that has it more often."""
    side = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.count(F.lit(1)).alias(flag))
    most = F.greatest(F.coalesce("R", F.lit(0)), F.coalesce("A", F.lit(0))).cast("int")
    return side("R").join(side("A"), "l_partkey", "full").select("l_partkey", F.explode(F.array_repeat(F.lit(1), most)).alias("_")).select("l_partkey")


@query("""WITH RECURSIVE c AS (SELECT p_partkey // 16 AS map, p_partkey % 16 // 4 AS row, p_partkey % 4 AS col, CASE WHEN p_partkey % 16 = 0 THEN 'S' WHEN p_partkey % 16 = 15 THEN 'G' WHEN p_size % 3 = 0 THEN 'H' ELSE 'F' END AS kind FROM part),
w AS (SELECT map, row, col FROM c WHERE kind = 'S' UNION SELECT c.map, c.row, c.col FROM w JOIN c ON c.map = w.map AND abs(c.row - w.row) + abs(c.col - w.col) = 1 WHERE c.kind <> 'H')
SELECT m.map, g.map IS NOT NULL AS reachable FROM (SELECT DISTINCT map FROM c) m LEFT JOIN (SELECT DISTINCT w.map FROM w JOIN c USING (map, row, col) WHERE kind = 'G') g USING (map)""")
def frozen_lake_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, place = F.col("p_partkey"), F.col("p_partkey") % 16
    kind = F.when(place == 0, "S").when(place == 15, "G").when(F.col("p_size") % 3 == 0, "H").otherwise("F")
    return grids.has_goal_path(table(spark, sf_dir, "part").select(F.floor(k / 16).alias("map"), F.floor(place / 4).alias("row"), (k % 4).alias("col"), kind.alias("kind")))


@query()
def vector_index_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is indexed; queries read 20 of 48 cells.  No SQL: recall against the exact search is tested."""
    e = vectors(spark, sf_dir)
    centres = vector_index.fitted_centres(e, 48)
    return rounded(vector_index.index_top_k(e.where("id % 100 = 0"), vector_index.in_cells(e, centres), centres, 5, probes=20))


@query()
def vector_residual_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is indexed by a code of 16 bytes; the 100 best by codes are compared.  No SQL: recall against the exact search is tested."""
    e, path = vectors(spark, sf_dir), scratch(spark, "codes")
    model = residual_index.fit(e)
    residual_index.write_index(e, model, path)
    return rounded(residual_index.search(e, path, model, e.where("id % 100 = 0"), 5))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def parquet_stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split read as a stream, until its files are used up."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    path = scratch(spark, "split")
    docs.repartition(4).write.parquet(path)
    read = runs.drained(runs.source(spark, path, "doc_id long, lang string", files=2), scratch(spark, "read"), scratch(spark, "progress"))
    return read.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 2 AS version, count(*) AS n FROM documents")
def json_write_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that is written twice: readers see the first or the second one, never a part."""
    path, n = scratch(spark, "record") + ".json", table(spark, sf_dir, "documents").count()
    for version in (1, 2):
        sinks.write_record(spark, {"version": version, "n": n}, path)
    return spark.read.schema("version int, n long").json(path)


FORMATS_SQL = """WITH t AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id,
 concat(string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '' ORDER BY turn), CASE WHEN max(CASE WHEN turn = last THEN role END) <> 'assistant' THEN concat('<|im_start|>assistant', chr(10)) ELSE '' END) AS im,
 concat('<|begin_of_text|>', string_agg(concat('<|start_header_id|>', role, '<|end_header_id|>', chr(10), chr(10), text, '<|eot_id|>'), '' ORDER BY turn)) AS header,
 concat('<s>', string_agg(CASE role WHEN 'system' THEN concat('[SYSTEM_PROMPT] ', text, '[/SYSTEM_PROMPT]') WHEN 'user' THEN concat('[INST] ', text, '[/INST]') ELSE concat(' ', text, '</s>') END, '' ORDER BY turn)) AS inst,
 concat('<bos>', string_agg(concat('<start_of_turn>', CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END, chr(10), text, '<end_of_turn>', chr(10)), '' ORDER BY turn)) AS turn
FROM t GROUP BY conv_id"""


@query(FORMATS_SQL)
def chat_render_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chat in four well-known formats, in the first one ready for an answer."""
    chats = C.to_chats(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return chats.select("conv_id", *[C.chat_text(F.col("messages"), name, prompt=name == "im").alias(name) for name in C.FORMATS])
