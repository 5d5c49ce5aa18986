"""Queries over texts, chats, pages, token arrays and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import text as T
from tessera.operators import chat as C
from tessera.operators import retrieval as V
from tessera.plans.registry import query, table
from tessera.plans.rollout_queries import rounded

#: Texts with each answer format, made from rows of events: number n, and one of six forms by event_id.
ANSWERS_SQL = r"""SELECT event_id, n, CASE event_id % 6
 WHEN 0 THEN concat('We get <answer> ', n, ' </answer> and <ANSWER>', n + 1, '</ANSWER>') WHEN 1 THEN concat('So \boxed{\frac{', n, '}{2}} done')
 WHEN 2 THEN concat('Sum', chr(10), '#### ', n, ',000') WHEN 3 THEN concat('**Answer:** ', n, chr(10), 'bye') WHEN 4 THEN concat('x', chr(10), 'Final: ', n, chr(10), ' ') ELSE concat('Reasons.', chr(10), 'ANSWER: ', chr((65 + n % 4)::INT)) END AS t
FROM (SELECT event_id, event_id % 23 AS n FROM events)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 23).cast("string")
    k = F.col("event_id") % 6
    forms = [
        F.concat(F.lit("We get <answer> "), n, F.lit(" </answer> and <ANSWER>"), (F.col("event_id") % 23 + 1).cast("string"), F.lit("</ANSWER>")),
        F.concat(F.lit("So \\boxed{\\frac{"), n, F.lit("}{2}} done")),
        F.concat(F.lit("Sum\n#### "), n, F.lit(",000")),
        F.concat(F.lit("**Answer:** "), n, F.lit("\nbye")),
        F.concat(F.lit("x\nFinal: "), n, F.lit("\n ")),
    ]
    t = F.concat(F.lit("Reasons.\nANSWER: "), F.char((65 + F.col("event_id") % 23 % 4).cast("long")))
    for i, form in enumerate(forms):
        t = F.when(k == i, form).otherwise(t)
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 23).alias("n"), t.alias("t"))


@query(f"WITH a AS ({ANSWERS_SQL}) SELECT event_id, CASE WHEN event_id % 6 = 0 THEN n::VARCHAR END AS first, CASE WHEN event_id % 6 = 0 THEN (n + 1)::VARCHAR END AS last, CASE WHEN event_id % 6 = 1 THEN concat('\\frac{{', n, '}}{{2}}') END AS boxed, CASE WHEN event_id % 6 = 2 THEN concat(n, '000') END AS gsm8k, CASE event_id % 6 WHEN 0 THEN (n + 1)::VARCHAR WHEN 1 THEN concat('\\frac{{', n, '}}{{2}}') WHEN 3 THEN n::VARCHAR END AS cascade, CASE WHEN event_id % 6 = 4 THEN n::VARCHAR END AS final, CASE WHEN event_id % 6 = 5 THEN chr((65 + n % 4)::INT) END AS letter FROM a")
def answer_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return answers(spark, sf_dir).select(
        "event_id", T.answer_tag_first(t).alias("first"), T.answer_tag_last(t).alias("last"), T.boxed(t).alias("boxed"), T.gsm8k_number(t).alias("gsm8k"),
        T.answer_cascade(t).alias("cascade"), T.final_answer_line(t).alias("final"), T.mcq_letter(t).alias("letter"),
    )


@query(r"SELECT doc_id, regexp_replace(regexp_replace(trim(text), '\s+', ' ', 'g'), '\.+$', '') AS normalized FROM documents")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_answer(F.col("text")).alias("normalized"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '\s+', ' ', 'g')) AS normalized FROM documents WHERE lang = 'en'")
def squad_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", T.squad_normalize(F.col("text")).alias("normalized"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]+')) AS n_words FROM documents")
def word_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.word_tokens(F.col("text"))).cast("long").alias("n_words"))


F1_SQL = r"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS g FROM benchmark), p AS (SELECT a.item_id, a.g AS gold, c.g AS pred FROM b a JOIN b c ON c.item_id = a.item_id + 1),
w AS (SELECT item_id, x, count(*) AS n FROM (SELECT item_id, unnest(gold) AS x FROM p) GROUP BY ALL), v AS (SELECT item_id, x, count(*) AS n FROM (SELECT item_id, unnest(pred) AS x FROM p) GROUP BY ALL),
c AS (SELECT item_id, sum(least(w.n, v.n)) AS common FROM w JOIN v USING (item_id, x) GROUP BY item_id), z AS (SELECT item_id, coalesce(common, 0)::DOUBLE AS common, len(gold) AS g, len(pred) AS p FROM p LEFT JOIN c USING (item_id))
SELECT item_id, round(2 * common / (g + p), 6) + 0.0 AS f1, round(common / (g + p - common), 6) + 0.0 AS jaccard FROM z"""


@query(F1_SQL)
def token_f1_and_multiset_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("gold"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("gold").alias("pred"))
    return rounded(b.join(nxt, "item_id").select("item_id", T.token_f1(F.col("pred"), F.col("gold")).alias("f1"), T.multiset_jaccard(F.col("pred"), F.col("gold")).alias("jaccard")))


@query("SELECT event_id, abs(value - round(value, 1)) < 0.02 AS matched, round(value, 2) + 0.0 AS amount FROM events")
def numeric_match_and_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = F.concat(F.lit("$ "), F.format_string("%.2f", F.round("value", 2)))
    return table(spark, sf_dir, "events").select("event_id", T.numeric_match(F.col("value").cast("string"), F.round("value", 1).cast("string"), 0.02).alias("matched"), (T.currency(money) + 0.0).alias("amount"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def date_parse_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(shown, "MM/dd/yyyy", "yyyy-MM-dd").alias("day"))


@query("SELECT page_id, concat('Page ', page_id, ' é') AS title FROM pages")
def wiki_title_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://example.org/wiki/Page_"), F.col("page_id").cast("string"), F.lit("_%C3%A9#top"))
    return table(spark, sf_dir, "pages").select("page_id", T.wiki_title(url).alias("title"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, regexp_replace(trim(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')), '\s+', ' ', 'g') AS body FROM a""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))


@query("SELECT doc_id, concat('[', lang, '] ', source, ': ', n_chars, ' characters') AS prompt FROM documents")
def string_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.template("[{lang}] {source}: {n_chars} characters").alias("prompt"))


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents), c AS (SELECT doc_id, ws, unnest(range(0, len(ws), 64)) AS i FROM w) SELECT doc_id, (i // 64)::INT AS chunk, array_to_string(ws[i + 1:i + 64], ' ') AS body FROM c")
def wide_to_long_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.word_chunks(F.col("text"), 64)).alias("chunk", "body"))


@query(r"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s, text FROM documents) SELECT doc_id, CASE WHEN len(s) > 0 THEN len(s) ELSE 1 END AS n_sentences, CASE WHEN len(s) > 0 THEN s[1] ELSE text END AS first FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.element_at("s", 1).alias("first"))


@query("WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 120 AND NOT starts_with(x, '=')) AS p FROM documents) SELECT doc_id, least(len(p), 3) AS n_blocks, CASE WHEN len(p) > 0 THEN left(p[1], 200) END AS first FROM l")
def article_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", T.article_blocks(F.col("text"), 120, 200, 3).alias("b"))
    return b.select("doc_id", F.size("b").cast("long").alias("n_blocks"), F.try_element_at("b", F.lit(1)).alias("first"))


@query("SELECT event_id, 'look' AS name, concat('{\"n\":', event_id, '}') AS arguments FROM events")
def tool_call_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('Sure. <tool_call>{"name": "look", "arguments": {"n":'), F.col("event_id").cast("string"), F.lit("}}</tool_call> then"))
    return table(spark, sf_dir, "events").select("event_id", T.tool_call(text).alias("c")).select("event_id", "c.name", "c.arguments")


CHATS_SQL = "SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id"


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.to_chats(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, string_agg(concat('<|', role, '|>', chr(10), text), chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", C.render(F.col("messages")).alias("rendered"))


@query("WITH l AS (SELECT conv_id, coalesce(max(turn) FILTER (role <> 'assistant'), -1) AS last FROM conversations GROUP BY conv_id) SELECT conv_id, count(*) FILTER (turn <= last) AS n_kept FROM conversations JOIN l USING (conv_id) GROUP BY conv_id")
def strip_trailing_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("conv_id", F.size(C.strip_trailing_assistant(F.col("messages"))).cast("long").alias("n_kept"))


@query("SELECT conv_id, turn, n_context, context, target FROM (SELECT conv_id, turn, count(*) OVER w AS n_context, coalesce(string_agg(text, chr(10)) OVER w, '') AS context, text AS target, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS u WHERE role = 'assistant' AND n_context > 0")
def multi_turn_unroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unroll(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, count(*) AS n_segments, count(*) FILTER (role = 'assistant') AS n_trained, sum(CASE WHEN role = 'assistant' THEN length(role) + length(text) + 5 ELSE 0 END)::BIGINT AS trained_chars FROM conversations GROUP BY conv_id")
def render_loss_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chats(spark, sf_dir).select("conv_id", C.loss_segments(F.col("messages")).alias("s"))
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]) * x["trained"])
    return s.select("conv_id", F.size("s").cast("long").alias("n_segments"), F.size(F.filter("s", lambda x: x["trained"] == 1)).cast("long").alias("n_trained"), chars.alias("trained_chars"))


@query("SELECT event_id, CASE WHEN event_id % 5 - 2 < 0 THEN 'a' ELSE 'b' END || event_id AS chosen, CASE WHEN event_id % 5 - 2 < 0 THEN 'b' ELSE 'a' END || event_id AS rejected FROM events WHERE event_id % 5 <> 2")
def helpsteer_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda x: F.concat(F.lit(x), F.col("event_id").cast("string"))
    p = table(spark, sf_dir, "events").select("event_id", C.signed_preference(side("a"), side("b"), F.col("event_id") % 5 - 2).alias("p")).where("p is not null")
    return p.select("event_id", "p.chosen", "p.rejected")


@query("WITH s AS (SELECT user_id, arg_max(event_id, event_id) FILTER (event_type = 'purchase') AS c, arg_max(event_id, event_id) FILTER (event_type = 'error') AS r FROM events GROUP BY user_id) SELECT user_id, c::VARCHAR AS chosen, r::VARCHAR AS rejected FROM s WHERE c IS NOT NULL AND r IS NOT NULL")
def normalize_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", 0.0).otherwise(0.5)
    sample = F.struct("event_id", F.col("event_id").cast("string").alias("text"), score.alias("score"), F.lit(None).cast("double").alias("evals_score"))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    return g.select("user_id", C.preference_from_samples(F.col("samples")).alias("p")).where("p is not null").select("user_id", "p.chosen", "p.rejected")


@query("SELECT doc_id, list_filter([CASE WHEN text IS NULL OR text = '' THEN 'missing' END, CASE WHEN n_chars < 900 THEN 'stub' END, CASE WHEN contains(text, '|') THEN 'markup' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END], lambda x: x IS NOT NULL) AS errors FROM documents")
def privileged_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"missing": F.col("text").isNull() | (F.col("text") == ""), "stub": F.col("n_chars") < 900, "markup": F.contains("text", F.lit("|")), "license": F.contains(F.lower("text"), F.lit("license"))}
    return C.audit(table(spark, sf_dir, "documents"), "doc_id", rules)


@query("SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus IN ('F') AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' END, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' END], lambda x: x IS NOT NULL) AS reasons FROM orders")
def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"urgent": {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}, "open": {"o_orderstatus": ["O", "P"]}}
    return table(spark, sf_dir, "orders").select("o_orderkey", C.rule_reasons(rules).alias("reasons"))


@query("WITH t AS (SELECT *, count(*) OVER (PARTITION BY text) > 1 AS twin FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (twin) AS twins, count(*) FILTER (n_chars < 900) AS stubs, count(*) FILTER (starts_with(text, '%PDF')) AS blobs FROM t GROUP BY lang")
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stub, blob = F.count_if(F.col("n_chars") < 900).alias("stubs"), F.count_if(F.startswith(F.col("text"), F.lit("%PDF"))).alias("blobs")
    copies = table(spark, sf_dir, "documents").groupBy("lang", F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), stub, blob)
    every = copies.withColumn("all", F.sum("n").over(W.partitionBy("h")))  # at most one row a language
    return every.groupBy("lang").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("all") > 1, F.col("n")).otherwise(0)).alias("twins"), F.sum("stubs").alias("stubs"), F.sum("blobs").alias("blobs"))


ARRAYS_SQL = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t, list((l_returnflag <> 'N')::INT ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS m FROM lineitem GROUP BY l_orderkey"


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_returnflag") != "N").cast("int").alias("m"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return g.select("l_orderkey", F.col("r.l_partkey").alias("t"), F.col("r.m").alias("m"))


@query(f"WITH a AS ({ARRAYS_SQL}) SELECT l_orderkey, t[1:least(len(t) - 1, 4)] AS inputs, t[2:least(len(t) - 1, 4) + 1] AS targets, len(list_filter(m, lambda x: x > 0)) AS trainable FROM a WHERE len(t) >= 2")
def shift_next_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays(spark, sf_dir).where("size(t) >= 2").select("l_orderkey", A.shift_inputs(F.col("t"), 4).alias("inputs"), A.shift_targets(F.col("t"), 4).alias("targets"), A.count_trainable(F.col("m")).cast("long").alias("trainable"))


@query(f"WITH a AS ({ARRAYS_SQL}) SELECT l_orderkey, list_transform(t, lambda x, i: CASE WHEN i <= 2 THEN -100 ELSE x END) AS labels, list_concat([0.0::DOUBLE, 0.0::DOUBLE], list_transform(t, lambda x: x::DOUBLE)) AS padded, list_resize(list_transform(t, lambda x: x::DOUBLE), 5, 0.0::DOUBLE) AS fixed FROM a")
def prompt_mask_and_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.transform("t", lambda x: x.cast("double"))
    return arrays(spark, sf_dir).select("l_orderkey", A.prompt_mask(F.col("t"), F.lit(3)).alias("labels"), A.left_pad(wide, F.lit(2)).alias("padded"), A.pad_or_trim(wide, 5).alias("fixed"))


@query(f"WITH a AS ({ARRAYS_SQL}) SELECT l_orderkey, list_transform(m, lambda x, i: CASE WHEN x > 0 THEN coalesce([10.0::DOUBLE, 20.0, 30.0][list_sum(m[1:i])::INT], 0.0) ELSE 0.0 END) AS scattered FROM a")
def scatter_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0))
    return arrays(spark, sf_dir).select("l_orderkey", A.scatter_active(F.col("m"), values).alias("scattered"))


@query("WITH l AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), p AS (SELECT a.doc_id, a.w AS a, b.w AS b FROM l a JOIN l b ON b.doc_id = a.doc_id + 1), i AS (SELECT doc_id, a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM p) SELECT doc_id, coalesce(min(i) FILTER (a[i] <> b[i]) - 1, max(i)) AS prefix FROM i GROUP BY doc_id")
def common_prefix_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("a"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(nxt, "doc_id").select("doc_id", A.common_prefix(F.col("a"), F.col("b")).alias("prefix"))


@query(f"WITH a AS ({ARRAYS_SQL}), i AS (SELECT l_orderkey, m, unnest(range(1, len(m))) AS i FROM a) SELECT a.l_orderkey, (SELECT max(i) - 1 FROM i WHERE i.l_orderkey = a.l_orderkey AND i.m[i.i] = 1 AND i.m[i.i + 1] = 0) AS start FROM a")
def last_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays(spark, sf_dir).select("l_orderkey", A.last_subsequence(F.col("m"), F.array(F.lit(1), F.lit(0))).cast("long").alias("start"))


@query("WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM e q, e d WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) SELECT qid, doc_id, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= 5")
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(V.cosine_top_k(e.where("id % 100 = 0"), e, 5))


@query("WITH e AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM e q, e d WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) SELECT qid, doc_id, round(score, 6) + 0.0 AS score, rank FROM r WHERE rank <= 3")
def resized_embedding_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rounded(V.cosine_top_k(e.where("id % 100 = 0"), e, 3, dims=16))


RUN_SQL = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, q.label AS ql, d.vec_id AS doc_id, d.label AS dl, round(list_cosine_similarity(q.v, d.v), 9) AS score FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s), t AS (SELECT *, (ql = dl)::INT AS hit FROM r WHERE rank <= 100)"


def retrieval_run(spark: SparkSession, sf_dir: str, k: int = 100) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, sf_dir, "embeddings")
    e = raw.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    top = V.cosine_top_k(e.where("id % 100 = 0"), e, k + 1).where("qid <> doc_id")
    run = top.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return run, raw.select(F.col("vec_id").alias("id"), "label")


@query(f"WITH {RUN_SQL}, u AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM t), p AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN hit / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS found, max(CASE WHEN hit = 1 THEN 1.0 / rank ELSE 0 END) AS rr, sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) AS prec FROM u GROUP BY qid), i AS (SELECT q.vec_id AS qid, count(*) AS relevant FROM e q JOIN e d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id), j AS (SELECT qid, relevant, list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda x: 1.0 / log2(x + 1.0))) AS idcg FROM i) SELECT count(*) AS n_queries, round(avg(dcg / idcg), 5) + 0.0 AS ndcg, round(avg(found / relevant), 5) + 0.0 AS recall, round(avg(rr), 5) + 0.0 AS mrr, round(avg(prec / relevant), 5) + 0.0 AS map FROM p JOIN j USING (qid)")
def recall_mrr_ndcg_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = V.label_ranking_metrics(*retrieval_run(spark, sf_dir), [10])
    return rounded(metrics.withColumnsRenamed({"ndcg_10": "ndcg", "recall_10": "recall"}), 5)


@query(f"""WITH {RUN_SQL}, u AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM t),
p AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN hit / log2(rank + 1.0) ELSE 0 END) AS dcg_10, sum(hit / log2(rank + 1.0)) AS dcg_100, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS found_10, sum(hit) AS found_100, max(CASE WHEN hit = 1 THEN 1.0 / rank ELSE 0 END) AS rr, sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) AS prec FROM u GROUP BY qid),
i AS (SELECT q.vec_id AS qid, count(*) AS relevant FROM e q JOIN e d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id),
j AS (SELECT qid, relevant, list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda x: 1.0 / log2(x + 1.0))) AS idcg_10, list_sum(list_transform(range(1, least(relevant, 100) + 1), lambda x: 1.0 / log2(x + 1.0))) AS idcg_100 FROM i)
SELECT count(*) AS n_queries, round(avg(dcg_10 / idcg_10), 5) + 0.0 AS ndcg_10, round(avg(dcg_100 / idcg_100), 5) + 0.0 AS ndcg_100, round(avg(found_10 / relevant), 5) + 0.0 AS recall_10, round(avg(found_100 / relevant), 5) + 0.0 AS recall_100, round(avg(rr), 5) + 0.0 AS mrr_100, round(avg(prec / relevant), 5) + 0.0 AS map_100 FROM p JOIN j USING (qid)""")
def ranking_metrics_10_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 10 and 100, over runs of 100 rows, as MAP@100 asks for."""
    metrics = V.label_ranking_metrics(*retrieval_run(spark, sf_dir), [10, 100])
    return rounded(metrics.withColumnsRenamed({"mrr": "mrr_100", "map": "map_100"}), 5)


@query(r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), n AS (SELECT count(*) AS n FROM documents), tf AS (SELECT doc_id, w, count(*) AS tf FROM c GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
q AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), qc AS (SELECT qid, w, count(*) AS q FROM q GROUP BY ALL),
s AS (SELECT qid, doc_id, round(sum(q * tf * (ln((n + 1.0) / (df + 1)) + 1)), 3) AS score FROM qc JOIN tf USING (w) JOIN df USING (w), n GROUP BY qid, doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) SELECT qid, doc_id, score + 0.0 AS score, rank FROM r WHERE rank <= 5""")
def tfidf_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("words")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), words)
    return V.tfidf_top_k(queries, table(spark, sf_dir, "documents").select("doc_id", words), 5)


@query("WITH q AS (SELECT doc_id AS qid, doc_id, 1 AS rel, text FROM documents WHERE doc_id % 100 = 0) SELECT q.qid, d.doc_id, max(rel) AS rel FROM q JOIN documents d ON d.text = q.text GROUP BY ALL")
def twin_expand_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return V.twin_expand(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "doc_id", F.lit(1).alias("rel")), docs)


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def dict_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'eval' ELSE 'train' END AS split FROM documents")
def semi_anti_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(held, "doc_id", "left_semi").withColumn("split", F.lit("eval")).unionByName(docs.join(held, "doc_id", "left_anti").withColumn("split", F.lit("train")))


@query("(SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def multiset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersectAll(li.where("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT s_suppkey AS id FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1995-01-01' UNION ALL SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 10")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    late = li.where("l_quantity > 49 AND l_returnflag = 'R' AND l_shipdate < TIMESTAMP_NTZ '1995-01-01'").select("l_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).subtract(late).unionAll(table(spark, sf_dir, "part").select("p_partkey")).subtract(li.where("l_quantity > 10").select("l_partkey"))


@query("SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders")
def set_union_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, sf_dir, "orders").select("o_custkey")).distinct()


@query("SELECT 'documents' AS origin, doc_id AS id, lang FROM documents UNION ALL SELECT 'benchmark', item_id, NULL FROM benchmark")
def concat_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "lang")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id")), allowMissingColumns=True)


@query("SELECT doc_id FROM documents WHERE n_chars BETWEEN 900 AND 4000 AND lang IN ('en', 'de')")
def length_and_language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("n_chars").between(900, 4000) & F.col("lang").isin("en", "de")).select("doc_id")


@query("WITH a AS (SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id)), b AS (SELECT lang, arg_max(doc_id, n_chars * 1000000 - doc_id) FILTER (quality = 1) AS chosen, arg_min(doc_id, n_chars * 1000000 + doc_id) FILTER (quality = 0) AS rejected FROM a GROUP BY lang) SELECT lang, chosen, rejected FROM b WHERE chosen IS NOT NULL AND rejected IS NOT NULL")
def preference_pairs_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    picked = a.groupBy("lang").agg(F.max_by(F.when(F.col("quality") == 1, F.col("doc_id")), F.when(F.col("quality") == 1, F.col("n_chars") * 1000000 - F.col("doc_id"))).alias("chosen"), F.min_by(F.when(F.col("quality") == 0, F.col("doc_id")), F.when(F.col("quality") == 0, F.col("n_chars") * 1000000 + F.col("doc_id"))).alias("rejected"))
    return picked.where("chosen is not null and rejected is not null")


@query("SELECT event_id, sha256(concat('{\"event_type\":\"', event_type, '\",\"user_id\":', user_id, '}')) AS digest FROM events")
def stable_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("digest"))


@query("SELECT user_id, ts::DATE AS day, min(event_id) AS first_event FROM events GROUP BY ALL")
def utc_day_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("first_event"))


@query("SELECT doc_id, doc_id % 3 AS teacher, CASE doc_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'terse' ELSE 'long' END AS style FROM documents")
def route_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = spark.createDataFrame([(0, "plain"), (1, "terse"), (2, "long")], "teacher long, style string")
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("teacher")).join(F.broadcast(styles), "teacher").select("doc_id", "teacher", "style")
