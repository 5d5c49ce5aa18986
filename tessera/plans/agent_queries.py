"""Queries over chats with tools and reasoning, and over trees of sampled turns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import renderers as R
from tessera.operators import trees
from tessera.plans.registry import query, table

LOOKUP = {"name": "lookup", "description": "Finds a turn.", "parameters": {"type": "object", "properties": {"turn": {"type": "integer", "description": "Its number"}, "lang": {"type": "string"}}, "required": ["turn"]}}


def tool_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, where some answers have reasoning, some call a tool, and the user's turn after a call is the result."""
    turn, role = F.col("turn"), F.col("role")
    calls = F.array(F.struct(F.lit("lookup").alias("name"), F.to_json(F.struct("turn", F.lit("fr").alias("lang"))).alias("arguments")))
    answer = role == "assistant"
    message = F.struct(
        F.when((role == "user") & (turn % 3 == 2), "tool").otherwise(role).alias("role"), F.col("text").alias("content"), F.when(answer & (turn % 2 == 1), F.concat(F.lit("step "), turn)).alias("reasoning"),
        F.when(answer & (turn % 3 == 1), calls).alias("tool_calls"), F.lit(None).cast("boolean").alias("trainable"),
    )
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"))
    return rows.select("conv_id", F.transform("ms", lambda x: x["m"]).alias("messages"), F.array(F.lit(json.dumps(LOOKUP))).alias("tools"))


RENDER_SQL = r"""WITH m0 AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 3 = 2 THEN 'tool' ELSE role END AS r, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS trimmed,
 CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN concat('step ', turn) END AS why, role = 'assistant' AND turn % 3 = 1 AS calls FROM conversations),
m AS (SELECT *, lag(r) OVER w AS before, lead(r) OVER w AS after, coalesce(turn > max(CASE WHEN r = 'user' THEN turn END) OVER (PARTITION BY conv_id), true) AS late FROM m0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
im AS (SELECT 'im' AS renderer, *, CASE WHEN r = 'tool' THEN concat(CASE WHEN before = 'tool' THEN '' ELSE '<|im_start|>user' END, E'\n<tool_response>\n') ELSE concat('<|im_start|>', r, E'\n', CASE WHEN why IS NOT NULL AND late THEN E'<think>\n' ELSE '' END) END AS head,
 concat(CASE WHEN why IS NOT NULL AND late THEN concat(why, E'\n</think>\n\n') ELSE '' END, text, CASE WHEN calls THEN concat(E'\n<tool_call>\n{"name": "lookup", "arguments": {"turn": ', turn, E', "lang": "fr"}}\n</tool_call>') ELSE '' END) AS body,
 CASE WHEN r = 'tool' THEN concat(E'\n</tool_response>', CASE WHEN after = 'tool' THEN '' ELSE E'<|im_end|>\n' END) ELSE E'<|im_end|>\n' END AS tail FROM m),
tags AS (SELECT 'tags' AS renderer, *, CASE r WHEN 'tool' THEN concat(CASE WHEN before = 'tool' THEN '' ELSE '<|observation|>' END, '<tool_response>') ELSE concat('<|', r, '|>') END AS head,
 CASE WHEN r <> 'assistant' THEN '' WHEN NOT late THEN '</think>' WHEN why IS NULL THEN '<think></think>' ELSE '<think>' END AS pre,
 concat(CASE WHEN why IS NOT NULL AND late THEN concat(why, '</think>') ELSE '' END, trimmed, CASE WHEN calls THEN concat('<tool_call>lookup<arg_key>turn</arg_key><arg_value>', turn, '</arg_value><arg_key>lang</arg_key><arg_value>fr</arg_value></tool_call>') ELSE '' END) AS body,
 concat(CASE r WHEN 'tool' THEN '</tool_response>' ELSE '' END, CASE WHEN after IS NULL AND r = 'assistant' THEN CASE WHEN calls THEN '<|observation|>' ELSE '<|user|>' END ELSE '' END) AS tail FROM m),
sections AS (SELECT 'sections' AS renderer, *, concat(CASE r WHEN 'tool' THEN '<|system|>tool' ELSE concat('<|', r, '|>', r) END, '<|middle|>', CASE WHEN r <> 'assistant' THEN '' WHEN why IS NULL THEN '<think></think>' ELSE '<think>' END) AS head,
 concat(CASE WHEN why IS NOT NULL THEN concat(why, '</think>') ELSE '' END, text, CASE WHEN calls THEN concat('<|calls|><|call|>functions.lookup:0<|argument|>{"turn": ', turn, ', "lang": "fr"}<|/call|><|/calls|>') ELSE '' END) AS body, '<|end|>' AS tail FROM m),
a AS (SELECT renderer, conv_id, turn, r, head, body, tail, false AS learned_head FROM im UNION ALL SELECT renderer, conv_id, turn, r, concat(CASE WHEN before = 'assistant' THEN '' ELSE head END, pre), body, tail, false FROM tags
 UNION ALL SELECT renderer, conv_id, turn - 0.5, 'head', head, '', '', true FROM tags WHERE before = 'assistant' UNION ALL SELECT renderer, conv_id, turn, r, head, body, tail, false FROM sections)
SELECT conv_id, renderer, concat(CASE renderer WHEN 'im' THEN @@im WHEN 'tags' THEN @@tags ELSE @@sections END, string_agg(concat(head, body, tail), '' ORDER BY turn)) AS rendered,
 coalesce(string_agg(CASE WHEN learned_head THEN head WHEN r = 'assistant' THEN concat(body, tail) ELSE '' END, '' ORDER BY turn), '') AS learned FROM a GROUP BY conv_id, renderer"""
_QUOTED = {
    "im": "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n" + json.dumps(LOOKUP) + "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, \"arguments\": <args-json-object>}\n</tool_call><|im_end|>\n",
    "tags": '# Tools\n\n<tools>\n<function name="lookup">\n<description>Finds a turn.</description>\n<parameter name="turn" type="integer" required="true">Its number</parameter>\n<parameter name="lang" type="string" required="false"></parameter>\n</function>\n</tools>',
    "sections": "# Tools\n\n## functions\nnamespace functions {\n// Finds a turn.\ntype lookup = (_: {\n  // Its number\n  turn: number,\n  lang?: string,\n}) => any;\n}<|end|>",
}
_OPENED = {"im": "<|im_start|>system\n", "tags": "[gMASK]<sop><|system|>\n", "sections": "<|system|>tool_declare<|middle|>"}
for _name, _text in _QUOTED.items():
    RENDER_SQL = RENDER_SQL.replace(f"@@{_name}", "'" + (_OPENED[_name] + _text).replace("'", "''") + "'")


@query(RENDER_SQL)
def chat_render_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats with tools, calls and reasoning in three layouts, and the text that each one's weights let learn."""
    chats, out = tool_chats(spark, sf_dir), None
    for name, renderer in R.RENDERERS.items():
        rows = R.chunks(chats, "messages", renderer, "tools").select("conv_id", F.lit(name).alias("renderer"), R.text_of(F.col("chunks")).alias("rendered"), R.learned_text(F.col("chunks")).alias("learned"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH u AS (SELECT conv_id, turn, role, text, coalesce(lead(role) OVER w, 'user') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, turn AS last, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM u WHERE after = 'user' AND role <> 'user'),
b AS (SELECT e.conv_id, e.last, max(c.turn) FILTER (c.role = 'user') AS begin FROM e JOIN conversations c ON c.conv_id = e.conv_id AND c.turn <= e.last GROUP BY e.conv_id, e.last),
x AS (SELECT b.conv_id, b.last, count(*) AS n_messages, count(*) FILTER (c.role = 'assistant' AND c.turn > begin) AS n_learned, coalesce(string_agg(c.text, '|' ORDER BY c.turn) FILTER (c.role = 'assistant' AND c.turn > begin), '') AS learned FROM b JOIN conversations c ON c.conv_id = b.conv_id AND c.turn <= b.last WHERE begin IS NOT NULL GROUP BY b.conv_id, b.last)
SELECT conv_id, n_messages, learned FROM x WHERE n_learned > 0""")
def chat_examples_per_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training example for each user turn, its answers learned and the earlier ones as context."""
    message = F.struct("role", F.col("text").alias("content"), F.lit(None).cast("boolean").alias("trainable"))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms")).select("conv_id", F.transform("ms", lambda x: x["m"]).alias("messages"))
    rows = R.per_user_turn(chats, "messages")
    learned = F.transform(F.filter("messages", lambda m: (m["role"] == "assistant") & F.coalesce(m["trainable"], F.lit(True))), lambda m: m["content"])
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.array_join(learned, "|").alias("learned"))


#: A turn continues the tokens of the turns above it (each gave one of context and two of output) unless its number
#: is divisible by 11 (another first token) or 13 (another token just before its own).
SEGMENTS_SQL = """WITH n AS (SELECT event_id AS node, CASE WHEN event_id >= 3 THEN event_id // 3 END AS parent, list_filter([event_id // 59049, event_id // 19683, event_id // 6561, event_id // 2187, event_id // 729, event_id // 243, event_id // 81, event_id // 27, event_id // 9, event_id // 3], lambda a: a > 0) AS above FROM events),
t AS (SELECT node, parent, above, CASE WHEN node % 11 = 0 AND len(above) > 0 THEN list_concat([99], plain[2:]) WHEN node % 13 = 0 AND len(above) > 0 THEN list_concat(plain[1:len(plain) - 2], [98], plain[len(plain):]) ELSE plain END AS p, [node % 5, node % 3] AS o
 FROM (SELECT *, list_concat(flatten(list_transform(above, lambda a: [a % 7, a % 5, a % 3])), [node % 7]) AS plain FROM n)),
e AS (SELECT c.node, c.parent, c.above, c.p, c.o, t.node IS NULL OR c.p[1:len(t.p) + 2] <> list_concat(t.p, t.o) AS cut FROM t c LEFT JOIN t ON t.node = c.parent),
leaf AS (SELECT node AS leaf, list_concat(above, [node]) AS path FROM e WHERE node NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL)),
w AS (SELECT leaf, unnest(path) AS node, generate_subscripts(path, 1) AS i FROM leaf),
s AS (SELECT w.leaf, w.node, i, p, o, sum(cut::INT) OVER (PARTITION BY leaf ORDER BY i ROWS UNBOUNDED PRECEDING) AS seg FROM w JOIN e USING (node)),
g AS (SELECT leaf, seg, arg_max(node, i) AS "end", arg_min(node, i) AS begin, count(*) AS n_turns, arg_min(len(p), i) AS n_prompt, max(len(p)) + 2 AS n_tokens FROM s GROUP BY leaf, seg),
k AS (SELECT leaf, seg, "end", begin, n_turns, n_prompt, n_tokens FROM g WHERE n_tokens <= 20),
own AS (SELECT node, min(leaf) AS leaf FROM s JOIN k USING (leaf, seg) GROUP BY node),
x AS (SELECT k.leaf, k."end", k.begin, k.n_turns, k.n_prompt, k.n_tokens, sum(2) AS n_learned, string_agg(concat(len(s.p), '-', len(s.p) + 2), ' ' ORDER BY i) AS spans FROM k JOIN s USING (leaf, seg) JOIN own ON own.node = s.node AND own.leaf = k.leaf GROUP BY ALL)
SELECT leaf, "end", x.begin, n_turns, n_prompt::BIGINT AS n_prompt, n_tokens::BIGINT AS n_tokens, n_learned::BIGINT AS n_learned, spans, sha256(array_to_string(list_concat(e.p, e.o), ',')) AS tokens_sha256 FROM x JOIN e ON e.node = x."end\""""


def sampled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, prompt_ids, output_ids) with event k below event k // 3; see SEGMENTS_SQL."""
    node = F.col("node")
    above = F.filter(F.transform(F.sequence(F.lit(10), F.lit(1), F.lit(-1)), lambda j: F.floor(node / F.pow(F.lit(3.0), j))), lambda a: a > 0)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("node")).withColumn("above", above)
    rows = rows.withColumn("plain", F.concat(F.flatten(F.transform("above", lambda a: F.array(a % 7, a % 5, a % 3))), F.array(node % 7)))
    n, deep = F.size("plain"), F.size("above") > 0
    first = F.concat(F.array(F.lit(99).cast("long")), F.slice("plain", F.lit(2), n))
    last = F.concat(F.slice("plain", F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.lit(98).cast("long")), F.slice("plain", n, F.lit(1)))
    prompt = F.when((node % 11 == 0) & deep, first).when((node % 13 == 0) & deep, last).otherwise(F.col("plain"))
    return rows.select("node", F.when(node >= 3, F.floor(node / 3)).alias("parent"), prompt.alias("prompt_ids"), F.array(node % 5, node % 3).alias("output_ids"))


@query(SEGMENTS_SQL)
def trajectory_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training segments of at most 20 tokens from a tree of turns, each turn's loss owned once."""
    turns = sampled_turns(spark, sf_dir)
    segments = trees.owned_segments(turns, max_context_tokens=20)
    tokens = turns.where(F.size("prompt_ids") + F.size("output_ids") <= 20).select(F.col("node").alias("end"), F.sha2(F.array_join(F.concat("prompt_ids", "output_ids"), ","), 256).alias("tokens_sha256"))
    learned = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), " ")
    return segments.join(tokens, "end").select("leaf", "end", "begin", "n_turns", F.col("n_prompt").cast("long").alias("n_prompt"), F.col("n_tokens").cast("long").alias("n_tokens"), learned.alias("n_learned"), shown.alias("spans"), "tokens_sha256")
