"""Chats as chunks of (text, weight, kind, message), by renderers that are described as data.

A description holds the texts around each role's content, how tools are declared and called (``json``, ``xml`` or ``typed``),
where reasoning is kept, and what ends an answer.  It is compiled to one column expression over an array of messages; only
the JSON of declarations and calls is written by a small Arrow-batched function.

Messages are structs of role, content, reasoning, tool_calls (array of name and arguments, a JSON object) and trainable
(null: as the description says).  Null contents and missing calls are empty.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,content:string,reasoning:string,tool_calls:array<struct<name:string,arguments:string>>,trainable:boolean>"


@dataclass(frozen=True)
class Around:
    """Text before and after a content; with ``run`` neighbours of one role share ``open`` and ``close``."""

    head: str = ""
    tail: str = ""
    open: str = ""
    close: str = ""


@dataclass(frozen=True)
class Renderer:
    """``reasoning``: what opens and closes it; ``unthought``: what an answer without reasoning begins with, ``dropped``: one whose
    reasoning is left out.  ``keep``: ``all``, ``last`` (after the last user turn) or ``none``.  ``calls``: text before the first and
    after the last call, before and after each.  ``tools``: text before, between and after declarations.  With ``stops_at_head``
    an answer ends where the next role's head begins: that head is learned, and ``stop`` or ``stop_calls`` (after calls)
    stands after a last answer.  ``roles`` names what other roles are taken for.
    """

    roles: dict[str, Around]
    assistant: Around
    opening: str = ""
    tools: tuple[str, str, str] = ("", "\n", "")
    tools_style: str = "json"
    calls: tuple[str, str, str, str] = ("", "", "", "")
    calls_style: str = "json"
    reasoning: tuple[str, str] = ("", "")
    unthought: str = ""
    dropped: str = ""
    keep: str = "last"
    trimmed: bool = False
    stops_at_head: bool = False
    stop: str = ""
    stop_calls: str = ""
    prompt: str = ""
    aliases: dict[str, str] = field(default_factory=dict)


def _function(spec: dict) -> dict:
    return spec["function"] if isinstance(spec.get("function"), dict) else spec


def _typed(schema: dict, indent: str = "") -> str:
    """A JSON schema as a type expression."""
    if "enum" in schema:
        return " | ".join(json.dumps(x, ensure_ascii=False) for x in schema["enum"])
    if "anyOf" in schema:
        return " | ".join(_typed(s, indent) for s in schema["anyOf"])
    kind = schema.get("type", "any")
    if isinstance(kind, list):
        return " | ".join(_typed({**schema, "type": k}, indent) for k in kind)
    if kind == "array":
        item = _typed(schema.get("items", {}), indent)
        return f"Array<{item}>" if " " in item else f"{item}[]"
    if kind == "object":
        required, lines = set(schema.get("required", [])), []
        for name, of in schema.get("properties", {}).items():
            lines += [f"{indent}  // {line}" for line in of.get("description", "").splitlines()]
            default = f" // default: {json.dumps(of['default'], ensure_ascii=False)}" if "default" in of else ""
            lines.append(f"{indent}  {name}{'' if name in required else '?'}: {_typed(of, indent + '  ')},{default}")
        return "\n".join(["{", *lines, f"{indent}}}"]) if lines else "{}"
    return {"integer": "number", "null": "null"}.get(kind, kind)


def declaration(spec: dict, style: str) -> str:
    """One tool: as JSON, as XML, or as the type of a function."""
    f = _function(spec)
    schema = f.get("parameters") or {}
    if style == "json":
        return json.dumps(spec, ensure_ascii=False)
    if style == "xml":
        required = set(schema.get("required", []))
        lines = [f'<parameter name="{n}" type="{s.get("type", "any")}" required="{str(n in required).lower()}">{s.get("description", "")}</parameter>' for n, s in schema.get("properties", {}).items()]
        return "\n".join([f'<function name="{f["name"]}">', f"<description>{f.get('description', '')}</description>", *lines, "</function>"])
    if style == "typed":
        about = [f"// {line}" for line in f.get("description", "").splitlines()]
        taken = f"(_: {_typed({'type': 'object', **schema})})" if schema.get("properties") else "()"
        return "\n".join([*about, f"type {f['name']} = {taken} => any;"])
    raise ValueError(f"no style {style}")


def call(name: str, arguments: str | None, style: str, number: int) -> str:
    """One call: as a JSON object, as keys and values in XML (strings as they are), or as name, number and JSON."""
    given = json.loads(arguments) if arguments else {}
    if not isinstance(given, dict):
        raise ValueError(f"the arguments of {name} are no JSON object")
    if style == "json":
        return json.dumps({"name": name, "arguments": given}, ensure_ascii=False)
    if style == "xml":
        shown = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return name + "".join(f"<arg_key>{k}</arg_key><arg_value>{shown(v)}</arg_value>" for k, v in given.items())
    if style == "typed":
        return f"functions.{name}:{number}<|argument|>{json.dumps(given, ensure_ascii=False)}"
    raise ValueError(f"no style {style}")


def _each(write: Callable[[list], list], kind: str) -> Callable[[Column], Column]:
    """``write`` over JSON arrays, null for null, in Arrow batches."""

    @F.pandas_udf(kind)
    def written(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else write(json.loads(v)))

    return written


def chunks(df: DataFrame, messages: str, renderer: Renderer, tools: str | None = None, prompt: bool = False, train: str = "all", name: str = "chunks") -> DataFrame:
    """df with ``name``: array of (text, weight, kind, message) without empty texts; joined, the texts are the rendered chat.

    ``tools`` is a column of declarations, an array of JSON objects.  With ``prompt`` the text that asks for an answer
    follows.  ``train``: ``all`` answers, the ``last`` one, or ``none``, where a message doesn't say.  Learned are an
    answer's kept reasoning (not what opens it), its content, calls and end.  Roles without a description are an error.
    A chat without messages has the opening and declarations only.  Kinds are opening, tools, head, reasoning,
    content, calls, tail, prompt.
    """
    r, first, last, before, after = renderer, *renderer.calls
    wrapped = _each(lambda ms: [first + "".join(before + call(c["name"], c.get("arguments"), r.calls_style, k) + after for k, c in enumerate(m)) + last if m else "" for m in ms], "array<string>")
    listed = _each(lambda ts: r.tools[0] + r.tools[1].join(declaration(json.loads(t), r.tools_style) for t in ts) + r.tools[2] if ts else "", "string")
    m_of = lambda x: x["role"] if not r.aliases else F.coalesce(*[F.when(x["role"] == a, F.lit(b)) for a, b in r.aliases.items()], x["role"])
    every = F.transform(F.coalesce(F.col(messages), F.array().cast(f"array<{MESSAGE}>")), lambda m: m.withField("role", m_of(m)))
    df = df.withColumn("_m", every)
    df = df.withColumn("_calls", wrapped(F.to_json(F.transform("_m", lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<name:string,arguments:string>>"))))))
    df = df.withColumn("_tools", F.coalesce(listed(F.to_json(F.col(tools))), F.lit("")) if tools else F.lit(""))
    n = F.size("_m")
    at = lambda i: F.get(F.col("_m"), i)["role"]
    place = lambda role: F.coalesce(F.array_max(F.transform("_m", lambda m, i: F.when(m["role"] == role, i).otherwise(-1))), F.lit(-1))
    df = df.withColumn("_user", place("user")).withColumn("_answer", place("assistant"))
    default = {"all": F.lit(True), "none": F.lit(False)}

    def learned(m: Column, i: Column) -> Column:
        said = default[train] if train in default else i == F.col("_answer")
        return (m["role"] == "assistant") & F.coalesce(m["trainable"], said)

    def chunk(text: Column | str, weight: Column | float, kind: str, i: Column) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        weight = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
        return F.struct(text.alias("text"), weight.alias("weight"), F.lit(kind).alias("kind"), i.cast("int").alias("message"))

    def around(m: Column, part: str) -> Column:
        missing = F.raise_error(F.concat(F.lit("no description of the role "), F.coalesce(m["role"], F.lit("null")))).cast("string")
        return F.coalesce(*[F.when(m["role"] == role, F.lit(getattr(a, part))) for role, a in [*r.roles.items(), ("assistant", r.assistant)]], missing)

    def told(m: Column, i: Column) -> Column:
        text = F.coalesce(m["content"], F.lit(""))
        text, thought = (F.regexp_replace(text, r"^\s+|\s+$", ""), F.regexp_replace(m["reasoning"], r"^\s+|\s+$", "")) if r.trimmed else (text, m["reasoning"])
        answer, own = m["role"] == "assistant", learned(m, i)
        weight = F.when(own, 1.0).otherwise(0.0)
        kept = {"all": F.lit(True), "none": F.lit(False), "last": i > F.col("_user")}[r.keep]
        has = F.coalesce(thought != "", F.lit(False))
        opened = F.when(answer & kept & has, r.reasoning[0]).when(answer & kept, r.unthought).when(answer, r.dropped).otherwise("")
        shown = F.when(answer & kept & has, F.concat(thought, F.lit(r.reasoning[1]))).otherwise("")
        calls = F.coalesce(F.get(F.col("_calls"), i), F.lit(""))
        new, ends = ~F.coalesce(at(i - 1) == m["role"], F.lit(False)) | (i == 0), ~F.coalesce(at(i + 1) == m["role"], F.lit(False)) | (i == n - 1)
        before = F.when(i > 0, learned(F.get(F.col("_m"), i - 1), i - 1)).otherwise(False)
        head = F.when(before, 1.0).otherwise(0.0) if r.stops_at_head else F.lit(0.0)
        tail = F.concat(around(m, "tail"), F.when(ends, around(m, "close")).otherwise(""))
        stop = F.when(answer & (i == n - 1), F.when(calls != "", r.stop_calls).otherwise(r.stop)).otherwise("")
        return F.array(
            chunk(F.concat(F.when(new, around(m, "open")).otherwise(""), around(m, "head")), head, "head", i), chunk(opened, 0, "head", i), chunk(shown, weight, "reasoning", i), chunk(text, weight, "content", i),
            chunk(F.when(answer, calls).otherwise(""), weight, "calls", i), chunk(F.concat(tail, stop), weight, "tail", i),
        )

    none = F.lit(None).cast("int")
    lead = F.array(chunk(r.opening, 0, "opening", none), chunk(F.col("_tools"), 0, "tools", none))
    asks = F.array(chunk(r.prompt if prompt else "", 0, "prompt", none))
    parts = F.filter(F.concat(lead, F.flatten(F.transform("_m", told)), asks), lambda c: c["text"] != "")
    return df.withColumn(name, parts).drop("_m", "_calls", "_tools", "_user", "_answer")


def text_of(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c: c["text"]), "")


def learned_text(chunks: Column) -> Column:
    return F.array_join(F.transform(F.filter(chunks, lambda c: c["weight"] > 0), lambda c: c["text"]), "")


def per_user_turn(df: DataFrame, messages: str, place: str = "example") -> DataFrame:
    """One row for each user turn that answers follow: the chat up to the next user turn, only those answers trainable.

    For renderers that drop earlier reasoning: each answer is learned as it was given.  A message that says that it is not
    trainable stays so.  Chats without such a turn give no rows.
    """
    ends = F.filter(
        F.transform(messages, lambda m, i: F.struct(i.alias("i"), m["role"].alias("role"), F.coalesce(F.get(F.col(messages), i - 1)["role"], F.lit("")).alias("before"), F.coalesce(F.get(F.col(messages), i + 1)["role"], F.lit("user")).alias("after"))),
        lambda x: (x["after"] == "user") & (x["role"] != "user"),
    )  # the last message before each user turn, and that of the chat
    rows = df.withColumn("_e", F.explode(ends)).withColumn("_cut", F.slice(messages, F.lit(1), F.col("_e.i") + 1))
    begin = F.coalesce(F.array_max(F.transform("_cut", lambda m, i: F.when(m["role"] == "user", i).otherwise(-1))), F.lit(-1))
    rows = rows.withColumn("_begin", begin).where("_begin >= 0")
    flagged = F.transform("_cut", lambda m, i: m.withField("trainable", F.when(i < F.col("_begin"), False).otherwise(m["trainable"])))
    answers = F.exists(F.slice("_cut", F.col("_begin") + 1, F.size("_cut")), lambda m: m["role"] == "assistant")
    return rows.where(answers).withColumn(place, F.col("_e.i")).withColumn(messages, flagged).drop("_e", "_cut", "_begin")


#: Three public layouts.
RENDERERS: dict[str, Renderer] = {
    "im": Renderer(
        roles={
            "system": Around("<|im_start|>system\n", "<|im_end|>\n"), "user": Around("<|im_start|>user\n", "<|im_end|>\n"),
            "tool": Around("\n<tool_response>\n", "\n</tool_response>", "<|im_start|>user", "<|im_end|>\n"),
        },
        assistant=Around("<|im_start|>assistant\n", "<|im_end|>\n"),
        tools=("<|im_start|>system\n# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n", "\n", "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, \"arguments\": <args-json-object>}\n</tool_call><|im_end|>\n"),
        calls=("", "", "\n<tool_call>\n", "\n</tool_call>"), reasoning=("<think>\n", "\n</think>\n\n"), prompt="<|im_start|>assistant\n", aliases={"developer": "system"},
    ),
    "tags": Renderer(
        roles={"system": Around("<|system|>"), "user": Around("<|user|>"), "tool": Around("<tool_response>", "</tool_response>", "<|observation|>")},
        assistant=Around("<|assistant|>"), opening="[gMASK]<sop>", tools=("<|system|>\n# Tools\n\n<tools>\n", "\n", "\n</tools>"), tools_style="xml", calls=("", "", "<tool_call>", "</tool_call>"), calls_style="xml",
        reasoning=("<think>", "</think>"), unthought="<think></think>", dropped="</think>", trimmed=True, stops_at_head=True, stop="<|user|>", stop_calls="<|observation|>", prompt="<|assistant|><think>",
    ),
    "sections": Renderer(
        roles={"system": Around("<|system|>system<|middle|>", "<|end|>"), "user": Around("<|user|>user<|middle|>", "<|end|>"), "tool": Around("<|system|>tool<|middle|>", "<|end|>")},
        assistant=Around("<|assistant|>assistant<|middle|>", "<|end|>"), tools=("<|system|>tool_declare<|middle|># Tools\n\n## functions\nnamespace functions {\n", "\n", "\n}<|end|>"), tools_style="typed",
        calls=("<|calls|>", "<|/calls|>", "<|call|>", "<|/call|>"), calls_style="typed", reasoning=("<think>", "</think>"), unthought="<think></think>", keep="all", prompt="<|assistant|>assistant<|middle|>", aliases={"developer": "system"},
    ),
}
