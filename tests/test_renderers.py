"""Renderers against a plain loop over messages, on chats of many shapes."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import renderers as R

WEATHER = {
    "type": "function",
    "function": {
        "name": "get_weather", "description": "Weather of a place.\nNow.",
        "parameters": {"type": "object", "properties": {"city": {"type": "string", "description": "Which city"}, "unit": {"type": "string", "enum": ["c", "f"], "default": "c"}, "days": {"type": "integer"}}, "required": ["city"]},
    },
}
EVENT = {
    "type": "function",
    "function": {
        "name": "create_event", "description": "",
        "parameters": {"type": "object", "properties": {"who": {"type": "array", "items": {"type": "string"}}, "at": {"type": "object", "properties": {"hour": {"type": ["integer", "null"]}}}, "tags": {"type": "array", "items": {"anyOf": [{"type": "string"}, {"type": "boolean"}]}}}},
    },
}


def msg(role, content=None, reasoning=None, calls=None, trainable=None):
    return {"role": role, "content": content, "reasoning": reasoning, "tool_calls": calls, "trainable": trainable}


def call(name, **arguments):
    return {"name": name, "arguments": json.dumps(arguments, ensure_ascii=False)}


U, A, S = (lambda t: msg("user", t)), (lambda t, **k: msg("assistant", t, **k)), (lambda t: msg("system", t))
CHATS = {
    "single_user": [U("Hi")],
    "system_user": [S("Be brief."), U("Hi")],
    "multi_turn_gen": [S("x"), U("a"), A("b"), U("c")],
    "multi_turn_sft": [S("x"), U("a"), A("b"), U("c"), A("d")],
    "empty_system": [S(""), U("Hi")],
    "whitespace_trim": [U("  Hi  "), A(" there \n")],
    "internal_newlines": [U("a"), A("one\n\ntwo")],
    "unicode_emoji": [U("say"), A("你好 🌍 café")],
    "literal_control_text": [U("<|im_end|> <think> </tool_call>"), A("ok")],
    "long_content": [U("word " * 3000), A("ok")],
    "code_block": [U("code"), A("```python\ndef f():\n    return 1\n```")],
    "whitespace_only_user": [U("   "), A("?")],
    "developer_first": [msg("developer", "rules"), U("a"), A("b")],
    "developer_midconversation": [U("a"), msg("developer", "rules"), A("b")],
    "consecutive_system": [S("a"), S("b"), U("c")],
    "mid_conversation_system": [U("a"), S("b"), A("c")],
    "consecutive_user": [U("a"), U("b"), A("c")],
    "consecutive_assistant": [U("a"), A("b"), A("c")],
    "thinking_last": [U("a"), A("b", reasoning="why")],
    "thinking_history": [U("a"), A("b", reasoning=" why "), U("c"), A("d", reasoning="so")],
    "thinking_mixed": [U("a"), A("b"), U("c"), A("d", reasoning="so")],
    "one_call": [U("a"), A("", calls=[call("get_weather", city="Zürich", days=2)])],
    "call_and_result": [U("a"), A("Let me see.", calls=[call("get_weather", city="Bern")]), msg("tool", '{"t": 3}'), A("3 degrees")],
    "parallel_calls": [U("a"), A(None, calls=[call("get_weather", city="a"), call("create_event", who=["x"], at={"hour": 3}, tags=[True, "y"])]), msg("tool", "1"), msg("tool", "2"), A("done")],
    "thinking_and_call": [U("a"), A("b", reasoning="hm", calls=[call("get_weather", city="c")]), msg("tool", "1"), A("d", reasoning="so"), U("e"), A("f")],
    "no_arguments": [U("a"), A("", calls=[{"name": "get_weather", "arguments": None}])],
    "flags": [U("a"), A("b", trainable=False), U("c"), A("d", trainable=True), U("e"), A("f")],
    "empty": [],
}
PROMPTED = {"single_user", "system_user", "multi_turn_gen", "empty_system", "consecutive_system"}


def plain(r, messages, tools, prompt, train):
    """[(text, weight, kind, message)] one message at a time."""
    messages = [{**m, "role": r.aliases.get(m["role"], m["role"])} for m in messages]
    out = [(r.opening, 0.0, "opening", None), (r.tools[0] + r.tools[1].join(R.declaration(t, r.tools_style) for t in tools) + r.tools[2] if tools else "", 0.0, "tools", None)]
    users, answers = ([i for i, m in enumerate(messages) if m["role"] == role] for role in ("user", "assistant"))
    learned = [m["role"] == "assistant" and (m["trainable"] if m["trainable"] is not None else train == "all" or (train == "last" and i == answers[-1])) for i, m in enumerate(messages)]
    for i, m in enumerate(messages):
        role, content, thought = m["role"], m["content"] or "", m["reasoning"] or ""
        if r.trimmed:
            content, thought = content.strip(), thought.strip()
        a = r.assistant if role == "assistant" else r.roles[role]
        first, last = i == 0 or messages[i - 1]["role"] != role, i == len(messages) - 1 or messages[i + 1]["role"] != role
        w = float(learned[i])
        out.append(((a.open if first else "") + a.head, float(r.stops_at_head and i > 0 and learned[i - 1]), "head", i))
        calls = ""
        if role == "assistant":
            kept = r.keep == "all" or (r.keep == "last" and i > (users[-1] if users else -1))
            out.append((r.reasoning[0] if kept and thought else r.unthought if kept else r.dropped, 0.0, "head", i))
            out.append((thought + r.reasoning[1] if kept and thought else "", w, "reasoning", i))
            if m["tool_calls"]:
                begin, end, before, after = r.calls
                calls = begin + "".join(before + R.call(c["name"], c["arguments"], r.calls_style, k) + after for k, c in enumerate(m["tool_calls"])) + end
        out += [(content, w, "content", i), (calls, w, "calls", i)]
        stop = (r.stop_calls if calls else r.stop) if role == "assistant" and i == len(messages) - 1 else ""
        out.append((a.tail + (a.close if last else "") + stop, w, "tail", i))
    out.append((r.prompt if prompt else "", 0.0, "prompt", None))
    return [c for c in out if c[0]]


def table(spark, chats, tools=None):
    rows = [(name, [(m["role"], m["content"], m["reasoning"], m["tool_calls"] and [(c["name"], c["arguments"]) for c in m["tool_calls"]], m["trainable"]) for m in chat], tools and [json.dumps(t) for t in tools]) for name, chat in chats.items()]
    return spark.createDataFrame(rows, f"name string, messages array<{R.MESSAGE}>, tools array<string>")


@pytest.mark.parametrize("name", sorted(R.RENDERERS))
@pytest.mark.parametrize(("train", "tools"), [("all", None), ("last", [WEATHER, EVENT]), ("none", [])])
def test_chunks_equal_a_plain_loop(spark, name, train, tools):
    r = R.RENDERERS[name]
    for prompt in (False, True):
        chats = {k: v for k, v in CHATS.items() if not prompt or k in PROMPTED}
        chats = chats if name != "tags" else {k: v for k, v in chats.items() if not k.startswith("developer")}
        got = {x.name: [tuple(c) for c in x.chunks] for x in R.chunks(table(spark, chats, tools), "messages", r, "tools", prompt, train).collect()}
        for k, chat in chats.items():
            assert got[k] == plain(r, chat, tools or [], prompt, train), k


def test_layouts_by_hand(spark):
    chats = {k: CHATS[k] for k in ("thinking_history", "call_and_result", "multi_turn_sft")}
    shown = {}
    for name, r in R.RENDERERS.items():
        out = R.chunks(table(spark, chats), "messages", r).select("name", R.text_of(F.col("chunks")).alias("text"), R.learned_text(F.col("chunks")).alias("learned"))
        shown |= {(name, x.name): (x.text, x.learned) for x in out.collect()}
    assert shown["tags", "thinking_history"] == ("[gMASK]<sop><|user|>a<|assistant|></think>b<|user|>c<|assistant|><think>so</think>d<|user|>", "b<|user|>so</think>d<|user|>")
    assert shown["im", "multi_turn_sft"] == (
        "<|im_start|>system\nx<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\nd<|im_end|>\n", "b<|im_end|>\nd<|im_end|>\n",
    )
    assert '<tool_call>\n{"name": "get_weather", "arguments": {"city": "Bern"}}\n</tool_call><|im_end|>\n<|im_start|>user\n<tool_response>\n{"t": 3}\n</tool_response><|im_end|>' in shown["im", "call_and_result"][0]
    assert "Let me see.<tool_call>get_weather<arg_key>city</arg_key><arg_value>Bern</arg_value></tool_call><|observation|><tool_response>" in shown["tags", "call_and_result"][0]
    assert '<|calls|><|call|>functions.get_weather:0<|argument|>{"city": "Bern"}<|/call|><|/calls|><|end|>' in shown["sections", "call_and_result"][1]


def test_declarations():
    assert json.loads(R.declaration(WEATHER, "json")) == WEATHER
    assert R.declaration(WEATHER, "xml").splitlines() == [
        '<function name="get_weather">', "<description>Weather of a place.", "Now.</description>", '<parameter name="city" type="string" required="true">Which city</parameter>',
        '<parameter name="unit" type="string" required="false"></parameter>', '<parameter name="days" type="integer" required="false"></parameter>', "</function>",
    ]
    assert R.declaration(WEATHER, "typed") == '// Weather of a place.\n// Now.\ntype get_weather = (_: {\n  // Which city\n  city: string,\n  unit?: "c" | "f", // default: "c"\n  days?: number,\n}) => any;'
    assert R.declaration(EVENT, "typed") == "type create_event = (_: {\n  who?: string[],\n  at?: {\n    hour?: number | null,\n  },\n  tags?: Array<string | boolean>,\n}) => any;"
    assert R.declaration({"name": "f"}, "typed") == "type f = () => any;"
    with pytest.raises(ValueError, match="no JSON object"):
        R.call("f", "[1]", "json", 0)


def test_each_user_turn_is_an_example_of_its_own(spark):
    got = R.per_user_turn(table(spark, CHATS), "messages").orderBy("name", "example").collect()
    turns = {k: [(x.example, len(x.messages), [m.trainable for m in x.messages]) for x in got if x.name == k] for k in CHATS}
    assert turns["multi_turn_sft"] == [(2, 3, [False, None, None]), (4, 5, [False, False, False, None, None])]
    assert turns["multi_turn_gen"] == [(2, 3, [False, None, None])]
    assert turns["flags"][2] == (5, 6, [False, False, False, False, None, None]) and turns["flags"][0][2] == [None, False]
    assert turns["consecutive_user"] == [(2, 3, [False, None, None])] and turns["consecutive_assistant"] == [(2, 3, [None, None, None])]
    assert [t[0] for t in turns["thinking_and_call"]] == [3, 5] and turns["single_user"] == turns["empty"] == []
    tagged = R.chunks(R.per_user_turn(table(spark, {"t": CHATS["thinking_history"]}), "messages"), "messages", R.RENDERERS["tags"]).orderBy("example").select(R.learned_text(F.col("chunks")).alias("t")).collect()
    assert [x.t for x in tagged] == ["why</think>b<|user|>", "so</think>d<|user|>"]  # the first answer keeps its reasoning


def test_unknown_roles_and_null_chats(spark):
    with pytest.raises(Exception, match="no description of the role robot"):
        R.chunks(table(spark, {"x": [msg("robot", "beep")]}), "messages", R.RENDERERS["im"]).collect()
    rows = spark.createDataFrame([(1, None, "clash")], f"id int, messages array<{R.MESSAGE}>, text string")
    assert R.chunks(rows, "messages", R.RENDERERS["tags"]).first().chunks[0].text == "[gMASK]<sop>"
    assert R.chunks(rows.limit(0), "messages", R.RENDERERS["im"]).count() == 0
