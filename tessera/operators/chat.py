"""Chat rows: conversations from long form, trailing turns, training flags, preference shapes and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_chats(turns: DataFrame, key: str, order: str, role: str = "role", content: str = "text") -> DataFrame:
    """(key, messages array<struct<role, content>>) in turn order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def strip_trailing_assistant(messages: Column) -> Column:
    """Without the run of assistant messages at the end."""
    last = F.array_max(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", 0).otherwise(i + 1)))
    return F.slice(messages, F.lit(1), F.coalesce(last, F.lit(0)))


def render(messages: Column) -> Column:
    """<|role|> and content of each message on lines of their own."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("user")), F.lit("|>\n"), F.coalesce(m["content"], F.lit("")))), "\n")


def formatted(messages: Column, formats: dict[str, tuple[str, str, bool]]) -> Column:
    """Array of (head, content, trained) by a chat format: text before and after each role's content, and whether it is trained.

    The text after a content belongs to it.  Roles without a format are an error.
    """
    pick = lambda m, k: F.coalesce(*[F.when(m["role"] == r, F.lit(f[k])) for r, f in formats.items()], F.raise_error(F.concat(F.lit("no format for "), m["role"])).cast("boolean" if k == 2 else "string"))
    return F.transform(messages, lambda m: F.struct(pick(m, 0).alias("head"), F.concat(m["content"], pick(m, 1)).alias("content"), pick(m, 2).alias("trained")))


#: Well-known chat formats, by role the text before and after a content and whether it is trained, and
#: what opens a chat.  Where a format has no system role, its text stands as a turn of the user.
FORMATS: dict[str, tuple[str, dict[str, tuple[str, str, bool]]]] = {
    "im": ("", {r: (f"<|im_start|>{r}\n", "<|im_end|>\n", r == "assistant") for r in ("system", "user", "assistant", "tool")}),
    "header": ("<|begin_of_text|>", {r: (f"<|start_header_id|>{r}<|end_header_id|>\n\n", "<|eot_id|>", r == "assistant") for r in ("system", "user", "assistant", "tool")}),
    "inst": ("<s>", {"system": ("[SYSTEM_PROMPT] ", "[/SYSTEM_PROMPT]", False), "user": ("[INST] ", "[/INST]", False), "assistant": (" ", "</s>", True)}),
    "turn": ("<bos>", {r: (f"<start_of_turn>{'model' if r == 'assistant' else 'user'}\n", "<end_of_turn>\n", r == "assistant") for r in ("system", "user", "assistant")}),
}


def chat_text(messages: Column, name: str, prompt: bool = False) -> Column:
    """A chat in a named format; with ``prompt`` the head of an answer follows unless the last message is one."""
    opening, roles = FORMATS[name]
    text = F.array_join(F.transform(formatted(messages, roles), lambda p: F.concat(p["head"], p["content"])), "")
    asks = F.when(F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] != "assistant", F.lit(True)), roles["assistant"][0]).otherwise("")
    return F.concat(F.lit(opening), text, asks) if prompt else F.concat(F.lit(opening), text)


def loss_segments(messages: Column) -> Column:
    """Array of (text, trained): each message as rendered, trained if it is the assistant's."""
    return F.transform(messages, lambda m: F.struct(F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"]).alias("text"), (m["role"] == "assistant").cast("int").alias("trained")))


def unroll(turns: DataFrame, key: str, order: str, role: str = "role", content: str = "text") -> DataFrame:
    """One row for each assistant turn: the turns up to it as context, that turn as target."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = turns.withColumn("context", F.array_join(F.collect_list(content).over(before), "\n")).withColumn("n_context", F.count(content).over(before))
    return rows.where((F.col(role) == "assistant") & (F.col("n_context") > 0)).select(key, order, "n_context", "context", F.col(content).alias("target"))


def resolve_trainable(messages: Column) -> Column:
    """Flags per message: trainable, else weight, else whether it is the assistant's; only if any message has a flag."""
    flagged = F.exists(messages, lambda m: m["trainable"].isNotNull() | m["weight"].isNotNull())
    flags = F.transform(messages, lambda m: F.coalesce(m["trainable"], m["weight"] != 0, m["role"] == "assistant"))
    return F.when(flagged, flags).otherwise(F.transform(messages, lambda m: m["role"] == "assistant"))


def preference_from_samples(samples: Column) -> Column:
    """(chosen, rejected) from scored samples: the last with score 1 and the last with score 0; null if either is missing."""
    pick = lambda v: F.try_element_at(F.filter(samples, lambda s: F.coalesce(s["evals_score"], s["score"]) == v), F.lit(-1))["text"]
    return F.when(pick(1.0).isNotNull() & pick(0.0).isNotNull(), F.struct(pick(1.0).alias("chosen"), pick(0.0).alias("rejected")))


def signed_preference(first: Column, second: Column, preference: Column) -> Column:
    """(chosen, rejected): below zero the first, above the second; null for zero or null."""
    return F.when(preference < 0, F.struct(first.alias("chosen"), second.alias("rejected"))).when(preference > 0, F.struct(second.alias("chosen"), first.alias("rejected")))


def audit(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, errors): names of the rules that a row breaks, in their order."""
    broken = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, broken.alias("errors"))


def rule_reasons(conditions: dict[str, dict[str, list]]) -> Column:
    """Reasons whose conditions (column: allowed values) all hold."""
    out = []
    for reason, wanted in conditions.items():
        every = F.lit(True)
        for column, values in wanted.items():
            every = every & F.col(column).isin(values)
        out.append(F.when(every, F.lit(reason)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())
