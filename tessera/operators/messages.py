"""Chat messages of mixed shapes (VARIANT) to one shape, and rows that carry rubrics or several chats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.chat import strip_trailing_assistant


def text_at(v: Column, path: str) -> Column:
    """The string at a path, null for other kinds."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def part(kind: str | Column, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), value.alias("value"))


def content_parts(content: Column) -> Column:
    """Array of (type, value): a string is one text part, an object one part, an array many; images by URL."""
    kind = F.schema_of_variant(content)

    def one(p: Column) -> Column:
        image = F.coalesce(text_at(p, "$.image"), text_at(p, "$.image_url"), text_at(p, "$.image_url.url"))
        plain = F.coalesce(F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), text_at(p, "$.text"), F.lit(""))
        return F.when(image.isNotNull(), part("image", image)).otherwise(part(F.coalesce(text_at(p, "$.type"), F.lit("text")), plain))

    none = F.array().cast("array<struct<type:string,value:string>>")
    many = F.try_variant_get(content, "$", "array<variant>")
    return F.when(content.isNull() | F.is_variant_null(content), none).when(kind.startswith("ARRAY"), F.transform(many, one)).otherwise(F.array(one(content)))


def tool_calls(calls: Column) -> Column:
    """Array of (name, arguments JSON, id) from {name, args} or {function: {name, arguments}}; null names mark unknown shapes."""

    def one(c: Column) -> Column:
        raw = F.try_variant_get(c, "$.function.arguments", "variant")
        spelled = F.when(F.schema_of_variant(raw) == "STRING", F.to_json(F.try_parse_json(F.coalesce(F.nullif(F.try_variant_get(raw, "$", "string"), F.lit("")), F.lit("{}"))))).otherwise(F.to_json(raw))
        args = F.coalesce(F.to_json(F.try_variant_get(c, "$.args", "variant")), spelled, F.lit("{}"))
        return F.struct(F.coalesce(text_at(c, "$.name"), text_at(c, "$.function.name")).alias("name"), args.alias("arguments"), text_at(c, "$.id").alias("id"))

    return F.transform(F.try_variant_get(calls, "$", "array<variant>"), one)


def normalize_messages(messages: Column) -> Column:
    """Array of (role, parts, tool_calls, trainable) from a VARIANT array of chat messages.

    Thinking comes first as a part of its own: thinking, else non-empty reasoning, else non-empty
    reasoning_content.  ``trainable`` is null unless some message has a flag (trainable or weight).
    A message without a string role makes the row null.
    """
    rows = F.try_variant_get(messages, "$", "array<variant>")
    flag = lambda m: F.coalesce(F.try_variant_get(m, "$.trainable", "boolean"), F.try_variant_get(m, "$.weight", "int") != 0)
    flagged = F.exists(rows, lambda m: flag(m).isNotNull())

    def one(m: Column) -> Column:
        thought = F.coalesce(text_at(m, "$.thinking"), F.nullif(text_at(m, "$.reasoning"), F.lit("")), F.nullif(text_at(m, "$.reasoning_content"), F.lit("")))
        parts = content_parts(F.try_variant_get(m, "$.content", "variant"))
        role = text_at(m, "$.role")
        return F.struct(
            role.alias("role"),
            F.when(thought.isNotNull(), F.concat(F.array(part("thinking", thought)), parts)).otherwise(parts).alias("parts"),
            tool_calls(F.try_variant_get(m, "$.tool_calls", "variant")).alias("tool_calls"),
            F.when(flagged, F.coalesce(flag(m), role == "assistant")).alias("trainable"),
        )

    return F.when(~F.exists(rows, lambda m: text_at(m, "$.role").isNull()), F.transform(rows, one))


def extract_text(text: Column, messages: Column) -> Column:
    """The text if there is one, else the messages as <|role|> lines, else empty."""
    lines = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("user")), F.lit("|>\n"), F.coalesce(m["content"], F.lit("")))), "\n")
    return F.coalesce(F.nullif(text, F.lit("")), lines, F.lit(""))


def teacher_messages(*choices: Column) -> Column:
    """The first non-empty of the choices without its trailing assistant turns."""
    return strip_trailing_assistant(F.coalesce(*[F.when(F.size(c) > 0, c) for c in choices]))


def mustache(pattern: str) -> Column:
    """``{{ name }}`` parts of a template replaced by columns, when the plan is made; nulls print as empty."""
    import re

    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", pattern)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def rubric_row(record: Column) -> Column:
    """(row, errors) of a nested benchmark record: only allowed fields stay; a broken record has errors and no row."""
    turns = F.try_variant_get(record, "$.conversation.messages", "array<struct<role:string,content:string>>")
    items = F.try_variant_get(record, "$.rubric_items", "array<struct<criterion_text:string,points:double>>")
    key = text_at(record, "$.id")
    rules = {
        "id": F.coalesce(key, F.lit("")) == "",
        "conversation": turns.isNull() | (F.size(turns) == 0) | F.exists(turns, lambda m: m["role"].isNull() | m["content"].isNull()),
        "rubric": items.isNull() | (F.size(items) == 0) | F.exists(items, lambda i: F.coalesce(i["criterion_text"], F.lit("")).eqNullSafe(F.lit("")) | i["points"].isNull()),
    }
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    fields = F.struct(key.alias("id"), turns.alias("messages"), items.alias("rubric_items"), text_at(record, "$.use_case").alias("use_case"), text_at(record, "$.difficulty").alias("difficulty"))
    return F.struct(F.when(F.size(errors) == 0, fields).alias("row"), errors.alias("errors"))


def question_documents(blob: Column) -> Column:
    """(query, answer, documents) of a text with 'Question:', 'Answer:' and 'Document:' lines; null if a prefix is missing."""
    m = lambda p: F.when(F.regexp_like(blob, F.lit(p)), F.trim(F.regexp_extract(blob, p, 1)))
    query, answer = m(r"(?s)^Question:(.*?)\nAnswer:"), m(r"(?s)\nAnswer:(.*?)\nDocument:")
    docs = F.transform(F.slice(F.split(blob, "\nDocument:"), F.lit(2), F.greatest(F.size(F.split(blob, "\nDocument:")) - 1, F.lit(0))), lambda x: F.trim(x))
    return F.when(query.isNotNull() & answer.isNotNull(), F.struct(query.alias("query"), answer.alias("answer"), docs.alias("documents")))
