"""Rewards and parsed verdicts: number answers, equations, result sets, judge replies and JSON leaves."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import answer_tag_first, answer_tag_last, boxed, collapse, first_match, last_match

NUMBER = r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"
CONCLUSIONS = (r"[Tt]herefore", r"[Ss]o", r"[Tt]hus", r"[Ii]n total", r"[Aa]ltogether")
STATEMENTS = (r"[Tt]he answer is\s+", r"[Aa]nswer:\s*", r"[Ff]inal answer:\s*")


def bare_number(text: Column) -> Column:
    """Without thousands separators and the zeros after a decimal point."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)


def number_cascade(text: Column) -> Column:
    """A number from result tags, else answer tags, else a box, else the last number of at least 1, else a conclusion,
    else a stated answer, else the last three sentences."""
    numbers = lambda t: F.regexp_extract_all(t, F.lit(rf"\b{NUMBER}\b"), F.lit(1))
    inside = lambda t: first_match(t, NUMBER)
    large = F.filter(numbers(text), lambda n: F.replace(n, F.lit(","), F.lit("")).cast("double") >= 1)
    tail = F.reverse(F.slice(F.split(text, r"\."), F.greatest(F.lit(1), F.size(F.split(text, r"\.")) - 2), 3))
    return bare_number(
        F.coalesce(
            inside(first_match(text, r"(?s)\[RESULT\](.*?)\[/RESULT\]")),
            inside(first_match(text, r"(?is)<answer>\s*(.*?)\s*</answer>")),
            inside(first_match(text, r"\\boxed\{([^}]+)\}")),
            F.try_element_at(large, F.lit(-1)),
            *[last_match(text, rf"{p},?\s+.*?{NUMBER}") for p in CONCLUSIONS],
            *[first_match(text, rf"{p}{NUMBER}") for p in STATEMENTS],
            F.try_element_at(F.filter(F.transform(tail, lambda s: F.try_element_at(numbers(s), F.lit(-1))), lambda n: n.isNotNull()), F.lit(1)),
        )
    )


def boxed_or_last_number(text: Column) -> Column:
    """The last box without inner braces, else the last signed number, else the whole text; trimmed."""
    return F.trim(F.coalesce(last_match(text, r"\\boxed\{([^{}]+)\}"), last_match(text, r"([-+]?[0-9]+(?:\.[0-9]+)?)"), text, F.lit("")))


def comparable_answer(text: Column) -> Column:
    """Numbers in one spelling; other texts lower-cased with single spaces."""
    value = F.trim(F.coalesce(text, F.lit("")))
    shown = value.try_cast("double").cast("decimal(38,12)").cast("string")
    return F.coalesce(F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", ""), F.regexp_replace(F.lower(value), r"\s+", " "))


def binary_reward(found: Column, expected: Column) -> Column:
    return F.coalesce((found == expected).cast("double"), F.lit(0.0))


def _value(text: str | None) -> float | None:
    """Value of an arithmetic text of digits, + - * / and parentheses; None where it isn't one."""
    if text is None or not re.fullmatch(r"[0-9+\-*/(). ]+", text) or "**" in (bare := text.replace(" ", "")) or "//" in bare:
        return None
    parts, at = re.findall(r"[0-9]+\.?[0-9]*|\.[0-9]+|[-+*/()]", bare), 0
    if "".join(parts) != bare:
        return None

    def atom() -> float:
        nonlocal at
        part, at = parts[at], at + 1
        if part in "+-":
            return atom() if part == "+" else -atom()
        if part == "(":
            inner = total()
            if parts[at] != ")":
                raise ValueError(bare)
            at += 1
            return inner
        if re.fullmatch("0[0-9]+", part) and set(part) != {"0"}:
            raise ValueError(part)
        return float(part)

    def product() -> float:
        nonlocal at
        out = atom()
        while at < len(parts) and parts[at] in "*/":
            sign, at = parts[at], at + 1
            out = out * atom() if sign == "*" else out / atom()
        return out

    def total() -> float:
        nonlocal at
        out = product()
        while at < len(parts) and parts[at] in "+-":
            sign, at = parts[at], at + 1
            out = out + product() if sign == "+" else out - product()
        return out

    try:
        out = total()
        return out if at == len(parts) else None
    except (ValueError, IndexError, ZeroDivisionError, RecursionError, OverflowError):
        return None


def equation_value(text: Column) -> Column:
    """Value of an arithmetic text, null where it isn't one; built-ins can't evaluate nested parentheses."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_value(t) for t in batch], dtype="float64")

    found = run(text)
    return F.when(~F.isnan(found), found)


def countdown_rewards(text: Column, numbers: Column, target: Column) -> Column:
    """(format, composite): 1 for think and answer tags, 0.5 for an answer; 0.1 answer + 0.2 numbers + 0.7 value."""
    equation = answer_tag_last(text)
    used = F.array_sort(F.transform(F.regexp_extract_all(equation, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long")))
    exact = used == F.array_sort(F.transform(numbers, lambda x: x.cast("long")))
    hit = exact & (F.abs(equation_value(equation) - target) < 1e-6)
    form = F.when(equation.isNull(), 0.0).when(F.regexp_like(text, F.lit("(?i)<think>")), 1.0).otherwise(0.5)
    score = F.when(equation.isNull(), 0.0).otherwise(0.1 + F.when(exact, 0.2).otherwise(0.0) + F.when(hit, 0.7).otherwise(0.0))
    return F.struct(form.alias("format"), score.alias("composite"))


def six_digits(x: Column) -> Column:
    """A number as text with six significant digits and no zeros at the end."""
    shown = F.format_string("%.5e", F.round(x, 6)).cast("decimal(38,12)").cast("string")
    return F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", "")


def result_rows(payload: Column, marker: str = "[[ROWS]]") -> Column:
    """Rows after the last marker as one text each, cells in one spelling; null where there is no JSON array of arrays."""
    tail = F.when(F.contains(payload, F.lit(marker)), F.trim(F.substring_index(payload, marker, -1)))
    rows = F.try_variant_get(F.try_parse_json(tail), "$", "array<array<variant>>")

    def cell(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        number = F.try_variant_get(v, "$", "double")
        return F.when(F.is_variant_null(v), "NULL").when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string"))).when(kind == "STRING", F.trim(F.try_variant_get(v, "$", "string"))).otherwise(six_digits(number))

    return F.transform(rows, lambda r: F.array_join(F.transform(r, cell), "\x1f"))


def json_object(text: Column) -> Column:
    """A reply's JSON object without the code fence around it, null if it is none."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    return F.when(F.schema_of_variant(F.try_parse_json(bare)).startswith("OBJECT"), bare)


def judge_verdict(text: Column) -> Column:
    """(explanation, criteria_met) of a judge's reply; null unless both are there with their types."""
    reply = F.try_parse_json(json_object(text))
    met, why = F.try_variant_get(reply, "$.criteria_met", "variant"), F.try_variant_get(reply, "$.explanation", "variant")
    fine = (F.schema_of_variant(met) == "BOOLEAN") & (F.schema_of_variant(why) == "STRING")
    return F.when(fine, F.struct(F.try_variant_get(why, "$", "string").alias("explanation"), F.try_variant_get(met, "$", "boolean").alias("criteria_met")))


def judge_verdicts(text: Column, n: Column) -> Column:
    """Pass flags of verdicts 1 to n in order; null unless each index is there once with a boolean."""
    rows = F.try_variant_get(F.try_parse_json(json_object(text)), "$.verdicts", "array<struct<index:long,pass:variant>>")
    flat = F.array_sort(F.transform(rows, lambda r: F.struct(r["index"].alias("i"), F.when(F.schema_of_variant(r["pass"]) == "BOOLEAN", F.try_variant_get(r["pass"], "$", "boolean")).alias("p"))))
    whole = (F.transform(flat, lambda r: r["i"]) == F.sequence(F.lit(1).cast("long"), n.cast("long"))) & ~F.exists(flat, lambda r: r["p"].isNull())
    return F.when(whole, F.transform(flat, lambda r: r["p"]))


def _leaves(text: str | None) -> list[str] | None:
    try:
        todo, out = [("None", json.loads(text or ""))], set()
    except (ValueError, RecursionError):
        return None
    while todo:
        key, value = todo.pop()
        if isinstance(value, dict):
            todo += value.items()
        elif isinstance(value, list):
            todo += [(key, v) for v in value]
        elif value is not None and str(value).strip():
            out.add(f"{key}\x1f{re.sub(r'[,\s$]', '', str(value).lower().strip())}")
    return sorted(out)


def leaf_pairs(text: Column) -> Column:
    """Distinct (leaf key, value) texts of a JSON text, whatever its depth; null for other texts."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_leaves(t) for t in batch], dtype="object")

    return run(text)


def set_f1(found: Column, gold: Column) -> Column:
    """F1 of two sets; 0 for no set at all; an empty gold set wants an empty one."""
    common, n, m = F.size(F.array_intersect(found, gold)).cast("double"), F.size(found), F.size(gold)
    return F.when(found.isNull(), 0.0).when(m == 0, F.when(n == 0, 1.0).otherwise(0.0)).when(common == 0, 0.0).otherwise(2 * common / (n + m))


def tagged_match(text: Column, truth: Column) -> Column:
    """Whether an answer tag and a think tag are there and the answer equals the truth."""
    return F.regexp_like(text, F.lit(r"(?is)<think>.*</think>")) & (collapse(answer_tag_last(text)) == collapse(truth))


def first_answer_reward(text: Column, truth: Column) -> Column:
    return binary_reward(F.coalesce(answer_tag_first(text), boxed(text)), truth)
