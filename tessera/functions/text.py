"""Answers, rewards and text scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the pattern's first match, null if there is none."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def answer_tag_first(text: Column) -> Column:
    """The first integer inside the first answer tag."""
    return first_match(first_match(text, r"(?is)<answer>(.*?)</answer>"), r"(-?[0-9]+)")


def answer_tag_last(text: Column) -> Column:
    return F.trim(last_match(text, r"(?is)<answer>(.*?)</answer>"))


def boxed(text: Column) -> Column:
    r"""Content of the last \boxed{...} with matching braces; null where they don't match.

    The characters after the last opening are folded with their brace depth.
    """
    at = F.length(text) - F.length(F.substring_index(text, "\\boxed{", -1))
    rest = F.when(F.instr(text, "\\boxed{") > 0, F.substring(text, at + 1, F.length(text)))
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("kept"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(acc["depth"] == 0, 0).when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when((acc["depth"] > 0) & (depth > 0), F.concat(acc["kept"], c)).otherwise(acc["kept"]).alias("kept"))

    folded = F.aggregate(F.split(rest, ""), start, step)
    return F.when(folded["depth"] == 0, folded["kept"])


def gsm8k_number(text: Column) -> Column:
    return F.replace(first_match(text, r"#### *(-?[0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(","), F.lit(""))


def answer_cascade(text: Column) -> Column:
    """Boxed, else answer tag, else what follows **Answer:**."""
    return F.coalesce(boxed(text), answer_tag_last(text), F.trim(first_match(text, r"\*\*Answer:\*\* *([^\n]*)")))


def final_answer_line(text: Column) -> Column:
    """What follows 'Final:' if the last line with text starts so."""
    line = F.try_element_at(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), F.lit(-1))
    return F.trim(first_match(F.trim(line), r"^Final: *(.*)$"))


def mcq_letter(text: Column) -> Column:
    """The letter after 'ANSWER:' on the last lines."""
    lines = F.split(F.trim(text), "\n")
    return last_match(F.upper(F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 2), 3), "\n")), r"ANSWER: *([A-D])")


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def normalize_answer(text: Column) -> Column:
    """White space collapsed, dots at the end gone."""
    return F.regexp_replace(collapse(text), r"\.+$", "")


def expected_answer(*columns: Column) -> Column:
    return F.nullif(normalize_answer(F.coalesce(*columns)), F.lit(""))


def squad_normalize(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))


def word_tokens(text: Column) -> Column:
    """Unicode words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def latex_normalize(text: Column) -> Column:
    r"""\text{x} to x, \dfrac and \tfrac to \frac, no \left, \right, spaces or dollar signs."""
    for pattern, new in ((r"\\text\{([^{}]*)\}", "$1"), (r"\\[dt]frac", r"\\frac"), (r"\\(?:left|right)", ""), (r"[$\s]", "")):
        text = F.regexp_replace(text, pattern, new)
    return text


def number(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def numeric_match(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.coalesce(F.abs(number(a) - number(b)) < eps, F.lit(False))


def exact_match(a: Column, b: Column) -> Column:
    """Equality without <think> parts, case and white space differences."""
    clean = lambda c: collapse(F.lower(F.regexp_replace(c, r"(?s)<think>.*?</think>", "")))
    return clean(a) == clean(b)


def counts(words: Column) -> Column:
    """Map from word to its number in an array."""
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.size(F.filter(words, lambda x: x == w)))))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays: the k-th repeat of a word matches the k-th of the other."""
    nth = lambda xs: F.transform(xs, lambda x, i: F.struct(x.alias("w"), F.size(F.filter(F.slice(xs, 1, i + 1), lambda y: y == x)).alias("k")))
    return F.size(F.array_intersect(nth(a), nth(b)))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of multiset overlap; two empty sides agree, one empty side scores 0."""
    common, n, m = overlap(pred, gold).cast("double"), F.size(pred), F.size(gold)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(2 * common / (n + m))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Least over greatest multiplicities; two empty sides give 1."""
    common, n, m = overlap(a, b), F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), 1.0).otherwise(common / (n + m - common))


def currency(text: Column) -> Column:
    """A number from money text; one comma with two digits after it is a decimal comma."""
    bare = F.regexp_replace(text, r"[^0-9,.-]", "")
    return F.when(F.regexp_like(bare, F.lit(r"^-?[0-9]+,[0-9]{2}$")), F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit(""))).try_cast("double")


def parse_date(text: Column, *formats: str) -> Column:
    """The date by the first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def wiki_title(url: Column) -> Column:
    return F.replace(F.try_url_decode(first_match(url, r"/wiki/([^?#]+)")), F.lit("_"), F.lit(" "))


def html_text(html: Column) -> Column:
    """Text of a page: no scripts, styles or tags, a few entities decoded, single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(c))
    return collapse(bare)


def template(pattern: str) -> Column:
    """``{name}`` parts of a format string replaced by columns, when the plan is made."""
    import string

    return F.concat(*[p for literal, field, _, _ in string.Formatter().parse(pattern) for p in ([F.lit(literal)] if literal else []) + ([F.col(field).cast("string")] if field else [])])


def word_chunks(text: Column, size: int = 256) -> Column:
    """Array of chunks of ``size`` words."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    starts = lambda ws: F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    # the words are a lambda's variable: a text is split once, not once for each chunk
    return F.get(F.transform(F.array(words), lambda ws: F.transform(starts(ws), lambda i: F.array_join(F.slice(ws, i + 1, size), " "))), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts after sentence ends, trimmed, none empty; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def article_blocks(text: Column, least: int = 120, longest: int = 1200, most: int = 5) -> Column:
    """Lines that are no headers and long enough, cut to a length, the first few."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda p: (F.length(p) >= least) & ~p.startswith("="))
    return F.slice(F.transform(lines, lambda p: F.substring(p, 1, longest)), 1, most)


def tool_call(text: Column) -> Column:
    """(name, arguments) of the first tool call in JSON or tag form."""
    body = F.coalesce(first_match(text, r"(?s)<tool_call>(.*?)</tool_call>"), first_match(text, r'(?s)(\{.*"name".*\})'))
    return F.struct(F.get_json_object(body, "$.name").alias("name"), F.get_json_object(body, "$.arguments").alias("arguments"))


def json_between_braces(text: Column) -> Column:
    """The part from the first { to the last }, null unless it is JSON."""
    part = first_match(text, r"(?s)(\{.*\})")
    return F.when(F.try_parse_json(part).isNotNull(), part)
