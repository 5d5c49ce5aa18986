"""Token arrays: shifts, masks, alignment and spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift_inputs(tokens: Column, longest: int) -> Column:
    """Tokens up to the last, cut to ``longest``."""
    return F.slice(tokens, F.lit(1), F.least(F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(longest)))


def shift_targets(tokens: Column, longest: int) -> Column:
    return F.slice(tokens, F.lit(2), F.least(F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(longest)))


def prompt_mask(tokens: Column, prompt: Column, ignore: int = -100) -> Column:
    """Labels for targets: ``ignore`` at the first prompt - 1 places."""
    return F.transform(tokens, lambda x, i: F.when(i < prompt - 1, F.lit(ignore)).otherwise(x))


def left_pad(values: Column, n: Column) -> Column:
    """n zeros before the values."""
    return F.concat(F.array_repeat(F.lit(0.0), n.cast("int")), values)


def pad_or_trim(values: Column, n: int) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), n)), 1, n)


def scatter_active(mask: Column, values: Column) -> Column:
    """Values put at the places where the mask is positive, zeros elsewhere."""
    nth = lambda i: F.size(F.filter(F.slice(mask, 1, i + 1), lambda m: m > 0))
    return F.transform(mask, lambda m, i: F.when(m > 0, F.coalesce(F.try_element_at(values, nth(i)), F.lit(0.0))).otherwise(F.lit(0.0)))


def count_trainable(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m > 0))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, n.cast("long")).otherwise(at - 1)


def last_subsequence(haystack: Column, needle: Column) -> Column:
    """Start of the needle's last occurrence, null if there is none."""
    n = F.size(haystack) - F.size(needle)
    starts = F.when((n >= 0) & (F.size(needle) > 0), F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.array_max(F.filter(starts, lambda i: F.slice(haystack, i + 1, F.size(needle)) == needle))


def span_mask(n: Column, spans: Column) -> Column:
    """1 where a position is within [start - 1, start + length - 2] of some (start, length) span."""
    hit = lambda p: F.exists(spans, lambda s: p.between(s["start"] - 1, s["start"] + s["length"] - 2))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda p: hit(p).cast("int"))


def interleave(a: Column, b: Column) -> Column:
    return F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))
