"""Line-first quality rules.

Each line is judged by itself (punctuation, navigation, boilerplate, repeats); failing lines go, and
a document that loses too much text thereby, or keeps too few words, is rejected.  One pass over the
texts without a shuffle; memory is bounded by an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._common import lean, named

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»•›·"
ENDINGS = ".!?…:;\"'”’»)"
WHITE = " \t\n\x0b\x0c\r"
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|use of cookies|uses cookies|enable javascript|terms of (use|service)|privacy policy|subscribe to|sign up for|click here|log ?in to|powered by|share (this|on)|read more|skip to content|back to top)"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(BOILERPLATE)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of what a document may lose."""

    symbol_share: float = 0.1  # of a line's characters
    fragment_words: int = 5  # shorter lines must end with punctuation
    menu_words: int = 4  # for each separator of a menu line
    boilerplate_words: int = 25  # longer lines are prose whatever they mention
    lost_share: float = 0.3  # of a document's characters
    least_words: int = 50
    repeated_share: float = 0.5


def line_fails(line: str, seen: bool, rules: Rules) -> bool:
    """Whether a line with a word fails; ``seen``: an earlier line is equal to it."""
    words = WORD.findall(line)
    n, chars = len(words), sum(map(len, words))
    marks, bars, bangs = sum(map(line.count, SYMBOLS)), sum(map(line.count, SEPARATORS)), line.count("!")
    return (
        seen
        or marks > rules.symbol_share * chars
        or (bangs >= 3 and 3 * bangs > n)
        or (bars >= 2 and rules.menu_words * (bars + 1) >= n)
        or (n < rules.fragment_words and words[-1][-1] not in ENDINGS)
        or (n <= rules.boilerplate_words and TERMS.search(line) is not None)
    )


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(words) < 4:
        return 0
    table: dict[bytes, int] = {}
    codes = np.array([table.setdefault(w, len(table)) for w in words], "i8")
    n = len(table)
    pairs = codes[:-1] * n + codes[1:]
    if n >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * n + codes[2:]
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    covered = np.zeros(len(words), bool)
    for at in (order[1:][same], order[:-1][same]):
        for k in range(3):
            covered[at + k] = True
    return int(covered.sum())


def judge(text: str, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_chars, cleaned text)."""
    words = text.encode().split()  # bytes: exactly the ASCII white space
    chars = len(text) - sum(map(text.count, WHITE))
    seen: set[str] = set()
    duplicates = lost = lost_words = 0
    left = []
    for line in text.split("\n"):
        if WORD.search(line) is None:
            left.append(line)
            continue
        again = line in seen
        duplicates += again
        seen.add(line)
        if line_fails(line, again, rules):
            found = WORD.findall(line)
            lost += sum(map(len, found))
            lost_words += len(found)
        else:
            left.append(line)
    repeats = repeated_words(words)
    failed = len(words) < rules.least_words or repeats > rules.repeated_share * len(words)
    kept = not failed and lost <= rules.lost_share * chars and len(words) - lost_words >= rules.least_words
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicates, repeats, failed, kept, lost, "\n".join(left) if lost else text


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long"


def assess(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, the counts, base_failed, kept, lost_chars.

    Null texts have no words and so fail.  Rows that repeat are judged alike, null ids are kept as they
    are, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py() or "", rules)[:8] for t in batch["text"]]
            columns = zip(*found, strict=True) if found else [[]] * 8
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
            yield pa.record_batch([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *COUNTS])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(lean(run), f"doc_id long, {TYPES}")


def clean(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """Kept rows with their failing lines removed (``size_col``, if there, follows the text); all columns stay.

    Null and empty texts have no words, so their rows go; null ids stay; rows that repeat are judged alike; columns of any
    other names are left as they are; an empty table gives an empty result.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(names.index(text_col)).to_pylist()
            found = [judge(t or "", rules) for t in old]
            new = [f[8] for f in found]
            batch = batch.set_column(names.index(text_col), text_col, pa.array(new, pa.string()))
            if size_col in names:
                sizes = [n if a == b else len(b) for n, a, b in zip(batch.column(names.index(size_col)).to_pylist(), old, new, strict=True)]
                batch = batch.set_column(names.index(size_col), size_col, pa.array(sizes, batch.schema.field(names.index(size_col)).type))
            yield batch.filter(pa.array([f[6] for f in found], pa.bool_()))

    return docs.mapInArrow(lean(run, text_col), docs.schema)
