"""Equal windows of a text by a blockwise suffix array over a difference cover.

The suffixes that start windows are sorted one bucket of leading bytes at a time, by their first
bytes only.  Suffixes that stay tied over the cover's period are ordered by ranks of sample positions
that were computed once: for any two positions the cover has a shift below the period after which both
are sampled.  So beside the text and the sample's ranks only one bucket's keys are held.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set; each nonzero difference modulo the period occurs once.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
BUCKET = 1 << 18
PAD = 128

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: SHIFT[a, b]: the least shift after which positions of residues a and b are both sampled.
SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)], "i8")


def leading_words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number that orders like the bytes; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(PAD + 8, "u1")])
    words = np.lib.stride_tricks.as_strided(padded, (len(text) + PAD, 8), (1, 1))
    return words.copy().view(">u8").ravel().astype("u8")


def refine(words: np.ndarray, at: np.ndarray, shifts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by the words at the shifts, and where a group of equal ones begins."""
    order = np.argsort(words[at + shifts[0]])
    at = at[order]
    key = words[at + shifts[0]]
    begins = np.concatenate([[True], key[1:] != key[:-1]]) if len(at) else np.zeros(0, bool)
    for shift in shifts[1:]:
        tied = ~begins
        tied[:-1] |= ~begins[1:]
        open_at = np.flatnonzero(tied)
        if not len(open_at):
            break
        group = np.cumsum(begins)[open_at]
        key = words[at[open_at] + shift]
        order = np.lexsort((key, group))
        at[open_at], key = at[open_at[order]], key[order]
        begins[open_at[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
    return at, begins


def sample_ranks(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the sampled positions below n by their first ``depth`` bytes; 0 elsewhere."""
    at = np.flatnonzero(np.tile(_IN_COVER, n // PERIOD + 1)[:n])
    ranks = np.zeros(n + PAD, "i4")
    at, begins = refine(words, at, [*range(0, depth - 8, 8), depth - 8])
    ranks[at] = np.cumsum(begins)
    return ranks


def split_ties(at: np.ndarray, begins: np.ndarray, ranks: np.ndarray) -> None:
    """Order groups of tied positions in place by comparing each with its group's first by sample ranks.

    Positions whose ranks equal their pivot's stay one group.
    """
    done = np.zeros(len(at), bool)
    while True:
        tied = ~begins
        tied[:-1] |= ~begins[1:]
        open_at = np.flatnonzero(tied & ~done)
        if not len(open_at):
            return
        group = np.cumsum(begins)[open_at]
        heads = np.concatenate([[True], group[1:] != group[:-1]])
        own = at[open_at]
        pivot = own[heads][np.cumsum(heads) - 1]
        shift = SHIFT[pivot % PERIOD, own % PERIOD]
        side = np.sign(ranks[own + shift].astype("i8") - ranks[pivot + shift])
        order = np.lexsort((side, group))
        at[open_at], side = own[order], side[order]
        begins[open_at[1:]] |= (group[1:] == group[:-1]) & (side[1:] != side[:-1])
        done[open_at] = side == 0


def windows_of_others(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, depth: int) -> np.ndarray:
    """For each window text[start : start + depth], whether an equal one has a smaller owner."""
    words = leading_words(text)
    ranks = sample_ranks(words, len(text), depth)
    first = (words[starts] >> np.uint64(48)).astype("u2")
    by_first = np.argsort(first, kind="stable")
    ends = np.flatnonzero(np.diff(first[by_first], append=np.uint16(0)) != 0) + 1 if len(starts) else np.zeros(0, "i8")
    ends = np.unique(np.append(ends, len(starts)))
    out, begin = np.zeros(len(starts), bool), 0
    where = np.zeros(len(text) + 1, "i8")
    where[starts] = np.arange(len(starts))
    while begin < len(starts):
        end = int(ends[max(np.searchsorted(ends, begin + BUCKET, "right") - 1, np.searchsorted(ends, begin, "right"))])
        at, begins = refine(words, starts[by_first[begin:end]], [0, 8, 16, 24])
        over_period = begins.copy()
        split_ties(at, begins, ranks)
        # ranks look further than the window: neighbours that differ only beyond it are equal
        apart = np.flatnonzero(begins & ~over_period)
        for shift in (32, 40, depth - 8):
            apart = apart[words[at[apart] + shift] == words[at[apart - 1] + shift]]
        begins[apart] = False
        rows = where[at]
        heads = np.flatnonzero(begins)
        least = np.minimum.reduceat(owner[rows], heads)
        out[rows] = owner[rows] > least[np.cumsum(begins) - 1]
        begin = end
    return out
