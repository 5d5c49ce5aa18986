"""Packing token sequences with minimum bin slack.

A document's ids are cut at multiples of the capacity; full pieces are windows by themselves.  The
rest are dealt into groups of about ``group_pieces``, and each group fills window after window: its
longest remaining piece opens a window, a subset-sum bitset over the remaining length counts finds
the sum closest to what is left of the capacity, and the counts taken are backtracked through the
bitset's layers.  Windows that a group could not fill go through the same step once more together.
Only (id, start, length, checksum) rows are shuffled, never ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed, id_and_text, lean
from tessera.llm._items import library_items, once, slices

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, its end id included."""
    end = np.array([end_id], "<u4")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = once(library_items, tokenizer_path, False)
        for batch in batches:
            for rows in slices(batch["text"]):
                ids, offsets = items.ids(batch["text"][rows])
                out: list[tuple] = []
                for doc_id, a, b in zip(batch["doc_id"][rows].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    whole = np.concatenate([ids[a:b], end])
                    for start in range(0, len(whole), capacity):
                        piece = whole[start : start + capacity]
                        out.append((doc_id, start, len(piece), zlib.crc32(piece), len(whole)))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(lean(cut), PIECE)


def best_subset(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length to take for the sum closest to room from below.

    ``lengths`` are the keys of counts in ascending order.  Bit s of the bitset says that sum s can be
    made of the layers so far; a layer is a power of two (or the rest) of one length's count.
    """
    reach, mask, layers = 1, (1 << (room + 1)) - 1, []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length, left, step = lengths[i], min(counts[lengths[i]], room // lengths[i]), 1
        while left:
            times = min(step, left)
            layers.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left, step = left - times, step * 2
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, times, before in reversed(layers):
        if not before >> total & 1:
            taken[length] += times
            total -= length * times
    return taken


def fill_windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Minimum-bin-slack windows over a multiset of lengths (each from 1 to capacity)."""
    counts: dict[int, int] = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    order, windows = sorted(counts), []
    while order:
        longest = order[-1]
        counts[longest] -= 1
        taken = best_subset(counts, order, capacity - longest)
        window = [longest, *(n for n, times in taken.items() for _ in range(times))]
        for n, times in taken.items():
            counts[n] -= times
        order = [n for n in order if counts[n]] if any(not counts[n] for n in window) else order
        windows.append(window)
    return windows


def pack_groups(pieces: DataFrame, groups: int, base: int, capacity: int) -> DataFrame:
    """pieces with sequence_id and offset; sequence ids are unique over groups numbered from ``base``."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select([n.split()[0] for n in PIECE.split(", ")]).combine_chunks()
        rows = rows.sort_by([(n, "ascending") for n in ("length", "doc_id", "start", "ids_crc32")])
        lengths = rows["length"].to_numpy()
        of_length = {n: list(range(*np.searchsorted(lengths, [n, n + 1]))) for n in np.unique(lengths).tolist()}
        sequence, offset = np.zeros(len(rows), "i8"), np.zeros(len(rows), "i8")
        for k, window in enumerate(fill_windows(lengths.tolist(), capacity)):
            filled = 0
            for n in window:
                at = of_length[n].pop()
                sequence[at], offset[at] = ((base + key[0].as_py()) << 24) + k, filled
                filled += n
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # by the place in the (written) table too: rows that repeat don't all meet in one group
    dealt = pieces.withColumn("_place", F.monotonically_increasing_id()).withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_place"), F.lit(groups))).drop("_place")
    return dealt.groupBy("_group").applyInArrow(pack, PIECE + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, group_pieces: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone.  Rows that repeat are packed apart, ties in length go by
    id and start, an empty table gives no rows.  A group's memory is that of its pieces' lengths.
    """
    pieces = checkpointed(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col))
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    first = checkpointed(pack_groups(pieces, groups, 0, capacity))
    if groups == 1:
        return first
    filled = first.groupBy("sequence_id").agg(F.sum("length").alias("_used"))
    open_ones = filled.where(F.col("_used") < capacity - capacity // 64).select("sequence_id")
    loose = checkpointed(first.join(open_ones, "sequence_id", "left_semi"))
    again = max(1, -(-loose.count() // group_pieces))
    kept = first.join(open_ones, "sequence_id", "left_anti")
    return kept.unionByName(pack_groups(loose.drop("sequence_id", "offset"), again, groups, capacity))
