"""Segmented scans: what a row gets depends on all rows of its key before it, however many there are.

Rows are range-partitioned by key and order, so that a long key lies in several partitions.  A first pass sums each
partition up as a map from the state before it to the state after it; the maps, one for each shuffle partition, are
composed in order; a second pass applies them.  No task holds a key, only Arrow batches in turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.scratch import checkpointed


def in_runs(df: DataFrame, *order: Column | str) -> DataFrame:
    """df split by ranges of the order, sorted, with ``_part``, the range's number.

    Ranges come from a sample and must not be drawn again, so they are written; a partition of what is read back
    is one range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def with_begins(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that have rows, and where another key begins (never at a partition's first row)."""
    last: Any = None
    for k, batch in enumerate(b for b in batches if len(b)):
        codes = batch[key].dictionary_encode(null_encoding="encode").indices.to_numpy()
        begins = np.concatenate([[k > 0 and batch[key][0].as_py() != last], codes[1:] != codes[:-1]])
        last = batch[key][len(batch) - 1].as_py()
        yield batch, begins


def scanned(runs: DataFrame, key: str, new: Callable[[], Any], added: Callable[[Any, pa.RecordBatch, np.ndarray], Any], state: Callable[[Any, Any], Any], apply: Callable[[Any, pa.RecordBatch, np.ndarray], tuple[pa.RecordBatch, Any]], schema: T.StructType) -> DataFrame:
    """The two passes over in_runs(...).

    ``new()`` is the map of no rows; ``added(map, batch, begins)`` the map with a batch more, as plain lists and numbers;
    ``state(map, before)`` the state after it; ``apply(before, batch, begins)`` gives a batch's rows and the state after
    it.  The state before the first row of a key is None.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, first, last, part = new(), None, None, None
        for batch, begins in with_begins(batches, key):
            first = batch[key].slice(0, 1) if part is None else first
            part, last = batch["_part"][0].as_py(), batch[key].slice(len(batch) - 1)
            whole = added(whole, batch, begins)
        if part is not None:
            yield pa.record_batch([pa.array([part], pa.int32()), first, last, pa.array([whole], pa.list_(pa.list_(pa.float64())))], names=["part", "first", "last", "map"])

    kind = runs.schema[key].dataType.simpleString()
    maps = runs.mapInArrow(summarise, f"part int, first {kind}, last {kind}, map array<array<double>>").collect()  # one row a shuffle partition
    before: dict[int, Any] = {}
    key_before, now = object(), None
    for r in sorted(maps, key=lambda r: r.part):
        before[r.part] = now if r.first == key_before else None
        key_before, now = r.last, state(r.map, before[r.part])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh = None, True
        for batch, begins in with_begins(batches, key):
            now, fresh = before[batch["_part"][0].as_py()] if fresh else now, False
            out, now = apply(now, batch, begins)
            yield out

    return runs.mapInArrow(put, schema)


def folded(a: list[float], b: list[float], y: float) -> list[float]:
    """y = b + a y, step by step; a zero forgets what was before, infinities too."""
    out = []
    for x, v in zip(a, b, strict=True):
        y = v + x * y if x else v
        out.append(y)
    return out


def affine_scan(df: DataFrame, key: str, order: list[tuple[str, bool]], keep: list[str], factor: Column, value: Column, name: str) -> DataFrame:
    """(key, keep..., name): name[i] = value[i] + factor[i] * name[i - 1] in each key's order, from value[0] on.

    ``order``: columns, and whether each descends.
    A row without a value gets null and the sum begins anew after it; a null factor counts as 0.  Rows with a null
    key are a key.  An empty table gives an empty result.
    """
    columns = list(dict.fromkeys([key, *keep]))
    rows = df.select(*columns, F.coalesce(factor.cast("double"), F.lit(0.0)).alias("_a"), value.cast("double").alias("_b"), *[F.col(o).alias(f"_o{i}") for i, (o, _) in enumerate(order)])
    ordered = in_runs(rows, key, *[F.col(f"_o{i}").desc() if down else F.col(f"_o{i}") for i, (_, down) in enumerate(order)]).select(*columns, "_a", "_b", "_part")

    def steps(batch: pa.RecordBatch, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held = batch["_b"].is_valid().to_numpy(zero_copy_only=False)
        return np.where(begins | ~held, 0.0, batch["_a"].to_numpy()), np.where(held, batch["_b"].fill_null(0.0).to_numpy(), 0.0), held

    def added(whole: list, batch: pa.RecordBatch, begins: np.ndarray) -> list:
        a, b, _ = steps(batch, begins)
        zeros = np.flatnonzero(a == 0)
        first = int(zeros[-1]) if len(zeros) else 0  # what was before the last zero doesn't matter
        factor = 0.0 if len(zeros) else whole[0][0] * float(np.prod(a))
        return [[factor, folded(a[first:].tolist(), b[first:].tolist(), whole[0][1])[-1]]]

    def apply(now: float | None, batch: pa.RecordBatch, begins: np.ndarray) -> tuple[pa.RecordBatch, float]:
        a, b, held = steps(batch, begins)
        y = folded(a.tolist(), b.tolist(), now or 0.0)
        out = pa.record_batch([*[batch[c] for c in columns], pa.array(y, pa.float64(), mask=~held)], names=[*columns, name])
        return out, y[-1]

    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField(name, T.DoubleType())])
    return scanned(ordered, key, lambda: [[1.0, 0.0]], added, lambda m, before: m[0][1] + (m[0][0] * before if before and m[0][0] else 0.0), apply, schema)


class Breaks:
    """Next-fit packs as a map: for each fill that may come in, the fill that goes out and how many packs were opened.

    ``least[j]`` is the largest fill at which row j still fits on top of the rows before it; with a fill beyond, but not beyond
    least[j - 1], row j is the first to open a pack, after which the rest is determined: ``out[j]``, ``opened[j]``.  With a fill of
    at most least[-1] none opens one.
    """

    def __init__(self, least: np.ndarray, out: np.ndarray, opened: np.ndarray, total: int, cut: bool):
        self.least, self.out, self.opened, self.total, self.cut = least, out, opened, total, cut

    def after(self, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fill and opened packs after the rows; ``cut`` says that a key began there, so what came in doesn't matter."""
        if self.cut:
            return np.full(len(fill), self.out[-1]), np.full(len(fill), self.opened[-1])
        j = np.searchsorted(-self.least, -fill, "right")  # the first row that doesn't fit
        none = j == len(self.least)
        at = np.minimum(j, len(self.least) - 1)
        return (np.where(none, fill + self.total, self.out[at]), np.where(none, 0, self.opened[at])) if len(self.least) else (fill + self.total, np.zeros_like(fill))

    def then(self, later: Breaks) -> Breaks:
        if later.cut:
            return later
        if self.cut:
            out, more = later.after(self.out)
            return Breaks(self.least, out, self.opened + more, 0, True)
        out, more = later.after(self.out) if len(self.out) else (self.out, self.opened)
        stays = later.least - self.total  # fills with which all rows here fit
        least = np.concatenate([self.least, np.minimum(stays, self.least[-1]) if len(self.least) else stays])
        return Breaks(least, np.concatenate([out, later.out]), np.concatenate([self.opened + more, later.opened]), self.total + later.total, False).distinct()

    def distinct(self) -> Breaks:
        """Rows that no fill from 0 on can make the first to open a pack are left out, so at most capacity + 1 stay."""
        keep = np.concatenate([[True], (self.least[1:] < self.least[:-1]) & (self.least[:-1] >= 0)]) if len(self.least) else np.zeros(0, bool)
        return Breaks(self.least[keep], self.out[keep], self.opened[keep], self.total, self.cut)

    def told(self) -> list[list[float]]:
        return [self.least.tolist(), self.out.tolist(), self.opened.tolist(), [float(self.total), float(self.cut)]]

    @classmethod
    def heard(cls, told: list[list[float]]) -> Breaks:
        return cls(*[np.array(x, "i8") for x in told[:3]], int(told[3][0]), bool(told[3][1]))


def jumps(sizes: np.ndarray, begins: np.ndarray, capacity: int) -> np.ndarray:
    """For each row the row that opens the next pack if this one opens one; len(sizes) where none does."""
    n = len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    over = np.searchsorted(upto, upto[:-1] + capacity, "right") - 1  # rows from i up to over fit
    own = np.append(np.flatnonzero(begins), n)
    return np.minimum(np.maximum(over, np.arange(n) + 1), own[np.searchsorted(own, np.arange(n), "right")])


def followed(nxt: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By pointer doubling: the last row of each row's chain of jumps, and the sum of weights along it."""
    n = len(nxt)
    jump, last, total = np.append(nxt, n), np.append(np.arange(n), n), np.append(weights, 0)
    while (jump < n).any():
        last = np.where(jump < n, last[jump], last)
        total = total + np.where(jump < n, total[jump], 0)
        jump = jump[jump]
    return last[:-1], total[:-1]


def breaks_of(sizes: np.ndarray, begins: np.ndarray, capacity: int) -> Breaks:
    """The map of the rows; from the last key that begins here on, if one does."""
    cut = bool(begins.any())
    if cut:
        sizes = sizes[np.flatnonzero(begins)[-1] :]
    last, opened = followed(jumps(sizes, np.zeros(len(sizes), bool), capacity), np.ones(len(sizes), "i8"))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out = upto[-1] - upto[last]
    if cut:  # its first row opens pack 0
        return Breaks(np.zeros(1, "i8"), out[:1], opened[:1] - 1, 0, True)
    return Breaks(capacity - upto[1:], out, opened, int(upto[-1]), False).distinct()


def next_fit(df: DataFrame, key: str, order: str, size: str, capacity: int, name: str = "pack") -> DataFrame:
    """(key, order, size, name): packs of each key's rows in order; a row that doesn't fit opens the next pack.

    Rows over the capacity, below zero or without a size are left out.  Each row's next break comes from prefix sums, and
    pointer doubling marks the rows that open a pack; a partition's map has at most capacity + 1 entries.
    Rows alike in order go by size.  Rows with a null key are a key; an empty table gives an empty result.
    """
    fit = df.where((F.col(size) <= capacity) & (F.col(size) >= 0)).select(key, order, size)
    ordered = in_runs(fit, key, order, size)
    schema = T.StructType([*fit.schema.fields, T.StructField(name, T.IntegerType())])

    def sizes_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch[size].to_numpy(zero_copy_only=False).astype("i8")

    def added(whole: list, batch: pa.RecordBatch, begins: np.ndarray) -> list:
        return Breaks.heard(whole).then(breaks_of(sizes_of(batch), begins, capacity)).told()

    def state(whole: list, before: tuple[int, int] | None) -> tuple[int, int]:
        fill, pack = before or (0, 0)
        breaks = Breaks.heard(whole)
        out, opened = breaks.after(np.array([fill]))
        return int(out[0]), int(opened[0]) + (0 if breaks.cut else pack)

    def apply(now: tuple[int, int] | None, batch: pa.RecordBatch, begins: np.ndarray) -> tuple[pa.RecordBatch, tuple[int, int]]:
        fill, pack = now or (0, 0)
        sizes = sizes_of(batch)
        n, opens = len(sizes), np.zeros(len(sizes) + 1, bool)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        opens[min(int(np.searchsorted(upto[1:], capacity - fill, "right")), int(np.flatnonzero(begins)[0]) if begins.any() else n)] = True
        jump = np.append(jumps(sizes, begins, capacity), n)
        while not (jump[opens] == n).all():
            opens[jump[opens]] = True
            jump = jump[jump]
        opens = opens[:-1]
        packs = pack + np.cumsum(opens)
        at = np.flatnonzero(begins)
        if len(at):  # each key counts from 0
            packs -= np.concatenate([[0], packs[at]])[np.searchsorted(at, np.arange(n), "right")]
        begun = np.flatnonzero(opens | begins)
        fill = int(upto[-1] - upto[begun[-1]]) if len(begun) else fill + int(upto[-1])
        return pa.record_batch([batch[key], batch[order], batch[size], pa.array(packs, pa.int32())], names=schema.names), (fill, int(packs[-1]))

    empty = Breaks(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8"), 0, False)
    return scanned(ordered, key, empty.told, added, state, apply, schema)
