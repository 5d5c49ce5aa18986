"""Removal of passages that also stand in a document with a smaller id.

Each 50-byte window has a minimizer, the least hash of its k-byte strings; equal windows have equal
minimizers, and a run of neighbouring windows with one minimizer is a segment.  Four steps, each a
grouped Arrow function over one shuffle:

1. blocks of documents send the sorted minimizers that they hold, packed by minimizer range;
2. ranges answer which of them stand in two documents or more, and which have ``hot_segments`` or more;
3. blocks send the segments of those, equal ones of a block once, to the minimizer's range; segments of hot
   minimizers go window by window to the ranges of the windows' own hashes (equal windows have equal ones);
4. ranges find equal windows by blockwise suffix sorting (``suffix_blocks``) and answer spans.

At last blocks cut the spans out.  The documents are shuffled once: the three steps that read them
share that exchange.  What is sent grows with the text and not with the number of equal pairs: a block's
row for a range holds what falls there, so there are at most blocks x ranges rows in step 1 and never more
than minimizers; answers go only where a minimizer is shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import id_and_text
from tessera.llm.suffix_blocks import windows_of_others

K = 24
STEP = 1 << 20
NO_ID = -(1 << 63)
#: Buckets that a range of minimizers is sorted in, one after the other.
BUCKETS = 16
ROUTED = "key long, part long, ids binary, places binary, sizes binary, buckets binary, text binary"


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of numbers, equal-weight bytes side by side."""
    raw = np.ascontiguousarray(values).view("u1").reshape(len(values), -1).T if len(values) else np.zeros(0, "u1")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(data), "u1")
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Block:
    """The documents of one block in ascending order, and the segments of their windows."""

    def __init__(self, rows: pa.Table, depth: int):
        rows = rows.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.null = np.array(rows["doc_id"].is_null(), bool)
        self.ids = rows["doc_id"].fill_null(NO_ID).to_numpy()
        text = rows["text"].cast(pa.large_binary()).combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text
        if len(rows):
            offsets = np.frombuffer(text.buffers()[1], "i8")[text.offset : text.offset + len(rows) + 1]
            self.bytes = memoryview(text.buffers()[2] or b"")[offsets[0] : offsets[-1]]
            self.ends = offsets[1:] - offsets[0]
        else:
            self.bytes, self.ends = memoryview(b""), np.zeros(0, "i8")
        self.data = np.frombuffer(self.bytes, "u1")
        self.depth = depth

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(minimizer, place, number of windows) of each segment; none reaches over a document's end."""
        found, depth, wide = [], self.depth, self.depth - K + 1
        for begin in range(0, len(self.data) - depth + 1, STEP):
            part = self.data[begin : begin + STEP + depth - 1]
            n = len(part) - depth + 1
            least = window_minima(string_hashes(part), wide)[:n]
            place = begin + np.arange(n)
            doc = self.doc_of(place)
            fits = place + depth <= self.ends[doc]
            change = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (fits[1:] != fits[:-1])]))
            sizes = np.diff(np.append(change, n))
            keep = fits[change]
            found.append((evened(least[change][keep]), place[change][keep], sizes[keep]))
        if not found:
            return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8")
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def string_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the K bytes from each position on."""
    n = len(data) - K + 1
    words = np.lib.stride_tricks.as_strided(np.ascontiguousarray(data), (len(data) - 7, 8), (1, 1)).copy().view("<u8").ravel()
    out = np.zeros(n, "u8")
    for j in range(0, K, 8):
        out ^= words[j : j + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def window_hashes(data: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``depth`` bytes from each place on."""
    padded = np.lib.stride_tricks.as_strided(np.ascontiguousarray(data), (len(data) - 7, 8), (1, 1))
    out = np.zeros(len(places), "u8")
    for shift in (*range(0, depth - 8, 8), depth - 8):
        out ^= np.ascontiguousarray(padded[places + shift]).view("<u8").ravel()
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return evened(out)


def evened(values: np.ndarray) -> np.ndarray:
    """Minima lie near zero; a one-to-one mix spreads them over all 64 bits, and so over equal ranges."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(31))


def window_minima(values: np.ndarray, wide: int) -> np.ndarray:
    span = 1
    while span * 2 <= wide:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (wide - span)], values[wide - span :]) if wide > span else values


def key_bounds(sorted_keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of keys begins among sorted keys."""
    edges = np.array([(r << 64) // ranges for r in range(ranges)], "u8")
    return np.append(np.searchsorted(sorted_keys, edges), len(sorted_keys))


def rows_of(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({n: pa.array(columns.get(n, []), kinds[k]) for n, k in (x.split() for x in schema.split(", "))})


def repeated_spans(blocks: DataFrame, depth: int, ranges: int, hot_segments: int) -> DataFrame:
    """(part, places, sizes) of windows that also stand in a document with a smaller id."""
    told, answered = "key long, part long, ids binary, sizes binary, text binary", "key long, part long, ids binary, sizes binary"

    def minimizers(key: tuple, rows: pa.Table) -> pa.Table:
        block = Block(rows, depth)
        least, places, _ = block.segments()
        doc = block.ids[block.doc_of(places)]
        order = np.lexsort((doc, least))
        least, doc = least[order], doc[order]
        begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else np.zeros(0, "i8")
        unique = least[begins]
        several = doc[begins] != doc[np.append(begins[1:], len(doc))[: len(begins)] - 1]
        bounds = key_bounds(unique, ranges)
        counts = np.minimum(np.diff(np.append(begins, len(least))), (1 << 32) - 1).astype("u4")
        out: dict[str, list] = {"key": [], "part": [], "ids": [], "sizes": [], "text": []}
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[r], bounds[r + 1]
            short = unique[a:b] >> np.uint64(16)  # less to send; two keys that look equal only add candidates
            for column, x in zip(out.values(), (r, key[0].as_py(), pack(np.diff(short, prepend=np.uint64(0))), pack(counts[a:b]), pack(several[a:b].astype("u1"))), strict=True):
                column.append(x)
        return rows_of(out, told)

    def shared(key: tuple, rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x.as_py(), "u8"), dtype="u8") for x in rows["ids"]]
        several = np.concatenate([unpack(x.as_py(), "u1") for x in rows["text"]]).astype(bool)
        every = np.concatenate(keys)
        _, inverse, blocks_of = np.unique(every, return_inverse=True, return_counts=True)
        twice = blocks_of > 1
        twice[inverse[several]] = True
        hot = np.bincount(inverse, np.concatenate([unpack(x.as_py(), "u4") for x in rows["sizes"]])) >= hot_segments
        edges = np.cumsum([len(k) for k in keys])[:-1]
        out: dict[str, list] = {"key": [], "part": [], "ids": [], "sizes": []}
        for part, flags, hots in zip(rows["part"].to_pylist(), np.split(twice[inverse], edges), np.split((twice & hot)[inverse], edges), strict=True):
            if flags.any():
                for column, x in zip(out.values(), (key[0].as_py(), part, pack(np.packbits(flags)), pack(np.packbits(hots)) if hots.any() else None), strict=True):
                    column.append(x)
        return rows_of(out, answered)

    def send(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        block, part = Block(rows, depth), key[0].as_py()
        least, places, sizes = block.segments()
        unique, inverse = np.unique(least, return_inverse=True)
        bounds = key_bounds(unique, ranges)
        twice, hot = np.zeros(len(unique), bool), np.zeros(len(unique), bool)
        for r, shared_bits, hot_bits in zip(answers["key"].to_pylist(), answers["ids"].to_pylist(), answers["sizes"].to_pylist(), strict=True):
            a, b = bounds[r], bounds[r + 1]
            twice[a:b] = np.unpackbits(unpack(shared_bits, "u1"), count=int(b - a))
            if hot_bits:
                hot[a:b] = np.unpackbits(unpack(hot_bits, "u1"), count=int(b - a))
        chosen, split = twice[inverse], hot[inverse]
        keys, places, sizes, hots = least[chosen], places[chosen], sizes[chosen], split[chosen]
        if hots.any():  # their windows, each with a key of its own
            windows = np.repeat(places[hots], sizes[hots]) + np.arange(sizes[hots].sum()) - np.repeat(np.cumsum(sizes[hots]) - sizes[hots], sizes[hots])
            keys = np.concatenate([keys[~hots], window_hashes(block.data, windows, depth)])
            places, sizes = np.concatenate([places[~hots], windows]), np.concatenate([sizes[~hots], np.ones(len(windows), "i8")])
            order = np.argsort(places, kind="stable")
            keys, places, sizes = keys[order], places[order], sizes[order]
        ids = block.ids[block.doc_of(places)]
        first: dict[bytes, int] = {}
        known = np.zeros(len(places), bool)  # an equal segment stands in a smaller document of this block
        data = block.bytes
        for i, (a, n, d) in enumerate(zip(places.tolist(), (sizes + depth - 1).tolist(), ids.tolist(), strict=True)):
            known[i] = first.setdefault(bytes(data[a : a + n]), d) < d
        out: dict[str, list] = {n.split()[0]: [] for n in ROUTED.split(", ")}
        fine = np.array([(r << 64) // (ranges * BUCKETS) for r in range(ranges * BUCKETS)], "u8")

        def add(key: int, some: np.ndarray, text: bytes | None) -> None:
            bucket = (np.searchsorted(fine, keys[some], "right") - 1 - key * BUCKETS).astype("u1")
            for column, x in zip(out.values(), (key, part, pack(ids[some]), pack(places[some]), pack(sizes[some]), pack(bucket), text), strict=True):
                column.append(x)

        if known.any():
            add(part % ranges, np.flatnonzero(known), None)
        at = np.flatnonzero(~known)
        at = at[np.argsort(keys[at], kind="stable")]
        edges = key_bounds(keys[at], ranges)
        for r in np.flatnonzero(np.diff(edges)).tolist():
            some = at[edges[r] : edges[r + 1]]
            text = b"".join([data[a : a + n] for a, n in zip(places[some].tolist(), (sizes[some] + depth - 1).tolist(), strict=True)])
            add(r, some, zstandard.ZstdCompressor(level=3).compress(text))
        return rows_of(out, ROUTED)

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        done = rows.filter(rows["text"].is_null())
        out = {n: done[n].to_pylist() for n in ("part", "places", "sizes")}
        sent = []
        for row in rows.filter(rows["text"].is_valid()).to_pylist():
            ids, places, sizes = (unpack(row[n], "i8") for n in ("ids", "places", "sizes"))
            text = memoryview(zstandard.ZstdDecompressor().decompressobj().decompress(row["text"]))
            ends = np.concatenate([[0], np.cumsum(sizes + depth - 1)])
            edges = np.searchsorted(unpack(row["buckets"], "u1"), np.arange(BUCKETS + 1))
            sent.append((row["part"], ids, places, sizes, text, ends, edges))
        for k in range(BUCKETS):
            some = [(part, ids[a:b], places[a:b], sizes[a:b], text[ends[a] : ends[b]]) for part, ids, places, sizes, text, ends, edges in sent for a, b in [edges[k : k + 2]] if a < b]
            if not some:
                continue
            text = np.frombuffer(b"".join([x[4] for x in some]), "u1")
            ids, places, sizes = (np.concatenate([x[n] for x in some]) for n in (1, 2, 3))
            part = np.repeat([x[0] for x in some], [len(x[1]) for x in some])
            segment = np.repeat(np.arange(len(sizes)), sizes)
            within = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bases = np.cumsum(sizes + depth - 1) - (sizes + depth - 1)
            gone = windows_of_others(text, bases[segment] + within, ids[segment], depth)
            opens = gone & ~(np.concatenate([[False], gone[:-1]]) & (within > 0))
            begins, run = np.flatnonzero(opens), np.cumsum(opens)
            lengths = np.bincount(run[gone] - 1, minlength=len(begins))
            parts, spots = part[segment[begins]], places[segment[begins]] + within[begins]
            edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1))  # parts come in order
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out["part"].append(int(parts[a]))
                out["places"].append(pack(spots[a:b]))
                out["sizes"].append(pack(lengths[a:b].astype("i8")))
        return rows_of(out, "part long, places binary, sizes binary")

    held = blocks.groupBy("part").applyInArrow(minimizers, told)
    answers = held.groupBy("key").applyInArrow(shared, answered)
    routed = blocks.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(send, ROUTED)
    return routed.groupBy("key").applyInArrow(compare, "part long, places binary, sizes binary")


def _with_spans(docs: DataFrame, depth: int, block_bytes: int, hot_segments: int, id_col: str, text_col: str, finish, schema: str) -> DataFrame:
    if depth < 2 * K - 8 or depth < 42:
        raise ValueError(f"windows of {depth} bytes are too short for minimizers of {K}")
    rows = id_and_text(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    blocks = rows.select(F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(parts)).alias("part"), "doc_id", "text")

    def cut(key: tuple, rows: pa.Table, spans: pa.Table) -> pa.Table:
        block = Block(rows, depth)
        if len(spans):
            places = np.concatenate([unpack(x.as_py(), "i8") for x in spans["places"]])
            ends = places + np.concatenate([unpack(x.as_py(), "i8") for x in spans["sizes"]]) + depth - 1
        else:
            places = ends = np.zeros(0, "i8")
        order = np.argsort(places, kind="stable")
        places, ends = places[order], ends[order]
        doc = block.doc_of(places)
        reach = np.maximum.accumulate(ends) if len(ends) else ends
        new = np.concatenate([[True], (places[1:] > reach[:-1]) | (doc[1:] != doc[:-1])]) if len(places) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        begins, stops, owner = places[heads], reach[np.append(heads[1:], len(places))[: len(heads)] - 1], doc[heads]
        edges = np.searchsorted(owner, np.arange(len(block.ids) + 1))
        results = []
        for i, (a, b) in enumerate(zip((block.ends - np.diff(block.ends, prepend=0)).tolist(), block.ends.tolist(), strict=True)):
            gone = [(int(x), int(y)) for x, y in zip(begins[edges[i] : edges[i + 1]], stops[edges[i] : edges[i + 1]], strict=True)]
            cuts = [a, *(p for g in gone for p in g), b]
            kept = b"".join([block.bytes[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)])
            results.append((None if block.null[i] else int(block.ids[i]), b - a, sum(y - x for x, y in gone), len(gone), kept))
        return finish(results)

    spans = repeated_spans(blocks, depth, parts, hot_segments)
    return blocks.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(cut, schema)


def span_digests(docs: DataFrame, depth: int = 50, block_bytes: int = 8 << 20, hot_segments: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    Null texts are empty; null ids come before all others; rows with one id are no source for each
    other.  Texts shorter than a window stay whole.  An empty table gives an empty result.  A minimizer with
    ``hot_segments`` segments or more is split by window over all ranges.
    """

    def finish(results: list[tuple]) -> pa.Table:
        ids, sizes, gone, spans, kept = zip(*results, strict=True)
        return rows_of({"doc_id": ids, "n_bytes": sizes, "n_removed": gone, "n_spans": spans, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}, SPANS)

    return _with_spans(docs, depth, block_bytes, hot_segments, id_col, text_col, finish, SPANS)


SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeated_spans(docs: DataFrame, depth: int = 50, block_bytes: int = 8 << 20, hot_segments: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and what is left of each row's text as UTF-8; characters that a cut leaves incomplete go.

    Null and empty texts are empty; rows that repeat id and text are one document, and each gets its result; other columns
    are not read; an empty table gives an empty result.
    """

    def finish(results: list[tuple]) -> pa.Table:
        return rows_of({"doc_id": [r[0] for r in results], "text": [r[4].decode(errors="ignore") for r in results]}, "doc_id long, text string")

    return _with_spans(docs, depth, block_bytes, hot_segments, id_col, text_col, finish, "doc_id long, text string")
