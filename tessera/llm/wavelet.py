"""Token ids in shards of wavelet matrices.

A shard holds the ids of consecutive documents as bit-planes, from the highest bit down; below each
plane the ids with a 0 there come before those with a 1.  Planes are compressed in chunks of 65,536
bits, and a directory holds the ones before each chunk, so that access, rank, select, count and
locate unpack one chunk of each plane at most for each position.  A shard is one block of bytes;
Spark commits the blocks as Parquet rows (one shard, one row), so that any store serves and a lost
executor's attempt leaves nothing behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import id_and_text
from tessera.llm._items import library_items, once, slices

MAGIC = b"TWM2"
HEAD = "<4sIQQ"
#: Bits of a chunk of a plane.
CHUNK = 1 << 16


def build_shard(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, levels: int) -> bytes:
    """Bytes of a shard: a header, the directory, documents' ids and sizes, and the planes' compressed chunks."""
    if len(ids) and int(ids.max()) >> levels:
        raise ValueError(f"id {int(ids.max())} needs more than {levels} planes")
    squeeze = zstandard.ZstdCompressor(level=1).compress
    values = ids.astype("u2" if levels <= 16 else "u4")
    blocks, zeros, ranks = [squeeze(doc_ids.astype("<i8").tobytes()), squeeze(sizes.astype("<i8").tobytes())], [], []
    for level in range(levels - 1, -1, -1):
        bit = (values & values.dtype.type(1 << level)) != 0
        packed = memoryview(np.packbits(bit, bitorder="little"))
        blocks += [squeeze(packed[a : a + CHUNK // 8]) for a in range(0, len(packed), CHUNK // 8)]
        ones = [int(np.count_nonzero(bit[a : a + CHUNK])) for a in range(0, len(bit), CHUNK)]
        ranks += np.cumsum([0, *ones]).tolist()
        zeros.append(len(bit) - ranks[-1])
        below = np.empty_like(values)
        np.compress(~bit, values, out=below[: zeros[-1]])
        np.compress(bit, values, out=below[zeros[-1] :])
        values = below
    head = struct.pack(HEAD, MAGIC, levels, len(doc_ids), len(ids))
    return b"".join([head, np.array([*zeros, *ranks], "<u8").tobytes(), np.array(list(map(len, blocks)), "<u4").tobytes(), *blocks])


class Shard:
    """Reads a shard's bytes; a plane's chunks are unpacked when they are first asked for."""

    def __init__(self, data: bytes):
        magic, self.levels, self.n_docs, self.n = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.chunks = -(-self.n // CHUNK)
        at, numbers = struct.calcsize(HEAD), self.levels * (self.chunks + 2)
        table = np.frombuffer(data, "<u8", numbers, at).astype("i8")
        self.zeros, self.ranks = table[: self.levels].tolist(), table[self.levels :].reshape(self.levels, self.chunks + 1)
        at += 8 * numbers
        sizes = np.frombuffer(data, "<u4", 2 + self.levels * self.chunks, at)
        ends = np.cumsum([at + 4 * len(sizes), *sizes.tolist()]).tolist()
        self.blocks = [memoryview(data)[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.words: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.blocks[k], max_output_size=max(1, 8 * self.n_docs, CHUNK // 8))

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents and how many token ids each has."""
        return np.frombuffer(self.block(0), "<i8"), np.frombuffer(self.block(1), "<i8")

    def chunk(self, k: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of chunk c of plane k (0 is the highest bit) and the chunk's ones before each word."""
        if (k, c) not in self.words:
            raw = self.block(2 + k * self.chunks + c)
            words = np.frombuffer(raw + bytes(-len(raw) % 8), "<u8")
            self.words[k, c] = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype="i8")])
        return self.words[k, c]

    def ones(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        c, within = divmod(i, CHUNK)
        if not within:
            return int(self.ranks[k, c])
        words, before = self.chunk(k, c)
        w, rest = within >> 6, within & 63
        return int(self.ranks[k, c] + before[w]) + ((int(words[w]) & ((1 << rest) - 1)).bit_count() if rest else 0)

    def position(self, k: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) of plane k's bits that equal ``bit``."""
        ahead = self.ranks[k] if bit else np.arange(self.chunks + 1) * CHUNK - self.ranks[k]
        c = int(np.searchsorted(ahead[:-1], nth, "right")) - 1
        words, before = self.chunk(k, c)
        left, inner = nth - int(ahead[c]), before if bit else (np.arange(len(before)) << 6) - before
        w = int(np.searchsorted(inner[:-1], left, "right")) - 1
        word = int(words[w]) if bit else ~int(words[w]) & (1 << 64) - 1
        for _ in range(left - int(inner[w])):
            word &= word - 1
        return c * CHUNK + (w << 6) + (word & -word).bit_length() - 1

    def access(self, i: int) -> int:
        """The token id at position i."""
        value = 0
        for k in range(self.levels):
            words, _ = self.chunk(k, i // CHUNK)
            bit = int(words[i % CHUNK >> 6]) >> (i & 63) & 1
            value = value << 1 | bit
            i = self.zeros[k] + self.ones(k, i) if bit else i - self.ones(k, i)
        return value

    def span(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences of [begin, end) lie below the last plane."""
        for k in range(self.levels):
            a, b = self.ones(k, begin), self.ones(k, end)
            if token >> (self.levels - 1 - k) & 1:
                begin, end = self.zeros[k] + a, self.zeros[k] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of the token in [begin, end); none of an id that the planes can't hold."""
        if token < 0 or token >> self.levels:
            return 0
        a, b = self.span(token, begin, self.n if end is None else end)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """Position of the token's nth occurrence (from 0)."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        begin, _ = self.span(token, 0, self.n)
        at = begin + nth
        for k in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - k) & 1
            at = self.position(k, bit, at - self.zeros[k] if bit else at)
        return at

    def locate(self, token: int) -> list[int]:
        """All positions of the token."""
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids, put together from the lowest plane up."""
        values = np.zeros(self.n, "<u2" if self.levels <= 16 else "<u4")
        for k in range(self.levels - 1, -1, -1):
            raw = b"".join([self.block(2 + k * self.chunks + c) for c in range(self.chunks)])
            bit = np.unpackbits(np.frombuffer(raw, "u1"), count=self.n, bitorder="little").view(bool)
            values[self.zeros[k] :] |= values.dtype.type(1 << (self.levels - 1 - k))
            above = np.empty_like(values)
            np.place(above, ~bit, values[: self.zeros[k]])
            np.place(above, bit, values[self.zeros[k] :])
            values = above
        return values.astype("<u4")


def planes_of(tokenizer_path: str, end_id: int) -> int:
    """Bits of the greatest id of a vocabulary and of the end id."""
    from tokenizers import Tokenizer

    return max(1, end_id.bit_length(), max(Tokenizer.from_file(tokenizer_path).get_vocab().values()).bit_length())


def write_shards(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shard_bytes: int = 16 << 20, shard_ids: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode documents in ascending id order into shards at ``path``; each document ends with ``end_id``.

    Documents are dealt out by id ranges of about ``shard_bytes`` of text, and a part's shard ends where
    it holds ``shard_ids`` ids.  Null texts are empty, null ids come first.  Rows that share an id go by their place
    in the table, so that ranges can part them too.
    """
    rows = id_and_text(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    end, levels = np.array([end_id], "<u4"), planes_of(tokenizer_path, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = once(library_items, tokenizer_path, True)
        part, seq, n, held, sizes, doc_ids = TaskContext.get().partitionId(), 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            block = build_shard(np.array(doc_ids, "i8"), np.array(sizes, "i8"), np.concatenate(held), levels)
            return pa.record_batch({"part": [part], "seq": [seq], "n_tokens": [sum(sizes)], "block": pa.array([block], pa.binary())})

        for batch in batches:
            for at in slices(batch["text"], 16 << 20):
                ids, offsets = items.ids(batch["text"][at])
                for doc_id, a, b in zip(batch["doc_id"][at].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    held += [ids[a:b], end]
                    sizes.append(b - a + 1)
                    doc_ids.append(NO_ID if doc_id is None else doc_id)
                    n += b - a + 1
                    if n >= shard_ids:
                        yield flush()
                        seq, n, held, sizes, doc_ids = seq + 1, 0, [], [], []
        if sizes:
            yield flush()

    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id", "_place").sortWithinPartitions("doc_id", "_place")
    dealt.select("doc_id", "text").mapInArrow(encode, "part long, seq long, n_tokens long, block binary").write.parquet(path)


NO_ID = -(1 << 63)


def _based(spark: SparkSession, path: str) -> DataFrame:
    """(base, block): the shards at a path, each with the number of ids before it."""
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "seq", "n_tokens")
    upto = lambda by: F.coalesce(F.sum("n_tokens").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", upto(W.orderBy("part")).alias("_base"))  # one row for each part
    bases = sizes.withColumn("_at", upto(W.partitionBy("part").orderBy("seq"))).join(parts, "part").select("part", "seq", (F.col("_base") + F.col("_at")).alias("base"))
    return shards.select("part", "seq", "block").join(bases, ["part", "seq"]).select("base", "block")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document in the shards."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, block in zip(batch["base"].to_pylist(), batch["block"], strict=True):
                shard = Shard(block.as_buffer())
                doc_ids, sizes = shard.documents()
                raw = memoryview(shard.tokens().tobytes())
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": pa.array(doc_ids, mask=doc_ids == NO_ID), "start": base + ends - sizes, "n_tokens": sizes, "ids_crc32": pa.array(crc, pa.int64())})

    return _based(spark, path).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each of the asked-for ids in all shards, from ranks, without expanding a shard.

    Null and empty texts are one end id each in the shards, rows that repeat are there as often; ids asked for twice count
    once; an id that no text has gives 0, ids outside the vocabulary too; no shards give no rows.
    """
    asked = sorted(set(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["block"]:
                shard = Shard(block.as_buffer())
                yield pa.record_batch({"token": pa.array(asked, pa.int64()), "n": pa.array([shard.count(t) for t in asked], pa.int64())})

    counted = spark.read.parquet(path).select("block").mapInArrow(count, "token long, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def locate_tokens(spark: SparkSession, path: str, tokens: list[int], most: int = 1 << 16) -> DataFrame:
    """(token, position): each place of the asked-for ids among the ids of all documents, ``most`` to an Arrow batch.

    Null and empty texts are one end id each, rows that repeat have places of their own; ids asked for twice are told once;
    ids that no text has, and no shards, give no rows.
    """
    asked = sorted(set(tokens))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, block in zip(batch["base"].to_pylist(), batch["block"], strict=True):
                shard = Shard(block.as_buffer())
                for token in asked:
                    n = shard.count(token)
                    for a in range(0, n, most):
                        at = [base + shard.select(token, k) for k in range(a, min(n, a + most))]
                        yield pa.record_batch({"token": pa.array([token] * len(at), pa.int64()), "position": pa.array(at, pa.int64())})

    return _based(spark, path).mapInArrow(locate, "token long, position long")
