"""Phrases whose words stand together more often than apart, from suffix automata of shards.

A shard is up to ``shard_words`` words of one language as numbers.  The suffix-link tree of its (generalised) suffix
automaton is the tree of its reversed contexts: a node at depth m is a phrase of m words, its link drops the first
word, and its endpos count is the number of places where it ends.  The tree is built depth by depth by sorting
(link, word to the left) of all ends at once, to the depth asked for.

A phrase that is frequent over all shards has frequent parts, so counting goes by depth: a shard gives the counts of
phrases whose link and whose prefix (the transition that leads to them) are frequent, Spark adds them up, first in buckets
of hashes, then those of full buckets by their words, in sorted and compressed runs; what is frequent is known to the next
depth by a Bloom filter of a fixed size.  False positives cost rows and never counts; a corpus too rich for the filter shuffles more and gives the
same result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import hot_lookup, lean, named, shared_path

#: Capital letters become small, what ends a piece a newline, a tab a space.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
SMALL = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"\n" * len(ENDS) + b" ")
SHARD = "lang string, skip int, words array<string>, counts array<long>, ids binary"
SHARD_TYPES = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shard:
    """Words of one language as numbers, -1 between pieces; the first ``skip`` are there as left context only."""

    def __init__(self, context: list[bytes] = []):  # noqa: B006
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.parts, self.skip, self.size = [], len(context), 0
        if context:
            self.parts.append(np.array([self.vocabulary[w] for w in context], "<i4"))

    def add(self, words: list[bytes], breaks: np.ndarray) -> None:
        """``breaks``: before which of the words a new piece begins."""
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), "<i4", len(words))
        self.parts.append(np.insert(ids, breaks, -1))
        self.size += len(words)

    def row(self, lang: str) -> tuple:
        ids = np.concatenate(self.parts)
        held = ids[self.skip :]
        return lang, self.skip, list(self.vocabulary), np.bincount(held[held >= 0], minlength=len(self.vocabulary)), ids.tobytes()


def blocks(data: bytes, most: int) -> Iterator[tuple[list[bytes], np.ndarray, bool]]:
    """(words, breaks, whether the last piece goes on) of small-lettered data, cut at spaces into parts of about ``most`` bytes."""
    begin, fresh = 0, True
    while begin < len(data):
        end = len(data)
        if end - begin > most:
            cut = max(data.rfind(b" ", begin, begin + most), data.rfind(b"\n", begin, begin + most))
            if cut < 0:  # one word longer than a part
                cut = min((x for x in (data.find(b" ", begin), data.find(b"\n", begin)) if x >= 0), default=end)
            end = min(cut + 1, end)
        some = data[begin:end]
        raw = np.frombuffer(some, "u1")
        gap = (raw == 32) | (raw == 10)
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        piece = np.searchsorted(np.flatnonzero(raw == 10), starts)
        breaks = np.flatnonzero(np.diff(piece, prepend=piece[:1])) if len(piece) else np.zeros(0, "i8")
        if len(piece) and (fresh or piece[0] > 0):
            breaks = np.concatenate([[0], breaks])
        goes_on = end < len(data) and (some.rstrip(b" ")[-1:] != b"\n")
        fresh = not goes_on if len(piece) else fresh or b"\n" in some
        yield some.split(), breaks, not fresh
        begin = end


def write_shards(docs: DataFrame, path: str, depth: int, shard_words: int, block_bytes: int = 4 << 20, text_col: str = "text", lang_col: str = "lang") -> None:
    """The documents' words as Parquet rows of shards; null texts are empty, a null language is ``und``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = defaultdict(Shard)

        def done(langs: list[str]) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                shard = shards.pop(lang)
                if shard.size:
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(shard.row(lang), SHARD_TYPES, strict=True)], names=[c.split()[0] for c in SHARD.split(", ")])

        for batch in batches:
            by: dict[str, list[int]] = defaultdict(list)
            for i, lang in enumerate(batch["lang"].to_pylist()):
                by[lang].append(i)
            for lang, rows in by.items():
                texts = batch["text"].take(pa.array(rows)).cast(pa.binary()).to_pylist()
                for words, breaks, goes_on in blocks(b"\n".join(texts).translate(SMALL), block_bytes):
                    shards[lang].add(words, breaks)
                    if goes_on and shards[lang].size >= shard_words:
                        tail = words[max(len(words) - depth + 1, int(breaks[-1]) if len(breaks) else 0) :]
                        if len(tail) == depth - 1 or len(breaks):
                            yield from done([lang])
                            shards[lang] = Shard(tail)
            if sum(s.size for s in shards.values()) >= shard_words:
                yield from done(list(shards))
        yield from done(list(shards))

    rows = docs.select(F.coalesce(named(lang_col), F.lit("und")).alias("lang"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    rows.mapInArrow(lean(build), SHARD).write.option("compression", "zstd").parquet(path)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(f"{lang} {w}") for w in words), "u8", len(words))


def extended(suffix: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their links and of the words before."""
    x = suffix * MIX + left
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Known:
    """A Bloom filter of two bits for each phrase."""

    def __init__(self, bits: int, empty: bool = False):
        self.bits, self.held = bits, np.zeros(0 if empty else 1 << (bits - 3), "u1")

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> np.uint64(64 - self.bits)).astype("i8"), (hashes & np.uint64((1 << self.bits) - 1)).astype("i8")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        both = [self.held[p >> 3] >> (p & 7).astype("u1") & 1 for p in self.places(hashes)]
        return (both[0] & both[1]).astype(bool)

    def add(self, rows: DataFrame, hashed: Callable[[pa.RecordBatch], np.ndarray]) -> None:
        """Bits of the rows' hashes, found in tasks; what comes here is as large as the filter at most."""
        places = Known(self.bits, empty=True).places

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.concatenate(places(hashed(batch))))
                yield pa.record_batch({"word": at >> 6, "mask": (np.uint64(1) << (at & 63).astype("u8")).view("i8")})

        got = rows.mapInArrow(told, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        self.held.view("<i8")[got["word"].to_numpy()] |= got["mask"].to_numpy()


def phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of (lang, phrase) rows, as automata have them."""
    own: dict[str, dict[str, np.ndarray]] = defaultdict(dict)
    out = np.zeros(len(batch), "u8")
    for i, (lang, phrase) in enumerate(zip(batch["lang"].to_pylist(), batch["phrase"].to_pylist(), strict=True)):
        words, of = phrase.split(" "), own[lang]
        for w in words:
            if w not in of:
                of[w] = word_hashes(lang, [w])
        x = of[words[-1]]
        for w in words[-2::-1]:
            x = extended(x, of[w])
        out[i] = x[0]
    return out


def bucket_hashes(buckets: np.ndarray) -> np.ndarray:
    return extended(buckets.astype("u8"), np.zeros(len(buckets), "u8"))


def counted(ids: np.ndarray, skip: int, hashes: np.ndarray, depth: int, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An end, the endpos count and the hash of each phrase of ``depth`` words whose link and prefix are known, and so theirs."""
    width, word = len(hashes), ids.astype("i8")
    node = np.where(word >= 0, word, -1)
    node[node >= 0] = np.where(known.has(hashes)[node[node >= 0]], node[node >= 0], -1)
    own = hashes
    for m in range(2, depth + 1):
        ends = np.flatnonzero((node[1:] >= 0) & (node[:-1] >= 0)) + 1
        left = word[ends - m + 1]
        keys, first, inverse, counts = np.unique(node[ends] * width + left, return_index=True, return_inverse=True, return_counts=True)
        own = extended(own[keys // width], hashes[keys % width])
        if m == depth:
            if skip:
                counts = np.bincount(inverse[ends >= skip], minlength=len(keys))
            held = counts > 0
            return ends[first][held], counts[held], own[held]
        node = np.full(len(word), -1, "i8")
        node[ends] = np.where(known.has(own)[inverse], inverse, -1)
    raise ValueError("phrases have two words or more")


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, compressed."""
    return pa.compress(numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), "u1").reshape(4, n).T).view("<u4").ravel()


RUNS = "range int, lang string, n int, keys binary, counts binary, bytes int"
RUN_TYPES = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]


def over_shards(shards: DataFrame, depth: int, known: Known, hot: Known | None, ranges: int) -> DataFrame:
    """What shards count at a depth, in runs by range of the phrases' buckets (32 bits of their hashes).

    A run has the sorted buckets as differences or, of phrases in ``hot`` buckets, the phrases by line, with their counts.
    """
    sent = lambda k: None if k is None else (k.bits, k.held)
    shared = shards.sparkSession.sparkContext.broadcast((sent(known), sent(hot)))

    def heard(told: tuple | None) -> Known | None:
        if told is None:
            return None
        out = Known(told[0], empty=True)
        out.held = told[1]
        return out

    def enumerate_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot = map(heard, shared.value)
        for batch in batches:
            for i in range(len(batch)):
                lang, words = batch["lang"][i].as_py(), batch["words"][i].values
                ids = np.frombuffer(batch["ids"][i].as_buffer(), "<i4")
                ends, counts, own = counted(ids, batch["skip"][i].as_py(), word_hashes(lang, words.to_pylist()), depth, known)
                if hot is not None:
                    held = hot.has(bucket_hashes(own >> np.uint64(32)))
                    ends, counts, own = ends[held], counts[held], own[held]
                order = np.argsort(own)
                ends, counts, buckets = ends[order], counts[order], (own[order] >> np.uint64(32)).astype("i8")
                edges = np.searchsorted(buckets * ranges >> 32, np.arange(ranges + 1))
                rows = []
                for r in np.flatnonzero(np.diff(edges)).tolist():
                    a, b = edges[r : r + 2]
                    if hot is None:
                        rows.append((r, None, b - a, packed(np.diff(buckets[a:b], prepend=0)), packed(counts[a:b]), 0))
                        continue
                    at = ends[a:b]
                    phrases = pc.binary_join_element_wise(*[words.take(pa.array(ids[at - k])) for k in range(depth - 1, -1, -1)], " ")
                    text = "\n".join(phrases.to_pylist()).encode()
                    rows.append((r, lang, b - a, pa.compress(text, "zstd", asbytes=True), packed(counts[a:b]), len(text)))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUN_TYPES, strict=True)], names=[c.split()[0] for c in RUNS.split(", ")])

    return shards.select("lang", "skip", "words", "ids").mapInArrow(lean(enumerate_shard, "ids"), RUNS)


def phrase_counts(shards: DataFrame, depth: int, known: Known, least: int, ranges: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``depth`` words that stand ``least`` times or more in all.

    Nearly all phrases are rare, so they are first counted in 2^32 buckets; only phrases of buckets that reach ``least`` are
    then written out.  A range's runs, one from each shard, are added up in one task, and there are as many ranges as its
    memory asks for.
    """

    def full(runs: pa.Table) -> pa.Table:
        keys, counts = (np.concatenate([f(unpacked(d, n)) for d, n in zip(runs[c].to_pylist(), runs["n"].to_pylist(), strict=True)]) for c, f in (("keys", lambda x: np.cumsum(x, dtype="u8")), ("counts", lambda x: x)))
        found, inverse = np.unique(keys, return_inverse=True)
        return pa.table({"bucket": found[np.bincount(inverse, counts) >= least].astype("i8")})

    def added(runs: pa.Table) -> pa.Table:
        out = []
        for lang in runs["lang"].unique().to_pylist():
            own = runs.filter(pc.equal(runs["lang"], lang))
            texts = [pa.decompress(d, n, "zstd", asbytes=True).decode().split("\n") for d, n in zip(own["keys"].to_pylist(), own["bytes"].to_pylist(), strict=True)]
            counts = [unpacked(d, n).astype("i8") for d, n in zip(own["counts"].to_pylist(), own["n"].to_pylist(), strict=True)]
            sums = pa.table({"phrase": pa.array([p for t in texts for p in t], pa.string()), "n": np.concatenate(counts)}).group_by("phrase").aggregate([("n", "sum")])
            sums = sums.filter(pc.greater_equal(sums["n_sum"], least))
            out.append(pa.table({"lang": pa.array([lang] * len(sums), pa.string()), "phrase": sums["phrase"], "f": sums["n_sum"]}))
        return pa.concat_tables(out)

    hot = Known(known.bits)
    buckets = over_shards(shards, depth, known, None, ranges).groupBy("range").applyInArrow(full, "bucket long")
    hot.add(buckets, lambda batch: bucket_hashes(batch["bucket"].to_numpy()))
    return over_shards(shards, depth, known, hot, ranges).groupBy("range").applyInArrow(added, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, most_words: int = 5, least: int = 100, shard_words: int = 1 << 20, filter_bits: int = 26, block_bytes: int = 4 << 20, range_words: int = 1 << 22, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of words and phrases that stand ``least`` times or more, (lang, n) of all words)."""
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "phrases")
    write_shards(docs, f"{path}/shards", most_words, shard_words, block_bytes, text_col, lang_col)
    shards, known = spark.read.schema(SHARD).parquet(f"{path}/shards"), Known(filter_bits)
    sizes = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    ranges = -(-(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1) // range_words)
    words = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("n"))
    for m in range(1, most_words + 1):
        found = words.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least) if m == 1 else phrase_counts(shards, m, known, least, ranges)
        found.withColumn("words", F.lit(m)).write.parquet(f"{path}/frequent/depth={m}")
        if m < most_words:
            known.add(spark.read.parquet(f"{path}/frequent/depth={m}").select("lang", "phrase"), phrase_hashes)
    return spark.read.schema("lang string, phrase string, words int, f long").parquet(*[f"{path}/frequent/depth={m}" for m in range(1, most_words + 1)]), sizes


def _beginning(phrase: str, k: Column | int) -> Column:
    return F.expr(f"substring_index({phrase}, ' ', {k})")


def collocations(
    docs: DataFrame, most_words: int = 5, least: int = 100, top: int = 2000, subsumed_percent: int = 100, shard_words: int = 1 << 20, filter_bits: int = 26, block_bytes: int = 4 << 20, range_words: int = 1 << 22, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases by their weakest cut.

    a, l, r count the phrase and the two sides of the cut, n all words; score is floor(1000 a n / (l r)).  A phrase
    goes if a longer one that holds it stands ``subsumed_percent`` per cent as often or more: such a phrase has one of one
    word more, whose link or prefix it is, that does so too, hence only links and prefixes are compared.  Null
    texts are empty, a null language is ``und``, rows that repeat count each, words of any length are words, an empty
    table gives no rows.  Ties go by a, then by the phrase's bytes.
    """
    table, sizes = frequent_phrases(docs, most_words, least, shard_words, filter_bits, block_bytes, range_words, text_col, lang_col)
    longer = table.where("words > 1")
    parts = longer.where("words > 2").select("lang", F.explode(F.array(_beginning("phrase", "words - 1"), _beginning("phrase", "1 - words"))).alias("phrase"), "f")
    around = parts.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = longer.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < subsumed_percent * F.col("f"))).select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    of = lambda name: table.select(F.struct("lang", "phrase").alias(f"{name}_of"), F.col("f").alias(name))
    cuts = cuts.withColumn("l_of", F.struct("lang", _beginning("phrase", "k").alias("phrase"))).withColumn("r_of", F.struct("lang", _beginning("phrase", "k - words").alias("phrase")))
    cuts = hot_lookup(hot_lookup(cuts, of("l"), "l_of", F.col("phrase")), of("r"), "r_of", F.col("phrase")).join(sizes, "lang")
    whole = lambda name: f"cast({name} as decimal(19,0))"
    score = F.expr(f"({whole('a')} * {whole('n')} * cast(1000 as decimal(4,0))) div ({whole('l')} * {whole('r')})")
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy(*order)).cast("long")
    best = weakest.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", place("_salt")).where(F.col("rank") <= top)
    return best.withColumn("rank", place()).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
