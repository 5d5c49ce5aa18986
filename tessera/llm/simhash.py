"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2r`` bits apart have a variant in common that is within ``r`` bits of
either, so each distinct fingerprint emits its ball of radius ``r`` and those that meet on a variant
are candidates.  Bits beyond two are absorbed by leaving out, in turn, blocks of the fingerprint:

* distance 3: one of three blocks.  If no block holds two differing bits, leaving out one that holds
  one leaves two; else leaving out a block with two or more leaves at most one.  A fingerprint emits
  3 x (1 + 42 or 43) variants of radius 1, where balls of radius 2 over all 64 bits would be 2,081.
* distance 6: two of four blocks.  Were three bits left by leaving out the two blocks with most, one
  of the others would hold two, so the two left out four or more, seven in all.  A fingerprint emits
  6 x (1 + 32) variants.

Fingerprints are made distinct before they are spread, those that meet are verified on all bits (and,
if asked for, on a second fingerprint of longer shingles), and each variant's members give a spanning
forest of their links, not all pairs.

For near copies of a stated similarity, ``similar_documents`` meets the blocks of a wider fingerprint in the same way, each
with its ball of radius 1, and verifies every link by the whole texts' shingle sets, so that no estimate decides which
documents go.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed, hot_lookup, id_and_text, lean, without
from tessera.llm.components import connected_components

#: By the distance reached: where blocks of the 64 bits end, and how many of them are left out.
CUTS = {3: ((0, 21, 42, 64), 1), 6: ((0, 16, 32, 48, 64), 2)}
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype("i8")


def shingle_hashes(data: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words of ASCII-lower-cased UTF-8 text; of all words if there are fewer."""
    found = data.lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), "i8", len(found)) + 1) - 1
    k = min(words, len(found))
    begins = np.concatenate([[0], ends[: len(found) - k] + 1])
    of = xxhash.xxh64_intdigest
    return np.array([of(joined[a:b], seed) for a, b in zip(begins.tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(data: bytes, words: int) -> int:
    """64 bits, each set if set in over half of the shingles' hashes."""
    hashes = shingle_hashes(data, words)
    if len(hashes) < 400:
        ones = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    else:
        octets = hashes.view("u1").reshape(-1, 8)
        ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", verify_words: int | None = None) -> DataFrame:
    """doc_id and fingerprint (long, the 64 bits as signed), and ``check``, that of ``verify_words`` words, if given."""
    lengths = {"fingerprint": words} | ({"check": verify_words} if verify_words else {})

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.as_buffer().to_pybytes() for t in batch["text"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], **{name: pa.array([fingerprint(d, k) for d in data], pa.int64()) for name, k in lengths.items()}})

    return id_and_text(docs, id_col, text_col).mapInArrow(lean(hashed), ", ".join(["doc_id long", *(f"{name} long" for name in lengths)]))


def ball(distance: int) -> list[tuple[int, int]]:
    """(kept bits, change) of each variant: blocks left out and marked there, at most one kept bit changed."""
    ends, gone = CUTS[min(d for d in CUTS if d >= distance)]
    out, signed = [], lambda x: x - (1 << 64) if x >> 63 else x
    for k, chosen in enumerate(combinations(range(len(ends) - 1), gone)):
        left_out = {b for c in chosen for b in range(ends[c], ends[c + 1])}
        keep, mark = sum(1 << b for b in range(64) if b not in left_out), (k + 1) << ends[chosen[0]]
        out += [(signed(keep), signed(mark | change)) for change in (0, *(1 << b for b in range(64) if b not in left_out))]
    return out


def forest(members: np.ndarray, checks: np.ndarray | None, distance: int, verify_distance: int) -> list[tuple[int, int]]:
    """Links that connect those of the members which links connect."""
    rest, at = np.unique(members, return_index=True)
    checks, out = np.zeros(len(rest), "i8") if checks is None else checks[at], []
    while len(rest) > 1:
        queue, rest, checks = [(rest[0], checks[0])], rest[1:], checks[1:]
        while queue and len(rest):
            p, c = queue.pop()
            near = linked(rest, p, checks, c, distance, verify_distance)
            if near.any():
                queue += list(zip(rest[near], checks[near], strict=True))
                out += [(int(p), int(x)) for x in rest[near]]
                rest, checks = rest[~near], checks[~near]
    return out


def linked(a: np.ndarray, b: np.ndarray, a_check: np.ndarray | None, b_check: np.ndarray | None, distance: int, verify_distance: int) -> np.ndarray:
    near = np.bitwise_count((a ^ b).view("u8")) <= distance
    return near if a_check is None else near & (np.bitwise_count((a_check ^ b_check).view("u8")) <= verify_distance)


def fingerprint_links(prints: DataFrame, distance: int = 3, verify_distance: int = 14) -> DataFrame:
    """(a, b) links that connect distinct fingerprints at most ``distance`` (6 or less) bits apart.

    Where prints have a column ``check``, those are also at most ``verify_distance`` bits apart.
    """
    if not 0 <= distance <= max(CUTS):
        raise ValueError(f"balls of radius 1 with blocks left out reach {max(CUTS)} bits")
    checked = "check" in prints.columns
    carried = ["fingerprint", "check"] if checked else ["fingerprint"]
    variants = F.array(*[F.struct(F.lit(keep).alias("keep"), F.lit(change).alias("change")) for keep, change in ball(distance)])
    spread = prints.select(*carried, F.explode(variants).alias("v"))
    spread = spread.select(F.col("fingerprint").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.change")).alias("variant"), *carried)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = np.zeros(0, "i8"), np.zeros(0, "i8")  # of the last variant so far, which may go on
        check = np.zeros(0, "i8") if checked else None
        of = lambda at: None if check is None else check[at]
        for batch in (*batches, None):
            if batch is not None:
                key = np.concatenate([key, batch["variant"].to_numpy()])
                own = np.concatenate([own, batch["fingerprint"].to_numpy()])
                if checked:
                    check = np.concatenate([check, batch["check"].to_numpy()])
                if not len(key):
                    continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, "i8")
            done = len(key) if batch is None else int(starts[-1])
            ends = np.append(starts[1:], len(key))
            whole = (ends <= done) & (ends - starts > 1)
            two = starts[whole & (ends - starts == 2)]
            a, b = own[two], own[two + 1]
            near = (a != b) & linked(a, b, of(two), of(two + 1), distance, verify_distance)
            links = [np.stack([a[near], b[near]], 1)]
            for s, e in zip(starts[whole & (ends - starts > 2)].tolist(), ends[whole & (ends - starts > 2)].tolist(), strict=True):
                links.append(np.array(forest(own[s:e], of(slice(s, e)), distance, verify_distance), "i8").reshape(-1, 2))
            found = np.unique(np.concatenate(links), axis=0)
            key, own, check = key[done:], own[done:], of(slice(done, None))
            yield pa.record_batch({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

    return spread.repartition("variant").sortWithinPartitions("variant").mapInArrow(meet, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", verify_words: int | None = None, verify_distance: int = 14
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row.

    With ``verify_words`` a link also asks for fingerprints of shingles of so many words to be at most
    ``verify_distance`` bits apart (texts with equal fingerprints are always linked).  Texts without words, null
    ones included, have fingerprint zero and link like any other.  Rows that repeat get a result each; null ids
    take part but never name a component unless all its ids are null, when component_id is null.  An empty
    table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs, words, id_col, text_col, verify_words))
    carried = ["fingerprint", "check"] if verify_words else ["fingerprint"]
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in carried[1:]])
    roots = connected_components(fingerprint_links(distinct.select(*carried), distance, verify_distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    table = hot_lookup(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root", F.col("fingerprint"))
    told = hot_lookup(prints.select("doc_id", "fingerprint"), table.select("fingerprint", "component_id"), "fingerprint", F.col("doc_id"))
    return told.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: Of a wide fingerprint of 192 bits: blocks, and the bits of one, at most two of which may differ for texts to meet.
BLOCKS, BLOCK_BITS = 7, 27
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_shingles(data: bytes, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length a hash of every run of so many words (of all words if there are fewer), from the words' XXH64."""
    of = xxhash.xxh64_intdigest
    words = np.fromiter(map(of, data.lower().split()), "u8")
    out = []
    for k in lengths:
        k, runs = min(k, len(words)), np.zeros(max(0, len(words) - min(k, len(words)) + 1) if len(words) else 0, "u8")
        for j in range(k if len(words) else 0):
            runs = (runs ^ words[j : len(words) - k + 1 + j]) * MIX[0]
            runs ^= runs >> np.uint64(31)
        out.append(runs)
    return out


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if set in over half of the hashes."""
    octets = hashes.astype("<u8").view("u1").reshape(-1, 8)
    ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype="i8") if len(octets) < 400 else np.concatenate([np.bincount(octets[:, j], minlength=256) @ BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """Three times 64 bits, from the hashes mixed in three ways."""
    out = []
    for m in MIX:
        x = (hashes ^ (hashes >> np.uint64(30))) * m
        out.append(majority(x ^ (x >> np.uint64(27))))
    return out


WIDE = ["f0", "f1", "f2", "check"]


def wide_fingerprints(docs: DataFrame, words: int, check_words: int) -> DataFrame:
    """(doc_id, f0, f1, f2, check) of (doc_id, text): 192 bits of shingles of ``words`` words, 64 of ``check_words`` words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch["text"]:
                short, long = word_shingles(t.as_buffer().to_pybytes(), (words, check_words))
                rows.append([*wide_fingerprint(short), majority(long)])
            columns = np.array(rows, "i8").reshape(-1, 4)
            yield pa.record_batch([batch["doc_id"], *[pa.array(columns[:, j].copy()) for j in range(4)]], names=["doc_id", *WIDE])

    return docs.mapInArrow(lean(hashed), ", ".join(["doc_id long", *(f"{c} long" for c in WIDE)]))


def nested_forests(members: np.ndarray, checks: np.ndarray, levels: tuple[int, ...]) -> np.ndarray:
    """Links that connect, for each level, what links of at most so many differing check bits connect.

    Two members d bits apart are thus joined through links of at most the next level above d, so that a link that later
    fails on the texts hardly takes a better one along.  There is less than one link for each member; up to four members
    give all their links, six at most.
    """
    if 2 < len(members) <= 2048:  # those that are near no other are left out at once
        apart = np.bitwise_count((checks[:, None] ^ checks).view("u8"))
        kept = (apart <= levels[-1]).sum(1) > 1
        members, checks = members[kept], checks[kept]
    if len(members) < 2:
        return np.zeros((0, 2), "i8")
    if len(members) <= 4:
        a, b = np.nonzero(np.triu(np.bitwise_count((checks[:, None] ^ checks).view("u8")) <= levels[-1], 1))
        return np.stack([members[a], members[b]], 1)
    label, rest, links = np.arange(len(members)), np.arange(len(members)), []
    near = lambda p, among, level: np.bitwise_count((checks[among] ^ checks[p]).view("u8")) <= level
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            found = near(p, rest, levels[0])
            label[rest[found]] = label[p]
            links += [(p, x) for x in rest[found].tolist()]
            queue += rest[found].tolist()
            rest = rest[~found]
    for level in levels[1:]:
        kinds, sizes = np.unique(label, return_counts=True)
        for p in np.flatnonzero(label != kinds[np.argmax(sizes)]).tolist():  # links within the largest group are known
            found = np.flatnonzero(near(p, slice(None), level) & (label != label[p]))
            if len(found):
                others, at = np.unique(label[found], return_index=True)
                links += [(p, x) for x in found[at].tolist()]
                label[np.isin(label, others)] = label[p]
    return members[np.array(links, "i8").reshape(-1, 2)]


def block_links(prints: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """(a, b) links among (id, f0, f1, f2, check) that agree in all but two bits of a block and in all but levels[-1] of check.

    Each block emits its ball of radius 1, so two blocks at most two bits apart have a variant in common.  A variant's
    members give nested spanning forests, not all pairs.
    """
    ball = F.array(*[F.lit(c).cast("long") for c in (0, *(1 << b for b in range(BLOCK_BITS)))])

    def bits(j: int) -> Column:
        word, off = divmod(BLOCK_BITS * j, 64)
        low = F.shiftrightunsigned(F.col(f"f{word}"), off)
        over = low.bitwiseOR(F.shiftleft(F.col(f"f{word + 1}"), 64 - off)) if off + BLOCK_BITS > 64 else low
        return over.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))

    blocks = [F.struct(F.lit(j).alias("block"), bits(j).alias("bits")) for j in range(BLOCKS)]
    spread = prints.select("id", "check", F.explode(F.array(*blocks)).alias("b")).select("id", "check", "b", F.explode(ball).alias("change"))
    spread = spread.select(F.shiftleft(F.col("b.block").cast("long"), 32).bitwiseOR(F.col("b.bits").bitwiseXOR(F.col("change"))).alias("variant"), "id", "check")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, check = (np.zeros(0, "i8") for _ in range(3))  # of the last variant so far, which may go on
        for batch in (*batches, None):
            if batch is not None:
                key, own, check = (np.concatenate([x, batch[c].to_numpy()]) for x, c in ((key, "variant"), (own, "id"), (check, "check")))
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            done = len(key) if batch is None else int(starts[-1])
            ends = np.append(starts[1:], len(key))
            whole = (ends <= done) & (ends - starts > 1)
            two = starts[whole & (ends - starts == 2)]
            near = np.bitwise_count((check[two] ^ check[two + 1]).view("u8")) <= levels[-1]
            links = [np.stack([own[two], own[two + 1]], 1)[near]]
            more = whole & (ends - starts > 2)
            links += [nested_forests(own[s:e], check[s:e], levels) for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True)]
            found = np.unique(np.sort(np.concatenate(links), axis=1), axis=0)
            key, own, check = key[done:], own[done:], check[done:]
            yield pa.record_batch({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

    return spread.repartition("variant").sortWithinPartitions("variant").mapInArrow(meet, "a long, b long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and shingles (the distinct hashes, in order) of (doc_id, text)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(word_shingles(t.as_buffer().to_pybytes(), (words,))[0]).view("i8") for t in batch["text"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], "shingles": pa.array(found, pa.list_(pa.int64()))})

    return docs.mapInArrow(lean(listed), "doc_id long, shingles array<long>")


def similar_documents(docs: DataFrame, words: int = 2, id_col: str = "doc_id", text_col: str = "text", verify_words: int = 5, levels: tuple[int, ...] = (6, 10, 13, 17), similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the ids that links of verified similarity connect; others are not listed.

    Every text has 192 bits of its shingles of ``words`` words in seven blocks, and 64 of its shingles of ``verify_words``
    words.  Texts that agree in all but two bits of one block and in all but levels[-1] of the 64 are candidates; texts that
    agree in all of them are compared with the one of least id.  A pair is linked if the sets of ``verify_words``-word
    shingles of the whole texts have a Jaccard similarity of ``similarity`` or more.  Where up to four candidates meet
    all their pairs are compared, where more meet nested forests of them (all pairs would grow with a group's square).

    Null texts are empty; null ids take no part; rows with one id count as one document, alike if any of its texts is; an
    empty table gives an empty result.
    """
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    prints = checkpointed(wide_fingerprints(texts, words, verify_words))
    alike = checkpointed(prints.groupBy(*WIDE).agg(F.min("doc_id").alias("id")))
    links = block_links(alike, levels).select(F.col("a").alias("x"), F.col("b").alias("y"))
    known = F.struct(*WIDE).alias("known")
    same = hot_lookup(prints.select("doc_id", known), alike.select(known, "id"), "known", F.col("doc_id")).select(F.col("id").alias("x"), F.col("doc_id").alias("y"))
    held = verified(texts, links.unionByName(same).where("x <> y").distinct(), verify_words, similarity).where("held")
    groups = connected_components(held.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return groups.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def verified(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(x, y, held): whether the sets of shingles of two documents' whole texts are as similar as asked for."""
    pairs = checkpointed(pairs).withColumn("s", F.pmod(F.xxhash64("x", "y"), F.lit(32)))  # a text may have very many links, and copies of its set for them
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()
    sets = checkpointed(shingle_sets(texts.join(wanted, "doc_id", "left_semi"), words).distinct())
    side = lambda key, name: pairs.select(key, "s").distinct().join(sets.toDF(key, name), key)
    both = pairs.join(side("x", "a"), ["x", "s"]).join(side("y", "b"), ["y", "s"]).select("x", "y", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size(F.array_intersect("a", "b")).alias("both"))
    alike = F.col("both") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("both"))
    return both.groupBy("x", "y").agg(F.bool_or(alike).alias("held"))


def drop_near_duplicates(docs: DataFrame, words: int = 2, id_col: str = "doc_id", text_col: str = "text", verify_words: int = 5, levels: tuple[int, ...] = (6, 10, 13, 17), similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar documents, that of the least id; rows with null ids stay; all columns stay.

    Of two texts that share 0.8 of their 5-word shingles about 0.115 of the bits of 2-word shingles differ: a block of 27
    is then within two bits with 0.39, one of seven blocks with 0.97.  Of the 64 bits of 5-word shingles they differ in
    9.7; 17 is 2.5 standard deviations more, and the shingles themselves decide.
    """
    losers = similar_documents(docs, words, id_col, text_col, verify_words, levels, similarity).where("doc_id <> component_id").select("doc_id")
    return without(docs, id_col, losers)
