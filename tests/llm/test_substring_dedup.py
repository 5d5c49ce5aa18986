import hashlib
import random

import numpy as np

from tessera.llm import queries, substring_dedup, suffix_blocks


def brute(rows, depth=50):
    data = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in data:
        for i in range(len(b) - depth + 1):
            w = b[i : i + depth]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if least[b[i : i + depth]] < d:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert sum(x[2] for x in want) > 0
    assert sorted(map(tuple, queries.op9_suffix_dedup(spark, sf).collect())) == want
    small = substring_dedup.span_digests(spark.read.parquet(f"{sf}/documents.parquet"), block_bytes=1 << 15)
    assert sorted(map(tuple, small.collect())) == want
    for hot in (1, 6):
        split = substring_dedup.span_digests(spark.read.parquet(f"{sf}/documents.parquet"), block_bytes=1 << 16, hot_segments=hot)
        assert sorted(map(tuple, split.collect())) == want


def test_planted_passages(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdé", k=rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage, other = prose(30), "z" * 49
    rows = [(i, prose(20) + passage + prose(rng.randint(0, 30))) for i in range(30)]
    rows += [(40, passage[:50]), (41, passage[:49]), (42, None), (43, ""), (44, other), (45, other + "z"), (46, other + "zz" * 90), (47, "é" * 60), (48, "é" * 60), (49, "ab" * 5000), (50, "ab" * 40_000)]
    rows += [(51, rows[3][1]), (51, rows[3][1]), (52, prose(10)), (52, prose(50)), (-3, passage + passage)]
    docs = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], "doc_id long, text string, part string, key string, ids int")
    want = brute([r for r in rows])
    for size, hot in ((8 << 20, 1 << 20), (3000, 1 << 20), (8 << 20, 3), (3000, 3)):
        assert sorted(map(tuple, substring_dedup.span_digests(docs, block_bytes=size, hot_segments=hot).collect())) == want
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeated_spans(docs).collect()}
    assert left[-3] == passage + passage and left[40] == "" and left[44] == other


def test_null_ids_and_empty_table(spark):
    t = "some passage that is long enough to be found in both of the documents here"
    got = substring_dedup.span_digests(spark.createDataFrame([(None, t), (1, t)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {None: 0, 1: len(t)}
    assert substring_dedup.span_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blockwise_sort_with_small_buckets(monkeypatch):
    monkeypatch.setattr(suffix_blocks, "BUCKET", 50)
    rng = np.random.default_rng(1)
    for letters in (1, 2, 4):
        text = rng.integers(97, 97 + letters, 3000).astype("u1")
        text[1000:1400] = text[100:500]
        starts = np.arange(0, 2900, 1)
        owner = rng.integers(0, 9, len(starts))
        raw = text.tobytes()
        least = {}
        for s, o in zip(starts, owner):
            least[raw[s : s + 50]] = min(o, least.get(raw[s : s + 50], 99))
        want = [least[raw[s : s + 50]] < o for s, o in zip(starts, owner)]
        assert suffix_blocks.windows_of_others(text, starts, owner, 50).tolist() == want


def test_cover_has_a_shift_for_each_pair():
    for a in range(suffix_blocks.PERIOD):
        for b in range(suffix_blocks.PERIOD):
            s = suffix_blocks.SHIFT[a, b]
            assert 0 <= s < suffix_blocks.PERIOD and (a + s) % suffix_blocks.PERIOD in suffix_blocks.COVER and (b + s) % suffix_blocks.PERIOD in suffix_blocks.COVER
