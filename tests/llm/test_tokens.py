import functools
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe_trie, packing, queries, wavelet
from tessera.llm._items import default_path, library_items
from tessera.llm.wavelet import Shard, build_shard

WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
ALPHABETS = ["ab", "aab 'st", "hello wrd", "éèaßZΣςİ ́x1١二", "0123 .,!?<|>", "<|endoftext|> a", "\x1c\x85\xa0\t\n a b", "😀👍🏽 zz'll", " \n a", " \n"]
HARD = [None, "", " ", "a<|endoftext|>b c", "foo <|endoftext|> bar", "don't I'LL WE'RE", "x" * 5000, "the cat " * 3000]
SCHEMA = "doc_id long, text string, ids string, n_tokens int, part string"


def texts(n: int = 300) -> list:
    random.seed(5)
    return HARD + ["".join(random.choices(random.choice(ALPHABETS), k=random.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "clash", 1, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], (None, "null id", "c", 1, "c")], SCHEMA)


tokenizer = functools.cache(Tokenizer.from_file)


def library(path, t):
    return tokenizer(path).encode(t or "", add_special_tokens=False).ids


def test_trie_matches_library(spark, hard):
    got = bpe_trie.encode_corpus(hard, WORD).collect()
    source = {i: t for i, t in enumerate(texts())} | {None: "null id"}
    lib = Tokenizer.from_file(WORD)
    assert len(got) == hard.count()
    for r in got:
        want = library(WORD, source[r.doc_id])
        assert r.ids == want
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
    back = {r.doc_id: r.text for r in bpe_trie.decode_corpus(bpe_trie.encode_corpus(hard, WORD), WORD).collect()}
    assert back == {r.doc_id: r.decoded for r in got}


def test_digests_on_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lib = Tokenizer.from_file(WORD)
    got = queries.op2_bpe_trie(spark, sf).collect()
    assert {r.doc_id for r in got} == docs.keys()
    for r in got:
        ids = lib.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_long_words_take_little_memory():
    random.seed(2)
    word = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    coder = bpe_trie.WordTokenizer(WORD)
    tracemalloc.start()
    ids = np.frombuffer(coder.encode([word])[0], "<u4").tolist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == library(WORD, word)
    assert most < 100e6 and not coder.known


def test_ambiguous_vocabulary_is_refused():
    with pytest.raises(ValueError, match="two merges"):
        bpe_trie.TrieBpe({"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], "")


def check_packing(rows, ids_of, capacity):
    covered, windows = {}, {}
    for r in rows:
        whole = ids_of(r.doc_id)
        piece = np.array(whole[r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length > 0 and r.doc_tokens == len(whole) and zlib.crc32(piece.tobytes()) == r.ids_crc32
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        assert sum(n for _, n in parts) <= capacity
    return covered, windows


def test_packing_covers_each_id_once(spark, hard):
    source = {i: t for i, t in enumerate(texts())} | {None: "null id"}
    cache = {}
    ids_of = lambda d: cache.setdefault(d, [*library(WORD, source[d]), 2])
    covered, windows = check_packing(packing.pack_documents(hard, WORD, capacity=256, group_pieces=40).collect(), ids_of, 256)
    for d, parts in covered.items():
        assert sorted(parts)[0][0] == 0 and sum(n for _, n in parts) == len(ids_of(d)) * (2 if d == 3 else 1)
    assert covered.keys() == source.keys()
    slack = sum(256 - sum(n for _, n in w) for w in windows.values())
    assert slack < 256 * 3


def test_packing_fills_exactly():
    windows = packing.fill_windows([5, 5, 4, 3, 3], 10)
    assert sorted(map(sorted, windows)) == [[3, 3, 4], [5, 5]]
    random.seed(2)
    lengths = [random.randint(1, 4095) for _ in range(2000)]
    windows = packing.fill_windows(lengths, 4096)
    assert sorted(n for w in windows for n in w) == sorted(lengths)
    assert all(sum(w) <= 4096 for w in windows)
    assert len(windows) <= 1.02 * sum(lengths) / 4096 + 1


def test_wavelet_answers_like_an_array():
    rng = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 1), (63, 2), (1000, 50_257), (5000, 7)):
        ids = rng.integers(0, top, n).astype("<u4")
        shard = Shard(build_shard(np.arange(2), np.array([n, 0]), ids, 16))
        assert shard.tokens().tolist() == ids.tolist()
        for i in range(0, n, max(1, n // 50)):
            token = int(ids[i])
            assert shard.access(i) == token
            assert shard.locate(token)[:40] == np.flatnonzero(ids == token).tolist()[:40]
            assert shard.count(token, i // 2, i) == int((ids[i // 2 : i] == token).sum())
        assert shard.count(60_000) == 0 and shard.count(70_000) == 0 and shard.count(-1) == 0
        with pytest.raises(IndexError):
            shard.select(70_000, 0)


def test_wavelet_over_several_chunks_unpacks_few(monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK", 256)
    rng = np.random.default_rng(4)
    for n, levels in ((5000, 17), (256, 3), (512, 1), (257, 20)):
        ids = rng.integers(0, 1 << levels, n).astype("<u4")
        ids[rng.integers(0, n, n // 2)] = 1
        data = build_shard(np.arange(1), np.array([n]), ids, levels)
        assert Shard(data).tokens().tolist() == ids.tolist()
        shard = Shard(data)
        assert shard.access(n // 2) == ids[n // 2] and len(shard.words) <= levels
        assert shard.locate(1) == np.flatnonzero(ids == 1).tolist()
        for i in (0, 255, 256, n - 1, n):
            assert shard.count(1, 0, min(i, n)) == int((ids[:i] == 1).sum())


def test_ids_beyond_the_planes_are_refused():
    with pytest.raises(ValueError, match="planes"):
        build_shard(np.arange(1), np.array([3]), np.array([70_000, 65_536, 3], "<u4"), 16)
    assert Shard(build_shard(np.arange(1), np.array([3]), np.array([70_000, 65_536, 3], "<u4"), 17)).tokens().tolist() == [70_000, 65_536, 3]
    assert wavelet.planes_of(BYTE, 0) == 16 and wavelet.planes_of(BYTE, 1 << 16) == 17


def whole_documents(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_packing_query_on_documents(spark, sf):
    docs, cache = whole_documents(spark, sf), {}
    ids_of = lambda d: cache.setdefault(d, [*library(WORD, docs[d]), 2])
    covered, windows = check_packing(queries.op8_packing(spark, sf).collect(), ids_of, 4096)
    assert covered.keys() == docs.keys()
    assert all(sum(n for _, n in p) == len(ids_of(d)) for d, p in covered.items())
    assert all(a + n == b for p in covered.values() for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:]))
    total = sum(map(len, cache.values()))
    assert len(windows) * 4096 < 1.05 * total + 4096


def test_wavelet_query_on_documents(spark, sf):
    docs, at = whole_documents(spark, sf), 0
    got = {r.doc_id: r for r in queries.op10_wavelet(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for d in sorted(docs):
        ids = [*library(BYTE, docs[d]), 0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_counts_and_places_over_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    wavelet.write_shards(docs, str(tmp_path / "s"), BYTE, shard_bytes=1 << 14, shard_ids=3000)
    every = [i for _, t in sorted((r.doc_id, r.text or "") for r in docs.collect()) for i in [*library(BYTE, t), 0]]
    asked = [0, every[5], every[-2], 50_256, 1 << 20]
    assert {r.token: r.n for r in wavelet.count_tokens(spark, str(tmp_path / "s"), asked).collect()} == {t: every.count(t) for t in set(asked)}
    places = sorted((r.token, r.position) for r in wavelet.locate_tokens(spark, str(tmp_path / "s"), asked, most=7).collect())
    assert places == sorted((t, k) for t in set(asked) for k, x in enumerate(every) if x == t)


def test_counts_and_places_of_nulls_repeats_and_no_shards(spark, tmp_path):
    rows = [(1, "a b a"), (1, "a b a"), (2, None), (None, "a"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wavelet.write_shards(docs, str(tmp_path / "s"), BYTE)
    wavelet.write_shards(docs.where("false"), str(tmp_path / "none"), BYTE)
    every = [i for _, t in rows for i in [*library(BYTE, t or ""), 0]]
    asked = [0, 0, every[0], -1, 1 << 40, 12_345]
    assert {r.token: r.n for r in wavelet.count_tokens(spark, str(tmp_path / "s"), asked).collect()} == {t: every.count(t) for t in set(asked)}
    places = [(r.token, r.position) for r in wavelet.locate_tokens(spark, str(tmp_path / "s"), asked).collect()]
    assert len(places) == every.count(0) + every.count(every[0]) == len(set(places)) and {t for t, _ in places} == {0, every[0]}
    assert wavelet.count_tokens(spark, str(tmp_path / "none"), asked).count() == wavelet.locate_tokens(spark, str(tmp_path / "none"), asked).count() == 0


def test_repeated_rows_are_dealt_out(spark):
    docs = spark.createDataFrame([(7, "same words again")] * 400, "doc_id long, text string")
    packed = packing.pack_documents(docs, WORD, capacity=16, group_pieces=40).collect()
    assert len(packed) == 400 and len({r.sequence_id >> 24 for r in packed}) > 5


def test_shards_round_trip(spark, hard, tmp_path):
    wavelet.write_shards(hard, str(tmp_path / "s"), BYTE, shard_bytes=4096)
    got = wavelet.read_documents(spark, str(tmp_path / "s")).collect()
    source = {i: t for i, t in enumerate(texts())} | {None: "null id"}
    order = [None, 0, 1, 2, 3, 3, *range(4, len(source) - 1)]
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == order
    at = 0
    for r in by_start:
        ids = [*library(BYTE, source[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_trie.encode_digests(none, WORD).count() == 0
    assert packing.pack_documents(none, WORD).count() == 0
    wavelet.write_shards(none, str(tmp_path / "e"), BYTE)
    assert wavelet.read_documents(spark, str(tmp_path / "e")).count() == 0


def test_items_whole_texts_with_loose_spaces():
    items, lib = library_items(BYTE, True), Tokenizer.from_file(BYTE)
    import pyarrow as pa

    some = [t or "" for t in texts(2000)]
    ids, offsets = items.ids(pa.array(some))
    for k, t in enumerate(some):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids
