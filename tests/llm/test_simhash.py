import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import queries, simhash
from tessera.llm.components import connected_components


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: [(id, fingerprint)] -> {id: least id reachable}."""
    ids, values = [i for i, _ in prints], np.array([v for _, v in prints], "u8")
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            root[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_query_matches_brute_force(spark, sf):
    prints = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_components(prints)
    got = queries.op3_simhash(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint) for r in got} == {(d, f"{p:016x}") for d, p in prints}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


def test_links_reach_three_bits_and_no_further(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:40]:
        values += [v ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 3, 4)]
    centre = rng.getrandbits(64)
    values += [centre ^ 1 << b for b in range(64)]  # a dense group
    signed = [v - (1 << 64) if v >> 63 else v for v in dict.fromkeys(values)]
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = {r.node: r.root for r in connected_components(simhash.fingerprint_links(prints)).collect()}
    want = brute_components([(v, v % (1 << 64)) for v in signed])
    assert {v: roots.get(v, v) for v in signed} == want


def test_edges_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "É a b c"), (7, "É a b c"), (7, "É a b c"), (None, "é a b c"), (8, "w " * 40_000)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fingerprint string, component_id int")
    got = simhash.near_duplicates(docs)
    assert got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, r)
    assert by[1].fingerprint == by[3].fingerprint == "0" * 16 and by[2].component_id == 1
    assert by[5].component_id == 4 and by[7].component_id == 6 and by[8].component_id == 8
    for d, t in rows[:-1]:
        assert by[d].fingerprint == f"{brute_print(t):016x}"
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "4", "6", "8", "None"]
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0
    assert simhash.similar_documents(docs.where(F.lit(False))).count() == 0


def test_long_chains_of_links(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(links).collect()} == {0}
    assert connected_components(links).count() == 301


def test_distance_beyond_reach_is_refused(spark):
    with pytest.raises(ValueError, match="6 bits"):
        simhash.fingerprint_links(spark.createDataFrame([], "fingerprint long"), 7)


@pytest.mark.parametrize("distance", [4, 6])
def test_wider_links_by_brute_force(spark, distance):
    rng = random.Random(distance)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:60]:
        values += [v ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (4, 5, 6, 6, 7)]
    checks = {v: rng.choice([0, (1 << 14) - 1, (1 << 15) - 1]) for v in values}
    signed = {v - (1 << 64) if v >> 63 else v: c for v, c in checks.items()}
    got = simhash.fingerprint_links(spark.createDataFrame(list(signed.items()), "fingerprint long, check long"), distance, verify_distance=14)
    roots = {r.node: r.root for r in connected_components(got).collect()}
    nodes = list(signed)
    bits, marks = np.array(nodes, "i8"), np.array(list(signed.values()), "i8")
    least, seen = {}, set()
    for i in range(len(nodes)):
        queue, members = [i], []
        while queue:
            j = queue.pop()
            if j in seen:
                continue
            seen.add(j)
            members.append(nodes[j])
            near = (np.bitwise_count((bits ^ bits[j]).view("u8")) <= distance) & (np.bitwise_count((marks ^ marks[j]).view("u8")) <= 14)
            queue += np.flatnonzero(near).tolist()
        least |= {m: min(members) for m in members}
    assert {v: roots.get(v, v) for v in nodes} == least


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_copies_are_dropped_and_others_stay(spark, sf):
    rng, texts = random.Random(8), {}
    words = [f"w{k}" for k in range(3000)]
    for d in range(60):
        texts[d] = [rng.choice(words) for _ in range(300)]
        copy = list(texts[d])
        for at in rng.sample(range(300), 3):  # similarity of about 0.9
            copy[at] = rng.choice(words)
        texts[1000 + d] = copy
        texts[2000 + d] = texts[d][:100] + [rng.choice(words) for _ in range(200)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert left >= set(range(60)) | set(range(2000, 2060))
    assert len(left & set(range(1000, 1060))) <= 1


def test_every_text_of_one_fingerprint_is_compared(spark):
    """1 and 2 hold the same blocks of three words in other orders, 3 is 2 with a word changed."""
    rng = random.Random(12)
    blocks = [[f"a{k}", f"b{k}", f"c{k}"] for k in range(120)]
    one = [w for b in blocks for w in b]
    rng.shuffle(blocks)
    two = [w for b in blocks for w in b]
    three = [*two[:200], "changed", *two[201:]]
    texts = {1: " ".join(one), 2: " ".join(two), 3: " ".join(three)}
    assert jaccard(shingles(texts[2]), shingles(texts[3])) > 0.9 > 0.5 > jaccard(shingles(texts[1]), shingles(texts[2]))
    for held in ([1, 2, 3], [2, 3]):
        got = simhash.similar_documents(spark.createDataFrame([(d, texts[d]) for d in held], "doc_id long, text string"))
        assert sorted(map(tuple, got.collect())) == [(2, 2), (3, 2)]


def test_recall_by_similarity_of_planted_copies(spark, sf):
    """Pairs of a text and a copy with words replaced here and there, and in runs: 0.9 of each band end in one group."""
    rng, rows, alike = random.Random(9), [], {}
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 400 and 9000").orderBy("doc_id").limit(420).collect()]
    vocabulary = sorted({w for t in texts for w in t.split()})
    for d, text in enumerate(texts):
        words = text.split()
        share = rng.uniform(0.002, 0.028)
        if d % 3:
            copy = [rng.choice(vocabulary) if rng.random() < share else w for w in words]
        else:  # a run of words replaced, and some left out
            at, n = rng.randrange(len(words)), max(1, int(len(words) * 4 * share))
            copy = words[:at] + [rng.choice(vocabulary) for _ in range(n)] + words[at + n :]
        alike[d] = jaccard(shingles(text), shingles(" ".join(copy)))
        rows += [(2 * d, text), (2 * d + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        band = [d for d, j in alike.items() if low <= j < high]
        found = [d for d in band if got.get(2 * d, -1) == got.get(2 * d + 1, -2)]
        assert len(band) >= 20 and len(found) >= 0.9 * len(band), (low, len(found), len(band))


def true_pairs(texts):
    """All pairs of 0.8 or more, by the shingles that they share."""
    sets, by = {d: shingles(t) for d, t in texts.items()}, {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    shared = set()
    for d, s in sets.items():
        near = {}
        for x in s:
            for o in by[x]:
                if o < d:
                    near[o] = near.get(o, 0) + 1
        shared |= {(o, d) for o, n in near.items() if n >= 0.8 * (len(s) + len(sets[o]) - n)}
    return shared


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_the_true_pairs_of_a_table(spark, size):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"/root/testdata/{size}/documents.parquet").collect()}
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    texts = {d: t for t, d in first.items()}  # exact copies would be easy pairs
    pairs = true_pairs(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    found = [p for p in pairs if got.get(p[0], -1) == got.get(p[1], -2)]
    assert len(found) >= 0.9 * len(pairs), (len(found), len(pairs))
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(b)] = find(a)
    assert all(find(d) == find(c) for d, c in got.items())  # nothing is joined that no chain of such pairs joins


def test_similar_documents_are_verified_on_whole_shingle_sets(spark):
    rng, rows, sets = random.Random(9), [], {}
    words = [f"w{k}" for k in range(3000)]
    for d in range(40):
        text = [rng.choice(words) for _ in range(400)]
        for k, n in enumerate((0, 4, 7, 9, 11, 14)):  # similarities from above 0.9 to about 0.7
            copy = list(text)
            for at in rng.sample(range(400), n):
                copy[at] = rng.choice(words)
            rows.append((d + 100 * k, " ".join(copy)))
    rows += [(5000 + d, t) for d, t in rows[:120:6]] + [(None, rows[0][1]), (6000, None), (6001, " "), (7000, "a B c"), (7000, "other words"), (7001, "A b C")]
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    alike = lambda x, y: any(jaccard(a, b) >= 0.8 for a in sets[x] for b in sets[y])
    for d, c in got.items():
        others = [x for x, y in got.items() if y == c and x != d]
        assert c == min([d, *others]) and any(alike(d, x) for x in others)
    assert all(got[d] == got[5000 + d] for d in range(20)) and got[6001] == 6000 and got[7001] == 7000
    assert None not in got and sum(got.get(d) == got.get(d + 100, -1) for d in range(40)) >= 39


def test_few_texts_that_meet_are_all_compared(spark):
    """1 and 2 are alike, 3 is less alike to both but nearer by its fingerprint: its links fail and take none along."""
    members, checks = np.array([10, 20, 30]), np.array([0, 0b11111111111, 0b11111])  # 11, 5 and 6 bits apart
    assert sorted(map(tuple, simhash.nested_forests(members, checks, (6, 10, 13, 17)).tolist())) == [(10, 20), (10, 30), (20, 30)]
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id in (1, 255, 948)").collect()}
    alike = {(a, b) for a in texts for b in texts if a < b and jaccard(shingles(texts[a]), shingles(texts[b])) >= 0.8}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert alike == {(1, 255)} and got == {1: 1, 255: 1}


def test_a_hot_group_of_near_copies(spark):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for d in range(2000):
        copy = list(base)
        copy[rng.randrange(200)] = rng.choice(words)
        rows.append((d, " ".join(copy)))
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 2000 and {r.component_id for r in got} == {0}


def test_nested_forests_connect_at_every_level():
    rng = np.random.default_rng(3)
    checks = np.concatenate([rng.integers(-(1 << 62), 1 << 62, 6)] * 9)
    checks ^= np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in range(54)], "u8").view("i8")
    links = simhash.nested_forests(np.arange(54), checks, (6, 10, 17))
    apart = np.bitwise_count((checks[:, None] ^ checks).view("u8"))
    for level in (6, 10, 17):
        of = lambda pairs: brute_groups(54, pairs)
        assert of([(a, b) for a, b in links if apart[a, b] <= level]) == of(np.argwhere(apart <= level))
    assert len(links) <= 53
    assert len(simhash.nested_forests(np.arange(4), np.zeros(4, "i8"), (6, 10, 17))) == 6


def brute_groups(n, pairs):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root
