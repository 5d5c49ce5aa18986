import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as C
from tessera.llm import queries

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, words int, ids string"


def plain(rows, least, top=2000, most=5, percent=100):
    """[(lang, rank, phrase, a, l, r, n, score)] from (text, lang)."""
    counts, n = {}, Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
            if any(inside(q) and 100 * b >= percent * a for q, b in held.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(queries.oracle_sql()["op13_collocations"])
    got = queries.op13_collocations(spark, sf)
    assert rel.columns == got.columns and [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    want = sorted(rel.fetchall())
    assert rows_of(got) == want and len(want) > 20


@pytest.mark.parametrize(("least", "percent", "shard"), [(4, 100, 1 << 20), (3, 70, 50), (2, 100, 7)])
def test_random_texts_match_plain_python(spark, least, percent, shard):
    rng, rows = random.Random(least), []
    words = ["the", "New", "york", "Éa", "b-c", "x" * 300, "\x00", "..", "a", "b"]
    for i in range(160):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " , "]) for _ in range(rng.randrange(40)))
        rows.append((i, rng.choice([text, text, "big Red fox jumps over " * rng.randrange(4)]), rng.choice(["en", "en", "en", None, "und", "de"])))
    rows += [(None, None, "en"), (3, "", "en"), (3, rows[5][1], "en"), (3, rows[5][1], "en")]
    df = spark.createDataFrame([(*r, "p", 1, 2, "i") for r in rows], SCHEMA).repartition(3)
    got = C.collocations(df, least=least, top=40, subsumed_percent=percent, shard_words=shard, filter_bits=10 if least == 2 else 16, block_bytes=64 if shard == 7 else 1 << 20, range_words=100 if shard == 50 else 1 << 22)
    want = plain([r[1:] for r in rows], least, 40, percent=percent)
    assert rows_of(got) == want and len(want) > 10


def test_long_texts_without_ends_are_cut_with_context(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(30_000))
    data = text.encode().translate(C.SMALL)
    parts = list(C.blocks(data, 1000))
    assert sum(len(w) for w, _, _ in parts) == 30_000 and [goes for _, _, goes in parts] == [True] * (len(parts) - 1) + [False]
    rows = [(text, "en"), ("q " * 5, "en"), ("x" * 3000 + " a b", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert rows_of(C.collocations(df, least=20, shard_words=1000, block_bytes=512)) == plain(rows, 20)


def test_context_is_not_counted_twice():
    rng = random.Random(2)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(3000)]
    known = C.Known(12)
    known.held[:] = 255  # everything is known
    whole, cut = Counter(), Counter()
    for into, sizes in ((whole, [3000]), (cut, [700, 3, 1, 1500, 796])):
        at = 0
        for k, size in enumerate(sizes):
            shard = C.Shard(words[max(0, at - 4) : at] if k else [])
            shard.add(words[at : at + size], np.zeros(1 if not k else 0, "i8"))
            _, skip, names, counts, ids = shard.row("en")
            ids = np.frombuffer(ids, "<i4")
            for m in range(2, 6):
                for e, n, _ in zip(*C.counted(ids, skip, C.word_hashes("en", names), m, known), strict=True):
                    into[tuple(names[x] for x in ids[e - m + 1 : e + 1])] += int(n)
            into["n"] += int(counts.sum())
            at += size
    assert whole == cut and whole["n"] == 3000
    assert whole == Counter(tuple(words[i : i + m]) for m in range(2, 6) for i in range(3001 - m)) + Counter({"n": 3000})


def test_runs_are_packed_and_unpacked():
    for numbers in ([], [0], [1, 2**32 - 1, 77, 0, 256]):
        x = np.array(numbers, "i8")
        assert C.unpacked(C.packed(x), len(x)).tolist() == numbers


def test_products_beyond_64_bits(spark):
    row = spark.range(1).select(F.expr("(cast(4000000000000 as decimal(19,0)) * cast(9000000000000 as decimal(19,0)) * cast(1000 as decimal(4,0))) div (cast(5000000000001 as decimal(19,0)) * cast(4000000000003 as decimal(19,0)))").alias("x")).first()
    assert row.x == 4000000000000 * 9000000000000 * 1000 // (5000000000001 * 4000000000003)


def test_empty_tables(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, "", 1, 1, "")], SCHEMA), least=1).count() == 0
