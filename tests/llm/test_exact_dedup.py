import re

from pyspark.sql import functions as F

from tessera.llm import exact_dedup

ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (7, " "), (8, "\n"), (4, "a\xa0b"), (None, "solo"), (6, "x" * 200_000), (10, "x" * 200_000), (11, "dup"), (11, "dup"), (None, "dup")]


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(d)
    out = []
    for d, t in rows:
        g = groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")]
        keep = min((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep))
    return sorted(out, key=str)


def table(spark):
    return spark.createDataFrame([(d, t, "x", "y", 1, True) for d, t in ROWS], "doc_id long, text string, content string, digest string, salt int, kept boolean")


def test_matches_brute_force(spark):
    got = exact_dedup.exact_duplicates(table(spark)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(ROWS)


def test_colliding_digests_fall_back_to_content(spark):
    got = exact_dedup.exact_duplicates(table(spark), digest=lambda c: F.lit("same")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == brute(ROWS)


def test_drop_keeps_columns_and_winners(spark):
    left = exact_dedup.drop_exact_duplicates(table(spark))
    assert left.columns == table(spark).columns
    # of the two rows with id 11 and one text, one stays
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted({str(d) for d, _, _, kept in brute(ROWS) if kept})
    rows = [(1, "a b"), (1, "a  b"), (1, "a b"), (None, "c"), (None, "c"), (2, "d")]
    some = spark.createDataFrame([(d, t, {"k": t}) for d, t in rows], "doc_id long, text string, row map<string,string>")
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_exact_duplicates(some).collect()) == [("1", "a  b"), ("2", "d"), ("None", "c")]


def test_empty(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
