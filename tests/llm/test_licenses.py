import re

from tessera.llm import licenses, queries
from tessera.llm.license_texts import NOTICES, PHRASES


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_query_base_matches_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_licenses(spark, sf).collect()
    assert len(got) == len(texts) and any(r.n_base for r in got)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_planted(spark):
    mit = NOTICES[0][1]
    gappy = mit.replace("free of charge", "wholly free of any charge").replace("merge, publish", "publish")
    texts = [
        None, "", " ... ", "MIT License", "the mit license. apache-license; CC_BY gnu general public license gnu General Public LICENSE", "cc by cc by",
        mit, "word " * 70_000 + gappy + " tail" * 50, "permission is hereby granted", "x MIT License", "ÀMIT license", "mit", "permission " * 50, "general public license",
    ]
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4], rows[6], (None, mit, "x", 1, "y"), (4, "apache license", "x", 1, "y")], "doc_id long, text string, words string, pos int, label string")
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(texts) + 4
    for r in got:
        text = mit if r.doc_id is None else "apache license" if r.doc_id == 4 and r.n_words == 2 else texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        if r.doc_id in (6, 7, None):
            assert r.labels == "mit" and r.score > 0.6
        if r.doc_id in (8, 11, 12, 13):
            assert r.labels == "" and r.score == 0
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    spans = licenses.license_spans(docs).where("doc_id = 7").collect()
    assert len(spans) == 1 and spans[0].label == "mit" and 70_000 <= spans[0].first_word < 70_010


def test_words_are_exploded_and_hashed_in_one_generated_stage(spark, sf):
    """The array of a text's words must not be copied for each of its words: both explodes and the join are fused."""
    spans = licenses.license_spans(spark.read.parquet(f"{sf}/documents.parquet"))
    spans.collect()
    plan = spans._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    steps = [line for line in plan.splitlines() if "Generate posexplode(words" in line or "Generate explode(array(" in line]
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    stage = {re.search(r"\*\((\d+)\)", line)[1] for line in steps[:2] + joins[:1] if "*(" in line}
    assert len(steps) >= 2 and len(joins) >= 1 and len(stage) == 1, plan[:3000]
