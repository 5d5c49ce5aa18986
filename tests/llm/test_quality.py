import re
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import queries, quality

PROSE = "\n".join(f"Here w{i} goes x{i} with y{i} and z{i}, then v{i}." for i in range(12))


def test_repeated_words_by_brute_force():
    @given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
    def check(words):
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        at = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert quality.repeated_words(words) == len(at)

    check()


def test_line_rules():
    rules = quality.Rules()
    fails = lambda line: quality.line_fails(line, False, rules)
    assert fails("Home | About | Contact") and fails("one### two*** three$$$") and fails("WOW!! BUY!! NOW!!") and fails("Contact us")
    assert fails("We use cookies: see our cookie policy.") and quality.line_fails("A fine line of words here.", True, rules)
    assert not fails("A fine line of words here.") and not fails("Done.") and not fails("a | b with a single bar in a sentence that goes on for some words")


def test_documents(spark, sf):
    rows = [(1, PROSE), (2, None), (3, ""), (4, "a | b | c | d\n" * 30 + PROSE), (5, "one### two*** " * 60), (6, "same words here " * 100), (6, "same words here " * 100), (None, PROSE), (7, PROSE + "\nHome | About | Us")]
    docs = spark.createDataFrame([(d, t, 7, "x", True) for d, t in rows], "doc_id long, text string, n_words long, lang string, kept boolean")
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    assert {d for d, r in got.items() if r.kept} == {1, None, 7}
    assert got[2].n_words == 0 and got[2].base_failed and got[6].n_repeat_words == got[6].n_words
    left = quality.clean(docs).collect()
    assert quality.clean(docs).columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted((str(d), PROSE) for d in (1, None, 7))
    assert quality.assess(docs.limit(0)).count() == 0 and quality.clean(docs.limit(0)).count() == 0


def test_query_counts(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5_quality(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", texts[r.doc_id]))
        lines = Counter(x for x in texts[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        assert r.n_dup_lines == sum(n - 1 for n in lines.values())
        assert r.kept <= (not r.base_failed)


def test_labelled_quality_follows(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op5_quality(spark, sf).collect()}
    good = [got[d] for d, q in labels.items() if q == 1 and d in got and not got[d].base_failed]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
