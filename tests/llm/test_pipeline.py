"""The pipeline against plain Python, stage by stage."""

import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import quality, secrets  # noqa: E402
from tessera.llm._items import default_path  # noqa: E402


def test_stages_match_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    judged = {d: quality.judge(t, quality.Rules()) for d, t in texts.items()}
    texts = {d: j[8] for d, j in judged.items() if j[6]}
    seen: dict[str, int] = {}
    for d in sorted(texts):
        seen.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", texts[d]), d)
    texts = {d: texts[d] for d in sorted(seen.values())}
    rows = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, sf).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() for w in [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]}
    ids, root = sorted(texts), {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:  # the larger id goes under the smaller one
        root[max(find(a), find(b))] = min(find(a), find(b))
    should = {d for d in ids if find(d) == d}
    assert should <= left and len(left - should) <= 0.1 * len(ids) - 0.1 * len(should)  # all pairs, not the stage's own candidates
    forest = secrets.trained(spark)
    source = {r.doc_id: r.source for r in docs.collect()}
    texts = {d: secrets.redacted(texts[d], secrets.secrets_of(texts[d], source[d], forest, 0.5)) for d in left}
    lib = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        ids = np.array([*lib.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got.keys() == texts.keys() and len(got) < len(source)


def test_stages_keep_columns_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0


def test_edges_through_all_stages(spark, sf):
    prose = lambda k: " ".join(f"word{(i * k) % 97} goes on." for i in range(60))
    rows = [(1, None), (2, ""), (3, prose(3)), (3, prose(3)), (4, prose(3) + " "), (None, prose(5)), (None, prose(5)), (6, prose(7) * 300)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "clash", 2, True) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, row_id int, kept boolean")
    ids = []
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf)
        docs = spark.createDataFrame(result.collect(), result.schema)
        ids.append(sorted(str(r.doc_id) for r in docs.collect()))
    # null and empty texts and endless repeats go, rows that repeat leave one, a trailing space makes a near copy
    assert ids[:4] == [["3", "3", "4", "None", "None"], ["3", "4", "None"], ["3", "None"], ["3", "None"]]
    assert set(ids[4]) == {"3", "None"}
