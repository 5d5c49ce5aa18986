"""Registered queries of the corpus operators, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe_trie, chat_format, clustering, collocations, exact_dedup, licenses, packing, pii, quality, secrets, simhash, substring_dedup, wavelet
from tessera.llm._common import documents, shared_path
from tessera.llm._items import default_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_digests(documents(spark, sf_dir), default_path("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, distance=3)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), default_path("word_bpe_49k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.span_digests(documents(spark, sf_dir), depth=50)


def op10_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-shards")
    wavelet.write_shards(documents(spark, sf_dir), path, default_path("byte_bpe_50k.json"))
    return wavelet.read_documents(spark, path)


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3)


def op12_chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = shared_path(spark, "chats")
    chat_format.write_chats(chat_format.turn_events(turns), path)
    return chat_format.chat_digests(spark, path)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), most_words=5, least=100, top=2000, subsumed_percent=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_bpe_trie, op3_simhash, op4_licenses, op5_quality, op6_exact_dedup, op7_secrets, op8_packing, op9_suffix_dedup, op10_wavelet, op11_clusters, op12_chat_log, op13_collocations)}


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ws AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM ws),
t AS (SELECT doc_id, pos, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM t WHERE w3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id),
l0 AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d),
l1 AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l0),
l2 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS seen,
              regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l1 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l3 AS (SELECT doc_id, line, seen, len(words) AS n, list_sum(list_transform(words, lambda x: length(x))) AS chars, right(words[len(words)], 1) AS final,
              length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS marks, length(regexp_replace(line, '[^|»•›·]', '', 'g')) AS bars,
              length(regexp_replace(line, '[^!]', '', 'g')) AS bangs FROM l2),
l4 AS (SELECT doc_id, n, chars, seen, seen OR marks > 0.1 * chars OR (bangs >= 3 AND 3 * bangs > n) OR (bars >= 2 AND 4 * (bars + 1) >= n)
              OR (n < 5 AND NOT regexp_matches(final, '[.!?…:;"''”’»)]')) OR (n <= 25 AND regexp_matches(line, '@@')) AS fails FROM l3),
l AS (SELECT doc_id, sum(seen::INT) AS n_dup_lines, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost_chars, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost_words FROM l4 GROUP BY doc_id),
b AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_chars, 0)::BIGINT AS lost_chars, coalesce(lost_words, 0) AS lost_words
      FROM d JOIN ws USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.3 * word_chars AND n_words - lost_words >= 50 AS kept, lost_chars
FROM b
""".replace("@@", quality.BOILERPLATE)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p0 AS (SELECT rid, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS ps FROM d),
p AS (SELECT rid, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pn FROM p0),
w0 AS (SELECT rid, lang, pn, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT rid, lang, pn, unnest(ws) AS w, generate_subscripts(ws, 1) AS wn FROM w0),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
g AS (SELECT lang, list(w) OVER (PARTITION BY rid, pn ORDER BY wn ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ws FROM w),
m AS (SELECT unnest(range(1, 6)) AS m),
f AS (SELECT lang, array_to_string(ws[1:m], ' ') AS phrase, m, count(*) AS f FROM g, m WHERE len(ws) >= m GROUP BY ALL HAVING count(*) >= 100),
longer AS (SELECT lang, m, f, string_split(phrase, ' ') AS ws FROM f WHERE m > 2),
inside AS (SELECT l.lang, array_to_string(l.ws[i:i + j - 1], ' ') AS phrase, max(f) AS around FROM longer l, (SELECT m AS j FROM m WHERE m > 1) j, (SELECT m AS i FROM m) i WHERE j < m AND i + j - 1 <= m GROUP BY ALL),
c AS (SELECT f.lang, f.phrase, f.m, f.f AS a FROM f LEFT JOIN inside USING (lang, phrase) WHERE m > 1 AND (around IS NULL OR 100 * around < 100 * f.f)),
cut AS (SELECT c.lang, phrase, a, k.m AS k, array_to_string(string_split(phrase, ' ')[1:k.m], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k.m + 1:], ' ') AS rp FROM c, m k WHERE k.m < c.m),
s AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""


def _lloyd_sql(rounds: int = 3) -> str:
    """Rounds unrolled: r{i} assigns to the centroids c{i}, of which c{i + 1} are the means; empty ones stay."""
    steps = [
        "q AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT (row_number() OVER (ORDER BY sha256(concat('1:', vec_id::VARCHAR)), v) - 1)::INT AS c, v AS m FROM q WHERE vec_id IS NOT NULL QUALIFY c < 16)",
    ]
    for i in range(rounds + 1):
        steps += [
            f"d{i} AS (SELECT rid, c, list_sum(list_transform(range(1, 65), lambda j: (v[j] - m[j]) * (v[j] - m[j])))::BIGINT AS d FROM q, c{i})",
            f"r{i} AS (SELECT rid, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)",
            f"s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM r{i} JOIN q USING (rid)) GROUP BY c, j)",
            f"c{i + 1} AS (SELECT c{i}.c, coalesce(a.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM s{i} GROUP BY c) a ON a.c = c{i}.c)",
        ]
    return f"""WITH {", ".join(steps)}
SELECT vec_id, r{rounds}.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY r{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM r{rounds} JOIN q USING (rid) JOIN c{rounds} ON c{rounds}.c = r{rounds}.c"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op11_clusters": _lloyd_sql(), "op13_collocations": OP13_SQL}
