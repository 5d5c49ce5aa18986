"""License notices by diagonal voting, with DataFrame functions only.

Every rolling word k-gram of every text meets the k-grams of the templates on their hash.  A match
votes for the diagonal (position in the text less position in the template); neighbouring
diagonals are merged, since an inserted or missing word shifts the rest by one, and a span holds if
enough of its template voted.  Short phrases are templates with k = 2 whose every k-gram has to vote
on one diagonal: those are exactly the places where their words stand consecutively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._common import id_and_text
from tessera.llm.license_texts import NOTICES, PHRASES

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_K, NOTICE_K = 2, 5


def word_columns(text: Column) -> dict[str, Column]:
    """Words of the lower-cased text between gaps, with an empty string before or after them where a gap is."""
    return {"words": F.split(F.lower(text), GAP)}


def lead() -> Column:
    return (F.get("words", F.lit(0)) == "").cast("int")


def n_words() -> Column:
    size = F.size("words")
    return size - lead() - F.when((size > 1) & (F.get("words", size - 1) == ""), 1).otherwise(0)


def gram(k: int) -> Column:
    """Hash of the k words from pos on; null where they would reach over the end."""
    whole = F.get("words", F.col("pos") + k - 1)
    return F.when(whole.isNotNull(), F.xxhash64(F.lit(k), *[F.get("words", F.col("pos") + i) for i in range(k)]))


def spelled(k: Column) -> Column:
    return F.array_join(F.slice("words", F.col("pos") + 1, k), " ")


def templates(spark: SparkSession, notices: list[tuple[str, str]], phrases: dict[str, str]) -> DataFrame:
    """Template k-grams: as many rows as the fixed texts have words, whatever the corpus holds."""
    rows = [(label, text, NOTICE_K if len(text.split()) > NOTICE_K else len(text.split()), False) for label, text in notices]
    rows += [(label, text, PHRASE_K, True) for text, label in phrases.items()]
    table = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(k).alias("k"), F.lit(base).alias("base")) for i, (label, text, k, base) in enumerate(rows)])
    split = spark.range(1, numPartitions=1).select(F.inline(table)).select("template", "label", "k", "base", F.filter(F.split(F.lower("text"), GAP), lambda w: w != "").alias("words"))
    grams = split.select("*", F.posexplode("words").alias("pos", "word")).where(F.col("pos") + F.col("k") <= F.size("words"))
    keys = F.coalesce(*[F.when(F.col("k") == k, gram(k)) for k in sorted({r[2] for r in rows})])
    return grams.select("template", "label", "k", "base", F.col("pos").alias("at"), (F.size("words") - F.col("k") + 1).alias("n_grams"), keys.alias("gram"), spelled(F.col("k")).alias("spelling"))


def license_spans(
    docs: DataFrame, notices: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, shift: int = 3, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, version, template, label, base, first_word, last_word, coverage): verified spans of templates.

    ``version`` is a hash of the text, so that rows that share an id don't mix.  Word positions count from
    0.  ``shift`` is how far apart diagonals of one span may be.  Null and empty texts have no spans; rows that repeat
    id and text are one; null ids are kept; other columns are not read; an empty table gives no rows.
    """
    notices, phrases = NOTICES if notices is None else notices, PHRASES if phrases is None else phrases
    wanted = templates(docs.sparkSession, notices, phrases)
    sizes = sorted({PHRASE_K if phrases else NOTICE_K, *(min(NOTICE_K, len(t.split())) for _, t in notices)})
    worded = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("version"), *(c.alias(n) for n, c in word_columns(F.col("text")).items()))
    rolled = worded.select("doc_id", "version", "words", F.posexplode("words").alias("pos", "word"))
    hashed = rolled.select("doc_id", "version", "words", "pos", F.explode(F.array(*[gram(k) for k in sizes])).alias("gram")).where("gram is not null")
    met = hashed.join(F.broadcast(wanted), "gram").where(spelled(F.col("k")) == F.col("spelling"))
    votes = met.select("doc_id", "version", "template", "label", "base", "n_grams", "k", "at", (F.col("pos") - lead()).alias("pos")).distinct()
    diagonals = votes.groupBy("doc_id", "version", "template", "label", "base", "n_grams", "k", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("least"), F.max("pos").alias("most")
    )
    by = W.partitionBy("doc_id", "version", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(by) > shift)
    merged = diagonals.withColumn("span", F.sum(apart.cast("int")).over(by)).groupBy("doc_id", "version", "template", "label", "base", "n_grams", "k", "span").agg(
        F.sum("votes").alias("votes"), F.min("least").alias("first_word"), (F.max("most") + F.first("k") - 1).alias("last_word")
    )
    share = F.least(F.col("votes") / F.col("n_grams"), F.lit(1.0))
    near = F.col("last_word") - F.col("first_word") < 2 * (F.col("n_grams") + F.col("k"))
    held = F.when(F.col("base"), F.col("votes") == F.col("n_grams")).otherwise((share >= coverage) & near)
    return merged.where(held).select("doc_id", "version", "template", "label", "base", "first_word", "last_word", share.alias("coverage"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row.

    Null and empty texts have no words, empty labels and score 0.  Rows that repeat get a result each,
    null ids are kept, an empty table gives an empty result.
    """
    spans = license_spans(docs, id_col=id_col, text_col=text_col)
    listed = lambda c: F.concat_ws(",", F.sort_array(F.collect_set(c)))  # noqa: E731  as many as there are labels
    found = spans.groupBy("doc_id", "version").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("version"), *(c.alias(n) for n, c in word_columns(F.col("text")).items()))
    rows = rows.select("doc_id", "version", n_words().cast("long").alias("n_words"))
    found = found.withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    empty = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return joined.select("doc_id", "n_words", *[F.coalesce(c, empty[c]).alias(c) if c in empty else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
