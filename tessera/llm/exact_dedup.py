"""Exact duplicates by skew-safe combining, with DataFrame functions only.

Three stages, each comparing full content: rows of one input split are combined before any shuffle
(Spark's partial aggregation), (digest, salt, content) groups are merged, and the salt winners are
combined over (digest, content).  A digest that a third of all rows share is thereby met by at most
``salts`` rows in the last stage; by default there are more salts where there are more shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed, id_and_text, named, without

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int | None = None,
    digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256),
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty.  Null ids never win against others; a group of null ids only has a null
    keep_id and is kept.  Rows that repeat both id and text of the winner are the same document and
    are all marked kept.  An empty table gives an empty result.
    """
    salts = salts or max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    base = id_and_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("content"))
    base = base.select("doc_id", "content", digest(F.col("content")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    merged = base.groupBy("digest", "salt", "content").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = merged.groupBy("digest", "content").agg(
        F.min("least").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")  # at most one entry for each salt
    )
    # What a document is told needs no content where a digest has one content only, which is checked here.
    decided = checkpointed(groups.select("digest", "keep_id", "group_size", "salts"))
    collided = decided.groupBy("digest").count().where("count > 1")
    if not collided.isEmpty():
        table = groups.select("digest", "content", "keep_id", "group_size", F.explode("salts").alias("salt"))
        told = base.join(table, ["digest", "content", "salt"])
    else:
        table = decided.select("digest", "keep_id", "group_size", F.explode("salts").alias("salt"))
        told = base.drop("content").join(table, ["digest", "salt"])
    return told.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """docs with one row of each normalised text, that of the smallest id; all columns stay.

    Of rows that repeat both id and text (or have one text and null ids only) one stays, that of the least text.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    told = checkpointed(exact_duplicates(docs, id_col, text_col, salts).select("doc_id", "kept", "text_sha256"))
    losers = told.where("not kept").select("doc_id", "text_sha256").distinct()
    repeats = told.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    return without(docs, id_col, losers, F.sha2(normalised(text), 256), None if repeats.isEmpty() else (repeats, text))
