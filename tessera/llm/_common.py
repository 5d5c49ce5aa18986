"""What the corpus operators share: input columns, checkpoints, and lookups that hot keys do not skew."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string, null as empty): other columns can't clash with an operator's own."""
    return docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where none is named and one machine does all."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not configured and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        if not configured:
            atexit.register(shutil.rmtree, own := tempfile.mkdtemp(prefix="tessera-"), ignore_errors=True)
        context.setCheckpointDir(configured or own)
    return configured or context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, spread: Column, salts: int = 32) -> DataFrame:
    """rows left-joined to table (one row per key) where one key may hold a large share of rows.

    The rows get a salt from ``spread``; only distinct (key, salt) pairs meet the table on the key,
    so a hot key brings at most ``salts`` rows there, and the rows then join on (key, salt).
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    pairs = salted.select(key, "_salt").distinct()
    resolved = pairs.join(table, key)
    return salted.join(resolved, [key, "_salt"], "left").drop("_salt")


def without(docs: DataFrame, id_col: str, losers: DataFrame, digest: Column | None = None, repeats: tuple[DataFrame, Column] | None = None) -> DataFrame:
    """docs less the rows whose id (and digest, if given) is among the losers'; docs may have columns of any names.

    ``repeats``: ids and digests of which one row stays, and the column whose least value says which.
    """
    told = F.lit("") if digest is None else digest
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), named(id_col).cast("long").alias("row_id"), told.alias("row_digest"), *([repeats[1].alias("row_order")] if repeats else []))

    def among(some: DataFrame, how: str) -> DataFrame:
        wanted = some.select(F.col("doc_id").alias("some_id"), (F.lit("") if digest is None else F.col("text_sha256")).alias("some_digest"))
        return rows.join(wanted, F.col("row_id").eqNullSafe(F.col("some_id")) & (F.col("row_digest") == F.col("some_digest")), how)

    if repeats is None:
        return among(losers, "left_anti").select("row.*")
    one = among(repeats[0], "left_semi").groupBy("row_id", "row_digest").agg(F.min_by("row", "row_order").alias("row"))
    gone = losers.select("doc_id", "text_sha256").unionByName(repeats[0].select("doc_id", "text_sha256"))
    return among(gone, "left_anti").select("row").unionByName(one.select("row")).select("row.*")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], text_col: str = "text", most: int = 8 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over batches of about ``most`` bytes (a longer row is one), giving memory back when a task ends.

    Python workers outlive their tasks, and what their allocators keep counts against the executor.
    """

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, sizes = 0, pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text_col))), 0).to_numpy(zero_copy_only=False).astype("i8").cumsum()
            while begin < len(batch):
                end = max(begin + 1, int(sizes.searchsorted((sizes[begin - 1] if begin else 0) + most, "right")))
                yield batch.slice(begin, end - begin)
                begin = end

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(small(batches))
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return trimmed
