"""Sinks: JSON lines, CSV, relevance files, metrics, upserts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, nulls: bool = True, mode: str = "overwrite") -> None:
    """One compact object a line; null fields are kept unless told otherwise."""
    df.write.mode(mode).option("ignoreNullFields", not nulls).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_qrels(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", F.col("qid").cast("string"), F.lit("0"), F.col("doc_id").cast("string"), F.col("rel").cast("string"))).write.mode("overwrite").text(path)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, as metric records hold them."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with rows of the new ones' keys replaced; of several new rows of a key the one last in ``order``."""
    if order:
        by = W.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_status(old: DataFrame, new: DataFrame, key: str, status: str) -> DataFrame:
    """old with the status of new where there is one."""
    fresh = new.select(F.col(key), F.col(status).alias("_status"))
    return old.join(fresh, key, "left").withColumn(status, F.coalesce("_status", status)).drop("_status")


def preview(df: DataFrame, worker: str, order: str, n: int) -> DataFrame:
    """n rows, in turn from each worker's rows."""
    by = W.partitionBy(worker).orderBy(order)
    return df.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).orderBy("_n", worker).limit(n).drop("_n")


def write_json_array(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """JSON arrays of about ``rows_per_file`` records, each in a folder of its own (column ``share`` when read)."""
    files = max(1, -(-df.count() // rows_per_file))
    share = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    one = df.groupBy(share.alias("share")).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    one.write.mode("overwrite").partitionBy("share").text(path)


def write_counted(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> int:
    """Write and return the number of rows, counted while they are written."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


class AppendLog:
    """Appended Parquet segments that can be read once the log is sealed."""

    def __init__(self, path: str):
        self.path, self.sealed = path, False

    def append(self, df: DataFrame) -> None:
        if self.sealed:
            raise ValueError("the log is sealed")
        df.write.mode("append").parquet(self.path)

    def seal(self) -> None:
        self.sealed = True

    def read(self, spark: SparkSession) -> DataFrame:
        if not self.sealed:
            raise ValueError("the log isn't sealed yet")
        return spark.read.parquet(self.path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON record in a file of its own, written beside its place and then moved over it in one step."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(record).encode() + b"\n"))
    out.hsync()
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, target, how)
