"""Bounded runs of streams: what is there is processed in micro-batches, results and progress stay in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import with_row_number
from tessera.sources import sinks


def source(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files at the path; ``files`` a micro-batch is its admission."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def write_in_order(df: DataFrame, part: str, order: str, parts: int, path: str, split: int = 1) -> None:
    """``split`` files for each part (0, 1, ...) without that column, with ages in the parts' order: streams take files by age.

    A part's rows are dealt to its files by hash, each written by a task of its own; a part without rows has no files.
    One write; the files are then moved out of their parts' folders and dated.
    """
    spark, staged = df.sparkSession, f"{path}-staged"
    own = F.col(part) * split + F.pmod(F.xxhash64(order), F.lit(split))
    df.withColumn(part, own.cast("int")).repartitionById(parts * split, part).sortWithinPartitions(part, order).write.partitionBy(part).parquet(staged)
    named = spark._jvm.org.apache.hadoop.fs.Path
    store = named(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(named(path))
    found = sorted((int(f.getPath().getParent().getName().split("=")[1]), f.getPath().getName(), f.getPath()) for f in store.globStatus(named(f"{staged}/{part}=*/*.parquet")) or [])
    held = {number for number, _, _ in found}
    lacking = [p * split + k for p in sorted({n // split for n in held}) for k in range(split) if p * split + k not in held]
    if lacking:  # files without rows, so that each part has as many as a micro-batch takes
        df.drop(part).limit(0).coalesce(1).write.parquet(f"{staged}/none")
        none = store.globStatus(named(f"{staged}/none/*.parquet"))[0].getPath()
        for number in lacking:
            at = named(f"{staged}/none-{number}.parquet")
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, none, store, at, False, spark._jsc.hadoopConfiguration())
            found.append((number, at.getName(), at))
        found.sort(key=lambda f: f[:2])
    now = spark._jvm.java.lang.System.currentTimeMillis()
    for k, (number, name, at) in enumerate(found):
        target = named(f"{path}/part-{number:08d}-{name}")
        store.rename(at, target)
        store.setTimes(target, now - (len(found) - k) * 2000, -1)


def end(spark: SparkSession, path: str, schema: str) -> None:
    """A last file with one row, all of nulls: it tells an operator that the stream ends there."""
    spark.createDataFrame([{}], schema).coalesce(1).write.mode("append").parquet(path)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run until no input is left and return what was written; a second run goes on where the first one stopped."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, checkpoint: str, do: Callable[[DataFrame, int], None]) -> None:
    """``do(rows, id)`` for each micro-batch in id order; a batch that is repeated after a failure has the same id."""
    stream.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def publish(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Batches published in id order, each in a folder that is replaced if the batch is repeated; (batch, rows...)."""
    each_batch(stream, checkpoint, lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"))
    return stream.sparkSession.read.parquet(path)


def upsert_on_change(changes: DataFrame, key: str, order: str, derive: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """A table kept up to date: each micro-batch's newest rows, with what ``derive`` adds, replace those of their keys.

    Keys are dealt into buckets by hash.  A micro-batch writes a version, a folder with the buckets that it
    changes; each bucket's newest version is the table.
    """
    spark = changes.sparkSession

    def do(df: DataFrame, i: int) -> None:
        new = derive(df).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
        changed = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
        earlier = [p for b, p in newest(spark, path, i).items() if b in changed]
        old = spark.read.parquet(*earlier).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))) if earlier else new.limit(0)
        sinks.upsert(old, new, key, order).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={i}")

    each_batch(changes, checkpoint, do)
    return spark.read.parquet(*newest(spark, path).values())


def newest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The folder of each bucket's newest finished version (before a version, if given)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store, done = folder.getFileSystem(spark._jsc.hadoopConfiguration()), set(versions(spark, path))
    found: dict[int, tuple[int, str]] = {}
    for f in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "version=*/bucket=*")) or []:
        place = f.getPath()
        version, bucket = (int(p.getName().split("=")[1]) for p in (place.getParent(), place))
        if version in done and (before is None or version < before):
            found[bucket] = max(found.get(bucket, (-1, "")), (version, place.toString()))
    return {b: p for b, (_, p) in sorted(found.items())}


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished version folders at a path, in whatever store it names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "version=*/_SUCCESS")) or []
    return [int(f.getPath().getParent().getName().split("=")[1]) for f in done]


def chunks(samples: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """(key, chunk, n, first): tumbling windows of ``size`` samples by position."""
    place = with_row_number(samples, key, order, name="_row")
    start = place.groupBy(key).agg(F.min("_row").alias("_start"))
    numbered = place.join(start, key).withColumn("chunk", F.floor((F.col("_row") - F.col("_start")) / size))
    return numbered.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))


def latest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, value) as JSON of the state that a stopped stream keeps at its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.to_json("key").alias("key"), F.to_json("value").alias("value"))
