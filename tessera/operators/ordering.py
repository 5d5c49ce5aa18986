"""Order-dependent operators: dense row numbers, seeded permutations, splits, batches, epochs and packing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.scans import next_fit
from tessera.sources.scratch import scratch


def with_row_number(df: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """A dense 0-based number in the given order, without bringing all rows to one task.

    Rows are range-partitioned by the order and written to the shared folder (the ranges come from a
    sample, so they must not be drawn again); each range's numbers start where the counts of the ranges
    before it end, and there is one count for each shuffle partition.
    """
    spark = df.sparkSession
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, "ordered")
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    ordered = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_part", before.alias("_base"))
    return ordered.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")


def neighbourhoods(df: DataFrame, *order: Column | str, back: int = 0, ahead: int = 0, size: int = 1 << 16) -> DataFrame:
    """df in chunks of ``size`` rows in the given order, for windows that reach few rows: ``_row``, ``_chunk``, ``_own``.

    A chunk also holds the ``back`` rows before it and the ``ahead`` rows after it (``_own`` is false there), so that
    windows over (``_chunk``, key) by ``_row`` see what windows over the key would, with no task for a whole key.
    """
    size = max(size, back, ahead, 1)
    numbered = with_row_number(df, *order, name="_row")
    near = [F.floor((F.col("_row") + d) / size) for d in (0, back, -ahead)]
    spread = numbered.withColumn("_chunk", F.explode(F.filter(F.array_distinct(F.array(*near)), lambda c: c >= 0)))
    return spread.withColumn("_own", F.col("_chunk") == F.floor(F.col("_row") / size))


def hash_key(seed: int | str, *ids: str) -> Column:
    """A reproducible pseudo-random order: md5 of the seed and the ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def drawn_places(df: DataFrame, seed: int, key: str, slots: int, total: int) -> DataFrame:
    """(key, slot, place): for each row ``slots`` pseudo-random places below ``total``, repeats possible."""
    spread = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    return spread.withColumn("place", F.conv(F.substring(hash_key(seed, key, "slot"), 1, 12), 16, 10).cast("long") % total)


def pool_stride(total: int) -> int:
    """The least step from 0.618 of ``total`` on that leads through all places below it."""
    return next(x for x in range(max(1, total * 618 // 1000), total + 2) if math.gcd(x, total) == 1)


def filled_pools(items: DataFrame, docs: DataFrame, key: str, doc: str, eligible: str, wanted: int, seed: int, slots: int = 8, width: int = 16) -> DataFrame:
    """(key, doc): for each item ``wanted`` different eligible documents, or all if there are fewer.

    ``slots`` places are drawn for each item.  Items still short then go from their first place in steps
    through all places, in rounds of growing width; each round meets the documents in an equi-join by place.
    """
    spark, path, total = items.sparkSession, scratch(items.sparkSession, "pools"), docs.count()
    placed = with_row_number(docs.select(doc), doc, name="place")
    drawn = drawn_places(items.select(key), seed, key, slots, max(1, total))
    starts = drawn.where("slot = 0").select(key, F.col("place").alias("_start"))
    met = drawn.join(placed, "place").where(eligible).groupBy(key, doc).agg(F.min("slot").cast("long").alias("slot"))
    kept, done = [], 0
    while True:
        kept.append(f"{path}/{len(kept)}")
        met.write.parquet(kept[-1])
        got = spark.read.parquet(*kept)
        short = starts.join(got.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "left").where(F.coalesce("_n", F.lit(0)) < wanted)
        if done >= total or short.isEmpty():
            break
        steps = short.select(key, "_start", F.explode(F.sequence(F.lit(done), F.lit(min(done + width, total) - 1))).alias("_step"))
        steps = steps.select(key, (F.col("_step") + slots).cast("long").alias("slot"), ((F.col("_start") + F.col("_step").cast("long") * pool_stride(total)) % total).alias("place"))
        met = steps.join(placed, "place").where(eligible).select(key, doc, "slot").join(got.select(key, doc), [key, doc], "left_anti")
        done, width = done + width, width * 4
    return got.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("slot"))).where(F.col("_n") <= wanted).select(key, doc)


def seeded_shuffle(df: DataFrame, seed: int, key: str, name: str = "row") -> DataFrame:
    return with_row_number(df.withColumn("_h", hash_key(seed, key)), "_h", key, name=name).drop("_h")


def random_split(df: DataFrame, seed: int, key: str, ratio: float) -> DataFrame:
    """``split``: 'eval' for max(1, int(n * ratio)) rows of the permutation, else 'train'."""
    shuffled = seeded_shuffle(df, seed, key, "_row")
    held = F.greatest(F.lit(1), F.floor(F.lit(df.count()) * ratio))
    return shuffled.withColumn("split", F.when(F.col("_row") < held, "eval").otherwise("train")).drop("_row")


def eval_carveout(df: DataFrame, seed: int, key: str, ratio: float, most: int) -> DataFrame:
    """As random_split, but min(int(n * ratio), most) rows, and none if n is 1 or less or all would go."""
    n = df.count()
    held = 0 if n <= 1 else min(int(n * ratio), most)
    held = 0 if held >= n else held
    return seeded_shuffle(df, seed, key, "_row").withColumn("split", F.when(F.col("_row") < held, "eval").otherwise("train")).drop("_row")


def tail_split(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows are 'eval'; an error if there are not more than n."""
    total = df.count()
    if n >= total:
        raise ValueError(f"{n} of {total} rows can't be held out")
    return with_row_number(df, order, name="_row").withColumn("split", F.when(F.col("_row") >= total - n, "eval").otherwise("train")).drop("_row")


def batch_slices(df: DataFrame, order: str, size: int) -> DataFrame:
    return with_row_number(df, order, name="_row").withColumn("batch", F.floor(F.col("_row") / size)).drop("_row")


def epoch_batches(df: DataFrame, key: str, epochs: int, size: int, seed: int, carry: bool) -> DataFrame:
    """(epoch, key, batch) with a new permutation for each epoch.

    With ``carry`` batches reach over epochs and the last partial one stays; else each epoch's remainder goes.
    """
    rows = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("epoch").cast("string"), F.col(key).cast("string"))))
    numbered = with_row_number(rows, "epoch", "_h", key, name="_row")
    n = df.count()
    if carry:
        return numbered.select("epoch", key, F.floor(F.col("_row") / size).alias("batch"))
    within = F.col("_row") - F.col("epoch") * n
    return numbered.where(within < n // size * size).select("epoch", key, F.floor(within / size).alias("batch"))


def length_grouped_batches(df: DataFrame, key: str, size_col: str, batch: int, factor: int, seed: int) -> DataFrame:
    """Permute, cut into runs of batch * factor rows, sort each run by size (largest first), cut into batches.

    Batches are then put into a seeded order; a short last one stays last.  ``slot`` is that order.
    """
    n = df.count()
    mega = seeded_shuffle(df, seed, key, "_row").withColumn("_mega", F.floor(F.col("_row") / (batch * factor)))
    ranked = mega.withColumn("_in", F.row_number().over(W.partitionBy("_mega").orderBy(F.desc(size_col), "_row")) - 1)
    out = ranked.withColumn("batch", F.floor((F.col("_mega") * batch * factor + F.col("_in")) / batch))
    short = (F.col("batch") == n // batch).cast("int")
    order = out.select("batch").distinct().withColumn("_h", F.when(short == 1, "~").otherwise(hash_key(seed, "batch")))
    slots = with_row_number(order, "_h", "batch", name="slot").select("batch", "slot")  # one row a batch
    return out.join(slots, "batch").select(key, "batch", "slot")


def balanced_chunks(df: DataFrame, group: str, order: str, chunks: int) -> DataFrame:
    """ntile: at most ``chunks`` per group, the first ones one larger."""
    return df.withColumn("chunk", F.ntile(chunks).over(W.partitionBy(group).orderBy(order)) - 1)


def greedy_pack(df: DataFrame, shard: str, order: str, size_col: str, capacity: int) -> DataFrame:
    """In-order next-fit per shard: a row that doesn't fit opens a new ``pack``.  Rows over the capacity are dropped before."""
    return next_fit(df, shard, order, size_col, capacity)


def weighted_sample(df: DataFrame, key: str, weight: Column, k: int, seed: int) -> DataFrame:
    """k rows without replacement, likelier by weight: the k least of -ln(u) / weight, u from a hash; zero weights last."""
    u = (F.conv(F.substring(hash_key(seed, key), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    return df.withColumn("_e", F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))).orderBy("_e", key).limit(k).drop("_e")


def cycle_to(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows: the seeded permutation again and again; ``row`` is the place."""
    size = df.count()
    once = seeded_shuffle(df, seed, key, "_row")
    return once.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(0, (n - 1) // max(1, size))))).alias("_turn")).withColumn("row", F.col("_turn") * size + F.col("_row")).where(F.col("row") < n).drop("_turn", "_row")


def capped_concat(frames: list[tuple[str, DataFrame]], key: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each frame in its own seeded order, all with their source's name."""
    parts = [seeded_shuffle(df, seed, key, "_row").where(F.col("_row") < cap).drop("_row").withColumn("origin", F.lit(name)) for name, df in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def collect_until(df: DataFrame, order: str, accepted: Column, target: int) -> DataFrame:
    """Windows that close at each ``target`` accepted rows: window, consumed rows, accepted rows, whether it is partial."""
    numbered = with_row_number(df.withColumn("_ok", accepted.cast("int")), order, name="_row").where(F.col("_row") >= 0)
    hits = with_row_number(numbered.where("_ok = 1").select("_row"), "_row", name="_nth").where(F.col("_nth") % target == target - 1).select((F.floor(F.col("_nth") / target)).alias("window"), F.col("_row").alias("last"))
    spans = hits.withColumn("first", F.coalesce(F.lag("last").over(W.orderBy("window")) + 1, F.lit(0)))  # one row a window
    n, hit = numbered.count(), numbered.where("_ok = 1").count()
    full = spans.select("window", (F.col("last") - F.col("first") + 1).alias("consumed"), F.lit(target).cast("long").alias("accepted"), F.lit(False).alias("partial"))
    done = spans.agg(F.coalesce(F.max("last") + 1, F.lit(0)).alias("done"))
    rest = done.select(F.lit(hit // target).cast("long").alias("window"), (F.lit(n) - F.col("done")).alias("consumed"), F.lit(hit % target).cast("long").alias("accepted"), F.lit(True).alias("partial")).where("consumed > 0")
    return full.unionByName(rest)
