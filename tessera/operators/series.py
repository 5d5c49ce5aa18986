"""Time series and failure streams: gauges, cursors, breakers, usage calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ordering import neighbourhoods, with_row_number
from tessera.operators.skew import salted_lookup


def time_weighted_mean(df: DataFrame, gauge: str, ts: str, value: str, chunk: int = 1 << 16) -> DataFrame:
    """Mean of a step function: each value counts for the time until the next; nulls add neither value nor time."""
    near = neighbourhoods(df.select(gauge, ts, value), gauge, ts, value, ahead=1, size=chunk)
    span = F.unix_micros(F.lead(ts).over(W.partitionBy("_chunk", gauge).orderBy("_row")).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    rows = near.select(gauge, value, "_own", span.alias("_dt")).where(F.col("_own") & F.col("_dt").isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(gauge).agg((F.sum(F.col(value) * F.col("_dt")) / F.nullif(F.sum("_dt"), F.lit(0))).alias("mean"), (F.sum("_dt") / 1e6).alias("seconds"))


def moving_average(df: DataFrame, key: str, order: str, value: str, width: int = 3, chunk: int = 1 << 16) -> DataFrame:
    by = W.partitionBy("_chunk", key).orderBy("_row").rowsBetween(1 - width, 0)
    near = neighbourhoods(df, key, order, back=width - 1, size=chunk)
    return near.withColumn("moving", F.avg(value).over(by)).where("_own").drop("_row", "_chunk", "_own")


def contiguous_cursor(df: DataFrame, key: str, index: str) -> DataFrame:
    """Length of the longest prefix 0, 1, ... of resolved indices; repeats count once, negative and null ones not at all.

    Rows are numbered over all keys, so an index belongs to the prefix where it is as far from the key's first number; a
    key's rows lie in as many tasks as they fill.
    """
    rows = with_row_number(df.select(key, index).where(F.col(index) >= 0).distinct(), key, index, name="_row")
    first = rows.groupBy(key).agg(F.min("_row").alias("_first"))
    met = salted_lookup(rows, first, [key], F.col("_row"))
    return met.groupBy(key).agg(F.count_if(F.col(index) == F.col("_row") - F.col("_first")).alias("cursor"), F.count(F.lit(1)).alias("resolved"))


def circuit_breaker(df: DataFrame, key: str, order: str, failed: Column, run: int = 5, window: int = 20, least: int = 10, share: float = 0.5, chunk: int = 1 << 16) -> DataFrame:
    """First failure at which ``run`` failures stand in a row, or ``share`` of the last ``window`` (of ``least`` or more) failed."""
    near = neighbourhoods(df.select(key, order, failed.cast("int").alias("_f")), key, order, back=max(run, window) - 1, size=chunk)
    by = W.partitionBy("_chunk", key).orderBy("_row")
    row, recent = by.rowsBetween(1 - run, 0), by.rowsBetween(1 - window, 0)
    tripped = (F.col("_f") == 1) & ((F.sum("_f").over(row) >= run) | ((F.count("_f").over(recent) >= least) & (F.avg("_f").over(recent) >= share)))
    return near.withColumn("_t", tripped).where("_own").groupBy(key).agg(F.min(F.when(F.col("_t"), F.col(order))).alias("tripped_at"), F.sum("_f").alias("failures"))


def daily_usage(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    return df.groupBy(key, F.to_date(ts).alias("day")).agg(F.sum(value).alias("used"))


def full_outer_sum(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums over the union of both sides' keys; what is missing counts as zero."""
    return a.select(*keys, value).unionByName(b.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def calendar_fill(df: DataFrame, key: str, day: str, value: str, first: str, last: str) -> DataFrame:
    """Each key with every day of [first, last]; missing days have 0."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day)
    spine = df.select(key).distinct().select(key, days)
    return spine.join(df.select(key, day, value), [key, day], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def usage_summary(filled: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Total, largest day and mean over the expected days, and whether each rule calls it low."""
    out = filled.groupBy(key).agg(F.sum(value).alias("total"), F.max(value).alias("largest"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("days"))
    return out.withColumn("low_max", F.col("largest") < threshold).withColumn("low_mean", F.col("mean") < threshold)


def year_growth(df: DataFrame, key: str, year: str, value: str) -> DataFrame:
    """Growth over the year before in per cent; null where there is none."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(year))
    return df.withColumn("growth", 100 * (F.col(value) - before) / F.nullif(before, F.lit(0.0)))


def best_so_far(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The first row with the largest value of each key."""
    by = W.partitionBy(key).orderBy(F.desc(value), order)
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def change_points(df: DataFrame, key: str, order: str, *values: str, chunk: int = 1 << 16) -> DataFrame:
    """Rows whose values differ from those of the row before (the first row of each key counts)."""
    by = W.partitionBy("_chunk", key).orderBy("_row")
    same = F.lit(True)
    for v in values:
        same = same & F.lag(v).over(by).eqNullSafe(F.col(v))
    near = neighbourhoods(df, key, order, back=1, size=chunk).withColumn("_new", F.lag("_row").over(by).isNull() | ~same)
    return near.where("_own and _new").drop("_new", "_row", "_chunk", "_own")
