"""Rollout, token and pair tables derived from the supplied star schema, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.registry import table

ROLLOUTS_SQL = "SELECT user_id AS grp, event_id AS run, value AS reward FROM events"
FINE_ROLLOUTS_SQL = "SELECT concat_ws('/', user_id, event_type, strftime(ts, '%Y-%m-%d')) AS grp, event_id AS run, CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM events"
TOKENS_SQL = """SELECT l_orderkey AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
 -l_discount - 0.01 AS pi, -l_tax - 0.01 AS old, -(l_discount + l_tax) / 2 - 0.01 AS inf, -l_quantity / 100 AS ref,
 CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS mask, CASE WHEN l_orderkey % 7 = 0 THEN 0.0 ELSE (l_orderkey % 5) / 2.0 - 1.0 END AS adv FROM lineitem"""
TURNS_SQL = """SELECT l_orderkey % 1000 AS grp, l_orderkey AS rollout, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS turn,
 l_discount * 10 AS ig, CASE WHEN l_linestatus = 'F' THEN l_tax * 100 ELSE 0.0 END AS outcome FROM lineitem"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, run, reward): each user's events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("run"), F.col("value").alias("reward"))


def fine_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary rewards in small groups, many of which have one value only."""
    group = F.concat_ws("/", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select(group.alias("grp"), F.col("event_id").alias("run"), F.when(F.col("value") >= 50, 1.0).otherwise(0.0).alias("reward"))


def _position(by: str = "l_orderkey"):
    return F.row_number().over(W.partitionBy(by).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, pos, pi, old, inf, ref, mask, adv): one row for each token, dealt out by ``sample``."""
    adv = F.when(F.col("sample") % 7 == 0, 0.0).otherwise((F.col("sample") % 5) / 2.0 - 1.0)
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "sample")  # before the window, so that Spark knows that it dealt them out by it
    return lines.withColumn("pos", _position("sample")).select(
        "sample", "pos", (-F.col("l_discount") - 0.01).alias("pi"), (-F.col("l_tax") - 0.01).alias("old"),
        (-(F.col("l_discount") + F.col("l_tax")) / 2 - 0.01).alias("inf"), (-F.col("l_quantity") / 100).alias("ref"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("mask"), adv.alias("adv"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, rollout, turn, ig, outcome): rewards of each turn."""
    outcome = F.when(F.col("l_linestatus") == "F", F.col("l_tax") * 100).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("grp"), F.col("l_orderkey").alias("rollout"), _position().alias("turn"), (F.col("l_discount") * 10).alias("ig"), outcome.alias("outcome"))
