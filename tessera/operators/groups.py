"""Group-relative advantages, turn rewards and filters on groups of rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.scans import affine_scan
from tessera.operators.skew import salted_lookup


def beside_groups(df: DataFrame, group: list[str], stats: list[Column], salts: int = 32) -> DataFrame:
    """df with aggregates of each row's group as columns.

    Groups are aggregated in part before the shuffle (Spark merges counts, means and squares), and rows meet their
    group by (group, salt): a group brings its aggregates once for each salt that its rows have, so that a hot
    group is no one task's.  Null groups are a group.
    """
    found = df.groupBy(*group).agg(*stats)
    return salted_lookup(df, found, group, F.xxhash64(*df.columns), salts, "inner")


def group_advantage(df: DataFrame, group: str, reward: str, eps: float = 1e-8, name: str = "advantage") -> DataFrame:
    """(reward - mean) / (sample std + eps) in each group; a std below eps counts as 1; groups of one row are dropped."""
    return group_advantage_safe(df, group, reward, eps, name, lone=None).where(F.col(name).isNotNull())


def group_advantage_safe(df: DataFrame, group: str, reward: str, eps: float = 1e-8, name: str = "advantage", lone: float | None = 0.0) -> DataFrame:
    """As group_advantage, but a group of one row gets ``lone`` and stays."""
    both = beside_groups(df, [group], [F.stddev_samp(reward).alias("_sd"), F.avg(reward).alias("_mean"), F.count(F.lit(1)).alias("_n")])
    scaled = (F.col(reward) - F.col("_mean")) / (F.when(F.col("_sd") < eps, 1.0).otherwise(F.col("_sd")) + eps)
    return both.withColumn(name, F.when(F.col("_n") <= 1, F.lit(lone)).otherwise(scaled)).drop("_sd", "_mean", "_n")


def z_scores(df: DataFrame, values: dict[str, str], group: list[str], eps: float = 1e-6) -> DataFrame:
    """df with population z-scores (name: value column); 0 in groups of one value or with a deviation below eps."""
    stats = lambda v: [F.stddev_pop(v).alias(f"_sd_{v}"), F.avg(v).alias(f"_mean_{v}"), F.count(v).alias(f"_n_{v}")]
    both = beside_groups(df, group, [s for v in values.values() for s in stats(v)])
    for name, v in values.items():
        flat = (F.col(f"_n_{v}") <= 1) | (F.col(f"_sd_{v}") < eps)
        both = both.withColumn(name, F.when(flat, 0.0).otherwise((F.col(v) - F.col(f"_mean_{v}")) / F.col(f"_sd_{v}")))
    return both.drop(*[f"_{s}_{v}" for v in values.values() for s in ("sd", "mean", "n")])


def discounted_returns(df: DataFrame, key: str, order: str, value: str, gamma: float | Column, name: str = "ret") -> DataFrame:
    """(key, order, name): ret[t] = value[t] + gamma * ret[t + 1] in each key's order; gamma may differ by row.

    A scan from the last row on, so a key may have any number of rows.  Rows alike in order go by value; after a
    null value the sum begins anew.
    """
    factor = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    return affine_scan(df, key, [(order, True), (value, True)], [order], factor, F.col(value), name)


def turn_advantages(df: DataFrame, group: str, rollout: str, turn: str, ig: str, outcome: str, gamma: float = 0.95) -> DataFrame:
    """Both rewards z-scored over all turns of the group, added, then discounted backwards in each rollout."""
    scored = z_scores(df.select(group, rollout, turn, ig, outcome), {"_z_ig": ig, "_z_outcome": outcome}, [group])
    return discounted_returns(scored.withColumn("_r", F.col("_z_ig") + F.col("_z_outcome")), rollout, turn, "_r", gamma, "advantage")


def information_gain(df: DataFrame, rollout: str, turn: str, score: str, baseline: float = 0.0) -> DataFrame:
    """Score less the score of the turn before; the first turn is compared with the baseline."""
    before = F.lag(score).over(W.partitionBy(rollout).orderBy(turn))
    return df.withColumn("gain", F.col(score) - F.coalesce(before, F.lit(baseline)))


def nonzero_variance_groups(df: DataFrame, group: str, reward: str, digits: int | None = None) -> DataFrame:
    """Rows of groups with more than one distinct reward (after rounding, if asked for)."""
    value = F.col(reward) if digits is None else F.round(reward, digits)
    mixed = df.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_lo <> _hi").select(group)
    return df.join(mixed, group, "left_semi")


def kl_penalty_advantage(df: DataFrame, coefficient: float) -> DataFrame:
    """adv + coefficient * mask * (mean difference over masked tokens - the token's difference); difference = pi - ref."""
    mean = df.agg((F.sum((F.col("pi") - F.col("ref")) * F.col("mask")) / F.sum("mask")).alias("_mean"))
    shifted = F.col("adv") + coefficient * F.col("mask") * (F.col("_mean") - (F.col("pi") - F.col("ref")))
    return df.crossJoin(F.broadcast(mean)).withColumn("adv_kl", shifted).drop("_mean")  # one row


def version_offset(df: DataFrame, trained: str, submitted: str, by: str) -> DataFrame:
    gap = F.col(trained) - F.col(submitted)
    return df.groupBy(by).agg(F.avg(gap).alias("mean_offset"), F.max(gap).alias("max_offset"), F.min(gap).alias("min_offset"))


def group_alignment(df: DataFrame) -> DataFrame:
    """Samples with their checks: as many masks as positions, at least 2, positions without gaps, some trained token."""
    return df.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("mask").alias("trained"), (F.max("pos") == F.count(F.lit(1)) - 1).alias("dense")).withColumn(
        "aligned", (F.col("n") >= 2) & (F.col("trained") > 0) & F.col("dense")
    )
