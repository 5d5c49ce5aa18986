"""Aggregates of trials, rubrics, rollouts and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def step_metrics(df: DataFrame, step: str, key: str, value: str) -> DataFrame:
    """Reduce ``name:reducer`` keys per step by sum, min or max; plain names by their mean over chunks that reported; last and unknown reducers are skipped."""
    reducer = F.when(F.instr(key, ":") > 0, F.substring_index(key, ":", -1)).otherwise("mean")
    rows = df.select(step, F.substring_index(key, ":", 1).alias("metric"), reducer.alias("reducer"), F.col(value).alias("_v")).where(F.col("reducer").isin("sum", "min", "max", "mean"))
    picked = F.when(F.col("reducer") == "sum", F.sum("_v")).when(F.col("reducer") == "min", F.min("_v")).when(F.col("reducer") == "max", F.max("_v")).otherwise(F.avg("_v"))
    return rows.groupBy(step, "metric", "reducer").agg(picked.alias("value"))


def mean_then_clip(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean first, then clipped to [0, 1]."""
    return df.groupBy(*by).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(value))).alias("score"), F.count(F.lit(1)).alias("n_samples"))


def by_model_and_overall(df: DataFrame, model: str, value: str) -> DataFrame:
    """mean_then_clip for each model and, under '(all)', for all."""
    out = df.rollup(model).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(value))).alias("score"), F.count(F.lit(1)).alias("n_samples"), F.grouping(model).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "(all)").otherwise(F.col(model)).alias(model), "score", "n_samples")


def completeness(df: DataFrame, task: str, attempts: int) -> DataFrame:
    """Tasks whose number of attempts is not the expected one."""
    return df.groupBy(task).agg(F.count(F.lit(1)).alias("attempts")).where(F.col("attempts") != attempts)


def rollout_quality(df: DataFrame, by: str, reward: Column, accepted: Column) -> DataFrame:
    raw, kept = F.avg(reward), F.avg(F.when(accepted, reward))
    return df.groupBy(by).agg(raw.alias("raw_reward"), kept.alias("filtered_reward"), (1 - F.count_if(accepted) / F.count(F.lit(1))).alias("filter_ratio"))


def fixed_denominator(df: DataFrame, by: str, value: str, expected: int) -> DataFrame:
    """Mean over the expected number (missing ones are 0) beside the mean over those that came."""
    return df.groupBy(by).agg((F.sum(value) / expected).alias("fixed_mean"), F.avg(value).alias("returned_mean"), F.count(value).alias("returned"))


def weighted_rubric(df: DataFrame, case: str, ok: str, weight: str, critical: str, blend: float = 0.5) -> DataFrame:
    """Share of weight met; uniform if all weights are 0; critical share (score if none is critical); passed; blended reward."""
    w = F.greatest(F.when(F.isnan(weight) | F.col(weight).isNull(), 1.0).otherwise(F.col(weight)), F.lit(0.0))
    met, crit = F.col(ok).cast("double"), F.col(critical)
    score = F.when(F.sum(w) > 0, F.sum(w * met) / F.sum(w)).otherwise(F.avg(met))
    out = df.groupBy(case).agg(score.alias("score"), F.coalesce(F.avg(F.when(crit, met)), score).alias("critical_fraction"), F.coalesce(F.bool_and(F.when(crit, F.col(ok))), F.lit(True)).alias("passed"))
    return out.withColumn("reward", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - blend) * F.col("score") + blend * F.col("critical_fraction"))))


def signed_rubric(df: DataFrame, case: str, points: str, met: str) -> DataFrame:
    """Points met over positive points; negative points take away but are not in the denominator."""
    p = F.col(points)
    return df.groupBy(case).agg((F.sum(F.when(F.col(met), p).otherwise(0.0)) / F.nullif(F.sum(F.when(p > 0, p).otherwise(0.0)), F.lit(0.0))).alias("score"))


def length_adjusted(score: Column, length: Column, slope: float = 0.0147, base: int = 2000, unit: int = 500) -> Column:
    return score - slope * ((length - base) / float(unit))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")


def slice_metrics(df: DataFrame, fields: list[str], value: str) -> DataFrame:
    """Mean of the value for each value of each field, fields and values as one slug."""
    slices = F.explode(F.array(*[F.concat(F.lit(f + "_"), slug(F.col(f).cast("string"))) for f in fields])).alias("slice")
    return df.select(value, slices).groupBy("slice").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def win_rate(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    return df.groupBy(by).agg(F.count_if(F.col(a) > F.col(b)).alias("a_wins"), F.count_if(F.col(b) > F.col(a)).alias("b_wins"), F.count_if(F.col(a) == F.col(b)).alias("ties"), F.count_if(F.col(a).isNull() | F.col(b).isNull()).alias("invalid"), F.avg((F.col(a) > F.col(b)).cast("double")).alias("a_rate"))


def solve_rate(df: DataFrame, by: str, reward: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg((F.col(reward) >= 1 - 1e-6).cast("double")).alias("solve_rate"), F.count(F.lit(1)).alias("n"))


def value_shares(df: DataFrame, value: str) -> DataFrame:
    """Counts and per cent of all rows; one row for each value meets the total."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))).select(value, "n", (100.0 * F.col("n") / F.col("_all")).alias("share"))


def field_accuracy(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Mean equality of each (gold, prediction) field pair, of rows with all right, and the mean of the means."""
    eq = [F.col(g).eqNullSafe(F.col(p)) for g, p in pairs]
    every = eq[0]
    for e in eq[1:]:
        every = every & e
    means = [F.avg(e.cast("double")).alias(f"{g}_accuracy") for e, (g, _) in zip(eq, pairs, strict=True)]
    out = df.agg(*means, F.avg(every.cast("double")).alias("exact"))
    return out.withColumn("grand_mean", sum(F.col(f"{g}_accuracy") for g, _ in pairs) / len(pairs))


def token_weighted_nll(df: DataFrame, by: str, nll: str, n: str) -> DataFrame:
    mean = F.sum(F.col(nll) * F.col(n)) / F.greatest(F.sum(n), F.lit(1))
    return df.groupBy(by).agg(mean.alias("nll"), F.exp(mean).alias("perplexity"), F.sum(n).alias("n_tokens"))


def perplexity_curve(tokens: DataFrame, sample: str, pos: str, logprob: str, stride: int, longest: int) -> DataFrame:
    """Mean over samples of exp(mean negative log-probability of the first n tokens), n = stride, 2 stride, ..."""
    by = W.partitionBy(sample).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    rows = tokens.select(sample, (F.col(pos) + 1).alias("n"), F.exp(F.avg(-F.col(logprob)).over(by)).alias("_ppl"))
    return rows.where((F.col("n") % stride == 0) & (F.col("n") <= longest)).groupBy("n").agg(F.avg("_ppl").alias("perplexity"), F.count(F.lit(1)).alias("n_samples"))


def coefficient_variance(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, Bessel variance (0 or more), variance and standard error of the mean."""
    v = F.greatest(F.coalesce(F.var_samp(value), F.lit(0.0)), F.lit(0.0))
    return df.groupBy(by).agg(F.avg(value).alias("mean"), v.alias("variance"), (v / F.count(F.lit(1))).alias("variance_of_mean"), F.sqrt(v / F.count(F.lit(1))).alias("std_error"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's row with the largest order value."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r")).select(key, "_r.*")


def error_class(status: Column) -> Column:
    """recoverable for 408, 429, 5xx and transport failures (null), fatal otherwise."""
    return F.when(status.isNull() | status.isin(408, 429) | status.between(500, 599), "recoverable").otherwise("fatal")


def complete(returned: Column, expected: Column, cut: Column) -> Column:
    """Whether all expected episodes came back and none was cut short."""
    return (returned >= expected) & (cut == 0)
