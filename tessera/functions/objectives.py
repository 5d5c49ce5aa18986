"""Values and metrics of policy, preference, contrastive and distillation objectives over token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(float(low)))
    return F.least(x, F.lit(float(high))) if high is not None else x


def k3(d: Column) -> Column:
    return F.exp(d) - d - 1.0


def log1mexp(x: Column) -> Column:
    """log(1 - e^x) for x < 0, whichever form keeps its digits."""
    return F.when(x < -0.6931471805599453, F.log1p(-F.exp(x))).otherwise(F.log(-F.expm1(x)))


def log_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def tis_weight(cap: float = 5.0, sequence: bool = False, band: tuple[float, float] | None = None) -> Column:
    """exp(old - inf) of active tokens up to a cap, 1 elsewhere; outside the band, if any, 0."""
    active = F.col("mask") > 0.5
    d = F.col("old") - F.col("inf")
    d = F.avg(F.when(active, d)).over(W.partitionBy("sample")) if sequence else d
    w = clamp(F.exp(clamp(d, -20, 20)), 0, cap)
    if band:
        w = F.when(w.between(*band), w).otherwise(0.0)
    return F.when(active, w).otherwise(1.0)


def _surrogate(ratio: Column, low: float, high: float) -> tuple[Column, Column]:
    held = clamp(ratio, 1 - low, 1 + high)
    return F.greatest(-ratio * F.col("adv"), -held * F.col("adv")), (held != ratio).cast("double")


def policy_loss(tokens: DataFrame, kind: str, beta: float = 0.001, clip: float = 0.2, clip_high: float | None = None) -> DataFrame:
    """One row: loss (sum over tokens), n_tokens, clip_frac, ratio_mean and KL metrics.

    ``kind``: grpo, dapo, gspo, cispo, dro, is, reinforce.  Samples without an active token are skipped.
    Metrics are means over samples of each sample's mean; grpo's over active tokens, the others' over all;
    mean_kl is over active tokens of all samples.
    """
    by = W.partitionBy("sample")
    high = clip if clip_high is None else clip_high
    active, mask, adv, w = F.col("mask") > 0.5, F.col("mask"), F.col("adv"), F.col("tis")
    d = F.col("pi") - F.col("old")
    ratio = F.exp(clamp(d, -20, 20))
    shown, extra = ratio, F.lit(0.0)
    if kind == "grpo":
        value, clipped = _surrogate(ratio, clip, high)
        loss = (value * w + beta * k3(F.col("ref") - F.col("pi"))) * mask
    elif kind == "dapo":
        value, clipped = _surrogate(ratio, 0.2, 0.28)
        loss = value * w * mask
    elif kind == "gspo":
        shown = F.exp(clamp(F.avg(d).over(by), high=10.0))
        value, clipped = _surrogate(shown, clip, high)
        loss = value * w * mask
    elif kind == "cispo":
        held = clamp(ratio, 1 - clip, 1 + high)
        clipped, loss = (held != ratio).cast("double"), -(held * F.col("pi") * adv) * w * mask
    elif kind == "dro":
        gated = F.when(adv != 0, d * d).otherwise(0.0)
        clipped, loss = F.lit(0.0), -(F.col("pi") * adv * w - 0.5 * beta * gated) * mask
        extra = 0.5 * beta * gated * mask
    elif kind == "is":
        clipped, loss = F.lit(0.0), -ratio * adv * w * mask
    elif kind == "reinforce":
        clipped, loss = F.lit(0.0), (-F.exp(F.col("pi") - F.col("inf")) * adv + beta * (F.col("pi") - F.col("ref"))) * mask
    else:
        raise ValueError(f"no objective is called {kind}")
    seen = active if kind == "grpo" else F.lit(True)
    rows = tokens.withColumn("tis", tis_weight()).select("sample", "pos", "mask", loss.alias("loss"), F.when(seen, clipped).alias("clipped"), F.when(seen, shown).alias("ratio"), extra.alias("penalty"), F.when(active, k3(d)).alias("ppo"), F.when(active, k3(F.col("ref") - F.col("pi"))).alias("refkl"), ((F.col("pi") - F.col("ref")) * mask).alias("kl"))
    samples = rows.groupBy("sample").agg(
        F.sum("mask").alias("n"), F.sum("loss").alias("loss"), F.avg("clipped").alias("clipped"), F.avg("ratio").alias("ratio"), F.sum("penalty").alias("penalty"), F.avg("ppo").alias("ppo"), F.avg("refkl").alias("refkl"), F.sum("kl").alias("kl")
    ).where("n > 0")
    return samples.agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("n").alias("n_tokens"), F.sum("loss").alias("loss"), F.avg("clipped").alias("clip_frac"), F.avg("ratio").alias("ratio_mean"), F.avg("penalty").alias("penalty"), F.avg("ppo").alias("ppo_kl"), F.avg("refkl").alias("ref_kl"), (F.sum("kl") / F.sum("n")).alias("mean_kl")
    )


def inference_drift(tokens: DataFrame) -> DataFrame:
    """k1 and k3 between policy and inference: mean over samples of each sample's mean over active tokens."""
    d = F.when(F.col("mask") > 0.5, F.col("pi") - F.col("inf"))
    samples = tokens.groupBy("sample").agg(F.avg(d).alias("k1"), F.avg(F.exp(-d) + d - 1.0).alias("k3"), F.count(d).alias("n")).where("n > 0")
    return samples.agg(F.avg("k1").alias("k1"), F.avg("k3").alias("k3"), F.sum("n").alias("n_tokens"))


def logprob_compare(tokens: DataFrame) -> DataFrame:
    """Per sample: count, mean and largest |d|, k1, k2, k3 of d = inf - pi, and a verdict on the mean."""
    d = F.col("inf") - F.col("pi")
    out = tokens.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mean_abs"), F.max(F.abs(d)).alias("max_abs"), F.avg(d).alias("k1"), F.avg(d * d / 2).alias("k2"), F.avg(F.exp(d) - 1.0 - d).alias("k3"))
    return out.withColumn("verdict", F.when(F.col("mean_abs") < 0.01, "PASS").when(F.col("mean_abs") < 0.1, "MARGINAL").otherwise("FAIL"))


def dpo(pairs: DataFrame, beta: float = 0.1) -> DataFrame:
    """One row from (pi_c, ref_c, pi_r, ref_r) sums: mean loss, mean margin, accuracy."""
    margin = (F.col("pi_c") - F.col("ref_c")) - (F.col("pi_r") - F.col("ref_r"))
    return pairs.select(margin.alias("m")).agg(F.count(F.lit(1)).alias("n"), F.avg(-log_sigmoid(beta * F.col("m"))).alias("loss"), F.avg("m").alias("margin"), F.avg((F.col("m") > 0).cast("double")).alias("accuracy"))


def orpo(pairs: DataFrame, weight: float = 0.1) -> DataFrame:
    """One row from (mean_c, mean_r) mean log-probabilities: sum of sft + weight * odds-ratio loss."""
    c, r = clamp(F.col("mean_c"), -50, -1e-6), clamp(F.col("mean_r"), -50, -1e-6)
    odds = (c - r) - (log1mexp(c) - log1mexp(r))
    rows = pairs.select((-F.col("mean_c")).alias("sft"), (-log_sigmoid(odds)).alias("odds"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sft") + weight * F.col("odds")).alias("loss"), F.avg("odds").alias("odds_loss"))


def sft(tokens: DataFrame) -> DataFrame:
    """Weighted negative log-likelihood, perplexity and token count; null where no token has weight."""
    total = F.sum(F.when(F.col("mask") > 0, F.col("mask")))
    nll = F.sum(-F.col("pi") * F.col("mask")) / total
    return tokens.agg(nll.alias("nll"), F.exp(nll).alias("perplexity"), F.count_if(F.col("mask") > 0).alias("n_tokens"))


def info_nce(left: DataFrame, right: DataFrame, temperature: float = 0.05) -> DataFrame:
    """In-batch contrastive loss per batch from (batch, i, v) rows of unit vectors on either side; recall@1 takes the first best."""
    dot = F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = left.alias("a").join(right.alias("b"), F.col("a.batch") == F.col("b.batch")).select(F.col("a.batch").alias("batch"), F.col("a.i").alias("i"), F.col("b.i").alias("j"), (F.round(dot, 9) / temperature).alias("s"))
    row, col = W.partitionBy("batch", "i"), W.partitionBy("batch", "j")
    scored = pairs.select("batch", "i", "j", "s", F.max("s").over(row).alias("top")).select("batch", "i", "j", "s", F.min(F.when(F.col("s") == F.col("top"), F.col("j"))).over(row).alias("best"), F.col("top"))
    scored = scored.withColumn("rows", F.col("top") + F.log(F.sum(F.exp(F.col("s") - F.col("top"))).over(row))).withColumn("ctop", F.max("s").over(col)).withColumn("cols", F.col("ctop") + F.log(F.sum(F.exp(F.col("s") - F.col("ctop"))).over(col)))
    return scored.where("i = j").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("rows") + F.col("cols")) / 2 - F.col("s")).alias("loss"), F.avg((F.col("best") == F.col("i")).cast("double")).alias("recall_at_1"))


def reverse_kl_advantage(tokens: DataFrame, scale: float = 1.0) -> DataFrame:
    """Distillation advantages (teacher - sampling) * mask * scale, per sample: sum, mean and count of active tokens."""
    gap = (F.col("ref") - F.col("inf")) * F.col("mask") * scale
    return tokens.groupBy("sample").agg(F.sum(gap).alias("total"), (F.sum(gap) / F.nullif(F.sum("mask"), F.lit(0))).alias("mean"), F.sum("mask").alias("n_active"))


def topk_forward_kl(rows: DataFrame, by: str, position: str) -> DataFrame:
    """Soft cross-entropy over renormalised teacher candidates: (by, position, teacher, student) log-probabilities."""
    # the sums of a place stand beside its rows, of which one stays: a sort, and no table of all places in memory
    spot = W.partitionBy(by, position)
    rows = rows.select(by, position, "teacher", "student", F.row_number().over(spot.orderBy(F.desc("teacher"))).alias("_row"))
    scored = rows.withColumn("_top", F.max("teacher").over(spot)).withColumn("_p", F.exp(F.col("teacher") - F.col("_top"))).withColumn("p", F.col("_p") / F.sum("_p").over(spot))
    sums = scored.select(by, "_row", (-F.sum(F.col("p") * F.col("student")).over(spot)).alias("ce"), (-F.sum(F.col("p") * F.log("p")).over(spot)).alias("entropy"), F.sum(F.exp("teacher")).over(spot).alias("mass"))
    spots = sums.where("_row = 1")
    return spots.groupBy(by).agg(F.avg("ce").alias("loss"), F.avg("entropy").alias("entropy"), F.min("mass").alias("min_mass"), F.max("mass").alias("max_mass"), F.count(F.lit(1)).alias("n_positions"))


def learning_rate(step: Column, peak: float, warmup: int, total: int, kind: str = "cosine", floor: float = 0.0) -> Column:
    """Linear warm-up, then constant, cosine or linear decay to the floor."""
    done = clamp((step - warmup) / float(max(1, total - warmup)), 0, 1)
    after = {"constant": F.lit(peak), "linear": peak + (floor - peak) * done, "cosine": floor + (peak - floor) * (1 + F.cos(F.lit(3.141592653589793) * done)) / 2}[kind]
    return F.when(step < warmup, peak * (step + 1) / float(max(1, warmup))).otherwise(after)


def turn_policy_loss(tokens: DataFrame, beta: float = 0.001, clip: float = 0.2) -> DataFrame:
    """One row for per-token advantages: loss (sum), mean_kl over active tokens, token counts and their ratio.

    The importance weight has no cap beyond the exponent's, and the penalty is beta * (pi - ref).
    Samples without an active token are skipped.
    """
    active = F.col("mask") > 0.5
    live = tokens.withColumn("_live", F.max(active).over(W.partitionBy("sample"))).where("_live")
    surrogate, _ = _surrogate(F.exp(clamp(F.col("pi") - F.col("old"), -20, 20)), clip, clip)
    gap = F.col("pi") - F.col("ref")
    value = (surrogate * F.exp(clamp(F.col("old") - F.col("inf"), -20, 20)) + beta * gap) * F.col("mask")
    n = F.count_if(active)
    return live.agg(F.sum(value).alias("loss"), F.try_divide(F.sum(gap * F.col("mask")), n).alias("mean_kl"), n.alias("active_tokens"), F.count(F.lit(1)).alias("total_tokens"), F.try_divide(n, F.count(F.lit(1))).alias("mask_ratio"))
