"""Queries over rollouts, turns and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import objectives as O
from tessera.operators import groups as G
from tessera.plans import derived as D
from tessera.plans.registry import query, table

ADV_SQL = "(reward - avg(reward) OVER g) / (CASE WHEN stddev_samp(reward) OVER g < 1e-8 THEN 1.0 ELSE stddev_samp(reward) OVER g END + 1e-8)"


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded, minus zero made zero, so that values compare over engines; a nudge keeps exact halves apart."""
    return df.select(*[(F.round(F.col(c) + nudge, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def tidy(names: str, digits: int = 6, nudge: float = 0.0) -> str:
    return ", ".join(f"round({n} + {nudge!r}, {digits}) + 0.0 AS {n}" for n in names.split())


@query(f"WITH r AS ({D.ROLLOUTS_SQL}), a AS (SELECT *, {ADV_SQL} AS advantage, min(reward) OVER g AS lo, max(reward) OVER g AS hi FROM r WINDOW g AS (PARTITION BY grp)) SELECT grp, run, reward, {tidy('advantage')} FROM a WHERE advantage IS NOT NULL AND lo <> hi")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = G.nonzero_variance_groups(D.rollouts(spark, sf_dir), "grp", "reward")
    return rounded(G.group_advantage(kept, "grp", "reward")).select("grp", "run", "reward", "advantage")


@query(f"WITH r AS ({D.FINE_ROLLOUTS_SQL}), a AS (SELECT *, CASE WHEN count(*) OVER g <= 1 THEN 0.0 ELSE {ADV_SQL} END AS advantage FROM r WINDOW g AS (PARTITION BY grp)) SELECT grp, run, reward, {tidy('advantage')} FROM a")
def group_advantage_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.group_advantage_safe(D.fine_rollouts(spark, sf_dir), "grp", "reward")).select("grp", "run", "reward", "advantage")


@query(f"WITH r AS ({D.FINE_ROLLOUTS_SQL}) SELECT grp, run, reward FROM r WHERE grp IN (SELECT grp FROM r GROUP BY grp HAVING count(DISTINCT reward) > 1)")
def nonzero_variance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nonzero_variance_groups(D.fine_rollouts(spark, sf_dir), "grp", "reward")


@query(f"WITH r AS (SELECT user_id AS grp, event_id AS run, value * 1e-6 AS reward FROM events) SELECT grp, run, reward FROM r WHERE grp IN (SELECT grp FROM r GROUP BY grp HAVING count(DISTINCT round(reward, 6)) > 1)")
def nonzero_variance_filter_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiny = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("run"), (F.col("value") * 1e-6).alias("reward"))
    return G.nonzero_variance_groups(tiny, "grp", "reward", 6)


Z_SQL = "CASE WHEN count({0}) OVER g <= 1 OR stddev_pop({0}) OVER g < 1e-6 THEN 0.0 ELSE ({0} - avg({0}) OVER g) / stddev_pop({0}) OVER g END"


@query(f"WITH t AS ({D.TURNS_SQL}) SELECT grp, rollout, turn, round({Z_SQL.format('ig')}, 6) + 0.0 AS z FROM t WINDOW g AS (PARTITION BY grp)")
def z_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.z_scores(D.turns(spark, sf_dir), {"z": "ig"}, ["grp"]).select("grp", "rollout", "turn", "z"))


@query(f"WITH t AS ({D.TURNS_SQL}), s AS (SELECT rollout, turn, {Z_SQL.format('ig')} + {Z_SQL.format('outcome')} AS r FROM t WINDOW g AS (PARTITION BY grp)) SELECT a.rollout, a.turn, round(sum(b.r * power(0.95, b.turn - a.turn)) + 1e-9, 5) + 0.0 AS advantage FROM s a JOIN s b ON a.rollout = b.rollout AND b.turn >= a.turn GROUP BY a.rollout, a.turn")
def turn_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.turn_advantages(D.turns(spark, sf_dir), "grp", "rollout", "turn", "ig", "outcome"), 5, 1e-9)


@query(f"WITH t AS ({D.TURNS_SQL}) SELECT a.rollout, a.turn, round(sum(b.ig * power(0.9, b.turn - a.turn)) + 1e-9, 6) + 0.0 AS ret FROM t a JOIN t b ON a.rollout = b.rollout AND b.turn >= a.turn GROUP BY a.rollout, a.turn")
def discounted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.discounted_returns(D.turns(spark, sf_dir), "rollout", "turn", "ig", 0.9), 6, 1e-9)


@query(f"WITH t AS ({D.TURNS_SQL}) SELECT rollout, turn, round(ig - coalesce(lag(ig) OVER (PARTITION BY rollout ORDER BY turn), 0.3), 6) + 0.0 AS gain FROM t")
def information_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.information_gain(D.turns(spark, sf_dir), "rollout", "turn", "ig", 0.3).select("rollout", "turn", "gain"))


@query(f"WITH t AS ({D.TOKENS_SQL}), m AS (SELECT sum((pi - ref) * mask) / sum(mask) AS mean FROM t) SELECT sample, pos, round(adv + 0.1 * mask * (mean - (pi - ref)), 6) + 0.0 AS adv_kl FROM t, m")
def kl_penalty_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.kl_penalty_advantage(D.tokens(spark, sf_dir), 0.1).select("sample", "pos", "adv_kl"))


@query("SELECT event_type, round(avg(event_id % 17 - event_id % 5), 6) + 0.0 AS mean_offset, max(event_id % 17 - event_id % 5) AS max_offset, min(event_id % 17 - event_id % 5) AS min_offset FROM events GROUP BY event_type")
def version_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 17).alias("trained"), (F.col("event_id") % 5).alias("submitted"))
    return rounded(G.version_offset(rows, "trained", "submitted", "event_type"))


@query(f"WITH t AS ({D.TOKENS_SQL}), s AS (SELECT sample, count(*) AS n, sum(mask)::BIGINT AS trained, max(pos) = count(*) - 1 AS dense FROM t GROUP BY sample) SELECT *, n >= 2 AND trained > 0 AND dense AS aligned FROM s")
def group_alignment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.group_alignment(D.tokens(spark, sf_dir))


LOSS_SQL = """
WITH t AS ({tokens}),
w AS (SELECT *, CASE WHEN mask > 0.5 THEN least(exp(greatest(-20.0, least(20.0, old - inf))), 5.0) ELSE 1.0 END AS tis,
  exp(greatest(-20.0, least(20.0, pi - old))) AS ratio, exp(least(avg(pi - old) OVER (PARTITION BY sample), 10.0)) AS seq FROM t),
x AS (SELECT sample, mask, {loss} AS loss, {clipped} AS clipped, {shown} AS ratio, {penalty} AS penalty,
  CASE WHEN mask > 0.5 THEN exp(pi - old) - (pi - old) - 1 END AS ppo, CASE WHEN mask > 0.5 THEN exp(ref - pi) - (ref - pi) - 1 END AS refkl, (pi - ref) * mask AS kl FROM w),
s AS (SELECT sample, sum(mask) AS n, sum(loss) AS loss, avg(clipped) AS clipped, avg(ratio) AS ratio, sum(penalty) AS penalty, avg(ppo) AS ppo, avg(refkl) AS refkl, sum(kl) AS kl FROM x GROUP BY sample HAVING sum(mask) > 0)
SELECT count(*) AS n_samples, sum(n)::BIGINT AS n_tokens, round(sum(loss), 4) + 0.0 AS loss, round(avg(clipped), 4) + 0.0 AS clip_frac, round(avg(ratio), 4) + 0.0 AS ratio_mean,
  round(avg(penalty), 4) + 0.0 AS penalty, round(avg(ppo), 4) + 0.0 AS ppo_kl, round(avg(refkl), 4) + 0.0 AS ref_kl, round(sum(kl) / sum(n), 4) + 0.0 AS mean_kl FROM s
"""


def _held(r: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {r}))"


def _clipped(r: str, low: str, high: str, active: bool = False) -> str:
    core = f"({_held(r, low, high)} <> {r})::DOUBLE"
    return f"CASE WHEN mask > 0.5 THEN {core} END" if active else core


LOSSES = {
    "grpo": (f"(greatest(-ratio * adv, -{_held('ratio', '0.8', '1.2')} * adv) * tis + 0.001 * (exp(ref - pi) - (ref - pi) - 1)) * mask", _clipped("ratio", "0.8", "1.2", True), "CASE WHEN mask > 0.5 THEN ratio END", "0.0"),
    "dapo": (f"greatest(-ratio * adv, -{_held('ratio', '0.8', '1.28')} * adv) * tis * mask", _clipped("ratio", "0.8", "1.28"), "ratio", "0.0"),
    "gspo": (f"greatest(-seq * adv, -{_held('seq', '0.8', '1.2')} * adv) * tis * mask", _clipped("seq", "0.8", "1.2"), "seq", "0.0"),
    "cispo": (f"-({_held('ratio', '0.8', '1.2')} * pi * adv) * tis * mask", _clipped("ratio", "0.8", "1.2"), "ratio", "0.0"),
    "dro": ("-(pi * adv * tis - 0.5 * 0.05 * CASE WHEN adv <> 0 THEN (pi - old) * (pi - old) ELSE 0.0 END) * mask", "0.0", "ratio", "0.5 * 0.05 * CASE WHEN adv <> 0 THEN (pi - old) * (pi - old) ELSE 0.0 END * mask"),
    "is": ("-ratio * adv * tis * mask", "0.0", "ratio", "0.0"),
    "reinforce": ("(-exp(pi - inf) * adv + 0.001 * (pi - ref)) * mask", "0.0", "ratio", "0.0"),
}
for _kind, (_loss, _clip, _shown, _penalty) in LOSSES.items():

    @query(LOSS_SQL.format(tokens=D.TOKENS_SQL, loss=_loss, clipped=_clip, shown=_shown, penalty=_penalty), name=f"{_kind}_loss")
    def _(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return rounded(O.policy_loss(D.tokens(spark, sf_dir), kind, beta=0.05 if kind == "dro" else 0.001), 4)


@query(f"WITH t AS ({D.TOKENS_SQL}), d AS (SELECT *, avg(CASE WHEN mask > 0.5 THEN old - inf END) OVER (PARTITION BY sample) AS m FROM t) SELECT sample, pos, round(CASE WHEN mask > 0.5 THEN least(exp(old - inf), 5.0) ELSE 1.0 END, 6) + 0.0 AS token_weight, round(CASE WHEN mask > 0.5 THEN least(exp(m), 5.0) ELSE 1.0 END, 6) + 0.0 AS sequence_weight, round(CASE WHEN mask > 0.5 THEN CASE WHEN exp(old - inf) BETWEEN 0.98 AND 1.02 THEN exp(old - inf) ELSE 0.0 END ELSE 1.0 END, 6) + 0.0 AS band_weight FROM d")
def tis_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.tokens(spark, sf_dir).select("sample", "pos", O.tis_weight().alias("token_weight"), O.tis_weight(sequence=True).alias("sequence_weight"), O.tis_weight(band=(0.98, 1.02)).alias("band_weight")))


@query(f"WITH t AS ({D.TOKENS_SQL}), s AS (SELECT sample, avg(CASE WHEN mask > 0.5 THEN pi - inf END) AS k1, avg(CASE WHEN mask > 0.5 THEN exp(inf - pi) + (pi - inf) - 1 END) AS k3, sum(mask) AS n FROM t GROUP BY sample HAVING sum(mask) > 0) SELECT round(avg(k1), 6) + 0.0 AS k1, round(avg(k3), 6) + 0.0 AS k3, sum(n)::BIGINT AS n_tokens FROM s")
def inference_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.inference_drift(D.tokens(spark, sf_dir)))


@query(f"WITH t AS ({D.TOKENS_SQL}), s AS (SELECT sample, count(*) AS n, avg(abs(inf - pi)) AS mean_abs, max(abs(inf - pi)) AS max_abs, avg(inf - pi) AS k1, avg((inf - pi) * (inf - pi) / 2) AS k2, avg(exp(inf - pi) - 1 - (inf - pi)) AS k3 FROM t GROUP BY sample) SELECT sample, n, {tidy('mean_abs max_abs k1 k2 k3', 9, 1e-11)}, CASE WHEN mean_abs < 0.01 THEN 'PASS' WHEN mean_abs < 0.1 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM s")
def logprob_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.logprob_compare(D.tokens(spark, sf_dir)), 9, 1e-11)


PAIRS_SQL = f"WITH t AS ({D.TOKENS_SQL}), s AS (SELECT sample, sum(pi) AS pi, sum(ref) AS ref, avg(pi) AS mean FROM t WHERE mask > 0 GROUP BY sample), p AS (SELECT c.pi AS pi_c, c.ref AS ref_c, r.pi AS pi_r, r.ref AS ref_r, c.mean AS mean_c, r.mean AS mean_r FROM s c JOIN s r ON r.sample = c.sample + 1 WHERE c.sample % 2 = 0)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.tokens(spark, sf_dir).where("mask > 0").groupBy("sample").agg(F.sum("pi").alias("pi"), F.sum("ref").alias("ref"), F.avg("pi").alias("mean"))
    chosen = s.where("sample % 2 = 0").select(F.col("sample").alias("k"), *[F.col(c).alias(f"{c}_c") for c in ("pi", "ref", "mean")])
    return chosen.join(s.where("sample % 2 = 1").select((F.col("sample") - 1).alias("k"), *[F.col(c).alias(f"{c}_r") for c in ("pi", "ref", "mean")]), "k")


@query(PAIRS_SQL + ", m AS (SELECT (pi_c - ref_c) - (pi_r - ref_r) AS m FROM p) SELECT count(*) AS n, round(avg(ln(1 + exp(-0.1 * m))), 6) + 0.0 AS loss, round(avg(m), 6) + 0.0 AS margin, round(avg((m > 0)::INT), 6) + 0.0 AS accuracy FROM m")
def dpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.dpo(pairs(spark, sf_dir)))


@query(PAIRS_SQL + ", c AS (SELECT mean_c, greatest(-50.0, least(-1e-6, mean_c)) AS c, greatest(-50.0, least(-1e-6, mean_r)) AS r FROM p), o AS (SELECT -mean_c AS sft, ln(1 + exp(-((c - r) - (ln(1 - exp(c)) - ln(1 - exp(r)))))) AS odds FROM c) SELECT count(*) AS n, round(sum(sft + 0.1 * odds), 4) + 0.0 AS loss, round(avg(odds), 4) + 0.0 AS odds_loss FROM o")
def orpo_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.orpo(pairs(spark, sf_dir)), 4)


@query(f"WITH t AS ({D.TOKENS_SQL}) SELECT round(sum(-pi * mask) / sum(mask), 6) + 0.0 AS nll, round(exp(sum(-pi * mask) / sum(mask)), 6) + 0.0 AS perplexity, count(*) FILTER (mask > 0) AS n_tokens FROM t")
def sft_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.sft(D.tokens(spark, sf_dir)))


def unit(v: str) -> Column:
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.transform(v, lambda x: x.cast("double") / norm)


@query("""
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT vec_id // 32 AS batch, (vec_id % 32) // 2 AS i, v FROM n WHERE vec_id % 2 = 0), b AS (SELECT vec_id // 32 AS batch, (vec_id % 32) // 2 AS i, v FROM n WHERE vec_id % 2 = 1),
p AS (SELECT a.batch, a.i, b.i AS j, round(list_cosine_similarity(a.v, b.v), 9) / 0.05 AS s FROM a JOIN b ON a.batch = b.batch),
q AS (SELECT *, max(s) OVER r AS top, max(s) OVER c AS ctop FROM p WINDOW r AS (PARTITION BY batch, i), c AS (PARTITION BY batch, j)),
x AS (SELECT *, min(CASE WHEN s = top THEN j END) OVER r AS best, top + ln(sum(exp(s - top)) OVER r) AS rows_, ctop + ln(sum(exp(s - ctop)) OVER c) AS cols_ FROM q WINDOW r AS (PARTITION BY batch, i), c AS (PARTITION BY batch, j))
SELECT batch, count(*) AS n, round(avg((rows_ + cols_) / 2 - s), 5) + 0.0 AS loss, round(avg((best = i)::INT), 5) + 0.0 AS recall_at_1 FROM x WHERE i = j GROUP BY batch""")
def info_nce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 32).alias("batch"), F.floor((F.col("vec_id") % 32) / 2).alias("i"), (F.col("vec_id") % 2).alias("side"), unit("embedding").alias("v"))
    return rounded(O.info_nce(rows.where("side = 0"), rows.where("side = 1")), 5)


@query(f"WITH t AS ({D.TOKENS_SQL}) SELECT sample, round(sum((ref - inf) * mask), 6) + 0.0 AS total, round(sum((ref - inf) * mask) / nullif(sum(mask), 0), 6) + 0.0 AS mean, sum(mask)::BIGINT AS n_active FROM t GROUP BY sample")
def opd_reverse_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.reverse_kl_advantage(D.tokens(spark, sf_dir)))


@query(f"WITH t AS ({D.TOKENS_SQL}), r AS (SELECT sample, pos // 3 AS spot, ref AS teacher, pi AS student FROM t), x AS (SELECT *, exp(teacher - max(teacher) OVER w) AS e FROM r WINDOW w AS (PARTITION BY sample, spot)), p AS (SELECT *, e / sum(e) OVER (PARTITION BY sample, spot) AS p FROM x), s AS (SELECT sample, spot, -sum(p * student) AS ce, -sum(p * ln(p)) AS entropy, sum(exp(teacher)) AS mass FROM p GROUP BY sample, spot) SELECT sample, round(avg(ce), 6) + 0.0 AS loss, round(avg(entropy), 6) + 0.0 AS entropy, round(min(mass), 6) + 0.0 AS min_mass, round(max(mass), 6) + 0.0 AS max_mass, count(*) AS n_positions FROM s GROUP BY sample")
def topk_forward_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.tokens(spark, sf_dir).select("sample", F.floor(F.col("pos") / 3).alias("spot"), F.col("ref").alias("teacher"), F.col("pi").alias("student"))
    return rounded(O.topk_forward_kl(rows, "sample", "spot"))


@query("SELECT step, round(CASE WHEN step < 10 THEN 0.001 * (step + 1) / 10 ELSE 0.001 * (1 + cos(pi() * (step - 10) / 90.0)) / 2 END, 9) + 0.0 AS cosine, round(CASE WHEN step < 10 THEN 0.001 * (step + 1) / 10 ELSE 0.001 - 0.001 * (step - 10) / 90.0 END, 9) + 0.0 AS linear, round(CASE WHEN step < 10 THEN 0.001 * (step + 1) / 10 ELSE 0.001 END, 9) + 0.0 AS constant FROM (SELECT unnest(range(0, 101)) AS step)")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("id")
    return rounded(spark.range(101).select(step.alias("step"), *[O.learning_rate(step, 0.001, 10, 100, k).alias(k) for k in ("cosine", "linear", "constant")]), 9)
