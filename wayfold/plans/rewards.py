"""Reward statistics, filters and outcome advantages over the event samples."""

from pyspark.sql import functions as F

from wayfold.functions.stats import r6
from wayfold.operators import rewards as op
from wayfold.plans.catalog import ctes, query, r
from wayfold.sources import tables as t

S = t.SAMPLES_SQL
GV = "gv AS (SELECT uid, count(*) AS n, var_pop(reward) AS variance FROM samples GROUP BY uid)"
G = "g AS (SELECT uid, count(*) AS n, avg(reward) AS mu, stddev_samp(reward) AS sd FROM samples GROUP BY uid)"


@query("reward_variance", ctes(S, GV) + f"SELECT {r('avg(variance)')} AS reward_variance, count(*) AS n_groups FROM gv")
def _(spark, d):
    return op.reward_variance(t.samples(spark, d)).select(r6("reward_variance").alias("reward_variance"), "n_groups")


@query("filter_topk_variance", ctes(S, GV, "rk AS (SELECT *, row_number() OVER (ORDER BY variance DESC, uid) AS k FROM gv)") + f"""
SELECT uid, sample_id, {r('reward')} AS reward, {r('variance')} AS variance FROM samples JOIN rk USING (uid)
WHERE k <= greatest(1, ceil((SELECT count(*) FROM gv) * 0.25))""")
def _(spark, d):
    return op.filter_topk_variance(t.samples(spark, d), 0.25).select(
        "uid", "sample_id", r6("reward").alias("reward"), r6("variance").alias("variance"))


TOPP = """kept AS (SELECT * FROM (SELECT *, row_number() OVER o AS k, sum(variance) OVER o - variance AS before,
  sum(variance) OVER () AS total FROM gv WINDOW o AS (ORDER BY variance DESC, uid ROWS UNBOUNDED PRECEDING)) x WHERE total <= 0 OR k = 1 OR before < 0.8 * total)"""


@query("filter_topp_variance", ctes(S, GV, TOPP) + f"""
SELECT uid, sample_id, {r('variance')} AS variance, {r('sqrt((SELECT count(*) FROM kept) / (SELECT count(*) FROM gv))')} AS loss_scale
FROM samples JOIN kept USING (uid)""")
def _(spark, d):
    return op.filter_topp_variance(t.samples(spark, d), 0.8).select(
        "uid", "sample_id", r6("variance").alias("variance"), r6("loss_scale").alias("loss_scale"))


@query("variance_filter_report", ctes(S, GV, TOPP) + " UNION ALL ".join(
    f"""SELECT '{n}' AS stage, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_samples, {r('avg(variance)')} AS mean_variance,
{r('min(variance)')} AS min_variance, {r('max(variance)')} AS max_variance FROM {s}""" for n, s in (("before", "gv"), ("after", "kept"))))
def _(spark, d):
    s = t.samples(spark, d)
    rep = op.variance_report(s, op.filter_topp_variance(s, 0.8))
    return rep.select("stage", "n_groups", "n_samples", *[r6(c).alias(c) for c in ("mean_variance", "min_variance", "max_variance")])


@query("filter_zero_std_groups", ctes(S, GV) + f"""
SELECT uid, sample_id, {r('reward')} AS reward FROM samples WHERE uid IN (SELECT uid FROM gv WHERE variance > 0 OR n = 1 QUALIFY row_number() OVER (ORDER BY uid) <= 0.4 * (SELECT count(DISTINCT uid) FROM samples))""")
def _(spark, d):
    return op.filter_zero_std_groups(t.samples(spark, d), 0.4).select("uid", "sample_id", r6("reward").alias("reward"))


@query("filter_accuracy_band", ctes(S, """p AS (SELECT uid, avg(acc) BETWEEN 0.2 AND 0.8 AND max(length) < 84 AS passes FROM samples GROUP BY uid)""") + f"""
SELECT uid, sample_id, passes FROM samples JOIN p USING (uid)
QUALIFY row_number() OVER (ORDER BY passes DESC, uid, sample_id) <= floor((SELECT count(*) FROM samples) / 2.0)""")
def _(spark, d):
    return op.filter_accuracy_band(t.samples(spark, d), 0.2, 0.8, 85, 2.0).select("uid", "sample_id", "passes")


def _adv(name, fn, sql):
    @query(name, sql)
    def _(spark, d):
        return fn(t.samples(spark, d)).select("uid", "sample_id", r6("advantage").alias("advantage"))


def _adv_sql(expr):
    return ctes(S, G) + f"SELECT uid, sample_id, {r(expr)} AS advantage FROM samples JOIN g USING (uid)"


_adv("adv_grpo", op.grpo, _adv_sql("CASE WHEN n = 1 THEN reward / (1 + 1e-6) ELSE (reward - mu) / (sd + 1e-6) END"))
_adv("adv_grpo_nostd", lambda s: op.grpo(s, normalise=False), _adv_sql("CASE WHEN n = 1 THEN reward ELSE reward - mu END"))
_adv("adv_grpo_passk", op.grpo_passk, ctes(S, G, """b AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY reward DESC, sample_id) AS k,
  lead(reward) OVER (PARTITION BY uid ORDER BY reward DESC, sample_id) AS nxt FROM samples)""") + f"""
SELECT uid, sample_id, {r('CASE WHEN k = 1 THEN (reward - nxt) / (sd + 1e-6) ELSE 0 END')} AS advantage FROM b JOIN g USING (uid)""")
_adv("adv_rloo", op.rloo, _adv_sql("CASE WHEN n = 1 THEN 0 ELSE n / (n - 1) * (reward - mu) END"))
_adv("adv_opo", op.opo, ctes(S, "o AS (SELECT uid, count(*) AS n, sum(length * reward) / sum(length) AS base FROM samples GROUP BY uid)") + f"""
SELECT uid, sample_id, {r('reward - CASE WHEN n = 1 THEN 0 ELSE base END')} AS advantage FROM samples JOIN o USING (uid)""")
_adv("adv_gpg", op.gpg, _adv_sql("""(SELECT count(*) / greatest(count(*) FILTER (WHERE reward <> 0), 1) FROM samples)
  * (reward - CASE WHEN n = 1 THEN 0 ELSE mu END)"""))


@query("softmean_baseline", ctes(S) + f"""
SELECT uid, sample_id, {r('reward - (SELECT ln(avg(exp(0.05 * reward))) / 0.05 FROM samples)')} AS seq_reward FROM samples""")
def _(spark, d):
    return op.softmean_baseline(t.samples(spark, d), 0.05).select("uid", "sample_id", r6("seq_reward").alias("seq_reward"))


@query("reweight_resample", ctes(S, """w AS (SELECT *, row_number() OVER (ORDER BY sample_id) AS idx, pow(abs(reward), 2) + 1e-8 AS weight FROM samples)""",
       "c AS (SELECT *, sum(weight) OVER (ORDER BY idx) / (SELECT sum(weight) FROM w) AS hi FROM w)",
       "b AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY idx), 0) AS lo FROM c)",
       "u AS (SELECT idx AS draw, ('0x' || substr(md5('resample|' || CAST(idx AS VARCHAR)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM w)") + f"""
SELECT draw, uid, sample_id, {r('reward')} AS reward FROM u JOIN b ON u.u >= b.lo AND u.u < b.hi""")
def _(spark, d):
    return op.reweight_resample(t.samples(spark, d)).select("draw", "uid", "sample_id", r6("reward").alias("reward"))


@query("preference_pairs", ctes(S, "k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY sample_id) - 1 AS k FROM samples)") + f"""
SELECT a.uid, a.k // 2 AS pair, CASE WHEN a.reward >= b.reward THEN a.sample_id ELSE b.sample_id END AS chosen,
  CASE WHEN a.reward >= b.reward THEN b.sample_id ELSE a.sample_id END AS rejected, {r('abs(a.reward - b.reward)')} AS margin
FROM k a JOIN k b ON a.uid = b.uid AND a.k % 2 = 0 AND b.k = a.k + 1""")
def _(spark, d):
    return op.preference_pairs(t.samples(spark, d)).withColumn("margin", r6("margin"))


@query("pairwise_accuracy", ctes(S, """pr AS (SELECT a.uid, sum(abs(a.acc - b.acc)) AS w,
  sum(abs(a.acc - b.acc) * CASE WHEN a.reward = b.reward THEN 0.5 WHEN (a.reward > b.reward) = (a.acc > b.acc) THEN 1 ELSE 0 END) AS hit
  FROM samples a JOIN samples b ON a.uid = b.uid AND a.sample_id < b.sample_id GROUP BY a.uid)""",
       "sg AS (SELECT uid, avg(CASE WHEN sign(reward) = sign(acc * 2 - 1) THEN 1.0 ELSE 0.0 END) AS sign_accuracy FROM samples GROUP BY uid)") + f"""
SELECT uid, {r('CASE WHEN coalesce(w, 0) = 0 THEN 0.5 ELSE hit / w END')} AS pair_accuracy, {r('sign_accuracy')} AS sign_accuracy FROM sg LEFT JOIN pr USING (uid)""")
def _(spark, d):
    return op.pairwise_accuracy(t.samples(spark, d)).select("uid", r6("pair_accuracy").alias("pair_accuracy"), r6("sign_accuracy").alias("sign_accuracy"))


@query("overlong_penalty", ctes(S) + f"""
SELECT sample_id, {r('least(-(length - 50) / 30.0 * 1.5, 0)')} AS penalty, {r('reward + least(-(length - 50) / 30.0 * 1.5, 0)')} AS penalised,
  -(length - 50) / 30.0 * 1.5 < 0 AS overlong FROM samples""")
def _(spark, d):
    return op.overlong_penalty(t.samples(spark, d), 80, 30, 1.5).select(
        "sample_id", r6("penalty").alias("penalty"), r6("penalised").alias("penalised"), "overlong")


@query("align_uid", ctes(t.TURN_REWARDS_SQL, S) + f"""
SELECT a.uid, traj_idx, event_id, prompt_length, {r('a.reward')} AS reward FROM turn_rewards a
JOIN (SELECT uid, CAST(sum(length) AS BIGINT) AS prompt_length FROM samples GROUP BY uid) p USING (uid)""")
def _(spark, d):
    prompts = t.samples(spark, d).groupBy("uid").agg(F.sum("length").alias("prompt_length"))
    return op.align_uid(prompts, t.turn_rewards(spark, d)).select("uid", "traj_idx", "event_id", "prompt_length", r6("reward").alias("reward"))
