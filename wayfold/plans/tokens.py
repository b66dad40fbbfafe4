"""Token-level advantages, weights and batch statistics over the event tokens."""

from pyspark.sql import functions as F

from wayfold.functions.stats import r6, whiten
from wayfold.operators import tokens as op
from wayfold.plans.catalog import ctes, query, r
from wayfold.sources import tables as t

T = t.TOKENS_SQL


def white(src: str, col: str) -> str:
    """CTE pair computing masked mean and inverse deviation of ``col`` in ``src``."""
    return f"""wm AS (SELECT sum({col} * mask) / (sum(mask) + 1e-8) AS mu FROM {src}),
ws AS (SELECT mu, 1 / sqrt(sum(({col} - mu) * ({col} - mu) * mask) / (sum(mask) + 1e-8) * (sum(mask) / (sum(mask) - 1)) + 1e-8) AS inv FROM {src}, wm GROUP BY mu)"""


@query("gae_tokens", ctes(T, "tk AS (SELECT *, CAST(sum(mask) OVER (PARTITION BY sample_id ORDER BY pos) - mask AS BIGINT) AS k FROM tokens)", """
vt AS (SELECT sample_id, k, score + 0.97 * coalesce(lead(val) OVER (PARTITION BY sample_id ORDER BY k), 0) - val AS delta,
  max(k) OVER (PARTITION BY sample_id) AS kmax FROM tk WHERE mask = 1)""", """
rec(sample_id, k, adv) AS (SELECT sample_id, k, delta FROM vt WHERE k = kmax
  UNION ALL SELECT v.sample_id, v.k, v.delta + 0.97 * 0.9 * rec.adv FROM rec JOIN vt v ON v.sample_id = rec.sample_id AND v.k = rec.k - 1)""", """
al AS (SELECT tk.*, coalesce(adv, 0) AS adv FROM tk LEFT JOIN rec USING (sample_id, k))""", white("al", "adv")) + f"""
SELECT sample_id, pos, {r('(adv - mu) * inv')} AS advantage, {r('adv + val')} AS ret FROM al, ws""")
def _(spark, d):
    return op.gae_tokens(t.tokens(spark, d), 0.97, 0.9).select("sample_id", "pos", r6("advantage").alias("advantage"), r6("ret").alias("ret"))


def _turn_tokens(spark, d):
    x = t.tokens(spark, d).withColumnRenamed("sample_id", "traj_idx")
    x = x.withColumn("turn_idx", F.floor(F.col("pos") / 4))
    x = x.select("uid", "traj_idx", "turn_idx", (F.col("pos") % 4).alias("pos"), "score", "val", "mask")
    return x.unionByName(x.filter("turn_idx = 0"))


TT = """x AS (SELECT uid, sample_id AS traj_idx, pos // 4 AS turn_idx, pos % 4 AS pos, score, val, mask FROM tokens),
tr AS (SELECT uid, traj_idx, turn_idx, sum(score * mask) AS r, coalesce({pick}(val, pos) FILTER (WHERE mask = 1), 0) AS v,
  {edge}(pos) FILTER (WHERE mask = 1) AS at_pos FROM x GROUP BY ALL),
dl AS (SELECT *, r + 0.97 * coalesce(lead(v) OVER (PARTITION BY uid, traj_idx ORDER BY turn_idx), 0) - v AS delta,
  max(turn_idx) OVER (PARTITION BY uid, traj_idx) AS last FROM tr),
rec(uid, traj_idx, turn_idx, a) AS (SELECT uid, traj_idx, turn_idx, delta FROM dl WHERE turn_idx = last
  UNION ALL SELECT d.uid, d.traj_idx, d.turn_idx, d.delta + 0.97 * 0.9 * rec.a FROM rec
  JOIN dl d ON d.uid = rec.uid AND d.traj_idx = rec.traj_idx AND d.turn_idx = rec.turn_idx - 1),
al AS (SELECT x.*, CASE WHEN mask = 1 THEN a ELSE 0 END AS adv, CASE WHEN pos = at_pos THEN a + v ELSE -100 END AS ret
  FROM x JOIN dl USING (uid, traj_idx, turn_idx) JOIN rec USING (uid, traj_idx, turn_idx))"""


def _gae_turns(name, where, pick, edge):
    sql = ctes(T, TT.format(pick=pick, edge=edge), white("al", "adv"), f"""o AS (SELECT uid, traj_idx, turn_idx, pos, {r('(adv - mu) * inv')} AS advantage,
  {r('ret')} AS ret FROM al, ws)""")

    @query(name, sql + "SELECT * FROM o UNION ALL SELECT * FROM o WHERE turn_idx = 0")
    def _(spark, d):
        return op.gae_turns(_turn_tokens(spark, d), 0.97, 0.9, where).select(
            "uid", "traj_idx", "turn_idx", "pos", r6("advantage").alias("advantage"), r6("ret").alias("ret"))


_gae_turns("gae_turns_last", "last", "max_by", "max")
_gae_turns("gae_turns_first", "first", "min_by", "min")


@query("adv_reinforce_pp_baseline", ctes(T, "s AS (SELECT uid, sample_id, sum(score) AS r FROM tokens GROUP BY ALL)", """
b AS (SELECT sample_id, r - CASE WHEN count(*) OVER (PARTITION BY uid) = 1 THEN 0 ELSE avg(r) OVER (PARTITION BY uid) END AS a FROM s)""",
       "al AS (SELECT tokens.*, a * mask AS adv FROM tokens JOIN b USING (sample_id))", white("al", "adv")) + f"""
SELECT sample_id, pos, {r('(adv - mu) * inv * mask')} AS advantage FROM al, ws""")
def _(spark, d):
    return op.reinforce_pp_baseline(t.tokens(spark, d)).select("sample_id", "pos", r6("advantage").alias("advantage"))


@query("adv_reinforce_pp", ctes(T, "mx AS (SELECT sample_id, max(pos) AS last FROM tokens GROUP BY 1)", """
rec(sample_id, pos, ret, mask) AS (SELECT sample_id, pos, score, mask FROM tokens JOIN mx USING (sample_id) WHERE pos = last
  UNION ALL SELECT t.sample_id, t.pos, t.score + 0.970873786407767 * rec.ret * rec.mask, t.mask FROM rec JOIN tokens t ON t.sample_id = rec.sample_id AND t.pos = rec.pos - 1)""",
       white("rec", "ret")) + f"SELECT sample_id, pos, {r('ret')} AS ret, {r('(ret - mu) * inv * mask')} AS advantage FROM rec, ws")
def _(spark, d):
    return op.reinforce_pp(t.tokens(spark, d), 0.970873786407767).select("sample_id", "pos", r6("ret").alias("ret"), r6("advantage").alias("advantage"))


@query("adv_remax", ctes(T, "bl AS (SELECT sample_id, max(score) AS baseline FROM tokens GROUP BY 1)", """
c AS (SELECT *, sum(score * mask) OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM tokens)""") + f"""
SELECT sample_id, pos, {r('ret')} AS ret, {r('ret - baseline * mask')} AS advantage FROM c JOIN bl USING (sample_id)""")
def _(spark, d):
    x = t.tokens(spark, d)
    return op.remax(x, x.groupBy("sample_id").agg(F.max("score").alias("baseline"))).select(
        "sample_id", "pos", r6("ret").alias("ret"), r6("advantage").alias("advantage"))


@query("adv_multi_source_rloo", ctes(T, t.SAMPLES_SQL, """
p AS (SELECT t.uid, t.sample_id, sum(t.score * t.mask) / sum(t.mask) AS m, max(pos) AS last, any_value(acc) AS acc FROM tokens t JOIN samples USING (sample_id) GROUP BY ALL)""", """
q AS (SELECT *, count(*) OVER w AS n, sum(m) OVER w AS ms, sum(acc) OVER w AS accs FROM p WINDOW w AS (PARTITION BY uid))""", """
y AS (SELECT t.*, (CASE WHEN mask = 1 THEN score * n / (n - 1) - ms / (n - 1) ELSE 0 END * 5
  + CASE WHEN pos = last THEN acc * n / (n - 1) - accs / (n - 1) ELSE 0 END * 2) * mask AS x FROM tokens t JOIN q USING (sample_id))""", """
al AS (SELECT *, sum(x) OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM y)""", white("al", "ret")) + f"""
SELECT sample_id, pos, {r('ret')} AS ret, {r('(ret - mu) * inv')} AS advantage FROM al, ws""")
def _(spark, d):
    return op.multi_source_rloo(t.tokens(spark, d), t.samples(spark, d).select("sample_id", "acc"), 5.0, 2.0).select(
        "sample_id", "pos", r6("ret").alias("ret"), r6("advantage").alias("advantage"))


K3 = "least(10, greatest(-10, exp(ref_logp - old_logp) - (ref_logp - old_logp) - 1))"
KLS = {"k1": "(old_logp - ref_logp)", "abs": "abs(old_logp - ref_logp)", "mse": "0.5 * (old_logp - ref_logp) * (old_logp - ref_logp)", "low_var_kl": K3}


@query("kl_penalty_rewards", ctes(T) + " UNION ALL ".join(
    f"SELECT '{k}' AS estimator, sample_id, pos, {r(e + ' * mask')} AS kl, {r(f'score - 0.05 * {e} * mask')} AS penalised FROM tokens" for k, e in KLS.items()))
def _(spark, d):
    out = None
    for k in KLS:
        x = op.kl_penalty(t.tokens(spark, d), 0.05, k).select(F.lit(k).alias("estimator"), "sample_id", "pos", r6("kl").alias("kl"), r6("penalised").alias("penalised"))
        out = x if out is None else out.unionByName(x)
    return out


@query("mean_sequence_kl", ctes(T, f"s AS (SELECT sample_id, sum({K3} * mask) / (sum(mask) + 1e-8) AS k FROM tokens GROUP BY 1)") + f"SELECT {r('avg(k)')} AS mean_kl FROM s")
def _(spark, d):
    return op.mean_sequence_kl(t.tokens(spark, d), "low_var_kl").select(r6("mean_kl").alias("mean_kl"))


@query("adaptive_kl_coef", ctes("""st AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS step, avg(value) / 100 AS kl, count(*) AS n FROM events GROUP BY 1)""") + f"""
SELECT step, {r('0.2 * exp(sum(ln(1 + greatest(-0.2, least(0.2, kl / 0.5 - 1)) * n / 10000.0)) OVER (ORDER BY step))')} AS coef FROM st""")
def _(spark, d):
    s = t.table(spark, d, "events").groupBy(F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("step")).agg(
        (F.avg("value") / 100).alias("kl"), F.count(F.lit(1)).alias("n"))
    return op.adaptive_kl_coef(s, 0.2, 0.5, 10000.0).select("step", r6("coef").alias("coef"))


@query("masked_whiten", ctes(T, white("tokens", "score")) + f"SELECT sample_id, pos, {r('(score - mu) * inv')} AS white, {r('(score - mu) * inv + mu')} AS shifted FROM tokens, ws")
def _(spark, d):
    x = whiten(t.tokens(spark, d), "score", F.col("mask") == 1, "white")
    return whiten(x, "score", F.col("mask") == 1, "shifted", keep_mean=True).select("sample_id", "pos", r6("white").alias("white"), r6("shifted").alias("shifted"))


LR = """lr AS (SELECT *, old_logp - rollout_logp AS lr FROM tokens),
sq AS (SELECT sample_id, sum(lr * mask) AS lrs, sum(mask) AS n, sum(lr * mask) / (sum(mask) + 1e-8) AS lrm FROM lr GROUP BY 1),
wt AS (SELECT lr.*, lrs, lrm, exp(lr) AS w_tok, exp(least(20, greatest(-20, lrs))) AS w_seq, exp(lrm) AS w_geo FROM lr JOIN sq USING (sample_id))"""


@query("importance_weights", ctes(T, LR, "a AS (SELECT *, least(w_tok * mask, 2.0) AS x, least(w_seq * mask, 2.0) AS y FROM wt)",
       "m AS (SELECT sum(x * mask) / (sum(mask) + 1e-8) AS mx FROM a)") + f"""
SELECT sample_id, pos, {r('x')} AS token_weight, {r('y')} AS sequence_weight, {r('x / mx')} AS normalised_weight FROM a, m""")
def _(spark, d):
    x = t.tokens(spark, d)
    a = op.importance_weights(x, "token", 2.0).withColumnRenamed("weight", "token_weight")
    a = op.importance_weights(a, "sequence", 2.0).withColumnRenamed("weight", "sequence_weight")
    a = op.importance_weights(a, "token", 2.0, batch_normalise=True)
    return a.select("sample_id", "pos", r6("token_weight").alias("token_weight"), r6("sequence_weight").alias("sequence_weight"), r6("weight").alias("normalised_weight"))


@query("rejection_mask", ctes(T, LR) + """SELECT sample_id, pos, CASE WHEN w_tok BETWEEN 0.6666666666666666 AND 1.5 THEN mask ELSE 0 END AS token_mask,
  CASE WHEN w_seq BETWEEN 0.6666666666666666 AND 1.5 THEN mask ELSE 0 END AS sequence_mask, CASE WHEN w_geo BETWEEN 0.95 AND 1.05 THEN mask ELSE 0 END AS geometric_mask FROM wt""")
def _(spark, d):
    x = op.rejection_mask(t.tokens(spark, d), "token", 1.5).withColumnRenamed("new_mask", "token_mask")
    x = op.rejection_mask(x, "sequence", 1.5).withColumnRenamed("new_mask", "sequence_mask")
    x = op.rejection_mask(x, "geometric", 1.05, 0.95).withColumnRenamed("new_mask", "geometric_mask")
    return x.select("sample_id", "pos", "token_mask", "sequence_mask", "geometric_mask")


@query("rejection_stats", ctes(T, LR, *[
        f"s{n} AS (SELECT sample_id, mask, CASE WHEN {w} BETWEEN 0.6666666666666666 AND 1.5 THEN 0 ELSE 1 END AS b FROM wt)"
        for n, w in (("token", "w_tok"), ("sequence", "w_seq"), ("geometric", "w_geo"))]) + " UNION ALL ".join(
    f"""SELECT '{n}' AS level, {r('sum(b * mask) / (sum(mask) + 1e-8)')} AS masked_fraction,
  {r(f'(SELECT avg(f) FROM (SELECT max(b {"* mask" if n == "token" else ""}) AS f FROM s{n} GROUP BY sample_id))')} AS seq_masked_fraction FROM s{n}"""
    for n in ("token", "sequence", "geometric")))
def _(spark, d):
    return op.rejection_stats(t.tokens(spark, d), 1.5).select("level", r6("masked_fraction").alias("masked_fraction"), r6("seq_masked_fraction").alias("seq_masked_fraction"))


IS_COLS = ("mean", "max", "min", "std", "eff_sample_size", "fraction_high", "fraction_low", "seq_mean", "seq_std", "seq_max", "seq_min",
           "seq_max_deviation", "seq_fraction_high", "seq_fraction_low")


def _is_sql(level, w):
    own = {"token": ("max(w) FILTER (WHERE mask = 1)", "min(w) FILTER (WHERE mask = 1)", "sum(CASE WHEN w > 1.5 THEN mask ELSE 0 END) / (sum(mask) + 1e-8)",
                     "sum(CASE WHEN w < 1 / 1.5 THEN mask ELSE 0 END) / (sum(mask) + 1e-8)"),
           "sequence": ("(SELECT exp(least(20, max(lrs))) FROM sq)", "(SELECT exp(min(lrs)) FROM sq)",
                        "(SELECT avg(CASE WHEN lrs > ln(1.5) THEN 1.0 ELSE 0 END) FROM sq)", "(SELECT avg(CASE WHEN lrs < ln(1 / 1.5) THEN 1.0 ELSE 0 END) FROM sq)")}[level]
    vals = {"mean": "sum(w * mask) / (sum(mask) + 1e-8)", "max": own[0], "min": own[1], "fraction_high": own[2], "fraction_low": own[3],
            "std": "sqrt(greatest(sum(c * c * mask) / (sum(mask) + 1e-8) - pow(sum(c * mask) / (sum(mask) + 1e-8), 2), 0))",
            "eff_sample_size": "1 / (sum(c * c * mask) / (sum(mask) + 1e-8) / pow(sum(c * mask) / (sum(mask) + 1e-8) + 1e-8, 2))"}
    seq = {"seq_mean": "avg(q)", "seq_std": "stddev_samp(q)", "seq_max": "max(q)", "seq_min": "min(q)", "seq_max_deviation": "max(abs(q - 1))",
           "seq_fraction_high": "avg(CASE WHEN q > 1.5 THEN 1.0 ELSE 0 END)", "seq_fraction_low": "avg(CASE WHEN q < 1 / 1.5 THEN 1.0 ELSE 0 END)"}
    vals |= {k: f"(SELECT {v} FROM q{level})" for k, v in seq.items()}
    return (f"""t{level} AS (SELECT sample_id, mask, {w} AS w, least(1.5, greatest(1 / 1.5, {w})) AS c FROM wt),
q{level} AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS q FROM t{level} GROUP BY sample_id)""",
            f"SELECT '{level}' AS level, " + ", ".join(f'{r(vals[c])} AS "{c}"' for c in IS_COLS) + f" FROM t{level}")


_TOK, _SEQ = _is_sql("token", "w_tok"), _is_sql("sequence", "w_seq")


@query("importance_stats", ctes(T, LR, _TOK[0], _SEQ[0]) + _TOK[1] + " UNION ALL " + _SEQ[1])
def _(spark, d):
    x = t.tokens(spark, d)
    both = op.importance_stats(x, "token", 1.5).unionByName(op.importance_stats(x, "sequence", 1.5))
    return both.select("level", *[r6(c).alias(c) for c in IS_COLS])


OFF = {"training_ppl": "avg(exp(-mo))", "training_log_ppl": "avg(-mo)", "kl": "sum(kl) / (sum(n) + 1e-8)", "k3_kl": "sum(k3) / (sum(n) + 1e-8)",
       "rollout_ppl": "avg(exp(-mr))", "rollout_log_ppl": "avg(-mr)", "log_ppl_diff": "avg(mr - mo)", "log_ppl_abs_diff": "avg(abs(mr - mo))",
       "log_ppl_diff_max": "max(mr - mo)", "log_ppl_diff_min": "min(mr - mo)", "ppl_ratio": "avg(exp(mr - mo))",
       "chi2_token": "sum(rr) / (sum(n) + 1e-8) - 1", "chi2_seq": "avg(exp(2 * least(20, greatest(-20, lrs)))) - 1"}


@query("offpolicy_stats", ctes(T, """p AS (SELECT sample_id, sum(mask) AS n, sum(old_logp * mask) / (sum(mask) + 1e-8) AS mo, sum(rollout_logp * mask) / (sum(mask) + 1e-8) AS mr,
  sum((rollout_logp - old_logp) * mask) AS kl, sum((exp(old_logp - rollout_logp) - (old_logp - rollout_logp) - 1) * mask) AS k3,
  sum(exp(2 * (old_logp - rollout_logp)) * mask) AS rr, sum((old_logp - rollout_logp) * mask) AS lrs FROM tokens GROUP BY 1)""") +
       "SELECT " + ", ".join(f"{r(v)} AS {k}" for k, v in OFF.items()) + " FROM p")
def _(spark, d):
    return op.offpolicy_stats(t.tokens(spark, d)).select(*[r6(c).alias(c) for c in OFF])


LOSS = {"token_mean": "sum(s) / (sum(n) + 1e-8)", "seq_mean_token_sum": "avg(s)", "seq_mean_token_mean": "avg(s / n)", "seq_mean_token_sum_norm": "sum(s) / max(w)"}


@query("aggregate_loss", ctes(T, "p AS (SELECT sample_id, sum(-old_logp * val * mask) AS s, sum(mask) AS n, count(*) AS w FROM tokens GROUP BY 1)") +
       "SELECT " + ", ".join(f"{r(v)} AS {k}" for k, v in LOSS.items()) + " FROM p")
def _(spark, d):
    return op.aggregate_loss(t.tokens(spark, d), -F.col("old_logp") * F.col("val")).select(*[r6(c).alias(c) for c in LOSS])


BM_SEQ = {f"{c}_{n}": f"{f}({c})" for c in ("score", "reward") for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))} | {
    "response_length_mean": "avg(len)", "response_length_max": "max(len)", "response_length_min": "min(len)", "clip_ratio": "avg(CASE WHEN len = 50 THEN 1.0 ELSE 0 END)",
    "aborted_ratio": "avg(CASE WHEN len = 0 THEN 1.0 ELSE 0 END)", "num_turns_mean": "avg(turns)"}
BM_TOK = {f"{c}_{n}": f"(SELECT {f}({c}) FROM bt WHERE mask = 1)" for c in ("adv", "ret", "val") for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"))} | {
    "explained_var": "(SELECT 1 - var_samp(ret - val) / (var_samp(ret) + 1e-5) FROM bt WHERE mask = 1)"}


@query("batch_data_metrics", ctes(T, "bt AS (SELECT *, score - 0.05 * (old_logp - ref_logp) * mask AS reward, score - val AS adv, score AS ret, pos // 4 AS turns FROM tokens)",
       "bp AS (SELECT sample_id, sum(score) AS score, sum(reward) AS reward, sum(mask) AS len, max(turns) AS turns FROM bt GROUP BY 1)") +
       "SELECT " + ", ".join(f"{r(v)} AS {k}" for k, v in (BM_SEQ | BM_TOK).items()) + " FROM bp")
def _(spark, d):
    x = op.kl_penalty(t.tokens(spark, d), 0.05, "k1").withColumnRenamed("penalised", "reward")
    x = x.withColumn("adv", F.col("score") - F.col("val")).withColumn("ret", F.col("score")).withColumn("turns", F.floor(F.col("pos") / 4))
    return op.batch_data_metrics(x, 50).select(*[r6(F.col(c).cast("double")).alias(c) for c in (BM_SEQ | BM_TOK)])


@query("timing_throughput", ctes("""tm AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS step, event_type AS section, sum(value) / 10 AS seconds FROM events GROUP BY ALL)""", """
tk AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS step, count(*) FILTER (WHERE event_type = 'view') AS pt, count(*) FILTER (WHERE event_type <> 'view') AS rt FROM events GROUP BY 1)""") + f"""
SELECT step, section, {r('seconds')} AS seconds, {r("seconds * 1000 / CASE WHEN section = 'click' THEN rt ELSE pt + rt END")} AS ms_per_token,
 {r("CASE WHEN section = 'signup' THEN (pt + rt) / (seconds * 8) END")} AS throughput FROM tm JOIN tk USING (step)""")
def _(spark, d):
    e = t.table(spark, d, "events").withColumn("step", F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long"))
    timing = e.groupBy("step", F.col("event_type").alias("section")).agg((F.sum("value") / 10).alias("seconds"))
    toks = e.groupBy("step").agg(F.count_if(F.col("event_type") == "view").alias("prompt_tokens"), F.count_if(F.col("event_type") != "view").alias("response_tokens"))
    return op.timing_throughput(timing, toks, 8, whole="signup", generate="click").select(
        "step", "section", *[r6(c).alias(c) for c in ("seconds", "ms_per_token", "throughput")])
