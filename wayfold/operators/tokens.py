"""Token- and turn-level advantages, importance weights and batch statistics.

Inputs are exploded frames, one row per token: ``(sample_id, uid, pos, score, val, mask,
old_logp, rollout_logp, ref_logp)``.  Backward recursions are solved in chunks, so even a
sample of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.ordering import discounted_suffix, numbered, position_chunk, running
from wayfold.functions.stats import TINY, masked_mean, one, whiten
from wayfold.session import materialize

CLAMP = 20.0


def gae_tokens(tokens: DataFrame, gamma: float, lam: float) -> DataFrame:
    """Generalised advantage over valid tokens; a masked token carries the next valid one's value."""
    t = materialize(running(tokens, ["sample_id"], ["pos"], F.col("mask"), "k", position_chunk("pos"), inclusive=False))
    v = t.filter("mask = 1").select("sample_id", "k", "score", "val")
    nxt = v.select("sample_id", (F.col("k") - 1).alias("k"), F.col("val").alias("next_val"))
    v = v.join(nxt, ["sample_id", "k"], "left").withColumn(
        "delta", F.col("score") + gamma * F.coalesce("next_val", F.lit(0.0)) - F.col("val"))
    v = discounted_suffix(v.select("sample_id", "k", "delta"), ["sample_id"], "k", "delta", gamma * lam, "adv").select("sample_id", "k", "adv")
    t = t.join(v, ["sample_id", "k"], "left").withColumn("adv", F.coalesce("adv", F.lit(0.0)))
    t = t.withColumn("ret", F.col("adv") + F.col("val"))
    return whiten(t, "adv", F.col("mask") == 1, "advantage", costly=True).drop("k", "adv")


def gae_turns(tokens: DataFrame, gamma: float, lam: float, value_at: str = "last", ignore: float = -100.0) -> DataFrame:
    """Turn-level advantage per (uid, traj_idx); returns only at the supervised token of each turn.

    Repeated (uid, traj_idx, turn_idx) rows left by padding count once and all receive the result.
    """
    key = ["uid", "traj_idx", "turn_idx"]
    pick = F.max_by if value_at == "last" else F.min_by
    edge = F.max if value_at == "last" else F.min
    uniq = tokens.dropDuplicates([*key, "pos"])
    valid_pos = F.when(F.col("mask") == 1, F.col("pos"))
    turns = uniq.groupBy(*key).agg(F.sum(F.col("score") * F.col("mask")).alias("r"),
                                   F.coalesce(pick("val", valid_pos), F.lit(0.0)).alias("v"), edge(valid_pos).alias("at"))
    turns = materialize(numbered(turns, key[:2], ["turn_idx"], "k", position_chunk("turn_idx")))
    nxt = turns.select("uid", "traj_idx", (F.col("k") - 1).alias("k"), F.col("v").alias("nv"))
    turns = turns.join(nxt, ["uid", "traj_idx", "k"], "left").withColumn(
        "delta", F.col("r") + gamma * F.coalesce("nv", F.lit(0.0)) - F.col("v"))
    turns = discounted_suffix(turns, key[:2], "k", "delta", gamma * lam, "a").select(*key, "v", "at", "a")
    t = uniq.select(*key, "pos", "mask").join(turns, key)
    t = t.withColumn("adv", F.when(F.col("mask") == 1, F.col("a")).otherwise(0.0))
    t = t.withColumn("ret", F.when(F.col("pos") == F.col("at"), F.col("a") + F.col("v")).otherwise(ignore))
    t = whiten(t, "adv", F.col("mask") == 1, "advantage", costly=True).select(*key, "pos", "advantage", "ret")
    return tokens.join(t, [*key, "pos"])


def reinforce_pp_baseline(tokens: DataFrame) -> DataFrame:
    """Sample reward minus the prompt mean, whitened over valid tokens."""
    s = tokens.groupBy("uid", "sample_id").agg(F.sum("score").alias("r"))
    g = s.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mu"))
    s = s.join(g, "uid").select("sample_id", (F.col("r") - F.when(F.col("n") == 1, 0.0).otherwise(F.col("mu"))).alias("adv"))
    t = tokens.join(s, "sample_id").withColumn("adv", F.col("adv") * F.col("mask"))
    return whiten(t, "adv", F.col("mask") == 1, "advantage").withColumn("advantage", F.col("advantage") * F.col("mask")).drop("adv")


def reinforce_pp(tokens: DataFrame, gamma: float) -> DataFrame:
    """Discounted return to the end, cut at masked tokens, whitened.

    A masked token cuts the link into it, so the return is a discounted suffix sum inside
    the segment that starts at each masked token.
    """
    t = running(tokens, ["sample_id"], ["pos"], 1 - F.col("mask"), "segment", position_chunk("pos"))
    t = discounted_suffix(t, ["sample_id", "segment"], "pos", "score", gamma, "ret")
    return whiten(t, "ret", F.col("mask") == 1, "advantage", costly=True).withColumn("advantage", F.col("advantage") * F.col("mask")).drop("segment")


def remax(tokens: DataFrame, baselines: DataFrame) -> DataFrame:
    """Reward to go minus the sample's greedy baseline."""
    t = tokens.withColumn("mr", F.col("score") * F.col("mask"))
    t = discounted_suffix(t, ["sample_id"], "pos", "mr", 1.0, "ret").drop("mr")
    return t.join(baselines, "sample_id").withColumn("advantage", F.col("ret") - F.col("baseline") * F.col("mask"))


def multi_source_rloo(tokens: DataFrame, outcomes: DataFrame, dense_coef: float, outcome_coef: float) -> DataFrame:
    """Leave-one-out on dense token rewards and on the outcome at the last token, summed and cumulated."""
    per = tokens.groupBy("uid", "sample_id").agg(F.expr("sum(score * mask) / sum(mask)").alias("m"), F.max("pos").alias("last"))
    per = per.join(outcomes, "sample_id")
    g = per.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("ms"), F.sum("acc").alias("accs"))
    per = per.join(g, "uid").select("sample_id", "acc", "last", F.expr("try_divide(n, n - 1)").alias("up"),
                                    F.expr("try_divide(ms, n - 1)").alias("b_dense"), F.expr("try_divide(accs, n - 1)").alias("b_out"))
    dense = F.when(F.col("mask") == 1, F.col("score") * F.col("up") - F.col("b_dense")).otherwise(0.0)
    outcome = F.when(F.col("pos") == F.col("last"), F.col("acc") * F.col("up") - F.col("b_out")).otherwise(0.0)
    t = tokens.join(per, "sample_id").withColumn("x", (dense * dense_coef + outcome * outcome_coef) * F.col("mask"))
    t = discounted_suffix(t, ["sample_id"], "pos", "x", 1.0, "ret")
    return whiten(t, "ret", F.col("mask") == 1, "advantage", costly=True).drop("x", "acc", "last", "up", "b_dense", "b_out")


def kl_estimate(kind: str) -> Column:
    """Per-token estimate of the divergence from the reference policy."""
    d = F.col("old_logp") - F.col("ref_logp")
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        x = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), -d))
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(x) - x - 1))
    raise ValueError(f"unknown divergence estimator {kind!r}")


def kl_penalty(tokens: DataFrame, beta: float, kind: str) -> DataFrame:
    """Divergence on valid tokens and the reward after subtracting beta times it."""
    return tokens.withColumn("kl", kl_estimate(kind) * F.col("mask")).withColumn("penalised", F.col("score") - beta * F.col("kl"))


def mean_sequence_kl(tokens: DataFrame, kind: str) -> DataFrame:
    per = tokens.groupBy("sample_id").agg(masked_mean(kl_estimate(kind), F.col("mask")).alias("k"))
    return per.agg(F.avg("k").alias("mean_kl"))


def adaptive_kl_coef(steps: DataFrame, start: float, target: float, horizon: float) -> DataFrame:
    """Coefficient after each step: times 1 + clip(kl / target - 1, +-0.2) * n / horizon."""
    err = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("kl") / target - 1))
    s = steps.withColumn("mult", 1 + err * F.col("n") / horizon)
    return running(s, [], ["step"], F.ln("mult"), "lm", position_chunk("step")).withColumn("coef", start * F.exp("lm")).drop("lm", "mult")


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), c))


def log_ratios(tokens: DataFrame) -> DataFrame:
    """Attach the token log ratio and its per-sample sum and mean over valid tokens."""
    t = tokens.withColumn("lr", F.col("old_logp") - F.col("rollout_logp"))
    per = t.groupBy("sample_id").agg(F.sum(F.col("lr") * F.col("mask")).alias("lr_sum"), F.sum("mask").alias("n_valid"))
    per = per.withColumn("lr_mean", F.col("lr_sum") / (F.col("n_valid") + TINY))
    return t.join(per, "sample_id")


def _weight(level: str) -> Column:
    return F.exp(_clamped(F.col({"token": "lr", "sequence": "lr_sum", "geometric": "lr_mean"}[level])))


def importance_weights(tokens: DataFrame, level: str, threshold: float, batch_normalise: bool = False) -> DataFrame:
    """Truncated importance weights, per token or per sequence; optionally divided by their mean."""
    t = log_ratios(tokens).withColumn("weight", F.least(_weight(level) * F.col("mask"), F.lit(threshold)))
    if batch_normalise:
        if level == "token":
            m = t.agg(masked_mean(F.col("weight"), F.col("mask")).alias("m"))
        else:
            m = t.groupBy("sample_id").agg(masked_mean(F.col("weight"), F.col("mask")).alias("s")).agg(F.avg("s").alias("m"))
        mean = one(m)["m"]
        t = t.withColumn("weight", F.when(mean > TINY, F.col("weight") / mean).otherwise(F.col("weight")))
    return t.drop("lr", "lr_sum", "lr_mean", "n_valid")


def rejection_mask(tokens: DataFrame, level: str, upper: float, lower: float | None = None) -> DataFrame:
    """Mask off tokens (or whole samples) whose ratio leaves [lower, upper]; lower is 1/upper by default."""
    t = log_ratios(tokens).withColumn("accepted", _weight(level).between(lower if lower is not None else 1.0 / upper, upper).cast("int"))
    return t.withColumn("new_mask", F.col("mask") * F.col("accepted")).drop("lr", "lr_sum", "lr_mean", "n_valid")


def rejection_stats(tokens: DataFrame, upper: float, lower: float | None = None) -> DataFrame:
    """Share of rejected tokens and samples for each of the three levels."""
    out = None
    for level in ("token", "sequence", "geometric"):
        t = rejection_mask(tokens, level, upper, lower)
        per = t.groupBy("sample_id").agg(F.sum((1 - F.col("accepted")) * F.col("mask")).alias("bad"), F.sum("mask").alias("n"),
                                         F.max(1 - F.col("accepted")).alias("any_bad"))
        seq = F.avg((F.col("bad") > 0).cast("double")) if level == "token" else F.avg(F.col("any_bad").cast("double"))
        row = per.agg(F.lit(level).alias("level"), (F.sum("bad") / (F.sum("n") + TINY)).alias("masked_fraction"), seq.alias("seq_masked_fraction"))
        out = row if out is None else out.unionByName(row)
    return out


def importance_stats(tokens: DataFrame, level: str, threshold: float) -> DataFrame:
    """Mean, spread, extremes, effective sample size and out-of-band shares of the weights."""
    lo, hi = 1.0 / threshold, threshold
    t = log_ratios(tokens).withColumn("w", _weight(level))
    t = t.withColumn("c", F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("w"))))
    m, w, c = F.col("mask"), F.col("w"), F.col("c")
    ok = m == 1
    per = t.groupBy("sample_id").agg(
        F.sum(m).alias("n"), F.sum(w * m).alias("sw"), F.sum(c * m).alias("sc"), F.sum(c * c * m).alias("scc"),
        F.max(F.when(ok, w)).alias("wmax"), F.min(F.when(ok, w)).alias("wmin"),
        F.sum((w > hi).cast("int") * m).alias("above"), F.sum((w < lo).cast("int") * m).alias("below"), F.first("lr_sum").alias("lr_sum"))
    per = per.withColumn("seq", F.col("sw") / (F.col("n") + TINY))
    if level == "token":
        high, low = F.sum("above") / (F.sum("n") + TINY), F.sum("below") / (F.sum("n") + TINY)
        top, bottom = F.max("wmax"), F.min("wmin")
    else:
        high, low = F.avg((F.col("lr_sum") > F.ln(F.lit(hi))).cast("double")), F.avg((F.col("lr_sum") < F.ln(F.lit(lo))).cast("double"))
        top, bottom = F.exp(F.least(F.max("lr_sum"), F.lit(CLAMP))), F.exp(F.min("lr_sum"))
    s = per.agg(
        F.lit(level).alias("level"), (F.sum("sw") / (F.sum("n") + TINY)).alias("mean"), top.alias("max"), bottom.alias("min"),
        high.alias("fraction_high"), low.alias("fraction_low"), (F.sum("sc") / (F.sum("n") + TINY)).alias("_mc"),
        (F.sum("scc") / (F.sum("n") + TINY)).alias("_mcc"), F.sum("n").alias("_n"), F.avg("seq").alias("seq_mean"),
        F.coalesce(F.stddev_samp("seq"), F.lit(0.0)).alias("seq_std"), F.max("seq").alias("seq_max"), F.min("seq").alias("seq_min"),
        F.max(F.abs(F.col("seq") - 1)).alias("seq_max_deviation"), F.avg((F.col("seq") > hi).cast("double")).alias("seq_fraction_high"),
        F.avg((F.col("seq") < lo).cast("double")).alias("seq_fraction_low"))
    mc = F.col("_mc")
    s = s.withColumn("std", F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.col("_mcc") - mc * mc, F.lit(0.0)))).otherwise(0.0))
    s = s.withColumn("eff_sample_size", (mc + TINY) * (mc + TINY) / F.col("_mcc"))
    return s.drop("_mc", "_mcc", "_n")


def offpolicy_stats(tokens: DataFrame) -> DataFrame:
    """Perplexities, divergences and chi-squared distances between training and rollout policy."""
    m, lr = F.col("mask"), F.col("old_logp") - F.col("rollout_logp")
    rho = F.exp(_clamped(lr))
    per = tokens.groupBy("sample_id").agg(
        F.sum(m).alias("n"), F.sum(F.col("old_logp") * m).alias("so"), F.sum(F.col("rollout_logp") * m).alias("sr"), F.sum(-lr * m).alias("kl"),
        F.sum((F.exp(lr) - lr - 1) * m).alias("k3"), F.sum(rho * rho * m).alias("rr"), F.sum(lr * m).alias("lrs"))
    den = F.col("n") + TINY
    per = per.withColumn("mo", F.col("so") / den).withColumn("mr", F.col("sr") / den).withColumn("dl", F.col("mr") - F.col("mo"))
    total = F.sum("n") + TINY
    return per.agg(
        F.avg(F.exp(-F.col("mo"))).alias("training_ppl"), F.avg(-F.col("mo")).alias("training_log_ppl"), (F.sum("kl") / total).alias("kl"),
        (F.sum("k3") / total).alias("k3_kl"), F.avg(F.exp(-F.col("mr"))).alias("rollout_ppl"), F.avg(-F.col("mr")).alias("rollout_log_ppl"),
        F.avg("dl").alias("log_ppl_diff"), F.avg(F.abs("dl")).alias("log_ppl_abs_diff"), F.max("dl").alias("log_ppl_diff_max"),
        F.min("dl").alias("log_ppl_diff_min"), F.avg(F.exp("dl")).alias("ppl_ratio"), (F.sum("rr") / total - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * _clamped(F.col("lrs")))) - 1).alias("chi2_seq"))


def aggregate_loss(tokens: DataFrame, loss: Column) -> DataFrame:
    """The four reductions of a token loss to one number."""
    per = tokens.groupBy("sample_id").agg(F.sum(loss * F.col("mask")).alias("s"), F.sum("mask").alias("n"), F.count(F.lit(1)).alias("width"))
    return per.agg((F.sum("s") / (F.sum("n") + TINY)).alias("token_mean"), F.avg("s").alias("seq_mean_token_sum"),
                   F.avg(F.expr("try_divide(s, n)")).alias("seq_mean_token_mean"), (F.sum("s") / F.max("width")).alias("seq_mean_token_sum_norm"))


def batch_data_metrics(tokens: DataFrame, max_response: int) -> DataFrame:
    """Score, reward, advantage, return and value ranges, explained variance and length statistics."""
    m = F.col("mask") == 1
    per = tokens.groupBy("sample_id").agg(F.sum("score").alias("score"), F.sum("reward").alias("reward"), F.sum("mask").alias("len"),
                                          F.max("turns").alias("turns"))
    seq = per.agg(*[f(c).alias(f"{c}_{n}") for c in ("score", "reward") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))],
                  F.avg("len").alias("response_length_mean"), F.max("len").alias("response_length_max"), F.min("len").alias("response_length_min"),
                  F.avg((F.col("len") == max_response).cast("double")).alias("clip_ratio"),
                  F.avg((F.col("len") == 0).cast("double")).alias("aborted_ratio"), F.avg("turns").alias("num_turns_mean"))
    tok = tokens.filter(m).agg(
        *[f(c).alias(f"{c}_{n}") for c in ("adv", "ret", "val") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))],
        (1 - F.var_samp(F.col("ret") - F.col("val")) / (F.var_samp("ret") + 1e-5)).alias("explained_var"))
    s = one(tok)
    return seq.select("*", *[s[c].alias(c) for c in tok.columns])


def timing_throughput(timing: DataFrame, tokens: DataFrame, n_gpus: int, whole: str, generate: str) -> DataFrame:
    """Seconds and milliseconds per token by section, and tokens per second and device for the step."""
    t = timing.join(tokens, "step")
    n = F.when(F.col("section") == generate, F.col("response_tokens")).otherwise(F.col("prompt_tokens") + F.col("response_tokens"))
    rate = F.when(F.col("section") == whole, (F.col("prompt_tokens") + F.col("response_tokens")) / (F.col("seconds") * n_gpus))
    return t.select("step", "section", "seconds", (F.col("seconds") * 1000 / n).alias("ms_per_token"), rate.alias("throughput"))
