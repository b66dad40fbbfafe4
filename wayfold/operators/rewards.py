"""Group filters and outcome advantages: one reward per sample, several samples per prompt.

Inputs are frames of samples ``(uid, sample_id, reward, length)``.  Group statistics are
map-side combined and joined back, so a prompt with very many samples is never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.ordering import average_ranked, carried_forward, hash_int, hash_of, numbered, ranked, ranked_running
from wayfold.functions.stats import one, with_group
from wayfold.session import materialize

EPS = 1e-6


def group_variance(samples: DataFrame, ddof: int = 0) -> DataFrame:
    """Variance of the reward per prompt; a prompt with one sample has none."""
    var = F.var_pop("reward") if ddof == 0 else F.coalesce(F.var_samp("reward"), F.lit(0.0))
    return samples.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), var.alias("variance"))


def reward_variance(samples: DataFrame, ddof: int = 0) -> DataFrame:
    """Mean of the per-prompt reward variance."""
    return group_variance(samples, ddof).agg(F.avg("variance").alias("reward_variance"), F.count(F.lit(1)).alias("n_groups"))


def filter_topk_variance(samples: DataFrame, ratio: float, ddof: int = 0) -> DataFrame:
    """Samples of the ceil(groups * ratio) prompts of highest variance, at least one prompt."""
    g = ranked(group_variance(samples, ddof), [], [F.desc("variance"), "uid"], "rank")
    n = one(g.agg(F.count(F.lit(1)).alias("n")))["n"]
    kept = g.filter(F.col("rank") <= F.greatest(F.lit(1), F.ceil(n * F.lit(ratio)))).select("uid", "variance")
    return samples.join(kept, "uid")


def filter_topp_variance(samples: DataFrame, top_p: float, ddof: int = 0) -> DataFrame:
    """Prompts until their variance sums to ``top_p`` of the total; advantages shrink by sqrt(kept / all)."""
    g = ranked_running(group_variance(samples, ddof), [], [F.desc("variance"), "uid"], "rank", {"cum": "variance"})
    tot = one(g.agg(F.sum("variance").alias("total"), F.count(F.lit(1)).alias("n")))
    kept = g.filter((tot["total"] <= 0) | (F.col("rank") == 1) | (F.col("cum") - F.col("variance") < tot["total"] * top_p))
    n_kept = one(kept.agg(F.count(F.lit(1)).alias("k")))["k"]
    scale = F.when(tot["total"] <= 0, F.lit(1.0)).otherwise(F.sqrt(n_kept / tot["n"]))
    return samples.join(kept.select("uid", "variance"), "uid").withColumn("loss_scale", scale)


def variance_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Group count, sample count and variance range before and after a variance filter."""
    def line(df, stage):
        return group_variance(df).agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_samples"),
                                      F.avg("variance").alias("mean_variance"), F.min("variance").alias("min_variance"),
                                      F.max("variance").alias("max_variance"))
    return line(before, "before").unionByName(line(after, "after"))


def filter_zero_std_groups(samples: DataFrame, share: float) -> DataFrame:
    """Prompts whose reward varies (or that have one sample), the first ``share`` of all prompts by uid."""
    quota = one(samples.agg(F.count_distinct("uid").alias("n")))["n"] * F.lit(share)
    g = group_variance(samples).filter((F.col("variance") > 0) | (F.col("n") == 1))
    return samples.join(ranked(g, [], ["uid"], "rank").filter(F.col("rank") <= quota).select("uid"), "uid", "left_semi")


def filter_accuracy_band(samples: DataFrame, lo: float, hi: float, max_length: int, oversample: float) -> DataFrame:
    """Samples of in-band, untruncated prompts first; the leading 1/oversample of all samples stay."""
    s = with_group(samples, ["uid"], mean_score=F.avg("acc"), longest=F.max("length"))
    s = s.withColumn("passes", F.col("mean_score").between(lo, hi) & (F.col("longest") < max_length - 1))
    n = one(samples.agg(F.count(F.lit(1)).alias("n")))["n"]
    return ranked(s, [], [F.desc("passes"), "uid", "sample_id"], "rank").filter(F.col("rank") <= F.floor(n / F.lit(oversample)))


def _centred(samples: DataFrame) -> DataFrame:
    return with_group(samples, ["uid"], n=F.count(F.lit(1)), mu=F.avg("reward"), sd=F.stddev_samp("reward"))


def grpo(samples: DataFrame, normalise: bool = True) -> DataFrame:
    """(r - mean) / (std + eps) within the prompt; singletons keep mean 0 and std 1."""
    s = _centred(samples)
    mu = F.when(F.col("n") == 1, 0.0).otherwise(F.col("mu"))
    sd = F.when(F.col("n") == 1, 1.0).otherwise(F.col("sd"))
    adv = F.col("reward") - mu
    return s.withColumn("advantage", adv / (sd + EPS) if normalise else adv).drop("n", "mu", "sd")


def grpo_passk(samples: DataFrame, normalise: bool = True) -> DataFrame:
    """Only the best sample of a prompt gets its lead over the second best (first sample on ties)."""
    top = F.struct(F.col("reward").alias("r"), (-F.col("sample_id")).alias("i"))
    g = samples.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("reward").alias("sd"), F.max(top).alias("best"))
    s = samples.join(g, "uid")
    second = (s.filter(F.col("sample_id") != -F.col("best.i")).groupBy("uid").agg(F.max("reward").alias("second")))
    lead = F.col("best.r") - F.col("second")
    adv = lead / (F.col("sd") + EPS) if normalise else lead
    few = F.raise_error(F.concat(F.lit("prompt with fewer than two samples: "), F.col("uid").cast("string"))).cast("double")
    return (s.join(second, "uid", "left")
            .withColumn("advantage", F.when(F.col("n") < 2, few).when(F.col("sample_id") == -F.col("best.i"), adv).otherwise(0.0))
            .drop("n", "sd", "best", "second"))


def rloo(samples: DataFrame, singleton_keeps_reward: bool = False) -> DataFrame:
    """Leave-one-out baseline: n / (n - 1) * (r - mean)."""
    single = F.col("reward") if singleton_keeps_reward else F.lit(0.0)
    s = _centred(samples)
    adv = F.when(F.col("n") == 1, single).otherwise(F.expr("try_divide(n, n - 1) * (reward - mu)"))
    return s.withColumn("advantage", adv).drop("n", "mu", "sd")


def opo(samples: DataFrame) -> DataFrame:
    """Reward minus the length-weighted mean of the prompt; a singleton has baseline 0."""
    s = with_group(samples, ["uid"], n=F.count(F.lit(1)), lr=F.sum(F.col("length") * F.col("reward")), ln=F.sum("length"))
    base = F.when(F.col("n") == 1, 0.0).otherwise(F.col("lr") / F.col("ln"))
    return s.withColumn("advantage", F.col("reward") - base).drop("n", "lr", "ln")


def gpg(samples: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha * (r - mean) / f_norm with alpha = samples / samples of nonzero reward."""
    t = one(samples.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reward") != 0).alias("nz")))
    s = _centred(samples)
    mu = F.when(F.col("n") == 1, 0.0).otherwise(F.col("mu"))
    alpha = t["n"] / F.greatest(t["nz"], F.lit(1))
    return s.withColumn("advantage", alpha * (F.col("reward") - mu) / f_norm).drop("n", "mu", "sd")


def softmean_baseline(samples: DataFrame, beta: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Reward minus log-mean-exp(beta r) / beta over the batch (or per ``by``); beta 0 is the mean."""
    by = by or []
    hi = samples.groupBy(*by).agg(F.max("reward").alias("_hi"), F.avg("reward").alias("_avg"))
    if by:
        s = samples.join(hi, by)
    else:
        top = one(hi)
        s = samples.withColumn("_hi", top["_hi"]).withColumn("_avg", top["_avg"])
    if beta == 0:
        return s.withColumn("seq_reward", F.col("reward") - F.col("_avg")).drop("_hi", "_avg")
    soft = s.groupBy(*by).agg((F.ln(F.avg(F.exp(beta * (F.col("reward") - F.col("_hi"))))) / beta + F.max("_hi")).alias("_soft"))
    s = s.join(soft, by) if by else s.withColumn("_soft", one(soft)["_soft"])
    return s.withColumn("seq_reward", F.col("reward") - F.col("_soft")).drop("_hi", "_avg", "_soft")


def reweight_resample(samples: DataFrame, method: str = "pow", power: float = 2.0, seed: str = "resample") -> DataFrame:
    """As many draws with replacement as there are samples, by score weight.

    Weights are laid on the unit interval and each draw is a hash-uniform point.  Interval
    starts and points are sorted together and each point takes the last start before it, so
    neither a dominant weight nor a crowd of draws on one sample is a hot spot.
    """
    top = one(samples.agg(F.max("reward").alias("hi"), F.min("reward").alias("lo")))
    weight = {"pow": F.pow(F.abs("reward"), power),
              "max_min": F.when((F.col("reward") == top["hi"]) | (F.col("reward") == top["lo"]), 1.0).otherwise(0.0),
              "max_random": F.when(F.col("reward") == top["hi"], 0.4).otherwise(0.1)}[method]
    w = materialize(ranked_running(samples.withColumn("weight", weight + 1e-8), [], ["sample_id"], "idx", {"cum": "weight"}))
    total = one(w.agg(F.max("cum").alias("total")))["total"]
    starts = w.select(((F.col("cum") - F.col("weight")) / total).alias("at"), F.lit(0).alias("is_draw"), "idx", F.struct("uid", "sample_id", "reward").alias("sample"))
    u = hash_int(hash_of(seed, "idx")) / F.lit(float(16 ** 12))
    draws = w.select(u.alias("at"), F.lit(1).alias("is_draw"), "idx", F.lit(None).cast(starts.schema["sample"].dataType).alias("sample"))
    got = carried_forward(starts.unionByName(draws), ["at", "is_draw", "idx"], "sample", "hit").filter("is_draw = 1")
    return got.select(F.col("idx").alias("draw"), "hit.uid", "hit.sample_id", "hit.reward")


def preference_pairs(samples: DataFrame) -> DataFrame:
    """Responses of a prompt paired in order; the higher reward is chosen, the first on ties."""
    s = numbered(samples, ["uid"], ["sample_id"], "k", F.floor(F.col("sample_id") / 512))
    s = s.withColumn("pair", F.floor(F.col("k") / 2))
    a = s.filter("k % 2 = 0").select("uid", "pair", F.struct("sample_id", "reward").alias("a"))
    b = s.filter("k % 2 = 1").select("uid", "pair", F.struct("sample_id", "reward").alias("b"))
    first = F.col("a.reward") >= F.col("b.reward")
    return a.join(b, ["uid", "pair"]).select(
        "uid", "pair", F.when(first, F.col("a.sample_id")).otherwise(F.col("b.sample_id")).alias("chosen"),
        F.when(first, F.col("b.sample_id")).otherwise(F.col("a.sample_id")).alias("rejected"),
        F.abs(F.col("a.reward") - F.col("b.reward")).alias("margin"))


def pairwise_accuracy(samples: DataFrame) -> DataFrame:
    """Agreement of score order with correctness order over all pairs of a prompt, weighted by the
    difference in correctness, plus sign accuracy; 0.5 without any difference.

    No pair is formed.  The weight of a pair is the sum of the gaps between correctness levels
    it spans, and for one gap the rightly ordered pairs are a rank sum: the ranks of the samples
    above the gap minus P (P + 1) / 2 for P of them.  A tied score counts half.
    """
    s = average_ranked(samples, ["uid"], "reward", "rank")
    per = s.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.avg((F.signum(F.col("reward")) == F.signum(F.col("acc") * 2 - 1)).cast("double")).alias("sign_accuracy"))
    levels = s.groupBy("uid", "acc").agg(F.sum("rank").alias("rs"), F.count(F.lit(1)).alias("c"))
    levels = ranked_running(levels, ["uid"], [F.desc("acc")], "k", {"above": "c", "ranks": "rs"})
    lower = levels.select("uid", (F.col("k") - 1).alias("k"), F.col("acc").alias("below"))
    gaps = levels.join(lower, ["uid", "k"]).join(per.select("uid", "n"), "uid")
    gap, p = F.col("acc") - F.col("below"), F.col("above")
    g = gaps.groupBy("uid").agg(F.sum(gap * (F.col("ranks") - p * (p + 1) / 2)).alias("right"), F.sum(gap * p * (F.col("n") - p)).alias("weight"))
    return per.join(g, "uid", "left").select("uid", F.coalesce(F.try_divide("right", "weight"), F.lit(0.5)).alias("pair_accuracy"), "sign_accuracy")


def overlong_penalty(samples: DataFrame, max_length: int, buffer: int, factor: float) -> DataFrame:
    """Linear penalty on the part of a response inside the buffer before ``max_length``."""
    expected = max_length - buffer
    p = F.least(-(F.col("length") - expected) / F.lit(float(buffer)) * factor, F.lit(0.0))
    return samples.withColumn("penalty", p).withColumn("penalised", F.col("reward") + p).withColumn("overlong", p < 0)


def align_uid(prompts: DataFrame, rows: DataFrame) -> DataFrame:
    """Repeat the prompt row for each generated row of its uid; an unknown uid is an error."""
    j = rows.join(prompts.withColumn("_known", F.lit(True)), "uid", "left")
    err = F.raise_error(F.concat(F.lit("generated row with unknown uid "), F.col("uid").cast("string"))).cast("boolean")
    return j.filter(F.when(F.col("_known").isNull(), err).otherwise(True)).drop("_known")
