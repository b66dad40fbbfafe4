"""Evaluation tables over finished episodes.

Everything aggregates with map-side combining on (model, task, ...) keys; order statistics
come from distributed ranks, never from one group's values held together.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import pose
from wayfold.functions.ordering import hash_of, ranked_running
from wayfold.functions.stats import one
from wayfold.session import materialize

SLACK = 1e-9


def per_turn_table(episodes: DataFrame, success_keys: list[str]) -> DataFrame:
    """Turn 0 from the reset info, turns 1..T aligned with the rewards.

    With one info more than rewards the first belongs to the reset; otherwise step i uses
    info i.  Success is the first present key, else false.
    """
    e = episodes.withColumn("shift", F.when(F.size("infos") == F.size("rewards") + 1, 1).otherwise(0))
    first = F.when(F.size("infos") >= 1, F.lit(0)).otherwise(F.lit(1))
    turns = F.when(F.size("rewards") >= first, F.sequence(first, F.size("rewards")))
    e = e.withColumn("turn", F.explode(turns))
    info = F.when(F.col("turn") == 0, F.get("infos", F.lit(0))).otherwise(F.get("infos", F.col("turn") - 1 + F.col("shift")))
    e = e.withColumn("info", info).withColumn("reward", F.when(F.col("turn") > 0, F.get("rewards", F.col("turn") - 1)))
    ok = F.coalesce(*[F.col(f"info.{k}") for k in success_keys], F.lit(False))
    return e.withColumn("success", ok).drop("shift", "infos", "rewards")


def rollout_summary(episodes: DataFrame, error_reasons: list[str]) -> DataFrame:
    """Episode count, success rate, mean reward and turns and error count, overall and per tag."""
    return episodes.groupingSets([[], [F.col("task")]], "task").agg(
        F.coalesce("task", F.lit("all")).alias("tag"), F.count(F.lit(1)).alias("n_episodes"), F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("cumulative_reward").alias("avg_reward"), F.avg("num_turns").alias("avg_turns"),
        F.count_if(F.col("finish_reason").isin(error_reasons)).alias("n_errors")).drop("task")


def error_ids(episodes: DataFrame, error_reasons: list[str]) -> DataFrame:
    """(tag, sample_id): the episodes that ended for one of these reasons, overall and per tag."""
    e = episodes.filter(F.col("finish_reason").isin(error_reasons))
    tags = F.when(F.col("task").isNull(), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), "task"))
    return e.select(F.explode(tags).alias("tag"), "sample_id")


def pending_jobs(jobs: DataFrame, runs: DataFrame, finished: list[str]) -> DataFrame:
    """Jobs without a run of the same (env, seed, tag) that ended for an accepted reason."""
    done = runs.filter(F.col("finish_reason").isin(finished)).select("env", "seed", "tag")
    return jobs.join(done, ["env", "seed", "tag"], "left_anti")


def error_rollouts(rollouts: DataFrame, metrics: DataFrame, normal: list[str]) -> DataFrame:
    """Rollouts without metrics or with an abnormal finish reason; a missing reason is derived."""
    j = rollouts.join(metrics, "rollout_id", "left")
    reason = F.coalesce("finish_reason", F.when(F.col("terminated"), "done").otherwise("max_turns"))
    why = F.when(F.col("terminated").isNull(), "no_metrics").when(~reason.isin(normal), reason)
    return j.withColumn("problem", why).filter(F.col("problem").isNotNull()).select("rollout_id", "problem")


def within(metres: Column | float, degrees: Column | float) -> Column:
    m = metres if isinstance(metres, Column) else F.lit(metres)
    d = degrees if isinstance(degrees, Column) else F.lit(degrees)
    return (F.col("pos_err_m") <= m + SLACK) & (F.col("ang_err_deg") <= d + SLACK)


def success_at_thresholds(episodes: DataFrame, thresholds: list[tuple[float, float]]) -> DataFrame:
    """Success rate per (metres, degrees) pair in one pass; episodes without errors do not count."""
    e = episodes.filter("pos_err_m IS NOT NULL AND ang_err_deg IS NOT NULL")
    g = e.groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.struct(F.lit(m).alias("metres"), F.lit(d).alias("degrees"), F.avg(within(m, d).cast("double")).alias("rate")) for m, d in thresholds]).alias("t"))
    return g.select("model", "task", "n", F.inline("t"))


def threshold_flags(episodes: DataFrame, thresholds: list[tuple[float, float]]) -> DataFrame:
    """One boolean column per (metres, degrees) pair."""
    return episodes.select("*", *[within(m, d).alias(f"success_{m:g}m{d:g}deg".replace(".", "_")) for m, d in thresholds])


def length_thresholds(spec: str, length: Column) -> tuple[Column, Column]:
    """Thresholds by reference length from ``"m,d;lo-hi:m,d;..."``.

    A piece without a range covers the lengths between its neighbours' ranges.
    """
    pieces = []
    for raw in spec.split(";"):
        span, _, vals = raw.strip().rpartition(":")
        m, d = (float(x) for x in vals.split(","))
        lo, _, hi = span.partition("-")
        pieces.append([int(lo) if lo else None, int(hi or lo) if lo else None, m, d])
    metres = degrees = None
    for i, (lo, hi, m, d) in enumerate(pieces):
        if lo is None:
            if any(pieces[j][0] is None for j in (i - 1, i + 1) if 0 <= j < len(pieces)):
                raise ValueError(f"two neighbouring pieces without a range in {spec!r}")
            lo = pieces[i - 1][1] + 1 if i else None
            hi = pieces[i + 1][0] - 1 if i + 1 < len(pieces) else None
        elif i and pieces[i - 1][1] is not None and lo <= pieces[i - 1][1]:
            raise ValueError(f"ranges overlap in {spec!r}")
        cond = F.lit(True)
        cond = cond & (length >= lo) if lo is not None else cond
        cond = cond & (length <= hi) if hi is not None else cond
        metres = F.when(cond, m) if metres is None else metres.when(cond, m)
        degrees = F.when(cond, d) if degrees is None else degrees.when(cond, d)
    return metres, degrees


def adaptive_success(episodes: DataFrame, spec: str) -> DataFrame:
    """Success rate with thresholds that follow the reference action length."""
    m, d = length_thresholds(spec, F.col("gt_action_len"))
    return episodes.groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"), F.avg(within(m, d).cast("double")).alias("adaptive_rate"))


def length_bucket(length: Column, bounds: list[int]) -> Column:
    """Closed intervals [0,b0], [b0+1,b1], ..., [bn+1,+inf]."""
    out, lo = None, 0
    for b in bounds:
        label = f"[{lo},{b}]"
        out = F.when(length <= b, label) if out is None else out.when(length <= b, label)
        lo = b + 1
    return out.otherwise(f"[{lo},+inf]")


def success_by_length(episodes: DataFrame, bounds: list[int]) -> DataFrame:
    """Totals and successes per reference-length interval plus overall."""
    e = episodes.withColumn("bucket", length_bucket(F.coalesce("gt_action_len", "num_turns"), bounds))
    g = e.rollup("model", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_success"), F.grouping_id().alias("gid"))
    return g.filter("gid < 3").select("model", F.coalesce("bucket", F.lit("overall")).alias("bucket"), "n", "n_success", (F.col("n_success") / F.col("n")).alias("rate"))


def leaderboard(episodes: DataFrame, tasks: list[str], thresholds: list[tuple[float, float]]) -> DataFrame:
    """Wide table: success per task, mean over thresholds, mean over tasks, best model first."""
    rate = F.avg(F.col("success").cast("double")) * 100
    at = sum((F.avg(within(m, d).cast("double")) for m, d in thresholds), F.lit(0.0)) / len(thresholds) * 100
    g = episodes.groupBy("model", "task").agg(rate.alias("rate"), at.alias("at"))
    wide = g.groupBy("model").agg(*[F.max(F.when(F.col("task") == t, F.col("rate"))).alias(t) for t in tasks],
                                  F.avg("at").alias("threshold_mean"), F.avg("rate").alias("overall"))
    return wide.orderBy(F.desc("overall"), "model")


def unified_distance(a: str = "a_", b: str = "b_") -> Column:
    """Steps between two poses: half a metre and thirty degrees count one each."""
    d, ang = pose.pose_errors(a, b)
    return F.sqrt(F.pow(d / 0.5, 2) + F.pow(ang / 30.0, 2))


def easy_hard(episodes: DataFrame, views: DataFrame, easy_below: float = 3.0) -> DataFrame:
    """Success rate per model and task for easy, hard and all samples."""
    v = views.select("sample_id", unified_distance().alias("distance"))
    j = episodes.join(v, "sample_id").withColumn("split", F.when(F.col("distance") < easy_below, "easy").otherwise("hard"))
    g = j.groupingSets([[F.col("model"), F.col("task")], [F.col("model"), F.col("task"), F.col("split")]], "model", "task", "split").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col("success").cast("double")) * 100).alias("rate"))
    return g.withColumn("split", F.coalesce("split", F.lit("all")))


def distance_histogram(views: DataFrame, bins: int) -> DataFrame:
    """Histogram of the unified distance: ``bins`` equal cells from the smallest to the largest value."""
    v = views.select(unified_distance().alias("x"))
    rng = one(v.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    b = F.least(F.floor((F.col("x") - rng["lo"]) / (rng["hi"] - rng["lo"]) * bins), F.lit(bins - 1))
    return v.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pose_error_table(views: DataFrame) -> DataFrame:
    d, ang = pose.pose_errors("a_", "b_")
    return views.select("sample_id", d.alias("pos_err_m"), ang.alias("ang_err_deg"))


def closeness(err: Column, threshold: float, steepness: float = 6.0) -> Column:
    """Logistic closeness in [0, 1], one half at the threshold; 0 for any error where the threshold is 0."""
    if threshold <= 0:
        return F.when(err <= SLACK, 1.0).otherwise(0.0)
    z = steepness * (err / threshold - 1)
    return F.when(err <= SLACK, 1.0).when(z >= 60, 0.0).when(z <= -60, 1.0).otherwise(1 / (1 + F.exp(pose.clip(z, -60.0, 60.0))))


def reward_compose(turns: DataFrame, metres: float, degrees: float, answer: float, close: float, give: float, fmt: float,
                   per_turn: float, single: float) -> DataFrame:
    """Episode reward from per-turn flags ``(format_ok, answered, n_actions, pos_err_m, ang_err_deg)``.

    A malformed turn earns nothing and forfeits the episode's format bonus on the answer.
    """
    t = turns.join(turns.groupBy("episode_id").agg(F.min(F.when(~F.col("format_ok"), F.col("turn"))).alias("bad_at")), "episode_id")
    clean = F.col("bad_at").isNull() | (F.col("bad_at") > F.col("turn"))
    one = F.when(F.col("n_actions") == 1, single).otherwise(0.0)
    c = closeness(F.col("pos_err_m"), metres) * closeness(F.col("ang_err_deg"), degrees)
    final = F.when(within(metres, degrees), answer).otherwise(0.0) + close * c + give + F.when(clean, fmt).otherwise(0.0) + one
    reward = F.when(~F.col("format_ok"), 0.0).when(F.col("answered"), final).otherwise(per_turn + one)
    return t.groupBy("episode_id").agg(F.sum(reward).alias("reward"), F.max(F.when(F.col("answered") & F.col("format_ok"), c)).alias("closeness"))


FACTORS = ("pos_dist", "rot_dist", "unified_dist", "horiz_dist", "height_diff", "forward_alignment", "target_bearing", "target_elevation", "orientation_agreement")


def geometric_factors(views: DataFrame) -> DataFrame:
    """Nine distances and alignments between the first and the target view."""
    p, q = pose.position_of("a_"), pose.position_of("b_")
    ra, rb = pose.rotation_of("a_"), pose.rotation_of("b_")
    delta = [b - a for a, b in zip(p, q)]
    fa, fb = [-ra[i][2] for i in range(3)], [-rb[i][2] for i in range(3)]
    dist, horiz = pose.distance(p, q), F.sqrt(delta[0] * delta[0] + delta[1] * delta[1])
    v = views.select("sample_id", dist.alias("pos_dist"), pose.geodesic_angle(ra, rb).alias("rot_dist"), horiz.alias("horiz_dist"),
                     F.abs(delta[2]).alias("height_diff"), pose.dot(fa, delta).alias("_fd"), F.degrees(F.atan2(delta[2], horiz)).alias("target_elevation"),
                     pose.dot(fa, fb).alias("orientation_agreement"))
    v = v.withColumn("unified_dist", F.sqrt(F.pow(F.col("pos_dist") / 0.5, 2) + F.pow(F.col("rot_dist") / 30.0, 2)))
    v = v.withColumn("forward_alignment", F.when(F.col("pos_dist") > 1e-9, F.col("_fd") / F.col("pos_dist")).otherwise(0.0))
    v = v.withColumn("target_bearing", F.degrees(F.acos(pose.clip(F.col("forward_alignment"), -1.0, 1.0))))
    return v.select("sample_id", *FACTORS)


def _value_counts(wide: DataFrame) -> DataFrame:
    """(g, x, k, hits): values, their uses and successes, group ``g * len(FACTORS) + position of the factor``; equal values of a batch are one row."""

    def run(batches):
        for b in batches:
            x = np.concatenate([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in FACTORS]) + 0.0
            g = np.concatenate([b.column("g").to_numpy() * len(FACTORS) + i for i in range(len(FACTORS))])
            s = np.tile(b.column("s").to_numpy(), len(FACTORS))
            keep = ~np.isnan(x)
            g, x, s = g[keep], x[keep], s[keep]
            order = np.lexsort((x, g))
            yield _merged(g[order], x[order], np.ones(len(x), np.int64), s[order])

    return wide.select("g", "s", *FACTORS).mapInArrow(run, "g long, x double, k long, hits long")


def _merged(g, x, k, hits) -> pa.RecordBatch:
    """Sorted rows with equal values added up."""
    first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]))) if len(g) else np.zeros(0, np.int64)
    k, hits = (np.add.reduceat(c, first) if len(first) else c for c in (k, hits))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (g[first], x[first], k, hits)], ["g", "x", "k", "hits"])


def _rank_sums(counts: DataFrame) -> DataFrame:
    """Sums over the runs of each group that lie in one batch, ranks counted from the run's start; ``counts`` is sorted by g and x.

    (g, part, at): where the run lies; its rows n, successes pos and distinct values; sums of the average rank over
    its rows (r), squared (rr) and over its successes (hr).
    """

    def run(batches):
        part, at, held = TaskContext.get().partitionId(), 0, None
        empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.int64())], ["g", "x", "k", "hits"])
        for b in itertools.chain(batches, [None]):  # the last value of a batch may go on in the next
            got = [np.concatenate([y.column(c).to_numpy() for y in (held or empty, b or empty)]) for c in ("g", "x", "k", "hits")]
            m = _merged(*got)
            whole = m.num_rows if b is None else max(m.num_rows - 1, 0)
            held = m.slice(whole)
            if not whole:
                continue
            g, k, hits = (m.column(c).to_numpy()[:whole] for c in ("g", "k", "hits"))
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            upto = np.cumsum(k)
            start = np.repeat((upto - k)[first], np.diff(np.append(first, whole)))
            r = upto - start - (k - 1) / 2
            sums = [np.add.reduceat(c, first) for c in (k, hits, np.ones(whole, np.int64), k * r, k * r * r, hits * r)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (g[first], np.full(len(first), part), np.full(len(first), at), *sums)], ["g", "part", "at", "n", "pos", "distinct", "r", "rr", "hr"])
            at += 1

    return counts.mapInArrow(run, "g long, part long, at long, n long, pos long, distinct long, r double, rr double, hr double")


def factor_correlation(episodes: DataFrame, factors: DataFrame, min_n: int = 10) -> DataFrame:
    """Spearman correlation of each factor with success per model and task; 0 if short or constant.

    Values are sorted once over all tasks.  Sums over ranks need no ranks of single rows: each task adds up its part of
    a group from rank 0, and the parts are shifted to their places afterwards.
    """
    s = F.coalesce(F.col("success").cast("long"), F.lit(0)).alias("s")
    j = materialize(episodes.select("model", "task", "sample_id", s).join(factors, "sample_id").select("model", "task", "s", *FACTORS))  # read three times
    groups = materialize(j.select("model", "task").distinct().withColumn("g", F.monotonically_increasing_id()))
    at = groups.select(F.col("model").alias("_m"), F.col("task").alias("_t"), "g")
    wide = j.join(at, F.col("model").eqNullSafe(F.col("_m")) & F.col("task").eqNullSafe(F.col("_t")))
    runs = _rank_sums(_value_counts(wide).orderBy("g", "x"))
    every, before = Window.partitionBy("g"), Window.partitionBy("g").orderBy("part", "at").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"), F.sum("n").over(every).alias("all"), F.sum("pos").over(every).alias("hits"))
    # success is 0/1, so its average ranks follow from the counts alone; ranks are taken from their mean
    mean = (F.col("all") + 1) / 2
    off, hit, miss = F.col("off") - mean, F.col("all") - (F.col("hits") - 1) / 2 - mean, (F.col("all") - F.col("hits") + 1) / 2 - mean
    xs = hit * (F.col("hr") + off * F.col("pos")) + miss * (F.col("r") - F.col("hr") + off * (F.col("n") - F.col("pos")))
    c = runs.groupBy("g").agg(F.max("all").alias("n"), F.max("hits").alias("pos"), F.sum("distinct").alias("distinct"), F.max(hit).alias("hit"), F.max(miss).alias("miss"),
                              F.sum(F.col("rr") + 2 * off * F.col("r") + off * off * F.col("n")).alias("xx"), F.sum(xs).alias("xs"))
    ss = F.col("pos") * F.col("hit") * F.col("hit") + (F.col("n") - F.col("pos")) * F.col("miss") * F.col("miss")
    # equal values lie in one part, so none is counted twice
    flat = (F.col("distinct") == 1) | (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
    rho = F.when((F.col("n") < min_n) | flat, 0.0).otherwise(F.try_divide("xs", F.sqrt(F.col("xx") * ss)))
    name = F.element_at(F.array(*[F.lit(f) for f in FACTORS]), (F.col("g") % len(FACTORS) + 1).cast("int"))
    c = c.select(F.expr(f"g div {len(FACTORS)}").alias("_g"), name.alias("factor"), "n", rho.alias("rho"))
    return c.join(groups, F.col("_g") == F.col("g")).select("model", "task", "factor", "n", "rho")


def inferred_success(episodes: DataFrame, observed: DataFrame, targets: DataFrame, metres: float, degrees: float) -> DataFrame:
    """Per model: successes whose path reached the target view, and those that were inferred."""
    t = targets.select(F.col("sample_id").alias("traj_id"), *[f"b_{a}" for a in pose.AXES])
    d, ang = pose.pose_errors("", "b_")
    near = observed.join(t, "traj_id").select("traj_id", d.alias("pos_err_m"), ang.alias("ang_err_deg"))
    near = near.groupBy(F.col("traj_id").alias("sample_id")).agg(F.bool_or(within(metres, degrees)).alias("reached"), F.min("pos_err_m").alias("min_pos"), F.min("ang_err_deg").alias("min_ang"))
    j = episodes.select("model", "sample_id", "success").join(near, "sample_id")
    s, r = F.col("success"), F.col("reached")
    g = j.groupBy("model").agg(F.count(F.lit(1)).alias("n_rollouts"), F.count_if(s).alias("n_success"), F.count_if(s & r).alias("n_success_reached"),
                               F.count_if(r).alias("n_reached_all"), F.count_if(r & ~s).alias("n_reached_but_failed"), F.avg("min_pos").alias("mean_closest_m"))
    inferred = F.col("n_success") - F.col("n_success_reached")
    return g.withColumn("n_success_inferred", inferred).withColumn("inferred_rate", F.when(F.col("n_success") > 0, inferred / F.nullif("n_success", F.lit(0))).otherwise(0.0))


# The names of the failure categories.
CATEGORIES = ("no_answer", "snap_answer", "orientation_flip", "both_off", "position_off_only", "rotation_off_only")


def failure_category(metres: float = 0.5, degrees: float = 30.0, flip: float = 150.0) -> Column:
    """Failure category of an episode: unanswered and rash ones first, then by which of the two errors is too large."""
    far, turned = F.col("pos_err_m") > metres, F.col("ang_err_deg") > degrees
    off = F.when(far == turned, "both_off").when(far, "position_off_only").otherwise("rotation_off_only")
    return F.when(~F.col("answered") | far.isNull() | turned.isNull(), "no_answer").when(F.col("answer_turn") == 0, "snap_answer").when(F.col("ang_err_deg") >= flip, "orientation_flip").otherwise(off)


def failure_partition(episodes: DataFrame) -> DataFrame:
    """Share of each failure category among a model's failures, one row per model."""
    f = episodes.filter(~F.col("success")).withColumn("category", failure_category())
    return f.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[
        F.round(100 * F.avg((F.col("category") == c).cast("double")), 1).alias(c) for c in CATEGORIES])


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Median per key: equal values are counted, the counts prefix-summed in order, the middle read off."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    r = ranked_running(counts, keys, [value], "_r", {"_upto": "_n"})
    total = r.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    mid = r.join(total, keys).withColumn("_m", F.explode(F.array(F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2))))
    return mid.filter((F.col("_m") > F.col("_upto") - F.col("_n")) & (F.col("_m") <= F.col("_upto"))).groupBy(*keys).agg(F.avg(value).alias(name))


def failure_decomposition(episodes: DataFrame, metres: float = 0.5, degrees: float = 30.0) -> DataFrame:
    """Counts of single-axis, joint, near, gross, premature, silent and malformed failures; error medians and means."""
    f = episodes.filter(~F.col("success"))
    p, a = F.col("pos_err_m"), F.col("ang_err_deg")
    g = f.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((p <= metres) & (a > degrees)).alias("rotation_only"), F.count_if((p > metres) & (a <= degrees)).alias("position_only"),
        F.count_if((p > metres) & (a > degrees)).alias("both"), F.count_if(within(1.0, 60.0)).alias("near_miss"), F.count_if(~within(3.0, 90.0)).alias("gross"),
        F.count_if(F.col("answer_turn") <= 1).alias("premature"), F.count_if(~F.col("answered")).alias("no_answer"), F.count_if(F.col("format_errors") >= 3).alias("heavy_format"),
        F.avg(p).alias("mean_pos"), F.avg(a).alias("mean_ang"))
    return (g.join(exact_median(f, ["model"], "pos_err_m", "median_pos"), "model", "left")
            .join(exact_median(f, ["model"], "ang_err_deg", "median_ang"), "model", "left"))


def failure_samples(failures: DataFrame, k: int, seed: str) -> DataFrame:
    """A fixed number of random well-formed failures per task and model.

    The literal rank bound lets Spark keep k rows per key before the shuffle.
    """
    w = Window.partitionBy("task", "model").orderBy("_h", "sample_id")
    f = failures.filter(~F.col("format_bad")).withColumn("_h", hash_of(seed, "sample_id"))
    return f.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= k).drop("_h")


def format_error_rates(failures: DataFrame) -> DataFrame:
    return failures.groupBy("task", "model").agg(F.count(F.lit(1)).alias("n_fail"), F.count_if("format_bad").alias("n_format_err"),
                                                 F.round(100 * F.avg(F.col("format_bad").cast("double")), 1).alias("format_rate"))


def coded_category_table(labels: DataFrame, rates: DataFrame, categories: list[str]) -> DataFrame:
    """Label shares scaled to the well-formed share of failures, plus the format row; one column per category."""
    g = labels.groupBy("task", "model").agg(*[F.avg((F.col("label") == c).cast("double")).alias(c) for c in categories])
    j = g.join(rates, ["task", "model"])
    fr = F.col("format_rate") / 100
    return j.select("task", "model", *[F.round(100 * F.col(c) * (1 - fr), 1).alias(c) for c in categories], F.round(100 * fr, 1).alias("FORMAT"))


def horizon_table(episodes: DataFrame, buckets: dict[str, tuple[int, int]]) -> DataFrame:
    """Success by reference length in named, closed ranges."""
    b = None
    for name, (lo, hi) in buckets.items():
        c = F.coalesce("gt_action_len", F.lit(0)).between(lo, hi)
        b = F.when(c, name) if b is None else b.when(c, name)
    return episodes.groupBy("model", b.alias("horizon")).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(F.col("success").cast("double")), 1).alias("rate"))


def format_rate(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("model", "task").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("cumulative_reward") > 0).cast("double")).alias("format_rate"))


def flag_breakdown(episodes: DataFrame, flag: str, bounds: list[int]) -> DataFrame:
    """True, false and missing counts of a flag: overall, by length interval and by scene."""
    e = episodes.withColumn("bucket", length_bucket(F.col("gt_action_len"), bounds)).withColumn("_f", F.col(flag))
    g = e.groupingSets([[], [F.col("bucket")], [F.col("scene_id")]], "bucket", "scene_id").agg(
        F.count_if("_f").alias("n_true"), F.count_if(~F.col("_f")).alias("n_false"), F.count_if(F.col("_f").isNull()).alias("n_missing"),
        F.avg(F.col("_f").cast("double")).alias("true_rate"), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "length").otherwise("scene")
    return g.select(kind.alias("level"), F.coalesce("bucket", "scene_id", F.lit("all")).alias("value"), "n_true", "n_false", "n_missing", "true_rate")


def filter_flag(episodes: DataFrame, flag: str, state: str) -> DataFrame:
    """Episodes whose flag is ``true``, ``false`` or ``missing``."""
    f = F.col(flag)
    return episodes.filter({"true": f, "false": ~f, "missing": f.isNull()}[state])


def per_turn_stats(series: DataFrame) -> DataFrame:
    """Mean, population deviation, range and count per turn, four places.

    Values enter as decimals of eight places, so their sums and the sums of their squares are exact
    and do not depend on the order of the rows; a shift of 1e-9 takes results off the rounding edge.
    """
    v = series.withColumn("value", F.col("value").cast("decimal(18,8)"))
    g = v.groupBy("turn").agg(F.sum("value").cast("double").alias("s"), F.sum(F.col("value") * F.col("value")).cast("double").alias("q"),
                              F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"), F.count(F.lit(1)).alias("n"), F.count("value").alias("k"))
    mean = F.col("s") / F.col("k")
    four = lambda c: F.round(c + 1e-9, 4)
    return g.select("turn", four(mean).alias("mean"), four(F.sqrt(F.greatest(F.col("q") / F.col("k") - mean * mean, F.lit(0.0)))).alias("std"), four(F.col("lo")).alias("min"), four(F.col("hi")).alias("max"), "n")


def category_accuracy(answers: DataFrame) -> DataFrame:
    """Accuracy per category and on average over all questions."""
    g = answers.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("accuracy"), F.grouping_id().alias("gid"))
    return g.select(F.when(F.col("gid") == 1, "Average").otherwise(F.col("category")).alias("category"), "n", "accuracy")
