"""Evaluation tables over the orders as episodes and the line items as camera paths."""

from pyspark.sql import functions as F

from wayfold.functions.stats import r6
from wayfold.operators import evaluation as op
from wayfold.plans.catalog import ctes, query, r
from wayfold.sources import tables as t

E, V, P = t.EPISODES_SQL, t.VIEW_PAIRS_SQL, t.POSES_SQL
RATE = "avg(CASE WHEN {} THEN 1.0 ELSE 0.0 END)"


def matrix(prefix: str) -> list[list[str]]:
    """Rotation matrix entries as SQL text."""
    c = {a: f"cos(radians({prefix}r{a}))" for a in "xyz"}
    s = {a: f"sin(radians({prefix}r{a}))" for a in "xyz"}
    return [[f"({c['y']}*{c['z']})", f"({s['x']}*{s['y']}*{c['z']}-{c['x']}*{s['z']})", f"({c['x']}*{s['y']}*{c['z']}+{s['x']}*{s['z']})"],
            [f"({c['y']}*{s['z']})", f"({s['x']}*{s['y']}*{s['z']}+{c['x']}*{c['z']})", f"({c['x']}*{s['y']}*{s['z']}-{s['x']}*{c['z']})"],
            [f"(-{s['y']})", f"({s['x']}*{c['y']})", f"({c['x']}*{c['y']})"]]


def errors_sql(a: str, b: str) -> tuple[str, str]:
    ma, mb = matrix(a), matrix(b)
    trace = "+".join(f"{ma[i][j]}*{mb[i][j]}" for i in range(3) for j in range(3))
    d = "sqrt(" + "+".join(f"pow({a}t{x}-{b}t{x},2)" for x in "xyz") + ")"
    return d, f"degrees(acos(greatest(-1,least(1,({trace}-1)*0.5))))"


DIST, ANG = errors_sql("a_", "b_")
UNIFIED = f"sqrt(pow({DIST}/0.5,2)+pow({ANG}/30.0,2))"


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, r6(c))
    return df


# --- episode level -------------------------------------------------------------------------
@query("per_turn_table", """WITH o AS (SELECT o_orderkey AS episode_id, list_transform(range(1, 2 + o_orderkey % 3), lambda i: o_totalprice / i) AS rewards,
  list_transform(range(1, 2 + o_orderkey % 3 + o_orderkey % 2), lambda i: CASE WHEN i % 2 = 0 THEN o_orderstatus = 'F' END) AS a,
  list_transform(range(1, 2 + o_orderkey % 3 + o_orderkey % 2), lambda i: CASE WHEN i % 3 = 0 THEN o_orderstatus = 'O' END) AS b FROM orders),
x AS (SELECT *, unnest(range(0, len(rewards) + 1)) AS turn, CASE WHEN len(a) = len(rewards) + 1 THEN 1 ELSE 0 END AS shift FROM o),
y AS (SELECT *, CASE WHEN turn = 0 THEN 1 ELSE turn + shift END AS j FROM x)
SELECT episode_id, turn, CASE WHEN turn > 0 THEN rewards[turn] END AS reward, coalesce(a[j], b[j], false) AS success FROM y""")
def _(spark, d):
    k = F.col("o_orderkey")
    info = F.transform(F.sequence(F.lit(1), (1 + k % 3 + k % 2).cast("int")), lambda i: F.struct(
        F.when(i % 2 == 0, F.col("o_orderstatus") == "F").alias("success"), F.when(i % 3 == 0, F.col("o_orderstatus") == "O").alias("traj_success")))
    o = t.table(spark, d, "orders").select(k.alias("episode_id"), F.transform(F.sequence(F.lit(1), (1 + k % 3).cast("int")), lambda i: F.col("o_totalprice") / i).alias("rewards"), info.alias("infos"))
    return op.per_turn_table(o, ["success", "traj_success"]).select("episode_id", F.col("turn").cast("long").alias("turn"), "reward", "success")


@query("rollout_summary", ctes(E) + " UNION ALL ".join(f"""SELECT {tag} AS tag, count(*) AS n_episodes, {r(RATE.format('success'))} AS success_rate, {r('avg(cumulative_reward)')} AS avg_reward,
  {r('avg(num_turns)')} AS avg_turns, count(*) FILTER (WHERE finish_reason = 'error') AS n_errors FROM episodes {g}""" for tag, g in (("'all'", ""), ("task", "GROUP BY task"))))
def _(spark, d):
    return rounded(op.rollout_summary(t.episodes(spark, d), ["error"]), "success_rate", "avg_reward", "avg_turns")


@query("error_ids", ctes(E) + "SELECT 'all' AS tag, sample_id FROM episodes WHERE finish_reason IN ('error', 'max_turns') UNION ALL SELECT task, sample_id FROM episodes WHERE finish_reason IN ('error', 'max_turns')")
def _(spark, d):
    return op.error_ids(t.episodes(spark, d), ["error", "max_turns"])


@query("pending_jobs", ctes(E) + """SELECT c_custkey AS env, s AS seed, 'task' || s AS tag FROM customer, range(3) x(s)
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 3 = s AND o_orderpriority NOT LIKE '1%')""")
def _(spark, d):
    jobs = t.table(spark, d, "customer").select(F.col("c_custkey").alias("env"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("seed"))
    jobs = jobs.withColumn("tag", F.concat(F.lit("task"), F.col("seed").cast("string")))
    runs = t.episodes(spark, d).join(t.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("env")), "sample_id")
    runs = runs.select("env", (F.col("sample_id") % 3).alias("seed"), F.col("task").alias("tag"), "finish_reason")
    return op.pending_jobs(jobs, runs, ["done", "max_turns"])


@query("error_rollouts", """SELECT doc_id AS rollout_id, CASE WHEN l.doc_id IS NULL THEN 'no_metrics' WHEN toxic = 1 THEN 'error' ELSE 'max_turns' END AS problem
FROM documents LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR toxic = 1 OR quality = 0""")
def _(spark, d):
    rollouts = t.table(spark, d, "documents").select(F.col("doc_id").alias("rollout_id"))
    metrics = t.table(spark, d, "labels").select(F.col("doc_id").alias("rollout_id"), F.when(F.col("toxic") == 1, "error").alias("finish_reason"), (F.col("quality") == 1).alias("terminated"))
    return op.error_rollouts(rollouts, metrics, ["done"])


TH = [(0.5, 30.0), (1.0, 60.0), (2.0, 60.0), (3.0, 90.0)]
IN = "pos_err_m <= {} + 1e-9 AND ang_err_deg <= {} + 1e-9"


@query("success_at_thresholds", ctes(E) + " UNION ALL ".join(
    f"SELECT model, task, count(*) AS n, {m}::DOUBLE AS metres, {a}::DOUBLE AS degrees, {r(RATE.format(IN.format(m, a)))} AS rate FROM episodes GROUP BY model, task" for m, a in TH))
def _(spark, d):
    return rounded(op.success_at_thresholds(t.episodes(spark, d), TH), "rate")


@query("threshold_flags", ctes(E) + f"SELECT sample_id, {IN.format(0.5, 30)} AS success_0_5m30deg, {IN.format(1, 60)} AS success_1m60deg FROM episodes")
def _(spark, d):
    return op.threshold_flags(t.episodes(spark, d), TH[:2]).select("sample_id", "success_0_5m30deg", "success_1m60deg")


@query("adaptive_success", ctes(E) + f"""SELECT model, task, count(*) AS n, {r(RATE.format(IN.format('CASE WHEN gt_action_len <= 1 THEN 0.25 WHEN gt_action_len = 2 THEN 0.5 ELSE 1 END',
  'CASE WHEN gt_action_len <= 1 THEN 15 WHEN gt_action_len <= 5 THEN 30 ELSE 60 END')))} AS adaptive_rate FROM episodes GROUP BY model, task""")
def _(spark, d):
    return rounded(op.adaptive_success(t.episodes(spark, d), "0.25,15;2:0.5,30;3-5:1,30;1,60"), "adaptive_rate")


BUCKET = "CASE WHEN gt_action_len <= 2 THEN '[0,2]' WHEN gt_action_len <= 5 THEN '[3,5]' ELSE '[6,+inf]' END"


@query("success_by_length", ctes(E) + " UNION ALL ".join(f"""SELECT model, {b} AS bucket, count(*) AS n, count(*) FILTER (WHERE success) AS n_success,
  {r(RATE.format('success'))} AS rate FROM episodes GROUP BY ALL""" for b in (BUCKET, "'overall'")))
def _(spark, d):
    return rounded(op.success_by_length(t.episodes(spark, d), [2, 5]), "rate")


@query("leaderboard", ctes(E, f"g AS (SELECT model, task, 100 * {RATE.format('success')} AS rate, 100 * ({' + '.join(RATE.format(IN.format(*x)) for x in TH)}) / 4 AS at_rate FROM episodes GROUP BY ALL)") + f"""
SELECT model, {', '.join(r(f"max(rate) FILTER (WHERE task = 'task{i}')") + f' AS task{i}' for i in range(3))}, {r('avg(at_rate)')} AS threshold_mean, {r('avg(rate)')} AS overall FROM g GROUP BY model""")
def _(spark, d):
    return rounded(op.leaderboard(t.episodes(spark, d), ["task0", "task1", "task2"], TH), "task0", "task1", "task2", "threshold_mean", "overall")


@query("format_rate", ctes(E) + f"SELECT model, task, count(*) AS n, {r(RATE.format('cumulative_reward > 0'))} AS format_rate FROM episodes GROUP BY model, task")
def _(spark, d):
    return rounded(op.format_rate(t.episodes(spark, d)), "format_rate")


FLAG = "fl AS (SELECT *, CASE WHEN finish_reason = 'error' THEN NULL ELSE success END AS flag FROM episodes)"


def _flagged(spark, d):
    return t.episodes(spark, d).withColumn("flag", F.when(F.col("finish_reason") != "error", F.col("success")))


@query("flag_breakdown", ctes(E, FLAG) + " UNION ALL ".join(f"""SELECT '{n}' AS level, {v} AS value, count(*) FILTER (WHERE flag) AS n_true, count(*) FILTER (WHERE NOT flag) AS n_false,
  count(*) FILTER (WHERE flag IS NULL) AS n_missing, {r('avg(CAST(flag AS INT))')} AS true_rate FROM fl GROUP BY ALL""" for n, v in (("overall", "'all'"), ("length", BUCKET), ("scene", "scene_id"))))
def _(spark, d):
    return rounded(op.flag_breakdown(_flagged(spark, d), "flag", [2, 5]), "true_rate")


@query("filter_flag", ctes(E, FLAG) + "SELECT sample_id FROM fl WHERE flag IS NULL")
def _(spark, d):
    return op.filter_flag(_flagged(spark, d), "flag", "missing").select("sample_id")


# --- failures ------------------------------------------------------------------------------
FAIL = """fe AS (SELECT *, finish_reason <> 'max_turns' AS answered, CASE WHEN finish_reason <> 'max_turns' THEN sample_id % 5 END AS answer_turn, sample_id % 6 AS format_errors,
  sample_id % 9 = 0 AS format_bad, 'L' || (sample_id % 4) AS label FROM episodes)"""


def _failing(spark, d):
    e = t.episodes(spark, d)
    k = F.col("sample_id")
    return (e.withColumn("answered", F.col("finish_reason") != "max_turns").withColumn("answer_turn", F.when(F.col("answered"), k % 5)).withColumn("format_errors", k % 6)
            .withColumn("format_bad", k % 9 == 0).withColumn("label", F.concat(F.lit("L"), (k % 4).cast("string"))))


CAT = """CASE WHEN NOT answered THEN 'no_answer' WHEN answer_turn = 0 THEN 'snap_answer' WHEN ang_err_deg >= 150 THEN 'orientation_flip' WHEN pos_err_m > 0.5 AND ang_err_deg > 30 THEN 'both_off'
  WHEN pos_err_m > 0.5 THEN 'position_off_only' WHEN ang_err_deg > 30 THEN 'rotation_off_only' ELSE 'both_off' END"""


@query("failure_partition", ctes(E, FAIL, f"c AS (SELECT model, {CAT} AS category FROM fe WHERE NOT success)") + "SELECT model, count(*) AS n, " + ", ".join(
    f"round(100 * count(*) FILTER (WHERE category = '{c}') / count(*), 1) AS {c}" for c in op.CATEGORIES) + " FROM c GROUP BY model")
def _(spark, d):
    return op.failure_partition(_failing(spark, d))


DEC = {"rotation_only": "pos_err_m <= 0.5 AND ang_err_deg > 30", "position_only": "pos_err_m > 0.5 AND ang_err_deg <= 30", "both": "pos_err_m > 0.5 AND ang_err_deg > 30",
       "near_miss": IN.format(1, 60), "gross": f"NOT ({IN.format(3, 90)})", "premature": "answer_turn <= 1", "no_answer": "NOT answered", "heavy_format": "format_errors >= 3"}


@query("failure_decomposition", ctes(E, FAIL) + "SELECT model, count(*) AS n, " + ", ".join(f'count(*) FILTER (WHERE {c}) AS "{k}"' for k, c in DEC.items()) +
       f""", {r('avg(pos_err_m)')} AS mean_pos, {r('avg(ang_err_deg)')} AS mean_ang, {r('median(pos_err_m)')} AS median_pos, {r('median(ang_err_deg)')} AS median_ang FROM fe WHERE NOT success GROUP BY model""")
def _(spark, d):
    return rounded(op.failure_decomposition(_failing(spark, d)), "mean_pos", "mean_ang", "median_pos", "median_ang")


@query("failure_samples", ctes(E, FAIL) + """SELECT task, model, sample_id, row_number() OVER (PARTITION BY task, model ORDER BY md5('fail|' || sample_id), sample_id) AS pick
FROM fe WHERE NOT success AND NOT format_bad QUALIFY pick <= 60""")
def _(spark, d):
    return op.failure_samples(_failing(spark, d).filter("NOT success"), 60, "fail").select("task", "model", "sample_id", F.col("pick").cast("long").alias("pick"))


RT = "rt AS (SELECT task, model, count(*) AS n_fail, count(*) FILTER (WHERE format_bad) AS n_format_err, round(100 * count(*) FILTER (WHERE format_bad) / count(*), 1) AS format_rate FROM fe WHERE NOT success GROUP BY ALL)"


@query("format_error_rates", ctes(E, FAIL, RT) + "SELECT * FROM rt")
def _(spark, d):
    return op.format_error_rates(_failing(spark, d).filter("NOT success"))


LABELS = ["L0", "L1", "L2", "L3"]


@query("coded_category_table", ctes(E, FAIL, RT, "lb AS (SELECT task, model, " + ", ".join(f"{RATE.format(f'label = {c!r}')} AS {c}" for c in LABELS) + " FROM fe WHERE NOT success AND NOT format_bad GROUP BY ALL)") +
       "SELECT task, model, " + ", ".join(f"round(100 * {c} * (1 - format_rate / 100), 1) AS {c}" for c in LABELS) + ", round(format_rate, 1) AS FORMAT FROM lb JOIN rt USING (task, model)")
def _(spark, d):
    f = _failing(spark, d).filter("NOT success")
    return op.coded_category_table(f.filter("NOT format_bad"), op.format_error_rates(f), LABELS)


@query("horizon_table", ctes(E) + f"""SELECT model, CASE WHEN gt_action_len BETWEEN 0 AND 2 THEN 'short' WHEN gt_action_len BETWEEN 3 AND 5 THEN 'medium' ELSE 'long' END AS horizon,
  count(*) AS n, round(100 * {RATE.format('success')}, 1) AS rate FROM episodes GROUP BY ALL""")
def _(spark, d):
    return op.horizon_table(t.episodes(spark, d), {"short": (0, 2), "medium": (3, 5), "long": (6, 99)})


# --- poses ---------------------------------------------------------------------------------
@query("pose_error", ctes(V) + f"SELECT sample_id, {r(DIST)} AS pos_err_m, round({ANG}, 4) + 0.0 AS ang_err_deg FROM view_pairs")
def _(spark, d):
    return op.pose_error_table(t.view_pairs(spark, d)).select("sample_id", r6("pos_err_m").alias("pos_err_m"), (F.round("ang_err_deg", 4) + 0.0).alias("ang_err_deg"))


@query("easy_hard", ctes(E, V, f"j AS (SELECT model, task, success, CASE WHEN {UNIFIED} < 9 THEN 'easy' ELSE 'hard' END AS split FROM episodes JOIN view_pairs USING (sample_id))") + " UNION ALL ".join(
    f"SELECT model, task, {s} AS split, count(*) AS n, {r('100 * ' + RATE.format('success'))} AS rate FROM j GROUP BY ALL" for s in ("split", "'all'")))
def _(spark, d):
    return rounded(op.easy_hard(t.episodes(spark, d), t.view_pairs(spark, d), 9.0), "rate")


@query("easy_hard_histogram", ctes(V, f"u AS (SELECT {UNIFIED} AS x FROM view_pairs)", "m AS (SELECT min(x) AS lo, max(x) AS hi FROM u)") +
       "SELECT CAST(least(floor((x - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM u, m GROUP BY 1")
def _(spark, d):
    return op.distance_histogram(t.view_pairs(spark, d), 40)


CLOSE = "CASE WHEN {e} <= 1e-9 THEN 1 WHEN 6 * ({e} / {t} - 1) >= 60 THEN 0 WHEN 6 * ({e} / {t} - 1) <= -60 THEN 1 ELSE 1 / (1 + exp(6 * ({e} / {t} - 1))) END"


@query("reward_compose", ctes(P, """tu AS (SELECT traj_id AS episode_id, turn, tx > 0.4 AS format_ok, turn = max(turn) OVER (PARTITION BY traj_id) AS answered, 1 + CAST(tz * 10 AS BIGINT) % 3 AS n_actions,
  tz AS pos_err_m, abs(rx) / 2 AS ang_err_deg FROM poses)""", "bt AS (SELECT episode_id, min(turn) FILTER (WHERE NOT format_ok) AS bad_at FROM tu GROUP BY 1)", f"""
sc AS (SELECT *, {CLOSE.format(e='pos_err_m', t=0.5)} * {CLOSE.format(e='ang_err_deg', t=30)} AS c, CASE WHEN n_actions = 1 THEN 0.05 ELSE 0 END AS one FROM tu JOIN bt USING (episode_id))""") + f"""
SELECT episode_id, {r('''sum(CASE WHEN NOT format_ok THEN 0 WHEN answered THEN CASE WHEN pos_err_m <= 0.5 + 1e-9 AND ang_err_deg <= 30 + 1e-9 THEN 1.0 ELSE 0 END + 0.5 * c + 0.1
  + CASE WHEN bad_at IS NULL OR bad_at > turn THEN 0.2 ELSE 0 END + one ELSE 0.01 + one END)''')} AS reward, {r('max(c) FILTER (WHERE answered AND format_ok)')} AS closeness FROM sc GROUP BY 1""")
def _(spark, d):
    p = t.poses(spark, d)
    last = p.groupBy("traj_id").agg(F.max("turn").alias("last"))
    turns = p.join(last, "traj_id").select(F.col("traj_id").alias("episode_id"), "turn", (F.col("tx") > 0.4).alias("format_ok"), (F.col("turn") == F.col("last")).alias("answered"),
                                           (1 + F.rint(F.col("tz") * 10).cast("long") % 3).alias("n_actions"), F.col("tz").alias("pos_err_m"), (F.abs("rx") / 2).alias("ang_err_deg"))
    return rounded(op.reward_compose(turns, 0.5, 30.0, answer=1.0, close=0.5, give=0.1, fmt=0.2, per_turn=0.01, single=0.05), "reward", "closeness")


MA, MB = matrix("a_"), matrix("b_")
FACTORS = f"""f0 AS (SELECT sample_id, {DIST} AS pos_dist, {ANG} AS rot_dist, sqrt(pow(b_tx-a_tx,2)+pow(b_ty-a_ty,2)) AS horiz_dist, abs(b_tz-a_tz) AS height_diff,
  -({MA[0][2]}*(b_tx-a_tx)+{MA[1][2]}*(b_ty-a_ty)+{MA[2][2]}*(b_tz-a_tz)) AS fd, degrees(atan2(b_tz-a_tz, sqrt(pow(b_tx-a_tx,2)+pow(b_ty-a_ty,2)))) AS target_elevation,
  {'+'.join(f'{MA[i][2]}*{MB[i][2]}' for i in range(3))} AS orientation_agreement FROM view_pairs),
f1 AS (SELECT *, sqrt(pow(pos_dist/0.5,2)+pow(rot_dist/30,2)) AS unified_dist, CASE WHEN pos_dist > 1e-9 THEN fd/pos_dist ELSE 0 END AS forward_alignment FROM f0),
factors AS (SELECT *, degrees(acos(greatest(-1,least(1,forward_alignment)))) AS target_bearing FROM f1)"""


@query("geometric_factors", ctes(V, FACTORS) + "SELECT sample_id, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in op.FACTORS) + " FROM factors")
def _(spark, d):
    return op.geometric_factors(t.view_pairs(spark, d)).select("sample_id", *[(F.round(c, 4) + 0.0).alias(c) for c in op.FACTORS])


_LONG = " UNION ALL ".join(f"SELECT model, task, '{c}' AS factor, round({c}, 6) AS x, CASE WHEN success THEN 1.0 ELSE 0.0 END AS s FROM episodes JOIN factors USING (sample_id)" for c in op.FACTORS)


@query("factor_correlation", ctes(E, V, FACTORS, f"lg AS ({_LONG})", """rk AS (SELECT *, rank() OVER (PARTITION BY model, task, factor ORDER BY x) + (count(*) OVER (PARTITION BY model, task, factor, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY model, task, factor ORDER BY s) + (count(*) OVER (PARTITION BY model, task, factor, s) - 1) / 2.0 AS rs FROM lg)""") + """
SELECT model, task, factor, count(*) AS n, round(CASE WHEN count(*) < 10 OR stddev_pop(rx) = 0 OR stddev_pop(rs) = 0 THEN 0 ELSE corr(rx, rs) END, 5) + 0.0 AS rho FROM rk GROUP BY model, task, factor""")
def _(spark, d):
    f = op.geometric_factors(t.view_pairs(spark, d)).select("sample_id", *[F.round(c, 6).alias(c) for c in op.FACTORS])
    return op.factor_correlation(t.episodes(spark, d), f).withColumn("rho", F.round("rho", 5) + F.lit(0.0))


OD, OA = errors_sql("", "b_")


@query("inferred_success", ctes(E, V, f"""ob AS (SELECT traj_id AS sample_id, {OD} AS pe, {OA} AS ae FROM poses JOIN view_pairs ON traj_id = sample_id
  WHERE turn < (SELECT max(turn) FROM poses q WHERE q.traj_id = poses.traj_id))""", """nr AS (SELECT sample_id, bool_or(pe <= 3 + 1e-9 AND ae <= 90 + 1e-9) AS reached, min(pe) AS min_pos FROM ob GROUP BY 1)""",
       "j AS (SELECT model, success, reached, min_pos FROM episodes JOIN nr USING (sample_id))") + f"""
SELECT model, count(*) AS n_rollouts, count(*) FILTER (WHERE success) AS n_success, count(*) FILTER (WHERE success AND reached) AS n_success_reached, count(*) FILTER (WHERE reached) AS n_reached_all,
  count(*) FILTER (WHERE reached AND NOT success) AS n_reached_but_failed, {r('avg(min_pos)')} AS mean_closest_m, count(*) FILTER (WHERE success AND NOT reached) AS n_success_inferred,
  {r('count(*) FILTER (WHERE success AND NOT reached) / count(*) FILTER (WHERE success)')} AS inferred_rate FROM j GROUP BY model""")
def _(spark, d):
    p = t.poses(spark, d)
    last = p.groupBy("traj_id").agg(F.max("turn").alias("last"))
    observed = p.join(last, "traj_id").filter("turn < last")
    return rounded(op.inferred_success(t.episodes(spark, d), observed, t.view_pairs(spark, d), 3.0, 90.0), "mean_closest_m", "inferred_rate")


@query("per_turn_stats", ctes(t.TURN_REWARDS_SQL, "x AS (SELECT turn_idx AS turn, CAST(reward AS DECIMAL(18,8)) AS v FROM turn_rewards)", """
g AS (SELECT turn, sum(v)::DOUBLE AS s, sum(CAST(v AS DECIMAL(18,8)) * CAST(v AS DECIMAL(18,8)))::DOUBLE AS q, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, count(*) AS n, count(v) AS k FROM x GROUP BY 1)""") + """
SELECT turn, round(s / k + 1e-9, 4) AS mean, round(sqrt(greatest(q / k - (s / k) * (s / k), 0)) + 1e-9, 4) AS std, round(lo + 1e-9, 4) AS min, round(hi + 1e-9, 4) AS max, n FROM g""")
def _(spark, d):
    return op.per_turn_stats(t.turn_rewards(spark, d).select(F.col("turn_idx").alias("turn"), F.col("reward").alias("value")))


@query("category_accuracy", f"""WITH a AS (SELECT source AS category, CASE WHEN quality = 1 THEN lang ELSE 'en' END = lang AS ok FROM documents LEFT JOIN labels USING (doc_id))
SELECT category, count(*) AS n, {r(RATE.format('ok'))} AS accuracy FROM a GROUP BY 1 UNION ALL SELECT 'Average', count(*), {r(RATE.format('ok'))} FROM a""")
def _(spark, d):
    a = t.table(spark, d, "documents").join(t.table(spark, d, "labels"), "doc_id", "left").select(F.col("source").alias("category"), F.when(F.col("quality") == 1, F.col("lang")).otherwise("en").alias("pred"), F.col("lang").alias("gold"))
    return rounded(op.category_accuracy(a), "accuracy")
