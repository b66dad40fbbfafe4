"""Map, point and exploration analytics over line items, embeddings and events."""

from pyspark.sql import functions as F

from wayfold.functions.stats import r6
from wayfold.operators import maps as op, points as pt
from wayfold.plans.catalog import ctes, query, r
from wayfold.plans.evaluation import matrix, rounded
from wayfold.sources import tables as t

OBJ = """obj AS (SELECT traj_id AS map_id, turn AS idx, tx - 2.5 AS x, ty - 5 AS y, CASE WHEN turn % 3 > 0 THEN CAST(tx * 10 AS BIGINT) % 4 END AS facing,
  CASE WHEN (turn + traj_id) % 5 > 0 THEN tx - 2.5 + tz - 0.41 END AS px, CASE WHEN (turn + traj_id) % 5 > 0 THEN ty - 5 + rx / 90 END AS py,
  CASE WHEN (turn + traj_id) % 5 > 0 THEN CAST(tx * 10 AS BIGINT) % 3 END AS pfacing FROM poses)"""
BIN = "floor(((degrees(atan2({dx}, {dy})) + 360) % 360 + 22.5) / 45) % 8"


def _objects(spark, d):
    k = F.rint(F.col("tx") * 10).cast("long")
    known = (F.col("turn") + F.col("traj_id")) % 5 > 0
    return t.poses(spark, d).select(F.col("traj_id").alias("map_id"), F.col("turn").alias("idx"), (F.col("tx") - 2.5).alias("x"), (F.col("ty") - 5).alias("y"), F.when(F.col("turn") % 3 > 0, k % 4).alias("facing"),
                                    F.when(known, F.col("tx") - 2.5 + F.col("tz") - 0.41).alias("px"), F.when(known, F.col("ty") - 5 + F.col("rx") / 90).alias("py"), F.when(known, k % 3).alias("pfacing"))


@query("map_similarity", ctes(t.POSES_SQL, OBJ, "ob AS (SELECT map_id, idx, x, y, px, py FROM obj UNION ALL SELECT DISTINCT map_id, -1, 0, 0, 0, 0 FROM obj)", f"""
dr AS (SELECT a.map_id, avg(CASE WHEN {BIN.format(dx='a.x - b.x', dy='a.y - b.y')} = {BIN.format(dx='a.px - b.px', dy='a.py - b.py')} THEN 1.0 ELSE 0.0 END) AS dir
  FROM ob a JOIN ob b ON a.map_id = b.map_id AND a.idx < b.idx GROUP BY 1)""", """
sm AS (SELECT map_id, count(*) AS n, count(px) AS m, avg(pow(px - x, 2) + pow(py - y, 2)) AS mse, avg(x * x + y * y) FILTER (WHERE px IS NOT NULL) AS gg,
  count(facing) AS nf, count(*) FILTER (WHERE facing = pfacing) AS nof FROM obj GROUP BY 1)""", """
sc AS (SELECT map_id, dir, CASE WHEN nf = 0 THEN 1 ELSE nof / nf END AS facing, CASE WHEN m = 0 THEN 0 ELSE exp(-sqrt(mse) / sqrt(gg)) * m / n END AS pos FROM sm JOIN dr USING (map_id))""") + f"""
SELECT map_id, {r('dir')} AS dir, {r('facing')} AS facing, {r('pos')} AS pos, {r('(dir + facing + pos) / 3')} AS overall FROM sc""")
def _(spark, d):
    return rounded(op.map_similarity(_objects(spark, d)), *op.MAP_METRICS)


MAPS = """mp AS (SELECT traj_idx AS sample_id, uid AS grp, turn_idx AS turn, reward AS dir, reward / 7 AS facing, reward / 3 AS pos, reward * 2 AS overall, event_id % 7 > 0 AS valid FROM turn_rewards)"""


def _maps(spark, d):
    x = F.col("reward")
    return t.turn_rewards(spark, d).select(F.col("traj_idx").alias("sample_id"), F.col("uid").alias("grp"), F.col("turn_idx").alias("turn"), x.alias("dir"), (x / 7).alias("facing"), (x / 3).alias("pos"),
                                           (x * 2).alias("overall"), (F.col("event_id") % 7 > 0).alias("valid"))


@query("map_curve", ctes(t.TURN_REWARDS_SQL, MAPS) + "SELECT turn, count(*) AS n, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in op.MAP_METRICS) + " FROM mp WHERE valid GROUP BY 1")
def _(spark, d):
    return rounded(op.map_curve(_maps(spark, d)), *op.MAP_METRICS)


@query("map_group_average", ctes(t.TURN_REWARDS_SQL, MAPS, "ps AS (SELECT grp, sample_id, " + ", ".join(f"avg({c}) FILTER (WHERE valid) AS {c}" for c in op.MAP_METRICS) + ", max_by(overall, turn) AS last_overall FROM mp GROUP BY ALL)") +
       "SELECT grp, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in (*op.MAP_METRICS, "last_overall")) + " FROM ps GROUP BY 1")
def _(spark, d):
    return rounded(op.map_group_average(_maps(spark, d)), *op.MAP_METRICS, "last_overall")


@query("average_series", ctes(t.TURN_REWARDS_SQL, "mx AS (SELECT max(turn_idx) AS m FROM turn_rewards)", """
ls AS (SELECT traj_idx, max(turn_idx) AS last, max_by(reward, turn_idx) AS v FROM turn_rewards GROUP BY 1)""", """
gr AS (SELECT traj_idx, unnest(range(0, m + 1)) AS turn FROM ls, mx)""", """
cf AS (SELECT gr.turn, tr.reward, CASE WHEN gr.turn > last THEN v ELSE tr.reward END AS carried FROM gr JOIN ls USING (traj_idx) LEFT JOIN turn_rewards tr ON tr.traj_idx = gr.traj_idx AND tr.turn_idx = gr.turn)""") + f"""
SELECT turn, {r('avg(reward)')} AS mean, {r('avg(carried)')} AS carried_mean FROM cf GROUP BY 1""")
def _(spark, d):
    s = t.turn_rewards(spark, d).select(F.col("traj_idx").alias("series_id"), F.col("turn_idx").alias("turn"), F.col("reward").alias("value"))
    both = op.average_series(s).join(op.average_series(s, carry=True).withColumnRenamed("mean", "carried_mean"), "turn")
    return rounded(both, "mean", "carried_mean")


PR = "pr AS (SELECT event_type AS task, value AS x, CASE WHEN event_id % 5 > 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS y FROM events)"


def _pearson_rows(spark, d):
    return t.table(spark, d, "events").select(F.col("event_type").alias("task"), F.col("value").alias("x"), F.when(F.col("event_id") % 5 > 0, F.regexp_extract("props", "([0-9]+)", 1).cast("double")).alias("y"))


@query("pearson_table", ctes(PR) + f"SELECT task, count(*) AS n, {r('corr(x, y)')} AS r, {r('corr(x, y) * sqrt((count(*) - 2) / (1 - pow(corr(x, y), 2)))')} AS t FROM pr WHERE y IS NOT NULL GROUP BY 1")
def _(spark, d):
    return rounded(op.pearson(_pearson_rows(spark, d), "task", "x", "y"), "r", "t")


# p value of (t, n): continued fraction of the incomplete beta function, list_reduce folds from its last term
_TERM = "1 + (-(a + m - 1) * (a + b + m - 1) * z / ((a + 2 * m - 2) * (a + 2 * m - 1))) / (1 + (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m))) / f)"
PV = f"""ps AS (SELECT task, count(*) AS n, corr(x, y) AS r FROM pr WHERE y IS NOT NULL GROUP BY 1), px AS (SELECT *, (n - 2) / 2 AS h, 1 - r * r AS x FROM ps),
pz AS (SELECT *, x >= (h + 1) / (h + 2.5) AS turn, CASE WHEN x >= (h + 1) / (h + 2.5) THEN 0.5::DOUBLE ELSE h END AS a, CASE WHEN x >= (h + 1) / (h + 2.5) THEN h ELSE 0.5::DOUBLE END AS b, CASE WHEN x >= (h + 1) / (h + 2.5) THEN 1 - x ELSE x END AS z FROM px),
pt AS (SELECT *, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(z) + b * ln(1 - z)) / a / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({op.TERMS}, 0, -1), lambda k: CAST(k AS DOUBLE))), lambda f, m: {_TERM}) AS tail FROM pz),
pp AS (SELECT task, n, r, CASE WHEN turn THEN 1 - tail ELSE tail END AS p FROM pt)"""


@query("pearson_p_values", ctes(PR, PV) + f"SELECT task, n, {r('r')} AS r, {r('p')} AS p, p < 0.05 AS significant FROM pp")
def _(spark, d):
    return rounded(op.pearson_table(_pearson_rows(spark, d), "task", "x", "y"), "r", "p")


CELLS = """pd AS (SELECT DISTINCT l_orderkey // 100 AS grp, l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem WHERE l_returnflag <> 'R'),
co AS (SELECT DISTINCT l_orderkey // 100 AS grp, l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem WHERE l_linestatus = 'O'),
pf AS (SELECT grp, count(*) FILTER (WHERE p.x IS NOT NULL AND c.x IS NOT NULL) AS tp, count(*) FILTER (WHERE c.x IS NULL) AS fp, count(*) FILTER (WHERE p.x IS NULL) AS fn FROM pd p FULL JOIN co c USING (grp, x, y) GROUP BY 1)"""
PRF = f"{r('tp / (tp + fp)')} AS precision, {r('tp / (tp + fn)')} AS recall, {r('2 * tp / (2 * tp + fp + fn)')} AS f1"


def _cells(spark, d, cond):
    return t.table(spark, d, "lineitem").filter(cond).select(F.floor(F.col("l_orderkey") / 100).alias("grp"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"))


@query("set_prf", ctes(CELLS) + f"SELECT grp, tp, fp, fn, {PRF} FROM pf")
def _(spark, d):
    return rounded(op.set_prf(_cells(spark, d, "l_returnflag <> 'R'"), _cells(spark, d, "l_linestatus = 'O'"), ["grp"], ["x", "y"]), "precision", "recall", "f1")


@query("micro_prf", ctes(CELLS, "s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pf)") + f"SELECT tp, fp, fn, {PRF} FROM s")
def _(spark, d):
    return rounded(op.micro_prf(op.set_prf(_cells(spark, d, "l_returnflag <> 'R'"), _cells(spark, d, "l_linestatus = 'O'"), ["grp"], ["x", "y"])), "precision", "recall", "f1")


@query("nearest_distance", """WITH p AS (SELECT DISTINCT l_orderkey // 100 AS grp, l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem WHERE l_returnflag = 'A'),
e AS (SELECT DISTINCT l_orderkey // 100 AS grp, l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem WHERE l_returnflag <> 'A')
""" + f"SELECT p.grp, p.x, p.y, {r('sqrt(min(pow(p.x - e.x, 2) + pow(p.y - e.y, 2)))')} AS distance FROM p JOIN e ON p.grp = e.grp GROUP BY ALL")
def _(spark, d):
    return rounded(op.nearest_distance(_cells(spark, d, "l_returnflag = 'A'"), _cells(spark, d, "l_returnflag <> 'A'")), "distance")


@query("distance_hit_correlation", """WITH p AS (SELECT DISTINCT l_orderkey // 100 AS grp, l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem WHERE l_returnflag = 'A'),
e AS (SELECT DISTINCT l_orderkey // 100 AS grp, l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem WHERE l_returnflag <> 'A'),
h AS (SELECT DISTINCT l_orderkey // 100 AS grp, l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem WHERE l_linestatus = 'O'),
dd AS (SELECT p.grp, p.x, p.y, sqrt(min(pow(p.x - e.x, 2) + pow(p.y - e.y, 2))) AS distance FROM p JOIN e ON p.grp = e.grp GROUP BY ALL)
""" + f"SELECT count(*) AS n, {r('corr(distance, CASE WHEN h.grp IS NULL THEN 0.0 ELSE 1.0 END)')} AS corr FROM dd LEFT JOIN h ON dd.grp = h.grp AND dd.x = h.x AND dd.y = h.y")
def _(spark, d):
    dist = op.nearest_distance(_cells(spark, d, "l_returnflag = 'A'"), _cells(spark, d, "l_returnflag <> 'A'"))
    return rounded(op.distance_hit_correlation(dist, _cells(spark, d, "l_linestatus = 'O'").distinct()), "corr")


@query("task_scores", ctes("q AS (SELECT user_id AS sample_id, event_type AS task, value / 100 AS score FROM events)") + f"""
SELECT CAST(sample_id AS VARCHAR) AS sample, task, count(*) AS n_total, {r('sum(score)')} AS score, {r('avg(score)')} AS accuracy FROM q GROUP BY ALL
UNION ALL SELECT CAST(sample_id AS VARCHAR), 'overall', count(*) FILTER (WHERE task <> 'view'), {r("coalesce(sum(score) FILTER (WHERE task <> 'view'), 0)")}, {r("avg(score) FILTER (WHERE task <> 'view')")} FROM q GROUP BY sample_id
UNION ALL SELECT 'all', 'overall', count(*) FILTER (WHERE task <> 'view'), {r("sum(score) FILTER (WHERE task <> 'view')")}, {r("avg(score) FILTER (WHERE task <> 'view')")} FROM q""")
def _(spark, d):
    q = t.table(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("task"), (F.col("value") / 100).alias("score"))
    return rounded(op.task_scores(q, ["view"]), "score", "accuracy")


EX = ctes(t.TURN_REWARDS_SQL, """ex AS (SELECT traj_idx AS sample_id, turn_idx AS turn, e.event_type AS action, reward AS coverage, reward * 2 AS gain, e.event_type = 'error' AS failed, e.value > 5 AS valid
  FROM turn_rewards JOIN events e USING (event_id))""", """sm AS (SELECT sample_id, max_by(coverage, turn) AS last_coverage, count(*) AS n_steps, count(*) FILTER (WHERE action = 'view') AS n_view,
  count(*) FILTER (WHERE action = 'click') AS n_click, sum(CASE WHEN action = 'view' THEN 1 ELSE 0 END) AS action_cost, max_by(gain, turn) AS final_gain,
  avg(CASE WHEN failed THEN 1.0 ELSE 0 END) AS fail_ratio, avg(CASE WHEN valid THEN 1.0 ELSE 0 END) AS valid_ratio FROM ex GROUP BY 1)""")
EXC = ("last_coverage", "action_cost", "final_gain", "fail_ratio", "valid_ratio")


def _exploration(spark, d):
    e = t.table(spark, d, "events").select("event_id", F.col("event_type").alias("action"), "value")
    x = t.turn_rewards(spark, d).join(e, "event_id").select(F.col("traj_idx").alias("sample_id"), F.col("turn_idx").alias("turn"), "action", F.col("reward").alias("coverage"), (F.col("reward") * 2).alias("gain"),
                                                           (F.col("action") == "error").alias("failed"), (F.col("value") > 5).alias("valid"))
    return op.exploration_summary(x, {"view": 1.0, "click": 0.0})


@query("exploration_summary", EX + "SELECT sample_id, n_steps, n_view, n_click, " + ", ".join(f"{r(c)} AS {c}" for c in EXC) + " FROM sm")
def _(spark, d):
    return rounded(_exploration(spark, d), *EXC)


@query("exploration_group", EX + "SELECT " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in (*EXC, "n_steps", "n_view", "n_click")) + " FROM sm")
def _(spark, d):
    return rounded(op.exploration_group(_exploration(spark, d)), *EXC, "n_steps", "n_view", "n_click")


# --- points --------------------------------------------------------------------------------
W, H, FOC = 64, 48, 40.0
M = matrix("")
PTS = f"""pts AS (SELECT vec_id AS vid, 'scene' || (vec_id // 50) AS scene_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[10]::DOUBLE AS value FROM embeddings),
cams AS (SELECT vec_id AS cam_id, vec_id // 5 AS traj_id, CASE WHEN vec_id % 5 = 4 THEN 4 ELSE greatest(vec_id % 5 - 1, 0) END AS turn, vec_id % 5 = 4 AS is_target, 'scene' || (vec_id // 50) AS scene_id,
  embedding[4]::DOUBLE AS tx, embedding[5]::DOUBLE AS ty, embedding[6]::DOUBLE AS tz, embedding[7]::DOUBLE * 900 AS rx, embedding[8]::DOUBLE * 900 AS ry, embedding[9]::DOUBLE * 900 AS rz FROM embeddings),
pj AS (SELECT cam_id, vid, {', '.join('+'.join(f'{M[i][j]}*({a}-t{a})' for i, a in enumerate('xyz')) + f' AS c{j}' for j in range(3))} FROM cams JOIN pts USING (scene_id)),
px AS (SELECT cam_id, vid, c2 AS depth, floor({FOC} * c0 / c2 + {W / 2}) AS u, floor({FOC} * c1 / c2 + {H / 2}) AS v FROM pj WHERE c2 > 0.05),
ib AS (SELECT *, min(depth) OVER (PARTITION BY cam_id, u, v) AS front FROM px WHERE u >= 0 AND u < {W} AND v >= 0 AND v < {H}),
vis AS (SELECT cam_id, vid FROM ib WHERE abs(depth - front) < 0.05)"""


def _el(i):
    return F.element_at("embedding", i).cast("double")


def _points(spark, d):
    v = F.col("vec_id")
    scene = F.concat(F.lit("scene"), F.floor(v / 50).cast("string")).alias("scene_id")
    e = t.table(spark, d, "embeddings")
    pts = e.select(v.alias("vid"), scene, _el(1).alias("x"), _el(2).alias("y"), _el(3).alias("z"), _el(10).alias("value"))
    cams = e.select(v.alias("cam_id"), F.floor(v / 5).alias("traj_id"), F.when(v % 5 == 4, 4).otherwise(F.greatest(v % 5 - 1, F.lit(0))).cast("long").alias("turn"), (v % 5 == 4).alias("is_target"), scene,
                    _el(4).alias("tx"), _el(5).alias("ty"), _el(6).alias("tz"), (_el(7) * 900).alias("rx"), (_el(8) * 900).alias("ry"), (_el(9) * 900).alias("rz"))
    return pts, cams, pt.visible_points(cams, pts, W, H, FOC, cell=0.1)


@query("point_visibility", ctes(PTS) + "SELECT cam_id, vid FROM vis")
def _(spark, d):
    return _points(spark, d)[2]


@query("coverage_curve", ctes(PTS, "vt AS (SELECT traj_id, turn, is_target, vid FROM vis JOIN cams USING (cam_id))", """
fs AS (SELECT traj_id, vid, min(turn) AS turn, max(CASE WHEN EXISTS (SELECT 1 FROM vt q WHERE q.is_target AND q.traj_id = vt.traj_id AND q.vid = vt.vid) THEN 1 ELSE 0 END) AS hit FROM vt WHERE NOT is_target GROUP BY ALL)""", """
tt AS (SELECT DISTINCT traj_id, scene_id, turn FROM cams WHERE NOT is_target)""", """
nw AS (SELECT tt.*, count(vid) AS n, coalesce(sum(hit), 0) AS h FROM tt LEFT JOIN fs USING (traj_id, turn) GROUP BY ALL)""", "tot AS (SELECT scene_id, count(*) AS total FROM pts GROUP BY 1)") + f"""
SELECT traj_id, turn, CAST(sum(n) OVER w AS BIGINT) AS covered, n AS increment, {r('sum(n) OVER w / total')} AS ratio, CAST(sum(h) OVER w AS BIGINT) AS target_covered, CAST(h AS BIGINT) AS target_increment
FROM nw JOIN tot USING (scene_id) WINDOW w AS (PARTITION BY traj_id ORDER BY turn)""")
def _(spark, d):
    pts, cams, vis = _points(spark, d)
    return rounded(pt.coverage_curve(vis, cams, pts), "ratio")


@query("visual_overlap", ctes(PTS, """ab AS (SELECT vec_id // 5 AS pair_id, vid, vec_id % 5 = 0 AS first FROM vis JOIN embeddings ON cam_id = vec_id WHERE vec_id % 5 IN (0, 4))""", """
g AS (SELECT pair_id, vid, bool_or(first) AS a, bool_or(NOT first) AS b FROM ab GROUP BY ALL)""") + f"""
SELECT pair_id, count(*) FILTER (WHERE a AND b) AS n_both, {r('coalesce(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE a), 0), 0)')} AS over_first,
  {r('coalesce(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE b), 0), 0)')} AS over_second, {r('count(*) FILTER (WHERE a AND b) / count(*)')} AS iou FROM g GROUP BY 1""")
def _(spark, d):
    pts, cams, vis = _points(spark, d)
    pairs = t.table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 5).alias("pair_id")).agg(F.min("vec_id").alias("cam_a"), (F.min("vec_id") + 4).alias("cam_b"))
    return rounded(pt.visual_overlap(vis, pairs), "over_first", "over_second", "iou")


@query("overlap_value_stats", ctes(PTS, "n AS (SELECT vid, count(*) AS views FROM vis GROUP BY 1)") + f"""
SELECT scene_id, count(*) FILTER (WHERE views >= 2) AS n_overlap, count(*) FILTER (WHERE views < 2) AS n_single, {r('avg(value) FILTER (WHERE views >= 2)')} AS mean_overlap,
  {r('avg(value) FILTER (WHERE views < 2)')} AS mean_single FROM n JOIN pts USING (vid) GROUP BY 1""")
def _(spark, d):
    pts, cams, vis = _points(spark, d)
    return rounded(pt.overlap_value_stats(vis, pts.select("vid", "scene_id", "value")), "mean_overlap", "mean_single")
