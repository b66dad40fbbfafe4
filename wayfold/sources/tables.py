"""Views of the test tables in the shapes the operators expect.

Every view covers its whole table.  Group keys grow with the data (a prompt is a block of
four users, a scene a block of ten), so the number of groups scales as the tables do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.ordering import numbered, numbered_led

# The twelve atomic camera actions, in the order used for picking.
ACTIONS = ["move_forward", "move_backward", "move_left", "move_right", "move_up", "move_down",
           "turn_left", "turn_right", "look_up", "look_down", "rotate_cw", "rotate_ccw"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ordered_events(spark: SparkSession, d: str, pos: str) -> DataFrame:
    """Events numbered per user from 0; a user's events are chunked by hour."""
    e = table(spark, d, "events")
    return numbered(e, ["user_id"], ["ts", "event_id"], pos, F.date_trunc("HOUR", "ts"))


def _states(events: DataFrame) -> DataFrame:
    """Events with their trajectory, scene, state and action."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    names = F.array(*[F.lit(a) for a in ACTIONS])
    first, second = F.get(names, k % 12), F.get(names, (k * 7) % 12)
    return events.withColumns({
        "traj_id": F.col("user_id"), "scene_id": F.concat(F.lit("scene"), F.floor(F.col("user_id") / 10).cast("string")),
        "state": F.concat("event_type", F.lit("_"), F.floor(F.col("value") / 25).cast("string")),
        "action": F.when(F.col("event_type") == "error", F.lit(None)).when(k % 5 == 0, F.concat(first, F.lit(" | "), second)).otherwise(first)})


def steps(spark: SparkSession, d: str) -> DataFrame:
    """(traj_id, turn, scene_id, state, action): one row per observed state."""
    return _states(_ordered_events(spark, d, "turn")).select("traj_id", "turn", "scene_id", "state", "action")


def steps_with_next(spark: SparkSession, d: str) -> DataFrame:
    """``steps`` with each row's next state, from one scan of the events."""
    e = _states(table(spark, d, "events")).select("traj_id", "ts", "event_id", "scene_id", "state", "action")
    s = numbered_led(e, ["traj_id"], ["ts", "event_id"], "turn", F.date_trunc("HOUR", "ts"), {"next_state": "state"})
    return s.select("traj_id", "turn", "scene_id", "state", "action", "next_state", "has_next")


STEPS_SQL = f"""v AS (SELECT i AS a, x AS name FROM (SELECT unnest(range(12)) AS i, unnest({ACTIONS!r}) AS x)),
ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
steps AS (SELECT ev.user_id AS traj_id, row_number() OVER (PARTITION BY ev.user_id ORDER BY ts, event_id) - 1 AS turn,
  'scene' || CAST(CAST(floor(ev.user_id / 10) AS BIGINT) AS VARCHAR) AS scene_id,
  event_type || '_' || CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS state,
  CASE WHEN event_type = 'error' THEN NULL WHEN k % 5 = 0 THEN v1.name || ' | ' || v2.name ELSE v1.name END AS action
  FROM ev JOIN v v1 ON v1.a = k % 12 JOIN v v2 ON v2.a = (k * 7) % 12)"""


def turn_rewards(spark: SparkSession, d: str) -> DataFrame:
    """(uid, traj_idx, event_id, turn_idx, reward): one row per rewarded turn."""
    return _ordered_events(spark, d, "turn_idx").select(
        F.floor(F.col("user_id") / 4).alias("uid"), F.col("user_id").alias("traj_idx"), "event_id", "turn_idx",
        (F.col("value") / 100).alias("reward"))


TURN_REWARDS_SQL = """turn_rewards AS (SELECT CAST(floor(user_id / 4) AS BIGINT) AS uid, user_id AS traj_idx, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS turn_idx, value / 100 AS reward FROM events)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(uid, sample_id, reward, length, acc): one row per response, four responses to a prompt.

    Rewards are rounded far below the cents they are summed from: the last bit of a sum of doubles
    follows the order of the rows, and equal rewards must tie in every order.
    """
    return (table(spark, d, "events").groupBy(F.floor(F.col("user_id") / 4).alias("uid"), F.col("user_id").alias("sample_id"))
            .agg(F.round(F.sum(F.col("value") / 100), 9).alias("reward"), F.count(F.lit(1)).alias("length"),
                 F.max(F.when(F.col("value") > 250, 1.0).otherwise(0.0)).alias("acc")))


SAMPLES_SQL = """samples AS (SELECT CAST(floor(user_id / 4) AS BIGINT) AS uid, user_id AS sample_id, sum(value / 100) AS reward,
  count(*) AS length, max(CASE WHEN value > 250 THEN 1.0e0 ELSE 0.0e0 END) AS acc FROM events GROUP BY 1, 2)"""


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, uid, pos, score, val, mask, old_logp, rollout_logp, ref_logp): one row per token."""
    def logp(n):
        return (-((F.col("event_id") * n) % 89) / F.lit(89.0))
    return _ordered_events(spark, d, "pos").select(
        F.col("user_id").alias("sample_id"), F.floor(F.col("user_id") / 4).alias("uid"), "pos", (F.col("value") / 100).alias("score"),
        (((F.col("event_id") * 37) % 101) / F.lit(101.0)).alias("val"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("mask"),
        logp(13).alias("old_logp"), logp(29).alias("rollout_logp"), logp(53).alias("ref_logp"))


TOKENS_SQL = """tokens AS (SELECT user_id AS sample_id, CAST(floor(user_id / 4) AS BIGINT) AS uid,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value / 100 AS score,
  ((event_id * 37) % 101) / CAST(101 AS DOUBLE) AS val, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS mask,
  -((event_id * 13) % 89) / CAST(89 AS DOUBLE) AS old_logp, -((event_id * 29) % 89) / CAST(89 AS DOUBLE) AS rollout_logp,
  -((event_id * 53) % 89) / CAST(89 AS DOUBLE) AS ref_logp FROM events)"""


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """One evaluated episode per order: model, task, errors, turns, reward and finish reason."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("m"), (F.col("c_nationkey") % 6).cast("string")).alias("model"), F.concat(F.lit("task"), (key % 3).cast("string")).alias("task"),
        key.alias("sample_id"), F.concat(F.lit("scene"), F.floor(F.col("c_custkey") / 20).cast("string")).alias("scene_id"),
        (F.col("o_orderstatus") == "F").alias("success"), (F.col("o_totalprice") / 100000).alias("pos_err_m"), (((key * 7919) % 1800) / 10).alias("ang_err_deg"),
        (1 + key % 10).alias("gt_action_len"), (1 + key % 7).alias("num_turns"), (F.col("o_totalprice") / 1000 - 100).alias("cumulative_reward"),
        F.when(F.col("o_orderpriority").startswith("1"), "error").when(F.col("o_orderpriority").startswith("2"), "max_turns").otherwise("done").alias("finish_reason"))


EPISODES_SQL = """episodes AS (SELECT 'm' || CAST(c_nationkey % 6 AS VARCHAR) AS model, 'task' || CAST(o_orderkey % 3 AS VARCHAR) AS task, o_orderkey AS sample_id,
  'scene' || CAST(c_custkey // 20 AS VARCHAR) AS scene_id, o_orderstatus = 'F' AS success, o_totalprice / 100000 AS pos_err_m, ((o_orderkey * 7919) % 1800) / 10 AS ang_err_deg,
  1 + o_orderkey % 10 AS gt_action_len, 1 + o_orderkey % 7 AS num_turns, o_totalprice / 1000 - 100 AS cumulative_reward,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'error' WHEN o_orderpriority LIKE '2%' THEN 'max_turns' ELSE 'done' END AS finish_reason
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _pose() -> list[Column]:
    """tx..rz of an order line."""
    return [(F.col("l_quantity") / 10).alias("tx"), (F.col("l_extendedprice") / 10000).alias("ty"), (F.col("l_tax") * 10).alias("tz"),
            (F.col("l_discount") * 900).alias("rx"), (F.col("l_quantity") * 7 - 170).alias("ry"), (F.col("l_tax") * 1000 - 40).alias("rz")]


def poses(spark: SparkSession, d: str) -> DataFrame:
    """(traj_id, turn, scene_id, tx..rz): the camera poses of an order's lines in sequence."""
    li = table(spark, d, "lineitem")
    li = numbered(li, ["l_orderkey"], _LINE_ORDER, "turn", F.col("l_linenumber"))
    return li.select(F.col("l_orderkey").alias("traj_id"), "turn", F.concat(F.lit("scene"), F.floor(F.col("l_orderkey") / 50).cast("string")).alias("scene_id"),
                     *_pose())


POSES_SQL = f"""poses AS (SELECT l_orderkey AS traj_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS turn,
  'scene' || CAST(l_orderkey // 50 AS VARCHAR) AS scene_id, l_quantity / 10 AS tx, l_extendedprice / 10000 AS ty, l_tax * 10 AS tz, l_discount * 900 AS rx, l_quantity * 7 - 170 AS ry,
  l_tax * 1000 - 40 AS rz FROM lineitem)"""


def view_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, a_tx.., b_tx..): first and last pose of each order, by partial aggregation without numbering the lines."""
    line = F.struct(*_LINE_ORDER, *_pose())
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.min(line).alias("a"), F.max(line).alias("b"))
    return g.select("sample_id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("tx", "ty", "tz", "rx", "ry", "rz")])


VIEW_PAIRS_SQL = POSES_SQL + ",\nview_pairs AS (SELECT traj_id AS sample_id, " + ", ".join(
    f"{f}({c}, turn) AS {s}_{c}" for s, f in (("a", "min_by"), ("b", "max_by")) for c in ("tx", "ty", "tz", "rx", "ry", "rz")) + " FROM poses GROUP BY 1)"


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Tagged answers over whole documents, with a gold text and a gold number."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.col("source").alias("data_source"), "quality", F.concat(
        F.lit("<think>"), "text", F.lit("</think><answer>The "), "lang", F.lit("</answer> #### "), (F.col("n_chars") % 7).cast("string")).alias("response"),
        F.when(F.col("quality") == 1, F.col("lang")).otherwise("xx").alias("gold_text"), (F.col("n_chars") % 5).cast("string").alias("gold_num"))


RESPONSES_SQL = """responses AS (SELECT d.doc_id, d.source AS data_source, quality, '<think>' || d.text || '</think><answer>The ' || d.lang || '</answer> #### ' || CAST(d.n_chars % 7 AS VARCHAR) AS response,
  CASE WHEN l.quality = 1 THEN d.lang ELSE 'xx' END AS gold_text, CAST(d.n_chars % 5 AS VARCHAR) AS gold_num FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
