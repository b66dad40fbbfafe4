"""Supervised records from the walks of the event graph."""

from pyspark.sql import functions as F

from wayfold.functions.ordering import hash_int, hash_of
from wayfold.functions.stats import r6
from wayfold.operators import datasets as op
from wayfold.plans.catalog import ctes, query, r
from wayfold.plans.graph import G, WALKS, graph, walks
from wayfold.session import materialize
from wayfold.sources import tables as t

IMG = """im AS (SELECT *, CASE WHEN ('0x' || substr(md5('img|' || id), 1, 12))::BIGINT % 10 > 0 THEN 'img/' || id || '.png' END AS image FROM nodes)"""
AW = """wx AS (SELECT scene_id AS s, walk AS w, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS pos FROM walks),
wa AS (SELECT s, w, list(image ORDER BY pos) AS images, list(state ORDER BY pos) AS states FROM wx JOIN im USING (id) GROUP BY ALL),
aw AS (SELECT walks.*, images, states, array_to_string(actions, ' | ') AS cat FROM walks JOIN wa ON s = scene_id AND w = walk)"""
B = (*G, WALKS, IMG, AW)


def hx(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 12))::BIGINT"


def base(spark, d):
    n, e, w = walks(spark, d)
    n = n.withColumn("image", F.when(hash_int(hash_of("img", "id")) % 10 > 0, F.concat(F.lit("img/"), "id", F.lit(".png"))))
    return n, e, w


def annotated(spark, d):
    n, e, w = base(spark, d)
    return n, e, op.annotate(w, n)


def flat(df, *extra):
    m = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n--\n")
    return df.select("scene_id", "walk", *extra, m.alias("record"), F.array_join("images", ",").alias("images"))


def rec(*parts: str) -> str:
    """SQL text of a flattened record from (role, SQL expression) pieces."""
    return " || chr(10) || '--' || chr(10) || ".join(parts)


def m(role: str, expr: str) -> str:
    return f"'{role}: ' || {expr}"


def sysm(key: str) -> str:
    return m("system", f"'{op.PROMPTS[key]}'")


NL = "chr(10)"
ENDS = "images[1] IS NOT NULL AND images[-1] IS NOT NULL"
ATOM = "list_filter(list_transform(string_split({}, '|'), lambda a: trim(a)), lambda a: a <> '')"

RAR = f"""at1 AS (SELECT scene_id, walk, unnest({ATOM.format('cat')}) AS a FROM aw), at2 AS (SELECT scene_id, walk, a, count(*) AS c FROM at1 GROUP BY ALL),
at3 AS (SELECT *, sum(c) OVER (PARTITION BY scene_id, a) AS g, sum(c) OVER (PARTITION BY scene_id) AS total FROM at2),
rar AS (SELECT scene_id, walk, round(sum(c * total / g), 9) AS rarity FROM at3 GROUP BY ALL)"""


@query("balanced_select", ctes(*B, RAR) + f"""SELECT scene_id, walk, {r('rarity')} AS rarity FROM rar
QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY rarity DESC, md5('bal|' || scene_id || '|' || walk)) <= 8""")
def _(spark, d):
    return op.balanced_select(base(spark, d)[2], 8, "bal").select("scene_id", "walk", r6("rarity").alias("rarity"))


KIND = """kd AS (SELECT scene_id, walk, CASE WHEN len(list_filter(actions, lambda a: contains(a, '|'))) = 0 THEN 'single' WHEN len(list_filter(actions, lambda a: contains(a, '|'))) = len(actions) THEN 'multi' ELSE 'mix' END AS kind FROM aw),
ct AS (SELECT scene_id, count(*) FILTER (WHERE kind = 'single') AS s, count(*) FILTER (WHERE kind = 'mix') AS x, count(*) FILTER (WHERE kind = 'multi') AS u FROM kd GROUP BY 1),
q1 AS (SELECT *, least(s, 9) AS qs, greatest(9 - s, 0) AS ss FROM ct), q2 AS (SELECT *, least(x, 3 + ss) AS qx, greatest(3 + ss - x, 0) AS sx FROM q1), q3 AS (SELECT *, least(u, 3 + sx) AS qu, greatest(3 + sx - u, 0) AS su FROM q2),
q4 AS (SELECT *, 0 AS mu, least(x - qx, su) AS mx FROM q3), q5 AS (SELECT *, least(s - qs, su - mx) AS ms FROM q4),
qt AS (SELECT scene_id, 'single' AS kind, qs + ms AS quota FROM q5 UNION ALL SELECT scene_id, 'mix', qx + mx FROM q5 UNION ALL SELECT scene_id, 'multi', qu FROM q5)"""


@query("ratio_allocate", ctes(*B, KIND) + """SELECT scene_id, walk, kind FROM kd JOIN qt USING (scene_id, kind)
QUALIFY row_number() OVER (PARTITION BY scene_id, kind ORDER BY md5('ratio|' || scene_id || '|' || walk), scene_id, walk) <= quota""")
def _(spark, d):
    return op.ratio_allocate(base(spark, d)[2], "3:1:1", 15, "ratio").select("scene_id", "walk", "kind")


SUB = f"""sb AS (SELECT *, h % n AS s, h // 4096 % (n - h % n) + h % n + 1 AS e FROM (SELECT aw.*, len(actions) AS n, {hx("'vd|' || scene_id || '|' || walk")} AS h FROM aw)),
sw AS (SELECT *, len({ATOM.format("array_to_string(actions[s + 1:e], '|')")}) AS n_steps, images[s + 1] AS ia, images[e + 1] AS ib FROM sb),
vd AS (SELECT * FROM sw WHERE ia IS NOT NULL AND ib IS NOT NULL)"""


@query("bucket_even_sample", ctes(*B, SUB, """rk AS (SELECT *, row_number() OVER (PARTITION BY scene_id, n_steps ORDER BY md5('vd|' || scene_id || '|' || walk), scene_id, walk) AS k FROM vd),
pb AS (SELECT scene_id, greatest(1, 10 // count(DISTINCT n_steps)) AS per FROM vd GROUP BY 1), evn AS (SELECT rk.*, k <= per AS early FROM rk JOIN pb USING (scene_id)),
od AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY early DESC, CASE WHEN early THEN n_steps END, CASE WHEN early THEN k END, md5('vd|' || scene_id || '|' || walk), scene_id, walk) AS j FROM evn)""") + """
SELECT scene_id, walk, n_steps FROM od WHERE j <= 10""")
def _(spark, d):
    v = op.gen_view_difference(annotated(spark, d)[2], "vd").select("scene_id", "walk", F.col("n_steps").cast("long").alias("n_steps"))
    return op.bucket_even_sample(materialize(v), "n_steps", 10, "vd")


def neg_nodes(seed: str, src: str = "im WHERE image IS NOT NULL", name: str = "ng") -> str:
    return f"""{name}k AS (SELECT scene_id, id, row_number() OVER (PARTITION BY scene_id ORDER BY md5('{seed}|' || id), id) AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM {src}),
{name}c AS (SELECT aw.scene_id, aw.walk, j, q.id FROM aw JOIN (SELECT DISTINCT scene_id, n FROM {name}k) z USING (scene_id), range(0, 5) x(j), {name}k q
  WHERE j < z.n AND q.scene_id = aw.scene_id AND q.k = ({hx(f"'{seed}|' || aw.scene_id || '|' || walk")} % z.n + j) % z.n + 1 AND q.id <> nodes[1] AND q.id <> nodes[-1]),
{name} AS (SELECT scene_id, walk, (list(id ORDER BY j))[1:3] AS negs FROM {name}c GROUP BY ALL)"""


@query("sample_negative_nodes", ctes(*B, neg_nodes("neg")) + "SELECT scene_id, walk, array_to_string(negs, ',') AS negatives FROM ng")
def _(spark, d):
    n, e, w = base(spark, d)
    return op.sample_negative_nodes(w, n, 3, "neg").select("scene_id", "walk", F.array_join("negatives", ",").alias("negatives"))


def disp(a: str) -> str:
    return " || ',' || ".join(f"(len(list_filter({a}, lambda z: z = '{p}')) - len(list_filter({a}, lambda z: z = '{q}')))" for p, q in op.AXES)


NEGA = f"""na0 AS (SELECT scene_id, walk, trial, {ATOM.format('cat')} AS gt FROM aw, range(1, 21) x(trial)),
na1 AS (SELECT *, list_transform(range(len(gt)), lambda i: {t.ACTIONS!r}[CAST({hx("'na|' || scene_id || '|' || walk || '|' || trial || '|' || i")} % 12 AS INT) + 1]) AS cand FROM na0),
na2 AS (SELECT *, {disp('cand')} AS d, {disp('gt')} AS dg FROM na1),
na3 AS (SELECT scene_id, walk, d, min(trial) AS trial, min_by(cand, trial) AS cand FROM na2 WHERE d <> dg GROUP BY scene_id, walk, d),
na AS (SELECT scene_id, walk, (list(array_to_string(cand, ' | ') ORDER BY trial))[1:3] AS negs FROM na3 GROUP BY ALL)"""


@query("sample_negative_actions", ctes(*B, NEGA) + "SELECT scene_id, walk, array_to_string(negs, ' / ') AS negatives FROM na")
def _(spark, d):
    return op.sample_negative_actions(base(spark, d)[2], 3, "na").select("scene_id", "walk", F.array_join("negatives", " / ").alias("negatives"))


NUMS = """nn0 AS (SELECT vd.*, unnest(range(1, CAST(greatest(len({a}) + 2, n_steps + 3) AS BIGINT) + 1)) AS x FROM vd),
nn AS (SELECT scene_id, walk, (list(CAST(x AS VARCHAR) ORDER BY md5('vd|' || scene_id || '|' || walk || '|' || x), x))[1:3] AS negs FROM nn0 WHERE x <> n_steps GROUP BY ALL)""".replace("{a}", ATOM.format("cat"))


@query("sample_negative_numbers", ctes(*B, SUB, NUMS) + "SELECT scene_id, walk, array_to_string(negs, ',') AS negatives FROM nn")
def _(spark, d):
    w = op._pair_shown(op.sub_walk(annotated(spark, d)[2], "vd"))
    hi = F.greatest(F.size(op.atoms(op.concat_actions())) + 2, F.col("n_steps") + 3)
    return w.select("scene_id", "walk", F.array_join(op.negative_numbers(F.col("n_steps"), 3, hi, "vd"), ",").alias("negatives"))


@query("gen_action_gen", ctes(*B) + f"""SELECT scene_id, walk, {rec(sysm('action_gen'), m('user', "'From <image> to <image>: which actions?'"), m('assistant', "'<action>' || cat || '</action>'"))} AS record,
  images[1] || ',' || images[-1] AS images FROM aw WHERE {ENDS}""")
def _(spark, d):
    return flat(op.gen_action_gen(annotated(spark, d)[2]))


def options(src: str, right: str, seed: str) -> str:
    """CTE ``op``: the right option inserted among ``negs`` at the hashed slot."""
    return f"""op0 AS (SELECT *, {hx(f"'{seed}|' || scene_id || '|' || walk")} % 4 AS slot, {right} AS answer FROM {src} WHERE len(negs) >= 3),
op AS (SELECT *, list_concat(list_append(negs[1:slot], answer), negs[slot + 1:3]) AS opts, substr('ABCD', CAST(slot AS INT) + 1, 1) AS letter FROM op0)"""


LET = "'A. ' || opts[1] || chr(10) || 'B. ' || opts[2] || chr(10) || 'C. ' || opts[3] || chr(10) || 'D. ' || opts[4]"
ANS = "'<action>answer(' || letter || ')</action>'"


@query("gen_path_to_view", ctes(*B, neg_nodes("p2v"), f"pv AS (SELECT aw.*, negs FROM aw JOIN ng USING (scene_id, walk) WHERE {ENDS})", options("pv", "nodes[-1]", "p2v"), """
sh AS (SELECT scene_id AS s, walk AS w, string_agg(image, ',' ORDER BY p) AS shown FROM (SELECT op.scene_id, walk, unnest(opts) AS id, generate_subscripts(opts, 1) AS p FROM op) o JOIN (SELECT id, image FROM im) USING (id) GROUP BY ALL)""") + f"""
SELECT scene_id, walk, {rec(sysm('path_to_view'), m('user', "'From <image> do [' || cat || ']. Which view results?' || chr(10) || 'A. <image>' || chr(10) || 'B. <image>' || chr(10) || 'C. <image>' || chr(10) || 'D. <image>'"), m('assistant', ANS))} AS record,
  images[1] || ',' || shown AS images FROM op JOIN sh ON s = scene_id AND w = walk""")
def _(spark, d):
    n, e, w = annotated(spark, d)
    return flat(op.gen_path_to_view(w, n, "p2v"))


def _dialogue(mcq: str | None) -> str:
    first = "'Scene ' || scene_id || ': from <image> to <image>.' || chr(10) || states[i] || chr(10) || 'Step 1/' || (len(actions) + 1)"
    later = "'format: ok' || chr(10) || states[i] || chr(10) || '<image>' || chr(10) || 'Step ' || i || '/' || (len(actions) + 1)"
    q = f"CASE WHEN i = 1 THEN {first} ELSE {later} END"
    a = "'<action>' || actions[i] || '</action>'"
    if mcq:
        q, a = f"{q} || CASE WHEN chosen THEN chr(10) || 'A. ' || o1 || chr(10) || 'B. ' || o2 || chr(10) || 'C. ' || o3 ELSE '' END", f"CASE WHEN chosen THEN '<action>answer(' || substr('ABCD', slot + 1, 1) || ')</action>' ELSE {a} END"
    src = f"(SELECT aw.*, unnest(range(1, len(actions) + 1)) AS i FROM aw WHERE len(list_filter(images, lambda x: x IS NULL)) = 0)"
    if mcq:
        src = f"""(SELECT *, h % 1000 < 500 AS chosen, CAST(h // 65536 % 3 AS INT) AS slot, CASE WHEN h // 65536 % 3 = 0 THEN actions[i] ELSE w1 END AS o1,
  CASE h // 65536 % 3 WHEN 1 THEN actions[i] WHEN 0 THEN w1 ELSE w2 END AS o2, CASE WHEN h // 65536 % 3 = 2 THEN actions[i] ELSE w2 END AS o3 FROM (
    SELECT *, ot[CAST(h // 1000 % len(ot) AS INT) + 1] AS w1, ot[CAST((h // 1000 + 5) % len(ot) AS INT) + 1] AS w2 FROM (
      SELECT *, {hx(f"'{mcq}|' || scene_id || '|' || walk || '|' || (i - 1)")} AS h, list_filter({t.ACTIONS!r}, lambda z: z <> actions[i]) AS ot FROM {src})))"""
    return f"""dl AS (SELECT scene_id, walk, any_value(states) AS states, any_value(images) AS images, any_value(len(actions)) AS n, string_agg('user: ' || {q} || chr(10) || '--' || chr(10) || 'assistant: ' || {a}, chr(10) || '--' || chr(10) ORDER BY i) AS body FROM {src} GROUP BY scene_id, walk)"""


DSEL = f"""SELECT scene_id, walk, {rec(sysm('multi_turn'), "body", m('user', "'format: ok' || chr(10) || states[-1] || chr(10) || '<image>' || chr(10) || 'Step ' || (n + 1) || '/' || (n + 1)"), m('assistant', "'<action>answer(' || states[-1] || ')</action>'"))} AS record,
  images[1] || ',' || images[-1] || ',' || array_to_string(images[2:n + 1], ',') AS images FROM dl"""


@query("gen_multi_turn", ctes(*B, _dialogue(None)) + DSEL)
def _(spark, d):
    return flat(op.gen_multi_turn(annotated(spark, d)[2]))


@query("gen_multi_turn_mix", ctes(*B, _dialogue("mix")) + DSEL)
def _(spark, d):
    return flat(op.gen_multi_turn(annotated(spark, d)[2], mcq_share=0.5, seed="mix"))


@query("gen_multi_turn_mcq", ctes(*B, NEGA, f"mq AS (SELECT aw.*, negs FROM aw JOIN na USING (scene_id, walk) WHERE {ENDS})", options("mq", "cat", "na")) + f"""
SELECT scene_id, walk, {rec(sysm('multi_turn_mcq'), m('user', "'From <image> to <image>: which sequence?' || chr(10) || " + LET), m('assistant', ANS))} AS record, images[1] || ',' || images[-1] AS images FROM op""")
def _(spark, d):
    return flat(op.gen_multi_turn_mcq(annotated(spark, d)[2], "na"))


@query("gen_view_difference", ctes(*B, SUB) + f"""SELECT scene_id, walk, n_steps, {rec(sysm('view_difference'), m('user', "'How many actions from <image> to <image>?'"), m('assistant', "'<action>answer(' || n_steps || ')</action>'"))} AS record,
  ia || ',' || ib AS images FROM vd""")
def _(spark, d):
    return flat(op.gen_view_difference(annotated(spark, d)[2], "vd"), F.col("n_steps").cast("long").alias("n_steps"))


@query("gen_view_difference_mcq", ctes(*B, SUB, NUMS, "vn AS (SELECT vd.*, negs FROM vd JOIN nn USING (scene_id, walk))", options("vn", "CAST(n_steps AS VARCHAR)", "vd")) + f"""
SELECT scene_id, walk, n_steps, {rec(sysm('view_difference'), m('user', "'How many actions from <image> to <image>?' || chr(10) || " + LET), m('assistant', ANS))} AS record, ia || ',' || ib AS images FROM op""")
def _(spark, d):
    return flat(op.gen_view_difference_mcq(annotated(spark, d)[2], "vd"), F.col("n_steps").cast("long").alias("n_steps"))


FWD = "'You are here:' || chr(10) || states[1] || chr(10) || chr(10) || 'You will do: ' || cat"


@query("gen_forward_state", ctes(*B) + f"""SELECT scene_id, walk, {rec(sysm('forward_state'), m('user', FWD), m('assistant', "'<prediction>' || chr(10) || states[-1] || chr(10) || '</prediction>'"))} AS record, '' AS images FROM aw""")
def _(spark, d):
    return flat(op.gen_forward_state(annotated(spark, d)[2]))


@query("gen_forward_state_mcq", ctes(*B, neg_nodes("fwd", "im"), "ns AS (SELECT ng.scene_id, walk, list(state ORDER BY p) AS negs FROM (SELECT scene_id, walk, unnest(negs) AS id, generate_subscripts(negs, 1) AS p FROM ng WHERE len(negs) >= 3) ng JOIN (SELECT id, state FROM im) USING (id) GROUP BY ALL)",
                                     "fs AS (SELECT aw.*, negs FROM aw JOIN ns USING (scene_id, walk))", options("fs", "states[-1]", "fwd")) + f"""
SELECT scene_id, walk, {rec(sysm('forward_state'), m('user', FWD + " || chr(10) || chr(10) || 'Where do you end up?' || chr(10) || " + LET), m('assistant', 'letter'))} AS record, '' AS images FROM op""")
def _(spark, d):
    n, e, w = annotated(spark, d)
    return flat(op.gen_forward_state_mcq(w, n, "fwd"))


@query("gen_inverse_edge", ctes(*G, """ie AS (SELECT *, row_number() OVER (ORDER BY md5('inv|' || src || '|' || dst || '|' || action), src, dst, action) AS walk FROM edges)""") + f"""
SELECT a.scene_id, walk, {rec(sysm('inverse_edge'), m('user', "'Seen first:' || chr(10) || a.state || chr(10) || chr(10) || 'Seen then:' || chr(10) || b.state"), m('assistant', 'action'))} AS record, '' AS images
FROM ie JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE walk <= 2000""")
def _(spark, d):
    n, e = graph(spark, d)
    return flat(op.gen_inverse_edge(e, n, 2000, "inv"))


@query("gen_goal_reach", ctes(*B, """gr AS (SELECT aw.*, unnest(range(1, len(actions) + 1)) AS i FROM aw)""", """
gb AS (SELECT scene_id, walk, string_agg('user: ' || CASE WHEN i = 1 THEN 'You are here:' || chr(10) || states[1] || chr(10) || chr(10) || 'You want to be here:' || chr(10) || states[-1]
  ELSE 'You did ''' || actions[i - 1] || ''' and are here now:' || chr(10) || states[i] END || chr(10) || chr(10) || 'What do you do next?' || chr(10) || '--' || chr(10) || 'assistant: ' || actions[i], chr(10) || '--' || chr(10) ORDER BY i) AS body FROM gr GROUP BY ALL)""") + f"""
SELECT scene_id, walk, {rec(sysm('goal_reach'), 'body')} AS record, '' AS images FROM gb""")
def _(spark, d):
    return flat(op.gen_goal_reach(annotated(spark, d)[2]))


@query("filter_high_reward", f"""WITH c AS (SELECT conv_id AS rollout_id, count(*) AS n FROM conversations GROUP BY 1), x AS (SELECT *, CASE WHEN rollout_id % 3 = 0 THEN 0.1 * (rollout_id % 10) ELSE 0.1 * (rollout_id % 7) + 0.05 * n END AS reward FROM c)
SELECT rollout_id, n AS n_messages, {r('reward')} AS reward FROM x WHERE reward >= 0.5 - 1e-12 AND n >= 3""")
def _(spark, d):
    k = F.col("rollout_id")
    c = t.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("rollout_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    n = F.size("messages")
    c = c.withColumn("score", F.when(k % 3 == 0, F.round(0.1 * (k % 10), 6))).withColumn("reward_scores", F.create_map(F.lit("a"), 0.1 * (k % 7), F.lit("b"), 0.05 * n + 1e-12))
    return op.filter_high_reward(c).select("rollout_id", n.cast("long").alias("n_messages"), r6("reward").alias("reward"))
