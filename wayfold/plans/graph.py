"""Transition graph queries over the event trajectories."""

from pyspark.sql import functions as F

from wayfold.functions.stats import r6
from wayfold.functions.fixpoint import shortest_paths, strong_components
from wayfold.operators import graph as op, parsing
from wayfold.plans.catalog import ctes, query, r
from wayfold.session import materialize
from wayfold.sources import tables as t

NID = "scene_id || '_' || md5(scene_id || '|' || {})"
TR = """tr AS (SELECT a.traj_id, a.turn, a.scene_id, a.state, a.action, b.state AS next_state FROM steps a JOIN steps b ON b.traj_id = a.traj_id AND b.turn = a.turn + 1 WHERE a.action IS NOT NULL)"""
NODES = f"""nodes AS (SELECT {NID.format('state')} AS id, scene_id, state, traj_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, state ORDER BY traj_id, turn) AS rn
  FROM (SELECT scene_id, state, traj_id, turn FROM tr UNION ALL SELECT scene_id, next_state, traj_id, turn + 1 FROM tr)) WHERE rn = 1)"""
ERAW = f"""eraw AS (SELECT {NID.format('state')} AS src, {NID.format('next_state')} AS dst, action, len(string_split(action, '|')) AS n_actions, traj_id, turn FROM tr WHERE state <> next_state)"""
EDGES = """edges AS (SELECT src, dst, action, n_actions, traj_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY n_actions, traj_id, turn, action) AS rn FROM eraw) WHERE rn = 1)"""
G = (t.STEPS_SQL, TR, NODES, ERAW, EDGES)


def transitions(spark, d):
    return op.extract_transitions(t.steps_with_next(spark, d))


def graph(spark, d):
    """Nodes and shorter-wins edges, written once because the kernels read them many times."""
    tr = materialize(transitions(spark, d))
    return materialize(op.dedup_nodes_exact(tr)), materialize(op.edges_shorter_wins(op.raw_edges(tr)))


ECOLS = ["src", "dst", "action", "n_actions", "traj_id", "turn"]


@query("extract_transitions", ctes(t.STEPS_SQL, TR) + "SELECT * FROM tr")
def _(spark, d):
    return transitions(spark, d)


MSG = f"""mg AS (SELECT conv_id AS traj_id, turn AS pos, role, conv_id + turn AS z, text FROM conversations),
st AS (SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY pos) - 1 AS turn, pos, lead(pos) OVER (PARTITION BY traj_id ORDER BY pos) AS nxt,
  CASE WHEN z % 4 = 3 THEN NULL ELSE regexp_replace(regexp_replace(trim(text), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') END AS grid,
  printf('%.4f_%.4f_%.4f_%.4f_%.4f_%.4f', (z % 5)::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE, (z % 90)::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE) AS state FROM mg WHERE role = 'user' AND z % 4 < 3),
ac AS (SELECT mg.traj_id, st.turn, max_by({t.ACTIONS!r}[CAST(z % 12 AS INT) + 1], mg.pos) AS action FROM st JOIN mg ON mg.traj_id = st.traj_id AND mg.pos > st.pos AND (st.nxt IS NULL OR mg.pos < st.nxt) WHERE role = 'assistant' AND z % 5 > 0 GROUP BY ALL)"""


def _messages(spark, d):
    z = F.col("conv_id") + F.col("turn")
    pose = F.concat(F.lit("You see [tx="), (z % 5).cast("string"), F.lit(", ty=0.5, tz=0.0, rx="), (z % 90).cast("string"), F.lit("°, ry=0.0°, rz=0°] "), "text")
    user = F.when(z % 4 < 3, pose).otherwise(F.col("text"))
    act = F.concat(F.lit("<action>"), F.when(z % 5 > 0, F.element_at(F.array(*[F.lit(a) for a in t.ACTIONS]), (z % 12 + 1).cast("int"))).otherwise("answer(1)"), F.lit("</action>"))
    return t.table(spark, d, "conversations").select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("pos"), "role", F.when(F.col("role") == "user", user).otherwise(act).alias("content"), "text", z.alias("z"))


def _pose_state():
    p = [op.parsing.found(F.col("content"), parsing.POSE, i + 1).cast("double") for i in range(6)]
    return F.when(p[0].isNotNull(), F.format_string("%.4f_%.4f_%.4f_%.4f_%.4f_%.4f", *p))


@query("transition_extractor", ctes(MSG) + "SELECT traj_id, turn, state, action FROM st LEFT JOIN ac USING (traj_id, turn)")
def _(spark, d):
    return op.steps_from_messages(_messages(spark, d), _pose_state(), parsing.clean_action(F.col("content"))).select("traj_id", "turn", "state", "action")


@query("extract_transitions_pending", ctes(MSG, "s2 AS (SELECT traj_id, turn, grid AS state, action FROM st LEFT JOIN ac USING (traj_id, turn))") + """
SELECT a.traj_id, a.turn, a.state, a.action, b.state AS next_state FROM s2 a JOIN s2 b ON a.traj_id = b.traj_id AND b.turn = a.turn + 1 WHERE a.action IS NOT NULL""")
def _(spark, d):
    s = op.steps_from_messages(_messages(spark, d), F.when(F.col("z") % 4 < 3, op.tidy_grid(F.col("text"))), parsing.clean_action(F.col("content")))
    return op.extract_transitions(s.withColumn("scene_id", F.lit("text"))).drop("scene_id")


@query("dedup_nodes_exact", ctes(*G) + "SELECT *, substr(sha256(state), 1, 16) AS state_key FROM nodes")
def _(spark, d):
    return op.dedup_nodes_exact(transitions(spark, d)).withColumn("state_key", op.state_key(F.col("state")))


_POSE_KEY = " || '_' || ".join(f"printf('%.4f', round(CAST({c} AS DECIMAL(18,8)), 4)::DOUBLE + 0.0)" for c in ("tx", "ty", "tz", "rx", "ry", "rz"))


@query("dedup_nodes_pose", ctes(t.POSES_SQL, f"k AS (SELECT *, {_POSE_KEY} AS state FROM poses)") + """
SELECT scene_id || '_' || md5(scene_id || '|' || state) AS id, scene_id, state, traj_id, turn, tx, ty, tz, rx, ry, rz FROM k QUALIFY row_number() OVER (PARTITION BY scene_id, state ORDER BY traj_id, turn) = 1""")
def _(spark, d):
    return op.dedup_nodes_pose(t.poses(spark, d))


@query("dedup_edges", ctes(*G) + "SELECT src, dst, action, n_actions, traj_id, turn FROM eraw QUALIFY row_number() OVER (PARTITION BY src, dst, action ORDER BY traj_id, turn) = 1")
def _(spark, d):
    return op.dedup_edges(op.raw_edges(transitions(spark, d)))


@query("edges_shorter_wins", ctes(*G) + "SELECT * FROM edges")
def _(spark, d):
    return op.edges_shorter_wins(op.raw_edges(transitions(spark, d))).select(*ECOLS)


@query("merge_graphs", ctes(*G) + "SELECT src, dst, action, n_actions FROM eraw QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY n_actions, CASE WHEN turn < 20 THEN 0 ELSE 1 END, traj_id, turn, action) = 1")
def _(spark, d):
    tr = materialize(transitions(spark, d))
    parts = [tr.filter("turn < 20"), tr.filter("turn >= 20")]
    old, new = [(op.dedup_nodes_exact(x), op.edges_shorter_wins(op.raw_edges(x))) for x in parts]
    return op.merge_graphs(old, new)[1].select("src", "dst", "action", "n_actions")


PNODES = """pn AS (SELECT DISTINCT l_orderkey // 2000 AS scene_id, floor(l_quantity / 10) AS tx, l_tax * 0.08 AS ty, l_discount * 0.13 AS tz, 0.0::DOUBLE AS rx, 0.0::DOUBLE AS ry, 10.0::DOUBLE AS rz FROM lineitem),
pk AS (SELECT scene_id, tx, ty, tz, printf('%d_%.4f_%.4f_%.4f', scene_id, tx, ty, tz) AS id FROM pn),
lk AS (SELECT a.id AS a, b.id AS b FROM pk a JOIN pk b ON a.scene_id = b.scene_id AND abs(a.tx - b.tx) < 1e-3 AND abs(a.ty - b.ty) < 1e-3 AND abs(a.tz - b.tz) < 1e-3),
cc(id, r) AS (SELECT a, b FROM lk UNION SELECT cc.id, lk.b FROM cc JOIN lk ON lk.a = cc.r)"""


@query("dedup_nodes_tolerance", ctes(PNODES) + "SELECT id, min(r) AS rep FROM cc GROUP BY 1")
def _(spark, d):
    li = t.table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 2000).alias("scene_id"), F.floor(F.col("l_quantity") / 10).cast("double").alias("tx"), (F.col("l_tax") * 0.08).alias("ty"),
                                              (F.col("l_discount") * 0.13).alias("tz"), F.lit(0.0).alias("rx"), F.lit(0.0).alias("ry"), F.lit(10.0).alias("rz"))
    return op.dedup_nodes_tolerance(li.withColumn("id", F.format_string("%d_%.4f_%.4f_%.4f", "scene_id", "tx", "ty", "tz")))


PIX = """px AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(least(greatest(x::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN 20 ELSE 900 END + CASE WHEN vec_id % 4 = 1 THEN 400 ELSE 128 END, 0), 255)) AS INT)) AS p FROM embeddings),
ok AS (SELECT vec_id FROM px WHERE sqrt(list_aggregate(list_transform(p, lambda x: pow(x - list_avg(p), 2)), 'avg')) >= 10 AND len(list_filter(p, lambda x: abs(x - 255) <= 5)) / len(p) <= 0.7)"""


@query("filter_low_quality_nodes", ctes(PIX) + """SELECT a.vec_id AS src, b.vec_id AS dst FROM ok a JOIN ok b ON b.vec_id = a.vec_id + 1""")
def _(spark, d):
    v = F.col("vec_id")
    gain, base = F.when(v % 3 == 0, 20).otherwise(900), F.when(v % 4 == 1, 400).otherwise(128)
    e = t.table(spark, d, "embeddings")
    n = e.select(v.alias("id"), F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * gain + base, F.lit(0)), F.lit(255))).cast("int")).alias("pixels"))
    return op.filter_low_quality_nodes(n, e.select(v.alias("src"), (v + 1).alias("dst")))[1].select("src", "dst")


@query("split_action_edges", ctes(*G, "sp AS (SELECT src, dst, list_transform(string_split(action, '|'), lambda a: trim(a)) AS a, '~' || md5(src || '|' || dst || '|' || action) || '_' AS base FROM edges)",
                                  "x AS (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM sp)") + """
SELECT DISTINCT CASE WHEN i = 1 THEN src ELSE base || (i - 1) END AS src, CASE WHEN i = len(a) THEN dst ELSE base || i END AS dst, a[i] AS action FROM x""")
def _(spark, d):
    return op.split_action_edges(op.edges_shorter_wins(op.raw_edges(transitions(spark, d))))


def world_edges(spark, d):
    """Edges of a regular world per scene: an action always moves a node by its own stride."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kinds = ["click", "view", "purchase", "signup", "error"]
    i = F.array_position(F.array(*[F.lit(x) for x in kinds]), F.col("event_type")) - 1
    j = (i + F.floor(F.col("value"))) % 5
    stride = F.array(*[F.lit(x) for x in (1, 3, 7, 11, 20)])
    name = F.array(*[F.lit(a) for a in t.ACTIONS[:5]])
    multi = F.col("event_id") % 3 == 0

    def node(n):
        return F.concat(F.lit("scene"), F.floor(F.col("user_id") / 10).cast("string"), F.lit("_"), F.lpad(n.cast("string"), 3, "0"))
    a, b = F.get(name, i.cast("int")), F.get(name, j.cast("int"))
    to = (k + F.get(stride, i.cast("int")) + F.when(multi, F.get(stride, j.cast("int"))).otherwise(0)) % 100
    e = t.table(spark, d, "events").select(node(k).alias("src"), node(to).alias("dst"), F.when(multi, F.concat(a, F.lit(" | "), b)).otherwise(a).alias("action"), F.when(multi, 2).otherwise(1).cast("long").alias("n_actions"),
                                           F.col("user_id").alias("traj_id"), F.col("event_id").alias("turn"))
    return op.edges_shorter_wins(e.filter("src <> dst"))


@query("congruence_merge")
def _(spark, d):
    return op.congruence_merge(op.split_action_edges(world_edges(spark, d)))[0]


@query("collapse_virtual_nodes")
def _(spark, d):
    return op.collapse_virtual_nodes(op.congruence_merge(op.split_action_edges(world_edges(spark, d)))[1])


@query("drop_redundant_edges", ctes(*G) + """SELECT src, dst, action, n_actions FROM edges e WHERE n_actions = 1
UNION ALL SELECT src, dst, action, n_actions FROM edges e WHERE n_actions = 2 AND NOT EXISTS (SELECT 1 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.n_actions = 1 AND b.n_actions = 1 AND a.src = e.src AND b.dst = e.dst)""")
def _(spark, d):
    return op.drop_redundant_edges(graph(spark, d)[1])


@query("prune_multi_action", ctes(*G) + "SELECT src, dst, action FROM edges WHERE NOT contains(action, '|')")
def _(spark, d):
    return op.prune_multi_action(op.edges_shorter_wins(op.raw_edges(transitions(spark, d)))).select("src", "dst", "action")


@query("action_distribution", ctes(*G, "a AS (SELECT trim(unnest(string_split(action, '|'))) AS action FROM edges)") + "SELECT action, count(*) AS n, round(count(*) / (SELECT count(*) FROM a), 4) AS ratio FROM a GROUP BY 1")
def _(spark, d):
    return op.action_distribution(op.edges_shorter_wins(op.raw_edges(transitions(spark, d))))


CC = """und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), cc(id, r) AS (SELECT id, id FROM nodes UNION SELECT cc.id, und.b FROM cc JOIN und ON und.a = cc.r),
comp AS (SELECT id, min(r) AS component FROM cc GROUP BY 1)"""
SCC = """rc(a, b) AS (SELECT id, id FROM nodes UNION SELECT rc.a, e.dst FROM rc JOIN edges e ON e.src = rc.b), sc AS (SELECT x.a AS id, min(x.b) AS scc FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY 1)"""


@query("connected_components", ctes(*G, CC) + "SELECT * FROM comp")
def _(spark, d):
    return op.connected_components(*graph(spark, d))


@query("strong_components", ctes(*G, SCC) + "SELECT * FROM sc")
def _(spark, d):
    n, e = graph(spark, d)
    return strong_components(n, e)


DG = """ends AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges),
dg AS (SELECT id, CAST(coalesce(sum(i), 0) AS BIGINT) AS ind, CAST(coalesce(sum(o), 0) AS BIGINT) AS outd, CAST(coalesce(sum(i + o), 0) AS BIGINT) AS deg FROM nodes LEFT JOIN ends USING (id) GROUP BY id)"""


@query("degree_stats", ctes(*G, DG) + """SELECT count(*) AS n_nodes, CAST(sum(outd) AS BIGINT) AS n_edges, round(avg(deg), 2) AS avg_degree, max(deg) AS max_degree, max(ind) AS max_in_degree, max(outd) AS max_out_degree,
  count(*) FILTER (WHERE deg = 0) AS isolated, count(*) FILTER (WHERE deg = 1) AS leaves, count(*) FILTER (WHERE ind = 0 AND outd > 0) AS sources, count(*) FILTER (WHERE outd = 0 AND ind > 0) AS sinks FROM dg""")
def _(spark, d):
    tr = transitions(spark, d)
    return op.degree_stats(op.dedup_nodes_exact(tr), op.edges_shorter_wins(op.raw_edges(tr)))


@query("degree_histogram", ctes(*G, DG, "h AS (SELECT 'total' AS kind, deg AS value FROM dg UNION ALL SELECT 'in', ind FROM dg WHERE ind > 0 UNION ALL SELECT 'out', outd FROM dg WHERE outd > 0)") + """
SELECT kind, value, count(*) AS n FROM h GROUP BY kind, value QUALIFY row_number() OVER (PARTITION BY kind ORDER BY value) <= 30""")
def _(spark, d):
    tr = transitions(spark, d)
    return op.degree_histogram(op.dedup_nodes_exact(tr), op.edges_shorter_wins(op.raw_edges(tr)))


TAB = """n AS (SELECT {l} AS label, count(*) AS n_nodes FROM {t} GROUP BY 1), ie AS (SELECT a.{l} AS label, count(*) AS n_edges FROM edges JOIN {t} a ON a.id = src JOIN {t} b ON b.id = dst WHERE a.{l} = b.{l} GROUP BY 1)"""
TSEL = "SELECT label, n_nodes, coalesce(n_edges, 0) AS n_edges, round(2 * coalesce(n_edges, 0) / n_nodes, 2) AS avg_degree FROM n LEFT JOIN ie USING (label)"


@query("component_table", ctes(*G, CC, TAB.format(l="component", t="comp")) + TSEL)
def _(spark, d):
    n, e = graph(spark, d)
    return op.component_table(materialize(op.connected_components(n, e)), e, "component").withColumnRenamed("component", "label")


@query("scc_table", ctes(*G, SCC, TAB.format(l="scc", t="sc")) + TSEL + " WHERE n_nodes >= 2")
def _(spark, d):
    n, e = graph(spark, d)
    return op.component_table(materialize(strong_components(n, e)), e, "scc", 2).withColumnRenamed("scc", "label")


@query("field_clusters", ctes(*G, TAB.format(l="state", t="nodes")) + TSEL)
def _(spark, d):
    n, e = graph(spark, d)
    return op.component_table(n.select("id", "state"), e, "state").withColumnRenamed("state", "label")


@query("graph_diameter", ctes(*G, CC, """bf(root, id, h) AS (SELECT id, id, 0 FROM nodes UNION SELECT bf.root, und.b, h + 1 FROM bf JOIN und ON und.a = bf.id WHERE h < 6)""", "ds AS (SELECT root, id, min(h) AS h FROM bf GROUP BY ALL)") + """
SELECT component, count(DISTINCT ds.root) AS n_nodes, CAST(max(h) AS BIGINT) AS diameter FROM ds JOIN comp ON comp.id = ds.root GROUP BY 1""")
def _(spark, d):
    return op.graph_diameter(*graph(spark, d))


@query("shortest_path", ctes(*G, "pr AS (SELECT scene_id, min(id) AS f, max(id) AS t FROM nodes GROUP BY 1)", """
pt(pair, f, t, cur, path, acts) AS (SELECT scene_id, f, t, f, [f], []::VARCHAR[] FROM pr UNION ALL
  SELECT pair, f, t, e.dst, list_append(path, e.dst), list_append(acts, e.action) FROM pt JOIN edges e ON e.src = cur WHERE cur <> t AND len(path) <= 4 AND NOT list_contains(path, e.dst))""", """
bs AS (SELECT pair, path, acts FROM pt WHERE cur = t QUALIFY row_number() OVER (PARTITION BY pair ORDER BY len(path), path) = 1)""") + """
SELECT scene_id AS pair_id, f AS from_id, t AS to_id, coalesce(len(path) - 1, -1) AS distance, array_to_string(path, '>') AS path, array_to_string(acts, '>') AS actions FROM pr LEFT JOIN bs ON pair = scene_id""")
def _(spark, d):
    n, e = graph(spark, d)
    pairs = n.groupBy(F.col("scene_id").alias("pair_id")).agg(F.min("id").alias("from_id"), F.max("id").alias("to_id"))
    p = shortest_paths(e, pairs)
    return p.select("pair_id", "from_id", "to_id", "distance", F.array_join("path", ">").alias("path"), F.array_join("actions", ">").alias("actions"))


@query("subgraph_extract", ctes(*G, DG, "top AS (SELECT id FROM dg ORDER BY deg DESC, id LIMIT 300)", "ie AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top))", """
d1 AS (SELECT id, count(src) AS deg FROM top LEFT JOIN ie ON id = src OR id = dst GROUP BY 1)""", "kp AS (SELECT id FROM d1 WHERE deg >= 8)", "i2 AS (SELECT src, dst FROM ie WHERE src IN (SELECT id FROM kp) AND dst IN (SELECT id FROM kp))", """
u2 AS (SELECT src AS a, dst AS b FROM i2 UNION SELECT dst, src FROM i2), c2(id, r) AS (SELECT id, id FROM kp UNION SELECT c2.id, u2.b FROM c2 JOIN u2 ON u2.a = c2.r)""") + """
SELECT kp.id, (SELECT count(*) FROM i2 WHERE src = kp.id OR dst = kp.id) AS degree, (SELECT min(r) FROM c2 WHERE c2.id = kp.id) AS component FROM kp""")
def _(spark, d):
    n, e = graph(spark, d)
    return op.subgraph(op.top_by_degree(n, e, 300), e, min_degree=8)[0].select("id", "degree", "component")


HITS = "hits AS (SELECT id FROM nodes WHERE contains(lower(id), 'click_1') OR contains(lower(state), 'click_1') ORDER BY id LIMIT 50)"


@query("node_search", ctes(*G, HITS) + "SELECT id FROM hits")
def _(spark, d):
    return op.node_search(op.dedup_nodes_exact(transitions(spark, d)), "Click_1", 50).select("id")


@query("node_lookup", ctes(*G, HITS) + """SELECT src AS id, 'out' AS direction, dst AS other, action FROM edges WHERE src IN (SELECT id FROM hits)
UNION ALL SELECT dst, 'in', src, action FROM edges WHERE dst IN (SELECT id FROM hits)""")
def _(spark, d):
    n, e = graph(spark, d)
    return op.node_detail(op.node_search(n, "Click_1", 50).select("id"), e)


FLD = {"state.scene_id": ("text", "scene_id"), "state.pose.tx": ("numeric", "tx"), "state.pose.ty": ("numeric", "ty"), "state.pose.zero": ("numeric", "0.0"), "extra.tag": ("text", "CAST(turn AS VARCHAR)"),
       "extra.key": ("text", "traj_id || ':' || turn"), "extra.rare": ("numeric", "CASE WHEN turn = 3 THEN tz END")}


@query("profile_fields", ctes(t.POSES_SQL) + " UNION ALL ".join(
    f"""SELECT '{p}' AS path, '{k}' AS kind, {'NULL::DOUBLE' if k == 'text' else f'min({c})'} AS lo, {'NULL::DOUBLE' if k == 'text' else f'max({c})'} AS hi, {f'count(DISTINCT {c})' if k == 'text' else 'NULL'}::BIGINT AS n_distinct FROM poses
HAVING {f'count(DISTINCT {c}) BETWEEN 2 AND 0.9 * count(*)' if k == 'text' else f'count({c}) >= 0.5 * count(*) AND max({c}) - min({c}) >= 1e-9'}""" for p, (k, c) in FLD.items()))
def _(spark, d):
    p = t.poses(spark, d)
    s = F.struct("scene_id", F.struct("tx", "ty", F.lit(0.0).alias("zero")).alias("pose")).alias("state")
    x = F.struct(F.col("turn").cast("string").alias("tag"), F.concat_ws(":", F.col("traj_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.when(F.col("turn") == 3, F.col("tz")).alias("rare")).alias("extra")
    return op.profile_fields(p.select(s, x))


def _regions(grp: str, x: str, y: str) -> str:
    return f"""WITH RECURSIVE c AS (SELECT DISTINCT {grp} AS grp, {x} AS x, {y} AS y FROM lineitem), k AS (SELECT *, grp || ':' || x || ':' || y AS id FROM c),
e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.grp = b.grp AND abs(a.x - b.x) + abs(a.y - b.y) = 1), r(id, r) AS (SELECT id, id FROM k UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.r)
SELECT id, min(r) AS region FROM r GROUP BY 1"""


@query("grid_regions", _regions("l_orderkey // 100", "l_partkey % 40", "l_suppkey % 40"))
def _(spark, d):
    c = t.table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("grp"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 40).alias("y"))
    return op.grid_regions(c)


@query("grid_regions_wide", _regions("l_orderkey // 500", "l_partkey - 100", "l_suppkey - 50"))
def _(spark, d):
    """Unreduced keys: coordinates below 0 and above 99."""
    c = t.table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 500).alias("grp"), (F.col("l_partkey") - 100).alias("x"), (F.col("l_suppkey") - 50).alias("y"))
    return op.grid_regions(c)


# --- walks ---------------------------------------------------------------------------------
SEED, MINL, MAXL, PER, TRY = "walk", 2, 4, 20, 3
WALKS = f"""nk AS (SELECT scene_id, id, row_number() OVER (PARTITION BY scene_id ORDER BY md5('{SEED}|' || id), id) AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM nodes),
ek AS (SELECT src, dst, action, row_number() OVER (PARTITION BY src ORDER BY md5('{SEED}|' || src || '|' || dst || '|' || action), src, dst, action) AS i FROM edges),
adj AS (SELECT src, list(dst ORDER BY i) AS ds, list(action ORDER BY i) AS acs FROM ek GROUP BY 1),
wk AS (SELECT scene_id, w AS walker, ('0x' || substr(md5('{SEED}|' || scene_id || '|' || w), 1, 12))::BIGINT AS h FROM (SELECT DISTINCT scene_id FROM nodes), range(1, {PER * TRY + 1}) x(w)),
w0 AS (SELECT wk.*, h // 65536 % {MAXL - MINL + 1} + {MINL} AS target, id FROM wk JOIN nk ON nk.scene_id = wk.scene_id AND nk.k = h % nk.n + 1),
wl(scene_id, walker, target, step, nodes, actions, open, ok) AS (SELECT scene_id, walker, target, 0, [id], []::VARCHAR[], true, true FROM w0 UNION ALL
  SELECT scene_id, walker, target, step + 1, CASE WHEN p IS NULL THEN nodes ELSE list_append(nodes, ds[p]) END, CASE WHEN p IS NULL THEN actions ELSE list_append(actions, acs[p]) END, p IS NOT NULL, ds IS NOT NULL FROM (
    SELECT *, fr[('0x' || substr(md5('{SEED}|' || scene_id || '|' || walker || '|' || (step + 1)), 1, 12))::BIGINT % nullif(len(fr), 0) + 1] AS p FROM (
      SELECT wl.*, ds, acs, list_filter(range(1, len(ds) + 1), lambda i: NOT list_contains(nodes, ds[i])) AS fr FROM wl LEFT JOIN adj ON adj.src = nodes[-1] WHERE open AND step < target))),
wf AS (SELECT scene_id, walker, nodes, actions FROM wl WHERE ok AND len(actions) >= {MINL} AND (NOT open OR step = target)),
wd AS (SELECT *, row_number() OVER (PARTITION BY scene_id, actions ORDER BY walker) AS dup FROM wf),
walks AS (SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY walker) AS walk, nodes, actions FROM wd WHERE dup = 1 QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY walker) <= {PER})"""


def walks(spark, d):
    n, e = graph(spark, d)
    return n, e, materialize(op.sample_walks(n, e, MINL, MAXL, PER, TRY, SEED))


@query("sample_walks", ctes(*G, WALKS) + "SELECT scene_id, walk, array_to_string(nodes, '>') AS nodes, array_to_string(actions, '>') AS actions FROM walks")
def _(spark, d):
    w = walks(spark, d)[2]
    return w.select("scene_id", "walk", F.array_join("nodes", ">").alias("nodes"), F.array_join("actions", ">").alias("actions"))
