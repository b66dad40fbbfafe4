"""Graph kernels and refinement against brute force on small random graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import fixpoint
from wayfold.operators import graph as g
from wayfold.sources import files

EDGE = "src string, dst string, action string, n_actions long, traj_id long, turn long"


def edge_frame(spark, rows):
    return spark.createDataFrame([(a, b, act, len(act.split("|")), i, i) for i, (a, b, act) in enumerate(rows)], EDGE)


def node_frame(spark, ids):
    return spark.createDataFrame([(i, "s", i, 0, n) for n, i in enumerate(ids)], "id string, scene_id string, state string, traj_id long, turn long")


def random_edges(seed, n=14, m=20):
    rnd = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(n)]
    pairs = {(a, b) for a, b in ((rnd.choice(ids), rnd.choice(ids)) for _ in range(m)) if a != b}
    return ids, [(a, b, " | ".join(rnd.choice("xyz") for _ in range(rnd.randint(1, 4)))) for a, b in sorted(pairs)]


def reach(ids, pairs):
    r = {i: {i} for i in ids}
    for _ in ids:
        for a, b in pairs:
            for i in ids:
                if a in r[i]:
                    r[i].add(b)
    return r


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_and_strong_components(spark, seed):
    ids, rows = random_edges(seed)
    pairs = [(a, b) for a, b, _ in rows]
    und = reach(ids, pairs + [(b, a) for a, b in pairs])
    got = {r.id: r.component for r in g.connected_components(node_frame(spark, ids), edge_frame(spark, rows)).collect()}
    assert got == {i: min(und[i]) for i in ids}
    fwd = reach(ids, pairs)
    got = {r.id: r.scc for r in fixpoint.strong_components(node_frame(spark, ids), edge_frame(spark, rows)).collect()}
    assert got == {i: min(j for j in ids if j in fwd[i] and i in fwd[j]) for i in ids}


def test_hub_and_chain_components(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("h000", f"h{i:03d}") for i in range(1, 300)]
    got = {r.id: r.component for r in fixpoint.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert set(got.values()) == {"c000", "h000"} and len(got) == 61 + 300


def distances(ids, edges):
    inf = float("inf")
    d = {(a, b): (0 if a == b else inf) for a in ids for b in ids}
    for a, b, c in edges:
        d[a, b] = min(d[a, b], c)
    for k, a, b in itertools.product(ids, ids, ids):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_redundant_edges_keep_all_distances(spark, seed):
    ids, rows = random_edges(seed, 9, 34)
    cost = [(a, b, len(x.split("|"))) for a, b, x in rows]
    kept = [(r.src, r.dst, r.n_actions) for r in g.drop_redundant_edges(edge_frame(spark, rows)).collect()]
    assert distances(ids, kept) == distances(ids, cost)
    for e in kept:  # nothing that remains could still go
        rest = distances(ids, [x for x in kept if x != e])
        assert rest[e[0], e[1]] > e[2]


def closure(edges):
    """Union-find version of the two congruence rules."""
    rep = {}

    def find(x):
        while rep.setdefault(x, x) != x:
            x = rep[x]
        return x
    for a, b, _ in edges:
        find(a), find(b)
    changed = True
    while changed:
        changed = False
        for (a, b, x), (c, d, y) in itertools.combinations(edges, 2):
            if x != y:
                continue
            for same, p, q in ((find(a) == find(c), b, d), (find(b) == find(d), a, c)):
                if same and find(p) != find(q):
                    lo, hi = sorted((find(p), find(q)))
                    rep[hi] = lo
                    changed = True
    return {i: find(i) for i in rep}


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_congruence_merge(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(20)] + [f"~v{i:02d}" for i in range(8)]
    rows = [(rnd.choice(ids), rnd.choice(ids), rnd.choice("abcdefgh")) for _ in range(26)]
    names, edges = g.congruence_merge(edge_frame(spark, rows))
    want = closure(rows)
    assert {r.id: r.rep for r in names.collect()} == want
    assert {(r.src, r.dst, r.action) for r in edges.collect()} == {(want[a], want[b], x) for a, b, x in rows if want[a] != want[b]}


def test_split_and_collapse_restore_edges(spark):
    rows = [("a", "b", "x | y | z"), ("b", "c", "x"), ("a", "c", "y | x")]
    parts = g.split_action_edges(edge_frame(spark, rows))
    assert parts.count() == 6 and parts.filter(F.col("action").contains("|")).count() == 0
    back = {(r.src, r.dst, r.action, r.n_actions) for r in g.collapse_virtual_nodes(parts).collect()}
    assert back == {("a", "b", "x | y | z", 3), ("b", "c", "x", 1), ("a", "c", "y | x", 2)}


def test_collapse_handles_branches_cycles_and_shorter_wins(spark):
    rows = [("a", "~1", "x"), ("~1", "~2", "y"), ("~2", "~1", "z"), ("~2", "b", "w"), ("~1", "c", "v"), ("a", "b", "d | e | f | g"), ("a", "c", "k")]
    got = {(r.src, r.dst, r.action) for r in g.collapse_virtual_nodes(edge_frame(spark, rows)).collect()}
    assert got == {("a", "b", "x | y | w"), ("a", "c", "k")}


def test_shorter_wins_and_first_writer(spark):
    e = edge_frame(spark, [("a", "b", "x | y"), ("a", "b", "z"), ("a", "b", "w")])
    assert [(r.action, r.traj_id) for r in g.edges_shorter_wins(e).collect()] == [("z", 1)]
    assert g.dedup_edges(e).count() == 3


def test_merge_is_idempotent(spark):
    ids, rows = random_edges(11)
    graph = node_frame(spark, ids), g.edges_shorter_wins(edge_frame(spark, rows))
    n, e = g.merge_graphs(graph, graph)
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, graph[0].collect()))
    assert sorted(map(tuple, e.collect())) == sorted(map(tuple, graph[1].collect()))


def test_tolerance_is_per_axis_and_transitive(spark):
    rows = [("a", 0.0), ("b", 0.0008), ("c", 0.0016), ("d", 0.0030)]
    df = spark.createDataFrame([(i, "s", x, 0.0, 0.0, 0.0, 0.0, 0.0) for i, x in rows] + [("e", "t", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)],
                               "id string, scene_id string, tx double, ty double, tz double, rx double, ry double, rz double")
    assert {r.id: r.rep for r in g.dedup_nodes_tolerance(df).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_tolerance_against_all_pairs(spark):
    rnd = random.Random(5)
    pts = [(f"p{i:03d}", [rnd.randint(0, 6) * 0.0005 for _ in range(6)]) for i in range(60)]
    df = spark.createDataFrame([(i, "s", *v) for i, v in pts], "id string, scene_id string, tx double, ty double, tz double, rx double, ry double, rz double")
    near = [(a, b) for (a, u), (b, v) in itertools.permutations(pts, 2) if all(abs(x - y) < 1e-3 for x, y in zip(u, v))]
    r = reach([i for i, _ in pts], near)
    assert {x.id: x.rep for x in g.dedup_nodes_tolerance(df).collect()} == {i: min(r[i]) for i, _ in pts}


def test_shortest_paths(spark):
    e = edge_frame(spark, [("a", "b", "1"), ("b", "c", "2"), ("c", "d", "3"), ("a", "c", "4"), ("d", "a", "5")])
    p = spark.createDataFrame([("p", "a", "d"), ("q", "d", "c"), ("r", "b", "b"), ("s", "a", "z")], "pair_id string, from_id string, to_id string")
    got = {r.pair_id: (r.distance, r.path, r.actions) for r in fixpoint.shortest_paths(e, p).collect()}
    assert got == {"p": (2, ["a", "c", "d"], ["4", "3"]), "q": (2, ["d", "a", "c"], ["5", "4"]), "r": (0, ["b"], []), "s": (-1, None, None)}


def test_walks_are_valid_and_distinct(spark):
    ids, rows = random_edges(12, 14, 60)
    n, e = node_frame(spark, ids), g.edges_shorter_wins(edge_frame(spark, rows))
    have = {(r.src, r.dst): r.action for r in e.collect()}
    walks = g.sample_walks(n, e, 2, 4, 15, 4, "w").collect()
    assert 0 < len(walks) <= 15 and len({tuple(w.actions) for w in walks}) == len(walks)
    for w in walks:
        assert len(set(w.nodes)) == len(w.nodes) and 2 <= len(w.actions) <= 4
        assert [have[a, b] for a, b in zip(w.nodes, w.nodes[1:])] == w.actions


def test_diameter_of_small_components(spark):
    e = edge_frame(spark, [("a", "b", "x"), ("b", "c", "x"), ("x", "y", "x")])
    n = node_frame(spark, ["a", "b", "c", "x", "y", "z"])
    assert {r.component: r.diameter for r in g.graph_diameter(n, e).collect()} == {"a": 2, "x": 1, "z": 0}


def test_diameter_of_a_large_component(spark):
    """A star of paths: 6,001 nodes, known diameter, beside a cycle whose nodes are all alike."""
    arms, long = 1000, 6
    rows = [("c" if k == 0 else f"a{i:04d}_{k}", f"a{i:04d}_{k + 1}", "x") for i in range(arms) for k in range(long)]
    rows += [(f"z{i:02d}", f"z{(i + 1) % 9:02d}", "x") for i in range(9)]
    e = edge_frame(spark, rows)
    n = node_frame(spark, sorted({x for r in rows for x in r[:2]}))
    got = {r.component: (r.n_nodes, r.diameter) for r in g.graph_diameter(n, e).collect()}
    assert got == {"a0000_1": (arms * long + 1, 2 * long), "z00": (9, 4)}


def counted(monkeypatch, *modules):
    """Rows of every table that these modules write to the scratch folder."""
    rows = []
    for m in modules:
        def write(df, kept=m.materialize):
            out = kept(df)
            rows.append(out.count())
            return out
        monkeypatch.setattr(m, "materialize", write)
    return rows


def test_diameter_carries_many_searches_in_a_row(spark, monkeypatch):
    ids = [f"n{i:02d}" for i in range(40)]
    e = edge_frame(spark, [(a, b, "x") for i, a in enumerate(ids) for b in ids[i + 1:]])
    rows = counted(monkeypatch, g)
    assert [(r.n_nodes, r.diameter) for r in g.graph_diameter(node_frame(spark, ids), e).collect()] == [(40, 1)]
    assert sum(rows) < 3000  # a row per search and node made 1,600 a copy, several times


def test_links_shrink_by_rounds(spark, monkeypatch):
    """Regions, components and merges share this step; integers and texts name a component by its smallest id."""
    n = 400
    rows = counted(monkeypatch, fixpoint)
    path = [(i * 7 % n, (i + 1) * 7 % n) for i in range(n - 1)]
    got = fixpoint.components(spark.createDataFrame(path + [(1000, 1000), (1003, 1001)], "a long, b long")).collect()
    assert {(r.id, r.component) for r in got} == {(i, 0) for i in range(n)} | {(1000, 1000), (1001, 1001), (1003, 1001)}
    assert sum(rows) < 6 * n
    text = spark.createDataFrame([("b", "c"), ("c", "~a"), ("10", "9"), ("x", "x")], "a string, b string")
    assert {(r.id, r.component) for r in fixpoint.components(text).collect()} == {("b", "b"), ("c", "b"), ("~a", "b"), ("10", "10"), ("9", "10"), ("x", "x")}


def test_grid_regions_of_wide_and_negative_coordinates(spark):
    cells = [("a", 100, 5), ("a", 10, 5), ("a", 101, 5), ("a", -3, 0), ("a", -30, 0), ("a", -2, 0)]
    got = {r.id: r.region for r in g.grid_regions(spark.createDataFrame(cells, "grp string, x int, y int")).collect()}
    assert len(got) == 6 and got["a:100:5"] == got["a:101:5"] != got["a:10:5"] and got["a:-3:0"] == got["a:-2:0"] != got["a:-30:0"]


def test_poses_are_numbered_in_order_for_any_key(spark, tmp_path):
    from wayfold.sources import tables

    rows = [(1, n, p, 1, 1.0 * n, "1995-01-01", 1.0, 0.0, 0.0) for n, p in ((1, 5_000_000_000), (2, 10), (3, 10))]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string, l_quantity double, l_tax double, l_discount double")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.ty: r.turn for r in tables.poses(spark, str(tmp_path)).collect()}
    assert got == {0.0001: 0, 0.0002: 1, 0.0003: 2}


def test_save_and_load_merge(spark, tmp_path):
    path = str(tmp_path / "g")
    n = node_frame(spark, ["a", "b"])
    files.save_graph(n, edge_frame(spark, [("a", "b", "x | y")]), path)
    files.save_graph(n.withColumn("state", F.lit("new")), edge_frame(spark, [("a", "b", "z")]), path)
    nodes, edges = files.load_graph(spark, path)
    assert {r.state for r in nodes.collect()} == {"a", "b"} and [r.action for r in edges.collect()] == ["z"]


def test_pose_nodes(spark):
    schema = "traj_id long, turn long, scene_id string, tx double, ty double, tz double, rx double, ry double, rz double"
    rows = [(2, 0, "s", 1.00004, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 3, "s", 1.00001, -0.00001, 0.0, 0.0, 0.0, 0.0), (1, 4, "s", 1.0001, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 5, "t", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 6, "s", None, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = g.dedup_nodes_pose(spark.createDataFrame(rows, schema)).orderBy("scene_id", "state").collect()
    assert [(r.scene_id, r.traj_id, r.turn, r.tx) for r in got] == [("s", 1, 3, 1.00001), ("s", 1, 4, 1.0001), ("t", 1, 5, 1.0)]
    assert got[0].state == "1.0000_0.0000_0.0000_0.0000_0.0000_0.0000" and len({r.id for r in got}) == 3


def test_tolerance_in_several_scenes_with_gaps(spark):
    rnd = random.Random(7)
    pts = [(f"p{i:03d}", f"s{i % 3}", [rnd.choice([-4.0, -0.0011, -0.0003, 0.0, 0.0008, 0.0021]), rnd.randint(-3, 3) * 0.0007, 1.0, rnd.choice([0.0, 0.00099]), rnd.choice([5.0, 5.0012]), -7.25]) for i in range(150)]
    df = spark.createDataFrame([(i, s, *v) for i, s, v in pts] + [("none", "s0", None, 0.0, 0.0, 0.0, 0.0, 0.0)],
                               "id string, scene_id string, tx double, ty double, tz double, rx double, ry double, rz double")
    near = [(a, b) for (a, s, u), (b, t, v) in itertools.permutations(pts, 2) if s == t and all(abs(x - y) < 1e-3 for x, y in zip(u, v))]
    r = reach([i for i, _, _ in pts], near)
    assert {x.id: x.rep for x in g.dedup_nodes_tolerance(df).collect()} == {i: min(r[i]) for i, _, _ in pts}


def test_tolerance_copies_cells_along_open_axes_only(spark):
    """A group that differs on one axis is laid out twice, not 64 times."""
    rows = [(f"p{i:02d}_{k}", "s", i * 0.0009, k * 0.5, 0.0, 0.0, 0.0, 0.0) for i in range(20) for k in range(3)]
    df = spark.createDataFrame(rows, "id string, scene_id string, tx double, ty double, tz double, rx double, ry double, rz double")
    assert {(x.id, x.rep) for x in g.dedup_nodes_tolerance(df).collect()} == {(r[0], f"p00_{r[0][-1]}") for r in rows}
    cells = df.select("scene_id", *[F.floor(F.col(a) / 1e-3).alias(f"c_{a}") for a in g.AXES], F.monotonically_increasing_id().alias("n"),
                      *[F.col(a).alias(f"{e}_{a}") for a in g.AXES for e in ("lo", "hi")])
    close, key, axes = g._within_gaps(cells, 1e-3)
    assert axes == ["tx", "ty"] and close.count() == 60 and close.select(*key).distinct().count() == 3
