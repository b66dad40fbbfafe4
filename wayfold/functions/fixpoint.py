"""Iterative graph kernels.  Each round writes its state to the scratch folder, so plans stay
short and a lost executor never costs more than one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wayfold.session import materialize


def numbered_ids(ids: DataFrame) -> DataFrame:
    """(id, n) of distinct ids: integers in the order of the ids, from one distributed sort.

    Rounds on integers move a fraction of the bytes of text ids, and the smallest number is the smallest id.
    """
    return materialize(ids.select("id").orderBy("id").withColumn("n", F.monotonically_increasing_id()))


def on_numbers(pairs: DataFrame, names: DataFrame, a: str, b: str) -> DataFrame:
    """The two id columns of ``pairs`` as their numbers; pairs with an unknown id are left out."""
    for c in (a, b):
        pairs = pairs.join(names.select(F.col("id").alias(c), F.col("n").alias("_n")), c).drop(c).withColumnRenamed("_n", c)
    return pairs


def contract(links: DataFrame) -> DataFrame:
    """(id, root) for the ids in links ``(a, b)`` between different ids; the ids of a component share one root, any of them.

    Each round every id takes the neighbour, or itself, that comes first in a random order of the round, and
    links are rewritten to those.  About half of the ids go each round whatever the shape, so all rounds
    together cost a small multiple of the first.
    """
    def undirected(e):
        return materialize(e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    e, picks = undirected(links), []
    while e.take(1):
        def first(c, salt=len(picks)):
            return F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("id"))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(first("b")).alias("w"))
        picks.append(materialize(near.select(F.col("a").alias("id"), F.least("w", first("a"))["id"].alias("root"))))
        for c in ("a", "b"):
            e = e.join(picks[-1].select(F.col("id").alias(c), "root"), c).drop(c).withColumnRenamed("root", c)
        e = undirected(e)
    if not picks:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found = picks.pop()
    while picks:
        later = found.select(F.col("id").alias("root"), F.col("root").alias("_to"))
        found = materialize(picks.pop().join(later, "root", "left").select("id", F.coalesce("_to", "root").alias("root")))
    return found


def components(links: DataFrame) -> DataFrame:
    """(id, component) for all ids in the links ``(a, b)``; a component is named by its smallest id."""
    whole = links.schema["a"].dataType == links.schema["b"].dataType == LongType()
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    names = None if whole else numbered_ids(ids.filter("id IS NOT NULL"))
    root = contract(links if whole else on_numbers(links.select("a", "b"), names, "a", "b"))
    low = root.groupBy("root").agg(F.min("id").alias("component"))
    c = root.join(low, "root").select("id", "component")
    if not whole:
        of = names.select(F.col("n").alias("component"), F.col("id").alias("_name"))
        c = c.join(of, "component").select(F.col("id").alias("n"), F.col("_name").alias("component")).join(names, "n").select("id", "component")
    return ids.join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def spread_min(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest label among all ancestors of each node (itself included), along (src, dst) edges.

    Only nodes whose label changed in the last round send it on.
    """
    state = materialize(labels)
    hot = state
    while True:
        sent = edges.join(hot.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("new"))
        hot = materialize(state.join(sent, "id").filter("new < label").select("id", F.col("new").alias("label")))
        if not hot.take(1):
            return state
        state = materialize(state.join(hot.select("id", F.col("label").alias("new")), "id", "left").select("id", F.coalesce("new", "label").alias("label")))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc): strongly connected components named by their smallest id.

    Nodes without both an incoming and an outgoing live edge are peeled off as single
    components.  The rest are coloured with the smallest ancestor; walking back from each
    colour's own node inside the colour gives that node's component, which then leaves.
    """
    names = numbered_ids(nodes.select("id").distinct())
    live = names.select(F.col("n").alias("id"))
    e = materialize(on_numbers(edges.filter("src <> dst").select("src", "dst").distinct(), names, "src", "dst"))
    done = None

    def settle(part):
        nonlocal done
        done = part if done is None else done.unionByName(part)

    def restrict(e, keep):
        k = keep.select("id")
        return e.join(k.withColumnRenamed("id", "src"), "src", "left_semi").join(k.withColumnRenamed("id", "dst"), "dst", "left_semi")

    while live.take(1):
        while True:
            inner = live.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            gone = materialize(live.join(inner, "id", "left_anti"))
            if not gone.take(1):
                break
            settle(gone.select("id", F.col("id").alias("scc")))
            live = materialize(inner)
            e = materialize(restrict(e, live))
        if not live.take(1):
            break
        colour = spread_min(live.select("id", F.col("id").alias("label")), e)
        c = colour.select(F.col("id").alias("k"), F.col("label").alias("lk"))
        inside = materialize(e.join(c, F.col("src") == F.col("k")).select("src", "dst", F.col("lk").alias("ls")).join(c, F.col("dst") == F.col("k")).filter("ls = lk").select("src", "dst"))
        found = materialize(colour.filter("id = label").select("id", F.col("label").alias("scc")))
        front = found
        while front.take(1):
            back = inside.join(front.select(F.col("id").alias("dst"), "scc"), "dst").select(F.col("src").alias("id"), "scc").distinct()
            front = materialize(back.join(found, "id", "left_anti"))
            found = materialize(found.unionByName(front))
        settle(found)
        live = materialize(live.join(found, "id", "left_anti"))
        e = materialize(restrict(e, live))
    if done is None:
        return names.select("id", F.col("id").alias("scc"))
    of = names.select(F.col("n").alias("scc"), F.col("id").alias("_name"))
    return done.withColumnRenamed("id", "n").join(of, "scc").join(names, "n").select("id", F.col("_name").alias("scc"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Unweighted directed path per pair ``(pair_id, from_id, to_id)``: distance, nodes and actions.

    Breadth-first rounds over all pairs at once; among equals the smallest node sequence wins.
    A pair leaves as soon as its target is reached; distance -1 means no path.
    """
    step = edges.groupBy("src", "dst").agg(F.min("action").alias("action"))
    front = materialize(pairs.select("pair_id", "to_id", F.col("from_id").alias("id"), F.array("from_id").alias("path"), F.array().cast("array<string>").alias("actions")))
    seen, done, hops = front.select("pair_id", "id"), front.filter("id = to_id"), 0
    while max_hops is None or hops < max_hops:
        hops += 1
        ends = done.select("pair_id")
        nxt = front.join(ends, "pair_id", "left_anti").join(step.withColumnRenamed("src", "id"), "id")
        nxt = nxt.select("pair_id", "to_id", F.col("dst").alias("id"), F.struct(F.array_append("path", F.col("dst")).alias("path"), F.array_append("actions", F.col("action")).alias("actions")).alias("w"))
        nxt = nxt.join(seen, ["pair_id", "id"], "left_anti").groupBy("pair_id", "to_id", "id").agg(F.min("w").alias("w"))
        front = materialize(nxt.select("pair_id", "to_id", "id", "w.path", "w.actions"))
        if not front.take(1):
            break
        seen = materialize(seen.unionByName(front.select("pair_id", "id")))
        done = materialize(done.unionByName(front.filter("id = to_id")))
    r = pairs.join(done.select("pair_id", "path", "actions"), "pair_id", "left")
    return r.select("pair_id", "from_id", "to_id", F.coalesce(F.size("path") - 1, F.lit(-1)).cast("long").alias("distance"), "path", "actions")
