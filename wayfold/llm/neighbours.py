"""Approximate nearest neighbours by inner product: a graph made by NN-descent, searched greedily.

Equal vectors are one node.  A node is its vector divided by the largest length and completed to
length one by a further component, so that a larger inner product with a query means a nearer node.
The graph starts from nodes side by side in a few random sign orders.  Rounds join each node's
neighbours with each other, pairs with a new neighbour only, and every list keeps its nearest, until
hardly any list changes.  Queries, all at once, hold the best nodes met; each round they expand the
best of these that are not expanded yet and look at all their neighbours, until none is left.  Queries
that lie close together form a block and share what they meet, so a vector is sent and a list followed
once a block and not once a query.

A bounded sample of queries is compared with all nodes.  While its recall is too low, the search goes
on with a wider beam, every other time on a graph refined with longer lists.  Graph and search use half
precision; what a query holds in the end is compared in double precision on the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.ordering import ranked
from wayfold.llm.arrays import broadcast_if_small, ready
from wayfold.llm.vectors import dimension, gathered, matrix, narrowed, one_an_id, packed, unpacked
from wayfold.session import materialize

#: Length of the lists, and how many further nodes that list a node count as its neighbours.
LIST, BACK = 40, 10
#: Old and new neighbours of a node, and nodes that list it, joined in one round; the best each of these may hand on.
NEW, OLD, LISTED_BY, EACH = 20, 10, 10, 5
#: Sign orders of an attempt, nodes compared side by side in them, and those kept of each.
ORDERS, CHUNK, SIDE = 6, 256, 8
#: Rounds end when fewer than this share of all list entries is new.
STILL = 0.05
BEAM, EXPANDED, ENTRIES = 96, 48, 64
#: Blocks that the queries are dealt into, while one has no fewer queries than ``LEAST`` and no more than ``MOST``.
BLOCKS, LEAST, MOST = 16, 64, 1024
AUDITED, RECALL = 128, 0.95
#: Attempts in a row that leave the recall as it was: then there is an error, not a result.
STALLED = 4


def _valid(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x): one row for each id that takes part, as bytes of doubles, and the length of the vectors."""
    rows = narrowed(df, id_col, vector_col).filter("id IS NOT NULL")
    d = dimension(rows)

    def run(batches):
        for b in batches:
            x, ok = matrix(b.column(1), d)
            ok &= x.any(1) & (np.abs(x) < 1e100).all(1) & (np.abs(x).max(1, initial=0) > 1e-100)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), packed(x[ok] + 0.0)], ["id", "x"])

    return one_an_id(materialize(rows.mapInArrow(run, "id long, x binary")), "x"), d


def _nodes(valid: DataFrame, d: int) -> DataFrame:
    """(node, x, a): every distinct vector under its smallest id, and its unit form in half precision."""
    distinct = materialize(valid.groupBy("x").agg(F.min("id").alias("node")))

    def longest(batches):
        for b in batches:
            x = unpacked(b.column(0), np.float64, d)
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(1)).max(initial=0))])], ["n"])

    top = distinct.select("x").mapInArrow(longest, "n double").agg(F.max("n")).first()[0] or 1.0

    def unit(batches):
        for b in batches:
            x = unpacked(b.column(1), np.float64, d) / top
            a = np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, packed(a.astype(np.float16))], ["node", "x", "a"])

    return materialize(distinct.select("node", "x").mapInArrow(unit, "node long, x binary, a binary"))


def _sides(nodes: DataFrame, d: int, seed: int, n: int) -> DataFrame:
    """(u, v, s): the nearest of the ``CHUNK`` nodes side by side in each of the sign orders."""
    bits = min(20, max(4, math.ceil(math.log2(max(n, 2) / CHUNK)) + 8))

    def signs(batches):
        for b in batches:
            a = unpacked(b.column(1), np.float16, d + 1).astype(np.float32)
            for t in range(ORDERS):
                plane = np.random.default_rng([seed, t]).standard_normal((d + 1, bits)).astype(np.float32)
                key = ((a @ plane > 0) @ (1 << np.arange(bits)[::-1])).astype(np.int64) + (t << bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], ["key", "node", "a"])

    def near(batches):
        for b in gathered(batches, CHUNK):
            a, node = unpacked(b.column(2), np.float16, d + 1).astype(np.float32), b.column(1).to_numpy()
            s = a @ a.T
            s[node[:, None] == node] = -2
            top = np.argsort(-s, axis=1)[:, :SIDE]
            u, v, s = np.repeat(node, top.shape[1]), node[top].reshape(-1), np.take_along_axis(s, top, 1).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(c[s > -2]) for c in (u, v, s)], ["u", "v", "s"])

    o = nodes.select("node", "a").mapInArrow(signs, "key long, node long, a binary")
    return o.repartitionByRange("key", F.xxhash64("node")).sortWithinPartitions("key", "node").mapInArrow(near, "u long, v long, s float")


def _nearest(edges: DataFrame, most: int) -> DataFrame:
    """Each list's ``most`` nearest; an edge known before stays as new or old as it was."""
    e = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min_by("new", "fresh").alias("new"), F.min("fresh").alias("fresh"))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).filter(F.col("r") <= most).drop("r")


def _joined(graph: DataFrame, nodes: DataFrame, d: int, most: int) -> DataFrame:
    """(u, v, s): neighbours of a node compared with each other, where this can enter a list."""
    low = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= most, F.min("s")).otherwise(F.lit(-2.0)).alias("low"))
    about = nodes.select(F.col("node").alias("m"), "a").join(low.withColumnRenamed("u", "m"), "m", "left").select("m", "a", F.coalesce("low", F.lit(-2.0)).cast("float").alias("low"))
    back = graph.withColumn("k", F.row_number().over(Window.partitionBy("v", "new").orderBy(F.xxhash64("u", "s")))).filter(F.col("k") <= LISTED_BY)
    group = graph.filter("picked").select(F.col("u").alias("p"), F.col("v").alias("m"), "new").union(back.select("v", "u", "new"))
    group = group.groupBy("p", "m").agg(F.max("new").alias("new")).join(about, "m").repartition("p").sortWithinPartitions("p", "m").select("p", "m", "new", "low", "a")

    def compare(t):
        p, m, new, low = (t.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        a = unpacked(t.column(4), np.float16, d + 1).astype(np.float32)
        begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        size = np.diff(np.append(begin, len(p)))
        most_m = int(size.max())
        at = begin[:, None] + np.minimum(np.arange(most_m), size[:, None] - 1)
        real = np.arange(most_m) < size[:, None]
        s = a[at] @ a[at].transpose(0, 2, 1)
        s[~(real[:, :, None] & real[:, None, :] & (new[at][:, :, None] | new[at][:, None, :]))] = -2
        s[:, np.arange(most_m), np.arange(most_m)] = -2
        top = np.argpartition(-s, min(EACH, most_m - 1), axis=2)[:, :, :EACH]
        best = np.take_along_axis(s, top, 2)
        g, i, j = np.nonzero(best > np.maximum(low[at], -1.5)[:, :, None])
        return pa.RecordBatch.from_arrays([pa.array(m[at[g, i]]), pa.array(m[at[g, top[g, i, j]]]), pa.array(best[g, i, j])], ["u", "v", "s"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            p = t.column(0).to_numpy()
            cut = int(np.searchsorted(p, p[-1])) if len(p) else 0  # the last group may go on in the next batch
            if cut:
                yield compare(t.slice(0, cut).combine_chunks().to_batches()[0])
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield compare(rest.combine_chunks().to_batches()[0])

    return group.mapInArrow(run, "u long, v long, s float")


def descend(nodes: DataFrame, d: int, n: int, graph: DataFrame | None, seed: int, most: int) -> DataFrame:
    """(u, v, s, new): ``graph``, if there is one, after a fresh start and rounds of joins until hardly any list changes."""
    start = _sides(nodes, d, seed, n).withColumn("new", F.lit(True)).withColumn("fresh", F.lit(True))
    if graph is not None:
        start = start.unionByName(graph.withColumn("fresh", F.lit(False)))
    hit = Window.partitionBy("u", "new").orderBy(F.desc("s"), "v")
    graph = start
    while True:
        picked = F.row_number().over(hit) <= F.when(F.col("new"), NEW).otherwise(OLD)
        graph = materialize(_nearest(graph, most).withColumn("picked", picked))
        changed, entries = graph.agg(F.count(F.when(F.col("fresh"), 1)), F.count(F.lit(1))).first()
        if changed <= STILL * entries:
            return graph.select("u", "v", "s", "new")
        found = _joined(graph, nodes, d, most).withColumn("new", F.lit(True)).withColumn("fresh", F.lit(True))
        known = graph.select("u", "v", "s", (F.col("new") & ~F.col("picked")).alias("new"), F.lit(False).alias("fresh"))
        graph = known.unionByName(found)


def _adjacent(graph: DataFrame) -> DataFrame:
    """(node, next): the list of a node, and the nearest nodes that list it."""
    back = graph.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))).filter(F.col("r") <= BACK)
    return materialize(graph.select(F.col("u").alias("node"), F.col("v").alias("next")).union(back.select("v", "u")).distinct())


def _blocks(queries: DataFrame, d: int) -> DataFrame:
    """(block, query, qa, node): queries side by side in a sign order share a block."""
    most = min(max(queries.count() // BLOCKS, LEAST), MOST)

    def signs(batches):
        plane = np.random.default_rng(d).standard_normal((d + 1, 16)).astype(np.float32)
        for b in batches:
            key = (unpacked(b.column(1), np.float16, d + 1).astype(np.float32) @ plane > 0) @ (1 << np.arange(16)[::-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key.astype(np.int64))], ["query", "qa", "node", "key"])

    keyed = queries.select("query", "qa", "node").mapInArrow(signs, "query long, qa binary, node long, key long")
    place = ranked(keyed, [], ["key", "query"], "rank")
    return materialize(place.select(F.floor((F.col("rank") - 1) / most).alias("block"), "query", "qa", "node"))


def _scored(met: DataFrame, blocks: DataFrame, nodes: DataFrame, d: int, beam: int) -> DataFrame:
    """(block, query, node, s): the ``beam`` best for each query among the nodes its block has ``met``.

    A block's queries come first and stay in memory; its nodes stream past, so a vector is sent once a block.
    """
    full = met.join(nodes.select("node", "a"), "node").select("block", F.lit(1).alias("kind"), F.col("node").alias("id"), "a")
    rows = blocks.select("block", F.lit(0).alias("kind"), F.col("query").alias("id"), F.col("qa").alias("a")).unionByName(full)
    rows = rows.repartition("block").sortWithinPartitions("block", "kind", "id").select("block", "kind", "id", "a")

    def run(batches):
        now, q, qa, s, n = None, None, None, None, None

        def best():
            i, j = np.nonzero(s > -2.5)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), now)), pa.array(q[i]), pa.array(n[i, j]), pa.array(s[i, j])], ["block", "query", "node", "s"])

        for b in batches:
            block, kind, ids = (b.column(k).to_numpy() for k in range(3))
            a = unpacked(b.column(3), np.float16, d + 1).astype(np.float32)
            for part in np.split(np.arange(len(block)), np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1):
                if not len(part):
                    continue
                if block[part[0]] != now:
                    if now is not None:
                        yield best()
                    now, q, qa = block[part[0]], np.zeros(0, np.int64), np.zeros((0, d + 1), np.float32)
                if kind[part[0]] == 0:
                    q, qa = np.append(q, ids[part]), np.concatenate([qa, a[part]])
                    s, n = np.full((len(q), beam), -3, np.float32), np.full((len(q), beam), -1, np.int64)
                    continue
                for t in np.split(part, range(CHUNK * 8, len(part), CHUNK * 8)):
                    s = np.concatenate([s, qa @ a[t].T], 1)
                    n = np.concatenate([n, np.broadcast_to(ids[t], (len(q), len(t)))], 1)
                    top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
                    s, n = np.take_along_axis(s, top, 1), np.take_along_axis(n, top, 1)
        if now is not None:
            yield best()

    return rows.mapInArrow(run, "block long, query long, node long, s float")


def greedy(blocks: DataFrame, adjacent: DataFrame, nodes: DataFrame, d: int, beam: int, held: DataFrame | None) -> DataFrame:
    """(block, query, node): the ``beam`` best nodes that each query meets on its way through the graph.

    The queries of a block meet what any of them meets: a node's vector is looked at once a block, and its
    list is followed once.  A block enters at what its queries ``held`` before, or else at their own
    nodes, and at the nodes of a bounded set of entries.
    """
    if held is None:
        entries = nodes.select("node").orderBy(F.xxhash64("node", F.lit("entries")), "node").limit(ENTRIES)
        of = [r["node"] for r in entries.collect()]  # ENTRIES ids
        held = blocks.select("block", F.explode(F.array_distinct(F.array("node", *map(F.lit, of)))).alias("node")).filter("node IS NOT NULL")
    met = materialize(held.select("block", "node").distinct())
    best = Window.partitionBy("query").orderBy(F.desc("s"), "node")
    now, seen, followed = None, met, None
    while True:
        new = _scored(met, blocks, nodes, d, beam)
        now = new if now is None else now.unionByName(new)
        now = materialize(now.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= beam).drop("r"))
        left = now if followed is None else now.join(followed, ["block", "node"], "left_anti")
        go = left.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= EXPANDED)
        go = materialize(go.select("block", "node").distinct())
        if not go.take(1):
            return now.select("block", "query", "node")
        followed = go if followed is None else followed.unionByName(go)
        met = go.join(adjacent, "node").select("block", F.col("next").alias("node")).distinct()
        met = materialize(met.join(seen, ["block", "node"], "left_anti"))
        seen = seen.unionByName(met)


def _truth(queries: DataFrame, nodes: DataFrame, d: int, k: int) -> DataFrame:
    """(query, node): the ``k`` nearest nodes of a bounded number of queries, each compared with all nodes."""
    t = queries.select("query", "node", "qa").toArrow()
    q, own, qa = t.column("query").to_numpy(), t.column("node").to_numpy(), unpacked(t.column("qa"), np.float16, d + 1).astype(np.float32)

    def run(batches):
        s, n = np.full((len(q), k), -3, np.float32), np.full((len(q), k), -1, np.int64)
        for b in gathered(batches, 4096):
            node = b.column(0).to_numpy()
            new = qa @ unpacked(b.column(1), np.float16, d + 1).astype(np.float32).T
            new[own[:, None] == node] = -3
            s, n = np.concatenate([s, new], 1), np.concatenate([n, np.broadcast_to(node, new.shape)], 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            s, n = np.take_along_axis(s, top, 1), np.take_along_axis(n, top, 1)
        i, j = np.nonzero(s > -2)
        yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(n[i, j]), pa.array(s[i, j])], ["query", "node", "s"])

    r = nodes.select("node", "a").mapInArrow(run, "query long, node long, s float")
    return r.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "node"))).filter(F.col("r") <= k).select("query", "node")


def _exact(held: DataFrame, nodes: DataFrame, d: int) -> DataFrame:
    """(query, node, score): inner products of the original vectors, summed in order of the components."""

    def run(batches):
        for b in batches:
            x, y = unpacked(b.column(2), np.float64, d), unpacked(b.column(3), np.float64, d)
            s = np.zeros(len(x))
            for k in range(d):
                s += x[:, k] * y[:, k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["query", "node", "score"])

    x = nodes.select("node", "x")
    full = held.join(x, "node").join(x.select(F.col("node").alias("query"), F.col("x").alias("qx")), "query")
    return full.select("query", "node", "x", "qx").mapInArrow(run, "query long, node long, score double")


def nearest_neighbours(df: DataFrame, query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
                       beam: int = BEAM, least_recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score, recall): the ``k`` other rows found with the largest inner product, ties to the smaller id.

    ``query`` is a condition on ``id``; candidates are all rows but the query's own.  ``recall`` is
    the audited mean over ``AUDITED`` queries.  Rows without an id take no part, nor those whose
    vector is null, empty, zero, holds null or non-finite components, has another length than that
    of the smallest id, or components out of 1e-100 to 1e100.  Rows of one id count once: the one
    with the smallest vector bytes.  With fewer candidates all are returned.  If the audit can't be
    met, there is an error instead of a result.
    """
    spark = ready(df.sparkSession)
    valid, d = _valid(df, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double, recall double"
    if not d or not valid.take(1):
        return spark.createDataFrame([], schema)
    nodes = _nodes(valid, d)
    n = nodes.count()
    ids = valid.join(nodes.select("x", "node"), "x").select("id", "node")
    asked = materialize(ids.filter(query))
    points = asked.select("node").distinct()

    def without_length(batches):
        for b in batches:
            a = unpacked(b.column(1), np.float16, d + 1).copy()
            a[:, d] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), packed(a), b.column(0)], ["query", "qa", "node"])

    queries = materialize(nodes.join(points, "node", "left_semi").select("node", "a").mapInArrow(without_length, "query long, qa binary, node long"))
    blocks = _blocks(queries, d)
    audited = queries.orderBy(F.xxhash64("query", F.lit("audit")), "query").limit(AUDITED)
    truth = materialize(_truth(audited, nodes, d, k))
    graph, adjacent, held, recall, attempt, most, stalled = None, None, None, -1.0, 0, LIST, 0
    while recall < least_recall:
        if stalled >= STALLED:
            raise RuntimeError(f"{STALLED} attempts in a row did not improve the audited recall of {recall:.3f}")
        if attempt % 2 == 0:  # between refinements the beam is widened alone
            graph = descend(nodes, d, n, graph, attempt, most)
            adjacent, most = _adjacent(graph), most + LIST // 2
        wide = max(beam, 2 * k + 1)
        held = greedy(blocks, adjacent, nodes, d, wide, held)
        hit = truth.join(held.withColumn("hit", F.lit(1)), ["query", "node"], "left").groupBy("query").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
        now = hit.agg(F.avg("share")).first()[0]
        now = 1.0 if now is None else now
        stalled = 0 if now > recall + 0.001 else stalled + 1
        recall, attempt, beam = now, attempt + 1, 2 * wide
    near = materialize(_exact(held.select("query", "node"), nodes, d))
    twice = ids.join(valid.groupBy("x").count().filter("count > 1").select("x").join(nodes.select("x", "node"), "x").select("node"), "node", "left_semi")
    members = twice.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("r") <= k + 1)  # no more can be among a query's k
    members = materialize(members.select("node", F.col("id").alias("vec_id")))
    near = near.join(broadcast_if_small(members, members.count()), "node", "left").select("query", F.coalesce("vec_id", "node").alias("vec_id"), "score")
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    mine = top.join(asked.select(F.col("id").alias("query_id"), F.col("node").alias("query")), "query").filter("query_id <> vec_id")
    r = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return r.select("query_id", "rank", "vec_id", "score", F.lit(recall).alias("recall"))
