"""Embedding near-dedup: a neighbour graph refined by NN-descent, of which the close edges are kept.

The graph starts from vectors that lie side by side in a few random sign orders.  In every round a
vector's neighbours, taken in both directions, are compared with each other, and each list keeps
the nearest found; close neighbours and others have room of their own.  Close pairs of different
components are always handed on and unite these at once, so the rounds go on until one unites
none: further close edges inside a component would change nothing.  A sample of vectors is compared
with all rows to audit the recall; more orders are drawn and refined until it suffices.  Search uses
single precision; links are counted in double precision inside the components, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.fixpoint import components
from wayfold.llm.arrays import ready
from wayfold.session import materialize

LIST, REVERSE, EACH = 10, 6, 5
ORDERS, BITS, CHUNK = 6, 16, 64
#: Share of the pairs at the threshold that all orders of an attempt may part.
MISSED = 0.1
#: Attempts in a row that unite nothing although the audit fails: then there is an error, not a result.
STALLED = 16
AUDITED, RECALL, LARGE = 512, 0.98, 64
BLOCK = 256
SLACK = 1e-4


def _unit(column, kind=np.float64) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(kind)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): vectors as bytes of doubles, scaled by their largest component; x is null for those that can't be compared."""

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                ok = v is not None and len(v) > 0 and all(c is not None for c in v)
                a = np.array(v, np.float64) if ok else np.zeros(1)
                ok = ok and np.isfinite(a).all() and a.any()
                out.append((a / np.abs(a).max() if ok and not 1e-100 < np.abs(a).max() < 1e100 else a).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "x"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, x binary")


def _order_sizes(rows: int, threshold: float) -> tuple[int, int]:
    """Orders and their bits: both grow with the rows, as a pair has to agree in more bits to meet in a chunk."""
    depth = max(math.log2(max(rows, 1) / CHUNK), 1.0)
    meet = min(max(1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi, 0.5), 0.999) ** depth
    return max(ORDERS, math.ceil(math.log(MISSED) / math.log(1 - meet))), BITS + math.ceil(depth)


def _ordered(vectors: DataFrame, seed: int, orders: int, bits: int) -> DataFrame:
    """(u, v, s): the nearest of the ``CHUNK`` vectors side by side in each of the sign orders."""

    def signs(batches):
        for b in batches:
            x = _unit(b.column(1), np.float32)
            for t in range(orders):
                plane = np.random.default_rng([seed, t]).standard_normal((x.shape[1], bits)).astype(np.float32)
                key = ((x @ plane > 0) @ (1 << np.arange(bits)[::-1])).astype(np.int64) + (t << bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), b.column(1)], ["key", "id", "x"])

    def near(batches):
        for b in batches:
            for k in range(0, b.num_rows, CHUNK):
                part = b.slice(k, CHUNK)
                x, ids = _unit(part.column(2), np.float32), part.column(1).to_numpy()
                s = x @ x.T
                s[ids[:, None] == ids[None, :]] = -2
                top = np.argsort(-s, axis=1)[:, :EACH]
                u, v, s = np.repeat(ids, top.shape[1]), ids[top].reshape(-1), np.take_along_axis(s, top, 1).reshape(-1)
                ok = s > -2
                yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok]), pa.array(s[ok].astype(np.float64))], ["u", "v", "s"])

    o = vectors.mapInArrow(signs, "key long, id long, x binary")
    return o.repartitionByRange("key", F.xxhash64("id")).sortWithinPartitions("key", "id").mapInArrow(near, "u long, v long, s double")


def _best(edges: DataFrame, threshold: float) -> DataFrame:
    """The neighbours of every list: the ``LIST`` nearest close ones and the ``LIST`` nearest others."""
    e = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("new")).withColumn("close", F.col("s") >= threshold - SLACK)
    w = Window.partitionBy("u", "close").orderBy(F.desc("s"), "v")  # one list
    return e.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= LIST).select("u", "v", "s", "new")


def _joined(graph: DataFrame, vectors: DataFrame, turn: int, threshold: float) -> DataFrame:
    """(u, v, s): neighbours of one vector compared with each other: the nearest few for each, and all close ones of other components."""
    w = Window.partitionBy("u").orderBy(F.desc("new"), F.xxhash64("v", F.lit(turn)))
    forward = graph.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= LIST).select(F.col("u").alias("p"), F.col("v").alias("m"))
    picks = graph.groupBy("v").agg(*[F.min_by("u", F.xxhash64("u", F.lit(turn), F.lit(k))).alias(f"m{k}") for k in range(REVERSE)])
    back = picks.select(F.col("v").alias("p"), F.explode(F.array(*[f"m{k}" for k in range(REVERSE)])).alias("m"))
    low = graph.groupBy("u").agg(F.when(F.count(F.when(F.col("s") < threshold - SLACK, 1)) >= LIST, F.min("s")).otherwise(F.lit(-1.0)).alias("low"))
    about = vectors.join(low, vectors["id"] == low["u"], "left").select(F.col("id").alias("m"), "x", F.coalesce("low", F.lit(-1.0)).alias("low"), "component")
    group = forward.union(back).union(graph.select("u", "u")).distinct().join(about, "m").repartition("p").sortWithinPartitions("p").select("p", "m", "low", "x", "component")

    def compare(t):
        p, m, low = (t.column(k).to_numpy() for k in range(3))
        x, c = _unit(t.column(3), np.float32), t.column(4).to_numpy()
        begin = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        size = np.diff(np.append(begin, len(p)))
        most = int(size.max())
        at = begin[:, None] + np.minimum(np.arange(most), size[:, None] - 1)
        real = np.arange(most) < size[:, None]
        v = x[at]
        s = v @ v.transpose(0, 2, 1)
        s[~(real[:, :, None] & real[:, None, :])] = -2
        s[:, np.arange(most), np.arange(most)] = -2
        top = np.argsort(-s, axis=2)[:, :, :EACH]
        best = np.take_along_axis(s, top, 2)
        keep = (s >= threshold - SLACK) & (c[at][:, :, None] != c[at][:, None, :])
        np.put_along_axis(keep, top, np.take_along_axis(keep, top, 2) | (best > np.maximum(low[at], -1.5)[:, :, None]), 2)
        g, i, j = np.nonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array(m[at[g, i]]), pa.array(m[at[g, j]]), pa.array(s[g, i, j].astype(np.float64))], ["u", "v", "s"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            p = t.column(0).to_numpy()
            cut = int(np.searchsorted(p, p[-1])) if len(p) else 0  # the last group may go on in the next batch
            if cut:
                yield compare(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield compare(rest.combine_chunks())

    return group.mapInArrow(run, "u long, v long, s double")


def _exact_pairs(comp: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, links): copies in linked vectors of the same component, compared in double precision by blocks."""

    def run(key, t):
        x, ids, block, n = _unit(t.column("x")), t.column("id").to_numpy(), t.column("block").to_numpy(), t.column("n").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
        who, links = [ids[a]], [near @ n[b]]
        if i != j:
            who.append(ids[b])
            links.append(near.T @ n[a])
        return pa.table({"id": pa.array(np.concatenate(who)), "links": pa.array(np.concatenate(links).astype(np.int64))})

    size = comp.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    c = comp.join(size, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(vectors, "id")
    c = c.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    c = c.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "n", "x")
    return c.groupBy("component", "i", "j").applyInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _audit(vectors: DataFrame, named: DataFrame, threshold: float) -> float:
    """Mean share of a vector's links, found by comparing it with all rows, that end in its own component.

    Every vector with a link counts once, however many it has.  ``AUDITED`` vectors are drawn from
    all and as many from outside components of more than ``LARGE``; the lower mean counts.
    """
    size = named.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    known = vectors.select("id", "x").join(named.select("id", "component").join(size, "component"), "id", "left")
    known = materialize(known.select("id", "x", F.coalesce("component", "id").alias("component"), F.coalesce("members", F.lit(1)).alias("members")))
    draws = [d.orderBy(F.xxhash64("id", F.lit("audit"))).limit(AUDITED).toArrow().combine_chunks() for d in (known, known.filter(F.col("members") <= LARGE))]
    picked = pa.concat_tables(draws).combine_chunks()
    q, qc, qx = picked.column("id").to_numpy(), picked.column("component").to_numpy(), _unit(picked.column("x"))

    def run(batches):
        n, k = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, AUDITED):
                part = b.slice(at, AUDITED)
                near = (_unit(part.column(1)) @ qx.T >= threshold) & (part.column(0).to_numpy()[:, None] != q)
                n += near.sum(0)
                k += (near & (part.column(2).to_numpy()[:, None] == qc)).sum(0)
        j = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(n[j]), pa.array(k[j])], ["j", "n", "k"])

    t = known.select("id", "x", "component").mapInArrow(run, "j long, n long, k long").groupBy("j").agg((F.sum("k") / F.sum("n")).alias("share")).toArrow()
    j, share = t.column("j").to_numpy(), t.column("share").to_numpy()
    return min((float(x.mean()) for x in (share[j < draws[0].num_rows], share[j >= draws[0].num_rows]) if len(x)), default=1.0)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, recall) of every row: links are pairs with a cosine of ``threshold`` or more.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are
    their own component, as are rows without an id.  Equal vectors are searched once and linked
    with each other.  If the audit can't be met, there is an error instead of a result.  Vectors must have one length.  ``recall`` is the audited mean.
    """
    spark = ready(df.sparkSession)
    every = materialize(valid_vectors(df, id_col, vector_col))
    groups = materialize(every.filter("x IS NOT NULL AND id IS NOT NULL").groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    vectors = groups.select("id", "x", "n").dropDuplicates(["id"])
    vectors = materialize(vectors)
    orders, bits = _order_sizes(vectors.count(), threshold)
    every_component = materialize(vectors.select("id", F.col("id").alias("component")))
    graph, comp, recall, attempt, turn, stalled = None, None, 0.0, 0, 0, 0
    while recall < RECALL:
        found, united = materialize(_ordered(vectors.select("id", "x"), attempt, orders, bits).withColumn("new", F.lit(True))), False
        every_component, moved = _united(every_component, found, vectors, threshold)
        while True:
            united |= moved
            graph = materialize(_best(found if graph is None else graph.withColumn("new", F.lit(False)).unionByName(found), threshold))
            found = materialize(_joined(graph, vectors.select("id", "x").join(every_component, "id"), turn, threshold).withColumn("new", F.lit(True)))
            every_component, moved = _united(every_component, found, vectors, threshold)
            turn += 1
            if not moved:
                break
        comp = every_component.join(every_component.groupBy("component").count().filter("count > 1").select("component"), "component").select("id", "component")
        recall = _audit(vectors, comp, threshold)
        attempt, stalled = attempt + 1, 0 if united else stalled + 1
        if recall < RECALL and stalled >= STALLED:
            raise RuntimeError(f"{STALLED} attempts in a row found no further links, but the audited recall is {recall:.3f}")
    links = _exact_pairs(comp, vectors, threshold)
    about = groups.join(comp, "id", "left").join(links, "id", "left").select(F.col("x").alias("gx"), F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    r = every.join(about, (F.col("x") == F.col("gx")) & F.col("id").isNotNull(), "left")
    return r.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.lit(recall).alias("recall"))


def _united(named: DataFrame, found: DataFrame, vectors: DataFrame, threshold: float) -> tuple[DataFrame, bool]:
    """The components (id, component) after the close edges found, and whether any were united."""
    close = found.filter(F.col("s") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    across = close.join(named.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(named.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").filter("ca <> cb")
    true = _checked(across.select("a", "b"), vectors, threshold)
    links = materialize(across.join(true, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if not links.take(1):
        return named, False
    to = components(links).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return materialize(named.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))), True


def _checked(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose cosine holds in double precision."""

    def run(batches):
        for b in batches:
            keep = pa.array((_unit(b.column(2)) * _unit(b.column(3))).sum(1) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    v = vectors.select("id", "x")
    p = pairs.join(v.withColumnsRenamed({"id": "a", "x": "xa"}), "a").join(v.withColumnsRenamed({"id": "b", "x": "xb"}), "b")
    return p.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")
