"""Hard negatives: exact searches by inner product over candidate lists that anchors of one cluster share.

Anchors are clustered by direction.  For a cluster with centre c and widest angle w, no member can
reach more with a candidate than its own length times ``|x| * cos(max(0, angle(x, c) - w))``.  The
candidates sorted by that bound are the cluster's list, and every member walks it until the next
bound is below what it still needs: its k-th best score, or the least score it accepts.

The list is cut into blocks of candidates that lie together.  A block knows its largest bound for
every cluster, so rounds hand a cluster's members, in packs, to its next best blocks only while some
member is not certified yet; inside a block the candidates are sorted once for each cluster.  Scores
are exact integers.  Vectors of candidates move once, into the blocks; later only packs of anchors do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.arrays import broadcast_if_small, ready
from wayfold.llm.vectors import dimension, gathered, grid, narrowed, one_an_id, packed, unpacked
from wayfold.session import materialize

#: Anchors that the cluster centres are fitted on, and the most centres; both bound what the driver holds.
SAMPLE, CENTRES = 4096, 256
#: Anchors a cluster has on average while there are fewer centres than ``CENTRES``.
MEMBERS = 32
PACK, BLOCK, STRETCH = 256, 2048, 256
#: Blocks that a cluster's members walk in the first round; each later round reaches GROWTH times as far.
FIRST, GROWTH = 2, 4
#: Packs that one task compares with one block.
LANE = 64
LEAST, MOST = -(1 << 62), 1 << 62
SLACK = 1e-9


def _unit(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = g.astype(np.float64)
    n = np.sqrt((g * g).sum(1))
    return g / np.where(n > 0, n, 1)[:, None], n


def _codes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label`` as a long: itself, or a number of its own for each label of other types."""
    if dict(rows.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint"):
        return rows.withColumn("label", F.col("label").cast("long"))
    names = materialize(rows.select("label").filter("label IS NOT NULL").distinct().withColumn("code", F.monotonically_increasing_id()))
    return rows.join(broadcast_if_small(names, names.count()), "label").drop("label").withColumnRenamed("code", "label")


def _valid(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, label, g): one row for each id that takes part, and the length of the vectors."""
    rows = _codes(narrowed(df, id_col, vector_col, label=label_col)).filter("id IS NOT NULL AND label IS NOT NULL")
    d = dimension(rows)

    def run(batches):
        for b in batches:
            g, ok = grid(b.column(1), d, scale)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(2).filter(keep), packed(g[ok].astype(np.int32))], ["id", "label", "g"])

    valid = materialize(rows.select("id", "v", "label").mapInArrow(run, "id long, label long, g binary"))
    return one_an_id(valid, "label", "g"), d


def _fitted(anchors: DataFrame, n: int, d: int) -> np.ndarray:
    """Unit centres of about ``n / MEMBERS`` clusters, fitted on at most ``SAMPLE`` anchors chosen by hash."""
    sample = anchors.orderBy(F.xxhash64("id", F.lit("centres")), "id").limit(SAMPLE).select("g").toArrow()
    x, _ = _unit(unpacked(sample.column("g"), np.int32, d))
    c = x[:: max(1, -(-len(x) // min(CENTRES, max(1, n // MEMBERS))))].copy()
    for _ in range(5):
        near = (x @ c.T).argmax(1)
        for k in range(len(c)):
            mean = x[near == k].sum(0)
            if (size := np.sqrt((mean * mean).sum())) > 0:
                c[k] = mean / size
    return c


def _members(anchors: DataFrame, centres: np.ndarray, d: int) -> DataFrame:
    """(id, label, g, norm, cluster, angle, piece): anchors with their cluster, in pieces of about ``PACK``."""

    def run(batches):
        for b in batches:
            x, n = _unit(unpacked(b.column(2), np.int32, d))
            s = x @ centres.T
            k = s.argmax(1)
            angle = np.where(n > 0, np.arccos(np.clip(s[np.arange(len(k)), k], -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(k), pa.array(angle)], ["id", "label", "g", "norm", "cluster", "angle"])

    m = materialize(anchors.select("id", "label", "g").mapInArrow(run, "id long, label long, g binary, norm double, cluster long, angle double"))
    pieces = m.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("pieces"))
    return materialize(m.join(F.broadcast(pieces), "cluster").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces")).drop("pieces"))  # at most CENTRES rows


def _bounds(g: np.ndarray, centres: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """[row, cluster]: what a member of unit length can reach with each row at most."""
    x, n = _unit(g)
    angle = np.arccos(np.clip(x @ centres.T, -1, 1)) - widest
    return n[:, None] * (np.cos(np.clip(angle, 0, np.pi)) + SLACK)


def _blocks(valid: DataFrame, centres: np.ndarray, widest: np.ndarray, d: int) -> DataFrame:
    """(block, ids, labels, gs, top): candidates of near directions side by side, with their largest bound for each cluster."""

    def near(batches):
        for b in batches:
            x, _ = _unit(unpacked(b.column(2), np.int32, d))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x @ centres.T).argmax(1))], ["id", "label", "g", "near"])

    def pack(batches):
        k = TaskContext.get().partitionId() << 32
        for b in gathered(batches, BLOCK):
            g = unpacked(b.column(2), np.int32, d)
            top = _bounds(g, centres, widest).max(0)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([b.column(0).to_numpy().tobytes()]), pa.array([b.column(1).to_numpy().tobytes()]), pa.array([g.tobytes()]), pa.array([top.tolist()])], ["block", "ids", "labels", "gs", "top"])
            k += 1

    dealt = valid.select("id", "label", "g").mapInArrow(near, "id long, label long, g binary, near long")
    dealt = dealt.repartitionByRange("near", F.xxhash64("id")).sortWithinPartitions("near", F.xxhash64("id"))
    return materialize(dealt.select("id", "label", "g").mapInArrow(pack, "block long, ids binary, labels binary, gs binary, top array<double>"))


def walk(block: dict, pack: dict, order: np.ndarray, bound: np.ndarray, k: int, same: bool) -> tuple[list, int]:
    """Best rows of one block for every member and slot of a pack, down the cluster's list.

    A slot accepts scores from ``lo`` to ``hi`` and wants its ``k`` best, none below ``kth``.  Returns
    (member, slot, score, id) arrays and the number of comparisons made.
    """
    g, lo, hi = pack["g"], pack["lo"], pack["hi"]
    need, real = np.maximum(lo, pack["kth"]), lo <= hi
    m, slots = need.shape
    held = [np.zeros(0, np.int64)] * 4
    walked = 0
    exact = np.int64 if float(np.abs(g).max(initial=0)) * float(np.abs(block["g"]).max(initial=0)) * g.shape[1] >= 1 << 53 else np.float64
    g, rows = g.astype(exact), block["g"].astype(exact)
    for s in range(0, len(order), STRETCH):
        at = np.flatnonzero((real & (pack["norm"][:, None] * bound[s] >= need)).any(1))
        if not len(at):
            break
        part = order[s: s + STRETCH]
        walked += len(at) * len(part)
        score = (g[at] @ rows[part].T).astype(np.int64)
        fits = (pack["label"][at][:, None] == block["label"][part]) == same
        fits &= pack["id"][at][:, None] != block["id"][part]
        for j in range(slots):
            i, c = np.nonzero(fits & (score >= need[at, j][:, None]) & (score <= hi[at, j][:, None]) & real[at, j][:, None])
            new = [at[i], np.full(len(i), j), score[i, c], block["id"][part[c]]]
            held = [np.concatenate(x) for x in zip(held, new)]
        by = np.lexsort((held[3], -held[2], held[1], held[0]))
        held = [x[by] for x in held]
        slot = held[0] * slots + held[1]
        begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        rank = np.arange(len(slot)) - np.repeat(begin, np.diff(np.append(begin, len(slot))))
        last = rank == k - 1
        np.maximum.at(need, (held[0][last], held[1][last]), held[2][last])
        held = [x[rank < k] for x in held]
    return held, walked


def _array(value: bytes, kind, *shape: int) -> np.ndarray:
    return np.frombuffer(value, kind).reshape(shape)


def _packs(members: DataFrame, slots: DataFrame) -> DataFrame:
    """One row a piece of a cluster: its members with their slots as matrices, and the least bound that can still serve one."""
    wanted = slots.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "lo", "hi", "kth"))).alias("s"))  # a few slots a member
    m = members.join(wanted, "id").select("cluster", "piece", "id", "label", "norm", "g", *[F.col(f"s.{c}").alias(c) for c in ("lo", "hi", "kth")])

    def run(key, t):
        t = t.sort_by("id")
        norm = t.column("norm").to_numpy()
        lo, hi, kth = (np.array(t.column(c).to_pylist(), np.int64) for c in ("lo", "hi", "kth"))
        least = np.maximum(lo, kth)
        with np.errstate(all="ignore"):
            need = np.where(norm[:, None] > 0, least / np.where(norm > 0, norm, 1)[:, None], np.where(least <= 0, -np.inf, np.inf))
        need = np.where(lo <= hi, need, np.inf).min()
        cols = [t.column("id").to_numpy(), t.column("label").to_numpy(), norm]
        return pa.table({"cluster": [key[0].as_py()], "piece": [key[1].as_py()], "need": [float(need)], "n": [t.num_rows], "ids": [cols[0].tobytes()], "labels": [cols[1].tobytes()], "norms": [cols[2].tobytes()],
                         "gs": [b"".join(t.column("g").to_pylist())], "lo": [lo.tobytes()], "hi": [hi.tobytes()], "kth": [kth.tobytes()]})

    return m.groupBy("cluster", "piece").applyInArrow(run, "cluster long, piece long, need double, n long, ids binary, labels binary, norms binary, gs binary, lo binary, hi binary, kth binary")


def search(members: DataFrame, blocks: DataFrame, slots: DataFrame, centres: np.ndarray, widest: np.ndarray, d: int, k: int, same: bool) -> DataFrame:
    """(id, slot, score, other): the ``k`` best rows for every slot (id, slot, lo, hi), of the same label or of others; every member has all slots."""
    blocks_n = blocks.count()
    w = Window.partitionBy("cluster").orderBy(F.desc("top"), "block")  # one row a block
    lists = materialize(blocks.select("block", F.posexplode("top").alias("cluster", "top")).withColumn("nth", F.row_number().over(w)))

    def compare(key, left, right):
        out = []
        if left.num_rows and right.num_rows:
            b = {c: right.column(c)[0].as_py() for c in ("ids", "labels", "gs")}
            block = {"id": _array(b["ids"], np.int64, -1), "label": _array(b["labels"], np.int64, -1), "g": _array(b["gs"], np.int32, -1, d)}
            bounds = _bounds(block["g"], centres, widest)
            order: dict[int, np.ndarray] = {}
            for p in left.to_pylist():
                c, n = p["cluster"], p["n"]
                if c not in order:
                    order[c] = np.argsort(-bounds[:, c], kind="stable")
                pack = {"id": _array(p["ids"], np.int64, n), "label": _array(p["labels"], np.int64, n), "norm": _array(p["norms"], np.float64, n), "g": _array(p["gs"], np.int32, n, d),
                        **{x: _array(p[x], np.int64, n, -1) for x in ("lo", "hi", "kth")}}
                (i, j, score, other), _ = walk(block, pack, order[c], bounds[order[c], c], k, same)
                out.append(pa.table({"id": pack["id"][i], "slot": j, "score": score, "other": other}))
        empty = pa.table({x: pa.array([], pa.int64()) for x in ("id", "slot", "score", "other")})
        return pa.concat_tables(out) if out else empty

    found, begin, end = None, 0, FIRST
    best = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "other")
    while begin < blocks_n:
        now = slots.withColumn("kth", F.lit(LEAST))
        if found is not None:
            full = found.groupBy("id", "slot").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")
            now = slots.join(full, ["id", "slot"], "left").select("id", "slot", "lo", "hi", F.coalesce("low", F.lit(LEAST)).alias("kth"))
        packs = materialize(_packs(members, now))
        lanes = -(-packs.count() // LANE)
        open_ = lists.filter((F.col("nth") > begin) & (F.col("nth") <= end)).join(packs.select("cluster", "piece", "need"), "cluster").filter(F.col("top") >= F.col("need"))
        pairs = materialize(open_.select("block", "cluster", "piece", F.pmod(F.xxhash64("cluster", "piece"), F.lit(max(lanes, 1))).alias("lane")))
        if not pairs.take(1):
            break
        left = pairs.join(packs, ["cluster", "piece"])
        right = pairs.select("block", "lane").distinct().join(blocks, "block").select(F.col("block").alias("of"), F.col("lane").alias("in_lane"), "ids", "labels", "gs")
        new = left.groupBy("block", "lane").cogroup(right.groupBy("of", "in_lane")).applyInArrow(compare, "id long, slot long, score long, other long")
        new = new if found is None else new.unionByName(found)
        found = materialize(new.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"))
        begin, end = end, end * GROWTH
    return found


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of ``floor(scale * x)``.  An anchor (a row that ``anchor``, a condition
    on ``id``, holds for) has its ``positives`` best other rows of the same label; each of these the
    ``negatives`` best rows of other labels whose score lies from ``low`` to ``high`` percent of its
    own.  Ties go to the smaller id.  Fewer are returned where there are no more.

    Rows without an id or label take no part, nor those whose vector is null or empty, holds null or
    non-finite components, has another length than that of the smallest id, or a component beyond
    2**28 on the grid.  Rows of one id count once: the one with the smallest label, then vector bytes.
    """
    spark = ready(df.sparkSession)
    valid, d = _valid(df, id_col, label_col, vector_col, scale)
    anchors = materialize(valid.filter(anchor))
    n = anchors.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    centres = _fitted(anchors, n, d)
    members = _members(anchors, centres, d)
    widest = np.zeros(len(centres))
    for r in members.groupBy("cluster").agg(F.max("angle").alias("w")).collect():  # at most CENTRES rows
        widest[r["cluster"]] = r["w"]
    blocks = _blocks(valid, centres, widest, d)
    every = members.select("id", F.lit(0).cast("long").alias("slot"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    near = search(members, blocks, every, centres, widest, d, positives, True)
    ranked = near.withColumn("slot", (F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")) - 1).cast("long"))
    near = materialize(ranked.select("id", "slot", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
    if not near.take(1):
        return spark.createDataFrame([], schema)
    floor = lambda percent: f"({percent} * positive_score - pmod({percent} * positive_score, 100)) div 100"
    grid_of = members.select("id", F.explode(F.expr(f"sequence(0L, {positives - 1}L)")).alias("slot"))
    slots = materialize(grid_of.join(near, ["id", "slot"], "left").select(
        "id", "slot", F.coalesce(F.expr(f"-({floor(-low)})"), F.lit(MOST)).alias("lo"), F.coalesce(F.expr(floor(high)), F.lit(LEAST)).alias("hi")))
    found = search(members, blocks, slots, centres, widest, d, negatives, False)
    r = found.withColumn("rank", F.row_number().over(Window.partitionBy("id", "slot").orderBy(F.desc("score"), "other"))).join(near, ["id", "slot"])
    return r.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
