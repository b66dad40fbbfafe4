"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming join.

A signature has ``CHUNKS * WIDTH`` symbols of 16 bits, one per hash function.  It is split into
chunks; a chunk is indexed once for every symbol that may be wrong (that symbol is left out of the
key).  By the pigeonhole principle every pair whose signatures differ in fewer than
``2 * CHUNKS`` symbols agrees in some key.  Pairs found are confirmed on their full shingle sets.

Buckets are never expanded into all pairs while their members are still being joined to each
other: each round compares the members of a bucket with one pivot only, and links merge
components.  Only members of different components are compared pair by pair at the end, block by
block, which is exact, since a pair inside one component cannot change the result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.fixpoint import components
from wayfold.llm.arrays import LOWER, broadcast_if_small, flat, hashes, lists, mixed, ready, words
from wayfold.session import materialize

CHUNKS, WIDTH = 8, 5
#: Bits of a key that tell which chunk it is of and which symbol is left out.
PART = np.uint64(63)
#: Found pairs whose signatures differ in more symbols are not confirmed: at the least similarity
#: of 0.8 that happens to 5 in a million.
MOST_DIFFERENT = 20
#: Rounds of comparing with one pivot a bucket.
PIVOT_ROUNDS = 3
#: Members of one block of a bucket; classes of shingles that are counted, and the count that says no more.
BLOCK, CLASSES, FULL = 256, 256, 65535


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``size`` consecutive words, lower-cased A-Z."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = hashes(data, starts, ends)
    grams = h.copy()
    for k in range(1, size):
        grams[:-k or None] = mixed(grams[:-k or None] * np.uint64(0x9FB21C651E98DF25) + h[k:], k)
        grams[len(grams) - k:] = 0
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n == 0:
            out.append(grams[:0])
        elif n < size:  # the whole sequence is one shingle
            whole = np.uint64(n)
            for x in h[a:b]:
                whole = mixed(whole[None] * np.uint64(0x9FB21C651E98DF25) + x, size)[0]
            out.append(np.array([whole]))
        else:
            s = np.sort(grams[a: b - size + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit symbols per non-empty set."""
    n = CHUNKS * WIDTH
    full = [s for s in sets if len(s)]
    out = np.zeros((len(full), n), np.uint16)
    if not full:
        return out
    x = np.concatenate(full)
    at = np.cumsum([0, *map(len, full)])[:-1]
    for k in range(n):
        a, b = mixed(np.array([2 * k, 2 * k + 1], np.uint64), 91)
        low = np.minimum.reduceat(x * (a | np.uint64(1)) + b, at)
        out[:, k] = (mixed(low, k) >> np.uint64(48)).astype(np.uint16)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, f1, f2, sig): set size, 128-bit fingerprint of the set, signature (null: empty set)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sets = _sets(b.column(1), size)
            n = np.array([len(s) for s in sets], np.int64)
            sig = iter(_signatures(sets))
            f = [np.array([mixed(s, salt).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for salt in (11, 12)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(f[0]), pa.array(f[1]), pa.array([next(sig).tobytes() if k else None for k in n], pa.binary())], ["id", "n", "f1", "f2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL").mapInArrow(run, "id long, n long, f1 long, f2 long, sig binary")


def _index(reps: DataFrame) -> DataFrame:
    """(key, id): every chunk with every single symbol left out."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, CHUNKS, WIDTH).astype(np.uint64)
            keys = np.empty((b.num_rows, CHUNKS, WIDTH), np.uint64)
            for out in range(WIDTH):
                packed = np.zeros((b.num_rows, CHUNKS), np.uint64)
                for j in range(WIDTH):
                    if j != out:
                        packed = (packed << np.uint64(16)) | sig[:, :, j]
                for c in range(CHUNKS):
                    keys[:, c, out] = (mixed(packed[:, c], c * WIDTH + out + 1) & ~PART) | np.uint64(c * WIDTH + out)
            ids = np.repeat(b.column(0).to_numpy(), CHUNKS * WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def _close(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs whose signatures differ in at most ``MOST_DIFFERENT`` symbols and whose set sizes allow the similarity."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in (b.column(2), b.column(3)))
            keep = (x != y).sum(1) <= MOST_DIFFERENT
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])

    s = sigs.select("id", "n", "sig")
    j = pairs.join(s.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    j = j.filter("100 * least(na, nb) >= 80 * greatest(na, nb)").select("a", "b", "sa", "sb")
    return j.mapInArrow(run, "a long, b long")


def _shingles(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame, size: int) -> DataFrame:
    """(id, s, classes): full shingle sets of the documents named in ``ids``, and how many fall in each of ``CLASSES``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                sets = _sets(b.column(1), size)
                classes = [np.minimum(np.bincount((x & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES), FULL).astype(np.uint16).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), lists(np.concatenate(sets).view(np.int64), np.cumsum([0, *map(len, sets)]), pa.int64()), pa.array(classes, pa.binary())], ["id", "s", "classes"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return d.join(broadcast_if_small(ids, ids.count()), "id", "left_semi").mapInArrow(run, "id long, s array<long>, classes binary")


def _first_key(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The first chunk and left-out symbol in whose key signatures agree with ``one``."""
    differ = (many != one).reshape(-1, CHUNKS, WIDTH)
    chunk = (differ.sum(2) <= 1).argmax(1)
    return chunk * WIDTH + differ[np.arange(len(many)), chunk].argmax(1)


def _blocks(per: DataFrame) -> DataFrame:
    """``per`` with how many blocks a bucket has outside its largest component (``out``) and in it (``ins``), and the rows they make."""
    wide = F.col("n") > BLOCK
    b = per.withColumn("out", F.ceil(F.when(wide, F.col("n") - F.col("at_home")).otherwise(F.col("n")) / BLOCK).cast("int"))
    b = b.withColumn("ins", F.when(wide, F.ceil(F.col("at_home") / BLOCK)).otherwise(0).cast("int"))
    return b.withColumn("rows", F.when(wide, F.col("at_home") * F.col("out") + (F.col("n") - F.col("at_home")) * (F.col("out") + F.col("ins"))).otherwise(F.col("n")))


def _dealt(m: DataFrame, per: DataFrame) -> DataFrame:
    """(key, id, comp, block, other): every member with its block, once for each block that this one meets."""
    o = m.join(_blocks(per).select("key", "home", "out", "ins"), "key")
    inside = (F.col("ins") > 0) & (F.col("comp") == F.col("home"))
    at = F.xxhash64("id")
    o = o.withColumn("block", F.when(inside, F.col("out") + F.pmod(at, F.col("ins"))).otherwise(F.pmod(at, F.col("out"))).cast("int"))
    last = F.col("out") + F.when(inside, 0).otherwise(F.col("ins")) - 1
    return o.select("key", "id", "comp", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))


def _across(m: DataFrame, per: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one bucket but different components that may be similar enough.

    Buckets are cut into blocks of about ``BLOCK`` members and two blocks meet in one task, where
    signatures and class counts are compared as arrays.  In wide buckets the largest component has
    blocks of its own, which meet the others only: its members make one row for each block outside.
    The class counts bound the common shingles from above, so what they rule out is no link.
    """

    def run(key, t):
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(t.num_rows, -1)
        classes = np.frombuffer(b"".join(t.column("classes").to_pylist()), np.uint16).reshape(t.num_rows, -1)
        ids, comp, n, block = (t.column(c).to_numpy() for c in ("id", "comp", "n", "block"))
        part, i, j = key[0].as_py() & int(PART), key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        for x in left:
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            y = y[(sig[y] != sig[x]).sum(1) <= MOST_DIFFERENT]
            both = np.minimum(classes[y], classes[x]).sum(1, dtype=np.int64)
            full = (classes[y] == FULL).any(1) | (classes[x] == FULL).any()
            y = y[full | (100 * both >= percent * (n[y] + n[x] - both))]
            y = y[_first_key(sig[y], sig[x]) == part]  # each pair in one of its buckets only
            out.append(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]))
        a, b = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    o = _dealt(m, per).join(about, "id")
    o = o.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp", "n", "sig", "classes")
    return o.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): documents linked by a Jaccard similarity of ``percent`` or more.

    ``component_id`` is the smallest id reachable by links.  Null and empty texts have no shingles
    and are linked with nothing; a text with fewer words than a shingle is one shingle; equal sets
    are one node, however many documents share them.  Rows without an id are left out; rows that
    repeat an id get the same component.  ``percent`` must be 80 or more, which the signature's
    error bound is made for.
    """
    if percent < 80:
        raise ValueError("the signature's error bound holds from a similarity of 0.8")
    ready(docs.sparkSession)
    every = materialize(signatures(docs, id_col, text_col, size))
    some = every.filter("n > 0")
    groups = materialize(some.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")))
    reps = materialize(some.join(groups, ["f1", "f2", "n"]).filter("id = rep").select("id", "n", "sig").dropDuplicates(["id"]))
    keys = materialize(_index(reps))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    members = materialize(keys.join(shared, "key").select("key", "id"))
    comp = materialize(members.select("id").distinct().withColumn("comp", F.col("id")))
    sets = materialize(_shingles(docs, id_col, text_col, comp.select("id"), size))
    reps = materialize(reps.join(comp, "id", "left_semi"))
    links, tested = [], []

    def confirmed(pairs, last=False):
        """The pairs that hold on full sets; all pairs tried are noted."""
        if last and tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
        pairs = materialize(_close(pairs, reps))
        tested.append(pairs)
        few = broadcast_if_small(pairs, pairs.count())
        ends = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        named = sets.join(broadcast_if_small(ends, ends.count()), "id", "left_semi")
        full = few.join(named.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        full = full.join(named.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("shuffle_hash"), "a")  # sets grow with the texts: never broadcast
        both = F.size(F.array_intersect("sa", "sb"))
        links.append(materialize(full.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")))
        return links[-1]

    t, before = 0, None
    while True:
        m = materialize(members.join(comp, "id"))
        of = m.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct(F.xxhash64("id", F.lit(t)).alias("r"), "id")).alias("pick"))
        most = F.max(F.struct("c", "pick", "comp"))
        per = of.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"), most.alias("home"))
        per = materialize(per.filter("n * n > q").select("key", "n", "q", F.col("home.c").alias("at_home"), F.col("home.pick.id").alias("pivot"), F.col("home.comp").alias("home")))
        left = _blocks(per).agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2).alias("x"), F.sum("n").alias("n"),
                                *[F.coalesce(F.sum(F.when(F.col("n") > BLOCK, F.col(c))), F.lit(0)).alias(f"wide_{c}") for c in ("n", "rows")]).first()
        if not left["x"]:
            break
        # wide buckets go on while that saves a quarter of the rows that their blocks would make
        enough = left["wide_rows"] <= 2 * left["wide_n"] or (before is not None and 4 * left["wide_rows"] > 3 * before)
        if left["x"] <= left["n"] or t >= PIVOT_ROUNDS and enough:
            confirmed(_across(m, per, reps.join(sets.select("id", "classes"), "id"), percent), last=True)
            break
        before = left["wide_rows"] if t >= PIVOT_ROUNDS else None
        wide = per if t < PIVOT_ROUNDS else per.filter(F.col("n") > BLOCK)
        new = confirmed(m.join(wide.select("key", "pivot", "home"), "key").filter("comp <> home").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
        # equal labels are surely linked; labels that stay apart for now only cost another look
        met = new.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b").select("ca", "cb")
        low = materialize(met.select("ca", "cb").union(met.select("cb", "ca")).groupBy("ca").agg(F.min("cb").alias("low")).withColumn("low", F.least("ca", "low")))
        # a second step, so that what met one pivot gets one label
        low = low.join(low.select(F.col("ca").alias("low"), F.col("low").alias("lower")), "low", "left").select("ca", F.coalesce("lower", "low").alias("low"))
        comp = materialize(comp.join(low, comp["comp"] == low["ca"], "left").select("id", F.least("comp", F.coalesce("low", "comp")).alias("comp")))
        t += 1
    comp = None
    if links:
        comp = components(reduce(DataFrame.unionByName, links)).select("id", "component")
    named = groups if comp is None else groups.join(comp, groups["rep"] == comp["id"], "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("rep"))
    out = every.join(named, ["f1", "f2", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("component_id"))
