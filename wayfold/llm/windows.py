"""Substring dedup over word windows: a count-min prefilter, then exact grouping.

Every window of ``WINDOW`` words is represented by its minimizer, the ``GRAM``-word run in it with
the smallest hash (the leftmost of equals).  Two places with the same window have the same
minimizer at the same distance, so the count of a minimizer's places is never below that of the
window.  Each partition sketches the places it sees; the merged sketch overestimates the counts,
and only windows whose minimizer is estimated to occur twice are grouped exactly.  The sketch's
width bounds the memory of every task; a width too small for a corpus lets more windows through
and loses none.

Windows travel packed as arrays, one row for each bucket and flush; a flush sends a repeated window
once, so that a passage that half the corpus holds reaches a bucket once a flush.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import flat, hashes, mixed, placed, powers, ready, words
from wayfold.session import materialize

WINDOW, GRAM = 20, 10
#: Counters of one of the two sketch rows; flags of both take ``2 * WIDTH / 8`` bytes.
WIDTH, CELLS = 1 << 26, 1 << 16
#: Routes from buckets to blocks of documents, and bytes that a task deals to the blocks at once.
ROUTES, DEALT_BYTES = 257, 32 << 20
#: Values a task holds before it sends them, and words for which a bucket is made.
FLUSH, BUCKET_WORDS, BLOCK_DOCS = 1 << 20, 1 << 20, 256
STEP = np.uint64(0xD6E8FEB86659FD93)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each place on."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(h * powers(STEP, len(h))))
    return mixed((sums[n:] - sums[:-n]) * powers(BACK, len(h) - n + 1), n)


def _minimizers(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie in one text, the place of each one's minimizer, and the hash of every gram."""
    gram, span = _runs(h, GRAM), WINDOW - GRAM + 1
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), gram
    low, size = np.arange(len(gram)), 1
    while size < span:
        step = min(size, span - size)
        a, b = low[:-step], low[step:]
        low, size = np.where(gram[b] < gram[a], b, a), size + step
    inside = np.zeros(len(h) + 1, np.int32)
    n = np.diff(first)
    long = n >= WINDOW
    np.add.at(inside, first[:-1][long], 1)
    np.add.at(inside, first[1:][long] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(low)])
    return at, low[at], gram


def _column(m: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mixed(m, 70 + row) & np.uint64(width - 1)).astype(np.int64)


def _sketch_rows(m: np.ndarray, width: int, part: int) -> pa.RecordBatch:
    """Counts up to 2 of one flush: a row for each block of ``CELLS`` counters."""
    out = []
    for row in (0, 1):
        cell, count = np.unique(_column(m, row, width), return_counts=True)
        edges = np.flatnonzero(np.diff(cell // CELLS)) + 1
        for c, k in zip(np.split(cell, edges), np.split(np.minimum(count, 2), edges)):
            if len(c):
                out.append((row, int(c[0] // CELLS), part, (c % CELLS).astype(np.uint16).tobytes(), k.astype(np.uint8).tobytes(), len(m) if row == 0 else 0))
    c = list(zip(*out))
    n = [0] * len(out)
    if out:
        n[0] = len(m)
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary()), pa.array(n, pa.int64())], ["row", "block", "part", "cells", "counts", "n"])


SKETCH = "row int, block int, part int, cells binary, counts binary, n long"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Sketch blocks of every partition's minimizers, each place counted once; ``n`` sums to the places."""

    def run(batches):
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId() // 256, [], 0
        for b in batches:
            data, offsets = flat(b.column(0))
            starts, ends, first = words(data, offsets)
            _, low, gram = _minimizers(hashes(data, starts, ends), first)
            held.append(gram[np.unique(low)])
            size += len(held[-1])
            if size >= FLUSH:
                yield _sketch_rows(np.concatenate(held), width, part)
                held, size = [], 0
        if size:
            yield _sketch_rows(np.concatenate(held), width, part)

    return docs.select("text").mapInArrow(run, SKETCH)


def _merged(t: pa.Table) -> np.ndarray:
    total = np.zeros(CELLS, np.uint8)
    for cells, counts in zip(t.column("cells"), t.column("counts")):
        at = np.frombuffer(cells.as_py(), np.uint16)
        total[at] = np.minimum(total[at] + np.frombuffer(counts.as_py(), np.uint8), 2)
    return total


def repeated_flags(sketch: DataFrame, width: int) -> list[np.ndarray]:
    """For each row the bits of the counters that reach 2: bounded by ``width``, so they may be held."""

    def some(key, t):  # sketches of 256 partitions first, so that no task gets those of all
        total = _merged(t)
        at = np.flatnonzero(total)
        return pa.table({"row": [key[0].as_py()], "block": [key[1].as_py()], "part": [key[2].as_py()], "cells": [at.astype(np.uint16).tobytes()], "counts": [total[at].tobytes()], "n": [0]}, schema=pa.schema([("row", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())]))

    def whole(key, t):
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([np.packbits(_merged(t) == 2).tobytes()], pa.binary())})

    if sketch.filter("part > 0").take(1):
        sketch = sketch.groupBy("row", "block", "part").applyInArrow(some, SKETCH)
    got = sketch.groupBy("row", "block").applyInArrow(whole, "row int, block int, bits binary").toArrow()
    flags = [np.zeros(width // 8, np.uint8) for _ in (0, 1)]
    for row, block, bits in zip(*(got.column(c).to_pylist() for c in ("row", "block", "bits"))):
        flags[row][block * CELLS // 8: (block + 1) * CELLS // 8] = np.frombuffer(bits, np.uint8)
    return flags


def _flagged(flags: list[np.ndarray], m: np.ndarray, width: int) -> np.ndarray:
    ok = np.ones(len(m), bool)
    for row in (0, 1):
        c = _column(m, row, width)
        ok &= (flags[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _later(w: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by (hash, document, start), and which of them repeat an earlier one."""
    order = np.lexsort((at, doc, w))
    w, doc, at = w[order], doc[order], at[order]
    new = np.append(True, w[1:] != w[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (doc != doc[head]) | (at != at[head])


def _packed(kind: int, block: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """One row (kind, block, bytes ...) for each block."""
    if not len(block):
        return []
    order = np.argsort(block, kind="stable")
    block = block[order]
    edges = np.flatnonzero(np.diff(block)) + 1
    parts = [np.split(v[order], edges) for v in values]
    return [(kind, int(b[0]), *(p[k].tobytes() for p in parts)) for k, b in enumerate(np.split(block, edges))]


def routes(doc: np.ndarray, blocks: int) -> np.ndarray:
    """The route to each document's block: at most about ``ROUTES`` or the root of the number of blocks.

    A bucket writes one row a route it touches, so its rows don't grow with the number of blocks.
    """
    return doc % blocks % max(ROUTES, math.isqrt(blocks) | 1)


def dealt(packed: DataFrame, blocks: int) -> DataFrame:
    """Packed rows (block, doc, ...) of the routes, dealt to the blocks themselves."""
    if blocks <= max(ROUTES, math.isqrt(blocks) | 1):
        return packed
    names = packed.columns

    def split(held):
        cols = [np.frombuffer(b"".join(x for b in held for x in b.column(k).to_pylist()), np.int64) for k in range(1, len(names))]
        return pa.RecordBatch.from_pydict(_table([r[1:] for r in _packed(0, cols[0] % blocks, *cols)], *names))

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= DEALT_BYTES:
                yield split(held)
                held, size = [], 0
        if held:
            yield split(held)

    return packed.repartition("block").mapInArrow(run, packed.schema)


def _table(rows: list[tuple], *names: str) -> dict:
    c = list(zip(*rows)) or [()] * len(names)
    return {n: pa.array(v, pa.int32() if n in ("kind", "block") else pa.binary()) for n, v in zip(names, c)}


def repeated_windows(docs: DataFrame, buckets: int, blocks: int, width: int, flags) -> DataFrame:
    """(block, doc, at): packed windows that also start earlier, by block of the document's id."""

    def run(batches):
        held = []

        def flush():
            w, doc, at = (np.concatenate(x) for x in zip(*held))
            order, later = _later(w, doc, at)
            go = order[~later]
            stay = order[later]
            rows = _packed(0, (w[go] % np.uint64(buckets)).astype(np.int64), w[go], doc[go], at[go])
            # what repeats a window of this flush is settled; it passes the buckets by its document
            rows += [(1, b % buckets, b"", d, a) for _, b, d, a in _packed(1, routes(doc[stay], blocks), doc[stay], at[stay])]
            return pa.RecordBatch.from_pydict(_table(rows, "kind", "block", "w", "doc", "at"))

        size = 0
        for b in batches:
            data, offsets = flat(b.column(1))
            starts, ends, first = words(data, offsets)
            h = hashes(data, starts, ends)
            at, low, gram = _minimizers(h, first)
            place = np.unique(low)
            hot = _flagged(flags.value, gram[place], width)
            keep = hot[np.searchsorted(place, low)]
            at = at[keep]
            text = np.searchsorted(first, at, "right") - 1
            doc = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((_runs(h, WINDOW)[at] if len(h) >= WINDOW else h[:0], doc[text], (at - first[text]).astype(np.int64)))
            size += len(at)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def settle(key, t):
        kind = np.array(t.column("kind"))
        got = {k: [np.frombuffer(b"".join(x.as_py() for x, y in zip(t.column(c), kind) if y == k), np.uint64 if c == "w" else np.int64) for c in ("w", "doc", "at")] for k in (0, 1)}
        w, doc, at = got[0]
        order, later = _later(w, doc, at) if len(w) else (np.zeros(0, np.int64), np.zeros(0, bool))
        gone = order[later]
        doc, at = np.append(doc[gone], got[1][1]), np.append(at[gone], got[1][2])
        rows = _packed(0, routes(doc, blocks), doc, at)
        return pa.table(_table([r[1:] for r in rows], "block", "doc", "at"))

    sent = docs.select("id", "text").mapInArrow(run, "kind int, block int, w binary, doc binary, at binary")
    return dealt(sent.groupBy(F.col("block").alias("bucket")).applyInArrow(settle, "block int, doc binary, at binary"), blocks)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_removed, kept): texts without the words of repeated windows, joined by one space.

    A word goes if a window of ``WINDOW`` words over it also starts earlier, in a smaller id or
    earlier in the same text; windows are judged on the input.  Null and empty texts have no words.
    Rows without an id keep their words; equal rows that share an id are one place, different texts
    under one id come in the order of their hashes.
    """
    ready(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    d = placed(d)
    named = d.filter("place IS NOT NULL").select(F.col("place").alias("id"), "text")
    sketch = materialize(sketches(named, width))
    size = sketch.agg(F.sum("n")).first()[0] or 0
    n_docs = d.count()
    buckets, blocks = max(256, size * (WINDOW - GRAM + 2) // 2 // BUCKET_WORDS) | 1, max(256, n_docs // BLOCK_DOCS) | 1
    flags = docs.sparkSession.sparkContext.broadcast(repeated_flags(sketch, width))
    gone = repeated_windows(named, buckets, blocks, width, flags)
    by = F.coalesce(F.pmod("place", F.lit(blocks)), F.pmod(F.xxhash64("text"), F.lit(blocks))).cast("int")

    def finish(left, right):
        doc, at = (np.frombuffer(b"".join(right.column(c).to_pylist()), np.int64) for c in ("doc", "at"))
        order = np.argsort(doc, kind="stable")
        doc, at = doc[order], at[order]
        ids = left.column("place")
        data, offsets = flat(left.column("text"))
        starts, ends, first = words(data, offsets)
        number = np.array([x if x is not None else -1 for x in ids.to_pylist()], np.int64)
        valid = ~np.asarray(ids.is_null())
        a, b = np.searchsorted(doc, number, "left"), np.searchsorted(doc, number, "right")
        b[~valid] = a[~valid]
        change = np.zeros(len(starts) + WINDOW + 1, np.int32)
        for i in np.flatnonzero(b > a):
            np.add.at(change, first[i] + at[a[i]: b[i]], 1)
            np.add.at(change, first[i] + at[a[i]: b[i]] + WINDOW, -1)
        keep = np.cumsum(change)[: len(starts)] == 0
        raw, kept, n = data.tobytes(), [], np.add.reduceat(np.append(~keep, False), first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)
        n = np.where(np.diff(first) > 0, n, 0)
        for i, j in zip(first[:-1], first[1:]):
            some = np.flatnonzero(keep[i:j]) + i
            kept.append(b" ".join([raw[x:y] for x, y in zip(starts[some].tolist(), ends[some].tolist())]).decode())
        return pa.table({"id": left.column("id").cast(pa.int64()), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(n, pa.int64()), "kept": pa.array(kept, pa.string())})

    return d.withColumn("block", by).groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(finish, "id long, n_words long, n_removed long, kept string")
