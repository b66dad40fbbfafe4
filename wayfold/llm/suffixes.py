"""Byte-level substring dedup: merged Burrows-Wheeler transforms of the places that can repeat.

Every string of ``WINDOW`` bytes is represented by its minimizer, the ``GRAM``-byte run with the
smallest hash; equal strings have the same one at the same distance.  A count-min sketch of the
minimizers' places tells which can occur twice, and only their surroundings, the bytes of all the
windows they represent, are sent on, to the bucket of the minimizer's hash.  That loses none.

In a bucket the surroundings are read as sequences of tokens (words with the spaces after them).
Each shard of sequences gets its Burrows-Wheeler transform; transforms are merged two by two by
refining the interleave one token per step, which sorts the joint suffixes without comparing them
again and shows, by the step that parts two neighbours, their common prefix.  Windows whose whole
tokens lie in such a repeated interval are then confirmed byte by byte through their hashes.

A minimizer of very many places would send them all to one bucket.  Its surroundings are cut into
windows instead, equal ones of a task are folded, and each goes to the bucket of its own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import BASE, INVERSE, LETTER, SPACE, _power, flat, hashes, mixed, placed, ready
from wayfold.llm.windows import FLUSH, SKETCH, WIDTH, _flagged, _packed, _sketch_rows, _table, dealt, repeated_flags, routes
from wayfold.session import materialize

WINDOW, GRAM = 200, 32
SPAN = WINDOW - GRAM + 1
CHUNK, PLACE = 1 << 20, np.uint64((1 << 22) - 1)
BUCKET_BYTES, BLOCK_DOCS, SEND = 4 << 20, 256, 8 << 20
#: Tokens of one shard before merging.
SHARD = 1 << 16
#: Places from which on a minimizer is split into windows; places in one flush of the sketch from which on they are counted.
HOT, HEAVY = 1 << 12, 64
#: Document of surroundings that stand for several places, whose bytes are settled already.
NOWHERE = -(1 << 63)


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` bytes from each place on."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTER[data] * _power(BASE, len(data)), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * _power(INVERSE, len(data) - n + 1), n)


def _anchors(data: np.ndarray, offsets: np.ndarray):
    """Chunks of (window starts, their minimizers' places, minimizers' hashes at those places)."""
    room = np.diff(offsets)
    for lo in range(0, len(data), CHUNK):
        hi = min(lo + CHUNK, len(data))
        text = np.searchsorted(offsets, [lo, hi], "right")
        valid = np.zeros(hi - lo + 1, np.int32)
        for t in range(max(text[0] - 1, 0), min(int(text[1]), len(room))):
            a, b = max(offsets[t], lo), min(offsets[t + 1] - WINDOW + 1, hi)
            if a < b:
                valid[a - lo] += 1
                valid[b - lo] -= 1
        at = np.flatnonzero(np.cumsum(valid[:-1]))
        if not len(at):
            continue
        g = _grams(data[lo: min(hi + WINDOW - 1, len(data))], GRAM)
        key = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
        table = np.full(-(-len(key) // SPAN) * SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
        table[: len(key)] = key
        table = table.reshape(-1, SPAN)
        ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        low = (np.minimum(behind[at], ahead[at + SPAN - 1]) & PLACE).astype(np.int64)
        yield at + lo, low + lo, g[low]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Sketch blocks of every partition's minimizers, each place counted once; blocks of row 2 count those frequent in a flush."""
    least = HEAVY

    def heavy(m, part):
        m, count = np.unique(m, return_counts=True)
        some = count >= least
        return pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int32()), pa.array([part], pa.int32()), pa.array([m[some].tobytes()]), pa.array([count[some].astype(np.int64).tobytes()]), pa.array([0], pa.int64())], ["row", "block", "part", "cells", "counts", "n"])

    def run(batches):
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId() // 256, [], 0
        for b in batches:
            last = -1
            for _, low, g in _anchors(*flat(b.column(0))):
                new = np.append(low[0] != last, low[1:] != low[:-1])
                last = low[-1]
                held.append(g[new])
                size += len(held[-1])
            if size >= FLUSH:
                yield _sketch_rows(np.concatenate(held), width, part)
                yield heavy(np.concatenate(held), part)
                held, size = [], 0
        if size:
            yield _sketch_rows(np.concatenate(held), width, part)
            yield heavy(np.concatenate(held), part)

    return docs.select("text").mapInArrow(run, SKETCH)


def hot_minimizers(sketch: DataFrame) -> tuple[np.ndarray, int]:
    """Minimizers of ``HOT`` counted places or more, in order, and the sum of their places."""

    def run(batches):
        for b in batches:
            m, n = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(n)], ["m", "n"])

    t = sketch.filter("row = 2").select("cells", "counts").mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT).toArrow()
    return np.sort(t.column("m").to_numpy().view(np.uint64)), int(t.column("n").to_numpy().sum())


def transform(sequences: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of one shard: its suffixes in order and the symbol before each.

    Symbols are positive; each sequence gets a closing 0, and closings follow the order of their
    sequences.  Suffixes are sorted by doubling.
    """
    n = len(sequences) + len(lengths)
    text = np.zeros(n, np.int64)
    ends = np.cumsum(lengths + 1) - 1
    inner = np.ones(n, bool)
    inner[ends] = False
    text[inner] = sequences
    left = np.repeat(ends, lengths + 1) - np.arange(n)  # symbols up to the closing one
    rank, k = np.unique(text, return_inverse=True)[1], 1
    while True:
        further = np.where(left >= k, rank[np.minimum(np.arange(n) + k, n - 1)] + 1, 0)
        order = np.lexsort((further, rank))
        new = np.append(False, (rank[order][1:] != rank[order][:-1]) | (further[order][1:] != further[order][:-1]))
        now = np.empty(n, np.int64)
        now[order] = np.cumsum(new)
        if (now == rank).all() or k > WINDOW:
            break
        rank, k = now, 2 * k
    before = np.where(np.append(True, ~inner[:-1]), 0, np.append(0, text[:-1])).astype(sequences.dtype)
    return order, before[order]


def merged(one: np.ndarray, two: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of two transforms (True: from ``two``) and the common prefix of every suffix with the one before.

    Each step sorts the interleave by the symbol before, stably: the suffixes one symbol longer
    come into order.  It ends when a step changes neither order nor blocks.  Closing symbols differ
    from each other and keep the order of their sequences, so a common prefix ends before them.
    """
    n = len(one) + len(two)
    closed = int((one == 0).sum()), int((two == 0).sum())
    z = np.append(np.zeros(len(one), bool), np.ones(len(two), bool))
    common = np.full(n, -1, np.int64)
    common[:1] = 0  # nothing stands before the first
    block = np.zeros(n, np.int64)
    for step in range(steps):
        symbol = np.empty(n, one.dtype)
        symbol[~z], symbol[z] = one, two
        order = np.argsort(symbol, kind="stable")
        s, b = symbol[order], block[order]
        parts = np.append(False, (s[1:] != s[:-1]) | (s[1:] == 0) | (b[1:] != b[:-1]))[:n]
        common[parts & (common < 0)] = step
        now, z2 = np.cumsum(parts), z[order]
        z2[: sum(closed)] = np.repeat([False, True], closed)
        if (now == block).all() and (z2 == z).all():
            break
        z, block = z2, now
    common[common < 0] = steps
    return z, common


def repeated_intervals(sequences: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each symbol the length, in symbols, of the longest sequence from it that starts elsewhere, too."""
    steps = int(lengths.max(initial=0)) + 2
    sequences = sequences.astype(np.uint16 if sequences.max(initial=0) < 1 << 16 else np.int64)  # short symbols sort fastest
    shards, first = [], 0
    begins = np.append(0, np.cumsum(lengths))
    while first < len(lengths):
        last = max(int(np.searchsorted(begins, begins[first] + SHARD, "right")) - 1, first + 1)
        part = sequences[begins[first]: begins[last]]
        order, before = transform(part, lengths[first:last])
        shards.append((order + begins[first] + first, before, None))
        first = last
    if len(shards) == 1:  # a transform merged with an empty one tells its own common prefixes
        shards.append((np.zeros(0, np.int64), np.zeros(0, sequences.dtype), None))
    while len(shards) > 1:
        pairs = []
        for a, b in zip(shards[::2], shards[1::2]):
            z, common = merged(a[1], b[1], steps)
            order, before = np.empty(len(z), np.int64), np.empty(len(z), a[1].dtype)
            order[~z], order[z] = a[0], b[0]
            before[~z], before[z] = a[1], b[1]
            pairs.append((order, before, common))
        shards = pairs + (shards[-1:] if len(shards) % 2 else [])
    order, _, common = shards[0]
    longest = np.zeros(len(order), np.int64)
    longest[order] = np.maximum(common, np.append(common[1:], 0))
    inner = np.ones(len(order), bool)
    inner[np.cumsum(lengths + 1) - 1] = False
    return longest[inner]


def _tokens(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every token (a word and the spaces after it) and the first of each text; the text's head before a word is one, too."""
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    start[begins[:-1][np.diff(begins) > 0]] = True
    at = np.flatnonzero(start)
    return at, np.searchsorted(at, begins)


def _candidates(data: np.ndarray, begins: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each window of each surrounding whether its whole tokens lie in a repeated interval (or there are none)."""
    at, first = _tokens(data, begins)
    ends = np.append(at[1:], len(data))
    # the head may be cut, and so may the last token
    whole = np.ones(len(at), bool)
    whole[first[:-1]] = False
    whole[first[1:] - 1] = False
    lengths = np.add.reduceat(whole.astype(np.int64), first[:-1])
    symbols = np.unique(hashes(data, at, ends)[whole], return_inverse=True)[1].astype(np.int64) + 1
    longest = np.zeros(len(at), np.int64)
    longest[whole] = repeated_intervals(symbols, lengths)
    start = np.repeat(begins[:-1], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    # a token at the window's very edge may be cut differently elsewhere
    a = np.searchsorted(at, start, "right")
    b = np.searchsorted(ends, start + WINDOW, "left")
    a = np.maximum(a, np.repeat(first[:-1] + 1, windows))
    b = np.minimum(b, np.repeat(first[1:] - 1, windows))
    return (b <= a) | (longest[np.minimum(a, len(at) - 1)] >= b - a)


def _hashed(data: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window of surroundings of ``n`` windows each, its surrounding and its place there."""
    begins = np.cumsum(n - 1 + WINDOW) - (n - 1 + WINDOW)
    own = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    return mixed(_grams(data, WINDOW)[begins[own] + off] ^ m[own]), own, off


def _places(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each hash, and which rows' hash has several places (or stands for several)."""
    order = np.lexsort((at, doc, h))
    hs, ds, xs = h[order], doc[order], at[order]
    new = np.append(True, hs[1:] != hs[:-1])[: len(hs)]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(hs))[: len(head)] - 1
    hit = np.zeros(len(h), bool)
    hit[order] = ((ds[head] != ds[tail]) | (xs[head] != xs[tail]) | (ds[head] == NOWHERE))[np.cumsum(new) - 1]
    return order[head], hit


def surroundings(docs: DataFrame, buckets: int, blocks: int, width: int, flags, hot) -> DataFrame:
    """Packed rows for each bucket: surroundings (kind 0), settled ranges (1) and windows of ``hot`` minimizers (2)."""
    names = ("kind", "block", "m", "doc", "at", "n", "text")

    def run(batches):
        held, size = [], 0

        def flush():
            m, doc, at, n = (np.concatenate([h[k] for h in held]) for k in range(4))
            text = [x for h in held for x in h[4]]
            split = np.isin(m, hot.value)
            seen: dict = {}
            for k, x in enumerate(zip(m.tolist(), text)):
                if not split[k]:
                    seen.setdefault(x, []).append(k)
            rows, settled = {}, []
            for (key, raw), at_ in seen.items():
                spot = {(doc[k], at[k]) for k in at_}
                if len(spot) > 1:  # all its windows start elsewhere, too
                    settled += at_
                    spot = {(NOWHERE, 0)}
                d, a = next(iter(spot))
                rows.setdefault(key % buckets, []).append((key, d, a, n[at_[0]], raw))
            out = []
            for bucket, some in rows.items():
                c = list(zip(*some))
                out.append((0, bucket, np.array(c[0], np.uint64).tobytes(), np.array(c[1], np.int64).tobytes(), np.array(c[2], np.int64).tobytes(), np.array(c[3], np.int64).tobytes(), b"".join(c[4])))
            if split.any():
                k = np.flatnonzero(split)
                h, own, off = _hashed(np.frombuffer(b"".join(text[x] for x in k), np.uint8), m[k], n[k])
                place = at[k][own] + off
                first, hit = _places(h, doc[k][own], place)
                who, where = np.where(hit[first], NOWHERE, doc[k][own[first]]), np.where(hit[first], 0, place[first])
                out += [(2, bucket, x, d, a, b"", b"") for _, bucket, x, d, a in _packed(2, (h[first] % np.uint64(buckets)).astype(np.int64), h[first], who, where)]
                own, place = own[hit], place[hit]
                edge = np.append(True, (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1))[: len(own)]
                d, a, z = doc[k][own[edge]], place[edge], place[np.append(edge[1:], True)[: len(own)]] + WINDOW
                out += [(1, b % buckets, b"", d, a, e, b"") for _, b, d, a, e in _packed(1, routes(d, blocks), d, a, z)]
            if settled:
                k = np.array(settled)
                out += [(1, b % buckets, b"", d, a, e, b"") for _, b, d, a, e in _packed(1, routes(doc[k], blocks), doc[k], at[k], at[k] + n[k] - 1 + WINDOW)]
            return pa.RecordBatch.from_pydict(_table(out, *names))

        for b in batches:
            data, offsets = flat(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, low, g in _anchors(data, offsets):
                edge = np.append(True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1))
                begin = np.flatnonzero(edge)
                begin = begin[_flagged(flags.value, g[begin], width)]
                n = np.append(np.flatnonzero(edge), len(at))
                n = n[np.searchsorted(n, begin, "right")] - begin
                a = at[begin]
                t = np.searchsorted(offsets, a, "right") - 1
                raw = [data[x: x + k - 1 + WINDOW].tobytes() for x, k in zip(a.tolist(), n.tolist())]
                held.append((g[begin], ids[t], a - offsets[t], n, raw))
                size += sum(map(len, raw))
                if size >= SEND:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("id", "text").mapInArrow(run, "kind int, block int, m binary, doc binary, at binary, n binary, text binary")


def repeated_strings(docs: DataFrame, buckets: int, blocks: int, width: int, flags, hot) -> DataFrame:
    """(block, doc, a, b): packed byte ranges covered by strings that start elsewhere, too, by block of the document's id."""

    def settle(key, t):
        kind = np.array(t.column("kind"))
        cat = lambda c, k, d: np.frombuffer(b"".join(x.as_py() for x, y in zip(t.column(c), kind) if y == k), d)
        doc, a, b = cat("doc", 1, np.int64), cat("at", 1, np.int64), cat("n", 1, np.int64)
        m, who, at, n = cat("m", 0, np.uint64), cat("doc", 0, np.int64), cat("at", 0, np.int64), cat("n", 0, np.int64)
        if 2 in kind:
            h, d, x = cat("m", 2, np.uint64), cat("doc", 2, np.int64), cat("at", 2, np.int64)
            hit = _places(h, d, x)[1] & (d != NOWHERE)
            doc, a, b = np.append(doc, d[hit]), np.append(a, x[hit]), np.append(b, x[hit] + WINDOW)
        raw, begins = cat("text", 0, np.uint8).tobytes(), np.append(0, np.cumsum(n - 1 + WINDOW)).tolist()
        places: dict = {}  # of equal surroundings
        for key, i, j, place in zip(m.tolist(), begins[:-1], begins[1:], zip(who.tolist(), at.tolist())):
            places.setdefault((key, raw[i:j]), set()).add(place)
        several = {k: len(p) > 1 or NOWHERE in {d for d, _ in p} for k, p in places.items()}
        extra = [(d, x, x + len(k[1])) for k, p in places.items() if several[k] for d, x in p if d != NOWHERE]
        kinds: dict = {}
        for k in places:
            kinds.setdefault(k[0], []).append(k)
        # surroundings that differ meet the others of their minimizer, if any still has to be settled
        some = [k for ks in kinds.values() if len(ks) > 1 and not all(several[k] for k in ks) for k in ks]
        if some:
            data, n = np.frombuffer(b"".join(k[1] for k in some), np.uint8), np.array([len(k[1]) - WINDOW + 1 for k in some])
            begins, m = np.append(0, np.cumsum(n - 1 + WINDOW)), np.array([k[0] for k in some], np.uint64)
            own = np.repeat(np.arange(len(m)), n)
            off = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            keep = np.flatnonzero(_candidates(data, begins, n))
            own, off = own[keep], off[keep]
            h = mixed(_grams(data, WINDOW)[begins[own] + off] ^ m[own])
            order = np.lexsort((own, h))
            hs, us = h[order], own[order]
            new = np.append(True, hs[1:] != hs[:-1])[: len(hs)]
            head, tail = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(hs))[: new.sum()] - 1
            hit = np.zeros(len(h), bool)
            hit[order] = (us[head] != us[tail])[np.cumsum(new) - 1]
            hit &= ~np.array([several[k] for k in some])[own]
            own, off = own[hit], off[hit]
            edge = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1))[: len(own)])
            for x, y in zip(edge, np.append(edge[1:], len(own)) - 1):
                d, base = next(iter(places[some[own[x]]]))
                extra.append((d, base + off[x], base + off[y] + WINDOW))
        if extra:
            c = np.array(extra, np.int64)
            doc, a, b = np.append(doc, c[:, 0]), np.append(a, c[:, 1]), np.append(b, c[:, 2])
        return pa.table(_table([r[1:] for r in _packed(0, routes(doc, blocks), doc, a, b)], "block", "doc", "a", "b"))

    sent = surroundings(docs, buckets, blocks, width, flags, hot)
    return dealt(sent.groupBy(F.col("block").alias("bucket")).applyInArrow(settle, "block int, doc binary, a binary, b binary"), blocks)


def remove_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): UTF-8 bytes without those of repeated strings, joined.

    A byte goes if a string of ``WINDOW`` bytes over it also starts anywhere else; strings do not
    cross documents and are judged on the input.  Null and empty texts have no bytes.  Rows
    without an id keep theirs; equal rows that share an id are one place, different texts are places of
    their own.
    """
    ready(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    d = placed(d)
    named = d.filter("place IS NOT NULL").select(F.col("place").alias("id"), "text")
    sketch = materialize(sketches(named, width))
    size = sketch.agg(F.sum("n")).first()[0] or 0
    hot, places = hot_minimizers(sketch)
    buckets, blocks = max(256, (size * (2 * WINDOW) + places * SPAN * 24) // BUCKET_BYTES) | 1, max(256, d.count() // BLOCK_DOCS) | 1
    flags = docs.sparkSession.sparkContext.broadcast(repeated_flags(sketch.filter("row < 2"), width))
    gone = repeated_strings(named, buckets, blocks, width, flags, docs.sparkSession.sparkContext.broadcast(hot))
    by = F.coalesce(F.pmod("place", F.lit(blocks)), F.pmod(F.xxhash64("text"), F.lit(blocks))).cast("int")

    def finish(left, right):
        doc, a, b = (np.frombuffer(b"".join(right.column(c).to_pylist()), np.int64) for c in ("doc", "a", "b"))
        order = np.argsort(doc, kind="stable")
        doc, a, b = doc[order], a[order], b[order]
        raw = [x or b"" for x in left.column("text").to_pylist()]
        removed, spans, kept = [], [], []
        for k, text in zip(left.column("place").to_pylist(), raw):
            i, j = (np.searchsorted(doc, k, "left"), np.searchsorted(doc, k, "right")) if k is not None else (0, 0)
            if i == j:
                removed.append(0)
                spans.append(0)
                kept.append(text)
                continue
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, a[i:j], 1)
            np.add.at(change, b[i:j], -1)
            off = np.cumsum(change[:-1]) > 0
            removed.append(int(off.sum()))
            spans.append(int(off[0]) + int((off[1:] & ~off[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~off].tobytes())
        return pa.table({"id": left.column("id").cast(pa.int64()), "n_bytes": pa.array([len(x) for x in raw], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return d.withColumn("block", by).groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
