"""Line dedup: equal lines and lines within a small edit distance, by a segment-partition join.

A line of length l is cut into ``TAU + 1`` segments.  A line within ``TAU`` edits contains one of
them unchanged, at a place that both lengths narrow to a few (seen from the left, at most i - 1
edits precede segment i; seen from the right, at most TAU + 1 - i follow).  Segments are indexed
and these substrings probed as hashes; candidates that pass two letter-parity sketches are verified
by a banded bit-parallel edit distance on the texts.  Lengths and edits count UTF-8 bytes.
A line needs only one earlier neighbour to go, so families that share a segment are first compared
with their earliest lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.arrays import BASE, BLOCK, INVERSE, LETTER, SPACE, _power, broadcast_if_small, flat, hashes, mixed, ready
from wayfold.session import materialize

TAU = 2
#: Shorter lines are compared for equality only: two edits would join unlike ones.
LEAST_BYTES = 20
#: Keys of more index lines than this are settled by pivots before pairs are made.
HOT = 16


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and each text's first line (with a closing entry); an empty text is one empty line."""
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    closing = np.append(starts[1:], len(data) + 1) - 1  # the byte before the next line, if that is a line end
    first = np.arange(len(offsets) - 1) + np.searchsorted(cut, offsets[:-1])
    ends = closing
    last = np.append(first[1:], len(starts)) - 1
    ends[last] = offsets[1:]
    return starts, ends, np.append(first, len(starts))


def _judged(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Lines with anything but spaces."""
    ink = np.append(0, np.cumsum(~SPACE[data]))
    return ink[ends] > ink[starts]


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, row, pos, h, g): every judged line with two 64-bit hashes; ``row`` tells texts of one id apart."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = flat(b.column(1))
            starts, ends, first = _spans(data, offsets)
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            pos = np.arange(len(starts)) - first[doc]
            keep = _judged(data, starts, ends)
            starts, ends, doc, pos = starts[keep], ends[keep], doc[keep], pos[keep]
            h = hashes(data, starts, ends)
            g = hashes(data ^ np.uint8(0x5A), starts, ends)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), b.column(2).take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], ["id", "row", "pos", "h", "g"])

    return docs.select("id", "text", "row").mapInArrow(run, "id long, row long, pos int, h long, g long")


def _segments(length: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``i`` of ``TAU + 1``; the last ones take what division leaves."""
    base, long = length // (TAU + 1), length % (TAU + 1)
    plain = TAU + 1 - long
    return i * base + np.maximum(i - plain, 0), base + (i >= plain)


def _sketch(seg: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Parities of 32 letter classes and of 32 letter-pair classes: an edit flips at most 2 and 4 of them."""
    one = np.uint64(1) << (mixed(seg.astype(np.uint64), 3) & np.uint64(31))
    pair = np.zeros(len(seg), np.uint64)
    pair[:-1] = np.uint64(1) << (np.uint64(32) + (mixed(seg[:-1].astype(np.uint64) * np.uint64(257) + seg[1:], 4) & np.uint64(31)))
    a = np.append(np.uint64(0), np.bitwise_xor.accumulate(one))
    b = np.append(np.uint64(0), np.bitwise_xor.accumulate(pair))
    return (a[ends] ^ a[starts]) | (b[ends - 1] ^ b[starts])


def _keys(docs: DataFrame) -> DataFrame:
    """(key, h, s, own): index keys (``own``) and the substrings to look up, of the lines of ``LEAST_BYTES`` and more.

    A line's own index keys are not among what it looks up: lines of one length with an equal
    segment in place meet in the index itself.
    """

    def block(data, starts, ends):
        length = ends - starts
        sums = np.append(np.uint64(0), np.cumsum(LETTER[data] * _power(BASE, len(data))))
        back = _power(INVERSE, len(data) + 1)
        h = mixed((sums[ends] - sums[starts]) * back[starts] + length.astype(np.uint64))
        _, one = np.unique(h, return_index=True)
        starts, length, ends, h = starts[one], length[one], ends[one], h[one]
        s = _sketch(data, starts, ends)
        keys, who, index = [], [], 0

        def add(l, i, at, size, ok):
            a = starts + at
            x = (sums[np.where(ok, a + size, 0)] - sums[np.where(ok, a, 0)]) * back[np.where(ok, a, 0)]
            keys.append(mixed(x + l.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25), 50 + i)[ok])
            who.append(np.flatnonzero(ok))

        for i in range(TAU + 1):
            at, size = _segments(length, i)
            add(length, i, at, size, np.ones(len(h), bool))
            index += len(h)
        for i in range(TAU + 1):
            for d in range(TAU + 1):
                l = length - d
                at, size = _segments(l, i)
                for shift in range(max(-i, d - (TAU - i)), min(i, d + (TAU - i)) + 1):
                    if d or shift:
                        add(l, i, at + shift, size, (l >= LEAST_BYTES) & (at + shift >= 0) & (at + shift + size <= length))
        who = np.concatenate(who)
        return [*[pa.array(x.view(np.int64)) for x in (np.concatenate(keys), h[who], s[who])], pa.array(np.arange(len(who)) < index)]

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(0))
            starts, ends, _ = _spans(data, offsets)
            keep = (ends - starts >= LEAST_BYTES) & _judged(data, starts, ends)
            starts, ends = starts[keep], ends[keep]
            i = 0
            while i < len(starts):
                lo = starts[i]
                j = max(int(np.searchsorted(ends, lo + BLOCK, "right")), i + 1)
                yield pa.RecordBatch.from_arrays(block(data[lo: ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo), ["key", "h", "s", "own"])
                i = j

    return docs.select("text").mapInArrow(run, "key long, h long, s long, own boolean")


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance is at most ``most``: one bit for each diagonal of the band, one column at a time."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    front = n if same.all() else int(same.argmin())
    tail = x[len(x) - n + front:] == y[len(y) - n + front:]
    back = 0 if not len(tail) else len(tail) if tail.all() else int(tail[::-1].argmin())
    front = max(0, front - most)  # rows above the band's first column are needed
    x, y = x[front: len(x) - back], y[front: len(y) - back]
    rows, columns = len(x), len(y)
    if rows <= most or columns <= most:
        return _small(x.tobytes(), y.tobytes()) <= most
    width = 2 * most + 1
    padded = np.full(columns + width + rows, -1, np.int16)
    padded[most: most + rows] = x
    equal = np.zeros(columns, np.int64)
    for bit in range(width):
        equal |= (padded[bit: bit + columns] == y).astype(np.int64) << bit
    full = (1 << width) - 1
    up, down, cost = full & ~((1 << (most + 1)) - 1) | 0, 0, most
    up = full & ~((1 << most) - 1)  # column 0: the cells below row 0 grow by one
    bottom = 1 << (width - 1)
    for j, e in enumerate(equal.tolist()):
        zero = ((((e & up) + up) ^ up) | e | down) & full
        plus, minus = down | (full & ~(zero | up)), zero & up
        row = rows - (j + 1) + most  # bit of the last row in this column
        if row >= width - 1:
            cost += not zero & bottom
        elif row >= 0:
            cost += bool(plus >> row & 1) - bool(minus >> row & 1)
        shifted = zero >> 1
        up, down = minus | (full & ~(shifted | plus)), shifted & plus
    return cost <= most


def _small(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the lines at (id, row, pos)."""
    per = wanted.groupBy("id", "row").agg(F.collect_list("pos").alias("at"))  # lines of one document

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lines = [[t.encode().split(b"\n")[p] for p in at] for t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            column = pa.array([x for some in lines for x in some], pa.binary())
            data, offsets = flat(column)
            yield pa.RecordBatch.from_arrays([pa.array(hashes(data, offsets[:-1], offsets[1:]).view(np.int64)), column], ["h", "line"])

    per = materialize(per)
    return docs.join(broadcast_if_small(per, per.count(), 20_000), ["id", "row"]).select("text", "at").mapInArrow(run, "h long, line binary")


def _close(s, t):
    """Whether two sketches may belong to lines within ``TAU`` edits."""
    off = s.bitwiseXOR(t)
    return (F.bit_count(off.bitwiseAND(F.lit((1 << 32) - 1))) <= 2 * TAU) & (F.bit_count(F.shiftrightunsigned(off, 32)) <= 4 * TAU)


def _later(pairs: DataFrame, lines: DataFrame, places: DataFrame) -> DataFrame:
    """(h): the later line of every pair (x, y) within ``TAU`` edits; ``lines`` has (h, line), ``places`` where each starts first."""

    def run(batches):
        for b in batches:
            keep = pa.array([within(x, y, TAU) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["x", "y"])

    both = pairs.join(lines.select(F.col("h").alias("x"), F.col("line").alias("lx")), "x").join(lines.select(F.col("h").alias("y"), F.col("line").alias("ly")), "y")
    links = both.select("x", "y", "lx", "ly").mapInArrow(run, "x long, y long")
    at = F.struct("id", "row", "pos")
    x, y = places.select(F.col("h").alias("x"), at.alias("fx")), places.select(F.col("h").alias("y"), at.alias("fy"))
    return links.join(x, "x").join(y, "y").select(F.when(F.col("fx") < F.col("fy"), F.col("y")).otherwise(F.col("x")).alias("h")).distinct()


def _places(names: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of ``firsts`` of the lines in ``names`` (h); few names don't make all lines move."""
    names = materialize(names.distinct())
    return materialize(firsts.join(broadcast_if_small(names, names.count()), "h", "left_semi"))


def _lines_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    return materialize(_texts(docs, places.select("id", "row", "pos")).dropDuplicates(["h"]))


def _settled(docs: DataFrame, members: DataFrame, places: DataFrame) -> DataFrame:
    """(h): lines of hot keys near a line that starts earlier, as far as pivots tell.

    Each round takes the earliest index line of every key that is neither settled nor taken yet
    and compares it with all lines of the key.  Rounds end when one leaves over three quarters of
    the index lines unsettled, so their number is logarithmic.
    """
    lines = _lines_of(docs, places)
    own = members.filter("own")
    gone = used = None
    before = own.count()
    while True:
        left = own if gone is None else own.join(gone, "h", "left_anti").join(used, ["key", "h"], "left_anti")
        pivots = materialize(left.groupBy("key").agg(F.min(F.struct("first", "h", "s")).alias("p")).select("key", F.col("p.h").alias("x"), F.col("p.s").alias("sx")))
        pairs = members.join(pivots, "key").filter((F.col("h") != F.col("x")) & _close(F.col("s"), F.col("sx"))).select("x", F.col("h").alias("y")).distinct()
        found = _later(materialize(pairs), lines, places)
        gone = materialize(found if gone is None else gone.union(found).distinct())
        taken = pivots.select("key", F.col("x").alias("h"))
        used = materialize(taken if used is None else used.union(taken))
        rest = own.join(gone, "h", "left_anti").join(used, ["key", "h"], "left_anti").count()
        if 4 * rest > 3 * before or not rest:
            return gone
        before = rest


def candidates(docs: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((x, y), (h)): pairs of different lines to verify, and lines that are near an earlier one already.

    Repeats of a line meet once.  Where more than ``HOT`` lines share an index key, pivots settle
    lines first, and only pairs whose later line is unsettled are made; so a family of near lines
    makes rows in proportion to its size.
    """
    of = Window.partitionBy("key")
    shared = _keys(docs).repartition("key").withColumn("owned", F.max("own").over(of)).withColumn("low", F.min("h").over(of)).withColumn("high", F.max("h").over(of))
    shared = materialize(shared.filter("owned AND low <> high").select("key", "h", "s", "own"))  # a key of one line makes no pair
    index = materialize(shared.filter("own").select("key", "h", "s").dropDuplicates(["key", "h"]).withColumn("n", F.count(F.lit(1)).over(of)))
    probe = shared.filter("NOT own").dropDuplicates(["key", "h"]).select("key", F.col("h").alias("y"), F.col("s").alias("sy"))
    differ = (F.col("x") != F.col("y")) & _close(F.col("sx"), F.col("sy"))
    pair = [F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")]
    cold, hot = index.filter(F.col("n") <= HOT), index.filter(F.col("n") > HOT)
    x = cold.select("key", F.col("h").alias("x"), F.col("s").alias("sx"))
    several = cold.filter("n > 1").select("key", "h", "s")
    same = several.select("key", F.col("h").alias("x"), F.col("s").alias("sx")).join(several.select("key", F.col("h").alias("y"), F.col("s").alias("sy")), "key").filter((F.col("x") < F.col("y")) & differ)
    keys = hot.select("key", F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("sx")).distinct()
    met = materialize(x.union(keys).join(probe, "key").filter(F.col("x").isNull() | differ).select("key", "x", "y", "sy"))  # x is null: who looks up a hot key
    pairs = met.filter("x IS NOT NULL").select(*pair).union(same.select("x", "y"))
    if hot.isEmpty():
        return materialize(pairs.distinct()), None
    members = hot.select("key", "h", "s", F.lit(True).alias("own")).union(met.filter("x IS NULL").select("key", "y", "sy", F.lit(False))).groupBy("key", "h").agg(F.first("s").alias("s"), F.max("own").alias("own"))
    places = _places(members.select("h"), firsts)
    at = places.select("h", F.struct("id", "row", "pos").alias("first"))
    members = materialize(members.join(at, "h").select("key", "h", "s", "first", "own"))
    gone = _settled(docs, members, places)
    left = materialize(members.join(gone, "h", "left_anti"))
    x, y = [lambda d, c=c: d.select("key", F.col("h").alias(c), F.col("s").alias("s" + c), F.col("first").alias("f" + c)) for c in "xy"]
    late_x = x(left.filter("own")).join(y(members), "key").filter(differ & (F.col("fx") > F.col("fy")))
    late_y = x(members.filter("own")).join(y(left), "key").filter(differ & (F.col("fy") > F.col("fx")))
    return materialize(pairs.union(late_x.select(*pair)).union(late_y.select(*pair)).distinct()), gone


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h): lines within ``TAU`` edits of a different line that starts earlier; ``firsts`` has (h, id, row, pos) of every line."""
    pairs, gone = candidates(docs, firsts)
    places = _places(pairs.select(F.col("x").alias("h")).union(pairs.select("y")), firsts)
    later = _later(pairs, _lines_of(docs, places), places)
    return materialize(later if gone is None else later.union(gone).distinct())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns with the repeated lines taken out of ``text_col``, and ``n_lines`` and ``n_removed``.

    A line goes if an equal line, or one within ``TAU`` edits, starts earlier (in a smaller id, or
    in the same text); lines are judged on the input.  Lines of spaces only stay, as do the texts
    of rows without an id.  Null stays null; rows that share an id are judged as one text each,
    in the order of their texts' hashes, and equal rows keep equal lines.  New columns replace columns of the same name.
    """
    ready(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").withColumn("row", F.xxhash64("text"))
    seen = materialize(occurrences(d))
    firsts = materialize(seen.groupBy("h", "g").agg(F.min(F.struct("id", "row", "pos")).alias("first")).select("h", "g", "first.*"))
    later = near_lines(d, firsts.select("h", "id", "row", "pos"))
    stay = firsts.join(broadcast_if_small(later, later.count()), "h", "left_anti").groupBy("id", F.col("row").alias("key")).agg(F.collect_list("pos").alias("stay"))
    stay = stay.hint("shuffle_hash")  # it grows with the texts, so no size of it is broadcast
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text")).join(stay, ["id", "key"], "left")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = flat(b.column(2))
            starts, ends, first = _spans(data, offsets)
            keep = ~_judged(data, starts, ends)
            ids, texts, stays = b.column(1), b.column(2), b.column(3)
            raw, out, gone = data.tobytes(), [], []
            for k in range(b.num_rows):
                i, j = first[k], first[k + 1]
                if not ids[k].is_valid:
                    keep[i:j] = True
                elif stays[k].is_valid:
                    keep[i + np.asarray(stays[k].values.to_numpy())] = True
                left = np.flatnonzero(keep[i:j]) + i
                gone.append(int(j - i - len(left)))
                out.append(None if not texts[k].is_valid else b"\n".join(raw[starts[t]: ends[t]] for t in left).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_removed"])

    inner = full.select("row", "id", "text", "stay")
    schema = inner.select("row", "text").schema.add("n_lines", "long").add("n_removed", "long")
    r = inner.mapInArrow(run, schema)
    return r.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
