"""Compression of vectors to one byte a part: codebooks in integers, entries found through memoised grid cells.

A vector's components are put on an integer grid and cut into parts.  Each part position has a
codebook that starts from the rows with the smallest ids and moves to its parts' floored means in a
few rounds.  The nearest entry of a part is found through the coarse cell the part lies in: for each
cell met, a task keeps the entries whose least distance to the cell's box is not above the smallest
of all entries' greatest distances.  No other entry can be nearest, or tie, anywhere in the box, so
only those are compared with the part itself.  A round is one pass over the rows without a shuffle
of vectors: tasks hand on one sum a part and entry.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from wayfold.llm.arrays import broadcast_if_small, ready
from wayfold.llm.vectors import dimension, gathered, grid, narrowed
from wayfold.session import materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Side of a coarse cell as a power of two; it changes the time, not the result.
SIDE_BITS = 4
#: Cells a task remembers for each part position; beyond it starts anew.
CELLS = 1 << 15
ROWS = 4096


class Cells:
    """Nearest entries of one part position's codebook, through the cells met so far."""

    def __init__(self, book: np.ndarray, side_bits: int, most: int):
        self.book, self.bits, self.most = book.astype(np.int64), side_bits, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.entries = np.zeros(0, np.int64)

    def _add(self, cells: np.ndarray) -> None:
        lo = cells[:, None, :] << self.bits
        hi = lo + ((1 << self.bits) - 1)
        e = self.book[None]
        least = np.maximum(np.maximum(lo - e, e - hi), 0)
        most = np.maximum(np.abs(e - lo), np.abs(hi - e))
        least, most = (least * least).sum(2), (most * most).sum(2)
        keep = least <= most.min(1, keepdims=True)
        n = keep.sum(1)
        self.begin = np.append(self.begin, len(self.entries) + np.cumsum(n) - n)
        self.count = np.append(self.count, n)
        self.entries = np.append(self.entries, np.nonzero(keep)[1])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every part; ties go to the lower entry."""
        cells, which = _distinct(x >> self.bits)
        keys = [c.tobytes() for c in cells]
        if len(self.known) + len(keys) > self.most:
            self.clear()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        for s in range(0, len(new), 1024):
            part = new[s: s + 1024]
            for i in part:
                self.known[keys[i]] = len(self.known)
            self._add(cells[part])
        slot = np.array([self.known[k] for k in keys], np.int64)[which]
        n = self.count[slot]
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(x)), n)
        entry = self.entries[np.repeat(self.begin[slot] - first, n) + np.arange(len(row))]
        gap = x[row] - self.book[entry]
        far = (gap * gap).sum(1)
        low = np.minimum.reduceat(far, first)
        best = np.minimum.reduceat(np.where(far == low[row], entry, len(self.book)), first)
        return best, low


def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and which of them each row is."""
    low = cells.min(0)
    span = cells.max(0) - low + 1
    if math.prod(span.tolist()) >= 1 << 62:
        rows, which = np.unique(cells, axis=0, return_inverse=True)
        return rows, which.reshape(-1)
    key = (cells - low) @ np.append(np.cumprod(span[:0:-1])[::-1], 1)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return cells[first], which


def _cut(g: np.ndarray, parts: int) -> np.ndarray:
    return g.reshape(len(g), parts, g.shape[1] // parts)


def seeds(rows: DataFrame, d: int, entries: int) -> np.ndarray:
    """The grid vectors of the smallest ids; of rows with one id the smallest vector."""

    def run(batches):
        held: dict[int, tuple] = {}
        for b in batches:
            g, ok = grid(b.column(1), d)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            ok &= ~np.asarray(b.column(0).is_null())
            at = np.flatnonzero(ok)
            for i in at[np.argsort(ids[at], kind="stable")]:
                k, v = int(ids[i]), tuple(g[i].tolist())
                if len(held) >= entries and k > max(held):
                    break
                held[k] = min(v, held.get(k, v))
                if len(held) > entries:
                    del held[max(held)]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([list(v) for v in held.values()], pa.list_(pa.int64()))], ["id", "g"])

    r = rows.select("id", "v").mapInArrow(run, "id long, g array<long>").groupBy("id").agg(F.min("g").alias("g")).orderBy("id").limit(entries)
    return np.array([x["g"] for x in r.collect()], np.int64).reshape(-1, d)


def _moved(rows: DataFrame, d: int, parts: int, books: np.ndarray, side_bits: int) -> np.ndarray:
    """The codebooks after one round: floored means of the parts each entry is nearest to."""
    width = d // parts

    def run(batches):
        cells = [Cells(b, side_bits, CELLS) for b in books]
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for b in gathered(batches, ROWS):
            g, ok = grid(b.column(0), d)
            g = _cut(g[ok], parts)
            for p in range(parts if len(g) else 0):
                near, _ = cells[p].nearest(g[:, p])
                n[p] += np.bincount(near, minlength=books.shape[1])
                for k in range(width):  # sums of a batch are below 2**53, so exact
                    total[p, :, k] += np.bincount(near, g[:, p, k], minlength=books.shape[1]).astype(np.int64)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), *[pa.array(total[p, e, k]) for k in range(width)]], ["p", "e", "n", *[f"t{k}" for k in range(width)]])

    sums = rows.select("v").mapInArrow(run, "p long, e long, n long, " + ", ".join(f"t{k} long" for k in range(width)))
    out = books.copy()
    for r in sums.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(f"t{k}").alias(f"t{k}") for k in range(width)]).collect():  # parts * entries rows at most
        out[r["p"], r["e"]] = [r[f"t{k}"] // r["n"] for k in range(width)]
    return out


def digest(books: np.ndarray) -> str:
    """sha256 over all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, side_bits: int = SIDE_BITS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) of the rows that take part, and the codebooks [part, entry, position].

    Rows take no part if their vector is null or empty, holds null or non-finite components, has
    another length than that of the smallest id, or a component beyond 2**20 either way.  Codes hold
    two hex digits a part, so ``entries`` is 256 at most.  Rows without an id or label are coded
    too; null labels share one ``label_error``.  Repeated rows each have their own result.  With
    fewer ids than ``entries`` the codebooks are shorter; an empty table gives no rows.
    """
    spark = ready(df.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("a code holds 1 to 256 entries a part")
    rows = narrowed(df, id_col, vector_col, label=label_col)
    label_type = dict(rows.dtypes)["label"]
    d = dimension(rows)
    if d % parts:
        raise ValueError(f"vectors of {d} components can't be cut into {parts} equal parts")
    books = _cut(seeds(rows, d, entries), parts).transpose(1, 0, 2) if d else np.zeros((parts, 0, 0), np.int64)
    if not books.size:
        empty = spark.createDataFrame([], f"id long, label {label_type}, code string, error long, label_error long")
        return empty, np.zeros((parts, 0, d // parts), np.int64)
    for _ in range(rounds):
        books = _moved(rows, d, parts, books, side_bits)

    def run(batches):
        cells = [Cells(b, side_bits, CELLS) for b in books]
        for b in gathered(batches, ROWS):
            g, ok = grid(b.column(1), d)
            keep = pa.array(ok)
            g = _cut(g[ok], parts)
            code, error = np.zeros((len(g), parts), np.uint8), np.zeros(len(g), np.int64)
            for p in range(parts if len(g) else 0):
                near, far = cells[p].nearest(g[:, p])
                code[:, p] = near
                error += far
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(2).filter(keep), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    coded = materialize(rows.mapInArrow(run, f"id long, label {label_type}, code string, error long"))
    by_label = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(broadcast_if_small(by_label, by_label.count()), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("id", "label", "code", "error", "label_error"), books


def decompress(codes: DataFrame, books: np.ndarray, code_col: str = "code", scale: int = 256) -> DataFrame:
    """``codes`` with the vector that each code stands for (the middle of its grid cell); null codes give null."""
    parts = len(books)

    def run(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index(code_col)).to_pylist()
            out = []
            for c in text:
                e = np.frombuffer(bytes.fromhex(c), np.uint8) if c is not None else None
                out.append(None if e is None else ((books[np.arange(parts), e] + 0.5) / scale).reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], [*b.schema.names, "vector"])

    schema = StructType([*codes.schema.fields, StructField("vector", ArrayType(DoubleType()))])
    return codes.mapInArrow(run, schema)
