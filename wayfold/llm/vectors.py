"""Vector columns as numpy matrices: which rows take part, integer grids, and packed bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import broadcast_if_small
from wayfold.session import materialize

#: Integer components beyond this take no part: squares and products of them would not fit a long.
LIMIT = 1 << 28


def narrowed(df: DataFrame, id_col: str, vector_col: str, **more: str) -> DataFrame:
    """(id, v, more...): the columns an operator needs, under names of its own."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *[F.col(c).alias(k) for k, c in more.items()])


def dimension(rows: DataFrame) -> int:
    """Length of the vectors: that of the smallest (id, length) whose vector is not null or empty; 0 without any."""
    r = rows.filter(F.size("v") > 0).agg(F.min(F.struct(F.col("id").isNull(), "id", F.size("v").alias("d"))).alias("m")).first()
    return r["m"]["d"] if r["m"] else 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column as doubles, and which of them have ``d`` finite components."""
    n = len(column)
    x = np.zeros((n, d))
    if not n or not d:
        return x, np.zeros(n, bool)
    size = np.asarray(column.value_lengths().fill_null(-1))
    ok = size == d
    values = column.filter(pa.array(ok)).flatten()
    if values.null_count:
        holes = np.asarray(values.is_null()).reshape(-1, d).any(1)
        values = values.fill_null(0.0)
    else:
        holes = np.zeros(int(ok.sum()), bool)
    x[ok] = np.asarray(values).reshape(-1, d)
    ok[np.flatnonzero(ok)[holes]] = False
    return x, ok & np.isfinite(x).all(1)


def grid(column: pa.Array, d: int, scale: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` of every component, and which rows take part."""
    x, ok = matrix(column, d)
    with np.errstate(all="ignore"):
        g = np.floor(x * scale)
    ok &= (np.abs(g) <= LIMIT).all(1)
    g[~ok] = 0
    return g.astype(np.int64), ok


def packed(x: np.ndarray) -> pa.Array:
    """One binary value a row, in the type of the matrix."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, kind, d: int) -> np.ndarray:
    """The matrix of a column that ``packed`` made."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), d)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def one_an_id(valid: DataFrame, *columns: str) -> DataFrame:
    """``valid`` (id, columns) with one row an id, the smallest by its columns; where none repeats, nothing but ids is shuffled."""
    twice = materialize(valid.groupBy("id").count().filter("count > 1").select("id"))
    n = twice.count()
    if not n:
        return valid
    few = broadcast_if_small(twice, n)
    one = valid.join(few, "id").groupBy("id").agg(F.min(F.struct(*columns)).alias("m")).select("id", *[f"m.{c}" for c in columns])
    return materialize(valid.join(few, "id", "left_anti").unionByName(one))
