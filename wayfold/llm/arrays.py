"""Words of Arrow text columns as numpy arrays: boundaries, hashes and joined output.

A batch of texts is one byte array with offsets.  Word boundaries come from a byte mask and word
hashes from differences of one running polynomial sum, so no Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.ordering import ranked
from wayfold.session import configure, materialize

BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: The separators of ``[^\x20\x09-\x0D]+`` by byte value.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: adaptive execution and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")  # rows here hold texts, vectors and hashes, which don't shrink as files
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values (two multiply-and-shift rounds)."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LETTER = mixed(np.arange(256, dtype=np.uint64), 7)


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    if n > 4 * BLOCK:  # one very long word: not kept
        return powers(base, n)
    key = int(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        _POWERS[key] = powers(base, max(n, BLOCK + 1))
    return _POWERS[key][:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in order, and the first word of each text (with a closing entry)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    starts = step == 1
    ends = step == -1
    cuts = offsets[1:-1]  # a word ends with its text even where no separator follows
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    starts[cuts] = True
    ends[cuts] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``data[start:end]``; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(int(np.searchsorted(ends, lo + BLOCK, "right")), i + 1)
        seg = data[lo: ends[j - 1]]
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(LETTER[seg] * _power(BASE, len(seg)), out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * _power(INVERSE, len(seg) + 1)[a] + (b - a).astype(np.uint64)
        i = j
    return mixed(out)


def ids_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lists(values: np.ndarray, offsets: np.ndarray, type_: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type_))


def broadcast_if_small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """A side of at most ``most`` narrow rows is broadcast; beyond that Spark shuffles as usual."""
    return F.broadcast(df) if rows <= most else df


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) with ``place``: the id, or, where an id has different texts, numbers of (id, hash of the text) in order.

    Null ids have no place.  Only ids and hashes are shuffled to find out.
    """
    keyed = docs.withColumn("_hash", F.xxhash64("text"))
    named = keyed.filter("id IS NOT NULL")
    clash = named.groupBy("id").agg(F.min("_hash").alias("a"), F.max("_hash").alias("b")).filter("a <> b")
    if not clash.take(1):
        return docs.withColumn("place", F.col("id"))
    numbers = ranked(named.select("id", "_hash").distinct(), [], ["id", "_hash"], "place").select(F.col("id").alias("_id"), F.col("_hash").alias("_of"), "place")
    return keyed.join(materialize(numbers), (F.col("id") == F.col("_id")) & (F.col("_hash") == F.col("_of")), "left").select("id", "text", "place")
