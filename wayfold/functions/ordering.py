"""Order-dependent building blocks that never send one whole key to one task.

A window over a hot key runs in a single task.  The helpers here cut every key into
chunks (by position, by time or by hash prefix), solve the chunks separately and join
small per-chunk carries back, so the largest unit of work is one chunk.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.session import materialize

CHUNK = 512


def _before(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, name: str,
            chunk: Column, inclusive: bool = True) -> DataFrame:
    """Prefix sum of ``value`` per key; ``chunk`` must be monotone in the ordering."""
    c = df.withColumn("_chunk", chunk).withColumn("_v", value)
    carry = c.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_v"))
    carry = carry.select(*keys, "_chunk", F.coalesce(F.sum("_v").over(_before(keys, "_chunk")), F.lit(0)).alias("_carry"))
    upto = 0 if inclusive else -1
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    local = c.withColumn("_local", F.coalesce(F.sum("_v").over(w), F.lit(0)))
    return local.join(carry, [*keys, "_chunk"]).withColumn(name, F.col("_local") + F.col("_carry")).drop("_chunk", "_v", "_local", "_carry")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence, name: str, chunk: Column, start: int = 0) -> DataFrame:
    """Dense row number per key (from ``start``); ``chunk`` must be monotone in the ordering."""
    return running(df, keys, order, F.lit(1), name, chunk, inclusive=False).withColumn(name, (F.col(name) + start).cast("long"))


def numbered_led(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, chunk: Column, leads: dict[str, str], start: int = 0) -> DataFrame:
    """Dense row number per key, and of the next row ``{output: input column}`` and whether there is one (``has_next``).

    ``chunk`` must be monotone in the ordering, and no two rows of a key may tie.  Rows are shuffled
    once, by key and chunk; the window inside the chunk and the chunk's size and first row share
    that exchange.  The last row of a chunk takes the first of the key's next chunk.
    """
    c = df.withColumn("_chunk", chunk)
    c = c.repartition(*keys, "_chunk")
    rest = [k for k in c.columns if k not in {*keys, *order, "_chunk"}]
    first = F.struct(*order, *rest)  # all columns, so that both branches read the same exchange
    carry = c.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), F.min(first).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    carry = carry.select(*[F.col(k).alias(f"_at_{k}") for k in [*keys, "_chunk"]], F.coalesce(F.sum("_n").over(_before(keys, "_chunk")), F.lit(0)).alias("_carry"), F.lead("_first").over(w).alias("_then"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    near = F.struct(*[F.col(v).alias(o) for o, v in leads.items()])
    local = c.withColumn("_local", F.row_number().over(w) - 1).withColumn("_next", F.lead(near).over(w))
    at = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in [*keys, "_chunk"]]  # keeps rows without a key and the shared exchange
    j = local.join(carry, functools.reduce(Column.__and__, at)).withColumn(name, (F.col("_local") + F.col("_carry") + start).cast("long"))
    out = {o: F.when(F.col("_next").isNotNull(), F.col(f"_next.{o}")).otherwise(F.col(f"_then.{v}")) for o, v in leads.items()}
    return j.withColumns(out | {"has_next": F.col("_next").isNotNull() | F.col("_then").isNotNull()}).drop("_chunk", "_local", "_carry", "_next", "_then", *[f"_at_{k}" for k in [*keys, "_chunk"]])


def position_chunk(pos: str) -> Column:
    return F.floor(F.col(pos) / CHUNK)


def hash_of(seed: str, *ids: str | Column) -> Column:
    """Reproducible random key of a row: md5 over the seed and its stable identifiers."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]))


def hash_int(h: Column) -> Column:
    """48-bit integer from the first twelve hex digits of a hash."""
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long")


def hash_ranked(df: DataFrame, keys: Sequence[str], seed: str, ids: Sequence[str], name: str) -> DataFrame:
    """1-based random rank per key: rows ordered by hash, chunked by its leading digits."""
    h = df.withColumn("_h", hash_of(seed, *ids))
    return numbered(h, keys, ["_h", *ids], name, F.substring("_h", 1, 3), start=1).drop("_h")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """1-based row number per key by any ordering, from one distributed sort.

    The sorted rows are written once with order-preserving ids; ranks then follow from
    per-partition counts, so a key may span any number of tasks.
    """
    return _sorted_positions(df, keys, order, name=name, sums={})


def ranked_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rank: str,
                   sums: dict[str, str]) -> DataFrame:
    """``ranked`` plus inclusive prefix sums ``{output: input column}`` in the same order."""
    return _sorted_positions(df, keys, order, rank, sums)


def _sorted_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, sums: dict[str, str]) -> DataFrame:
    mid, part = "_mid", "_part"
    s = materialize(df.orderBy(*keys, *order).withColumn(mid, F.monotonically_increasing_id())).withColumn(part, F.shiftright(F.col(mid), 33))
    per = s.groupBy(*keys, part).agg(F.min(mid).alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = _before(keys, part)
    per = per.select(*keys, part, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                     *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_c_{o}") for o in sums])
    if sums:
        w = Window.partitionBy(*keys, part).orderBy(mid).rowsBetween(Window.unboundedPreceding, 0)
        s = s.select("*", *[F.sum(c).over(w).alias(f"_l_{o}") for o, c in sums.items()])
    s = s.join(per, [*keys, part]).withColumn(name, (F.col(mid) - F.col("_first") + F.col("_off") + 1).cast("long"))
    for o in sums:
        s = s.withColumn(o, F.col(f"_l_{o}") + F.col(f"_c_{o}"))
    return s.drop(mid, part, "_first", "_off", *[f"_{k}_{o}" for o in sums for k in "lc"])


def carried_forward(df: DataFrame, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Last non-null ``value`` at or before each row in one global order (an as-of look-up).

    The sorted rows are written once; only the last value of each partition travels further.
    """
    mid, part = "_mid", "_part"
    s = materialize(df.orderBy(*order).withColumn(mid, F.monotonically_increasing_id())).withColumn(part, F.shiftright(F.col(mid), 33))
    per = s.groupBy(part).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(mid))).alias("_last"))
    per = per.select(part, F.last("_last", ignorenulls=True).over(_before([], part)).alias("_carry"))
    w = Window.partitionBy(part).orderBy(mid).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_local", F.last(value, ignorenulls=True).over(w)).join(per, part)
    return s.withColumn(name, F.coalesce("_local", "_carry")).drop(mid, part, "_local", "_carry")


def average_ranked(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank (ties share the mean of their positions) per key."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    r = ranked_running(counts, keys, [value], "_r", {"_upto": "_n"})
    r = r.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(r, [*keys, value])


def discounted_suffix(df: DataFrame, keys: Sequence[str], pos: str, value: str, g: float, out: str,
                      level: int = 0) -> DataFrame:
    """``out[i] = sum over j >= i of g^(j-i) * value[j]`` for dense integer positions per key.

    Chunk sums form a series of the same kind with ratio ``g**chunk``; the recursion ends
    once that ratio is numerically nothing or the series is a quarter-millionth of the input.
    """
    if g == 0:
        return df.withColumn(out, F.col(value))
    if g < 1e-150 or (g == 1 and level >= 2):
        w = Window.partitionBy(*keys).orderBy(F.col(pos).desc())
        if g == 1:
            return df.withColumn(out, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        nxt = df.select(*keys, (F.col(pos) - 1).alias(pos), F.col(value).alias("_next"))
        return df.join(nxt, [*keys, pos], "left").withColumn(out, F.col(value) + g * F.coalesce("_next", F.lit(0.0))).drop("_next")
    size = CHUNK if g == 1 else max(2, min(CHUNK, int(280 / -math.log10(g))))
    c = f"_c{level}"
    t = materialize(df.withColumn(c, F.floor(F.col(pos) / size)))  # read by both the chunk sums and the local sums
    scale = F.pow(F.lit(float(g)), F.col(pos) - F.col(c) * size) if g != 1 else F.lit(1.0)
    w = Window.partitionBy(*keys, c).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn(f"_l{level}", F.sum(F.col(value) * scale).over(w) / scale)
    if not t.filter(F.col(c) > 0).take(1):
        return t.withColumn(out, F.col(f"_l{level}")).drop(c, f"_l{level}")
    chunks = t.groupBy(*keys, c).agg(F.sum(F.col(value) * scale).alias("_t"))
    carry = discounted_suffix(chunks, keys, c, "_t", float(g) ** size, f"_k{level}", level + 1)
    carry = carry.select(*keys, (F.col(c) - 1).alias(c), F.col(f"_k{level}"))
    tail = F.pow(F.lit(float(g)), (F.col(c) + 1) * size - F.col(pos)) if g != 1 else F.lit(1.0)
    return (t.join(carry, [*keys, c], "left")
            .withColumn(out, F.col(f"_l{level}") + tail * F.coalesce(F.col(f"_k{level}"), F.lit(0.0)))
            .drop(c, f"_l{level}", f"_k{level}"))
