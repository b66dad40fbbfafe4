"""Small statistical expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.session import materialize

TINY = 1e-8


def r6(c: Column | str) -> Column:
    """Round to six places; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def one(df: DataFrame) -> Column:
    """All columns of a one-row aggregate as a scalar subquery (a struct)."""
    return df.select(F.struct("*")).scalar()


def with_group(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Attach per-group aggregates by join: partial aggregation first, skew-splittable join after."""
    return df.join(df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]), by)


def masked_mean(x: Column, mask: Column) -> Column:
    return F.sum(x * mask) / (F.sum(mask) + TINY)


def whiten(df: DataFrame, value: str, mask: Column, out: str, keep_mean: bool = False,
           costly: bool = False) -> DataFrame:
    """(x - mean) / std over the masked rows of the whole frame, unbiased variance.

    The frame is read twice, for the moments and for the rows; ``costly`` writes it first.
    """
    df = materialize(df) if costly else df
    st = df.filter(mask).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("a"), F.var_pop(value).alias("v"))
    st = st.withColumn("mu", F.expr(f"n * a / (n + {TINY})"))
    st = st.withColumn("var", F.expr(f"(n * v + n * (a - mu) * (a - mu)) / (n + {TINY}) * try_divide(n, n - 1)"))
    s = one(st.select("mu", "var"))
    z = (F.col(value) - s["mu"]) / F.sqrt(s["var"] + TINY)
    return df.withColumn(out, z + s["mu"] if keep_mean else z)
