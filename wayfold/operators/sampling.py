"""Splits, subsets, resampling and mixing.  Randomness is a hash of a seed and a stable key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.ordering import hash_int, hash_of, hash_ranked, numbered, ranked
from wayfold.functions.stats import one, with_group


def largest_remainder(n: Column, ratios: list[float]) -> list[Column]:
    """Split n by ratios: whole parts first, what is missing goes to the largest remainders in order."""
    total = float(sum(ratios))
    if total <= 0 or min(ratios) < 0:
        raise ValueError(f"invalid ratios {ratios}")
    target = [n * F.lit(float(x)) / total for x in ratios]
    base = [F.floor(x) for x in target]
    rest = [x - b for x, b in zip(target, base)]
    missing = n - sum(base, F.lit(0))
    out = []
    for i, r in enumerate(rest):
        ahead = sum((F.when((rest[j] > r) | ((rest[j] == r) & F.lit(j < i)), 1).otherwise(0) for j in range(len(rest)) if j != i), F.lit(0))
        out.append(base[i] + F.when(ahead < missing, 1).otherwise(0))
    return out


def split_by_group(df: DataFrame, group: str, ratios: list[float], names: list[str], seed: str) -> DataFrame:
    """Group-disjoint splits with largest-remainder group counts, groups in hash order."""
    groups = hash_ranked(df.select(group).distinct(), [], seed, [group], "_rank")
    n = df.agg(F.countDistinct(group).alias("n"))
    for i, quota in enumerate(largest_remainder(F.col("n"), ratios)):
        n = n.withColumn(f"u{i}", quota + (F.col(f"u{i - 1}") if i else F.lit(0)))
    upto, split = one(n), None
    for i, name in enumerate(names):
        inside = F.col("_rank") <= upto[f"u{i}"]
        split = F.when(inside, name) if split is None else split.when(inside, name)
    return df.join(groups.select(group, split.alias("split")), group)


def split_report(split: DataFrame, group: str) -> DataFrame:
    return split.groupBy("split").agg(F.countDistinct(group).alias("n_groups"), F.count(F.lit(1)).alias("n_samples"))


def sample_within_group(df: DataFrame, group: str, item: str, ratio: float, seed: str) -> DataFrame:
    """round(n * ratio) items of every group, at least one, half-even rounding."""
    r = hash_ranked(with_group(df, [group], _n=F.count(F.lit(1))), [group], seed, [group, item], "_rank")
    k = F.greatest(F.lit(1), F.least(F.col("_n"), F.rint(F.col("_n") * F.lit(ratio)).cast("long")))
    return r.filter(F.col("_rank") <= k).drop("_rank", "_n")


def mini_sample(df: DataFrame, idx: str, ratio: float, seed: str) -> DataFrame:
    """int(n * ratio) rows without replacement, at least one, in the original order."""
    n = one(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    k = F.when(F.lit(ratio) >= 1, n).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(ratio))))
    return hash_ranked(df, [], seed, [idx], "_rank").filter(F.col("_rank") <= k).drop("_rank").orderBy(idx)


def reweight_dataset(df: DataFrame, idx: str, size: int | None = None, weight: float | None = None, seed: str = "reweight") -> DataFrame:
    """Resample with replacement to ``size`` rows and/or int(rows * weight) rows: hash-drawn positions joined to numbered rows."""
    n = df.count()
    for k in (size, None if weight is None else int((size if size is not None else n) * weight)):
        if k is None:
            continue
        rows = ranked(df, [], [idx], "_i").withColumn("_i", F.col("_i") - 1)
        draws = df.sparkSession.range(1, k + 1).withColumnRenamed("id", "draw")
        draws = draws.withColumn("_i", hash_int(hash_of(seed, "draw")) % n)
        df, n, idx = draws.join(rows.drop("draw"), "_i").drop("_i"), k, "draw"
    return df


def mix_datasets(parts: dict[str, DataFrame], idx: str, strategy: str = "concat", probs: list[float] | None = None) -> DataFrame:
    """Concatenate named datasets, or interleave them by probability.

    The i-th row of a source of probability p sits at time i / p.  ``interleave_under`` stops when
    the first source runs out, ``interleave_over`` repeats sources until the last one has, and
    ``interleave_once`` keeps every row once.
    """
    frames = [df.withColumn("_dataset_name", F.lit(name)) for name, df in parts.items()]
    cat = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if strategy == "concat":
        return cat
    probs = probs or [1.0 / len(parts)] * len(parts)
    p = F.element_at(F.create_map(*[x for n, q in zip(parts, probs) for x in (F.lit(n), F.lit(float(q)))]), F.col("_dataset_name"))
    rows = ranked(cat, ["_dataset_name"], [idx], "_i").withColumn("_p", p)
    size = cat.groupBy("_dataset_name").agg(F.count(F.lit(1)).alias("_n")).withColumn("_end", F.col("_n") / p)
    ends = one(size.agg(F.min("_end").alias("first"), F.max("_end").alias("last")))
    if strategy == "interleave_under":
        rows = rows.filter(F.col("_i") / F.col("_p") <= ends["first"])
    elif strategy == "interleave_over":
        rows = rows.join(size.select("_dataset_name", "_n"), "_dataset_name")
        laps = F.ceil(ends["last"] * F.col("_p") / F.col("_n"))
        rows = rows.withColumn("_laps", laps).withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_laps") - 1) / 1024))))
        rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_laps") - 1, F.lit(1023))))).withColumn("_lap", F.col("_a") * 1024 + F.col("_b"))
        rows = rows.filter("_lap < _laps").withColumn("_i", F.col("_i") + F.col("_lap") * F.col("_n"))
        rows = rows.filter(F.col("_i") / F.col("_p") <= ends["last"]).drop("_n", "_laps", "_a", "_b", "_lap")
    elif strategy != "interleave_once":
        raise ValueError(f"unknown mixing strategy {strategy!r}")
    return rows.withColumn("mix_time", F.col("_i") / F.col("_p")).drop("_i", "_p")
