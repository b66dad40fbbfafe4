"""Object-map and exploration analytics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.ordering import position_chunk, running
from wayfold.functions.stats import one
from wayfold.session import materialize, spread

BLOCK = 64


def direction_bin(dx: Column, dy: Column) -> Column:
    """One of eight 45-degree sectors clockwise from north."""
    deg = F.degrees(F.atan2(dx, dy))
    return F.floor(((deg + 360) % 360 + 22.5) / 45) % 8


def _agreeing(a: str, c: str) -> Column:
    """Ordered pairs of an item of array ``a`` and a later one of array ``c`` whose predicted sector agrees."""
    def agrees(p, q):
        true = direction_bin(p["x"] - q["x"], p["y"] - q["y"])
        return F.when((p["idx"] < q["idx"]) & (true == direction_bin(p["px"] - q["px"], p["py"] - q["py"])), 1).otherwise(0)

    def row(p):
        return F.aggregate(c, F.lit(0), lambda acc, q: acc + agrees(p, q))
    return F.aggregate(a, F.lit(0), lambda acc, p: acc + row(p))


def _across_blocks(blocks: DataFrame) -> DataFrame:
    """(map_id, n_agree) for each two blocks of a map.

    Every pair of blocks is a key of its own, so a large map is spread before its blocks meet.  Only full
    blocks have a later one, so maps of a single block take no part.
    """
    last = blocks.filter("block > 0").groupBy("map_id").agg(F.max("block").alias("last"))
    left = blocks.filter(F.size("items") >= BLOCK).join(last, "map_id").filter("block < last")
    left = left.select("map_id", F.col("block").alias("ba"), F.explode(F.sequence(F.col("block") + 1, "last")).alias("bb"), F.col("items").alias("a"))
    right = blocks.filter("block > 0").select("map_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("ba"), F.col("block").alias("bb"), F.col("items").alias("c"))
    pairs = spread(left, "map_id", "ba", "bb").join(spread(right, "map_id", "ba", "bb"), ["map_id", "ba", "bb"])
    return pairs.select("map_id", _agreeing("a", "c").cast("long").alias("n_agree"))


def map_similarity(objects: DataFrame, allow_scale: bool = False, norm: float | None = None) -> DataFrame:
    """Direction, facing and position agreement of predicted and true object maps and their mean.

    ``objects``: (map_id, idx, x, y, facing, px, py, pfacing) with nulls where an object was not
    predicted and a null ``facing`` where the object has none; ``idx`` is dense per map from 0.  The origin
    is one more object of every map's directions.  A map is cut into blocks of 64 objects, made once with
    their sums.  Pairs are counted inside the expression that sees one block against another, so no pair
    becomes a row and no task holds a whole map.
    """
    hit = F.col("px").isNotNull()

    def total(c):
        return F.coalesce(F.sum(F.when(hit, c)), F.lit(0.0))
    x, y, px, py = (F.col(c) for c in ("x", "y", "px", "py"))
    at = (F.col("idx") + 1).cast("long")
    item = F.struct(at.alias("idx"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "px", "py")])
    origin = F.struct(F.lit(0).cast("long").alias("idx"), *[F.lit(0.0).alias(c) for c in ("x", "y", "px", "py")])
    sums = {"n": F.count(F.lit(1)), "m": F.count_if(hit), "pp": total(px * px + py * py), "pg": total(x * px + y * py), "gg": total(x * x + y * y),
            "nf": F.count("facing"), "of": F.count_if(F.col("facing") == F.col("pfacing"))}
    b = objects.groupBy("map_id", F.floor(at / BLOCK).alias("block")).agg(F.collect_list(item).alias("items"), *[c.alias(name) for name, c in sums.items()])
    b = materialize(b.withColumn("items", F.when(F.col("block") == 0, F.array_append("items", origin)).otherwise(F.col("items"))))
    parts = b.select("map_id", *sums, _agreeing("items", "items").cast("long").alias("n_agree"))
    parts = parts.unionByName(_across_blocks(b), allowMissingColumns=True)
    g = parts.groupBy("map_id").agg(*[F.sum(c).alias(c) for c in (*sums, "n_agree")])
    k = F.try_divide("pg", "pp") if allow_scale else F.lit(1.0)
    mse = (k * k * F.col("pp") - 2 * k * F.col("pg") + F.col("gg")) / F.nullif("m", F.lit(0))
    size = F.lit(norm) if norm else F.sqrt(F.col("gg") / F.nullif("m", F.lit(0)))
    base = F.when(size > 0, F.exp(-F.sqrt(F.greatest(mse, F.lit(0.0))) / size)).otherwise(0.0)
    pos = F.when(F.col("m") == 0, 0.0)
    if allow_scale:
        pos = pos.when(F.col("pp") == 0, 0.0)
    g = g.withColumn("pos", pos.otherwise(base * F.col("m") / F.col("n")))
    g = g.withColumn("facing", F.when(F.col("nf") == 0, 1.0).otherwise(F.col("of") / F.nullif("nf", F.lit(0))))
    g = g.withColumn("dir", F.col("n_agree") / (F.col("n") * (F.col("n") + 1) / 2))
    return g.select("map_id", "dir", "facing", "pos", ((F.col("dir") + F.col("facing") + F.col("pos")) / 3).alias("overall"))


MAP_METRICS = ("dir", "facing", "pos", "overall")


def map_curve(maps: DataFrame) -> DataFrame:
    """Mean of the valid map metrics per turn over samples."""
    return maps.filter("valid").groupBy("turn").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in MAP_METRICS])


def map_group_average(maps: DataFrame) -> DataFrame:
    """Valid turns averaged per sample, then over the samples of each group; and the last map alike."""
    per = maps.groupBy("grp", "sample_id").agg(*[F.avg(F.when(F.col("valid"), F.col(c))).alias(c) for c in MAP_METRICS], F.max_by("overall", "turn").alias("last_overall"))
    return per.groupBy("grp").agg(*[F.avg(c).alias(c) for c in MAP_METRICS], F.avg("last_overall").alias("last_overall"))


def average_series(series: DataFrame, carry: bool = False) -> DataFrame:
    """Element-wise mean of variable-length series ``(series_id, turn, value)``, turns dense from 0.

    With ``carry`` a finished series keeps its last value.  Those values are summed per length
    and prefix-summed over turns, so no series is ever padded.
    """
    at = series.groupBy("turn").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    if not carry:
        return at.filter("n > 0").select("turn", (F.col("s") / F.col("n")).alias("mean"))
    last = series.groupBy("series_id").agg(F.max("turn").alias("last"), F.max_by("value", "turn").alias("v"))
    ended = last.groupBy((F.col("last") + 1).alias("turn")).agg(F.sum("v").alias("es"), F.count("v").alias("en"))
    t = at.join(ended, "turn", "left").fillna(0, ["es", "en"])
    t = running(t, [], ["turn"], F.col("es"), "cs", position_chunk("turn"))
    t = running(t, [], ["turn"], F.col("en"), "cn", position_chunk("turn"))
    return t.select("turn", ((F.col("s") + F.col("cs")) / (F.col("n") + F.col("cn"))).alias("mean"))


def pearson(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """r and t per ``by`` with null pairs removed; r is null for constant or too short columns."""
    g = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    r = F.when((F.col("n") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0)))
    g = g.withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return g.select(by, "n", "r", t.alias("t"))


#: Terms of the continued fraction of the incomplete beta function.
TERMS = 200


def _log_gamma(x: Column) -> Column:
    """Stirling's series, ten steps up where it is exact to double precision."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    return series - sum((F.log(x + k) for k in range(1, 10)), F.log(x))


def t_test_p():
    """Function of the columns (t, n): two-sided p value with n - 2 degrees of freedom, NaN for fewer than three rows.

    The regularised incomplete beta function by its continued fraction, folded from the last term.
    """
    def p(t: str, n: str) -> Column:
        t, n = F.col(t), F.col(n).cast("double")
        half, x = (n - 2) / 2, (n - 2) / (n - 2 + t * t)
        turn = x >= (half + 1) / (half + 2.5)
        a, b, z = F.when(turn, 0.5).otherwise(half), F.when(turn, half).otherwise(0.5), F.when(turn, 1 - x).otherwise(x)

        def term(f, m):
            odd = -(a + m - 1) * (a + b + m - 1) * z / ((a + 2 * m - 2) * (a + 2 * m - 1))
            return 1 + odd / (1 + m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)) / f)
        fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), term)
        tail = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(z) + b * F.log1p(-z)) / a / fraction
        return (F.when(t.isNull() | F.isnan(t) | (n < 3), F.lit(float("nan"))).when(x >= 1, 1.0).when(x <= 0, 0.0)
                .when(turn, 1 - tail).otherwise(tail))
    return p


def pearson_table(rows: DataFrame, by: str, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    """Correlation, p value and significance per task."""
    g = pearson(rows, by, x, y).withColumn("p", t_test_p()("t", "n"))
    return g.select(by, "n", "r", "p", (F.col("p") < alpha).alias("significant"))


def set_prf(predicted: DataFrame, correct: DataFrame, keys: list[str], point: list[str]) -> DataFrame:
    """True and false positives, misses, precision, recall and F1 of point sets per key."""
    p = predicted.select(*keys, *point).distinct().withColumn("in_p", F.lit(1))
    c = correct.select(*keys, *point).distinct().withColumn("in_c", F.lit(1))
    g = p.join(c, [*keys, *point], "full").groupBy(*keys).agg(
        F.count_if(F.col("in_p").isNotNull() & F.col("in_c").isNotNull()).alias("tp"), F.count_if(F.col("in_c").isNull()).alias("fp"), F.count_if(F.col("in_p").isNull()).alias("fn"))
    return prf(g)


def prf(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = counts.withColumn("precision", F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)))
    return c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def micro_prf(per_turn: DataFrame) -> DataFrame:
    """The same three numbers from counts summed over all keys."""
    return prf(per_turn.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def nearest_distance(points: DataFrame, explored: DataFrame) -> DataFrame:
    """Distance of each grid point ``(grp, x, y)`` to the closest explored point of its group.

    Search cells double in size round by round.  A point looks at its own and the eight
    neighbouring cells and is settled once it finds something no farther than one cell,
    because nothing outside can be closer.  Without explored points the distance is infinite.
    """
    e = materialize(explored.select("grp", "x", "y").distinct())
    open_ = materialize(points.select("grp", "x", "y").distinct())
    known = open_.join(e.select("grp").distinct(), "grp", "left_semi")
    done = open_.join(e.select("grp").distinct(), "grp", "left_anti").withColumn("distance", F.lit(float("inf")))
    open_ = materialize(known)
    size = 1
    while open_.take(1):
        def cells(df, spread):
            c = df.withColumn("cx", F.floor(F.col("x") / size)).withColumn("cy", F.floor(F.col("y") / size))
            if spread:
                for a in ("cx", "cy"):
                    c = c.withColumn(a, F.explode(F.array(*[F.col(a) + k for k in (-1, 0, 1)])))
            return c
        near = cells(open_, True).join(cells(e, False).select("grp", "cx", "cy", F.col("x").alias("ex"), F.col("y").alias("ey")), ["grp", "cx", "cy"])
        d2 = (F.col("x") - F.col("ex")) * (F.col("x") - F.col("ex")) + (F.col("y") - F.col("ey")) * (F.col("y") - F.col("ey"))
        best = materialize(near.groupBy("grp", "x", "y").agg(F.min(d2).alias("d2")).filter(F.col("d2") <= size * size))
        done = done.unionByName(best.select("grp", "x", "y", F.sqrt(F.col("d2").cast("double")).alias("distance")))
        open_ = materialize(open_.join(best, ["grp", "x", "y"], "left_anti"))
        size *= 2
    return done


def distance_hit_correlation(distances: DataFrame, hits: DataFrame) -> DataFrame:
    """Correlation of distance with having been picked, over correct points; null when constant."""
    j = distances.join(hits.withColumn("hit", F.lit(1.0)), ["grp", "x", "y"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    g = j.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("distance", "hit").alias("c"), F.stddev_pop("distance").alias("sd"), F.stddev_pop("hit").alias("sh"))
    return g.select("n", F.when((F.col("n") >= 2) & (F.col("sd") > 0) & (F.col("sh") > 0), F.try_divide("c", F.col("sd") * F.col("sh"))).alias("corr"))


def task_scores(questions: DataFrame, excluded: list[str]) -> DataFrame:
    """Score totals and accuracy per sample and task, and per sample over the tasks that count."""
    counted = ~F.col("task").isin(excluded)
    g = questions.withColumn("cs", F.when(counted, F.col("score"))).rollup("sample_id", "task").agg(
        F.count("score").alias("n_all"), F.sum("score").alias("s_all"), F.count("cs").alias("n_in"), F.coalesce(F.sum("cs"), F.lit(0.0)).alias("s_in"), F.grouping_id().alias("gid"))
    per_task = F.col("gid") == 0
    n, s = F.when(per_task, F.col("n_all")).otherwise(F.col("n_in")), F.when(per_task, F.col("s_all")).otherwise(F.col("s_in"))
    return g.select(F.coalesce(F.col("sample_id").cast("string"), F.lit("all")).alias("sample"), F.coalesce("task", F.lit("overall")).alias("task"),
                    n.alias("n_total"), s.alias("score"), F.try_divide(s, n).alias("accuracy"))


def exploration_summary(turns: DataFrame, costs: dict[str, float]) -> DataFrame:
    """Per sample: last coverage, steps, action counts and cost, final gain, fail and valid ratios."""
    cost = F.lit(0.0)
    for action, c in costs.items():
        cost = F.when(F.col("action") == action, F.lit(float(c))).otherwise(cost)
    return turns.groupBy("sample_id").agg(
        F.max_by("coverage", "turn").alias("last_coverage"), F.count(F.lit(1)).alias("n_steps"), *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in costs],
        F.sum(cost).alias("action_cost"), F.max_by("gain", "turn").alias("final_gain"), F.avg(F.col("failed").cast("double")).alias("fail_ratio"),
        F.avg(F.col("valid").cast("double")).alias("valid_ratio"))


def exploration_group(summary: DataFrame) -> DataFrame:
    """Mean of every exploration figure over samples."""
    return summary.agg(*[F.avg(c).alias(c) for c in summary.columns if c != "sample_id"])
