"""Mixing sources to target token counts by entropy balancing.  Only DataFrame functions.

Every document gets a rate between 0 and ``MOST`` copies.  Among all rates that meet a source's
token target, those nearest to one copy each in relative entropy have the form
``least(MOST, exp(lambda * size))``; the convex dual in ``lambda`` is solved per source by Newton
steps.  One step is one aggregation of all documents' gradient and curvature, taken over the
counts of (source, size), in which all documents are contained.

Rates become whole copies by a shared offset: a document is copied once for every whole number
that ``rate + hash`` reaches, and each source's offset is the weighted quantile at which the words
taken meet the target.  The quantile is found by histograms, each 1024 times finer.  What the
document at the quantile leaves open is filled in the same way with documents of at most
half of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.ordering import ranked
from wayfold.llm.arrays import ready
from wayfold.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
MOST = 2
BINS = 1024
EXACT = 1e-7


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def water_filled(sources: DataFrame, share: float) -> DataFrame:
    """Adds ``target``: ``share`` of all words by weight, where none exceeds ``MOST`` times its source.

    One round caps the sources above their bound; the rest is shared again until none is above.
    """
    s = sources.withColumn("capped", F.lit(False))
    while True:
        t = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(F.col("capped"), MOST * F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("w")).first()
        if not t["w"]:
            return s.withColumn("target", MOST * F.col("source_size").cast("double")).drop("capped")
        level = (share * t["all"] - t["held"]) / t["w"]
        above = ~F.col("capped") & (F.col("weight") * F.lit(level) > MOST * F.col("source_size"))
        if not s.filter(above).take(1):
            return s.withColumn("target", F.when(F.col("capped"), MOST * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.lit(level))).drop("capped")
        s = materialize(s.withColumn("capped", F.col("capped") | above))


def _rate(x: str = "x") -> Column:
    """Tilted rate; a source whose target is its bound has no finite ``lam`` and the full rate."""
    return F.when(F.col("lam").isNull(), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col("lam") * F.col(x), F.lit(700.0)))))


def tilts(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, lam): the dual's solution per source, from counts ``n`` of documents by (sid, size).

    ``x`` is the size over the source's mean size.  Newton steps are kept inside the bracket that
    the gradient's signs have shown; outside it the bracket is halved or, still open, doubled.
    """
    shape = cells.groupBy("sid").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.col("size") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("heavy"))
    free = sources.filter(F.col("target") < MOST * F.col("source_size") * (1 - EXACT)).join(shape, "sid")
    state = materialize(free.select("sid", "target", "mean", (F.log(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("heavy")).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("off")))
    for _ in range(100):
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < EXACT:
            break
        c = cells.join(state, "sid").withColumn("x", F.col("size") / F.col("mean")).withColumn("r", _rate())
        got = c.groupBy("sid").agg(F.sum(F.col("n") * F.col("size") * F.col("r")).alias("words"), F.sum(F.when(F.col("r") < MOST, F.col("n") * F.col("size") * F.col("x") * F.col("r")).otherwise(0.0)).alias("bend"))
        s = state.join(got, "sid").withColumn("g", F.col("words") - F.col("target"))
        s = s.withColumn("lo", F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("g") >= 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.when(F.col("bend") > 0, F.col("lam") - F.col("g") / F.col("bend"))
        inside = (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi")))
        wide = F.when(F.col("lo").isNull(), F.col("lam") - 1 - F.abs("lam")).when(F.col("hi").isNull(), F.col("lam") + 1 + F.abs("lam")).otherwise((F.col("lo") + F.col("hi")) / 2)
        off = F.abs("g") / F.col("target")
        state = materialize(s.select("sid", "target", "mean", F.when(off < EXACT, F.col("lam")).when(F.coalesce(inside, F.lit(False)), step).otherwise(wide).alias("lam"), "lo", "hi", off.alias("off")))
    return state.select("sid", "lam", "mean")


def _cuts(events: DataFrame, targets: DataFrame, nearest: bool) -> DataFrame:
    """(sid, cut, rest): the events below ``cut`` have words up to the target or nearest to it; ``rest`` are those missing."""
    state = materialize(targets.select("sid", "target", F.lit(-float(MOST)).alias("lo"), F.lit(float(MOST)).alias("hi"), F.lit(0.0).alias("below"), F.lit(0.0).alias("inside"), F.lit(2).cast("long").alias("n")))
    while state.filter("n > 1 AND hi - lo > 1e-15").take(1):
        e = events.join(state.filter("n > 1 AND hi - lo > 1e-15"), "sid").filter("e >= lo AND e < hi")
        bin_ = F.least(F.floor((F.col("e") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        h = e.groupBy("sid", "target", "lo", "hi", "below", bin_.alias("bin")).agg(F.sum("size").cast("double").alias("words"), F.count(F.lit(1)).alias("k"))
        w = Window.partitionBy("sid").orderBy("bin")  # at most BINS rows for each source
        h = h.withColumn("upto", F.col("below") + F.sum("words").over(w)).withColumn("last", F.lead("bin").over(w).isNull())
        hit = h.filter("(upto >= target AND upto - words < target) OR (last AND upto < target)")
        width = (F.col("hi") - F.col("lo")) / BINS
        new = hit.select("sid", "target", (F.col("lo") + F.col("bin") * width).alias("lo"), F.when(F.col("bin") == BINS - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), (F.col("upto") - F.col("words")).alias("below"), F.col("words").alias("inside"), F.col("k").alias("n"))
        kept = state.join(new.select("sid"), "sid", "left_anti").withColumn("n", F.least("n", F.lit(1).cast("long")))
        state = materialize(new.unionByName(kept))
    whole = F.col("target") >= F.col("below") + (F.col("inside") / 2 if nearest else F.col("inside"))
    return state.select("sid", F.when(whole, F.col("hi")).otherwise(F.col("lo")).alias("cut"), (F.col("target") - F.col("below") - F.when(whole, F.col("inside")).otherwise(0.0)).alias("rest"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) for every document.

    Sources in code point order, null last as a source of its own, get ``weights`` in turn and
    ``share`` of all words, at most ``MOST`` times their own; ``copies`` is 0 to ``MOST``.  Null
    and empty texts have size 0 and one copy.  Rows that repeat an id get the same number of
    copies if their texts have equal sizes.  An empty table gives an empty result.
    """
    ready(docs.sparkSession)
    base = materialize(sizes(docs, id_col, source_col, text_col))
    s = ranked(base.groupBy("source").agg(F.sum("size").alias("source_size")), [], [F.col("source").asc_nulls_last()], "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = materialize(water_filled(materialize(s.withColumn("weight", weight)), share))
    named = base.join(s.withColumnRenamed("source", "_s").select("_s", "sid"), F.col("source").eqNullSafe(F.col("_s"))).select("sid", "size")
    cells = materialize(named.filter("size > 0").groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")))
    s = materialize(s.join(tilts(cells, s), "sid", "left"))
    rated = base.join(s.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rated = rated.withColumn("x", F.col("size") / F.col("mean")).withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate()))
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("mix")), 11) / F.lit(float(1 << 53)))
    rated = materialize(rated.withColumn("at", F.col("rate") + u).select("id", "source", "sid", "size", "source_size", "target", "rate", "at"))
    events = rated.filter("size > 0").select("sid", "size", F.explode(F.array(*[F.lit(float(k)) - F.col("at") for k in range(1, MOST + 1)])).alias("e"))
    cuts = materialize(_cuts(events, s.filter("source_size > 0"), nearest=False))
    small = F.col("size") * 2 <= F.col("rest")
    open_ = events.join(cuts, "sid").filter(small & (F.col("e") >= F.col("cut"))).select("sid", "size", "e")
    fill = _cuts(open_, cuts.filter("rest > 0").select("sid", F.col("rest").alias("target")), nearest=True)
    cuts = cuts.join(fill.select("sid", F.col("cut").alias("fill")), "sid", "left")
    e = [F.lit(float(k)) - F.col("at") for k in range(1, MOST + 1)]
    copies = sum(F.coalesce((x < F.col("cut")) | (small & (x < F.col("fill"))), F.lit(False)).cast("int") for x in e)
    out = rated.join(cuts, "sid", "left").withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(copies))
    return out.select("id", "source", "size", "source_size", "target", "rate", "copies")
