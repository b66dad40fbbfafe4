"""Quality classifier: logistic regression over hashed word n-grams.

Features are the word uni- and bigrams of a whole text, once as written and once as word shapes
(runs of small letters, capitals and digits reduced to one sign each; the shape of a bigram also
tells whether both words are the same), hashed to ``FEATURES`` places.  A text's vector holds each place's share of its n-grams, so length doesn't count.
Training is follow-the-regularised-leader (per-coordinate adaptive steps, L1 and L2 terms), done on
``SHARDS`` disjoint parts of the labelled rows in parallel, whose weights are averaged.  A score is
one sparse dot product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import broadcast_if_small, flat, hashes, mixed, ready, words
from wayfold.session import materialize

#: Bound of the weight vector (held by the driver and every task) and of the labelled rows fitted.
FEATURES, MOST_ROWS = 1 << 18, 20_000
SHARDS, EPOCHS = 4, 6
ALPHA, BETA, L1, L2 = 2.0, 0.1, 0.002, 0.01
SCALE = 8.0

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature places of all texts in order, and each text's first one (with a closing entry)."""
    data, offsets = flat(column)
    starts, ends, first = words(data, offsets)
    word = hashes(data, starts, ends)
    shaped = SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shaped[1:] != shaped[:-1]) | (shaped[1:] < 48)
    keep[starts] = True
    at = np.cumsum(keep) - 1
    shape = hashes(shaped[keep], at[starts], at[ends - 1] + 1) if len(starts) else word
    n = len(word)
    parts = np.zeros((n, 4), np.uint64)
    parts[:, 0] = word
    parts[:, 1] = mixed(shape, 21)
    if n > 1:
        for j, h in ((2, word), (3, shape)):
            parts[:-1, j] = mixed(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:], 20 + j)
        parts[:-1, 3] = mixed(parts[:-1, 3] + (word[:-1] == word[1:]).astype(np.uint64))
        last = first[1:][np.diff(first) > 0] - 1
        parts[last, 2] = mixed(word[last], 31)
        parts[last, 3] = mixed(shape[last], 32)
    elif n:
        parts[:, 2], parts[:, 3] = mixed(word, 31), mixed(shape, 32)
    return (parts & np.uint64(FEATURES - 1)).astype(np.int32).reshape(-1), first * 4


def features(docs: DataFrame) -> DataFrame:
    """(id, label, at, share): the sparse vector of each text."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            places, first = _grams(b.column(2))
            at, share = [], []
            for i, j in zip(first[:-1], first[1:]):
                k, c = np.unique(places[i:j], return_counts=True)
                at.append(k)
                share.append((c / max(j - i, 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["id", "label", "at", "share"])

    return docs.select("id", "label", "text").mapInArrow(run, "id long, label int, at array<int>, share array<float>")


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's weights.  Place ``FEATURES`` is the intercept."""
    rows = rows.sort_values(["turn", "id"])
    z, n = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    vectors = [(np.append(np.asarray(a, np.int64), FEATURES), np.append(np.asarray(s, float) * SCALE, 1.0), y) for a, s, y in zip(rows["at"], rows["share"], rows["label"])]
    for _ in range(EPOCHS):
        for at, x, y in vectors:
            zi, ni = z[at], n[at]
            w = _weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[at] = grown
    w = _weights(z, n)
    at = np.flatnonzero(w)
    return pd.DataFrame({"at": at.astype(np.int32), "w": w[at]})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights from the labelled rows, of which at most about ``MOST_ROWS`` are taken, by hash of the id.

    Labels other than 0 and 1 and rows without id are left out; without any labelled text the
    weights are all 0 (every score 0.5).
    """
    ready(docs.sparkSession)
    lab = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    lab = materialize(lab.groupBy("id").agg(F.max("label").alias("label")))
    part = min(1.0, MOST_ROWS / max(lab.count(), 1))
    lab = lab.withColumn("turn", F.shiftrightunsigned(F.xxhash64("id", F.lit("order")), 11)).filter(F.col("turn") < int(part * (1 << 53)))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    x = features(d.join(broadcast_if_small(lab.drop("turn"), MOST_ROWS), "id"))
    x = x.withColumn("turn", F.xxhash64("id", F.lit("order"))).withColumn("shard", F.pmod("turn", F.lit(SHARDS)))
    w = x.groupBy("shard").applyInPandas(lambda p: _follow(p).assign(shard=p["shard"].iloc[0]), "at int, w double, shard long")
    w = materialize(w)
    shards = w.agg(F.count_distinct("shard")).first()[0]
    by_shard = F.array_sort(F.collect_list(F.struct("shard", "w")))  # SHARDS values, summed in their order so that reruns agree
    got = w.groupBy("at").agg(F.aggregate(by_shard, F.lit(0.0), lambda a, x: a + x["w"]).alias("w")).toPandas()  # at most FEATURES + 1 rows
    out = np.zeros(FEATURES + 1)
    out[got["at"].to_numpy()] = got["w"].to_numpy() / max(shards, 1)
    return out


def scored(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1, for empty and null texts that of the intercept."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        w = shared.value
        places, first = _grams(text)
        size = np.diff(first)
        dot = np.zeros(len(size))
        if len(places):  # one sum a text, so that a score doesn't depend on the texts beside it
            dot[size > 0] = np.add.reduceat(w[places], first[:-1][size > 0])
        dot = dot / np.maximum(size, 1) * SCALE + w[FEATURES]
        return pa.array(1 / (1 + np.exp(-dot)))

    return docs.withColumn(name, score(F.col(f"`{text_col}`").cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0
